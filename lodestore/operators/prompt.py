"""Token-budgeted prompts: ordered folds over a query's few passages and turns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

Counter = Callable[[Column], Column]

#: Fixed: the prompt's wording, whose length counts towards the budget.
HISTORY_HEADER = "Conversation so far (for reference only; do not cite it):\n"
CONTEXT_HEADER = "Context Information:\n"
QUESTION_HEADER = "User Question:\n"
CLOSING = "Answer based strictly on the context above. Cite sources using [1], [2], etc."
OVERHEAD = "Context Information:\n\nUser Question:\n\n\n" + CLOSING


def passage_cost(chunk_id: Column, content: Column, ratio: float = 4.0, count: Counter | None = None) -> Column:
    """Tokens of a passage as it will stand in the prompt, with a placeholder for its number."""
    text = F.concat(F.lit("[0] (ID: "), chunk_id, F.lit(")\n"), F.coalesce(content, F.lit("")), F.lit("\n\n"))
    return count(text) if count else tx.token_estimate(text, ratio)


def bpe_counter(encoding: Callable[[], object]) -> Counter:
    """Counts byte-pair tokens; encoding() is called once per task and gives encode(text)."""

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoding()
        for texts in parts:
            yield texts.map(lambda t: len(bpe.encode(t)) if t else 0).astype("int64")

    return count


def middle_position(i: Column, n: Column) -> Column:
    """Where the passage of rank i (from 0) of n goes, so that the best stand at both ends."""
    return F.when(n <= 2, i).when(i % 2 == 0, F.floor(i / 2)).otherwise(n - 1 - F.floor((i - 1) / 2)).cast("int")


def choose_passages(hits: DataFrame, budget: Column | int, ratio: float = 4.0, count: Counter | None = None) -> DataFrame:
    """(query_id, place, chunk_id, content): what fits, in prompt order from 1.

    In rank order a passage is taken if it still fits and skipped otherwise; a later, smaller one may fit.
    budget may be a column that is equal in all rows of a query.
    """
    budget = F.lit(budget) if not isinstance(budget, Column) else budget
    rows = hits.withColumn("_cost", passage_cost(F.col("chunk_id"), F.col("content"), ratio, count).cast("bigint")).withColumn("_budget", budget.cast("bigint"))
    listed = rows.groupBy("query_id").agg(F.first("_budget").alias("budget"), F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "content", F.col("_cost").alias("cost")))).alias("hits"))
    kind = listed.schema["hits"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(kind).alias("kept"))

    def step(acc, h):
        fits = acc["used"] + h["cost"] <= F.col("budget")
        return F.struct(F.when(fits, acc["used"] + h["cost"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["kept"], h)).otherwise(acc["kept"]).alias("kept"))

    kept = listed.select("query_id", F.aggregate("hits", start, step, lambda acc: acc["kept"]).alias("kept"))
    placed = kept.select("query_id", F.size("kept").alias("n"), F.posexplode("kept").alias("i", "h"))
    return placed.select("query_id", (middle_position(F.col("i"), F.col("n")) + 1).alias("place"), "h.chunk_id", "h.content")


def passages_text(chosen: DataFrame) -> DataFrame:
    """(query_id, context, sources): the passages numbered in order."""
    one = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] (ID: "), F.col("chunk_id"), F.lit(")\n"), F.coalesce("content", F.lit("")), F.lit("\n\n"))
    listed = chosen.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", one.alias("text"), "chunk_id"))).alias("p"))
    return listed.select("query_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("context"), F.transform("p", lambda x: x["chunk_id"]).alias("sources"))


def history_text(turns: Column, budget: Column | int, ratio: float = 4.0) -> Column:
    """The newest turns that fit, oldest first; the first that does not fit ends the walk back."""
    budget = F.lit(budget) if not isinstance(budget, Column) else budget
    line = F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"], F.lit("\n")))
    head = tx.token_estimate(F.lit(HISTORY_HEADER + "\n"), ratio)
    start = F.struct(head.alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("full"))

    def step(acc, x):
        full = acc["full"] | (acc["used"] + tx.token_estimate(x, ratio) > budget)
        return F.struct(F.when(full, acc["used"]).otherwise(acc["used"] + tx.token_estimate(x, ratio)).alias("used"), F.when(full, acc["kept"]).otherwise(F.concat(F.array(x), acc["kept"])).alias("kept"), full.alias("full"))

    kept = F.aggregate(F.reverse(F.coalesce(line, F.array().cast("array<string>"))), start, step, lambda acc: acc["kept"])
    return F.when(F.size(kept) == 0, F.lit("")).otherwise(F.concat(F.lit(HISTORY_HEADER), F.array_join(kept, ""), F.lit("\n")))


def build_prompts(questions: DataFrame, hits: DataFrame, max_tokens: int = 4096, system: str = "", ratio: float = 4.0) -> DataFrame:
    """(query_id, prompt, sources) for questions(query_id, question[, history]); history takes a quarter at most."""
    if "history" not in questions.columns:
        questions = questions.withColumn("history", F.lit(None).cast("array<struct<role:string,content:string>>"))
    said = questions.withColumn("said", history_text(F.col("history"), max_tokens // 4, ratio))
    cost = tx.token_estimate(F.lit(OVERHEAD), ratio) + tx.token_estimate(F.col("question"), ratio) + tx.token_estimate(F.col("said"), ratio)
    if system:
        cost = cost + tx.token_estimate(F.lit(system + "\n\n"), ratio)
    said = said.withColumn("budget", F.greatest(F.lit(max_tokens).cast("bigint") - cost, F.lit(0).cast("bigint")))
    chosen = choose_passages(hits.join(said.select("query_id", "budget"), "query_id"), F.col("budget"), ratio)
    full = said.join(passages_text(chosen), "query_id", "left")
    text = F.concat(F.lit(system + "\n\n" if system else ""), F.col("said"), F.lit(CONTEXT_HEADER), F.coalesce("context", F.lit("")), F.lit(QUESTION_HEADER), F.col("question"), F.lit("\n\n" + CLOSING))
    return full.select("query_id", text.alias("prompt"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def prompt_tokens(question: Column, contents: Column) -> Column:
    """The estimate that is reported for a prompt: question and passages alone."""
    one = lambda t: F.greatest(F.lit(1), F.floor(F.octet_length(t) / 4)).cast("bigint")
    return F.aggregate(F.transform(contents, one), one(question), lambda a, x: a + x)
