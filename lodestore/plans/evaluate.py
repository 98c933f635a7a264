"""Retrieval quality: hit rate, recall, MRR and nDCG over ranked hits, as aggregates.

cases(case_id, category, wants array<string>) against hits(case_id, rank, content, source): an expectation is met by
the first hit whose normalised content contains it (text) or whose source equals it (sources).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import written


def first_ranks(cases: DataFrame, hits: DataFrame, k: int, by: str = "text") -> DataFrame:
    """(case_id, category, want_no, first): the first rank that meets each expectation, null if none; cases without any are skipped."""
    k = k if k > 0 else 5
    wants = cases.select("case_id", "category", F.posexplode("wants").alias("want_no", "want"))
    top = hits.where(F.col("rank") <= k)
    if by == "text":
        met: Column = tx.normalise(F.coalesce("content", F.lit(""))).contains(tx.normalise(F.col("want")))
    else:
        met = F.col("source") == F.col("want")
    joined = wants.join(top, "case_id", "left")
    return joined.groupBy("case_id", "category", "want_no").agg(F.min(F.when(met, F.col("rank"))).alias("first"))


def case_scores(firsts: DataFrame, k: int) -> DataFrame:
    """(case_id, category, hit, recall, rr, ndcg); a rank that meets several expectations gains once."""
    k = k if k > 0 else 5
    gain = lambda r: F.lit(1.0) / F.log2(r.cast("double") + 1)
    rows = firsts.groupBy("case_id", "category").agg(F.count(F.lit(1)).alias("wanted"), F.count("first").alias("found"), F.min("first").alias("best"), F.array_sort(F.collect_set("first")).alias("ranks"))
    dcg = F.aggregate("ranks", F.lit(0.0), lambda a, r: a + gain(r))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + gain(r))
    return rows.select("case_id", "category", (F.col("found") > 0).cast("double").alias("hit"), (F.col("found") / F.col("wanted")).alias("recall"), F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0)).alias("rr"), (dcg / ideal).alias("ndcg"))


def report(scores: DataFrame) -> DataFrame:
    """Means in total (category null) and by category, in one pass."""
    return scores.groupingSets([["category"], []], "category").agg(F.count(F.lit(1)).alias("cases"), F.avg("hit").alias("hit_rate"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"))


def evaluate(cases: DataFrame, hits: DataFrame, k: int = 5, by: str = "text") -> DataFrame:
    return report(case_scores(first_ranks(cases, hits, k, by), k))


def misses(scores: DataFrame) -> DataFrame:
    return scores.where("hit = 0").select("case_id", "category")


def run(engine, cases: DataFrame, k: int = 5, by: str = "text", where: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, scores per case) of an engine for cases(case_id, question, category, wants[, history]).

    All questions are one batch; candidates are recalled to a depth of at least 50, and the k best count. Cases without
    expectations are not asked.
    """
    k = k if k > 0 else 5
    asked = cases.where(F.size("wants") > 0)
    questions = asked.select(F.col("case_id").alias("query_id"), "question", *(["history"] if "history" in cases.columns else []))
    hits = engine.retrieve_batch(questions, where, recall=max(k, 50), top_n=k)
    source = F.element_at("meta", "source")["s"]
    hits = written(hits.select(F.col("query_id").alias("case_id"), "rank", tx.index_text(F.col("context"), F.col("content")).alias("content"), source.alias("source")), "evaluated")
    scores = case_scores(first_ranks(asked, hits, k, by), k)
    return report(scores), scores


def unknown_expectations(cases: DataFrame, corpus: DataFrame, at_once: int = 50_000) -> DataFrame:
    """Expected texts that no document holds: a check of the cases themselves.

    Expectations are written by hand, so they are few next to the corpus: one pass over it looks for all of them at once
    with an automaton; above `at_once` of them one pass for each so many.
    """
    wants = cases.select(F.explode("wants").alias("want")).distinct().select("want", tx.normalise(F.col("want")).alias("norm"))
    wants = written(wants.where(F.col("want").isNotNull()), "wants")
    norms = [r["norm"] for r in wants.select("norm").distinct().orderBy("norm").toLocalIterator()]
    spark, found = corpus.sparkSession, None
    for lo in range(0, len(norms), at_once):
        part = spark.sparkContext.broadcast(norms[lo : lo + at_once])

        def look(batches, part=part):
            words = set(part.value)
            contained = _finder(words)
            for batch in batches:
                got = {w for text in batch.column(0).to_pylist() if text is not None for w in contained(text)}
                yield pa.record_batch([pa.array(sorted(got), pa.string())], names=["norm"])

        some = corpus.select(tx.normalise(F.col("content")).alias("body")).mapInArrow(look, "norm string")
        found = some if found is None else found.unionByName(some)
    if found is None:
        return wants.select("want")
    return wants.join(found.distinct(), "norm", "left_anti").select("want")


def _finder(words: set[str]):
    """text -> those of words that it contains; an empty word is in every text."""
    empty = {w for w in words if not w}
    try:
        import ahocorasick
    except ImportError:
        return lambda text: {w for w in words if w in text}
    automaton = ahocorasick.Automaton()
    for w in words - empty:
        automaton.add_word(w, w)
    if not len(automaton):
        return lambda text: empty
    automaton.make_automaton()
    return lambda text: empty | {w for _, w in automaton.iter(text)}
