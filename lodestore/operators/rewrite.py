"""Query rewriting: model replies to searches, with injected completers; and the search list's own rules.

A rewriter takes questions(query_id, question, history) and adds `rewritten` (a standalone question or null),
`searches` (array of text and target) and `rewrite_error`. A failing model never fails the batch: the row keeps what
there was, and the error is recorded.
"""

from __future__ import annotations

import contextlib
import contextvars
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .context import Completer

SEARCHES = "array<struct<text:string,target:string>>"
HISTORY_TURNS, TURN_BYTES, PASSAGE_BYTES = 6, 1000, 2000

Rewriter = Callable[[DataFrame], DataFrame]


def _none() -> Column:
    return F.array().cast(SEARCHES)


def prepared(questions: DataFrame) -> DataFrame:
    """Questions with the columns that rewriters read and write."""
    have = questions.columns
    if "history" not in have:
        questions = questions.withColumn("history", F.lit(None).cast("array<struct<role:string,content:string>>"))
    if "rewritten" not in have:
        questions = questions.withColumn("rewritten", F.lit(None).cast("string"))
    if "searches" not in have:
        questions = questions.withColumn("searches", _none())
    if "rewrite_error" not in have:
        questions = questions.withColumn("rewrite_error", F.lit(None).cast("string"))
    return questions


def current(row_question: str = "question") -> Column:
    """The question as rewritten so far."""
    return F.coalesce("rewritten", row_question)


def _ask(rows: DataFrame, prompt: Column, completer: Completer, wanted: Column) -> DataFrame:
    """Adds reply (null if not asked or failed) and the error. One Arrow batch at a time, no call without need."""
    completer = timed(completer, _LIMIT.get())

    @F.pandas_udf("struct<reply:string,error:string>")
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in parts:
            out = []
            for p in prompts:
                if p is None:
                    out.append((None, None))
                    continue
                try:
                    out.append((completer("", p), None))
                except Exception as error:  # noqa: BLE001 - absorbed and recorded
                    out.append((None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["reply", "error"])

    open_row = wanted & F.col("rewrite_error").isNull()  # a chain stops at its first error
    asked = rows.withColumn("_r", call(F.when(open_row, prompt)))
    return asked.withColumn("rewrite_error", F.coalesce("rewrite_error", F.col("_r.error"))).withColumn("_reply", F.col("_r.reply")).drop("_r")


_LIMIT: contextvars.ContextVar[float] = contextvars.ContextVar("limit", default=0.0)


@contextlib.contextmanager
def time_limit(seconds: float) -> Iterator[None]:
    """Model calls of rewriters that are applied within take at most so long each; a late one counts as an error of its row."""
    token = _LIMIT.set(seconds)
    try:
        yield
    finally:
        _LIMIT.reset(token)


def timed(completer: Completer, seconds: float) -> Completer:
    """A completer that gives up after `seconds` (none if not positive); the call that hangs is left behind."""
    if seconds <= 0:
        return completer

    def ask(prefix: str, text: str) -> str:
        import queue
        import threading

        got: queue.SimpleQueue = queue.SimpleQueue()

        def work() -> None:
            try:
                got.put((completer(prefix, text), None))
            except Exception as error:  # noqa: BLE001 - raised again by the caller
                got.put((None, error))

        threading.Thread(target=work, daemon=True).start()
        try:
            reply, error = got.get(timeout=seconds)
        except queue.Empty:
            raise TimeoutError(f"no reply within {seconds} s") from None
        if error is not None:
            raise error
        return reply

    return ask


def _add(rows: DataFrame, texts: Column, target: str) -> DataFrame:
    more = F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(target).alias("target")))
    return rows.withColumn("searches", F.concat("searches", F.coalesce(more, _none()))).drop("_reply")


def condense(completer: Completer) -> Rewriter:
    """A follow-up becomes a standalone question; without history nothing is asked."""

    def run(questions: DataFrame) -> DataFrame:
        rows = prepared(questions)
        last = F.slice(F.col("history"), F.greatest(F.size("history") - HISTORY_TURNS + 1, F.lit(1)), HISTORY_TURNS)
        said = F.array_join(F.transform(last, lambda t: F.concat(t["role"], F.lit(": "), tx.truncate_bytes(tx.trim(t["content"]), TURN_BYTES))), "\n")
        prompt = F.concat(F.lit("Rewrite the follow-up question so that it can be understood without the conversation. Keep the names, numbers and dates it refers to. Output only the question.\n\n<conversation>\n"), said, F.lit("\n</conversation>\nFollow-up question: "), current())
        asked = _ask(rows, prompt, completer, F.coalesce(F.size("history"), F.lit(0)) > 0)
        line = F.try_element_at(tx.cleaned_lines(F.col("_reply"), 1, F.lit("")), F.lit(1))
        return asked.withColumn("rewritten", F.coalesce(line, F.col("rewritten"))).drop("_reply")

    return run


def multi_query(completer: Completer, n: int = 3) -> Rewriter:
    """Up to n rephrasings, for all indexes."""
    n = n if n > 0 else 3

    def run(questions: DataFrame) -> DataFrame:
        prompt = F.concat(F.lit(f"Write {n} different short search queries that would find documents answering the question. Output one query per line and nothing else.\n\nQuestion: "), current())
        asked = _ask(prepared(questions), prompt, completer, F.lit(True))
        return _add(asked, tx.cleaned_lines(F.col("_reply"), n, current()), "all")

    return run


def decompose(completer: Completer, n: int = 4) -> Rewriter:
    """Up to n sub-questions, for all indexes; the question itself adds nothing."""
    n = n if n > 0 else 4

    def run(questions: DataFrame) -> DataFrame:
        prompt = F.concat(F.lit(f"Break the question into the simpler questions, at most {n}, that must be looked up to answer it. If it asks about one thing, repeat it. Output one question per line and nothing else.\n\nQuestion: "), current())
        asked = _ask(prepared(questions), prompt, completer, F.lit(True))
        return _add(asked, tx.cleaned_lines(F.col("_reply"), n, current()), "all")

    return run


def hyde(completer: Completer) -> Rewriter:
    """A made-up answer passage, for the vector index alone."""

    def run(questions: DataFrame) -> DataFrame:
        prompt = F.concat(F.lit("Write a short passage that would answer the question, as it might stand in a document. Output only the passage.\n\nQuestion: "), current())
        asked = _ask(prepared(questions), prompt, completer, F.lit(True))
        passage = tx.truncate_bytes(tx.trim(tx.without_thoughts(F.col("_reply"))), PASSAGE_BYTES)
        return _add(asked, F.when(F.coalesce(passage, F.lit("")) != "", F.array(passage)), "dense")

    return run


def chain(*rewriters: Rewriter) -> Rewriter:
    """One after another: later ones see the new question, searches add up, a row's first error ends its chain."""

    def run(questions: DataFrame) -> DataFrame:
        rows = prepared(questions)
        for r in rewriters:
            rows = r(rows)
        return rows

    return run


def deduplicate(searches: Column) -> Column:
    """Search list without blanks and repeats.

    A search is dropped if the last kept one with the same normal text was for all indexes or for the same one. The
    fold keeps, per text, only the target last kept.
    """
    start = F.struct(F.create_map().cast("map<string,string>").alias("last"), _none().alias("kept"))

    def step(acc, s):
        key = tx.normalise(s["text"])
        before = F.element_at(acc["last"], key)
        drop = (key == "") | F.coalesce((before == "all") | (before == s["target"]), F.lit(False))
        kept = F.struct(tx.trim(s["text"]).alias("text"), s["target"].alias("target"))
        renewed = F.map_concat(F.map_filter(acc["last"], lambda k, v: k != key), F.create_map(key, s["target"]))
        return F.struct(F.when(drop, acc["last"]).otherwise(renewed).alias("last"), F.when(drop, acc["kept"]).otherwise(F.array_append(acc["kept"], kept)).alias("kept"))

    named = F.filter(searches, lambda s: s["text"].isNotNull() & s["target"].isNotNull())
    return F.aggregate(F.coalesce(named, _none()), start, step, lambda acc: acc["kept"])


def search_rows(questions: DataFrame) -> DataFrame:
    """(query_id, search_no, text, target): the question first, for all indexes, then its rewrites, numbered."""
    own = F.array(F.struct(current().alias("text"), F.lit("all").alias("target"))).cast(SEARCHES)
    rows = prepared(questions)
    return rows.select("query_id", F.posexplode(deduplicate(F.concat(own, F.col("searches")))).alias("search_no", "s")).select("query_id", "search_no", "s.text", "s.target")
