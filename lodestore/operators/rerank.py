"""Reranking of a query's candidates: diversity, word overlap, and injected cross-encoders."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scores import top_k
from .dense import cosine_table
from .embedding import Embedder, embed_column


class Scorer(Protocol):
    """A cross-encoder: one score per passage."""

    def score(self, question: str, passages: list[str]) -> list[float]: ...


def _usable(v) -> bool:
    return v is not None and len(v) > 0


def mmr_order(query, vectors: list, scores: np.ndarray, n: int, lam: float) -> list[int]:
    """Indices in the order of maximal marginal relevance; the first of equals wins.

    Similarity to the question falls back to the score where a vector is missing or of another length; chunks that
    cannot be compared do not repel each other.
    """
    m = len(scores)
    relevance = np.array(scores, dtype=np.float64)
    sims = np.full((m, m), -np.inf)
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if _usable(v):
            by_size.setdefault(len(v), []).append(i)
    for size, rows in by_size.items():
        x = np.stack([np.asarray(vectors[i], np.float64) for i in rows])
        sims[np.ix_(rows, rows)] = cosine_table(x, x)
        if _usable(query) and len(query) == size:
            relevance[rows] = cosine_table(np.asarray(query, np.float64)[None, :], x)[0]
    left, chosen = list(range(m)), []
    near = np.full(m, -np.inf)
    while left and len(chosen) < n:
        penalty = np.where(np.isinf(near[left]), 0.0, near[left])
        value = lam * relevance[left] - (1 - lam) * penalty
        pick = left.pop(int(np.argmax(np.round(value, 12))))
        chosen.append(pick)
        near = np.maximum(near, sims[:, pick])
    return chosen


def mmr(candidates: DataFrame, n: int, lam: float = 0.7) -> DataFrame:
    """(…, rank): the n chunks of each query chosen for relevance and novelty; scores stay.

    candidates(query_id, rank, chunk_id, score, vector, embedding) hold a query's recall depth at most, a few dozen
    rows, so a group fits a task whatever the corpus. lam 0 stands for 0.7; outside 0..1 it is an error.
    """
    lam = lam or 0.7
    if not 0 <= lam <= 1:
        raise ValueError("lambda must be between 0 and 1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        order = mmr_order(pdf["vector"].iloc[0], list(pdf["embedding"]), pdf["score"].to_numpy(), n, lam)
        pdf = pdf.astype({"query_id": object, "chunk_id": object})
        return pdf.iloc[order].assign(rank=np.arange(1, len(order) + 1, dtype=np.int32))[["query_id", "chunk_id", "score", "rank"]]

    return candidates.groupBy("query_id").applyInPandas(run, "query_id string, chunk_id string, score double, rank int")


def mmr_reranker(embedder: Embedder | None = None, lam: float = 0.7) -> Callable[[DataFrame, int], DataFrame]:
    """mmr as a reranker of candidates(query_id, rank, chunk_id, score, question, embedding).

    Each question is embedded once; without an embedder relevance is the candidates' score. lam outside (0, 1] is 0.7.
    """
    lam = lam if 0 < lam <= 1 else 0.7

    def run(candidates: DataFrame, n: int) -> DataFrame:
        rows = candidates.select("query_id", "rank", "chunk_id", "score", "question", "embedding")
        if embedder is None:
            return mmr(rows.withColumn("vector", F.lit(None).cast("array<float>")), n, lam)
        asked = rows.select("question").distinct()
        return mmr(rows.join(asked.withColumn("vector", embed_column(F.col("question"), embedder)), "question"), n, lam)

    return run


def overlap_score(question: Column, content: Column) -> Column:
    """How many words of the question, with repeats, occur in the content."""
    body = F.lower(content)
    return F.size(F.filter(F.split(tx.normalise(question), " "), lambda w: (w != "") & body.contains(w))).cast("double")


def overlap(candidates: DataFrame, n: int) -> DataFrame:
    """Reranks candidates(query_id, chunk_id, question, content) by shared words."""
    scored = candidates.withColumn("score", overlap_score(F.col("question"), F.col("content")))
    return top_k(scored, ["query_id"], n)


def cross_encode(candidates: DataFrame, scorer: Scorer, n: int, text: str | None = None) -> DataFrame:
    """Reranks with an injected scorer that reads the index text where there is one, else the content: one call per query over its candidates, stable order, cut to n."""

    text = text or ("index_text" if "index_text" in candidates.columns else "content")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        got = scorer.score(pdf["question"].iloc[0], list(pdf[text]))
        if len(got) != len(pdf):
            raise ValueError("number of results differs from number of inputs")
        pdf = pdf.astype({"query_id": object, "chunk_id": object}).assign(score=np.asarray(got, np.float64)).sort_values("score", ascending=False, kind="stable")
        pdf = pdf[pdf["score"] > -np.inf].head(n)  # what a server leaves out is no hit
        return pdf.assign(rank=np.arange(1, len(pdf) + 1, dtype=np.int32))[["query_id", "chunk_id", "score", "rank"]]

    return candidates.groupBy("query_id").applyInPandas(run, "query_id string, chunk_id string, score double, rank int")


def cut(candidates: DataFrame, n: int) -> DataFrame:
    """Without a reranker: the first n."""
    return candidates.where(F.col("rank") <= n)


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
