"""Rank fusion of labelled lists. Input: hits(query_id, search_no, is_dense, is_rewrite, rank, chunk_id, dense, sparse, score)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import min_max, sigmoid, top_k
from ..sources.shared import written

Fusion = Callable[[DataFrame, int], DataFrame]


def _carried() -> list[Column]:
    """The best dense and sparse score of a chunk over its lists; 0 is 'not scored' and never wins over a negative one."""
    best = lambda c: F.coalesce(F.max(F.when(F.col(c) != 0, F.col(c))), F.lit(0.0)).alias(c)
    return [best("dense"), best("sparse")]


def _weight(rewrite: float) -> Column:
    w = rewrite if rewrite > 0 else 1.0
    return F.when(F.coalesce(F.col("is_rewrite"), F.lit(False)), F.lit(float(w))).otherwise(F.lit(1.0))


def rrf(k: int = 60, rewrite_weight: float = 1.0) -> Fusion:
    """Reciprocal rank fusion: the sum of weight / (k + rank); k <= 0 is 60, a weight <= 0 is 1."""
    k = k if k > 0 else 60

    def fuse(hits: DataFrame, limit: int) -> DataFrame:
        part = _weight(rewrite_weight) / (F.lit(float(k)) + F.col("rank"))
        fused = hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"), *_carried())
        return top_k(fused, ["query_id"], limit)

    return fuse


def convex(alpha: float = 0.5, rewrite_weight: float = 1.0) -> Fusion:
    """alpha * best dense + (1 - alpha) * best sparse of weighted logistic scores; alpha outside 0..1 is 0.5."""
    alpha = alpha if 0 <= alpha <= 1 else 0.5

    def fuse(hits: DataFrame, limit: int) -> DataFrame:
        value = _weight(rewrite_weight) * sigmoid(F.col("score"))
        side = lambda is_dense: F.coalesce(F.max(F.when(F.col("is_dense") == F.lit(is_dense), value)), F.lit(0.0))
        fused = hits.groupBy("query_id", "chunk_id").agg((F.lit(alpha) * side(True) + F.lit(1 - alpha) * side(False)).alias("score"), *_carried())
        return top_k(fused, ["query_id"], limit)

    return fuse


def convex_pair(hits: DataFrame, limit: int, alpha: float) -> DataFrame:
    """Two-list blend; a bad alpha or limit gives no rows."""
    if limit <= 0 or not 0 <= alpha <= 1:
        return convex()(hits.limit(0), 1)
    return convex(alpha)(hits, limit)


def rrf_pair(dense: DataFrame, sparse: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of a vector list and a BM25 list per query; no limit, no rows."""
    both = label(dense, True).unionByName(label(sparse, False))
    return rrf(k)(both, limit) if limit > 0 else rrf(k)(both.limit(0), 1)


def fuse_or_keep(hits: DataFrame, fusion: Fusion, limit: int) -> DataFrame:
    """Fusion, except that the only list of a query is taken as it is, with its raw scores.

    The lists are read three times and are few next to what made them, so they are written once.
    """
    hits = written(hits, "lists")
    lists = hits.groupBy("query_id").agg(F.count_distinct("search_no", "is_dense").alias("lists"))
    marked = hits.join(lists, "query_id")
    many = fusion(marked.where("lists > 1").drop("lists"), limit)
    single = marked.where("lists = 1").select("query_id", "chunk_id", "score", F.coalesce("dense", F.lit(0.0)).alias("dense"), F.coalesce("sparse", F.lit(0.0)).alias("sparse"), "rank")
    return many.unionByName(single.where(F.col("rank") <= limit))


def label(hits: DataFrame, is_dense: bool) -> DataFrame:
    """Hits of one index as rows of ranked lists; lists of searches after the question's own count as rewrites."""
    score = F.col("dense" if is_dense else "sparse")
    other = F.lit(0.0)
    return hits.select("query_id", "search_no", F.lit(is_dense).alias("is_dense"), (F.col("search_no") > 0).alias("is_rewrite"), "rank", "chunk_id", (score if is_dense else other).alias("dense"), (other if is_dense else score).alias("sparse"), score.alias("score"))


def min_max_lists(hits: DataFrame) -> DataFrame:
    """Every list scaled to 0..1."""
    return min_max(hits, ["query_id", "search_no", "is_dense"])
