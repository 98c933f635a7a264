"""Vector search by brute force, exact: blocks of queries against blocks of vectors.

Every pair of blocks is one bounded task with a matrix product; each returns its k best per query, and the k best of
those are the answer. No pair of single rows is ever joined, and neither side is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import compile_filter
from ..functions.scores import top_k

_EMPTY = "query_id string, search_no int, chunk_id string, dense double"


def _matrix(values: pd.Series) -> np.ndarray:
    if len({len(v) for v in values}) > 1:
        raise ValueError("vector has another dimension")
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(1))


def cosine_table(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision; 0 where a vector is all zero."""
    scale = _norms(q)[:, None] * _norms(x)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale == 0, 0.0, (q @ x.T) / scale)


def search_dense(searches: DataFrame, chunks: DataFrame, k: int, *, where: dict | None = None, floor: float = 0.0, within: str | None = None, block: int = 20_000, query_block: int = 1_000) -> DataFrame:
    """(query_id, search_no, chunk_id, dense, rank) for searches(query_id, search_no, vector).

    The filter is tested before scoring, so a vector it excludes cannot fail the search. Any other vector of a length
    unlike the query's fails it. floor > 0 drops weaker hits before ranks are given. within names a column of both: only
    vectors that equal the search in it are searched, each value in blocks of its own; null equals nothing.
    """
    if where:
        chunks = chunks.where(compile_filter(where, F.col("meta")))
    only = [F.col(within)] if within else []
    held = chunks.where(F.col("embedding").isNotNull() & F.col("chunk_id").isNotNull()).select("chunk_id", "embedding", *only)
    asked = searches.where(F.col("vector").isNotNull()).select("query_id", "search_no", "vector", *only)
    if k <= 0:
        return asked.limit(0).select("query_id", "search_no", F.lit("").alias("chunk_id"), F.lit(0.0).alias("dense"), F.lit(1).alias("rank"))
    grid = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    if within:
        xs = held.where(F.col(within).isNotNull()).groupBy(within).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("xb"))
        qs = asked.where(F.col(within).isNotNull()).groupBy(within).agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("qb"))
        sizes = xs.join(qs, within)
        asked, held = asked.join(sizes, within), held.join(sizes, within)
    else:
        xb, qb = max(1, -(-held.count() // block)), max(1, -(-asked.count() // query_block))
        asked, held = (rows.withColumns({"xb": F.lit(xb), "qb": F.lit(qb)}) for rows in (asked, held))
    left = asked.withColumn("j", F.pmod(F.xxhash64("query_id", "search_no"), F.col("qb")).cast("int")).withColumn("i", grid(F.col("xb"))).drop("xb", "qb")
    right = held.withColumn("i", F.pmod(F.xxhash64("chunk_id"), F.col("xb")).cast("int")).withColumn("j", grid(F.col("qb"))).drop("xb", "qb")

    def run(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "search_no": [], "chunk_id": [], "dense": []}, dtype=object)
        x = x.sort_values("chunk_id", ignore_index=True)
        qv, xv = _matrix(q["vector"]), _matrix(x["embedding"])
        if qv.shape[1] != xv.shape[1]:
            raise ValueError("vector has another dimension")
        cos = cosine_table(qv, xv)
        cos = np.where(np.isnan(cos), -np.inf, cos)
        top = np.argsort(-np.round(cos, 9), axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(cos, top, 1).ravel()
        keep = value >= floor if floor > 0 else np.ones(len(value), bool)
        each = lambda c: np.repeat(q[c].to_numpy(dtype=object), top.shape[1])[keep]
        return pd.DataFrame({"query_id": each("query_id"), "search_no": each("search_no"), "chunk_id": x["chunk_id"].to_numpy(dtype=object)[top.ravel()[keep]], "dense": value[keep]}, dtype=object)

    keys = [within] * bool(within) + ["i", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, _EMPTY)
    return top_k(found, ["query_id", "search_no"], k, "dense").select("query_id", "search_no", "chunk_id", "dense", "rank")
