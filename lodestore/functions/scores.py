"""Score columns and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(score: Column, temperature: float = 1.0) -> Column:
    t = temperature if temperature > 0 else 1.0
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score / F.lit(float(t))))


def min_max(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Scales score to 0..1 within keys; equal scores become 1. Extremes come from a partial aggregate, not a window."""
    span = rows.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return rows.join(span, keys).withColumn(score, scaled).drop("_lo", "_hi")


def best_first(score: str = "score", key: str = "chunk_id") -> list[Column]:
    """Order by score to 9 places, highest first, NaN last, then by key: sums in another order cannot flip ranks.

    rint of the scaled score, as round() of a double goes through big decimals for every row.
    """
    return [F.rint(F.nanvl(F.col(score), F.lit(float("-inf"))) * F.lit(1e9)).desc(), F.col(key).asc()]


def ranked(rows: DataFrame, keys: list[str], score: str = "score", key: str = "chunk_id") -> DataFrame:
    """All rows per keys with their rank from 1, best first."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first(score, key))))


def top_k(rows: DataFrame, keys: list[str], k: int, score: str = "score", key: str = "chunk_id") -> DataFrame:
    """The k best rows per keys with their rank from 1. Spark cuts each task's share to k before the shuffle."""
    if k <= 0:
        return rows.limit(0).withColumn("rank", F.lit(1))
    return ranked(rows, keys, score, key).where(F.col("rank") <= k)
