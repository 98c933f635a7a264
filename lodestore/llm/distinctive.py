"""How distinctive a term is per record: divergence from randomness.

Score of a term t in record d, with N records, F occurrences of t in all of them, mean length avgdl:

    tfn   = tf * log2(1 + c * avgdl / dl)                      length-normalised frequency (normalisation 2)
    inf   = log2(1 + F/N) + tfn * log2((1 + F/N) / (F/N))      information under the geometric model
    gain  = 1 / (tfn + 1)                                      Laplace after-effect
    score = inf * gain

Defined results
* Rows with a null term or record id take no part; so do entries of records that are not in the record table.
* Repeated rows of one (record, term) count once; of unequal ones the largest tf counts.
* A null tf means "present, frequency unknown": it counts as 1.
* A null or non-positive dl counts as the mean length.
* Ties go to the smaller term. An empty table gives an empty result.
* Extra columns are ignored: only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


def geometric_laplace(tf: Column, dl: Column, total: Column, records: float, mean_length: float, c: float = 1.0) -> Column:
    """The score above as a column expression; it stays inside code generation."""
    tfn = tf * F.log2(F.lit(1.0) + F.lit(c * mean_length) / dl)
    rate = total / F.lit(float(records))
    return (F.log2(F.lit(1.0) + rate) + tfn * F.log2((F.lit(1.0) + rate) / rate)) / (tfn + F.lit(1.0))


def clean_postings(postings: DataFrame, records: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """(chunk_id, term, tf, dl, wanted), one row per entry of a record that exists.

    All steps share one shuffle by record id: the de-duplication, the semi-join that drops entries of lost
    records, and the mark of the records asked about.
    """
    rows = (
        postings.where(F.col("term").isNotNull() & F.col("chunk_id").isNotNull())
        .select("chunk_id", "term", "tf", "dl")
        .repartition(F.col("chunk_id"))
        .groupBy("chunk_id", "term")
        .agg(F.coalesce(F.max("tf"), F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
    )
    rows = rows.join(records.select("chunk_id").distinct(), "chunk_id", "left_semi")
    if probes is None:
        return rows.withColumn("wanted", F.lit(True))
    marks = probes.select("chunk_id").where(F.col("chunk_id").isNotNull()).distinct().withColumn("wanted", F.lit(True))
    return rows.join(marks, "chunk_id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))


def term_scores(postings: DataFrame, records: DataFrame, probes: DataFrame | None = None, c: float = 1.0) -> DataFrame:
    """(chunk_id, term, tf, df, score) for every term of every record (or of the probes only).

    Statistics always cover the whole collection; probes only restrict which rows are scored. The cleaned
    entries are written once, so that statistics and scores read them with their own columns. Term statistics
    combine on the map side, so a term that occurs everywhere sends one row per task.
    """
    entries = written(clean_postings(postings, records, probes), "postings")
    n = records.select("chunk_id").where(F.col("chunk_id").isNotNull()).distinct().count()
    tokens = entries.agg(F.sum("tf").alias("t")).first()["t"]
    mean_length = float(tokens or 0) / max(n, 1) or 1.0
    stats = entries.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    scored = entries.where("wanted").join(stats, "term")
    dl = F.when(F.col("dl") > 0, F.col("dl").cast("double")).otherwise(F.lit(mean_length))
    score = geometric_laplace(F.col("tf").cast("double"), dl, F.col("total").cast("double"), max(n, 1), mean_length, c)
    return scored.select("chunk_id", "term", "tf", "df", score.alias("score"))


def most_distinctive(scores: DataFrame, min_tf: int = 2, min_df: int = 2) -> DataFrame:
    """(chunk_id, term): per record its best term among those that come back and that another record shares.

    One aggregate with a partial step, not a window: a record with many terms is never sorted in one task.
    """
    best = F.min(F.struct(F.round(-F.col("score"), 9).alias("s"), F.col("term"))).alias("best")
    kept = scores.where((F.col("tf") >= min_tf) & (F.col("df") >= min_df))
    return kept.groupBy("chunk_id").agg(best).select("chunk_id", F.col("best.term").alias("term"))
