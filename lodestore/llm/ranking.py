"""One ranking from several differently scaled scores.

Each list of a search is standardised by its own median and median absolute deviation, squashed by the logistic
function (so an outlier cannot run away), and the kinds of score (vector, BM25, reranker) are joined by a weighted
geometric mean of the bounded values.

Defined results
* Rows logged twice count once; of unequal rows of one chunk in one list the highest score counts. Rank is not used.
* A null, NaN or infinite score is unknown. If the query's reranked row of the chunk still holds the score (not 0),
  that is taken; else the chunk counts as the middle of the list.
* A chunk that a kind of list lacks gets `absent` for it; kinds that a query lacks altogether do not count.
* Of several searches of one kind a chunk's best value counts.
* A list whose deviation is 0 falls back to the mean absolute deviation; if all scores are equal, all are middle.
* Medians are exact lower medians, whatever the length of a list.
* Ties go to the smaller chunk id. Rows without query or chunk id are ignored; an empty table gives an empty result.

Scale: every step is an aggregate with a partial step, keyed by list or by (query, chunk), so a query with a third of
all rows is spread over tasks; the joins bring per-list numbers to the rows of the list. Only the distinct scores
close to the median of a long list are put in order in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

KINDS = ("dense", "sparse", "rerank")
#: percentile_approx is exact for lists up to this length: at 10,000 steps its error is under half a rank.
SHORT = 5_000


def _known(score: Column) -> Column:
    x = score.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def list_entries(hits: DataFrame) -> DataFrame:
    """(query_id, search_no, kind, chunk_id, score): one row per chunk of a list, scores repaired where known."""
    hits = hits.where(F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull())
    kind = F.when(F.col("is_dense").isNull(), "rerank").when(F.col("is_dense"), "dense").otherwise("sparse")
    rows = hits.select("query_id", F.coalesce("search_no", F.lit(0)).alias("search_no"), kind.alias("kind"), "chunk_id", _known(F.col("score")).alias("own"), F.lit(None).cast("double").alias("kept"), F.lit(1).alias("listed"))
    had = F.explode(F.array(F.struct(F.lit("dense").alias("kind"), _known(F.col("dense")).alias("kept")), F.struct(F.lit("sparse").alias("kind"), _known(F.col("sparse")).alias("kept")))).alias("had")
    kept = hits.where(F.col("is_dense").isNull()).select("query_id", "chunk_id", had).where("had.kept <> 0")
    kept = kept.select("query_id", F.lit(0).alias("search_no"), "had.kind", "chunk_id", F.lit(None).cast("double").alias("own"), "had.kept", F.lit(0).alias("listed"))
    one = rows.unionByName(kept).groupBy("query_id", "search_no", "kind", "chunk_id").agg(F.max("own").alias("own"), F.max("kept").alias("kept"), F.max("listed").alias("listed"))
    return one.where("listed = 1").select("query_id", "search_no", "kind", "chunk_id", F.coalesce("own", "kept").alias("score"))


def lower_medians(rows: DataFrame, key: list[str], score: str, long: DataFrame | None, *more: Column) -> DataFrame:
    """(key, median, more): exact lower medians of score. long: (key, n) of the lists over SHORT, None if there are none.

    In a long list two estimated cuts part the scores in three; counting says which part holds the median, and the
    counts per distinct score of that part alone are added up. A bad estimate makes the part longer, not the median wrong.
    """
    got = rows.groupBy(*key).agg(F.percentile_approx(score, F.array(F.lit(0.49), F.lit(0.5), F.lit(0.51)), 10_000).alias("cuts"), *more)
    if long is None:
        return got.withColumn("median", F.col("cuts")[1]).drop("cuts")
    x = F.col(score)
    got = written(got, "cuts")
    cut = got.join(long, key).select(*key, "n", "cuts")
    parted = rows.where(x.isNotNull()).join(cut, key).select(*key, score, "n", F.when(x < F.col("cuts")[0], 0).when(x <= F.col("cuts")[2], 1).otherwise(2).alias("part"))
    counts = parted.groupBy(*key).agg(F.count_if(F.col("part") == 0).alias("low"), F.count_if(F.col("part") < 2).alias("mid"), F.first("n").alias("n"))
    at = F.floor((F.col("n") + 1) / 2)
    part = F.when(at <= F.col("low"), 0).when(at <= F.col("mid"), 1).otherwise(2)
    before = F.when(at <= F.col("low"), 0).when(at <= F.col("mid"), F.col("low")).otherwise(F.col("mid"))
    aim = counts.select(*key, part.alias("part"), (at - before).alias("at"))
    values = parted.join(aim, [*key, "part"]).groupBy(*key, score).agg(F.count(F.lit(1)).alias("c"), F.first("at").alias("at"))
    reached = values.withColumn("c", F.sum("c").over(Window.partitionBy(*key).orderBy(score))).where(F.col("c") >= F.col("at"))
    exact = reached.groupBy(*key).agg(F.min(score).alias("exact"))
    return got.join(exact, key, "left").withColumn("median", F.coalesce("exact", F.col("cuts")[1])).drop("cuts", "exact")


def squashed(entries: DataFrame) -> DataFrame:
    """Adds value in (0, 1): logistic of the robust z-score within the list; and w_<kind>: 1 if the query has the kind.

    Medians and deviations read keys and scores alone; chunk ids travel once, to meet the numbers of their list.
    """
    key = ["query_id", "search_no", "kind"]
    long = written(entries.groupBy(*key).agg(F.count("score").alias("n")).where(F.col("n") > SHORT), "long")
    long = None if long.isEmpty() else long
    middle = lower_medians(entries, key, "score", long).withColumnRenamed("median", "middle")
    off = entries.select(*key, "score").join(middle, key).withColumn("off", F.abs(F.col("score") - F.col("middle")))
    spread = lower_medians(off, key, "off", long, F.first("middle", ignorenulls=True).alias("middle"), F.avg("off").alias("mean_off")).withColumnRenamed("median", "mad")
    has = spread.groupBy("query_id").agg(*(F.max((F.col("kind") == k).cast("int")).alias(f"w_{k}") for k in KINDS))
    width = F.when(F.col("mad") > 0, F.col("mad") * 1.4826).when(F.col("mean_off") > 0, F.col("mean_off") * 1.2533)
    z = F.coalesce((F.col("score") - F.col("middle")) / width, F.lit(0.0))
    value = (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("value")
    numbers = spread.join(has, "query_id")
    return entries.join(numbers, key).select(*key, "chunk_id", "score", value, *(f"w_{k}" for k in KINDS))


def one_ranking(hits: DataFrame, weights: dict[str, float] | None = None, absent: float = 0.02) -> DataFrame:
    """(query_id, chunk_id, combined): the weighted geometric mean over the kinds that the query has."""
    weights = {k: 1.0 for k in KINDS} | (weights or {})
    values = squashed(written(list_entries(hits), "entries"))
    best = [F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in KINDS]
    joined = values.groupBy("query_id", "chunk_id").agg(*best, *(F.max(f"w_{k}").alias(f"w_{k}") for k in KINDS))
    weight = {k: F.col(f"w_{k}") * F.lit(weights[k]) for k in KINDS}
    total = sum(weight.values(), F.lit(0.0))
    logs = sum((weight[k] * F.log(F.coalesce(F.col(k), F.lit(absent))) for k in KINDS), F.lit(0.0))
    return joined.select("query_id", "chunk_id", F.exp(logs / total).alias("combined"))


def first_of_each(ranking: DataFrame) -> DataFrame:
    """(query_id, chunk_id): the best chunk of each query."""
    top = ranking.groupBy("query_id").agg(F.min(F.struct(F.round(-F.col("combined"), 9).alias("c"), "chunk_id")).alias("m"))
    return top.select("query_id", "m.chunk_id")
