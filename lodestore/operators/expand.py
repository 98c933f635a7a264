"""Widening hits to the chunks around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(hits: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """hits(query_id, rank, chunk_id, doc_id, idx, content, …) with content joined over idx-n..idx+n, and who is covered.

    Equality on the document and a range on the index; each hit asks for 2n+1 keys, so the join stays an equi-join on
    (document, index) and a document that many hits fall into is spread by index.
    """
    wanted = hits.where(F.col("doc_id").isNotNull() & (F.col("doc_id") != "")).select("query_id", "rank", "chunk_id", "doc_id", F.explode(F.sequence(F.greatest(F.col("idx") - n, F.lit(0)), F.col("idx") + n)).alias("at"))
    around = chunks.select("doc_id", F.col("idx").alias("at"), F.col("chunk_id").alias("near"), F.col("content").alias("text"))
    got = wanted.join(around, ["doc_id", "at"])
    parts = got.groupBy("query_id", "rank", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("at", "near", "text"))).alias("parts"))
    return hits.join(parts, ["query_id", "rank", "chunk_id"], "left")


def neighbours(hits: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Expanded hits in rank order; a hit that a kept higher hit covers already is dropped. n <= 0 changes nothing.

    The decision is an ordered fold over a query's few hits: the state holds the ids covered so far.
    """
    if n <= 0:
        return hits
    wide = windows(hits, chunks, n)
    own = F.transform("parts", lambda p: F.when(p["near"] == F.col("chunk_id"), F.col("content")).otherwise(p["text"]))
    joined = F.coalesce(F.array_join(own, "\n"), F.col("content"))
    covers = F.coalesce(F.transform("parts", lambda p: p["near"]), F.array())
    one = F.struct("rank", "chunk_id", "doc_id", "idx", "score", joined.alias("content"), F.array_union(covers, F.array("chunk_id")).alias("covers"))
    listed = wide.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("hits"))
    kind = listed.schema["hits"].dataType.simpleString()
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(kind).alias("kept"))

    def step(acc, h):
        taken = F.array_contains(acc["seen"], h["chunk_id"])
        return F.struct(F.when(taken, acc["seen"]).otherwise(F.array_union(acc["seen"], h["covers"])).alias("seen"), F.when(taken, acc["kept"]).otherwise(F.array_append(acc["kept"], h)).alias("kept"))

    kept = listed.select("query_id", F.aggregate("hits", start, step, lambda acc: acc["kept"]).alias("kept"))
    return kept.select("query_id", F.posexplode("kept").alias("p", "h")).select("query_id", (F.col("p") + 1).alias("rank"), "h.chunk_id", "h.doc_id", "h.idx", "h.score", "h.content")


def section(hits: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """The whole section of a hit: neighbours with a wide window."""
    return neighbours(hits, chunks, most)
