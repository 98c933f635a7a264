"""Continuous ingest with Structured Streaming: new files or chunk rows into the versioned tables.

Each micro-batch is an upsert by chunk id, so a batch that runs twice changes nothing: with the stream's checkpoint
this gives every row exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import Store, latest


def file_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """files(path, modificationTime, length, content) as they arrive."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)


def chunk_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def into_store(stream: DataFrame, store: Store, checkpoint: str, to_chunks: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Upserts the stream's rows; `once` takes what there is and stops."""

    def write(batch: DataFrame, number: int) -> None:
        rows = to_chunks(batch) if to_chunks else batch
        if not rows.isEmpty():
            store.upsert(latest(rows) if "ingested_at" in rows.columns else rows.dropDuplicates(["chunk_id"]))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals(stream: DataFrame, at: str = "ingested_at", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Chunks and bytes per source and time window; rows later than the watermark are left out of closed windows."""
    source = F.element_at("meta", "source")["s"]
    return stream.withWatermark(at, late).groupBy(F.window(at, width), source.alias("source")).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("content")).alias("bytes"))
