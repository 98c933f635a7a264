"""The shared folder of a cluster, and tables written to it to cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, else the context's own, else, on one machine, a temporary one.

    Executors elsewhere would not see a folder of the driver's machine: without a setting that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestore-"))
    return context.getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


_made: dict[str, SparkSession] = {}


def release() -> None:
    """Removes all tables written so far; to be called when nothing that reads them is still to run."""
    while _made:
        _remove(*reversed(_made.popitem()))


atexit.register(release)


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed by release() or when the driver ends."""
    path = f"{shared_folder(spark)}/lodestore/{tag}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder as Parquet and read back.

    Cuts the lineage at a place that survives the loss of an executor, and unlike checkpoint() lets later reads
    prune columns and push filters.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
