"""Versioned Parquet tables of chunks and postings: writing a segment and publishing it are two steps.

A write goes into a new directory; a numbered manifest that names it comes last. A failed or repeated write leaves the
published version as it was, so nothing ever has to be rolled back, and readers see one version throughout.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict, EmptySource
from ..operators.postings import build_postings


def latest(rows: DataFrame, key: str = "chunk_id", at: str = "ingested_at") -> DataFrame:
    """One row per key: the newest; on a tie the one with the greatest hash, on every run the same. Null keys are left out.

    An aggregate with a partial step rather than a window: rows repeated within a task never travel.
    """
    plain = [f.name for f in rows.schema if f.dataType.typeName() != "map"]
    order = F.struct(F.coalesce(F.col(at), F.timestamp_seconds(F.lit(0)).cast(rows.schema[at].dataType)), F.xxhash64(*plain))
    best = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r"))
    return best.select("r.*")


def one_per_key(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row per key: the newest where rows say when they came, else the one with the greatest hash. Null and empty keys are left out."""
    if "ingested_at" in rows.columns:
        return latest(rows, key)
    plain = [f.name for f in rows.schema if f.dataType.typeName() != "map"]
    best = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.xxhash64(*plain)).alias("r"))
    return best.select("r.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """old with the rows of new in place of those of the same key; rows without a key are skipped."""
    new = one_per_key(new, key)
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new, allowMissingColumns=True)


def delete(rows: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """rows without ids; unknown ids do not matter."""
    return rows.join(ids.select(key).distinct(), key, "left_anti").select(rows.columns)


def get_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of ids(pos, chunk_id), in their order; unknown ids are skipped."""
    return ids.join(chunks, "chunk_id").orderBy("pos")


def source_of(meta) -> F.Column:
    return F.element_at(meta, "source")["s"]


def delete_source(chunks: DataFrame, source: str, keep: DataFrame | None = None) -> DataFrame:
    """chunks without those of the source, but for the ids in keep."""
    if not source:
        raise EmptySource()
    same = F.coalesce(source_of(F.col("meta")) == source, F.lit(False))
    rest = chunks.where(~same)
    if keep is None:
        return rest
    return rest.unionByName(chunks.where(same).join(keep.select("chunk_id").distinct(), "chunk_id", "left_semi").select(chunks.columns))


def replace_source(chunks: DataFrame, source: str, new: DataFrame) -> DataFrame:
    """An upsert of new, and without what else the source had: one rewrite."""
    return upsert(delete_source(chunks, source, new), new)


class Store:
    """Chunks and postings under one folder: segments s-*/chunks, s-*/postings, s-*/gone, and numbered manifests.

    A write adds one segment: its rows, their postings, and the ids whose rows in earlier segments no longer count. So
    ingest costs what the batch costs, whatever the store holds, and postings of other chunks stay as they are. A manifest
    names the segments of a version; it appears under its number by one rename that fails if the number is taken, so a
    reader sees a whole version always, a crash leaves the last one, and of two writers one fails with Conflict. Above
    `most` segments they are merged into one. The last `keep` versions stay readable; segments that none of them names are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int = 16, keep: int = 3):
        self.spark, self.folder, self.most, self.keep = spark, folder.rstrip("/"), most, max(1, keep)
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # ---- manifests ------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        at = self._path("versions")
        if not self._fs().exists(at):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs().listStatus(at) if f.getPath().getName().isdigit())

    def _segments(self, number: int) -> list[str]:
        stream = self._fs().open(self._path(f"versions/{number:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["segments"]
        finally:
            stream.close()

    def version(self) -> int | None:
        numbers = self._numbers()
        return numbers[-1] if numbers else None

    def segments(self) -> list[str]:
        number = self.version()
        return self._segments(number) if number is not None else []

    def _publish(self, base: int | None, segments: list[str]) -> int:
        number = (base or 0) + 1
        draft = self._path(f"versions/.draft-{uuid.uuid4().hex}")
        stream = self._fs().create(draft, True)
        try:
            stream.write(bytearray(json.dumps({"segments": segments}).encode()))
        finally:
            stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        how = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, self._path(f"versions/{number:012d}"), how)
        except Exception as error:
            self._fs().delete(draft, False)
            raise Conflict(f"version {number} of {self.folder} exists: another writer was faster") from error
        self._clean()
        return number

    def _clean(self) -> None:
        """Removes manifests before the last `keep`, and the segments that only they name."""
        numbers = self._numbers()
        old, kept = numbers[: -self.keep], numbers[-self.keep :]
        used = {s for n in kept for s in self._segments(n)}
        for n in old:
            for s in self._segments(n):
                if s not in used:
                    self._fs().delete(self._path(s), True)
            self._fs().delete(self._path(f"versions/{n:012d}"), False)

    # ---- reading --------------------------------------------------------------------------------------------------

    def _live(self, kind: str, segments: list[str]) -> DataFrame:
        """The rows of all segments that no later one has replaced or deleted."""
        read = lambda s, k: self.spark.read.parquet(f"{self.folder}/{s}/{k}")
        if len(segments) == 1:
            return read(segments[0], kind)
        rows = [read(s, kind).withColumn("_at", F.lit(i)) for i, s in enumerate(segments)]
        gone = [read(s, "gone").withColumn("_gone", F.lit(i)) for i, s in enumerate(segments) if i]
        union = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        last = union(gone).groupBy("chunk_id").agg(F.max("_gone").alias("_gone"))
        return union(rows).join(last, "chunk_id", "left").where(F.col("_gone").isNull() | (F.col("_gone") <= F.col("_at"))).select(rows[0].drop("_at").columns)

    def chunks(self) -> DataFrame | None:
        segments = self.segments()
        return self._live("chunks", segments) if segments else None

    def postings(self) -> DataFrame | None:
        segments = self.segments()
        return self._live("postings", segments) if segments else None

    # ---- writing --------------------------------------------------------------------------------------------------

    def _segment(self, chunks: DataFrame, gone: DataFrame | None, postings: DataFrame | None = None) -> str:
        s = f"s-{uuid.uuid4().hex}"
        chunks.write.parquet(f"{self.folder}/{s}/chunks")
        held = self.spark.read.parquet(f"{self.folder}/{s}/chunks")
        (build_postings(held) if postings is None else postings).select("term", "chunk_id", "tf", "dl").write.parquet(f"{self.folder}/{s}/postings")
        own = held.select("chunk_id")
        (own if gone is None else own.union(gone.select("chunk_id")).distinct()).write.parquet(f"{self.folder}/{s}/gone")
        return s

    def _add(self, chunks: DataFrame, gone: DataFrame | None) -> int:
        base = self.version()
        segments = self._segments(base) if base is not None else []
        fresh = self._segment(chunks, gone)
        segments = [*segments, fresh]
        if len(segments) > self.most:
            segments = [self._segment(self._live("chunks", segments), None, self._live("postings", segments))]
            self._fs().delete(self._path(fresh), True)
        return self._publish(base, segments)

    def compact(self) -> int | None:
        """All segments merged into one."""
        base, segments = self.version(), self.segments()
        if len(segments) < 2:
            return base
        return self._publish(base, [self._segment(self._live("chunks", segments), None, self._live("postings", segments))])

    def publish(self, chunks: DataFrame, postings: DataFrame | None = None) -> int:
        """A version that holds these chunks alone, one row per id."""
        base = self.version()
        return self._publish(base, [self._segment(one_per_key(chunks), None, postings)])

    def upsert(self, new: DataFrame) -> int:
        """Only the postings of new chunks are built; a chunk that comes twice in one batch counts once."""
        return self._add(one_per_key(new), None)

    def replace_source(self, source: str, new: DataFrame) -> int:
        """What the source had and new has not goes; the postings of all other chunks stay."""
        if not source:
            raise EmptySource()
        old = self.chunks()
        return self._add(one_per_key(new), None if old is None else self._of_source(old, source))

    @staticmethod
    def _of_source(chunks: DataFrame, source: str) -> DataFrame:
        return chunks.where(F.coalesce(source_of(F.col("meta")) == source, F.lit(False))).select("chunk_id")

    def delete_source(self, source: str, keep: DataFrame | None = None) -> int | None:
        if not source:
            raise EmptySource()
        old = self.chunks()
        if old is None:
            return None
        gone = self._of_source(old, source)
        if keep is not None:
            gone = gone.join(keep.select("chunk_id").distinct(), "chunk_id", "left_anti")
        return self._add(old.limit(0), gone)

    def delete(self, ids: DataFrame) -> int | None:
        old = self.chunks()
        if old is None:
            return None
        return self._add(old.limit(0), ids.where(F.col("chunk_id").isNotNull()))

    def save(self, folder: str) -> None:
        """A snapshot: the chunks alone; loading builds the postings again."""
        chunks = self.chunks()
        if chunks is not None:
            chunks.write.mode("overwrite").parquet(folder)

    def load(self, folder: str) -> int | None:
        """Publishes a snapshot; a folder that does not exist is no error and changes nothing."""
        path = self._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(self._conf).exists(path):
            return None
        return self.publish(self.spark.read.parquet(folder))
