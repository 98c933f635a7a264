import datetime as dt

from pyspark.sql import functions as F

from lodestore.operators.chunking import character_chunks
from lodestore.sources.readers import read_files, with_meta
from lodestore.sources.tables import Store
from lodestore.streaming.ingest import arrivals, chunk_stream, file_stream, into_store

META = "map<string,struct<t:string,s:string,d:double,b:boolean>>"


def test_rows_stream_into_the_store_once(spark, tmp_path):
    schema = f"chunk_id string, doc_id string, idx int, content string, context string, embedding array<float>, meta {META}, ingested_at timestamp"
    row = lambda i, text, day: (i, "d", 0, text, "", None, None, dt.datetime(2025, 1, day))
    spark.createDataFrame([row("a", "old", 1), row("a", "new", 2), row("b", "x", 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    stream = lambda: chunk_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    into_store(stream(), store, str(tmp_path / "cp")).awaitTermination()
    assert {r.chunk_id: r.content for r in store.chunks().collect()} == {"a": "new", "b": "x"}
    first = store.version()
    into_store(stream(), store, str(tmp_path / "cp")).awaitTermination()
    assert store.version() == first  # nothing new, nothing written
    spark.createDataFrame([row("b", "y", 3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    into_store(stream(), store, str(tmp_path / "cp")).awaitTermination()
    assert {r.chunk_id: r.content for r in store.chunks().collect()} == {"a": "new", "b": "y"}


def test_files_stream_through_the_readers(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.md").write_text("# H\nbody text")
    (folder / "b.txt").write_text("plain")
    store = Store(spark, str(tmp_path / "store"))

    def to_chunks(files):
        docs = with_meta(read_files(files)).withColumn("doc_id", F.xxhash64("source", "seq").cast("string"))
        return character_chunks(docs, 100).withColumn("context", F.lit("")).withColumn("embedding", F.lit(None).cast("array<float>")).select("chunk_id", "doc_id", "idx", "content", "context", "embedding", "meta")

    into_store(file_stream(spark, str(folder)), store, str(tmp_path / "cp"), to_chunks).awaitTermination()
    assert sorted(r.content for r in store.chunks().collect()) == ["body text", "plain"]


def test_windowed_arrivals(spark, tmp_path):
    schema = f"content string, meta {META}, ingested_at timestamp"
    rows = [("abc", {"source": ("str", "s", None, None)}, dt.datetime(2025, 1, 1, h)) for h in (1, 1, 5)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = arrivals(stream).writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted((r.chunks, r.bytes) for r in spark.table("arrived").collect()) == [(1, 3), (2, 6)]
