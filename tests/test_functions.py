import math
import uuid

import pytest
from pyspark.sql import functions as F

from lodestore.functions import filters, identity, scores, vectors
from lodestore.functions import text as tx
from lodestore.operators.embedding import HashEmbedder
from lodestore.schema import META, meta_value


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [("Hello, World-Wide 42!", ["hello", "world", "wide", "42"]), ("", []), ("--", []), ("Ünïcode ΑΒΓ", ["ünïcode", "αβγ"])])
def test_tokens(spark, text, want):
    assert one(spark, text, "string", tx.tokens) == want


@pytest.mark.parametrize(("text", "want"), [("  A \n\tb  ", "a b"), (" X ", "x"), ("", "")])
def test_normalise(spark, text, want):
    assert one(spark, text, "string", tx.normalise) == want


@pytest.mark.parametrize(("text", "size", "want"), [("äöü", 3, "ä"), ("äöü", 4, "äö"), ("abc", 10, "abc"), ("日本", 5, "日"), ("😀x", 3, ""), ("", 3, "")])
def test_truncate_bytes(spark, text, size, want):
    assert one(spark, text, "string", lambda c: tx.truncate_bytes(c, size)) == want


@pytest.mark.parametrize(("text", "want"), [("", 0), ("ab", 1), ("abcdefgh", 2), ("ää", 1)])
def test_token_estimate(spark, text, want):
    assert one(spark, text, "string", tx.token_estimate) == want


def test_uuid5(spark):
    got = spark.createDataFrame([("a.md", "täxt")], "s string, c string").select(identity.document_id(F.col("s"), F.col("c")), identity.chunk_id(F.col("s"), F.lit(3)), identity.section_id(F.col("s"), F.lit("A > B"), F.col("c")), identity.section_id(F.col("s"), F.lit(""), F.col("c"))).first()
    u = lambda name: str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert list(got) == [u("a.md\0täxt"), u("a.md#3"), u("a.md\0A > B\0täxt"), u("a.md\0täxt")]


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-2.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert math.isclose(df.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0], want, abs_tol=1e-12)


def test_cosine_of_unlike_length_fails(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="another dimension"):
        df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()


def test_hash_embedding_equals_the_embedder(spark):
    texts = ["the pump and the valve", "", "Größe 42 pump"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(vectors.hash_embedding(tx.tokens(F.col("t")))).collect()]
    for a, b in zip(got, HashEmbedder().embed(texts)):
        assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(a, b))


ROWS = [
    ("en5", {"lang": "en", "n": 5, "ok": True}), ("en5f", {"lang": "en", "n": 5.0}), ("de", {"lang": "de", "n": "5"}), ("none", {}), ("null", None), ("b", {"ok": False}),
]


@pytest.mark.parametrize(
    ("where", "want"),
    [
        (None, {"en5", "en5f", "de", "none", "null", "b"}),
        ({}, {"en5", "en5f", "de", "none", "null", "b"}),
        ({"lang": "en"}, {"en5", "en5f"}),
        ({"n": 5}, {"en5"}),
        ({"n": 5.0}, {"en5f"}),
        ({"n": [5, "5"]}, {"en5", "de"}),
        ({"lang": {"$ne": "en"}}, {"de"}),
        ({"lang": {"$in": ["de", "fr"]}}, {"de"}),
        ({"lang": {"$in": "de"}}, set()),
        ({"lang": {"$nin": ["de"]}}, {"en5", "en5f"}),
        ({"lang": {"$nin": "de"}}, {"en5", "en5f", "de"}),
        ({"n": {"$gt": 4}}, {"en5", "en5f"}),
        ({"n": {"$gte": 5, "$lt": 6}}, {"en5", "en5f"}),
        ({"n": {"$lte": 4}}, set()),
        ({"n": {"$gt": "4"}}, set()),
        ({"lang": "en", "n": {"$lte": 5}, "ok": True}, {"en5"}),
        ({"lang": {"$odd": "en"}}, {"en5", "en5f"}),
        ({"missing": {"$ne": 1}}, set()),
        ({"ok": False}, {"b"}),
    ],
)
def test_filters(spark, where, want):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("meta", META)])
    df = spark.createDataFrame([(i, None if m is None else {k: meta_value(v) for k, v in m.items()}) for i, m in ROWS], schema)
    assert {r.id for r in df.where(filters.compile_filter(where, F.col("meta"))).collect()} == want


def test_filter_translation():
    assert filters.to_chroma(None) is None
    assert filters.to_chroma({"a": 1}) == {"a": {"$eq": 1}}
    assert filters.to_chroma({"a": [1, 2], "b": {"$gt": 3}}) == {"$and": [{"a": {"$in": [1, 2]}}, {"b": {"$gt": 3}}]}
    assert filters.to_qdrant({"a": 1, "b": {"$ne": 2}, "c": {"$gte": 1, "$lt": 5}, "d": [1], "e": {"$nin": [3]}}) == {
        "must": [{"key": "metadata.a", "match": {"value": 1}}, {"key": "metadata.c", "range": {"gte": 1, "lt": 5}}, {"key": "metadata.d", "match": {"any": [1]}}],
        "must_not": [{"key": "metadata.b", "match": {"value": 2}}, {"key": "metadata.e", "match": {"any": [3]}}],
    }
    assert filters.to_qdrant({"a": {"$odd": 1}}) is None


def test_top_k_against_full_sort(spark):
    import random

    rng = random.Random(1)
    rows = [("q", f"c{i:04d}", float(rng.randint(0, 50))) for i in range(1000)] + [("q", "nan", float("nan"))]
    got = scores.top_k(spark.createDataFrame(rows, "query_id string, chunk_id string, score double"), ["query_id"], 20).orderBy("rank").collect()
    want = sorted((r for r in rows if r[1] != "nan"), key=lambda r: (-r[2], r[1]))[:20]
    assert [(r.chunk_id, r.rank) for r in got] == [(w[1], i + 1) for i, w in enumerate(want)]
    assert scores.top_k(spark.createDataFrame(rows, "query_id string, chunk_id string, score double"), ["query_id"], 0).count() == 0


def test_min_max_and_sigmoid(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 7.0)], "q string, score double")
    assert sorted((r.q, r.score) for r in scores.min_max(df, ["q"]).collect()) == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 1.0)]
    assert one(spark, 0.0, "double", scores.sigmoid) == 0.5
    assert math.isclose(one(spark, 2.0, "double", lambda c: scores.sigmoid(c, 2.0)), 1 / (1 + math.exp(-1)))
    assert math.isclose(one(spark, 2.0, "double", lambda c: scores.sigmoid(c, -1.0)), 1 / (1 + math.exp(-2)))
