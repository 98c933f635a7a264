import math

import pytest

from lodestore.operators import fusion, postings, rerank
from lodestore.operators.dense import search_dense
from lodestore.operators.expand import neighbours
from lodestore.schema import meta_value

CHUNK = "chunk_id string, doc_id string, idx int, content string, context string, meta map<string,struct<t:string,s:string,d:double,b:boolean>>, embedding array<float>"


def chunks(spark, rows):
    """rows: (id, content[, meta[, embedding]])"""
    out = []
    for r in rows:
        meta = {k: meta_value(v) for k, v in (r[2] if len(r) > 2 and r[2] else {}).items()}
        out.append((r[0], "d", 0, r[1], "", meta, r[3] if len(r) > 3 else None))
    return spark.createDataFrame(out, CHUNK)


def bm25(spark, rows, text, k=10, **how):
    df = chunks(spark, rows)
    stats = postings.corpus_stats(df).first()
    searches = spark.createDataFrame([("q", 0, text)], "query_id string, search_no int, text string")
    got = postings.search_sparse(searches, postings.build_postings(df), stats["n"], stats["avgdl"], k, chunks=df, **how)
    return [(r.chunk_id, r.sparse) for r in got.orderBy("rank").collect()]


def test_bm25_formula_in_one_block_or_many(spark):
    rows = [("a", "go go channel"), ("b", "go routine"), ("c", "cooking pasta"), ("d", "")]
    n, avgdl = 4, 7 / 4
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, dl, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    want = {"a": part(2, 3, 2) * 2 + part(1, 3, 1), "b": part(1, 2, 2) * 2}
    for block in (8_192, 1):
        got = dict(bm25(spark, rows, "Go go, channel", block=block, query_block=block))
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def test_bm25_rare_term_length_filter_and_edges(spark):
    assert bm25(spark, [("a", "x y"), ("b", "x y"), ("c", "x z")], "x z")[0][0] == "c"
    assert bm25(spark, [("long", "pump " + "word " * 30), ("short", "pump word")], "pump")[0][0] == "short"
    rows = [("a", "same text", {"access": "public"}), ("b", "same text", {"access": "private"})]
    public = bm25(spark, rows, "same", where={"access": "public"})
    assert [i for i, _ in public] == ["a"]
    assert public[0][1] == bm25(spark, rows, "same")[0][1]  # the filter does not change statistics
    assert bm25(spark, rows, "absent") == []
    assert bm25(spark, rows, "same", k=0) == []
    assert bm25(spark, [], "same") == []


def test_terms_matched(spark):
    df = postings.build_postings(chunks(spark, [("a", "raft leader")]))
    s = spark.createDataFrame([("two", 0, "leader raft x"), ("dup", 0, "raft raft"), ("no", 0, "zzz")], "query_id string, search_no int, text string")
    assert {r.query_id: r.matched for r in postings.terms_matched(s, df).collect()} == {"two": 2, "dup": 1, "no": 0}


def test_postings_change_with_their_chunks_only(spark):
    old = postings.build_postings(chunks(spark, [("a", "x y"), ("b", "y z")]))
    new = postings.replace_postings(old, chunks(spark, [("b", "w w")]))
    assert sorted((r.term, r.chunk_id, r.tf, r.dl) for r in new.collect()) == [("w", "b", 2, 2), ("x", "a", 1, 2), ("y", "a", 1, 2)]


def dense(spark, rows, vector, k=10, **how):
    df = chunks(spark, [(i, "", m, v) for i, m, v in rows])
    q = spark.createDataFrame([("q", 0, vector)], "query_id string, search_no int, vector array<float>")
    return [(r.chunk_id, round(r.dense, 6)) for r in search_dense(q, df, k, **how).orderBy("rank").collect()]


def test_dense(spark):
    rows = [("a", {"p": 1}, [1.0, 0.0, 0.0]), ("b", {"p": 2}, [0.8, 0.6, 0.0]), ("c", {"p": 1}, [0.0, 0.0, 1.0])]
    assert dense(spark, rows, [1.0, 0.0, 0.0], k=2) == [("a", 1.0), ("b", 0.8)]
    assert dense(spark, rows, [1.0, 0.0, 0.0], where={"p": 2}) == [("b", 0.8)]
    assert dense(spark, rows, [1.0, 0.0, 0.0], floor=0.9) == [("a", 1.0)]
    assert dense(spark, rows, [1.0, 0.0, 0.0], block=1) == dense(spark, rows, [1.0, 0.0, 0.0])
    assert dense(spark, [], [1.0]) == []
    bad = [*rows, ("bad", {"p": 3}, [1.0])]
    with pytest.raises(Exception, match="another dimension"):
        dense(spark, bad, [1.0, 0.0, 0.0])
    assert dense(spark, bad, [1.0, 0.0, 0.0], where={"p": 2}) == [("b", 0.8)]  # what the filter excludes cannot fail it


HIT = "query_id string, search_no int, is_dense boolean, is_rewrite boolean, rank int, chunk_id string, dense double, sparse double, score double"


def lists(spark, *rows):
    out = []
    for no, is_dense, items in rows:
        out += [("q", no, is_dense, no > 0, i + 1, c, s if is_dense else 0.0, 0.0 if is_dense else s, s) for i, (c, s) in enumerate(items)]
    return spark.createDataFrame(out, HIT)


def order(df):
    return [r.chunk_id for r in df.orderBy("rank").collect()]


def test_rrf(spark):
    hits = lists(spark, (0, True, [("only", 0.9), ("both", 0.4)]), (0, False, [("both", 3.1), ("other", 2.0)]))
    got = {r.chunk_id: r for r in fusion.rrf(60)(hits, 10).collect()}
    assert math.isclose(got["both"].score, 1 / 62 + 1 / 61)
    assert (got["both"].dense, got["both"].sparse) == (0.4, 3.1)
    assert order(fusion.rrf(0)(hits, 10)) == ["both", "only", "other"]


def test_rrf_keeps_negative_scores_and_weighs_rewrites(spark):
    many = lists(spark, (0, True, [("a", -0.2), ("b", -0.3)]), (1, True, [("b", 0.4)]), (2, False, [("b", 3.1)]))
    got = {r.chunk_id: r for r in fusion.rrf(60)(many, 10).collect()}
    assert (got["a"].dense, got["b"].dense, got["b"].sparse) == (-0.2, 0.4, 3.1)
    two_three = lists(spark, (0, True, [("q", 0.9)]), (0, False, [("q", 9.0)]), (1, True, [("r", 0.9)]), (2, True, [("r", 0.9)]), (3, True, [("r", 0.9)]))
    assert order(fusion.rrf(60, 0)(two_three, 2))[0] == "r"
    assert order(fusion.rrf(60, 0.5)(two_three, 2))[0] == "q"


def test_convex(spark):
    hits = lists(spark, (0, True, [("a", 1.0), ("b", 0.0)]), (0, False, [("b", 10.0), ("c", 0.0)]))
    assert order(fusion.convex(0.6)(hits, 10)) == ["b", "a", "c"]
    spike = lists(spark, (0, True, [("c", 0.2), ("d", 0.1)]), (0, False, [("c", 0.3), ("spike", 25.0)]))
    assert order(fusion.convex(0.3)(spike, 1)) == ["spike"]
    assert order(fusion.rrf(60)(spike, 1)) == ["c"]
    assert fusion.convex_pair(hits, 5, 1.5).count() == 0
    assert fusion.convex_pair(hits, 0, 0.5).count() == 0


def test_a_single_list_is_kept(spark):
    hits = lists(spark, (0, False, [("a", 7.0), ("b", 3.0), ("c", 1.0)]))
    assert [(r.chunk_id, r.score) for r in fusion.fuse_or_keep(hits, fusion.rrf(60), 2).orderBy("rank").collect()] == [("a", 7.0), ("b", 3.0)]


CAND = "query_id string, rank int, chunk_id string, score double, vector array<float>, embedding array<float>"


def test_mmr(spark):
    rows = [("q", 1, "a", 0.9, [1.0, 0.0], [1.0, 0.0]), ("q", 2, "copy", 0.9, [1.0, 0.0], [1.0, 0.0]), ("q", 3, "other", 0.1, [1.0, 0.0], [0.6, 0.8])]
    df = spark.createDataFrame(rows, CAND)
    assert order(rerank.mmr(df, 2, 0.3)) == ["a", "other"]
    assert order(rerank.mmr(df, 3, 1.0)) == ["a", "copy", "other"]
    with pytest.raises(ValueError, match="lambda"):
        rerank.mmr(df, 2, 1.5)
    plain = spark.createDataFrame([("q", 1, "x", 0.1, None, None), ("q", 2, "y", 0.9, None, None)], CAND)
    assert order(rerank.mmr(plain, 2)) == ["y", "x"]


def test_overlap_and_cross_encoder(spark):
    df = spark.createDataFrame([("q", 1, "a", "pump valve", "the valve"), ("q", 2, "b", "pump valve", "the pump and the valve"), ("q", 3, "c", "pump valve", "none")], "query_id string, rank int, chunk_id string, question string, content string")
    assert order(rerank.overlap(df, 2)) == ["b", "a"]

    class Length:
        def score(self, question, passages):
            return [float(len(p)) for p in passages]

    class Short:
        def score(self, question, passages):
            return [1.0]

    assert order(rerank.cross_encode(df, Length(), 2)) == ["b", "a"]
    with pytest.raises(Exception, match="number of results"):
        rerank.cross_encode(df, Short(), 2).collect()


def test_neighbours(spark):
    held = spark.createDataFrame([(f"c{i}", "d", i, f"c{i}") for i in range(6)], "chunk_id string, doc_id string, idx int, content string")
    hit = lambda rank, i, doc="d": ("q", rank, f"c{i}", doc, i, 1.0, f"c{i}")
    schema = "query_id string, rank int, chunk_id string, doc_id string, idx int, score double, content string"
    hits = spark.createDataFrame([hit(1, 1), hit(2, 2), hit(3, 5)], schema)
    got = [(r.chunk_id, r.content) for r in neighbours(hits, held, 1).orderBy("rank").collect()]
    assert got == [("c1", "c0\nc1\nc2"), ("c5", "c4\nc5")]
    assert neighbours(hits, held, 0).count() == 3
    loose = spark.createDataFrame([("q", 1, "n", None, 0, 1.0, "own")], schema)
    assert [r.content for r in neighbours(loose, held, 1).collect()] == ["own"]


def test_dense_within_a_label(spark):
    columns = "chunk_id string, label int, embedding array<float>"
    held = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 2, [1.0, 0.0]), ("c", 1, [0.6, 0.8]), ("d", None, [1.0, 0.0]), ("e", 1, [0.0, 1.0])], columns)
    asked = spark.createDataFrame([("p", 0, [1.0, 0.0], 1), ("q", 0, [1.0, 0.0], None), ("r", 0, [1.0, 0.0], 3)], "query_id string, search_no int, vector array<float>, label int")
    for block in (20_000, 1):
        got = search_dense(asked, held, 2, within="label", block=block, query_block=block).orderBy("rank").collect()
        assert [(r.query_id, r.chunk_id, round(r.dense, 6), r["rank"]) for r in got] == [("p", "a", 1.0, 1), ("p", "c", 0.6, 2)]
