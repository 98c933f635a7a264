import math

import pytest

from lodestore.llm.ranking import first_of_each, list_entries, one_ranking, squashed

SCHEMA = "query_id string, search_no int, is_dense boolean, rank int, chunk_id string, dense double, sparse double, score double, value string, kind string"


def hits(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def lists(dense, sparse, rerank=None, q="q"):
    out = [(q, 0, True, i + 1, c, s, 0.0, s) for i, (c, s) in enumerate(dense)] + [(q, 0, False, i + 1, c, 0.0, s, s) for i, (c, s) in enumerate(sparse)]
    return out + [(q, 0, None, i + 1, c, 0.0, 0.0, s) for i, (c, s) in enumerate(rerank or [])]


def first(spark, rows):
    return {r.query_id: r.chunk_id for r in first_of_each(one_ranking(hits(spark, rows))).collect()}


def test_a_wide_range_does_not_win(spark):
    dense = [("both", 0.8), ("x", 0.5), ("y", 0.4), ("z", 0.3), ("spike", 0.2)]
    sparse = [("spike", 900.0), ("both", 9.0), ("u", 4.0), ("v", 3.0), ("w", 2.0)]
    assert first(spark, lists(dense, sparse)) == {"q": "both"}
    scaled = [(c, s * 1e6 + 5) for c, s in sparse]
    assert first(spark, lists(dense, scaled)) == {"q": "both"}


def test_reranked_list_counts_like_the_others(spark):
    dense = [("a", 0.9), ("b", 0.8), ("c", 0.1), ("d", 0.05)]
    sparse = [("a", 9.0), ("b", 8.5), ("c", 1.0), ("d", 0.5)]
    assert first(spark, lists(dense, sparse)) == {"q": "a"}
    assert first(spark, lists(dense, sparse, [("b", 3.0), ("c", -4.0), ("d", -5.0), ("a", -9.0)])) == {"q": "b"}


def test_unknown_scores_are_repaired(spark):
    rows = [("q", 0, True, 1, "a", None, 0.0, None), ("q", 0, True, 2, "b", 0.5, 0.0, 0.5), ("q", 0, True, None, "c", 0.1, 0.0, float("nan")), ("q", 0, None, 1, "a", 0.9, 0.0, 1.0)]
    got = {(r.kind, r.chunk_id): r.score for r in list_entries(hits(spark, rows)).collect()}
    assert got == {("dense", "a"): 0.9, ("dense", "b"): 0.5, ("dense", "c"): None, ("rerank", "a"): 1.0}
    values = {(r.kind, r.chunk_id): r.value for r in squashed(list_entries(hits(spark, rows))).collect()}
    assert values["dense", "c"] == 0.5


def test_repeats_ties_nulls_and_empty(spark):
    rows = lists([("b", 0.5), ("a", 0.5)], [("b", 1.0), ("a", 1.0)])
    assert first(spark, rows + rows) == {"q": "a"}
    assert first(spark, [(None, 0, True, 1, "a", 1.0, 0.0, 1.0), ("q", 0, True, 1, None, 1.0, 0.0, 1.0)]) == {}
    assert first(spark, []) == {}
    assert first(spark, [("q", None, True, 1, "a", None, None, None)]) == {"q": "a"}


def test_weights(spark):
    rows = lists([("a", 0.9), ("b", 0.2), ("c", 0.1)], [("b", 9.0), ("c", 2.0), ("a", 1.0)])
    top = lambda w: first_of_each(one_ranking(hits(spark, rows), w)).first().chunk_id
    assert top({"dense": 5.0}) == "a"
    assert top({"sparse": 5.0}) == "b"


@pytest.mark.parametrize("ties", [1, 1_000])
def test_medians_of_a_long_list_are_exact(spark, ties):
    n = 200_001
    score = f"floor(pmod(xxhash64(id), 1000000007) / {ties}) * 1e-3"
    rows = spark.range(n).selectExpr("'q' AS query_id", "0 AS search_no", "'dense' AS kind", "cast(id AS string) AS chunk_id", f"cast({score} AS double) AS score")
    short = spark.createDataFrame([("q", 0, "sparse", str(i), float(i)) for i in range(5)] + [("q", 0, "sparse", "5", None)], rows.schema)
    got = squashed(rows.unionByName(short)).toPandas()
    of = got[got["kind"] == "dense"]
    middle = sorted(of["score"])[n // 2]
    mad = sorted((of["score"] - middle).abs())[n // 2]
    assert len(of) == n
    for r in of.head(50).itertuples():
        assert math.isclose(r.value, 1 / (1 + math.exp((middle - r.score) / (mad * 1.4826))), rel_tol=1e-12)
    assert sorted(got[got["kind"] == "sparse"]["value"])[2:4] == [0.5, 0.5]
