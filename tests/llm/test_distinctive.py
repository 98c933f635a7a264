import math

from lodestore.llm.distinctive import most_distinctive, term_scores

POST = "term string, chunk_id string, tf int, dl int, source string"


def brute(rows, live, c=1.0):
    got = {}
    for term, cid, tf, dl, *_ in rows:
        if term is None or cid not in live:
            continue
        old = got.get((cid, term), (None, None))
        tfs = [x for x in (old[0], tf) if x is not None]
        dls = [x for x in (old[1], dl) if x is not None]
        got[cid, term] = (max(tfs) if tfs else None, max(dls) if dls else None)
    got = {k: (tf or 1, dl) for k, (tf, dl) in got.items()}
    avg = sum(tf for tf, _ in got.values()) / len(live)
    out = {}
    for (cid, term), (tf, dl) in got.items():
        total = sum(t for (c2, t2), (t, _) in got.items() if t2 == term)
        df = sum(1 for (c2, t2) in got if t2 == term)
        tfn = tf * math.log2(1 + c * avg / (dl if dl and dl > 0 else avg))
        lam = total / len(live)
        out[cid, term] = (tf, df, (math.log2(1 + lam) + tfn * math.log2((1 + lam) / lam)) / (tfn + 1))
    return out


ROWS = [
    ("a", "c1", 3, 5, "s"), ("b", "c1", 2, 5, None), ("a", "c2", 1, 2, "s"), ("b", "c2", None, 2, "s"), ("z", "c2", 1, 2, "s"),
    ("a", "c1", 3, 5, "s"), ("a", "c1", 1, 5, "s"), ("b", "gone", 9, 9, "s"), (None, "c1", 1, 5, "s"), ("q", "c3", 4, None, "s"), ("q", "c2", 1, 0, "s"),
]


def test_against_brute_force(spark):
    post = spark.createDataFrame(ROWS, POST)
    chunks = spark.createDataFrame([("c1", 1), ("c2", 1), ("c3", 1), ("c4", 1), ("c1", 2), (None, 1)], "chunk_id string, tf int")  # a clashing column
    got = {(r.chunk_id, r.term): (r.tf, r.df, r.score) for r in term_scores(post, chunks).collect()}
    want = brute(ROWS, {"c1", "c2", "c3", "c4"})
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:2] == want[k][:2]
        assert abs(got[k][2] - want[k][2]) < 1e-9


def test_best_term_comes_back_and_is_shared(spark):
    post = spark.createDataFrame([("rare", "c1", 4, 10, "s"), ("alone", "c1", 9, 10, "s"), ("rare", "c2", 1, 10, "s"), ("the", "c1", 9, 10, "s"), ("the", "c2", 9, 10, "s"), ("the", "c3", 9, 10, "s"), ("once", "c1", 1, 10, "s"), ("once", "c2", 1, 10, "s")], POST)
    chunks = spark.createDataFrame([(f"c{i}",) for i in range(1, 30)], "chunk_id string")
    probes = spark.createDataFrame([("c1",), ("c1",), (None,)], "chunk_id string")
    assert [tuple(r) for r in most_distinctive(term_scores(post, chunks, probes)).collect()] == [("c1", "rare")]


def test_ties_go_to_the_smaller_term(spark):
    post = spark.createDataFrame([(t, c, 2, 4, "s") for t in ("b", "a") for c in ("c1", "c2")], POST)
    chunks = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    assert {r.term for r in most_distinctive(term_scores(post, chunks)).collect()} == {"a"}


def test_empty_tables(spark):
    post = spark.createDataFrame([], POST)
    chunks = spark.createDataFrame([], "chunk_id string")
    assert term_scores(post, chunks).count() == 0
    assert most_distinctive(term_scores(spark.createDataFrame(ROWS, POST), chunks)).count() == 0
