import itertools
import random

import numpy as np
import pytest

from lodestore.llm import near_duplicates as nd
from lodestore.llm.shared import words

SCHEMA = "record string, id string, content string, node int, sig string"


def brute(rows, threshold, size):
    sets = {}
    for record, key, text, *_ in rows:
        w = words(text) if text else []
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        if s and key is not None:
            sets[record, key] = s
    out = set()
    for (r, a), (q, b) in itertools.combinations(sorted(sets), 2):
        if r == q:
            x, y = sets[r, a], sets[q, b]
            if len(x & y) / len(x | y) >= threshold:
                out.add((r, a, b))
    return out


def rows_of(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        rows.append(("document", f"d{i:03d}", " ".join(base)))
        for j in range(rng.randint(0, 2)):
            edit = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 20)):
                edit[rng.randrange(len(edit))] = rng.choice(vocabulary)
            rows.append((rng.choice(["document", "chunk"]), f"d{i:03d}-{j}", " ".join(edit).upper() + "!"))
    rows += [("document", "x1", rows[0][2]), ("document", "x1", rows[0][2]), ("document", "nil", None), ("document", "blank", "  "), ("document", "two", "just two"), ("document", "two2", "just two"), ("document", None, rows[0][2])]
    return [(a, b, c, 1, "s") for a, b, c in rows]


@pytest.mark.parametrize(("threshold", "size"), [(0.6, 3), (0.8, 5)])
def test_against_brute_force(spark, threshold, size):
    rows = rows_of()
    got = {tuple(r) for r in nd.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), threshold, size).collect()}
    assert got == brute(rows, threshold, size)


def test_large_bucket_is_compared_in_blocks(spark):
    """More near-duplicates of one text than a small bucket holds: every link is still found."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(nd.SMALL + 300):
        edit = list(base)
        edit[rng.randrange(200)] = f"e{i}"
        rows.append(("chunk", f"k{i:04d}", " ".join(edit), 1, "s"))
    got = nd.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.8, 3)
    n = len(rows)
    assert got.count() == n * (n - 1) // 2


def test_copies_form_one_class(spark):
    rows = [("document", f"c{i}", "a copy of one and the same text", 1, "s") for i in range(50)]
    links, members = nd.similar_classes(spark.createDataFrame(rows, SCHEMA), 0.8, 5)
    assert links.count() == 0
    assert members.select("node").distinct().count() == 1
    assert nd.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), 0.8, 5).count() == 50 * 49 // 2


def test_very_long_text_and_empty(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [("document", "l1", long, 1, "s"), ("document", "l2", long.replace("t77 ", "zz "), 1, "s")]
    assert [tuple(r) for r in nd.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), 0.8, 5).collect()] == [("document", "l1", "l2")]
    assert nd.near_duplicate_pairs(spark.createDataFrame([], SCHEMA), 0.8, 5).count() == 0


def test_estimate_is_unbiased(spark):
    rng = np.random.default_rng(2)
    mh = nd.MinHash(48, 4)
    for j in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(30):
            n = 200
            common = int(round(2 * n * j / (1 + j)))
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
            a, b = pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])
            x, y = (nd.MinHash.pack(mh.minima(h)).view(np.uint64) for h in (a, b))
            d = x ^ y
            off = int(np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
            errors.append((0.75 - off / 192) / 0.75 - common / (2 * n - common))
        assert abs(np.mean(errors)) < 0.03


def test_jvm_estimate_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(-(2**63), 2**63 - 1, (2, 5, 6))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "a array<bigint>, b array<bigint>")
    got = [r[0] for r in df.select(nd.lane_estimate(df.a, df.b, 192)).collect()]
    d = x.view(np.uint64) ^ y.view(np.uint64)
    off = np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1)
    assert np.allclose(got, (0.75 - off / 192) / 0.75)


@pytest.mark.parametrize("frequent", [4, 10**6])
def test_hot_band_keys_of_many_sizes(spark, monkeypatch, frequent):
    """Texts that grow out of one another share band keys over many sizes; told as frequent or not, no link is lost."""
    monkeypatch.setattr(nd, "FREQUENT", frequent)
    monkeypatch.setattr(nd, "SMALL", 4)
    monkeypatch.setattr(nd, "BLOCK", 7)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(90):
        edit = base[: 150 + 2 * i]
        edit[rng.randrange(len(edit))] = f"e{i}"
        rows.append(("chunk", f"k{i:04d}", " ".join(edit), 1, "s"))
    got = {tuple(r) for r in nd.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA).repartition(2), 0.6, 3).collect()}
    assert got == brute(rows, 0.6, 3)
    assert len(got) > 1000


def test_kinds_with_a_common_beginning_stay_apart(spark):
    text = "one two three four five six seven"
    rows = [("a kind of records, the first", "x", text, 1, "s"), ("a kind of records, the second", "y", text, 1, "s"), (None, "z", text, 1, "s"), ("a kind of records, the first", "w", text, 1, "s")]
    got = [tuple(r) for r in nd.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), 0.8, 5).collect()]
    assert got == [("a kind of records, the first", "w", "x")]


def test_links_of_records(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("chunk", "a", text, 1, "s"), ("chunk", "b", text, 1, "s"), ("chunk", "c", text + " end", 1, "s"), ("chunk", "d", "nothing of the kind is in here at all", 1, "s")]
    got = {r.id: (r.node, r.links) for r in nd.linked_records(*nd.similar_classes(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got["a"] == got["b"]
    assert got["a"][0] != got["c"][0]
    assert [got[k][1] for k in "abcd"] == [1, 1, 1, 0]
