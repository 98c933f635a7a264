"""Near-duplicate records with small edits: b-bit MinHash with band candidates, then an exact check.

Records are sets of word shingles (lower-cased runs of letters and digits). Equal sets form one class. Each class
has `bands * rows` minima; bands of whole minima give candidates, the two low bits of each minimum are packed into
longs, and the similarity of a candidate pair is estimated from the number of equal lanes, corrected for chance
collisions: J = (equal - 1/4) / (3/4). Pairs well below the threshold are dropped, the rest is checked exactly.

Defined results
* Null and blank contents, and contents of fewer words than a shingle, never match anything.
* Rows repeated under one id count once; if their contents differ, the one with the smallest class key counts.
* Pairs have the smaller id first, in plain string order; a record is never paired with itself.
* Only pairs of the same record kind are formed; rows without a kind are left out. Empty tables give an empty result.
  Other columns are not read.
* Texts are taken whole. With 64 bands of 4, a pair at similarity 0.6 becomes a candidate with probability 0.99986,
  at 0.7 with 0.99999997. That is the chance of the method, no cap.

Scale: a band bucket of up to `SMALL` classes is compared by its pairs. A larger one is cut by the number of shingles
(sets whose sizes differ too much cannot be alike) and by hash into blocks that are compared block against block, each
in a task of bounded size, and only pairs that pass the estimate come out. Band keys that are frequent in any part of
the input are told first and never gathered in one task. Copies of one text send their band keys once per task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import words, written

SMALL, BLOCK = 32, 2048
#: A band key that this many classes share within a million keys of one task is frequent.
FREQUENT = 256
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingles:
    """Distinct shingle hashes of a text; remembers the hashes of words, within a bound."""

    def __init__(self, size: int):
        self.size, self.seen = size, {}
        self.factors = _mix(np.arange(1, size + 1, dtype=np.uint64)) | _U(1)

    def __call__(self, text: str | None) -> np.ndarray:
        got = words(text) if text else []
        n = len(got) - self.size + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        try:
            codes = [seen[w] for w in got]
        except KeyError:
            for w in got:
                if w not in seen:
                    seen[w] = xxhash.xxh64_intdigest(w)
            codes = [seen[w] for w in got]
        h = np.array(codes, dtype=np.uint64)
        total = np.zeros(n, np.uint64)
        for j, f in enumerate(self.factors):
            total += h[j : j + n] * f
        return np.unique(_mix(total))


class MinHash:
    """Minima of `bands * rows` permutations; their band keys and their packed low bits."""

    def __init__(self, bands: int, rows: int):
        if bands * rows % 32:
            raise ValueError("bands * rows must be a multiple of 32: two bits each are packed into longs")
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(20_011)
        k = bands * rows
        self.a = (rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, k, dtype=np.uint32)[:, None]
        self.row_factor = _mix(np.arange(11, 11 + rows, dtype=np.uint64)) | _U(1)
        self.band_salt = _mix(np.arange(101, 101 + bands, dtype=np.uint64))

    def minima(self, h: np.ndarray) -> np.ndarray:
        x = (h >> _U(32)).astype(np.uint32)[None, :]
        out = None
        for lo in range(0, x.shape[1], 4096):  # bounds the table for very long texts
            v = x[:, lo : lo + 4096] * self.a
            v += self.b
            v ^= v >> np.uint32(16)
            m = v.min(axis=1)
            out = m if out is None else np.minimum(out, m)
        return out

    def keys(self, minima: np.ndarray, salt: int) -> np.ndarray:
        m = minima.reshape(self.bands, self.rows).astype(np.uint64)
        return _mix((m * self.row_factor).sum(axis=1) + self.band_salt + _U(salt)).view(np.int64)

    @staticmethod
    def pack(minima: np.ndarray) -> np.ndarray:
        low = (minima & np.uint32(3)).astype(np.uint64).reshape(-1, 32)
        return (low << (_U(2) * np.arange(32, dtype=np.uint64))).sum(axis=1).astype(np.uint64).view(np.int64)


def lane_estimate(a: Column, b: Column, lanes: int) -> Column:
    """Collision-corrected similarity of two packed signatures, from bit counts, in the JVM."""

    def unequal(x, y):
        d = x.bitwiseXOR(y)
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    off = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda acc, x: acc + x)
    return (F.lit(1.0) - off / F.lit(float(lanes)) - F.lit(0.25)) / F.lit(0.75)


def fingerprints(records: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(record, id, node, n, sig, bands) for records(record, id, content); bands once per task and class."""

    def run(batches):
        cut, mh = Shingles(shingle), MinHash(bands, rows)
        sent: dict[int, np.ndarray] = {}
        for batch in batches:
            out = {k: [] for k in ("record", "id", "node", "n", "sig", "bands")}
            for record, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                h = cut(text)
                if not len(h):
                    continue
                node = int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8, salt=hashlib.blake2b(record.encode(), digest_size=16).digest()).digest(), "little", signed=True)
                if node in sent:
                    sig, band = sent[node], None
                else:
                    m = mh.minima(h)
                    sig, band = mh.pack(m), mh.keys(m, xxhash.xxh64_intdigest(record) >> 1)
                    if len(sent) >= 50_000:
                        sent.clear()
                    sent[node] = sig
                for name, value in zip(out, (record, key, node, len(h), sig, band)):
                    out[name].append(value)
            types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return records.select("record", "id", "content").mapInArrow(run, "record string, id string, node bigint, n int, sig array<bigint>, bands array<bigint>")


def _runs(batches):
    """From rows (key, node) in order: pairs of small buckets (a, b), members of large ones (key, a)."""
    pend_k, pend_n, flushed = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def emit(a, b=None, key=None):
        return pa.record_batch([pa.nulls(len(a), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (a, b, key)], names=["a", "b", "key"])

    def hot(k, n):
        nonlocal flushed
        flushed += len(n)
        return emit(n, key=k)

    def pairs(n, starts, sizes):
        a, b = [], []
        for size in np.unique(sizes):
            if 2 <= size <= SMALL:
                at = starts[sizes == size]
                i, j = np.triu_indices(size, 1)
                a.append(n[at[:, None] + i].ravel())
                b.append(n[at[:, None] + j].ravel())
        return emit(np.concatenate(a), np.concatenate(b)) if a else None

    for batch in batches:
        k = np.concatenate([pend_k, batch.column(0).to_numpy(zero_copy_only=False)])
        n = np.concatenate([pend_n, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(k):
            continue
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
        k, n = k[fresh], n[fresh]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        last = starts[-1]
        if flushed and len(starts) > 1:  # the bucket under way ends within this batch
            end = starts[1]
            yield hot(k[1:end], n[1:end])  # its first row was sent before
            flushed, k, n, starts, last = 0, k[end:], n[end:], starts[1:] - end, last - end
        sizes = np.diff(starts)
        got = pairs(n, starts[:-1], sizes)
        if got is not None:
            yield got
        for s, size in zip(starts[:-1][sizes > SMALL], sizes[sizes > SMALL]):
            yield hot(k[s : s + size], n[s : s + size])
            flushed = 0
        pend_k, pend_n = k[last:], n[last:]
        if flushed:
            yield hot(pend_k[1:], pend_n[1:])
        elif len(pend_k) > SMALL:
            yield hot(pend_k, pend_n)
        if flushed:  # keep one row, to know the bucket and skip a repeat
            pend_k, pend_n = pend_k[-1:], pend_n[-1:]
    if len(pend_k) and not flushed:
        got = pairs(pend_n, np.array([0]), np.array([len(pend_n)]))
        if got is not None:
            yield got


def frequent_keys(prints: DataFrame) -> DataFrame:
    """(key): band keys that FREQUENT classes share within some window of a task; a narrow pass, at most one key in FREQUENT comes out."""

    def run(batches):
        held, size = [], 0

        def close():
            key, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(key[count >= FREQUENT], pa.int64())], names=["key"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= 1_000_000:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    return prints.select("bands").where(F.col("bands").isNotNull()).mapInArrow(run, "key bigint").distinct()


def _compare(x: np.ndarray, y: np.ndarray, lanes: int, least: float, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y whose estimate is least or more, a tile at a time."""
    out = []
    for lo in range(0, len(x), at_once):
        for hi in range(0, len(y), at_once):
            d = x[lo : lo + at_once, None, :] ^ y[None, hi : hi + at_once, :]
            off = np.bitwise_count((d | (d >> _U(1))) & _U(0x5555555555555555)).sum(2, dtype=np.int64)
            i, j = np.nonzero((0.75 - off / lanes) / 0.75 >= least)
            out.append((i + lo, j + hi))
    return tuple(np.concatenate(z) for z in zip(*out))


def _large_buckets(members: DataFrame, sigs: DataFrame, lanes: int, threshold: float, least: float) -> DataFrame:
    """Pairs (a, b) of members(key, node) of buckets above SMALL that pass the estimate.

    A bucket is a grid: `size` parts it so that sets of parts further apart than one cannot reach the threshold, and
    blocks of about BLOCK part each size. Only sizes that are equal or next to each other meet, each pair of blocks in one task.
    """
    step = -np.log(threshold) * (1 + 1e-9)
    rows = members.distinct().join(sigs, "node").withColumn("size", F.floor(F.log("n") / F.lit(float(step))).cast("int"))
    counts = rows.groupBy("key", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    plan = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("size", "blocks"))).alias("plan"))  # few sizes per key
    rows = rows.join(plan, "key").withColumn("at", F.pmod(F.xxhash64("node"), F.element_at("plan", F.col("size"))).cast("int"))
    upto = lambda size: F.when(F.map_contains_key("plan", size), F.sequence(F.lit(0), F.element_at("plan", size) - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda low, high, i, j, side: F.struct(low.alias("low"), high.alias("high"), i.alias("i"), j.alias("j"), side.alias("side"))
    size, at = F.col("size"), F.col("at")
    same = F.transform(upto(size), lambda o: cell(size, size, F.least(at, o), F.greatest(at, o), (at > o).cast("int")))
    above = F.transform(upto(size + 1), lambda o: cell(size, size + 1, at, o, F.lit(0)))
    below = F.transform(upto(size - 1), lambda o: cell(size - 1, size, o, at, F.lit(1)))
    grid = rows.select("key", "node", "sig", F.explode(F.concat(same, above, below)).alias("c")).select("key", "node", "sig", "c.*")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if key[1] == key[2] and key[3] == key[4]:
            right = left
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        x, y = (np.stack(s["sig"]).astype(np.int64).view(np.uint64) for s in (left, right))
        i, j = _compare(x, y, lanes, least)
        a, b = left["node"].to_numpy()[i], right["node"].to_numpy()[j]
        keep = a < b if right is left else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]}).drop_duplicates()

    return grid.groupBy("key", "low", "high", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def similar_classes(records: DataFrame, threshold: float = 0.8, shingle: int = 5, bands: int = 64, rows: int = 4, slack: float = 0.17) -> tuple[DataFrame, DataFrame]:
    """(pairs(a, b, jaccard), members(record, id, node)): links between classes, and who is in which class.

    slack: how far below the threshold the estimate may be for the exact check to be made; 0.17 is 4.4 standard
    deviations of the estimate from 256 two-bit lanes at a similarity of 0.6, 5.3 at 0.8.
    """
    lanes = bands * rows
    records = records.where(F.col("id").isNotNull() & F.col("record").isNotNull())
    prints = written(fingerprints(records, shingle, bands, rows), "prints")
    members = prints.groupBy("record", "id").agg(F.min("node").alias("node"))
    sigs = prints.where(F.col("bands").isNotNull()).select("node", "sig", "n").dropDuplicates(["node"])

    keyed = prints.where(F.col("bands").isNotNull()).select("node", F.explode("bands").alias("key"))
    marks = written(frequent_keys(prints).withColumn("frequent", F.lit(True)), "frequent")
    some = marks.count()
    if some > 500_000:  # too many to send to every executor
        keyed = keyed.join(marks, "key", "left")
    else:
        keyed = keyed.join(F.broadcast(marks), "key", "left") if some else keyed.withColumn("frequent", F.lit(None).cast("boolean"))
    often = keyed.where("frequent").select("key", "node")
    ordered = keyed.where("frequent IS NULL").select("key", "node").repartition(F.col("key")).sortWithinPartitions("key", "node")
    found = written(ordered.mapInArrow(_runs, "a bigint, b bigint, key bigint"), "candidates")
    small = found.where(F.col("b").isNotNull()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    least = threshold - slack
    large = _large_buckets(found.where(F.col("key").isNotNull()).select("key", F.col("a").alias("node")).unionByName(often), sigs, lanes, threshold, least)
    pairs = small.unionByName(large).distinct()

    side = lambda s: sigs.select(F.col("node").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("n").alias(f"n_{s}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    able = F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b")  # else the sizes alone forbid it
    pairs = written(pairs.where(able & (lane_estimate(F.col("sig_a"), F.col("sig_b"), lanes) >= least)).select("a", "b"), "likely")

    # The exact check reads the text of one member of each class that is left.
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    chosen = members.join(needed, "node", "left_semi").groupBy("node").agg(F.min(F.struct("record", "id")).alias("m")).select("node", "m.record", "m.id")
    texts = records.select("record", "id", "content").join(chosen, ["record", "id"])

    def sets(batches):
        cut = Shingles(shingle)
        for batch in batches:
            got = [cut(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(got, pa.list_(pa.int64()))], names=["node", "h"])

    whole = written(texts.select("node", "content").mapInArrow(sets, "node bigint, h array<bigint>").dropDuplicates(["node"]), "sets")
    both = pairs.join(whole.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(whole.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    exact = both.select("a", "b", (common / (F.size("ha") + F.size("hb") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)
    return exact, members


def linked_records(links: DataFrame, members: DataFrame) -> DataFrame:
    """(record, id, node, links): each record with its class and the number of other classes that its class is linked to."""
    ends = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "node", "left").select("record", "id", "node", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_pairs(records: DataFrame, threshold: float = 0.8, shingle: int = 5, **how) -> DataFrame:
    """(record, id_a, id_b) for all pairs of ids, copies included: as many rows as there are such pairs."""
    links, members = similar_classes(records, threshold, shingle, **how)
    members = written(members, "members")
    left = members.select("record", F.col("id").alias("x"), F.col("node").alias("a"))
    right = members.select(F.col("id").alias("y"), F.col("node").alias("b"))
    across = links.select("a", "b").join(left, "a").join(right, "b").select("record", "x", "y")
    shared = members.groupBy("node").count().where("count > 1").select("node")
    inside = members.join(shared, "node", "left_semi")
    within = inside.select("record", "node", F.col("id").alias("x")).join(inside.select("node", F.col("id").alias("y")), "node").where("x < y").select("record", "x", "y")
    return across.unionByName(within).select("record", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def two_tables(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """records(record, id, content) of documents and chunks."""
    a = documents.select(F.lit("document").alias("record"), F.col("doc_id").alias("id"), "content")
    return a.unionByName(chunks.select(F.lit("chunk").alias("record"), F.col("chunk_id").alias("id"), "content"))
