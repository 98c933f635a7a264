"""Filling fixed-capacity containers with items: a grouping genetic algorithm on islands.

Items longer than the capacity are divided: full containers of their own, and a rest that is packed like any item.
Items are hashed into regions of about `region` items. Every region is evolved by several islands, each a population
of packings that begin with items in random order. A child takes a parent's packing, injects whole well-filled bins of
another, drops the bins that thereby hold an item twice, opens the emptiest ones and best-fits the displaced items. After
each epoch every island sends its elite to the next one of its region. All generations are run, whatever the packing;
where sizes are small against the capacity little is left to gain, where they are not (0.2 to 0.6 of it) the packing
ends below that of best fit in order of size. Then the badly filled bins of all regions are opened and their items
packed again in fewer regions.

Defined results
* Items of size 0 or of null size need no place: container null, part 0 of 0 parts.
* Only items above the capacity are divided; parts are numbered from 0 and all but the last are full.
* A null id is an item like others; rows repeated under one id are items of their own only if their size differs.
* The result depends on ids and sizes alone (hashes and fixed seeds), not on partitioning. Empty in, empty out.
* Sizes must not be negative (they count as 0). Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

_STATE = "region int, island int, genome binary, fitness double"


def fitness(fill: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins in use."""
    used = fill[fill > 0] / capacity
    return float((used * used).mean()) if len(used) else 0.0


def best_fit(order: np.ndarray, sizes: np.ndarray, genome: np.ndarray, fill: list[int], capacity: int) -> None:
    """Places the items of order, largest room use first, into genome and fill in place."""
    rooms = sorted((capacity - f, b) for b, f in enumerate(fill) if f < capacity)
    for i in order:
        s = int(sizes[i])
        k = bisect_left(rooms, (s, -1))
        if k == len(rooms):
            b = len(fill)
            fill.append(s)
            room = capacity - s
        else:
            room, b = rooms.pop(k)
            fill[b] += s
            room -= s
        genome[i] = b
        if room:
            insort(rooms, (room, b))


def new_packing(sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Items in random order, each where it fits best."""
    genome, fill = np.full(len(sizes), -1, np.int32), []
    best_fit(rng.permutation(len(sizes)), sizes, genome, fill, capacity)
    return genome


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of b go into a; a's bins that share an item with them are dissolved."""
    fill_b = np.bincount(b, weights=sizes).astype(np.int64)
    good = np.flatnonzero(fill_b >= np.quantile(fill_b, 0.6))
    taken = rng.permutation(good)[: max(1, len(good) // 3)]
    came = np.isin(b, taken)
    gone = np.unique(a[came])
    fill_a = np.bincount(a, weights=sizes).astype(np.int64)
    bins = np.unique(a)
    weak = bins[np.argsort(fill_a[bins])[: max(1, len(bins) // 20)]]  # the emptiest bins are opened too
    loose = (np.isin(a, gone) | np.isin(a, weak)) & ~came
    child = np.full(len(a), -1, np.int32)
    stay = ~(came | loose)
    label, child_stay = np.unique(a[stay], return_inverse=True)
    child[stay] = child_stay
    _, child_came = np.unique(b[came], return_inverse=True)
    child[came] = child_came + len(label)
    placed = child >= 0
    fill = np.bincount(child[placed], weights=sizes[placed]).astype(np.int64).tolist() if placed.any() else []
    out = np.flatnonzero(loose)
    best_fit(out[np.argsort(-sizes[out], kind="stable")], sizes, child, fill, capacity)
    return child


def evolve(sizes: np.ndarray, genomes: list[np.ndarray], capacity: int, population: int, generations: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    fit = lambda g: fitness(np.bincount(g, weights=sizes), capacity)
    pool = [(fit(g), g) for g in genomes]
    while len(pool) < population:
        g = new_packing(sizes, capacity, rng)
        pool.append((fit(g), g))
    for _ in range(generations if len(sizes) > 1 else 0):
        pool.sort(key=lambda p: -p[0])
        pool = pool[:population]
        for _ in range(population // 2):
            i, j = sorted(rng.choice(population, 2, replace=False))  # the better one takes bins of the other
            child = crossover(pool[i][1], pool[j][1], sizes, capacity, rng)
            pool.append((fit(child), child))
    pool.sort(key=lambda p: -p[0])
    return [g for _, g in pool[:population]]


def _pack_regions(items: DataFrame, regions: int, capacity: int, islands: int, population: int, generations: int, epochs: int, tag: str) -> DataFrame:
    """(item, size, region, bin, fill) of the best packing of each region."""
    at = F.xxhash64(F.col("item.id"), F.col("item.part"), F.lit(tag))
    items = written(items.select("item", "size", at.alias("at"), F.pmod(at, F.lit(regions)).cast("int").alias("region")), f"items-{tag}")
    many = items.select("region", "at", "size", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    order = lambda pdf: pdf.sort_values(["size", "at"], ascending=[False, True], ignore_index=True)
    cut = 2 * population

    def step(epoch: int):
        def run(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            region, island = int(key[0]), int(key[1])
            if not len(pdf):
                return pd.DataFrame({"region": [], "island": [], "genome": [], "fitness": []}, dtype=object)
            sizes = order(pdf)["size"].to_numpy(np.int64)
            state = state.sort_values(["fitness", "genome"], ascending=[False, True]).head(cut)
            genomes = [np.frombuffer(g, np.int32) for g in state["genome"]]
            got = evolve(sizes, genomes, capacity, population, generations, seed=1_000_003 * epoch + 1009 * region + island)
            fit = [fitness(np.bincount(g, weights=sizes), capacity) for g in got]
            home = [island] * len(got)
            rows = list(zip(home, got, fit)) + [((island + 1) % islands, got[0], fit[0])]  # the elite migrates
            return pd.DataFrame({"region": region, "island": [r[0] for r in rows], "genome": [r[1].astype(np.int32).tobytes() for r in rows], "fitness": [r[2] for r in rows]})

        return run

    state = items.sparkSession.createDataFrame([], _STATE)
    for epoch in range(epochs):
        state = many.groupBy("region", "island").cogroup(state.groupBy("region", "island")).applyInPandas(step(epoch), _STATE)
        state = written(state, f"epoch-{tag}")
    best = state.groupBy("region").agg(F.max(F.struct("fitness", "genome")).alias("m")).select("region", "m.genome")

    def read_out(key: tuple, pdf: pd.DataFrame, win: pd.DataFrame) -> pd.DataFrame:
        pdf = order(pdf)
        genome = np.frombuffer(win["genome"].iloc[0], np.int32) if len(pdf) else np.zeros(0, np.int32)
        fill = np.bincount(genome, weights=pdf["size"]).astype(np.int64) if len(pdf) else genome
        return pdf[["item", "size", "region"]].assign(bin=genome, fill=fill[genome])

    kind = items.schema["item"].dataType.simpleString()
    return items.groupBy("region").cogroup(best.groupBy("region")).applyInPandas(read_out, f"item {kind}, size bigint, region int, bin int, fill bigint")


def fill_containers(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", *, capacity: int = 4096, region: int = 2000, islands: int = 2, population: int = 8, generations: int = 12, epochs: int = 2, open_below: float = 0.98) -> DataFrame:
    """(id, part, parts, n_tokens, container): where each piece of each item goes.

    Memory per task is a region's items and a few packings of them, whatever the input; the states of the
    islands move by shuffle between epochs and are written, so that a lost executor repeats one epoch at most.
    """
    n = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    rows = sizes.select(F.col(id_col).alias("id"), n.alias("n")).distinct()
    parts = F.ceil(F.col("n") / capacity).cast("int")
    rows = rows.select("id", "n", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))).alias("part"))
    size = F.least(F.col("n") - F.col("part").cast("bigint") * capacity, F.lit(capacity)).cast("bigint")
    rows = written(rows.select(F.struct("id", "part", "parts").alias("item"), size.alias("size")), "pieces")

    full = rows.where(F.col("size") == capacity).select("item", "size", F.concat_ws("-", F.lit("full"), F.hex(F.xxhash64("item.id")), F.col("item.part")).alias("container"))
    none = rows.where("size = 0").select("item", "size", F.lit(None).cast("string").alias("container"))
    loose = rows.where((F.col("size") > 0) & (F.col("size") < capacity))
    how = {"capacity": capacity, "islands": islands, "population": population, "generations": generations, "epochs": epochs}
    first = written(_pack_regions(loose, max(1, -(-loose.count() // region)), tag="first", **how), "first")
    poor = first.where(F.col("fill") < int(open_below * capacity)).select("item", "size")
    again = _pack_regions(poor, max(1, -(-poor.count() // region)), tag="second", **how)
    name = lambda tag: F.concat_ws("-", F.lit(tag), F.col("region"), F.col("bin")).alias("container")
    kept = first.where(F.col("fill") >= int(open_below * capacity)).select("item", "size", name("a"))
    done = full.unionByName(none).unionByName(kept).unionByName(again.select("item", "size", name("b")))
    return done.select(F.col("item.id").alias(id_col), "item.part", "item.parts", F.col("size").alias(size_col), "container")


def divided(packing: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id): the items that lie in more than one container."""
    return packing.where("parts > 1").groupBy(id_col).agg(F.min("container").alias("a"), F.max("container").alias("b")).where("a <> b").select(id_col)
