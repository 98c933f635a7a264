import numpy as np
import pytest

from lodestore.llm import containers
from lodestore.llm.containers import best_fit, crossover, divided, evolve, fill_containers, fitness, new_packing

CAP = 100


def placed(spark, rows, **how):
    df = spark.createDataFrame([(i, n, "x") for i, n in rows], "doc_id bigint, n_tokens bigint, container string")
    return fill_containers(df, capacity=CAP, **how).toPandas()


def test_nothing_is_lost_or_split_without_need(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(0, 60, 500))] + [(900, 250), (901, 100), (902, 200), (903, 101), (904, None), (905, -3)]
    got = placed(spark, rows, region=100)
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {i: max(n or 0, 0) for i, n in rows}
    assert (got.groupby("container").n_tokens.sum() <= CAP).all()
    assert set(got[got.parts > 1].doc_id) == {900, 902, 903}
    assert got[got.n_tokens == 0].container.isna().all()
    assert got[got.n_tokens > 0].container.notna().all()
    assert got[got.doc_id == 900].sort_values("part").n_tokens.tolist() == [100, 100, 50]
    used = got.container.nunique()
    assert got.n_tokens.sum() / (used * CAP) > 0.97


def test_the_result_depends_on_sizes_alone(spark):
    rows = [(i, 1 + (i * 37) % 70) for i in range(300)]
    a = placed(spark, rows, region=80).sort_values(["doc_id", "part"]).reset_index(drop=True)
    b = placed(spark, rows[::-1], region=80).sort_values(["doc_id", "part"]).reset_index(drop=True)
    assert a.equals(b)


def test_crossover_keeps_packings_valid():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 60, 120))[::-1].copy()
    a, b = new_packing(sizes, CAP, rng), new_packing(sizes, CAP, rng)
    for _ in range(20):
        c = crossover(a, b, sizes, CAP, rng)
        assert (c >= 0).all()
        assert np.bincount(c, weights=sizes).max() <= CAP
        a, b = b, c


def test_evolution_never_gets_worse():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(20, 60, 150))[::-1].copy()
    first = fitness(np.bincount(new_packing(sizes, CAP, rng), weights=sizes), CAP)
    best = evolve(sizes, [], CAP, 4, 15, 7)[0]
    assert fitness(np.bincount(best, weights=sizes), CAP) >= first


@pytest.mark.parametrize("most", [50, 60, 70])
def test_evolution_beats_best_fit_by_size(most):
    """Sizes of 0.2 to 0.5, 0.6 and 0.7 of the capacity: fewer bins than best fit in order of size, than the first packings too."""
    capacity, rng = 4096, np.random.default_rng(most)
    sizes = np.sort(rng.integers(capacity // 5, capacity * most // 100, 600))[::-1].copy()
    by_size, fill = np.full(len(sizes), -1, np.int32), []
    best_fit(np.arange(len(sizes)), sizes, by_size, fill, capacity)
    start = min(g.max() + 1 for g in evolve(sizes, [], capacity, 8, 0, 5))
    pool = []
    for epoch in range(8):
        pool = evolve(sizes, pool, capacity, 8, 12, epoch)
    bins = pool[0].max() + 1
    assert np.bincount(pool[0], weights=sizes).max() <= capacity
    assert bins < start
    assert bins <= len(fill)
    if most == 50:
        assert bins < len(fill)


def test_crossover_is_always_run(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(containers, "crossover", lambda a, *rest: calls.append(1) or a)
    evolve(np.full(40, 10), [], CAP, 4, 5, 1)  # a packing that cannot be bettered
    assert len(calls) == 10


def test_divided_and_empty(spark):
    df = spark.createDataFrame([(1, 500, ""), (2, 5, "")], "doc_id bigint, n_tokens bigint, part string")
    assert [r.doc_id for r in divided(fill_containers(df, capacity=CAP)).collect()] == [1]
    assert fill_containers(df.limit(0), capacity=CAP).count() == 0
    same = spark.createDataFrame([(1, 5), (1, 5)], "doc_id bigint, n_tokens bigint")
    assert fill_containers(same, capacity=CAP).count() == 1


@pytest.mark.parametrize("n", [1, CAP])
def test_a_single_item(spark, n):
    got = placed(spark, [(1, n)])
    assert len(got) == 1
    assert got.container.notna().all()
