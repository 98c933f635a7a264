"""Every core query over the smallest tables; those with SQL against DuckDB. And the driver's contract."""

import glob
import math
import os

import pytest

from lodestore.plans import registry

SQL = registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def tables(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(sf + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf, tables, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr(plain(tuple(r[c] for c in columns))) for r in df.collect())
    if name not in SQL:
        assert rows is not None
        return
    got = tables.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr(plain(tuple(r[i] for i in at))) for r in got.fetchall())


def test_contract(spark):
    import __spark_entry__ as entry

    every = entry.queries()
    assert set(entry.oracle_sql()) <= set(every)
    assert set(registry.queries()) <= set(every)
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0


def test_the_core_does_not_need_the_other_folder():
    root = os.path.dirname(os.path.dirname(os.path.abspath(registry.__file__)))
    for path in glob.glob(root + "/**/*.py", recursive=True):
        if os.sep + "llm" + os.sep not in path:
            with open(path) as f:
                text = f.read()
            assert "from .llm" not in text and "..llm" not in text and "lodestore.llm" not in text


def test_cache_semantic_beside_a_hot_label(spark, tmp_path):
    """More than ten thousand vectors of another label are nearer than the nearest of the query's own."""
    near = [(i, [1.0, 0.01 * (i % 7)], 0) for i in range(201, 10_301) if i % 100]
    rows = [(100, [1.0, 0.0], 1), (103, [0.6, 0.8], 1), (200, [1.0, 0.0], 2), *near, *[(i, [0.9, 0.1], 3) for i in range(10_301, 10_500) if i % 100]]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in registry.queries()["cache_semantic"](spark, str(tmp_path)).collect()] == [(100, 103, 0.6)]


def test_long_lists_keep_all_their_ranks(spark, monkeypatch):
    n = 1_000_001
    rows = spark.range(n).selectExpr("'q' AS query_id", "0 AS search_no", "true AS is_dense", "cast(id AS string) AS chunk_id", "0.5D AS score", "cast(id + 1 AS int) AS rank")
    monkeypatch.setattr(registry, "_hits", lambda *_: rows)
    monkeypatch.setattr(registry, "_reranked", lambda *_: rows)
    for name, column in (("dense_floor", "rank"), ("lost_in_middle", "place")):
        got = registry.queries()[name](spark, "").agg({"*": "count", column: "max"}).first()
        assert sorted(got) == [n, n]
