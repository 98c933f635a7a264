"""Every query of the folder over the smallest tables; those with SQL against DuckDB."""

import glob
import os

import pytest

from lodestore.llm import queries


@pytest.mark.parametrize("name", list(queries.queries()))
def test_runs(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert df.count() >= 0


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(sf + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = queries.queries()[name](spark, sf)
    r = c.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in r.description]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(r.fetchall())
