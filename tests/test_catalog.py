"""Every query with SQL gives DuckDB's rows; the others run and keep their invariants."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from driftline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    said = duck.execute(catalog.SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(plain(x) for x in r) for r in said.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr) == want
    assert want or name in ("cold_queries",)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
