"""Every registered query against its DuckDB twin on the smallest tables,
and a smoke run of every query without one."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from assay_spark.plans.oracle import ORACLE
from assay_spark.plans.queries import QUERIES
from assay_spark.plans.catalog import TABLES

SF = "/root/testdata/sf0.001"
SLOW_ROWS_ONLY = {"forest", "gbt", "bagging", "elbow", "rank_tree"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((repr([_norm(r[i]) for i in order]) for r in rows))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 1 and set(df.columns) == {"mse", "mae", "r2", "n"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    df = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(ocols, res.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW_ROWS_ONLY))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF).count() > 0
