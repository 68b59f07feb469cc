"""Queries that SQL can express, against DuckDB on the smallest tables."""
import math

import duckdb
import pytest

from assay_spark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    fix = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted(repr([fix(r[k]) for k in order]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE[name])
    cols = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(cols, want.fetchall())
