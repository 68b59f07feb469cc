import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from assay_spark.functions.keys import draw_int, permuted
from assay_spark.operators import sampling as SA


def strata200(spark, parts=4):
    """5 strata x 40 rows (FIXTURES.md strata200)."""
    rows = [(i, i % 5, float(i) / 7.0) for i in range(200)]
    return spark.createDataFrame(rows, "row_id long, stratum int, y double").repartition(parts)


def test_rank_within_matches_row_number(spark):
    rows = [(i, ["a", "b", None][i % 3], i % 17) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, k long")
    df = df.withColumn("h", draw_int("k", seed=1))  # ties on h: only 17 distinct keys
    got = SA.rank_within(df, ["g"], "h", ["id"], bucket_bits=4).select("id", "rank")
    w = Window.partitionBy("g").orderBy("h", "id")
    want = df.withColumn("rank", F.row_number().over(w)).select("id", "rank")
    assert sorted(got.collect()) == sorted(want.collect())
    lim = SA.rank_within(df, ["g"], "h", ["id"], limit=5, bucket_bits=4)
    assert lim.count() == 15 and lim.agg(F.max("rank")).first()[0] == 5


def test_split_exact_sizes_and_disjoint(spark):
    df = strata200(spark)
    s = SA.split_exact(df, "row_id", 20, seed=3)
    assert s.filter("split = 'test'").count() == 40
    assert s.count() == 200 and s.select("row_id").distinct().count() == 200


def test_same_seed_same_rows_any_partitioning(spark):
    a = SA.sample_n(strata200(spark, 1), "row_id", 37, seed=9).select("row_id").collect()
    b = SA.sample_n(strata200(spark, 7), "row_id", 37, seed=9).select("row_id").collect()
    c = SA.sample_n(strata200(spark, 7), "row_id", 37, seed=10).select("row_id").collect()
    assert sorted(a) == sorted(b) and len(a) == 37
    assert sorted(a) != sorted(c)


def test_stratified_split_equal_strata(spark):
    s = SA.stratified_split(strata200(spark), "row_id", "stratum", 20, seed=1)
    counts = {r["stratum"]: r["count"] for r in s.filter("split = 'test'").groupBy("stratum").count().collect()}
    assert counts == {k: 8 for k in range(5)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=1, max_value=30), min_size=1, max_size=5), st.integers(1, 99))
def test_stratified_split_largest_remainder(spark, sizes, pct):
    rows, rid = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((rid, s))
            rid += 1
    df = spark.createDataFrame(rows, "row_id long, stratum int")
    out = SA.stratified_split(df, "row_id", "stratum", pct, seed=5)
    test = {r["stratum"]: r["count"] for r in out.filter("split = 'test'").groupBy("stratum").count().collect()}
    total = sum(sizes)
    m = (total * pct + 99) // 100
    assert sum(test.values()) == m
    for s, n in enumerate(sizes):
        quota = m * n / total
        assert math.floor(quota) <= test.get(s, 0) <= math.floor(quota) + 1


def test_stratified_sample_without_replacement(spark):
    s = SA.stratified_sample(strata200(spark), "row_id", "stratum", 100, seed=2)
    counts = {r["stratum"]: r["count"] for r in s.groupBy("stratum").count().collect()}
    assert counts == {k: 20 for k in range(5)}
    assert s.select("row_id").distinct().count() == 100


def test_tiny_stratum(spark):
    rows = [(i, 0) for i in range(20)] + [(100, 1), (101, 1)]
    df = spark.createDataFrame(rows, "row_id long, stratum int")
    # without replacement the small stratum gives what it has
    s = SA.stratified_sample(df, "row_id", "stratum", 10, seed=1)
    assert {r["stratum"]: r["count"] for r in s.groupBy("stratum").count().collect()} == {0: 5, 1: 2}
    with pytest.raises(Exception):
        SA.stratified_sample(df, "row_id", "stratum", 10, seed=1, strict=True).collect()
    # with replacement every stratum gets its full share
    r = SA.stratified_sample(df, "row_id", "stratum", 10, seed=1, replace=True)
    assert {x["stratum"]: x["count"] for x in r.groupBy("stratum").count().collect()} == {0: 5, 1: 5}
    assert r.filter("stratum = 1").select("row_id").distinct().count() <= 2


def test_subsamples_grid_and_overlap(spark):
    cells = SA.subsamples(strata200(spark), "row_id", "stratum", [50, 100], 3, seed=4, replace=False)
    sizes = {(r["rec"], r["sub"]): r["count"] for r in cells.groupBy("rec", "sub").count().collect()}
    assert sizes == {(rec, sub): rec for rec in (50, 100) for sub in (1, 2, 3)}
    tests = cells.filter("split = 'test'").groupBy("rec", "sub").count().collect()
    assert all(r["count"] == (r["rec"] * 20 + 99) // 100 for r in tests)
    ov = SA.overlap(cells, "row_id", ["rec", "sub"]).collect()
    assert all(r["both_ids"] == 0 for r in ov)
    rep = SA.subsamples(strata200(spark), "row_id", "stratum", [50], 2, seed=4, replace=True)
    assert rep.groupBy("rec", "sub").count().collect()[0]["count"] == 50


def test_exclude_drawn_and_dedupe(spark):
    df = strata200(spark)
    drawn = SA.sample_n(df, "row_id", 30, seed=1)
    rest = SA.exclude_drawn(df, drawn, "row_id")
    assert rest.count() == 170 and rest.join(drawn, "row_id").count() == 0
    dup = spark.createDataFrame([(1, "a", 5.0), (2, "a", 6.0), (0, "b", 1.0)], "row_id long, k string, v double")
    d = {r["k"]: r["row_id"] for r in SA.dedupe_first(dup, ["k"], "row_id").collect()}
    assert d == {"a": 1, "b": 0}


def test_disjoint_subsamples(spark):
    cells = SA.subsamples(strata200(spark), "row_id", "stratum", [20, 50], 3, seed=8, disjoint=True)
    sizes = {(r["rec"], r["sub"]): r["count"] for r in cells.groupBy("rec", "sub").count().collect()}
    assert sizes == {(rec, sub): rec for rec in (20, 50) for sub in (1, 2, 3)}
    per_size = cells.groupBy("rec", "row_id").count()
    assert per_size.filter("count > 1").count() == 0


def test_default_draw_is_with_replacement(spark):
    cells = SA.subsamples(strata200(spark), "row_id", "stratum", [100], 2, seed=1)
    assert "draw" in cells.columns and cells.groupBy("rec", "sub").count().first()["count"] == 100


def test_keyed_permutation_is_one_for_any_size(spark):
    sizes = [1, 2, 3, 7, 64, 100, 1001]
    df = spark.createDataFrame([(n, i, k) for n in sizes for i in range(n) for k in (1, 2)], "n long, i long, k int")
    got = df.select("n", "k", permuted(F.col("i"), F.col("n"), "k", seed=5).alias("p")).groupBy("n", "k").agg(
        F.sort_array(F.collect_list("p")).alias("p"), F.collect_list("p").alias("raw")).collect()
    assert len(got) == 2 * len(sizes)
    assert all(r["p"] == list(range(r["n"])) for r in got)
    by = {(r["n"], r["k"]): r["raw"] for r in got}
    assert by[1001, 1] != by[1001, 2]


def test_draws_without_replacement_are_even_and_capped_by_the_stratum(spark):
    df = spark.range(60).select(F.col("id").alias("row_id"), F.when(F.col("id") < 10, 0).otherwise(1).alias("stratum"))
    cells = SA.subsamples(df, "row_id", "stratum", [40], 200, seed=3, replace=False)
    per = cells.groupBy("sub", "stratum").agg(F.count("*").alias("c"), F.countDistinct("row_id").alias("d")).collect()
    assert {(r["stratum"], r["c"], r["d"]) for r in per} == {(0, 10, 10), (1, 20, 20)}
    often = [r["count"] for r in cells.where("stratum = 1").groupBy("row_id").count().collect()]
    assert len(often) == 50 and min(often) > 50 and max(often) < 110  # 80 expected, deviation 7


def test_draws_need_no_exchange_per_cell(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 5).alias("stratum"))
    count = lambda sizes, repeats: SA.subsamples(df, "row_id", "stratum", sizes, repeats, replace=False)._jdf.queryExecution().toString().count("Exchange")
    assert count([100], 1) == count([100, 200, 800], 25)
