import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay_spark.operators import profile as PR
from assay_spark.operators import select as SE

# moments5 fixture (FIXTURES.md): 1, 2, 3, 4, 10
MOMENTS5 = [1.0, 2.0, 3.0, 4.0, 10.0]


def test_adjusted_moments(spark):
    df = spark.createDataFrame([(v,) for v in MOMENTS5], "x double")
    r = PR.moments(df, "x").first()
    assert r["n"] == 5
    assert r["skew_adj"] == pytest.approx(1.6970562748, abs=1e-9)
    assert r["kurt_adj"] == pytest.approx(3.152, abs=1e-9)
    assert r["std_pop"] == pytest.approx(3.1622776602, abs=1e-9)
    assert r["std_samp"] == pytest.approx(3.5355339059, abs=1e-9)


def test_quantile_linear_interpolation(spark):
    df = spark.createDataFrame([(v,) for v in MOMENTS5], "x double")
    assert PR.quantile(df, "x", 0.9995).first()["quantile"] == pytest.approx(9.988, abs=1e-12)


@pytest.mark.parametrize("seed", [0, 1])
def test_exact_quantiles_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    # heavy duplicates in one group, a skewed tail in the other, one tiny group
    rows = [("a", float(v)) for v in rng.integers(0, 5, 3000)]
    rows += [("b", float(v)) for v in rng.lognormal(0, 2, 2000)]
    rows += [("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9995, 1.0]
    got = {r["g"]: r for r in PR.exact_quantiles(df, "v", qs, by=["g"], accuracy=50).collect()}
    for g in "abc":
        vals = np.array([v for k, v in rows if k == g])
        assert got[g]["n"] == len(vals)
        for i, q in enumerate(qs):
            assert got[g][f"q{i}"] == pytest.approx(float(np.quantile(vals, q)), rel=1e-12, abs=1e-12)


def test_histogram_keeps_empty_bins_and_closes_last(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (10.0,)], "x double")
    h = {r["bin"]: r["count"] for r in PR.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 0, 2: 0, 3: 0, 4: 1}


def test_box_stats(spark):
    vals = list(range(1, 21)) + [100]
    df = spark.createDataFrame([("g", float(v)) for v in vals], "k string, v double")
    r = PR.box_stats(df, "v", ["k"]).first()
    q1, q3 = np.quantile(vals, 0.25), np.quantile(vals, 0.75)
    assert r["q1"] == pytest.approx(q1) and r["q3"] == pytest.approx(q3)
    assert r["outliers"] == 1 and r["whisker_hi"] == 20.0 and r["whisker_lo"] == 1.0


def test_null_report_and_drop_null_columns(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "x", None)], "a int, b string, c double")
    rep = {r["column"]: (r["non_null"], r["nulls"], r["dtype"]) for r in PR.null_report(df).collect()}
    assert rep == {"a": (2, 0, "int"), "b": (1, 1, "string"), "c": (1, 1, "double")}
    assert SE.drop_null_columns(df).columns == ["a"]


def test_zscore_and_topcode(spark):
    vals = [0.0] * 50 + [100.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v double")
    f = SE.zscore_flag(df, "v", 3.5)
    assert f.filter("outlier").count() == 1
    capped = SE.topcode(df, "v", 0.5, 0.0, out="c").agg(F.max("c")).first()[0]
    assert capped == 0.0


def test_log_axis_places_unparsable_label(spark):
    df = spark.createDataFrame([("10",), ("100",), ("Infinite",)], "s string")
    got = {r["s"]: r["x"] for r in SE.log_axis(df, "s").collect()}
    assert got["Infinite"] == pytest.approx(math.log(100) + 0.5)


def test_corr_matrix_vec_matches_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id int, x array<double>")
    got = {(r["i"], r["j"]): r["corr"] for r in PR.corr_matrix_vec(df, "x").collect()}
    c = np.corrcoef(m.T)
    for (i, j), v in got.items():
        assert v == pytest.approx(c[i, j], abs=1e-9)


def test_missing_column_fails(spark):
    from pyspark.errors import AnalysisException

    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(AnalysisException):
        PR.moments(df, "nope").collect()


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-5, 30), min_size=1, max_size=300), st.floats(0.0, 1.0), st.sampled_from([10, 50, 1000]))
def test_exact_quantile_property(spark, vals, q, acc):
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = PR.exact_quantiles(df, "v", [q], accuracy=acc).first()["q0"]
    assert got == pytest.approx(float(np.quantile(np.array(vals, dtype=float), q)), rel=1e-9, abs=1e-9)


def test_corr_of_many_dimensions_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(PR, "HELD_TILES", 3)  # tiles are handed on many times
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 300)) @ rng.normal(size=(300, 300)) + 1e3
    x[:, 7] = 5.0  # a constant dimension
    rows = [([float(v) for v in r],) for r in x] + [(None,)]
    got = {(r["i"], r["j"]): r["corr"] for r in
           PR.corr_matrix_vec(spark.createDataFrame(rows, "x array<double>").repartition(3), "x").collect()}
    assert len(got) == 300 * 301 // 2
    with np.errstate(all="ignore"):
        want = np.corrcoef(x.T)
    for (i, j), c in got.items():
        if 7 in (i, j):
            assert c is None
        else:
            assert c == pytest.approx(want[i, j], abs=1e-9)
    assert PR.corr_matrix_vec(spark.createDataFrame([], "x array<double>"), "x").collect() == []
