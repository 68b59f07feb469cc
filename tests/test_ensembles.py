"""Forests and bagged trees grown in groups: Spark ML's tree, large nodes, weights, odd rows."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from assay_spark.operators import ensembles as EN
from assay_spark.operators import importance as IM
from assay_spark.operators import models as MO


def table(spark, n=240, d=5, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(2)
    y = np.where(x[:, 1] > 0.2, 3.0, 0.0) + x[:, 0] + 0.1 * rng.normal(size=n)
    rows = [(i, x[i].tolist(), float(y[i])) for i in range(n)]
    rows += [(n + i, [0.0] * d, float(i % 2)) for i in range(copies)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, y double").repartition(3)
    return df.withColumn("_f", array_to_vector("x")).withColumn("_y", F.col("y"))


def by_id(df):
    return {r["row_id"]: r["_pred"] for r in df.select("row_id", "_pred").collect()}


@pytest.mark.parametrize("depth, group_bytes", [(0, 40 * 21), (4, EN.GROUP_BYTES), (4, 40 * 21), (30, 40 * 21)])
def test_one_tree_is_that_of_spark_ml(spark, depth, group_bytes, monkeypatch):
    monkeypatch.setattr(EN, "GROUP_BYTES", group_bytes)  # all rows in one group, or 40 at most
    df = table(spark)
    model = EN.fit_ensemble(df, "bagging", numTrees=1, maxDepth=depth, bootstrap=False)
    ml = DecisionTreeRegressor(featuresCol="_f", labelCol="_y", predictionCol="_pred", maxDepth=depth).fit(df)
    new = table(spark, seed=9)
    # nodes of two rows split equally well by many features: new rows then tell only ties apart
    for rows in (df, new) if depth < 30 else (df,):
        got, want = by_id(model.transform(rows)), by_id(ml.transform(rows))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert np.allclose(model.featureImportances.toArray(), ml.featureImportances.toArray(), atol=1e-8 if depth < 30 else 0.02)


def test_few_entries_at_once_give_the_same_tree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    codes, y = rng.integers(0, 32, (300, 6)).astype(np.uint8), rng.normal(size=300)
    w = EN.row_weights(np.arange(300), 2, 7)
    whole = EN.grow(codes, y, w, 30, 2, np.random.default_rng(1))
    monkeypatch.setattr(EN, "ENTRIES", 300)
    parts = EN.grow(codes, y, w, 30, 2, np.random.default_rng(1))
    assert all(np.allclose(whole[k], parts[k]) for k in whole)
    at = EN.descend(codes[w > 0], whole["feature"], whole["cut"], whole["child"])
    assert np.abs(whole["value"][at] - y[w > 0]).max() < 0.5 and len(whole["value"]) > 150


def test_weights_are_poisson_and_differ_by_tree():
    a, b = (EN.row_weights(np.arange(200_000), t, 42) for t in (0, 1))
    assert abs(a.mean() - 1) < 0.01 and abs(a.var() - 1) < 0.02 and abs((a == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01


@pytest.mark.parametrize("kind", ["forest", "bagging"])
def test_no_group_holds_more_than_its_bytes(spark, kind, monkeypatch):
    """Copies of one row that nothing can split, more than a group may hold, become a leaf."""
    df = table(spark, copies=200)
    whole = EN.fit_ensemble(df, kind, numTrees=12)
    monkeypatch.setattr(EN, "GROUP_BYTES", 60 * 21)
    model = EN.fit_ensemble(df, kind, numTrees=12)
    a, b = by_id(whole.transform(df)), by_id(model.transform(df))
    assert len(b) == 440 and set(a) == set(b)
    assert abs(b[300] - 0.5) < 0.2 and np.corrcoef([a[k] for k in a], [b[k] for k in a])[0, 1] > 0.95
    assert len(model.tops[0].feature) > 3 and all(t.feature[0] >= 0 for t in model.tops)


def test_forest_scores_as_spark_ml_does(spark):
    df, new = table(spark, n=400), table(spark, n=200, seed=5)
    ml = MO.estimator("forest", numTrees=40).fit(df)
    got, want, truth = by_id(EN.fit_ensemble(df, "forest", numTrees=40).transform(new)), by_id(ml.transform(new)), {r["row_id"]: r["y"] for r in new.collect()}
    err = [np.mean([(p[k] - truth[k]) ** 2 for k in truth]) for p in (got, want)]
    assert abs(err[0] - err[1]) < 0.25 * err[1]
    top = IM.rank_features(df, "tree", 2, numTrees=40).orderBy("rank").collect()
    assert [r["feature"] for r in top] == [1, 0]


def test_fit_takes_named_forests_from_here(spark):
    df = table(spark, n=90).drop("_f", "_y")
    rep = {r["split"]: r for r in MO.fit_report(df, table(spark, n=30, seed=4), "bagging").collect()}
    assert isinstance(MO.fit(df, "bagging").model, EN.EnsembleModel)
    assert rep["train"]["n"] == 90 and rep["test"]["n"] == 30 and rep["train"]["r2"] > rep["test"]["r2"] > 0.5


def test_odd_rows(spark):
    df = table(spark, n=30)
    for y in (None, float("nan"), float("inf")):
        with pytest.raises(Exception, match="Labels MUST NOT"):
            EN.fit_ensemble(df.withColumn("_y", F.lit(y).cast("double")), "bagging")
    with pytest.raises(ValueError, match="no rows"):
        EN.fit_ensemble(df.where("row_id < 0"), "forest")
    same = EN.fit_ensemble(df.withColumn("_y", F.lit(2.0)), "forest", numTrees=3)
    assert set(by_id(same.transform(df)).values()) == {2.0} and not same.featureImportances.toArray().any()
    assert same.transform(df.where("row_id < 0")).count() == 0
    twice = same.transform(df.unionByName(df))
    assert twice.count() == 60 and twice.columns == [*df.columns, "_pred"]


def test_ties_favour_no_feature():
    """Nodes of two rows split equally well by most features: a forest's importances must not lean to the first ones."""
    rng = np.random.default_rng(0)
    codes, y = rng.integers(0, 32, (400, 12)).astype(np.uint8), rng.normal(size=400)
    gains = sum(EN.grow(codes, y, EN.row_weights(np.arange(400), t, 1), 30, 4, np.random.default_rng(t))["gains"] for t in range(60))
    half = gains[:6].sum() / gains.sum()
    assert 0.48 < half < 0.52
    a = EN.looked_at(5000, 12, 4, rng)
    assert all(len(set(r)) == 4 for r in a.tolist()) and (np.abs(np.bincount(a[:, 0], minlength=12) / 5000 - 1 / 12) < 0.02).all()
