"""Faults found in the first round stay mended."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay_spark import session
from assay_spark.operators import features as FE
from assay_spark.operators import importance as IM
from assay_spark.operators import kernels as K
from assay_spark.operators import models as MO
from assay_spark.operators import report as RP


def cells(spark, rows):
    return spark.createDataFrame(rows, "rec int, row_id long, x array<double>, y double, split string")


def points(n=60, seed=0, split=lambda i: "test" if i % 5 == 0 else "train"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return [(1, i, x[i].tolist(), float(x[i] @ [1, 2, -1]), split(i)) for i in range(n)]


def test_knn_with_a_repeated_test_id(spark):
    df = cells(spark, points())
    test, train = df.where("split = 'test'"), df.where("split = 'train'")
    one = {r["row_id"]: r["y_hat"] for r in K.knn_regression(test, train, 5).collect()}
    twice = K.knn_regression(test.unionAll(test), train, 5).collect()
    assert len(twice) == 2 * len(one)
    assert all(r["y_hat"] == one[r["row_id"]] for r in twice)


def test_evaluate_imputes_train_means(spark):
    rows = points()
    rows[3] = (*rows[3][:2], [None, *rows[3][2][1:]], *rows[3][3:])
    rows[5] = (*rows[5][:2], [rows[5][2][0], None, rows[5][2][2]], *rows[5][3:])
    mean = np.array([[np.nan if v is None else v for v in r[2]] for r in rows if r[4] == "train"])
    fill = np.nanmean(mean, axis=0)
    full = [(*r[:2], [float(fill[k]) if v is None else v for k, v in enumerate(r[2])], *r[3:]) for r in rows]
    key = lambda df: sorted((r["algorithm"], round(r["mse"], 9), r["n"]) for r in df.collect())
    algs = ["ols", "ridge", "knn", "mean"]
    assert key(MO.evaluate(cells(spark, rows), ["rec"], algs)) == key(MO.evaluate(cells(spark, full), ["rec"], algs))


def test_cells_without_train_rows_stay(spark):
    rows = points() + [(2, 900 + i, [0.0, 0.0, 1.0], 1.0, "test") for i in range(3)]
    res = MO.evaluate(cells(spark, rows), ["rec"], ["ols", "ridge", "knn", "mean"]).collect()
    assert sorted((r["rec"], r["algorithm"], r["n"]) for r in res if r["rec"] == 2) == [(2, a, 0) for a in ("knn", "mean", "ols", "ridge")]


def test_timing_covers_the_fit(spark, monkeypatch):
    import time

    real = MO.fit

    def slow(*a, **k):
        time.sleep(1.5)
        return real(*a, **k)

    monkeypatch.setattr(MO, "fit", slow)
    assert MO.evaluate_timed(cells(spark, points()), ["rec"], ["tree"]).first()["fit_seconds"] >= 1.5


def test_noise_uses_the_whole_id(spark):
    df = spark.createDataFrame([(1, [0.0] * 20), (1 + 2 ** 31, [0.0] * 20), (1 + 2 ** 33, [0.0] * 20)], "row_id long, x array<double>")
    out = {tuple(r["noisy"]) for r in FE.add_shot_noise(df, "row_id", "x", [1000], method="binomial").collect()}
    assert len(out) == 3
    zero = FE.add_shot_noise(df, "row_id", "x", [0], method="binomial").collect()
    assert all(r["noisy"] == [0.0] * 20 for r in zero)
    with pytest.raises(ValueError):
        FE.add_shot_noise(df, "row_id", "x", [1], method="other")


def test_permutation_keeps_no_own_values(spark):
    rows = points(120, 3)
    df = cells(spark, rows)
    model = MO.fit(df, "ols")
    imp = {r["feature"]: r["importance"] for r in IM.permutation_importance(model, df, 3).collect()}
    x = np.array([r[2] for r in rows])
    for j, b in enumerate([1, 2, -1]):
        assert abs(imp[j] / (2 * b * b * x[:, j].var()) - 1) < 0.45  # expected MSE increase of a permuted column


def test_r2_over_scored_rows(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2), (100.0, None)], "y double, y_hat double")
    y, p = np.array([1.0, 2.0, 3.0]), np.array([1.1, 1.9, 3.2])
    r = RP.regression_metrics(df).first()
    assert r["n"] == 3 and abs(r["r2"] - (1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-12


def test_keep_dims_in_rank_order(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [4.0])], "row_id long, x array<double>")
    assert [r["x"] for r in FE.keep_dims(df, "x", [2, 0]).orderBy("row_id").collect()] == [[3.0, 1.0], None, [None, 4.0]]


def test_correlation_ranking(spark):
    df = cells(spark, points(200, 5)).withColumn("x", F.concat("x", F.array(F.lit(1.0))))
    got = [r["feature"] for r in IM.rank_features(df, "correlation", 4).orderBy("rank").collect()]
    assert got[0] == 1 and got[-1] == 3


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="share"):
        session.checkpoint_dir(Session())


def test_permutation_importance_shuffles_rows_once_whatever_the_dimensions(spark):
    from assay_spark.operators import importance as IM
    from assay_spark.operators.models import fit
    from pyspark.sql import functions as F

    def exchanges(d):
        df = spark.range(50).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: (F.col("id") * i % 11).cast("double")).alias("x"),
                                    F.col("id").cast("double").alias("y"))
        imp = IM.permutation_importance(fit(df, "ols", "x", "y", 1), df, d)
        assert imp.count() == d
        return imp._jdf.queryExecution().executedPlan().toString().count("Exchange")

    assert exchanges(2) == exchanges(9)
