import numpy as np
import pytest
from pyspark.sql import functions as F

from assay_spark.functions import arrays as A
from assay_spark.operators import features as FE
from assay_spark.operators import models as MO
from assay_spark.operators import select as SE
from assay_spark.session import cut_lineage, materialize


def test_impute_mean_vec_uses_fit_rows(spark):
    df = spark.createDataFrame([(0, "train", [1.0, None]), (1, "train", [3.0, 4.0]), (2, "test", [None, None])],
                               "row_id int, split string, x array<double>")
    out = {r["row_id"]: r["x"] for r in FE.impute_mean_vec(df, "x", fit_on=F.col("split") == "train").collect()}
    assert out == {0: [1.0, 4.0], 1: [3.0, 4.0], 2: [2.0, 4.0]}


def test_keep_long_and_align_long(spark):
    lng = spark.createDataFrame([(1, "D_1", 0.5), (1, "D_9", 9.0), (2, "D_2", 2.0)],
                                "row_id int, col_name string, value double")
    keep = spark.createDataFrame([(1, "D_2"), (2, "D_1")], "rank int, col_name string")
    k = sorted(tuple(r) for r in SE.keep_long(lng, keep).select("row_id", "col_name", "rank").collect())
    assert k == [(1, "D_1", 2), (2, "D_2", 1)]
    ids = spark.createDataFrame([(1,), (2,)], "row_id int")
    a = {(r["row_id"], r["col_name"]): r["value"] for r in SE.align_long(lng, ids, keep).collect()}
    assert a == {(1, "D_1"): 0.5, (1, "D_2"): 0.0, (2, "D_1"): 0.0, (2, "D_2"): 2.0}


def test_lower_bound(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 5.0], v) for v in (0.0, 1.0, 2.0, 3.0, 9.0)], "a array<double>, v double")
    got = [r[0] for r in df.select(A.lower_bound("a", "v", 4)).collect()]
    assert got == [0, 0, 1, 3, 4]


def test_fit_report_and_timed_grid(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "test" if i % 5 == 0 else "train", [float(v) for v in rng.normal(size=2)], 0.0) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, split string, x array<double>, y double")
    df = df.withColumn("y", F.col("x")[0] * 2.0 + 1.0)
    rep = {r["split"]: r for r in MO.fit_report(df.filter("split='train'"), df.filter("split='test'"), "ols").collect()}
    assert rep["test"]["mse"] == pytest.approx(0.0, abs=1e-9) and rep["train"]["r2"] == pytest.approx(1.0)
    t = MO.evaluate_timed(df, [], ["ols", "mean"]).collect()
    assert {r["algorithm"] for r in t} == {"ols", "mean"} and all(r["fit_seconds"] >= 0 for r in t)


def test_embed_and_lineage(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "row_id long, x array<double>")
    e = FE.embed(df, "x", lambda m: np.column_stack([m.sum(axis=1), m[:, 0] * 2]), 2)
    got = {r["row_id"]: r["embedding"] for r in e.collect()}
    assert got[3] == [4.0, 6.0]
    c = cut_lineage(df.filter("row_id > 4"))
    assert c.count() == 5 and materialize(df).count() == 10


def test_evaluate_train_resplit(spark):
    rows = [(i, c, "test" if i % 5 == 0 else "train", [float(i % 7), 1.0], float(i % 7)) for c in (1, 2)
            for i in range(50)]
    cells = spark.createDataFrame(rows, "row_id long, cell int, split string, x array<double>, y double")
    real = {r["cell"]: r["n"] for r in MO.evaluate(cells, ["cell"], ["mean"]).collect()}
    inner = {r["cell"]: r["n"] for r in MO.evaluate(cells, ["cell"], ["mean"], score_on="train_resplit").collect()}
    assert real == {1: 10, 2: 10} and inner == {1: 8, 2: 8}
