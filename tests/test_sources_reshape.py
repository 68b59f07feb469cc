import os
import tempfile

from pyspark.sql import functions as F

from assay_spark.operators import reshape as RS
from assay_spark.sources import files as S


def test_read_cells_parses_keys_from_names(spark):
    d = tempfile.mkdtemp(prefix="cells-")
    for kind, split, rec, sub in [("X", "test", 200, 1), ("X", "train", 200, 2), ("y", "test", 100, 1)]:
        with open(os.path.join(d, f"{kind}_{split}_{rec}rec_sub{sub}act4v3.csv"), "w") as f:
            f.write(",D_1,D_2\n0,1.5,2.5\n1,3.5,4.5\n")
    df = S.read_cells(spark, os.path.join(d, "*.csv"), schema="idx int, D_1 double, D_2 double", columns=["idx", "D_1"])
    rows = df.select("kind", "split", "rec", "sub", "act", "version").distinct().collect()
    assert sorted(tuple(r) for r in rows) == [("X", "test", 200, 1, 4, 3), ("X", "train", 200, 2, 4, 3),
                                              ("y", "test", 100, 1, 4, 3)]
    assert df.count() == 6 and "D_2" not in df.columns


def test_write_cells_partition_pruning(spark):
    d = tempfile.mkdtemp(prefix="wc-")
    df = spark.createDataFrame([(4, 100, s, 3, float(s)) for s in range(1, 4)], "act int, rec int, sub int, version int, v double")
    S.write_cells(df, d)
    back = spark.read.parquet(d).filter("sub = 2")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and back.count() == 1


def test_matrix_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="mx-")
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0])], "sample long, x array<double>")
    S.write_matrix(df, os.path.join(d, "m"), "sample", "x")
    back = {r["sample"]: r["x"] for r in S.read_matrix(spark, os.path.join(d, "m")).collect()}
    assert back == {0: [1.0, 2.0, 3.0], 1: [4.0, 5.0, 6.0]}


def test_scores_long_from_nested_literals(spark):
    nested = {"mse": {"rf": [0.2, 0.3], "gp": []}, "mae": {"rf": [0.4]}}
    long = RS.scores_long(S.from_scores(spark, nested, "act4"), keep=["source"])
    got = sorted((r["metric"], r["model"], r["run"], r["score"]) for r in long.collect())
    assert got == [("mae", "rf", 1, 0.4), ("mse", "rf", 1, 0.2), ("mse", "rf", 2, 0.3)]


def test_long_wide_and_results_frame(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, b double")
    lng = RS.to_long(df, ["id"], ["a", "b"])
    wide = RS.to_wide(lng, ["id"], "col_name", "value", ["a", "b"]).first()
    assert (wide["a"], wide["b"]) == (2.0, 3.0)
    r = spark.createDataFrame([(["rf", "gp"], [0.1, 0.2])], "Algorithm array<string>, MSE array<double>")
    assert [tuple(x) for x in RS.results_frame(r, ["Algorithm", "MSE"]).collect()] == [("rf", 0.1), ("gp", 0.2)]


def test_transpose_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "id long, x array<double>")
    t = {r["row_id"]: r["x"] for r in RS.transpose(df, "id", "x").collect()}
    assert t == {0: [1.0, 3.0, 5.0], 1: [2.0, 4.0, 6.0]}


def test_read_wide_declared_schema(spark):
    d = tempfile.mkdtemp(prefix="wide-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("MOLECULE,Act,D_1\nM1,6.1,0.5\nM2,5.9,\n")
    df = S.read_wide(spark, p, "MOLECULE string, Act double, D_1 double")
    assert df.filter(F.col("D_1").isNull()).count() == 1 and df.count() == 2


def test_read_cells_column_subset_is_pruned_in_the_scan(spark):
    d = tempfile.mkdtemp(prefix="prune-")
    with open(os.path.join(d, "X_test_200rec_sub1act4v3.csv"), "w") as f:
        f.write("idx,D_1,D_2,D_3\n0,1.0,2.0,3.0\n")
    df = S.read_cells(spark, os.path.join(d, "*.csv"), schema="idx int, D_1 double, D_2 double, D_3 double",
                      columns=["idx", "D_2"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<idx:int,D_2:double>" in plan
