import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay_spark.operators import features as FE
from assay_spark.operators import profile as PR
from assay_spark.operators import sampling as SA
from assay_spark.operators import select as SE

JOBS = {
    "zscore": lambda d: SE.zscore_flag(d, "v", by=["g"]),
    "topcode": lambda d: SE.topcode(d, "v", 0.9, by=["g"]),
    "histogram": lambda d: PR.histogram(d, "v", 4, by=["g"]),
    "box": lambda d: PR.box_stats(d, "v", ["g"]),
    "quantiles": lambda d: PR.exact_quantiles(d, "v", [0.5], by=["g"]),
    "standardize": lambda d: FE.standardize(d, "x", by=["g"]),
    "impute": lambda d: FE.impute_mean(d, ["v"], by=["g"]),
}


@pytest.fixture
def hot(spark):
    """Half of the rows in one group, a null group, copies of one row."""
    d = spark.range(0, 2000, 1, 4).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 7).cast("string")).alias("g"),
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") * 1.0).alias("v"))
    return d.withColumn("x", F.array("v", F.col("v") * 2))


@pytest.fixture
def no_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_no_raw_row_is_shuffled_by_its_group_alone(spark, hot, no_broadcast, name):
    plan = JOBS[name](hot)._jdf.queryExecution().executedPlan().toString().splitlines()
    salted = 0
    for line, below in zip(plan, plan[1:]):
        if "Exchange hashpartitioning(" not in line or "ReusedExchange" in line:
            continue
        salted += "_salt" in line
        if not re.search(r"_salt|qi#|kind#|_b#|bin#|_i#", line):
            # an aggregate's partial rows, or one row a group
            assert "Aggregate" in below or "Project" in below and "Scan" not in plan[plan.index(below) + 1], (line, below)
    assert salted


@pytest.mark.parametrize("name", sorted(JOBS))
def test_salted_join_gives_the_same_rows(spark, hot, no_broadcast, monkeypatch, name):
    def rows():
        return sorted(str(r) for r in JOBS[name](hot).collect())

    salted = rows()
    monkeypatch.setattr(SA, "STAT_SALTS", 1)
    assert rows() == salted and len(salted) > 0


def test_a_null_group_is_a_group(spark, hot):
    vals = {}
    for r in hot.collect():
        vals.setdefault(r["g"], []).append(r["v"])
    assert None in vals
    q = {r["g"]: r for r in PR.exact_quantiles(hot, "v", [0.5], by=["g"]).collect()}
    box = {r["g"]: r for r in PR.box_stats(hot, "v", ["g"]).collect()}
    bins = {r["g"]: r["n"] for r in PR.histogram(hot, "v", 4, by=["g"]).groupBy("g").agg(F.sum("count").alias("n")).collect()}
    for g, v in vals.items():
        assert q[g]["q0"] == pytest.approx(np.quantile(v, 0.5)) and q[g]["n"] == len(v)
        assert box[g]["q3"] == pytest.approx(np.quantile(v, 0.75))
        assert bins[g] == len(v)
