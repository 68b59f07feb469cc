"""The membership filter never loses a key, and a full one changes the work only."""
import numpy as np
from pyspark.sql import functions as F

from assay_spark.llm import common
from assay_spark.llm.common import may_hold, membership_filter
from assay_spark.llm.stages import near_copy_stage, told_apart

SF = "/root/testdata/sf0.001"


def test_no_key_is_lost(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    f = membership_filter(keys, "h")
    mine = np.array([r["h"] for r in keys.collect()])
    others = np.array([r["h"] for r in spark.range(10_000, 40_000).select(F.xxhash64("id").alias("h")).collect()])
    assert may_hold(f, mine).all() and may_hold(f, others).mean() < 0.05
    assert not may_hold(membership_filter(keys.limit(0), "h"), others).any()


def test_rows_are_told_apart(spark, docs):
    sure, maybe = told_apart(docs, F.xxhash64("doc_id"), spark.createDataFrame([(2,), (7,)], "i bigint").select(F.xxhash64("i").alias("h")))
    assert sure.columns == maybe.columns == docs.columns
    assert {2, 7} <= {r["doc_id"] for r in maybe.collect()}
    assert sorted(map(repr, sure.unionByName(maybe).collect())) == sorted(map(repr, docs.collect()))


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(r["doc_id"] for r in near_copy_stage(spark, docs, SF).collect())
    monkeypatch.setattr(common, "FILTER_BITS", 6)
    assert sorted(r["doc_id"] for r in near_copy_stage(spark, docs, SF).collect()) == want
