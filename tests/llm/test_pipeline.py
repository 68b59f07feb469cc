"""The pipeline and the registered queries."""
import corpus_pipeline
import __spark_entry__ as entry
from assay_spark.llm.stages import near_copy_stage, quality_stage

SF = "/root/testdata/sf0.001"


def test_pipeline_keeps_and_packs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, rows = {}, docs
    for name, step in corpus_pipeline.STAGES:
        rows = step(spark, rows, SF).cache()
        seen[name] = rows.count()
        if name != "packing":
            assert rows.columns == docs.columns
    n = docs.count()
    assert list(seen) == ["language_id", "quality", "near_copies", "packing"]
    assert n >= seen["language_id"] >= seen["quality"] >= seen["near_copies"] > n // 2
    assert rows.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    spark.catalog.clearCache()


def test_near_copy_stage_leaves_one_of_each_group(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base), (2, base + " x"), (3, "y " + base), (4, "another text of its own entirely"), (5, None), (5, None), (None, base), (4, "another text of its own entirely"),
            (6, "z " * 50)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "q") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int, extra string")
    out = near_copy_stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted([(0, base), (1, base), (4, rows[3][1]), (5, ""), (6, rows[8][1])])


def test_quality_stage_keeps_repeated_ids_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = quality_stage(spark, docs, SF)
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert {"op4_backoff_lm", "op6_chat_tree"} <= set(entry.oracle_sql())
