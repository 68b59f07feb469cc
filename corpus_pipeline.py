"""Corpus pipeline: language ID, quality, near-copies, packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and reread as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay_spark.llm.common import stage, table
from assay_spark.llm.stages import language_stage, near_copy_stage, packing_stage, quality_stage

STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_copies", near_copy_stage),
    ("packing", packing_stage),
]

#: The stages hold trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
