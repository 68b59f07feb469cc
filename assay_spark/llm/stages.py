"""The operators as stages of a corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

Filtering stages return the columns they get.  A row is told by its id and a
hash of its text, so rows that repeat an id are judged each for itself; repeated
rows with equal texts share their fate, but for one of them in the near-copy
stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay_spark.llm.common import may_hold, membership_filter, stage, table
from assay_spark.llm.jaccard_join import jaccard_components
from assay_spark.llm.lang_crf import accept, fit_language_model
from assay_spark.llm.pattern_pack import pack_documents
from assay_spark.llm.site_quality import judge

#: A document goes if no language has this mean word probability.
LEAST_LANGUAGE = 0.4
#: Near copies share five-word shingles with this Jaccard similarity in percent, or more.
SHINGLE, PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents without letters or without any likely language go."""
    return accept(docs, fit_language_model(docs), LEAST_LANGUAGE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents judged of low quality or toxic go."""
    judged = judge(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))
    gone = judged.where(~F.col("keep")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(gone, same, "left_anti")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near copies the document with the smallest id stays."""
    # an id may repeat: a row's key is its id and text hash, ordered by the id first
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    keyed = docs.select(F.when(F.col("doc_id").isNotNull(), key).alias("key"), "text")
    found = jaccard_components(keyed, id_col="key", shingle=SHINGLE, percent=PERCENT)
    # rows that go or repeat are looked at again; a filter of fixed size tells most others, whose texts stay where they are
    special = found.where("key IS NOT NULL").groupBy("key").agg(
        F.max(F.col("key") != F.col("component_id")).alias("goes"), F.count("*").alias("rows")).where("goes OR rows > 1")
    special = stage(special.select("goes", F.col("key.id").alias("_id"), F.col("key.hash").alias("_hash")), "special-rows")
    sure, maybe = told_apart(docs, F.xxhash64("doc_id", F.xxhash64("text")), special.select(F.xxhash64("_id", "_hash").alias("h")))
    gone = special.where("goes").select("_id", "_hash")
    left = maybe.join(gone, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
    once = left.where(F.col("doc_id").isNotNull()).withColumn("_nth", nth).where(F.col("_nth") == 1).drop("_nth")
    return sure.unionByName(once).unionByName(left.where(F.col("doc_id").isNull()))


def told_apart(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not among ``keys``, a column h of hashes; the rows left)."""
    known = rows.sparkSession.sparkContext.broadcast(membership_filter(keys, "h"))
    hashed = rows.withColumn("_key_hash", key)

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = may_hold(known.value, b.column(b.num_columns - 1).to_numpy())
                yield b.select(b.schema.names[:-1]).filter(pa.array(hit == wanted))

        return hashed.mapInArrow(run, rows.schema)

    return part(False), part(True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: all documents packed into sequences of at most 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_len=4096, end_id=1)
