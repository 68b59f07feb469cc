"""Driver-table access and the role each table plays.

The test tables stand in for the reference's inputs (see FIXTURES.md):
``embeddings`` gives feature vectors (x), a target (label) and strata;
``events`` a skewed scalar target; ``lineitem`` a wide numeric profile;
``orders``/``documents`` unique-id populations for exact draws; ``part`` a
one-feature regression.  Loaders only rename and cast -- no filtering, no
row caps -- so every query's work grows with the table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEATURES schema from ``embeddings``: row_id, x array<double>, y double, stratum int."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"),
                    F.col("embedding").cast("array<double>").alias("x"),
                    F.col("label").cast("double").alias("y"),
                    F.col("label").alias("stratum"))


def ranked_vectors(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """FEATURES reduced to the ``n`` dimensions that rank highest by absolute
    correlation with the target over the whole table (ties: smaller
    dimension), in rank order.  The keep list has n numbers."""
    from assay_spark.operators.features import keep_dims
    from assay_spark.operators.importance import rank_features

    v = vectors(spark, sf_dir)
    top = rank_features(v, "correlation", n).orderBy("rank").select("feature").collect()
    return keep_dims(v, "x", [r["feature"] for r in top])
