"""Clustering (C1, C3): seeded k-means|| on the feature vector only (never
on a previous label or the target), and the elbow curve."""

from __future__ import annotations

from typing import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay_spark import constants as C


def kmeans(df: DataFrame, vec: str = "x", k: int = C.CLUSTERS, seed: int = 42, max_iter: int = 20):
    from pyspark.ml.clustering import KMeans

    d = df.withColumn("_f", array_to_vector(vec))
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="_cl").fit(d)


def complete_dims(df: DataFrame, vec: str) -> list[int]:
    """0-based dimensions of ``vec`` with no null or NaN in any row (one
    aggregate; the answer is bounded by the vector width)."""
    from assay_spark.functions.arrays import entries

    flags = (df.select(entries(vec, "_i", "_v")).groupBy("_i")
               .agg(F.bool_or(F.col("_v").isNull() | F.isnan("_v")).alias("_bad")))
    return sorted(r["_i"] for r in flags.filter(~F.col("_bad")).select("_i").collect())


def cluster(df: DataFrame, vec: str = "x", k: int = C.CLUSTERS, seed: int = 42, out: str = "cluster",
            max_iter: int = 20) -> DataFrame:
    """Label every row with its k-means cluster, clustering on the
    dimensions that are complete in every row (the reference drops feature
    columns holding nulls, then labels all rows).  Only the feature vector
    is used: no earlier label, no target."""
    keep = complete_dims(df, vec)
    idx = F.array(*[F.lit(i + 1) for i in keep])
    d = df.withColumn("_xc", F.transform(idx, lambda i: F.element_at(F.col(vec), i)))
    model = kmeans(d, "_xc", k, seed, max_iter)
    return (model.transform(d.withColumn("_f", array_to_vector("_xc")))
            .withColumn(out, F.col("_cl").cast("int")).drop("_f", "_cl", "_xc"))


def centroids(df: DataFrame, vec: str = "x", k: int = C.CLUSTERS, seed: int = 42) -> DataFrame:
    model = kmeans(df, vec, k, seed)
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(rows, "cluster int, centroid array<double>")


def elbow(df: DataFrame, vec: str = "x", ks: Sequence[int] = C.ELBOW_KS, seed: int = 42) -> DataFrame:
    """Within-cluster sum of squares for each k.  Spark's k-means refuses
    k = 1; that cost is the total sum of squared deviations, sum_d n·var_pop."""
    from assay_spark.operators.features import vector_stats

    out = []
    for k in ks:
        if k == 1:
            st = vector_stats(df, vec).select(
                (F.col("_n") * F.aggregate(F.col("_sd"), F.lit(0.0), lambda a, s: a + s * s)).alias("c")).first()
            out.append((1, float(st["c"])))
        else:
            out.append((int(k), float(kmeans(df, vec, int(k), seed).summary.trainingCost)))
    return df.sparkSession.createDataFrame(out, "k int, cost double")
