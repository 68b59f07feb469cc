"""Feature rankings.

The reference ranks features by SHAP values; here three named statistics:
``tree`` (forest impurity importance), ``linear`` (exact linear attribution
beta_j (x_j - mean_j), mean absolute value per feature) and ``permutation``
(increase in MSE when one feature is shuffled).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay_spark.functions import arrays as A
from assay_spark.functions.keys import draw_int
from assay_spark.operators.sampling import _attach, _list, rank_within


# ---------------------------------------------------------------- T2
def top_features(imp: DataFrame, n: int, by: Sequence[str] = (), score: str = "importance",
                 name: str = "feature") -> DataFrame:
    """The ``n`` highest-scoring features (per group), ties to the smaller
    feature id; ``rank`` is 1-based."""
    by = _list(by)
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(name))
    return imp.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# ---------------------------------------------------------------- A13, F13 linear
def linear_attribution(df: DataFrame, coefs: DataFrame, by: Sequence[str] = (), vec: str = "x") -> DataFrame:
    """Mean |beta_j (x_j - mean_j)| per feature j (and group), with the
    means taken over the rows scored.  Output (by, feature, importance)."""
    by = _list(by)
    e = df.select(*by, A.entries(vec, "feature", "_x"))
    mu = e.groupBy(*by, "feature").agg(F.avg("_x").alias("_mu"))
    b = coefs.select(*by, A.entries("coef", "feature", "_beta"))
    e = _attach(e, mu, by + ["feature"])
    e = _attach(e, b, by + ["feature"])
    return (e.groupBy(*by, "feature")
             .agg(F.avg(F.abs(F.col("_beta") * (F.col("_x") - F.col("_mu")))).alias("importance"))
             .withColumn("feature", F.col("feature").cast("int")))


# ---------------------------------------------------------------- F13 correlation
def correlation_importance(df: DataFrame, vec: str = "x", y: str = "y") -> DataFrame:
    """|Pearson correlation| of every dimension with the target, rounded to 9
    decimals so that ties are ties on any engine; constant ones get 0.
    Output (feature, importance)."""
    e = df.select(F.col(y).cast("double").alias("_y"), A.entries(vec, "feature", "_x"))
    c = F.covar_pop("_x", "_y") / F.nullif(F.stddev_pop("_x") * F.stddev_pop("_y"), F.lit(0.0))
    return e.groupBy(F.col("feature").cast("int").alias("feature")).agg(
        F.round(F.coalesce(F.abs(c), F.lit(0.0)), 9).alias("importance"))


# ---------------------------------------------------------------- F12
def tree_importance(train: DataFrame, vec: str = "x", y: str = "y", seed: int = 42, **kw) -> DataFrame:
    """Forest impurity importance per feature (a d-vector from the fitted model)."""
    from assay_spark.operators.models import fit

    model = fit(train, "forest", vec, y, seed, **kw)
    imp = model.stages[-1].featureImportances.toArray()
    return train.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(imp)],
                                              "feature int, importance double")


# ---------------------------------------------------------------- F13 permutation
def permutation_importance(model, df: DataFrame, dim: int, id_col: str = "row_id", vec: str = "x",
                           y: str = "y", seed: int = 42) -> DataFrame:
    """MSE increase when feature j is replaced by its value in another row.

    The rows are put in one random order, and each row's donor is the next one
    (the first after the last), so no row of two or more is its own donor.  One
    join brings the donor's vector; the ``dim`` variants of a row are made and
    scored where it lies, so only row vectors are shuffled, whatever ``dim`` is.
    One order serves all features.  Output (feature, importance).
    """
    from assay_spark.operators.models import predict

    rows = df.select(id_col, vec, F.col(y).cast("double").alias("y")).withColumn("_h", draw_int(id_col, seed=seed))
    rows = rank_within(rows, [], "_h", [id_col], out="_r").drop("_h")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    donors = _attach(rows.select("_r", F.col(vec).alias("_dv")), n, [])
    donors = donors.select((F.pmod(F.col("_r") - 2, F.col("_n")) + 1).alias("_r"), "_dv")
    # feature -1 leaves the row as it is: the base error
    pairs = rows.join(donors, "_r").withColumn("feature", F.explode(F.sequence(F.lit(-1), F.lit(dim - 1))))
    swapped = pairs.withColumn(vec, F.transform(
        vec, lambda v, i: F.when(i == F.col("feature"), F.get("_dv", i)).otherwise(v)))
    p = predict(model, swapped, [id_col, "feature", "y"])
    per = p.groupBy("feature").agg(F.avg((F.col("y_hat") - F.col("y")) ** 2).alias("_mse"))
    base = F.max(F.when(F.col("feature") == -1, F.col("_mse"))).over(Window.partitionBy())  # dim + 1 rows
    return per.withColumn("_base", base).where("feature >= 0").select(
        F.col("feature").cast("int").alias("feature"), (F.col("_mse") - F.col("_base")).alias("importance"))


def rank_features(train: DataFrame, method: str, n: int, vec: str = "x", y: str = "y", id_col: str = "row_id",
                  dim: int | None = None, seed: int = 42, **kw) -> DataFrame:
    """Rank features by a named method and keep the top ``n``."""
    if method == "tree":
        imp = tree_importance(train, vec, y, seed, **kw)
    elif method == "correlation":
        imp = correlation_importance(train, vec, y)
    elif method == "linear":
        from assay_spark.operators.models import fit_grouped
        imp = linear_attribution(train, fit_grouped(train, [], vec, y), [], vec)
    elif method == "permutation":
        from assay_spark.operators.models import fit
        m = fit(train, kw.pop("model", "forest"), vec, y, seed, **kw)
        imp = permutation_importance(m, train, dim, id_col, vec, y, seed)
    else:
        raise ValueError(method)
    return top_features(imp, n)
