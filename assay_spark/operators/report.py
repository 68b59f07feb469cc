"""Scores and roll-ups.

Every roll-up is one ``groupBy`` with all its aggregates, so mean and spread
come out of the same partial/final aggregation instead of two passes and a
merge.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay_spark.operators.sampling import _list


# ---------------------------------------------------------------- A7, A8
def regression_metrics(pred: DataFrame, by: Sequence[str] = (), y: str = "y", y_hat: str = "y_hat",
                       extended: bool = False) -> DataFrame:
    """MSE, MAE, R² (= 1 - SSE / (n · var_pop(y))) and n per group, all over
    the rows that have a prediction; with
    ``extended`` also RMSE and MAPE (relative to the truth, zero truths
    skipped)."""
    by = _list(by)
    e = F.col(y_hat) - F.col(y)
    aggs = [
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.sum(e * e) / (F.count(e) * F.var_pop(F.when(e.isNotNull(), F.col(y))))).alias("r2"),
        F.count(e).alias("n"),
    ]
    if extended:
        aggs += [F.sqrt(F.avg(e * e)).alias("rmse"),
                 F.avg(F.abs(e / F.nullif(F.col(y), F.lit(0.0)))).alias("mape")]
    return pred.groupBy(*by).agg(*aggs) if by else pred.agg(*aggs)


def join_predictions(pred: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the actual value to each prediction by (cell, row id)."""
    return pred.join(truth, _list(keys), "inner")


# ---------------------------------------------------------------- A5, A6, E2, E3, J4
def rollup(df: DataFrame, by: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """Mean, sample std and count of ``value`` per group in one aggregate."""
    by = _list(by)
    return df.groupBy(*by).agg(F.avg(value).alias(f"{prefix}mean"),
                               F.stddev_samp(value).alias(f"{prefix}std"),
                               F.count(value).alias(f"{prefix}n"))


def summary_join(means: DataFrame, stds: DataFrame, on: Sequence[str],
                 suffixes: tuple[str, str] = ("_mean", "_std")) -> DataFrame:
    """J4 as the reference writes it: two grouped tables joined on keys with
    suffixes.  ``rollup`` gives the same in one pass and is preferred."""
    on = _list(on)
    m = means.select(*on, *[F.col(c).alias(c + suffixes[0]) for c in means.columns if c not in on])
    s = stds.select(*on, *[F.col(c).alias(c + suffixes[1]) for c in stds.columns if c not in on])
    return m.join(s, on, "inner")


# ---------------------------------------------------------------- J5
def pair_mean_std(df: DataFrame, key: str = "key", model: str = "model", value: str = "value") -> DataFrame:
    """Rows keyed like '100mse' and '100std' (same number, same model) become
    one row (n, model, mean, std).  A mean without a std partner is kept with
    a null std."""
    num = F.regexp_extract(F.col(key), r"^([0-9]+)", 1)
    kind = F.regexp_replace(F.col(key), r"^[0-9]+", "")
    d = df.select(num.alias("n_key"), kind.alias("_kind"), F.col(model).alias("model"), F.col(value).alias("_v"))
    means = d.filter(F.col("_kind") == "mse").select("n_key", "model", F.col("_v").alias("mean"))
    stds = d.filter(F.col("_kind") == "std").select("n_key", "model", F.col("_v").alias("std"))
    return means.join(stds, ["n_key", "model"], "left")


# ---------------------------------------------------------------- E4
def bar_table(pairs: DataFrame, labels: dict[str, str], order: Sequence[str],
              factors: DataFrame | None = None) -> DataFrame:
    """Plot-ready table: mapped category label, ordinal model position, value,
    error (std times a per-model factor, default 1), upper and lower bars.
    Models outside ``order`` are dropped (the chart's category list)."""
    from assay_spark.operators.select import map_labels, ordered_categories

    d = map_labels(pairs, "model", labels, out="label")
    d = ordered_categories(d, "model", list(order), pos="model_pos")
    if factors is not None:
        d = d.join(F.broadcast(factors.select("model", F.col("factor").cast("double"))), "model", "left")
    else:
        d = d.withColumn("factor", F.lit(None).cast("double"))
    err = F.col("std") * F.coalesce(F.col("factor"), F.lit(1.0))
    return (d.withColumn("err", err)
             .withColumn("upper", F.col("mean") + F.col("err"))
             .withColumn("lower", F.col("mean") - F.col("err"))
             .drop("factor"))


# ---------------------------------------------------------------- T1, A17
def leaderboard(results: DataFrame, n: int = 10, metric: str = "mse", tiebreak: Sequence[str] = ("algorithm",),
                by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` best rows (lowest metric) overall, or per group with ``by``.
    Global form is a top-n (TakeOrderedAndProject: each task keeps n rows);
    the per-group form is a window over the results table, whose size is
    cells x algorithms."""
    by = _list(by)
    order = [F.col(metric).asc_nulls_last()] + [F.col(t) for t in _list(tiebreak)]
    if not by:
        return results.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return results.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)


def best_model(results: DataFrame, by: Sequence[str], metric: str = "mse", name: str = "algorithm") -> DataFrame:
    """Per group, the algorithm with the lowest metric and that metric."""
    by = _list(by)
    return results.groupBy(*by).agg(
        F.min_by(F.col(name), F.struct(F.col(metric), F.col(name))).alias(f"best_{name}"),
        F.min(metric).alias(f"best_{metric}"))


# ---------------------------------------------------------------- E1
def shot_curve(results: DataFrame, shots: str = "numsamp", metric: str = "mse", by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample std of the metric per shot count, with a numeric x
    (log of the count; a non-numeric label such as 'Infinite' is placed at
    max + 0.5)."""
    from assay_spark.operators.select import log_axis

    by = _list(by)
    r = results.groupBy(*by, F.col(shots).cast("string").alias("shots")).agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("n"))
    return log_axis(r, "shots", out="x")


# ---------------------------------------------------------------- E5
def fit_line(pred: DataFrame, by: Sequence[str] = (), y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Least-squares line of predicted on actual, with its R², per group."""
    by = _list(by)
    aggs = [F.regr_slope(F.col(y_hat), F.col(y)).alias("slope"),
            F.regr_intercept(F.col(y_hat), F.col(y)).alias("intercept"),
            F.regr_r2(F.col(y_hat), F.col(y)).alias("r2"),
            F.regr_count(F.col(y_hat), F.col(y)).alias("n")]
    return pred.groupBy(*by).agg(*aggs) if by else pred.agg(*aggs)


# ---------------------------------------------------------------- A14
def distinct_labels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*_list(cols)).distinct()
