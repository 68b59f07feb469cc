"""Projections, filters and predicates.

Plain column expressions, so Catalyst pushes filters into the Parquet scan
and prunes unread columns.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay_spark import constants as C
from assay_spark.functions import arrays as A
from assay_spark.operators.sampling import _attach, _attach_stats, _list


# ---------------------------------------------------------------- P1, P2, P3
def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*_list(cols))


def keep(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep an ordered column list (missing names fail at analysis)."""
    return df.select(*_list(cols))


def keep_long(df_long: DataFrame, keep_list: DataFrame, name: str = "col_name", rank: str = "rank") -> DataFrame:
    """Long form of P2: (row, col_name, value) restricted to, and ordered by,
    a keep list (rank, col_name).  The keep list is bounded by the feature
    count and broadcast."""
    return df_long.join(F.broadcast(keep_list.select(rank, name)), name, "inner")


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])


# ---------------------------------------------------------------- P4, P5
def null_columns(df: DataFrame) -> list[str]:
    """Names of columns holding any null: one aggregate pass, one row back."""
    if not df.columns:
        return []
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] > 0]


def drop_null_columns(df: DataFrame) -> DataFrame:
    return df.drop(*null_columns(df))


def drop_all_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="all", subset=list(subset) if subset else None)


# ---------------------------------------------------------------- P6, P8
def cap_filter(df: DataFrame, col: str, t: float) -> DataFrame:
    return df.filter(F.col(col) <= F.lit(t))


def where_all(df: DataFrame, **equals) -> DataFrame:
    cond = F.lit(True)
    for k, v in equals.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)


# ---------------------------------------------------------------- P7, A15
def zscore_flag(df: DataFrame, col: str, t: float = C.ZSCORE_THRESHOLD, by: Sequence[str] = (), out: str = "outlier",
                drop: bool = False) -> DataFrame:
    """|x - mean| / population std > t.  Statistics are a one-row-per-group
    aggregate joined back.  ``drop=True`` removes flagged rows instead."""
    by = _list(by)
    aggs = [F.avg(col).alias("_mu"), F.stddev_pop(col).alias("_sd")]
    st = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    d = _attach_stats(df, st, by)
    z = F.abs((F.col(col) - F.col("_mu")) / F.col("_sd"))
    d = d.withColumn("zscore", z).withColumn(out, F.coalesce(F.col("zscore") > F.lit(float(t)), F.lit(False)))
    d = d.drop("_mu", "_sd")
    return d.filter(~F.col(out)) if drop else d


def outlier_report(flagged: DataFrame, flag: str = "outlier", by: Sequence[str] = ()) -> DataFrame:
    by = _list(by)
    aggs = [F.count_if(F.col(flag)).alias("outliers"), F.count(F.lit(1)).alias("n")]
    r = flagged.groupBy(*by).agg(*aggs) if by else flagged.agg(*aggs)
    return r.withColumn("share", F.col("outliers") / F.col("n"))


# ---------------------------------------------------------------- P9
def align_columns(df: DataFrame, cols: Sequence[str], fill=0) -> DataFrame:
    """Select ``cols`` in order; a missing column becomes the constant
    ``fill``, extra columns are dropped."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[F.coalesce(F.col(c), F.lit(fill).cast(types[c])).alias(c) if c in types
                       else F.lit(fill).alias(c) for c in cols])


def align_long(df_long: DataFrame, ids: DataFrame, keep_list: DataFrame, id_col: str = "row_id",
               name: str = "col_name", value: str = "value", fill: float = 0.0) -> DataFrame:
    """Long-form P9: every (row, listed column) pair, value or ``fill``.
    Each id is expanded over the packed keep list (bounded by the feature
    count), then left-joined with the values on (id, name)."""
    names = keep_list.agg(F.collect_list(name).alias("_names"))  # bounded by the feature count
    grid = _attach(ids.select(id_col), names, []).select(id_col, F.explode("_names").alias(name))
    return (grid.join(df_long.select(id_col, name, value), [id_col, name], "left")
                .withColumn(value, F.coalesce(F.col(value), F.lit(fill))))


# ---------------------------------------------------------------- P10
def tag(df: DataFrame, **literals) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in literals.items()})


# ---------------------------------------------------------------- P11
def map_labels(df: DataFrame, col: str, mapping: dict, out: str | None = None) -> DataFrame:
    """Code -> label through a literal map; unmapped codes give null."""
    out = out or col
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out, m[F.col(col)])


# ---------------------------------------------------------------- P12, T4
def ordered_categories(df: DataFrame, col: str, order: Sequence, pos: str = "pos") -> DataFrame:
    """Keep rows whose ``col`` is in ``order`` and number them by that order
    (1-based).  A literal array lookup: no join, no shuffle."""
    arr = F.array(*[F.lit(v) for v in order])
    d = df.withColumn(pos, F.array_position(arr, F.col(col)).cast("int"))
    return d.filter(F.col(pos) > 0)


# ---------------------------------------------------------------- P13
def topcode(df: DataFrame, col: str, upper_q: float = C.TOPCODE_QUANTILE, floor: float | None = C.TOPCODE_FLOOR,
            by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Cap at the exact ``upper_q`` quantile (linear interpolation, computed
    without gathering a group into one task) and floor."""
    by = _list(by)
    out = out or col
    from assay_spark.operators.profile import exact_quantiles

    st = exact_quantiles(df, col, [upper_q], by).select(*by, F.col("q0").alias("_q"))
    d = _attach_stats(df, st, by)
    v = F.least(F.col(col), F.col("_q"))
    if floor is not None:
        v = F.greatest(F.lit(float(floor)), v)
    return d.withColumn(out, v).drop("_q")


# ---------------------------------------------------------------- P14, W2
def log_axis(df: DataFrame, col: str, out: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """Lenient numeric parse and log: ln(value) where ``col`` parses as a
    positive number, else (max ln over the group) + 0.5."""
    by = _list(by)
    num = F.col(col).try_cast("double")
    d = df.withColumn("_ln", F.when(num > 0, F.log(num)))
    st = d.groupBy(*by).agg(F.max("_ln").alias("_mx")) if by else d.agg(F.max("_ln").alias("_mx"))
    d = _attach(d, st, by)
    return d.withColumn(out, F.coalesce(F.col("_ln"), F.col("_mx") + F.lit(0.5))).drop("_ln", "_mx")


# ---------------------------------------------------------------- P15
def any_nan(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    by = _list(by)
    e = F.bool_or(A.any_nan(vec)).alias("any_nan")
    return df.groupBy(*by).agg(e) if by else df.agg(e)


# ---------------------------------------------------------------- P16
def cast_cols(df: DataFrame, cols: Sequence[str], to: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(to) for c in cols})
