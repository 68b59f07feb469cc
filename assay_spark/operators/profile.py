"""Profiles: describe, null report, adjusted moments, exact quantiles,
histogram, box statistics, correlation, shape (A1-A4, A9-A12, A15, A16).

Exact quantiles without one task holding a whole group: a sketch bounds
where each wanted rank can be, rows below that value interval are only
counted (partial aggregation) and rows inside it travel as (value, count)
pairs, so heavy duplicates collapse.  The result equals linear-interpolation
``quantile_cont``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay_spark import constants as C
from assay_spark.functions.moments import kurt_adj, skew_adj
from assay_spark.operators.sampling import _attach, _attach_stats, _list


# ---------------------------------------------------------------- A4
QUANTILE_ACCURACY = 10000


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = (),
                    accuracy: int = QUANTILE_ACCURACY, prefix: str = "q", extra_aggs=None) -> DataFrame:
    """Per group: one column per q (named ``{prefix}{index}``) holding the
    exact linear-interpolated quantile (``quantile_cont``), plus ``n``.

    Pass 1 is one aggregate: n, any ``extra_aggs(v)`` and an approximate
    sketch read at q -/+ 2/accuracy.  Spark bounds the sketch's rank error by
    n/accuracy, so the exact q-th value lies inside that value interval.
    Pass 2 maps each row, per wanted q, to "below the interval" (counted,
    collapsed map-side) or its value if inside (kept as (value, count)); rows
    above are dropped.  The exact rank is then found among ~4n/accuracy
    candidate values per group (plus the max below / min above, since rank
    conventions can put a wanted rank one step outside).  No task ever holds
    a whole group.
    """
    by = _list(by)
    qs = [float(q) for q in qs]
    eps = 2.0 / accuracy
    d = df.select(*by, F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    probs = [p for q in qs for p in (max(0.0, q - eps), min(1.0, q + eps))]
    more = list(extra_aggs(F.col("_v"))) if extra_aggs else []
    head = d.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"),
                              F.percentile_approx("_v", probs, accuracy).alias("_iv"), *more)
    more_names = [c for c in head.columns if c not in by + ["_n", "_iv"]]
    iv = head.select(*by, "_n", *[F.col("_iv")[2 * i].alias(f"_lo{i}") for i in range(len(qs))],
                     *[F.col("_iv")[2 * i + 1].alias(f"_hi{i}") for i in range(len(qs))])
    rows = _attach_stats(d, iv.drop("_n"), by)
    # per row and wanted q: kind 0 below the interval, 1 inside, 2 above
    per_q = F.explode(F.array(*[
        F.struct(F.lit(i).alias("qi"),
                 F.when(F.col("_v") < F.col(f"_lo{i}"), 0).when(F.col("_v") <= F.col(f"_hi{i}"), 1)
                  .otherwise(2).alias("kind"), F.col("_v").alias("v"))
        for i in range(len(qs))]))
    m = rows.select(*by, per_q.alias("_m")).select(*by, "_m.qi", "_m.kind", "_m.v")
    # one aggregate, collapsed map-side: a single row for "below" and "above"
    # (count, max below, min above), one row per distinct value inside
    vkey = F.when(F.col("kind") == 1, F.col("v"))
    agg = m.groupBy(*by, "qi", "kind", vkey.alias("vk")).agg(
        F.count(F.lit(1)).alias("_c"), F.max("v").alias("_mx"), F.min("v").alias("_mn"))
    edge = agg.groupBy(*by, "qi").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("_c")).otherwise(0)).alias("_below"),
        F.max(F.when(F.col("kind") == 0, F.col("_mx"))).alias("_max_below"),
        F.min(F.when(F.col("kind") == 2, F.col("_mn"))).alias("_min_above"),
        F.sum(F.when(F.col("kind") == 1, F.col("_c")).otherwise(0)).alias("_inside"))
    cand = agg.filter(F.col("kind") == 1).select(*by, "qi", F.col("vk").alias("v"), "_c")
    wv = Window.partitionBy(*by, "qi").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cand = cand.withColumn("_cum", F.sum("_c").over(wv)).withColumn("_prev", F.col("_cum") - F.col("_c"))
    # wanted 1-based ranks: floor and ceil of 1 + (n - 1) q
    tq = head.select(*by, "_n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("qi"), F.lit(q).alias("q"), F.lit(lohi).alias("lohi"))
        for i, q in enumerate(qs) for lohi in (0, 1)])).alias("_t"))
    pos = (F.col("_n") - 1) * F.col("_t.q")
    tq = tq.select(*by, F.col("_t.qi").alias("qi"), F.col("_t.lohi").alias("lohi"), (pos - F.floor(pos)).alias("_frac"),
                   (F.when(F.col("_t.lohi") == 0, F.floor(pos)).otherwise(F.ceil(pos)) + 1).cast("long").alias("_r"))
    tq = _attach(tq, edge, by + ["qi"], "left").withColumn("_rin", F.col("_r") - F.coalesce(F.col("_below"), F.lit(0)))
    hit = (_attach(tq, cand, by + ["qi"])
             .filter((F.col("_prev") < F.col("_rin")) & (F.col("_rin") <= F.col("_cum")))
             .select(*by, "qi", "lohi", F.col("v").alias("_hv")))
    # the sketch can place a wanted rank at most one rank outside its interval
    # (rank conventions differ by one); those ranks are the max below / min above
    val = (F.when(F.col("_rin") == 0, F.col("_max_below"))
            .when(F.col("_rin") == F.coalesce(F.col("_inside"), F.lit(0)) + 1, F.col("_min_above"))
            .otherwise(F.col("_hv")))
    tv = _attach(tq, hit, by + ["qi", "lohi"], "left").withColumn("_tv", val)
    piv = tv.groupBy(*by, "qi").agg(
        F.max(F.when(F.col("lohi") == 0, F.col("_tv"))).alias("_lo"),
        F.max(F.when(F.col("lohi") == 1, F.col("_tv"))).alias("_hi"),
        F.max("_frac").alias("_frac"))
    qv = F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))
    # the bound above makes a miss impossible; fail rather than guess
    qv = F.when(F.col("_lo").isNotNull() & F.col("_hi").isNotNull(), qv).otherwise(
        F.raise_error(F.lit("exact quantile outside the sketch interval")).cast("double"))
    piv = piv.withColumn("_qv", qv)
    wide = piv.groupBy(*by).agg(*[F.max(F.when(F.col("qi") == i, F.col("_qv"))).alias(f"{prefix}{i}")
                                  for i in range(len(qs))])
    return _attach(head.select(*by, F.col("_n").alias("n"), *more_names), wide, by)


def quantile(df: DataFrame, col: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    return exact_quantiles(df, col, [q], by).withColumnRenamed("q0", "quantile")


# ---------------------------------------------------------------- A1
def profile(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Describe per column (long form): count, mean, sample std, min,
    quartiles, max.  Columns are unpivoted so one aggregate covers all."""
    by = _list(by)
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("_e"))
    long = long.select(*by, "_e.column", "_e.value")
    g = by + ["column"]
    basic = lambda v: [F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                       F.min(v).alias("min"), F.max(v).alias("max")]
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], g, extra_aggs=basic)
    return q.select(*g, F.col("n").alias("count"), "mean", "std", "min", "max",
                    F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))


# ---------------------------------------------------------------- A2
def null_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: non-null count, null count and Spark type name."""
    cols = list(cols) if cols else df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    agg = df.agg(*[F.count(F.col(c)).alias(f"nn_{i}") for i, c in enumerate(cols)],
                 *[F.count_if(F.col(c).isNull()).alias(f"nu_{i}") for i, c in enumerate(cols)])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"nn_{i}").alias("non_null"), F.col(f"nu_{i}").alias("nulls"),
                 F.lit(types[c]).alias("dtype")) for i, c in enumerate(cols)])).alias("_r")).select("_r.*")


# ---------------------------------------------------------------- A3
def moments(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    by = _list(by)
    aggs = [F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std_pop"),
            F.stddev_samp(col).alias("std_samp"), skew_adj(col).alias("skew_adj"), kurt_adj(col).alias("kurt_adj")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


# ---------------------------------------------------------------- A10
def histogram(df: DataFrame, col: str, bins: int = C.HISTOGRAM_BINS, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed) with empty bins
    kept: columns bin (0-based), lo, hi, count."""
    by = _list(by)
    mm = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")) if by else \
        df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    mm = mm.withColumn("_w", (F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))
    d = _attach_stats(df.filter(F.col(col).isNotNull()), mm, by)
    b = F.when(F.col("_w") == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1))).cast("int")
    counts = d.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = mm.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    grid = grid.select(*by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lo"),
                       (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("hi"))
    return _attach(grid, counts, by + ["bin"], "left").withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("long"))


# ---------------------------------------------------------------- A11
def box_stats(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at the most extreme values within 1.5 IQR, and the
    number of points outside them, per group."""
    by = _list(by)
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75], by).select(
        *by, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = q.withColumn("_iqr", F.col("q3") - F.col("q1"))
    q = q.withColumn("_lf", F.col("q1") - 1.5 * F.col("_iqr")).withColumn("_uf", F.col("q3") + 1.5 * F.col("_iqr"))
    d = _attach_stats(df.select(*by, col), q.select(*by, "_lf", "_uf"), by)
    inside = (F.col(col) >= F.col("_lf")) & (F.col(col) <= F.col("_uf"))
    w = d.groupBy(*by).agg(F.min(F.when(inside, F.col(col))).alias("whisker_lo"),
                           F.max(F.when(inside, F.col(col))).alias("whisker_hi"),
                           F.count_if(~inside).alias("outliers"))
    return _attach(q.drop("_iqr", "_lf", "_uf"), w, by)


# ---------------------------------------------------------------- A9
def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair (i <= j) in long form, from
    one aggregate with len(cols)² / 2 expressions."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    agg = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}")
                   for k, (a, b) in enumerate(pairs)])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"c{k}").alias("corr"))
        for k, (a, b) in enumerate(pairs)])).alias("_r")).select("_r.*")


# dimensions of a tile's side, and the tiles a task holds before handing them on
TILE = 128
HELD_TILES = 1024


def gram_tiles(df: DataFrame, vec: str) -> DataFrame:
    """X'X of a vector column in tiles: (bi, bj, w, v) with bi <= bj, v the
    row-major product of dimension blocks bi and bj, w the latter's width.

    Each task folds its rows into tiles and hands them on when it holds
    HELD_TILES of them; Spark adds them up tile by tile, so neither a task
    nor the driver needs the whole matrix.
    """
    import numpy as np
    import pandas as pd
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    cols = ["bi", "bj", "w", "v"]
    side, most = TILE, HELD_TILES

    def tiles(batches):
        held: dict = {}

        def out():
            rows = [(i, j, t.shape[1], t.ravel()) for (i, j), t in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=cols)

        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["_x"].to_numpy()).astype(float)
            edges = range(0, x.shape[1], side)
            for i, a in enumerate(edges):
                for j, b in list(enumerate(edges))[i:]:
                    t = x[:, a:a + side].T @ x[:, b:b + side]
                    held[i, j] = held[i, j] + t if (i, j) in held else t
                    if len(held) >= most:
                        yield out()
        if held:
            yield out()

    part = (df.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("_x"))
              .mapInPandas(tiles, "bi int, bj int, w int, v array<double>"))
    return (part.groupBy("bi", "bj", "w").agg(Summarizer.sum(array_to_vector("v")).alias("_s"))
                .select("bi", "bj", "w", vector_to_array("_s").alias("v")))


def corr_matrix_vec(df: DataFrame, vec: str) -> DataFrame:
    """Correlation between the dimensions of a vector column, long (i <= j):
    Gram tiles of the centred rows, each scaled by the diagonals of its two
    blocks.  Null where a dimension is constant; null vectors do not count."""
    from assay_spark.operators.features import vector_stats

    d = df.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("_x"))
    d = _attach(d, vector_stats(d, "_x").select("_mu"), [])
    t = gram_tiles(d.select(F.zip_with("_x", "_mu", lambda x, m: x - m).alias("_x")), "_x")
    own = t.filter("bi = bj").select("bi", F.transform(
        F.sequence(F.lit(0), F.col("w") - 1), lambda k: F.element_at("v", (k * F.col("w") + k + 1).cast("int"))).alias("_ss"))
    t = t.join(own.withColumnRenamed("_ss", "_si"), "bi").join(own.select(F.col("bi").alias("bj"), F.col("_ss").alias("_sj")), "bj")
    e = t.select("bi", "bj", "w", "_si", "_sj", F.posexplode("v").alias("_k", "_c"))
    e = e.withColumns({"_r": F.expr("_k div w").cast("int"), "_q": F.expr("_k % w")})
    e = e.select((F.col("bi") * TILE + F.col("_r")).alias("i"), (F.col("bj") * TILE + F.col("_q")).alias("j"), "_c",
                 F.sqrt(F.element_at("_si", F.col("_r") + 1)).alias("_a"), F.sqrt(F.element_at("_sj", F.col("_q") + 1)).alias("_b"))
    return e.filter("i <= j").select("i", "j", F.try_divide(F.col("_c"), F.col("_a") * F.col("_b")).alias("corr"))


# ---------------------------------------------------------------- A13
def mean_abs(df_long: DataFrame, by: str = "col_name", value: str = "value") -> DataFrame:
    return df_long.groupBy(by).agg(F.avg(F.abs(value)).alias("mean_abs"))


# ---------------------------------------------------------------- A16
def shape_report(df: DataFrame, by: Sequence[str] = (), vec: str | None = None) -> DataFrame:
    by = _list(by)
    aggs = [F.count(F.lit(1)).alias("rows")]
    if vec:
        aggs += [F.min(F.size(vec)).alias("min_len"), F.max(F.size(vec)).alias("max_len")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
