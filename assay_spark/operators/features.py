"""Feature operators on ``array<double>`` vectors.

Fitted statistics (means, spreads, max-abs) are aggregates with one row per
group -- one row in total without group keys -- joined back onto the rows;
that join side is bounded by the number of groups, not by the data.
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay_spark import constants as C
from assay_spark.functions import arrays as A
from assay_spark.functions.keys import KEY_BITS, draw_ints, generators
from assay_spark.operators.sampling import _attach, _attach_stats, _list

DRAWS = 1 << 15  # counted draws that are hashed at once


def _fit_rows(df: DataFrame, fit_on: Column | None) -> DataFrame:
    return df if fit_on is None else df.filter(fit_on)


def vector_stats(df: DataFrame, vec: str, by: Sequence[str] = (), fit_on: Column | None = None) -> DataFrame:
    """Per group: element-wise mean and population std of ``vec``, and n.

    One typed aggregate over an ML vector (partial + merge), no explode of the
    vector into d rows.
    """
    by = _list(by)
    src = _fit_rows(df, fit_on).select(*by, array_to_vector(F.col(vec)).alias("_v"))
    summ = Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("_s")
    # a constant key: over no rows a summary without one fails, this gives no row
    st = src.groupBy(*(by or [F.lit(0).alias("_all")])).agg(summ)
    n = F.col("_s.count").cast("double")
    return st.select(
        *by,
        vector_to_array(F.col("_s.mean")).alias("_mu"),
        F.transform(vector_to_array(F.col("_s.variance")),
                    lambda v: F.sqrt(F.greatest(v * (n - 1) / n, F.lit(0.0)))).alias("_sd"),
        F.col("_s.count").alias("_n"),
    )


# ---------------------------------------------------------------- F1
def standardize(df: DataFrame, vec: str, by: Sequence[str] = (), fit_on: Column | None = None,
                out: str | None = None) -> DataFrame:
    """(x - mean) / population std per dimension, fitted on ``fit_on`` rows
    (all rows if None) of each group; a constant dimension maps to 0."""
    by = _list(by)
    out = out or vec
    st = vector_stats(df, vec, by, fit_on).drop("_n")
    d = _attach_stats(df, st, by)
    z = F.zip_with(F.zip_with(F.col(vec), F.col("_mu"), lambda x, m: x - m), F.col("_sd"),
                   lambda c, s: F.when(s == 0, F.lit(0.0)).otherwise(c / s))
    return d.withColumn(out, z).drop("_mu", "_sd")


def standardize_cols(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                     fit_on: Column | None = None, suffix: str = "_z") -> DataFrame:
    """Scalar-column form of F1 (one aggregate with 2 x len(cols) expressions)."""
    by = _list(by)
    src = _fit_rows(df, fit_on)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}")]
    st = src.groupBy(*by).agg(*aggs) if by else src.agg(*aggs)
    d = _attach_stats(df, st, by)
    for c in cols:
        d = d.withColumn(c + suffix, F.when(F.col(f"_sd_{c}") == 0, F.lit(0.0))
                         .otherwise((F.col(c) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}")))
    return d.drop(*[f"_mu_{c}" for c in cols], *[f"_sd_{c}" for c in cols])


# ---------------------------------------------------------------- F2
def impute_mean(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                fit_on: Column | None = None) -> DataFrame:
    """Replace nulls by the column mean of the ``fit_on`` rows (train)."""
    by = _list(by)
    src = _fit_rows(df, fit_on)
    aggs = [F.avg(c).alias(f"_fill_{c}") for c in cols]
    st = src.groupBy(*by).agg(*aggs) if by else src.agg(*aggs)
    d = _attach_stats(df, st, by)
    for c in cols:
        d = d.withColumn(c, F.coalesce(F.col(c), F.col(f"_fill_{c}")))
    return d.drop(*[f"_fill_{c}" for c in cols])


def impute_mean_vec(df: DataFrame, vec: str, by: Sequence[str] = (), fit_on: Column | None = None) -> DataFrame:
    """Vector form: null entries become that dimension's mean over the
    non-nulls of the ``fit_on`` rows; a dimension without any, and groups
    without fit rows, keep 0.  The means are read (one table of groups x
    dimensions) only if some vector holds a null."""
    by = _list(by)
    if not df.where(F.exists(F.col(vec), lambda x: x.isNull())).limit(1).count():
        return df
    src = _fit_rows(df, fit_on).select(*by, A.entries(vec, "_i", "_x"))
    st = src.groupBy(*by, "_i").agg(F.avg("_x").alias("_m"))
    st = st.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_ms"))
    d = _attach_stats(df, st, by, "left")
    return d.withColumn(vec, F.transform(F.col(vec), lambda x, i: F.coalesce(
        x, F.get(F.col("_ms"), i)["_m"], F.lit(0.0)))).drop("_ms")


# ---------------------------------------------------------------- A12 / F3
def max_abs(df: DataFrame, vec: str, by: Sequence[str] = (), fit_on: Column | None = None) -> DataFrame:
    """Per group, max over rows and entries of |x| (one number per group)."""
    by = _list(by)
    src = _fit_rows(df, fit_on)
    e = F.max(A.vmax_abs(vec)).alias("max_abs")
    return src.groupBy(*by).agg(e) if by else src.agg(e)


def scale_to(df: DataFrame, vec: str, bound: float = C.SCALE_BOUND, by: Sequence[str] = (),
             fit_on: Column | None = None, out: str | None = None) -> DataFrame:
    """Scale the whole block so its global max-abs (of the ``fit_on`` rows)
    becomes ``bound``: x / s * bound.  ``fit_on=None`` with a split column in
    ``by`` gives the per-split variant."""
    by = _list(by)
    out = out or vec
    s = max_abs(df, vec, by, fit_on).withColumnRenamed("max_abs", "_s")
    d = _attach_stats(df, s, by)
    f = F.when(F.col("_s") == 0, F.lit(0.0)).otherwise(F.lit(float(bound)) / F.col("_s"))
    return d.withColumn(out, F.transform(F.col(vec), lambda v: v * f)).drop("_s")


# ---------------------------------------------------------------- P2 (vector form)
def keep_dims(df: DataFrame, vec: str, keep: Sequence[int], out: str | None = None) -> DataFrame:
    """Keep the listed dimensions (0-based) of a vector column, in the order
    of the list; a dimension beyond a row's vector becomes null."""
    dims = [F.get(F.col(vec), F.lit(int(i))) for i in keep]
    return df.withColumn(out or vec, F.when(F.col(vec).isNotNull(), F.array(*dims)))


# ---------------------------------------------------------------- F5, F7, J10
def correlators(df: DataFrame, vec: str, order: int = 2, out: str = "corr") -> DataFrame:
    """Singles then all unordered pairs z_i z_j (i < j): n + n(n-1)/2 values."""
    return df.withColumn(out, A.correlators(F.col(vec), order))


def pairs_long(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """Long form of J10: (id, i, j, product) for i < j -- a self-join of one
    row's entries, done inside the row (no shuffle)."""
    e = df.select(id_col, A.entries(vec, "i", "zi"), F.col(vec).alias("_v"))
    e = e.select(id_col, "i", "zi", A.entries(F.slice("_v", F.col("i") + 2, 1 << 30), "_o", "zj"))
    return e.select(id_col, F.col("i").cast("int").alias("i"),
                    (F.col("i") + F.col("_o") + 1).cast("int").alias("j"),
                    (F.col("zi") * F.col("zj")).alias("product"))


# ---------------------------------------------------------------- F6
READOUT_MODES = ("s", "ss", "z", "zz", "szz")


def expand(df: DataFrame, vec: str, mode: str, components: int = 3, out: str = "readout") -> DataFrame:
    """Readout variants over a per-site state vector laid out site-major with
    ``components`` entries per site (x, y, z for a spin):

    - ``s``: all entries;  ``ss``: outer product of all entries;
    - ``z``: the last component of every site;  ``zz``: unordered z pairs;
    - ``szz``: all entries followed by the z pairs.
    """
    if mode not in READOUT_MODES:
        raise ValueError(f"mode must be one of {READOUT_MODES}")
    v = F.col(vec)
    d = df.withColumn("_zs", F.filter(v, lambda x, i: (i % components) == (components - 1)))
    zs = F.col("_zs")
    expr = {
        "s": v,
        "ss": A.outer_product(v),
        "z": zs,
        "zz": A.pair_products(zs),
        "szz": F.concat(v, A.pair_products(zs)),
    }[mode]
    return d.withColumn(out, expr).drop("_zs")


# ---------------------------------------------------------------- F9
def response_steps(t_start: float, t_end: float, step: float) -> list[float]:
    n = int(math.floor((t_end - t_start) / step + 1e-9))
    return [t_start + step * (k + 1) for k in range(n)]


def response_features(df: DataFrame, vec: str, omega: float = C.DRIVE_OMEGA, t_end: float = C.QUANTUM_T_END,
                      step: float = C.QUANTUM_STEP, t_start: float = 0.0, order: int = 2,
                      layout: str = "interleaved", out: str = "embedding") -> DataFrame:
    """Time-sampled driven-response features.

    Each input x_i drives its own two-level system with Rabi frequency Ω and
    detuning x_i; its z expectation at time t is
    z(t) = 1 - 2 Ω²/(Ω² + x²) · sin²(√(Ω² + x²) t / 2).
    Sampled at the ``floor((t_end - t_start)/step)`` times after the start;
    per time step the readout is the singles and (order 2) the pair products,
    so 18 inputs give 171 values per step.  ``layout='interleaved'`` puts each
    step's singles and pairs together; ``'blocked'`` puts all singles first.
    """
    ts = response_steps(t_start, t_end, step)
    w2 = float(omega) ** 2
    v = F.col(vec)

    def z_at(t: float) -> Column:
        return F.transform(v, lambda x: F.lit(1.0) - F.lit(2.0 * w2) / (F.lit(w2) + x * x)
                           * F.pow(F.sin(F.sqrt(F.lit(w2) + x * x) * F.lit(t / 2.0)), 2))

    # Each step's z is its own column: the pair products read it 2 x n(n-1)/2
    # times, and Catalyst keeps a non-cheap projection it would otherwise have
    # to inline (and recompute) at every read.
    names = [f"_z{k}" for k in range(len(ts))]
    d = df.withColumns({n: z_at(t) for n, t in zip(names, ts)})
    zcol = [F.col(n) for n in names]
    if order == 1:
        res = F.flatten(F.array(*zcol))
    elif layout == "interleaved":
        res = F.flatten(F.array(*[F.concat(z, A.pair_products(z)) for z in zcol]))
    else:
        res = F.concat(F.flatten(F.array(*zcol)), F.flatten(F.array(*[A.pair_products(z) for z in zcol])))
    return d.withColumn(out, res).drop(*names)


# ---------------------------------------------------------------- F10
def add_shot_noise(df: DataFrame, id_col: str, vec: str, shots: Sequence[int], loops: int = 1,
                   seed: int = 42, out: str = "noisy", method: str = "counted") -> DataFrame:
    """Finite-shot estimate of each expectation e in [-1, 1]: the mean of n
    independent ±1 outcomes with P(+1) = (1 + e)/2, i.e. 2k/n - 1 with k
    binomial.  n = 0 keeps e.  One output row per (row, shots, loop).

    One method serves the whole call, whatever the shot counts.  ``counted``:
    k counts md5-uniforms below p, drawn in tables by numpy (reproducible in SQL;
    the work grows with n).  ``binomial``: a vectorised pandas UDF draws k
    from a binomial seeded by the whole 64-bit row id, shots and loop.
    """
    if method not in ("counted", "binomial"):
        raise ValueError("method must be 'counted' or 'binomial'")
    grid = F.array(*[F.struct(F.lit(int(s)).alias("shots"), F.lit(int(l)).alias("loop"))
                     for s in shots for l in range(1, loops + 1)])
    g = df.withColumn("_g", F.explode(grid)).select("*", "_g.shots", "_g.loop").drop("_g")
    if method == "binomial":
        return g.withColumn(out, _binomial_udf(seed)(F.col(id_col), F.col("shots"), F.col("loop"), F.col(vec)))

    # no draw is below the chance of a null entry, every one is below NaN
    chance = F.transform(F.col(vec).cast("array<double>"), lambda e: F.coalesce((F.lit(1.0) + e) / F.lit(2.0), F.lit(0.0)))
    key = F.concat_ws("|", F.col(id_col).cast("string"), F.col("shots"), F.col("loop"))
    res = F.when(F.col("shots") == 0, F.col(vec)).otherwise(_counted_udf(seed)(key, F.col("shots"), chance))
    return g.withColumn(out, res)


def _counts(keys, chances, n: int, seed: int):
    """Per key and entry, how many of its ``n`` draws are below the entry's chance."""
    import numpy as np

    k, width = np.zeros(chances.shape), chances.shape[1]
    limit = chances * float(2 ** KEY_BITS)

    def spans(lo, hi):  # numbers of equally many digits
        while lo < hi:
            end = min(hi, 10 ** len(str(lo)))
            yield lo, end
            lo = end

    for lo, hi in spans(0, width):
        for first, last in spans(1, n + 1):
            step = max(1, DRAWS // (hi - lo))
            for j in range(first, last, step):
                end = min(last, j + step)
                tails = [f"|{i}|{t}|{seed}".encode() for i in range(lo, hi) for t in range(j, end)]
                rows = max(1, DRAWS // len(tails))
                for at in range(0, len(keys), rows):
                    u = draw_ints(keys[at:at + rows], tails).astype(float).reshape(-1, hi - lo, end - j)
                    k[at:at + rows, lo:hi] += np.count_nonzero(~(u >= limit[at:at + rows, lo:hi, None]), axis=2)
    return k


def _counted_udf(seed: int):
    import numpy as np
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def noisy(keys, shots, chances):
        out = [None] * len(keys)
        texts = [k.encode() for k in keys]
        groups = {}
        for at, (t, n, p) in enumerate(zip(texts, shots, chances)):
            if n != 0 and p is not None:
                groups.setdefault((len(t), n, len(p)), []).append(at)
        for (_, n, _), rows in groups.items():
            p = np.stack([chances.iat[at] for at in rows]).astype(float)
            k = _counts([texts[at] for at in rows], p, max(int(n), 1), seed)
            for at, x in zip(rows, 2.0 * k / n - 1.0):
                out[at] = x
        return pd.Series(out, dtype=object)

    noisy.__annotations__ = {"keys": pd.Series, "shots": pd.Series, "chances": pd.Series, "return": pd.Series}
    return pandas_udf("array<double>")(noisy)


def _binomial_udf(seed: int):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.functions import arrow_udf

    seeds = [seed >> at & 0xFFFFFFFF for at in range(0, max(1, seed.bit_length()), 32)]

    def noisy(ids, shots, loop, vecs):
        ends = np.cumsum(pc.fill_null(pc.list_value_length(vecs), 0).to_numpy())
        starts, known = np.r_[0, ends[:-1]], vecs.is_valid()
        out = vecs.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).copy()  # nulls are NaN
        n, loop = (c.to_numpy().astype(np.int64) for c in (shots, loop))
        rows = np.flatnonzero((n != 0) & known.to_numpy(zero_copy_only=False))
        ids = ids.take(pa.array(rows))
        if ids.null_count:
            raise ValueError("draws need a row id")
        key, chance = ids.cast(pa.int64()).to_numpy().astype(np.uint64), np.clip((1.0 + out) / 2.0, 0.0, 1.0)
        made = generators([*seeds, key & np.uint64(0xFFFFFFFF), key >> np.uint64(32), n[rows], loop[rows]])
        for rng, m, lo, hi in zip(made, n[rows].tolist(), starts[rows].tolist(), ends[rows].tolist()):
            out[lo:hi] = 2.0 * rng.binomial(m, chance[lo:hi]) / m - 1.0
        offsets = pa.array(np.r_[0, ends], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(out, from_pandas=True), mask=pc.invert(known))

    noisy.__annotations__ = {"ids": pa.Array, "shots": pa.Array, "loop": pa.Array, "vecs": pa.Array, "return": pa.Array}
    return arrow_udf("array<double>")(noisy)


# ---------------------------------------------------------------- F4
def pca(df: DataFrame, vec: str, k: int, fit_on: Column | None = None, out: str = "pca") -> DataFrame:
    """Centred PCA to ``k`` dims, fitted on ``fit_on`` rows, applied to all.

    Centring uses the fit rows' means (Spark's PCA model does not centre);
    the covariance is a distributed Gram aggregate, only the d x d
    eigenproblem is local.  Component signs are arbitrary.
    """
    from pyspark.ml.feature import PCA

    st = vector_stats(df, vec, (), fit_on).select("_mu")
    d = _attach(df, st, [])
    d = d.withColumn("_c", array_to_vector(F.zip_with(F.col(vec), F.col("_mu"), lambda x, m: x - m)))
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(_fit_rows(d, fit_on))
    return model.transform(d).withColumn(out, vector_to_array("_p")).drop("_c", "_p", "_mu")


def pca_variance(df: DataFrame, vec: str, k: int, fit_on: Column | None = None) -> DataFrame:
    """Explained-variance ratio per component (non-increasing)."""
    from pyspark.ml.feature import PCA

    spark = df.sparkSession
    st = vector_stats(df, vec, (), fit_on).select("_mu")
    d = _attach(_fit_rows(df, fit_on), st, [])
    d = d.withColumn("_c", array_to_vector(F.zip_with(F.col(vec), F.col("_mu"), lambda x, m: x - m)))
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(d)
    ev = [float(x) for x in model.explainedVariance.toArray()]
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(ev)], "component int, explained double")


# ---------------------------------------------------------------- F8
def embed(df: DataFrame, vec: str, fn: Callable, out_dim: int, out: str = "embedding",
          keep: Sequence[str] | None = None) -> DataFrame:
    """Row-wise vector map through a user function, Arrow-batched.

    ``fn`` maps a 2-D numpy array (rows x in_dim) to (rows x out_dim); the
    same function serves train and test.  Output schema is declared, so the
    plan stays typed.
    """
    import numpy as np
    import pandas as pd

    keep = list(keep) if keep is not None else [c for c in df.columns if c != vec]
    src = df.select(*keep, vec)
    fields = [f.simpleString() for f in src.schema.fields if f.name in keep]
    schema = ", ".join(f.replace(":", " ", 1) for f in fields) + f", {out} array<double>"

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.vstack([np.asarray(v, dtype=float) for v in pdf[vec]])
            y = np.asarray(fn(x), dtype=float)
            if y.ndim != 2 or y.shape[1] != out_dim:
                raise ValueError(f"embedding function returned shape {y.shape}, expected (*, {out_dim})")
            res = pdf[keep].copy()
            res[out] = list(y)
            yield res

    return src.mapInPandas(run, schema)
