"""Models and evaluation.

Two paths:

- grouped (L9, one Spark job for every cell): least squares / ridge from
  per-cell Gram sums.  Each task folds its rows into one partial X'X per
  cell with a BLAS product; Spark adds the partials per cell, so a hot cell
  costs one p x p accumulator per task, never its rows.  Only the p x p
  solve runs per cell, one small row each.  kNN (J8) and random
  Fourier ridge (L8) reuse the same machinery.
- One training table at a time, each fit a distributed job: Spark ML estimators
  (boosted trees, tree, OLS, or the caller's own), and forests and bagged trees
  grown by ``ensembles``; inside a grid, ``forests`` grows the trees of all
  cells in one job.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay_spark import constants as C
from assay_spark.functions import arrays as A
from assay_spark.functions import packed as P
from assay_spark.operators import ensembles
from assay_spark.operators.sampling import _attach, _list
from assay_spark.session import materialize

# ---------------------------------------------------------------- L9
GRAM_CHUNK = 1 << 15  # values per emitted partial row (256 KB of doubles)
GRAM_BYTES = 256 << 20  # most bytes of partial sums a task holds


def gram(df: DataFrame, by: Sequence[str], vec: str = "x", y: str = "y", intercept: bool = True) -> DataFrame:
    """Per group: n, sum(y²), X'X (flattened, row-major) and X'y of the
    augmented vector [1, x] (or x).

    Each task folds its rows into one partial [n, y'y, X'X, X'y] per group
    with a BLAS product over Arrow batches -- no per-row p² arrays, so a
    1710-wide embedding costs one 1710² accumulator per task and group; a
    task that holds over GRAM_BYTES of them hands them on and begins anew.  The
    partial is emitted in chunks of ``GRAM_CHUNK`` values; Spark sums chunks
    per (group, chunk) and reassembles each group's p² values once.  No row,
    buffer or vector ever holds more than one chunk until the final
    per-group row the p x p solve needs.
    """
    import numpy as np
    import pandas as pd

    by = _list(by)
    key_fields = [f for f in df.schema.fields if f.name in by]
    d = df.select(*by, F.col(vec).alias("_x"), F.col(y).cast("double").alias("_y"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in key_fields] +
                       ["_j int", "_p int", "_v array<double>"])

    most = GRAM_BYTES

    def partials(batches):
        acc: dict = {}
        held = 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            groups = pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]
            for key, g in groups:
                key = key if isinstance(key, tuple) else (key,)
                x = np.stack(g["_x"].to_numpy()).astype(float)
                if intercept:
                    x = np.hstack([np.ones((x.shape[0], 1)), x])
                yv = g["_y"].to_numpy(dtype=float)
                part = (len(g), float(yv @ yv), x.T @ x, x.T @ yv)
                if key in acc:
                    a = acc[key]
                    acc[key] = (a[0] + part[0], a[1] + part[1], a[2] + part[2], a[3] + part[3])
                else:
                    acc[key] = part
                    held += part[2].nbytes
                if held > most:
                    yield from hand_on(acc)
                    held = 0
        yield from hand_on(acc)

    def hand_on(acc):
        while acc:
            key, (n, syy, xtx, xty) = acc.popitem()
            flat = np.concatenate([[float(n), syy], xtx.ravel(), xty])
            rows = [dict(zip(by, key), _j=j, _p=int(xty.shape[0]), _v=flat[o:o + GRAM_CHUNK].tolist())
                    for j, o in enumerate(range(0, flat.shape[0], GRAM_CHUNK))]
            yield pd.DataFrame(rows, columns=by + ["_j", "_p", "_v"])

    part = d.mapInPandas(partials, schema)
    summed = part.groupBy(*by, "_j", "_p").agg(Summarizer.sum(array_to_vector("_v")).alias("_s"))
    summed = summed.select(*by, "_j", "_p", vector_to_array("_s").alias("_v"))
    whole = summed.groupBy(*by, "_p").agg(F.sort_array(F.collect_list(F.struct("_j", "_v"))).alias("_c"))
    flat = F.flatten(F.transform("_c", lambda c: c["_v"]))
    w = whole.select(*by, "_p", flat.alias("_f"))
    pp = F.col("_p") * F.col("_p")
    return w.select(*by, F.col("_f")[0].cast("long").alias("n"), F.col("_f")[1].alias("syy"),
                    F.slice("_f", 3, pp).alias("xtx"), F.slice("_f", pp + 3, F.col("_p")).alias("xty"))


def solve_gram(g: DataFrame, by: Sequence[str], reg: float = 0.0, intercept: bool = True) -> DataFrame:
    """Solve (X'X + reg·I') b = X'y per group (I' leaves the intercept
    unpenalised).  One row per group in, one row out: (by, intercept, coef)."""
    import numpy as np
    import pandas as pd

    by = _list(by)
    key = g.select(*by).schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key.fields)
    schema = (schema + ", " if schema else "") + "intercept double, coef array<double>, n long"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            xty = np.asarray(r["xty"], dtype=float)
            p = xty.shape[0]
            xtx = np.asarray(r["xtx"], dtype=float).reshape(p, p)
            pen = np.eye(p) * float(reg)
            if intercept:
                pen[0, 0] = 0.0
            b = np.linalg.lstsq(xtx + pen, xty, rcond=None)[0]
            row = {k: r[k] for k in by}
            row.update(intercept=float(b[0]) if intercept else 0.0,
                       coef=[float(v) for v in (b[1:] if intercept else b)], n=int(r["n"]))
            out.append(row)
        cols = by + ["intercept", "coef", "n"]
        return pd.DataFrame(out, columns=cols)

    if by:
        return g.groupBy(*by).applyInPandas(solve, schema)
    return g.mapInPandas(lambda it: (solve(p) for p in it), schema)


def fit_grouped(df: DataFrame, by: Sequence[str], vec: str = "x", y: str = "y", reg: float = 0.0,
                intercept: bool = True) -> DataFrame:
    """One linear model per cell, all cells in one job."""
    return solve_gram(gram(df, by, vec, y, intercept), by, reg, intercept)


def predict_linear(df: DataFrame, coefs: DataFrame, by: Sequence[str], vec: str = "x", out: str = "y_hat") -> DataFrame:
    by = _list(by)
    # rows of a cell without a fitted model keep a null prediction
    d = _attach(df, coefs.select(*by, F.col("intercept").alias("_b0"), F.col("coef").alias("_b")), by, "left")
    return d.withColumn(out, F.col("_b0") + A.dot(vec, "_b")).drop("_b0", "_b")


# ---------------------------------------------------------------- L8
def fourier_features(df: DataFrame, vec: str, dim_in: int, n_features: int = 256, length: float = 1.0,
                     seed: int = 42, out: str = "rff") -> DataFrame:
    """Random Fourier features z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 1/l²),
    b ~ U(0, 2π): inner products approximate the RBF kernel of length l.
    W and b are a seeded parameter table of D rows (bounded by D, joined as
    one row)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, 1.0 / float(length), size=(n_features, dim_in))
    b = rng.uniform(0.0, 2 * math.pi, size=n_features)
    spark = df.sparkSession
    params = spark.createDataFrame([([w[i].tolist() for i in range(n_features)], b.tolist())],
                                   "_W array<array<double>>, _bb array<double>")
    d = _attach(df, params, [])
    s = math.sqrt(2.0 / n_features)
    z = F.zip_with(F.col("_W"), F.col("_bb"), lambda wr, bb: F.lit(s) * F.cos(A.dot(wr, F.col(vec)) + bb))
    return d.withColumn(out, z).drop("_W", "_bb")


# ---------------------------------------------------------------- L1-L6 (Spark ML)
def estimator(name: str, features: str = "_f", label: str = "_y", seed: int = 42, **kw):
    """Registry of Spark ML regressors by name (the reference's model list)."""
    from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                       RandomForestRegressor)

    common = dict(featuresCol=features, labelCol=label, predictionCol="_pred")
    if name == "forest":
        return RandomForestRegressor(numTrees=kw.get("numTrees", C.FOREST_TREES), maxDepth=kw.get("maxDepth", C.FOREST_DEPTH),
                                     seed=seed, **common)
    if name == "gbt":
        return GBTRegressor(maxIter=kw.get("maxIter", 100), maxDepth=kw.get("maxDepth", 3), seed=seed, **common)
    if name == "bagging":
        return RandomForestRegressor(numTrees=kw.get("numTrees", 10), featureSubsetStrategy="all",
                                     maxDepth=kw.get("maxDepth", 30), seed=seed, **common)
    if name == "tree":
        return DecisionTreeRegressor(maxDepth=kw.get("maxDepth", 30), seed=seed, **common)
    if name in ("ols", "ridge"):
        return LinearRegression(regParam=kw.get("regParam", 0.0 if name == "ols" else 1.0),
                                solver="normal" if name == "ols" else "l-bfgs", **common)
    raise ValueError(f"unknown model {name}")


ML_MODELS = ("forest", "gbt", "bagging", "tree", "ols", "ridge")
# concurrent per-cell fits submitted by the grid evaluation
ML_PARALLEL_FITS = 4


class FittedModel:
    """L1 pipeline: mean-impute the vector (means of the training rows) ->
    ML vector -> fitted regressor.  ``transform`` applies the same steps to
    any table with the vector column."""

    def __init__(self, model, fill: list[float], vec: str):
        self.model, self.fill, self.vec = model, fill, vec
        self.stages = [model]

    def _prep(self, df: DataFrame) -> DataFrame:
        fill = F.array(*[F.lit(float(v)) for v in self.fill])
        x = F.zip_with(F.col(self.vec), fill, lambda a, m: F.coalesce(a, m))
        return df.withColumn("_f", array_to_vector(x))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._prep(df))


def _made(model, seed: int, **kw):
    """A registered model by name, a given Spark ML estimator, or what a callable makes."""
    if isinstance(model, str):
        return estimator(model, seed=seed, **kw)
    made = model if hasattr(model, "fit") else model(**kw)
    return made.copy({made.featuresCol: "_f", made.labelCol: "_y", made.predictionCol: "_pred"})


def fit(train: DataFrame, name, vec: str = "x", y: str = "y", seed: int = 42, **kw) -> FittedModel:
    """L1: mean imputation fitted on train, then the regressor: a registered
    name, an estimator or a callable that makes one.  Forests and bagged trees
    named so are grown by ``ensembles``, all else by Spark ML.  The
    fill vector has one value per feature (bounded by the width)."""
    means = (train.select(A.entries(vec, "_i", "_v")).groupBy("_i").agg(F.avg("_v").alias("_m"))
             .orderBy("_i").collect())
    fill = [float(r["_m"]) if r["_m"] is not None else 0.0 for r in means]
    fm = FittedModel(None, fill, vec)
    d = fm._prep(train).withColumn("_y", F.col(y).cast("double"))
    if isinstance(name, str) and name in ensembles.KINDS:
        fm.model = ensembles.fit_ensemble(d, name, seed, kw.get("numTrees"), kw.get("maxDepth"))
    else:
        fm.model = _made(name, seed, **kw).fit(d)
    fm.stages = [fm.model]
    return fm


def predict(model, df: DataFrame, keep: Sequence[str], out: str = "y_hat") -> DataFrame:
    p = model.transform(df)
    return p.select(*keep, F.col("_pred").alias(out))


# ---------------------------------------------------------------- G2
def fit_report(train: DataFrame, test: DataFrame, name: str, id_col: str = "row_id", vec: str = "x",
               y: str = "y", seed: int = 42, **kw) -> DataFrame:
    """Train and test scores (MSE, MAE, R²) of one model."""
    from assay_spark.operators.report import regression_metrics

    m = fit(train, name, vec, y, seed, **kw)
    parts = []
    for split, d in (("train", train), ("test", test)):
        p = predict(m, d, [id_col, F.col(y).cast("double").alias("y")])
        parts.append(regression_metrics(p).withColumn("split", F.lit(split)))
    return parts[0].unionByName(parts[1]).withColumn("algorithm", F.lit(name))


# ---------------------------------------------------------------- G1
GROUPED = ("ols", "ridge", "knn", "rbf_ridge", "mean")


def _evaluate_ml(cells: DataFrame, by: list, name, id_col: str, vec: str, y: str, split: str,
                 seed: int, **kw) -> list[DataFrame]:
    """Predictions of a Spark ML estimator per cell.  Trees of all cells that fit a
    group grow in one job; larger cells, and other estimators, take one
    distributed fit per cell key (the key list is the grid, collected --
    bounded by the grid, not the data)."""
    from concurrent.futures import ThreadPoolExecutor
    from functools import reduce as _reduce

    from assay_spark.operators import forests

    if isinstance(name, str) and name in forests.KINDS and not kw:
        parts = [forests.grouped_trees(cells, by, name, id_col, vec, y, split, seed)]
        keys = forests.too_large(cells, by, vec)
    else:
        parts, keys = [], [tuple(r) for r in cells.select(*by).distinct().collect()] if by else [()]

    def one(key):
        cond = _reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(by, key)], F.lit(True))
        cell = cells.filter(cond)
        model = fit(cell.filter(F.col(split) == "train"), name, vec, y, seed, **kw)
        return predict(model, cell.filter(F.col(split) == "test"), [*by, id_col, F.col(y).cast("double").alias("y")])

    # each fit is its own distributed job; submitting several at once lets
    # the scheduler interleave them instead of running small jobs one by one
    with ThreadPoolExecutor(max_workers=ML_PARALLEL_FITS) as pool:
        parts += list(pool.map(one, keys))
    return parts


class _Stored:
    """Cells written once, ``packed`` or as they are, and the reads of them: a
    split's rows, or those without vectors."""

    def __init__(self, cells: DataFrame, keys: list, vec: str, packed: bool):
        self.like, self.keys, self.vec, self.packed = cells.withColumn(vec, F.col(vec).cast("array<double>")), keys, vec, packed
        self.rest = [c for c in cells.columns if c not in keys and c != vec]
        self.df = materialize(P.pack(self.like, keys, vec, self.rest) if packed else cells)

    def rows(self, cond=None, vectors: bool = True) -> DataFrame:
        df = self.df if cond is None else self.df.filter(cond)
        if not self.packed:
            return df
        if vectors:
            return P.unpack(df, self.like, self.keys, self.vec, self.rest)
        return P.without_vectors(df, self.keys, self.rest)


def evaluate(cells: DataFrame, by: Sequence[str], algorithms: Sequence[str] | dict = GROUPED, id_col: str = "row_id",
             vec: str = "x", y: str = "y", split: str = "split", k: int = C.KNN_K, ridge: float = 1.0,
             rff_features: int = 128, rff_length: float = 1.0, seed: int = 42, source: str = "raw",
             score_on: str = "test", packed: bool = False) -> DataFrame:
    """G1: every cell x algorithm fitted on the cell's train rows and scored
    on its test rows, all in one job.  Output (RESULTS): cell keys, source,
    algorithm, mse, mae, r2, n.

    ``score_on="train_resplit"`` reproduces the other protocol of the
    reference: the train rows alone are split again (exact 80/20 per cell)
    and the models are scored on that inner split; the real test rows are
    not used.  The default scores the real test split.

    ``algorithms`` may be a dict: a name, and None for the registered model of
    that name, a Spark ML estimator, or a callable that makes one.

    ``packed`` stores the cells packed (``functions.packed``), which is less
    where their vectors hold few distinct values."""
    from assay_spark.operators.features import impute_mean_vec
    from assay_spark.operators.kernels import knn_regression
    from assay_spark.operators.report import regression_metrics
    from assay_spark.operators.sampling import split_exact

    by = _list(by)
    if score_on == "train_resplit":
        inner = cells.filter(F.col(split) == "train").drop(split)
        cells = split_exact(inner, id_col, 20, seed=seed + 2, by=by, out=split)
    elif score_on != "test":
        raise ValueError("score_on must be 'test' or 'train_resplit'")
    # every algorithm reads the same cells: materialise them once, eagerly --
    # the branches below run as parallel stages of one job and would each
    # recompute a cache that is not filled yet
    # L1: nulls become the mean of the cell's train rows, for every algorithm
    # (looked for in the written cells, so that they are computed once)
    stored = _Stored(cells, [*by, split], vec, packed)
    cells = stored.rows()
    whole = impute_mean_vec(cells, vec, by, F.col(split) == "train")
    if whole is not cells:
        stored = _Stored(whole, [*by, split], vec, packed)
        cells = stored.rows()
    own = {k: m for k, m in algorithms.items() if m is not None} if isinstance(algorithms, dict) else {}
    in_train, in_test = F.col(split) == "train", F.col(split) == "test"
    train, test = stored.rows(in_train), stored.rows(in_test)
    truth = stored.rows(in_test, vectors=False).select(*by, id_col, F.col(y).cast("double").alias("y"))
    outs = []
    linear = [a for a in algorithms if a in ("ols", "ridge") and a not in own]
    # one Gram table (cells x p², bounded by the grid and the width) serves
    # every linear fit; it is filled once because each fit reads it
    g = materialize(gram(train, by, vec, y)) if len(linear) > 1 else (gram(train, by, vec, y) if linear else None)
    for alg in algorithms:
        if alg in ("ols", "ridge") and alg not in own:
            co = solve_gram(g, by, reg=0.0 if alg == "ols" else ridge)
            # one row a cell of the grid: the test rows are not shuffled for it
            pred = predict_linear(test, F.broadcast(co) if by else co, by, vec).select(*by, id_col, F.col(y).cast("double").alias("y"), "y_hat")
        elif alg == "rbf_ridge":
            dim = cells.select(F.max(F.size(vec))).first()[0]
            tr = fourier_features(train, vec, dim, rff_features, rff_length, seed)
            te = fourier_features(test, vec, dim, rff_features, rff_length, seed)
            co = fit_grouped(tr, by, "rff", y, reg=ridge)
            pred = predict_linear(te, co, by, "rff").select(*by, id_col, F.col(y).cast("double").alias("y"), "y_hat")
        elif alg == "knn":
            pred = knn_regression(test, train, k, by, id_col, vec, y)
        elif alg in ML_MODELS or alg in own:
            from functools import reduce as _reduce

            parts = _evaluate_ml(cells, by, own.get(alg, alg), id_col, vec, y, split, seed)
            pred = _reduce(lambda a, b: a.unionByName(b), parts)
        elif alg == "mean":
            seen, mu = stored.rows(in_train, vectors=False), F.avg(F.col(y).cast("double")).alias("y_hat")
            mu = F.broadcast(seen.groupBy(*by).agg(mu)) if by else seen.agg(mu)
            pred = _attach(truth, mu, by, "left")
        else:
            raise ValueError(f"unknown grouped algorithm {alg}")
        outs.append(regression_metrics(pred, by).withColumn("algorithm", F.lit(alg)))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res.withColumn("source", F.lit(source))


# ---------------------------------------------------------------- E7
def evaluate_timed(cells: DataFrame, by: Sequence[str], algorithms: Sequence[str] = GROUPED, **kw) -> DataFrame:
    """G1 with E7: each algorithm's scores are one action, timed on the
    driver's wall clock and attached as ``fit_seconds``.  The scored rows
    (cells x algorithms, bounded by the grid) are what comes back."""
    import time

    by = _list(by)
    spark = cells.sparkSession
    cells = materialize(cells)
    rows, schema = [], None
    for alg in algorithms:
        t0 = time.perf_counter()  # Spark ML models fit while the plan is built
        df = evaluate(cells, by, [alg], **kw)
        schema = schema or df.schema
        got = df.collect()
        secs = time.perf_counter() - t0
        rows += [tuple(r) + (secs,) for r in got]
    from pyspark.sql.types import DoubleType, StructField, StructType
    return spark.createDataFrame(rows, StructType(schema.fields + [StructField("fit_seconds", DoubleType())]))
