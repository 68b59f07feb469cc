"""Operator 12: whitening components by shifted CholeskyQR over distributed Gram passes.

Vectors become integers, x = floor(scale * c) + shift, and the distinct ones are
the fit list: n rows with exact sums S per dimension.  Rows are centred exactly
(n x - S in integers, then divided) before anything is multiplied.

    Q := centred rows
    repeat:  G = Q'Q (one Spark pass of partial sums);  R' R' = G + s I (Cholesky,
             s the shift that keeps it positive definite while Q is ill-conditioned,
             0 later);  Q := Q R'^-1 (triangular solves in the next pass);  R := R' R
    until Q is orthonormal to working precision

The rows of Q are never written: a pass solves with each factor in turn.  Should
directions without variance keep Q from becoming orthonormal, the last Gram
matrix's root takes the place of the identity: A'A = R' G R always holds.  The
singular values and right vectors of (root of G) R are those of the centred
rows, so the components come from a small SVD on the driver, which holds a few
d x d matrices and nothing that grows with the rows.

Rows whose vector is null, empty, or holds null or non-finite entries are
dropped, so are those whose length is not the most frequent one (ties: the
longer) and those with an entry beyond +-``LARGEST``.  Rows that repeat are kept
each for itself, a null id stays null.  Components without variance (relative to
the first, at ``NO_VARIANCE`` of its standard deviation) are left out, so equal
rows or an empty table give no rows.  Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay_spark.llm.common import stage, unstage

SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0 ** 40
NO_VARIANCE, PASSES = 1e-9, 8
#: Q counts as orthonormal when its Gram matrix is this close to the identity.
ORTHONORMAL = 1e-11


def _entries(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """Integer vectors of an Arrow batch, one row each."""
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: longs where they fit, else Python's integers."""
    if x.size == 0 or max(int(np.abs(x).max()) * n, max(map(abs, sums))) < 2 ** 61:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(dev: np.ndarray) -> list[int]:
    """Exact sums of squares by row."""
    if dev.size == 0:
        return []
    if dev.dtype != object and dev.shape[1] * int(np.abs(dev).max()) ** 2 < 2 ** 62:
        return (dev * dev).sum(1).tolist()
    return (dev.astype(object) ** 2).sum(1).tolist()


@dataclass
class Whitening:
    """The fitted map.  ``factors`` are the triangular factors by pass."""

    d: int = 0
    n: int = 0
    sums: list[int] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # d x k, unit columns
    variances: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trace: float = 0.0
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dev = deviations(x, self.n, self.sums)
        return dev, dev.astype(np.float64) / self.n

    def orthogonalised(self, x: np.ndarray) -> np.ndarray:
        """Rows of Q: one triangular solve per factor."""
        q = self.centred(x)[1]
        for r in self.factors:
            q = np.linalg.solve(r.T, q.T).T
        return q

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x)[1] @ self.components / np.sqrt(self.variances)


def _sum_tables(fit: DataFrame, of) -> np.ndarray:
    """Sum of the matrices that ``of`` gives for each batch: one row of them by task, then by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = of(b)
                total = m if total is None else total + m
        for i in range(0 if total is None else len(total)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i]], pa.list_(pa.float64()))], ["i", "row"])

    cells = fit.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    rows = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # d * d numbers
    i, j, v = (rows[c].to_numpy() for c in ("i", "j", "v"))
    out = np.zeros((int(i.max()) + 1, int(j.max()) + 1))
    out[i, j] = v
    return out


def shifted_factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular Cholesky factor of the Gram matrix, shifted where asked or where it fails."""
    d = len(gram)
    unit = np.finfo(float).eps
    shift = 11 * unit * (n * d + d * (d + 1)) * float(np.linalg.norm(gram, 2)) if shifted else 0.0
    least = 11 * unit * d * float(np.linalg.norm(gram, 2))
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, least)


def svd_components(gram: np.ndarray, factors: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit components (columns) and variances of A, where A'A = R' G R and R is the product of the factors."""
    values, vectors = np.linalg.eigh(gram)
    r = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    for f in reversed(factors):
        r = r @ f
    _, s, vt = np.linalg.svd(r)
    return vt.T, s ** 2 / n


def integer_vectors(rows: DataFrame, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, int]:
    """(the rows with a usable vector, as column x of longs; the number of dimensions)."""
    c = F.col(vector_col).cast("array<double>")
    good: Column = F.coalesce(F.size(c) > 0, F.lit(False)) & F.coalesce(
        F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= F.lit(LARGEST / scale))), F.lit(False))
    sizes = rows.where(good).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    x = F.transform(c, lambda e: F.floor(e * F.lit(float(scale))).cast("bigint") + F.lit(shift).cast("bigint"))
    return rows.where(good & (F.size(vector_col) == d)).withColumn("x", x), d


def fit_whitening(vectors: DataFrame, d: int, most: int | None = 16) -> Whitening:
    """Fit on the distinct x of ``vectors`` (longs, d of them)."""
    if not d:
        return Whitening()
    fit = stage(vectors.select("x").distinct(), "fit-list")
    # sums of x - SHIFT-like offsets stay exact as decimals whatever the rows
    each = fit.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = {r["j"]: (r["n"], int(r["s"])) for r in each.collect()}  # d rows
    w = Whitening(d, sums[0][0], [sums[j][1] for j in range(d)])

    def gram(b: pa.RecordBatch) -> np.ndarray:
        q = w.orthogonalised(_entries(b, d))
        return q.T @ q

    g = first = _sum_tables(fit, gram)
    w.trace = float(np.trace(first)) / w.n
    if w.trace > 0:
        for k in range(PASSES):
            w.factors.append(shifted_factor(g, w.n, k == 0))
            last, g = g, _sum_tables(fit, gram)
            off = np.abs(g - np.eye(d)).max()
            if off < ORTHONORMAL or (k > 1 and off > 0.5 * np.abs(last - np.eye(d)).max()):
                break  # orthonormal, or no nearer to it
        vectors_, variances = svd_components(g, w.factors, w.n)
        real = int((variances > variances[0] * NO_VARIANCE ** 2).sum())
        k = min(real, d if most is None else most)
        w.components, w.variances = vectors_[:, :k], variances[:k]

        def whitened_gram(b: pa.RecordBatch) -> np.ndarray:
            y = w.whitened(_entries(b, d))
            y = np.hstack([y, np.ones((len(y), 1))])
            return y.T @ y

        g = _sum_tables(fit, whitened_gram) / w.n
        mean = g[-1, :-1]
        w.identity_error = float(np.abs(g[:-1, :-1] - np.outer(mean, mean) - np.eye(k)).max())
    unstage(fit)
    return w


def whiten(vectors: DataFrame, w: Whitening, id_col: str) -> DataFrame:
    """(id, deviation, whitened array): exact integer distance from the mean and the whitened coordinates."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _entries(b, w.d)
            y = w.whitened(x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
            total = pa.array([str(v) for v in square_sums(w.centred(x)[0])], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), total, flat], [id_col, "deviation", "whitened"])

    out = vectors.select(id_col, "x").mapInArrow(run, f"`{id_col}` {kind}, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten_components(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    vectors, d = integer_vectors(rows.select(id_col, vector_col), vector_col)
    vectors = vectors.select(id_col, "x")
    w = fit_whitening(vectors, d, most)
    explained = F.array(*[F.lit(float(v)) for v in (w.variances / w.trace if w.trace else [])]).cast("array<double>")
    if w.trace:
        flat = whiten(vectors, w, id_col).select(id_col, "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    else:
        flat = rows.select(id_col, F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(0).alias("_k"), F.lit(None).cast("double").alias("whitened")).limit(0)
    return flat.select(id_col, (F.col("_k") + 1).alias("component"), F.lit(w.n).cast("bigint").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("_k")).alias("explained"), F.lit(w.identity_error).alias("identity_error"))
