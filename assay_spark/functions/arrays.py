"""Array-valued column expressions.

Feature vectors are one ``array<double>`` column, never thousands of scalar
columns, so these helpers are higher-order functions that run JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_array(x) -> Column:
    return _c(x).cast("array<double>")


def vsum(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + v)


def sq_dist(a, b) -> Column:
    """Squared Euclidean distance of two equal-length arrays."""
    return vsum(F.zip_with(_c(a), _c(b), lambda p, q: (p - q) * (p - q)))


def dot(a, b) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda p, q: p * q))


def vmax_abs(x) -> Column:
    """max |x_i| of one array (null for an empty array)."""
    return F.array_max(F.transform(_c(x), lambda v: F.abs(v)))


def scale(x, factor) -> Column:
    f = _c(factor) if not isinstance(factor, (int, float)) else F.lit(float(factor))
    return F.transform(_c(x), lambda v: v * f)


def pair_products(x, n: int | None = None) -> Column:
    """All z_i * z_j with i < j, in (i, j) lexicographic order.

    ``n`` is the vector length when known (a literal loop bound keeps the
    expression static); otherwise it is read per row with ``size``.
    """
    v = _c(x)
    size = F.lit(n) if n is not None else F.size(v)
    # i runs 0..n-2; for each i, j runs i+1..n-1 -> flatten keeps i-major order
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), size - 2),
            lambda i: F.transform(
                F.sequence(i + 1, size - 1),
                lambda j: F.element_at(v, i + 1) * F.element_at(v, j + 1),
            ),
        )
    )


def outer_product(x, n: int | None = None) -> Column:
    """All z_i * z_j for every (i, j), row-major (the ``ss`` readout)."""
    v = _c(x)
    size = F.lit(n) if n is not None else F.size(v)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), size - 1),
            lambda i: F.transform(v, lambda q: F.element_at(v, i + 1) * q),
        )
    )


def correlators(x, order: int = 2, n: int | None = None) -> Column:
    """Singles then unordered pairs: n + n(n-1)/2 values (order=2) or n (order=1)."""
    v = _c(x)
    if order == 1:
        return v
    return F.concat(v, pair_products(v, n))


def any_nan(x) -> Column:
    return F.exists(_c(x), lambda v: F.isnan(v) | v.isNull())


def entries(x, i_name: str = "i", v_name: str = "value") -> Column:
    """Generator of (position, value) rows of an array, 0-based int positions.

    Use with ``select(..., entries(...))`` in place of ``posexplode``: it
    reads the array expression once, where posexplode over a computed array
    re-evaluates it for every position (measured ~80x slower on 1710-long
    arrays).
    """
    return F.inline(F.transform(_c(x), lambda v, i: F.struct(i.alias(i_name), v.alias(v_name))))


def lower_bound(arr, v, max_len: int) -> Column:
    """Number of entries of the ascending array ``arr`` strictly below ``v``
    (binary search in ceil(log2(max_len + 1)) fixed steps; ``max_len``
    bounds the array length)."""
    import math

    a, x = _c(arr), _c(v)
    steps = max(1, math.ceil(math.log2(max_len + 1)))
    init = F.struct(F.lit(0).alias("lo"), F.size(a).alias("hi"))

    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = ((lo + hi) / 2).cast("int")
        open_ = lo < hi
        right = open_ & (F.try_element_at(a, mid + 1) < x)
        return F.struct(F.when(right, mid + 1).otherwise(lo).alias("lo"),
                        F.when(open_ & ~right, mid).otherwise(hi).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step, lambda acc: acc["lo"])
