"""Bias-adjusted moments.

Spark's ``skewness`` and ``kurtosis`` are the population (biased) forms; the
sample-adjusted forms used by spreadsheet/statistics tools are

    G1 = g1 * sqrt(n (n - 1)) / (n - 2)
    G2 = (n - 1) / ((n - 2) (n - 3)) * ((n + 1) g2 + 6)

with g1, g2 the population skewness and excess kurtosis.  Both stay one-pass
declarative aggregates (partial + final), so they work per group at scale.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def skew_adj(x) -> Column:
    n = F.count(_c(x)).cast("double")
    g1 = F.skewness(_c(x))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_adj(x) -> Column:
    n = F.count(_c(x)).cast("double")
    g2 = F.kurtosis(_c(x))
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
