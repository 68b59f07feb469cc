"""Keyed joins (J1-J3, J6, J9).  Positional alignment in the reference
becomes an equi-join on an explicit row id."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay_spark.operators.report import join_predictions
from assay_spark.operators.sampling import _list, exclude_drawn


def attach_target(x: DataFrame, y: DataFrame, on: Sequence[str] = ("row_id",)) -> DataFrame:
    """Left equi-join of targets onto features; missing targets are null."""
    return x.join(y, _list(on), "left")


def attach_label(df: DataFrame, labels: DataFrame, on: Sequence[str] = ("row_id",)) -> DataFrame:
    """Attach a cluster label by row id."""
    return df.join(labels, _list(on), "inner")


def pair_by_position(names: DataFrame, values: DataFrame, pos: str = "pos") -> DataFrame:
    """Pair two sequences by an explicit position column."""
    return names.join(values, pos, "inner")


def zip_arrays(df: DataFrame, a: str, b: str, out: str = "pairs") -> DataFrame:
    """J3 inside a row: element-wise pairing of two arrays."""
    return df.withColumn(out, F.arrays_zip(F.col(a), F.col(b)))


__all__ = ["attach_target", "attach_label", "pair_by_position", "zip_arrays", "exclude_drawn", "join_predictions"]
