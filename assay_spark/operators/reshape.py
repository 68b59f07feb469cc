"""Reshape: nested scores to long rows, transpose, concatenation, long/wide,
dict-of-lists to rows (R1-R5)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay_spark.functions import arrays as A
from assay_spark.operators.sampling import _list
from assay_spark.session import materialize


# ---------------------------------------------------------------- R1
def scores_long(df: DataFrame, scores: str = "scores", keep: Sequence[str] = ()) -> DataFrame:
    """map(metric -> map(model -> array(score))) to rows (metric, model,
    run, score); ``run`` is the 1-based position in the list.  Empty lists
    give no rows."""
    keep = _list(keep)
    a = df.select(*keep, F.explode(scores).alias("metric", "_m"))
    b = a.select(*keep, "metric", F.explode("_m").alias("model", "_l"))
    return b.select(*keep, "metric", "model", A.entries("_l", "_p", "score")).select(
        *keep, "metric", "model", (F.col("_p") + 1).cast("int").alias("run"), "score")


# ---------------------------------------------------------------- R2
def to_entries(df: DataFrame, id_col: str, vec: str, i_name: str = "i", v_name: str = "value") -> DataFrame:
    """(id, vector) -> (id, i, value) with 0-based i."""
    return df.select(id_col, A.entries(vec, i_name, v_name))


def transpose(df: DataFrame, id_col: str, vec: str, new_id: str = "row_id", out: str = "x") -> DataFrame:
    """Rows of vectors -> rows of vectors over the other index: entry i of
    every input row becomes the vector of output row i, ordered by input id.

    A shuffle by the new row index; each output row gathers one entry per
    input row, so its group is as long as the input has rows (the matrix
    orientation itself demands that; ``transpose_tiles`` cuts it).
    """
    e = to_entries(df, id_col, vec, "_i", "_v")
    g = e.groupBy("_i").agg(F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("_k"), "_v"))).alias("_l"))
    return g.select(F.col("_i").cast("long").alias(new_id), F.transform("_l", lambda s: s["_v"]).alias(out))


#: Samples of a tile.
TILE = 4096


def numbered(df: DataFrame, id_col: str, out: str = "_pos") -> DataFrame:
    """Add the 0-based position of each row in the order of ``id_col`` (ties in any order).

    A range sort, written once; then each row's place in its sorted partition
    plus the rows of the partitions before (one number per partition)."""
    rows = materialize(df.orderBy(id_col)).withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in counts:
        starts.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(starts, "_p bigint, _before bigint")
    d = rows.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return d.withColumn(out, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_before")


def transpose_tiles(df: DataFrame, id_col: str, vec: str, tile: int = TILE, new_id: str = "row_id",
                    start: str = "start", out: str = "x") -> DataFrame:
    """``transpose`` in tiles: (new_id, start, x) where x holds entry ``new_id`` of
    the input rows at positions start, start + 1, ... in the order of ``id_col``.
    No group is longer than a tile.  Null and missing entries are null."""
    e = numbered(df.select(id_col, vec), id_col).select("_pos", A.entries(vec, "_i", "_v"))
    t = F.floor(F.col("_pos") / F.lit(tile)).cast("bigint")
    g = e.groupBy("_i", t.alias("_t")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("_pos") % F.lit(tile)).cast("int").alias("k"), "_v"))).alias("_l"))
    last = F.element_at("_l", -1)["k"]
    filled = F.transform(F.sequence(F.lit(0), last), lambda k: F.element_at(F.map_from_entries("_l"), k))
    return g.select(F.col("_i").cast("long").alias(new_id), (F.col("_t") * F.lit(tile)).alias(start),
                    F.when(F.size("_l") == last + 1, F.transform("_l", lambda s: s["_v"])).otherwise(filled).alias(out))


# ---------------------------------------------------------------- R3
def concat_vectors(df: DataFrame, vecs: Sequence[str], out: str = "x") -> DataFrame:
    return df.withColumn(out, F.concat(*[F.col(v) for v in vecs]))


# ---------------------------------------------------------------- R4
def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "col_name",
            value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def to_wide(df_long: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Pivot with a fixed name list (no extra pass to discover names)."""
    return df_long.groupBy(*ids).pivot(name, list(names)).agg(F.first(value))


# ---------------------------------------------------------------- R5
def results_frame(df: DataFrame, lists: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns of parallel lists (Algorithm, MSE, ...) -> one row per position."""
    keep = _list(keep)
    z = df.select(*keep, F.explode(F.arrays_zip(*[F.col(c) for c in lists])).alias("_z"))
    return z.select(*keep, *[F.col(f"_z.{c}").alias(c) for c in lists])
