"""Tree ensembles for all cells of a grid in one job (L2-L5 inside G1).

The cells of a grid are many small tables.  Fitting each by its own distributed
job costs a job per tree level and cell; here every (cell, block of trees) is
one group of one Spark job, so the number of jobs does not depend on the cells.
A group holds one cell's rows, which are counted first: cells beyond
``MAX_CELL_VALUES`` numbers are not grouped but left to a distributed fit each
(``too_large``), so no group is unbounded.

Trees grow level by level on binned features: one histogram of weights and
weighted targets per level over (tree, node, feature, bin), from which each node
takes the split of greatest variance reduction.  Feature bins end at midpoints
between neighbouring values, at evenly spaced ones where a feature has more than
``MAX_BINS`` values in the cell.
"""

from __future__ import annotations

import zlib
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay_spark import constants as C
from assay_spark.operators.sampling import _list

MAX_BINS = 32
#: Numbers (rows x features) of a cell that one group may hold; trees of a group.
MAX_CELL_VALUES, GROUP_TREES = 4_000_000, 25
#: Histogram cells held at once while a level is split.
HIST_CELLS = 4_000_000

#: trees, depth, features a node looks at (of all), bootstrap rows, boosting rate
KINDS = {
    "forest": (C.FOREST_TREES, C.FOREST_DEPTH, 1 / 3, True, 0.0),
    "bagging": (10, 30, 1.0, True, 0.0),
    "tree": (1, 30, 1.0, False, 0.0),
    "gbt": (100, 3, 1.0, False, 0.1),
}


def bin_edges(x: np.ndarray, bins: int = MAX_BINS) -> list[np.ndarray]:
    """Per feature, the values that end a bin (a value belongs to the first bin whose end is not below it)."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        mid = v[:-1] + (v[1:] - v[:-1]) / 2
        if len(mid) > bins - 1:
            mid = mid[np.linspace(0, len(mid) - 1, bins - 1).round().astype(int)]
        out.append(mid)
    return out


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if x.shape[1] else np.zeros(x.shape, int)


def _best_splits(codes, row, slot, w, wy, nodes, allowed):
    """(feature, bin, gain) of each node's best split; gain 0 where none reduces the variance."""
    d = codes.shape[1]
    feature, cut, gain = np.zeros(nodes, int), np.zeros(nodes, int), np.zeros(nodes)
    step = max(1, HIST_CELLS // max(1, d * MAX_BINS))
    order = np.argsort(slot, kind="stable")
    row, slot, w, wy = row[order], slot[order], w[order], wy[order]
    for lo in range(0, nodes, step):
        hi = min(nodes, lo + step)
        a, b = np.searchsorted(slot, [lo, hi])
        key = (((slot[a:b] - lo) * d)[:, None] + np.arange(d)) * MAX_BINS + codes[row[a:b]]
        size = (hi - lo) * d * MAX_BINS
        cw, cs = (np.bincount(key.ravel(), np.repeat(v[a:b], d), size).reshape(hi - lo, d, MAX_BINS).cumsum(2) for v in (w, wy))
        all_w, all_s = cw[:, :1, -1:], cs[:, :1, -1:]
        ok = (cw > 0) & (all_w - cw > 0) & allowed[lo:hi, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            g = np.where(ok, cs ** 2 / cw + (all_s - cs) ** 2 / (all_w - cw) - all_s ** 2 / all_w, 0.0).reshape(hi - lo, -1)
        # rounded, so that equal gains fall to the first feature and bin
        at = np.round(g, 10).argmax(1)
        feature[lo:hi], cut[lo:hi], gain[lo:hi] = at // MAX_BINS, at % MAX_BINS, g[np.arange(hi - lo), at]
    return feature, cut, gain


def grow(codes: np.ndarray, y: np.ndarray, weights: np.ndarray, depth: int, look: int, rng, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(predictions of the fitted rows, of the test rows) by tree: trees grown level by level."""
    trees, n = weights.shape
    d = codes.shape[1]
    out, out_test = np.zeros((trees, n)), np.zeros((trees, len(test)))
    tree, row = np.nonzero(np.ones((trees, n), bool))
    t_tree, t_row = np.nonzero(np.ones((trees, len(test)), bool))
    slot, t_slot, nodes = tree.copy(), t_tree.copy(), trees
    for level in range(depth + 1):
        w = weights[tree, row]
        wy = w * y[row]
        sw, sy = np.bincount(slot, w, nodes), np.bincount(slot, wy, nodes)
        value = sy / np.maximum(sw, 1e-300)
        out[tree, row], out_test[t_tree, t_row] = value[slot], value[t_slot]
        if level == depth or not d:
            break
        allowed = np.ones((nodes, d), bool)
        if look < d:
            draw = rng.random((nodes, d))
            allowed = draw <= np.partition(draw, look - 1, axis=1)[:, look - 1:look]
        fit = w > 0
        feature, cut, gain = _best_splits(codes, row[fit], slot[fit], w[fit], wy[fit], nodes, allowed)
        split = gain > 1e-9 * np.maximum(1.0, np.abs(sy * value))
        if not split.any():
            break
        number = np.cumsum(split) - 1
        keep, t_keep = split[slot], split[t_slot]
        tree, row, slot = tree[keep], row[keep], slot[keep]
        t_tree, t_row, t_slot = t_tree[t_keep], t_row[t_keep], t_slot[t_keep]
        slot = number[slot] * 2 + (codes[row, feature[slot]] > cut[slot])
        t_slot = number[t_slot] * 2 + (test[t_row, feature[t_slot]] > cut[t_slot])
        nodes = 2 * int(split.sum())
    return out, out_test


def predict_cell(kind: str, x: np.ndarray, y: np.ndarray, test: np.ndarray, trees: int, seed: list[int]) -> np.ndarray:
    """Sum over ``trees`` trees of the predictions of the test rows (the boosted sum itself for gbt)."""
    _, depth, share, bootstrap, rate = KINDS[kind]
    rng, n, d = np.random.default_rng(seed), len(x), x.shape[1]
    edges = bin_edges(x)
    codes, codes_test = to_bins(x, edges), to_bins(test, edges)
    look = max(1, int(np.ceil(d * share)))
    if rate:
        fitted, total = np.full(n, y.mean()), np.full(len(test), y.mean())
        for _ in range(trees):
            a, b = grow(codes, y - fitted, np.ones((1, n)), depth, look, rng, codes_test)
            fitted, total = fitted + rate * a[0], total + rate * b[0]
        return total
    weights = np.stack([np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(trees)]).astype(float) if bootstrap else np.ones((trees, n))
    return grow(codes, y, weights, depth, look, rng, codes_test)[1].sum(0)


def cell_sizes(cells: DataFrame, by: Sequence[str], vec: str) -> DataFrame:
    """Per cell, whether one group may hold it."""
    by = _list(by)
    e = (F.count(F.lit(1)) * F.max(F.coalesce(F.size(vec), F.lit(0))) <= MAX_CELL_VALUES).alias("_fits")
    return cells.groupBy(*by).agg(e) if by else cells.agg(e)


def too_large(cells: DataFrame, by: Sequence[str], vec: str = "x") -> list[tuple]:
    """Keys of the cells that no group may hold; each has a bounded least number of rows, so they are few."""
    return [tuple(r)[:-1] for r in cell_sizes(cells, by, vec).where("NOT _fits").collect()]


def grouped_trees(cells: DataFrame, by: Sequence[str], kind: str, id_col: str = "row_id", vec: str = "x", y: str = "y",
                  split: str = "split", seed: int = 42, trees: int | None = None) -> DataFrame:
    """(by, id, y, y_hat) of the test rows of every cell that a group may hold.

    Rows without a target are not fitted, cells without fitted rows give no
    predictions, null entries count as 0.  Rows that repeat inside a cell are
    predicted once each.
    """
    by = _list(by)
    trees = trees or KINDS[kind][0]
    per = trees if KINDS[kind][4] else GROUP_TREES  # boosted trees follow one another
    rows = cells.select(*by, F.col(id_col).alias("_id"), F.col(vec).cast("array<double>").alias("_x"), F.col(y).cast("double").alias("_y"),
                        (F.col(split) == "train").alias("_train"))
    ok = cell_sizes(rows, by, "_x").where("_fits").drop("_fits")
    rows = rows.join(F.broadcast(ok), by, "left_semi") if by else rows  # a row per cell of the grid
    parts = -(-trees // per)
    dealt = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    id_type = cells.schema[id_col].dataType.simpleString()
    keys = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        train, test = g[g["_train"] & g["_y"].notna()], g[~g["_train"]]
        empty = pd.DataFrame({**{c: [] for c in by}, "_id": [], "_y": [], "_s": [], "_n": []})
        if not len(train) or not len(test):
            return empty
        matrix = lambda t: np.nan_to_num(np.array(t["_x"].tolist(), float))
        x, target = matrix(train), train["_y"].to_numpy()
        order = np.lexsort((*x.T[::-1], target))  # the order in which rows arrive decides nothing
        part = int(key[-1])
        cell = zlib.crc32(repr([str(k) for k in key[:-1]]).encode())
        s = predict_cell(kind, x[order], target[order], matrix(test), min(per, trees - part * per), [seed, cell, part])
        out = pd.DataFrame({**{c: k for c, k in zip(by, key)}, "_id": test["_id"].to_numpy(), "_y": test["_y"].to_numpy(), "_s": s, "_n": 1})
        return out.groupby([*by, "_id", "_y", "_s"], as_index=False, dropna=False)["_n"].sum()[[*by, "_id", "_y", "_s", "_n"]]

    sums = dealt.groupBy(*by, "_part").applyInPandas(run, f"{keys + ', ' if keys else ''}_id {id_type}, _y double, _s double, _n bigint")
    total = F.sum("_s") / F.lit(1.0 if KINDS[kind][4] else float(trees))
    each = sums.groupBy(*by, "_id", "_y").agg(total.alias("y_hat"), F.max("_n").alias("_n"))
    return each.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).select(
        *by, F.col("_id").alias(id_col), F.col("_y").alias("y"), "y_hat")
