"""Tree ensembles over one large table (L2, L4, F12): forests and bagging.

Trees as deep as these have about as many nodes as rows.  A histogram of every
node, summed over all tasks level by level, costs far more than the rows that
most nodes hold.  Here only nodes of over ``GROUP_BYTES`` of rows are split by
histograms that Spark sums over the tasks.  The rows of every smaller node
meet in one group, bounded by those bytes, where its subtree is finished from
the rows themselves.  A row is sent once per tree, in chunks of many rows.

Subtrees stay a table.  To predict, rows are sent to the subtrees they reach, and
their values are added up by chunks of rows.  The trees are those of Spark ML's
``RandomForestRegressor``: Poisson weights of mean 1 per tree and row, the same
feature bins, a random third of the features per node (or all), splits by
greatest variance reduction, nodes of equal targets stay leaves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay_spark import constants as C
from assay_spark.functions import arrays as A
from assay_spark.session import materialize

MAX_BINS = 32
#: Rows that feature bins are found from, as Spark ML does.
BIN_ROWS = 10_000
#: Bytes of rows that one group may hold, and of histograms that a task holds.
GROUP_BYTES, HIST_BYTES = 16 << 20, 128 << 20
#: (row, feature) entries sorted at once while a level is split.
ENTRIES = 2_000_000
#: Trees, depth and share of the features a node looks at.
KINDS = {"forest": (C.FOREST_TREES, C.FOREST_DEPTH, 1 / 3), "bagging": (10, 30, 1.0)}

_POISSON = np.exp(-1.0) * np.cumsum(1.0 / np.cumprod([1, *range(1, 18)]))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def bin_ends(values: np.ndarray, bins: int = MAX_BINS) -> list[float]:
    """Values that end a bin: midpoints of neighbours, at even counts where there are more than fit (Spark ML's rule)."""
    v, counts = np.unique(values, return_counts=True)
    mid = (v[:-1] + v[1:]) / 2
    if len(mid) < bins:
        return mid.tolist()
    stride, out = counts.sum() / bins, []
    target, so_far = stride, np.cumsum(counts).tolist()
    for i in range(1, len(v)):
        if abs(so_far[i - 1] - target) < abs(so_far[i] - target):
            out.append(float(mid[i - 1]))
            target += stride
    return out[:bins - 1]


def row_weights(rid: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson weights of mean 1, a function of the row's number, the tree and the seed."""
    z = rid.astype(np.uint64) * _MIX[0] + np.uint64((tree * 0x632BE59BD9B4E019 + seed * 0xD1342543DE82EF95 + 1) % (1 << 64))
    for shift, mul in ((30, _MIX[1]), (27, _MIX[2])):
        z = (z ^ (z >> np.uint64(shift))) * mul
    z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) * 2.0 ** -53, side="right").astype(float)


def looked_at(nodes: int, d: int, look: int, rng) -> np.ndarray:
    """The features that each of the nodes may be split by: all in order, or some in random order, so that ties favour none."""
    if look >= d:
        return np.broadcast_to(np.arange(d), (nodes, d))
    draw = rng.random((nodes, d))
    some = np.argpartition(draw, look - 1, axis=1)[:, :look]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(draw, some, 1), axis=1), 1)


def best_splits(codes, row, start, w, wy, chosen):
    """(feature, bin, gain) of each node's best split, gain 0 where there is none.

    ``row``, ``w`` and ``wy`` list the nodes' rows, node by node from ``start``;
    ``wy`` adds up to 0 in each node.  Ties go to the feature listed first in ``chosen``, and its first bin.
    """
    nodes, look, m = len(start), chosen.shape[1], len(row)
    count = np.diff(np.append(start, m))
    slot = np.repeat(np.arange(nodes), count)
    total = np.add.reduceat(w, start)
    feature, cut, gain = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes)
    bits = np.int64(max(1, int(m - 1).bit_length()))

    def better(node, f, b, g):
        new = g > gain[node] * (1 + 1e-12)
        node = node[new]
        feature[node], cut[node], gain[node] = f[new], b[new], g[new]

    step = max(1, ENTRIES // m)
    for j in range(0, look, step):
        part = chosen[:, j:j + step]
        k = part.shape[1]
        bins = (slot[:, None] * k + np.arange(k)) * MAX_BINS + codes[row[:, None], part[slot]]
        if nodes * k * MAX_BINS <= m * k:  # many rows a node: histograms
            cw, cs = (np.bincount(bins.ravel(), np.repeat(v, k), nodes * k * MAX_BINS).reshape(nodes, -1, MAX_BINS).cumsum(2) for v in (w, wy))
            rest = total[:, None, None] - cw
            ok = (cw > 0) & (rest > 0)
            g = np.where(ok, cs * cs * total[:, None, None] / np.where(ok, cw * rest, 1.0), 0.0).reshape(nodes, -1)
            at = (g >= g.max(1, keepdims=True) * (1 - 1e-12)).argmax(1)
            every = np.arange(nodes)
            better(every, part[every, at // MAX_BINS], at % MAX_BINS, g[every, at])
            continue
        # few rows a node: its rows in bin order, a candidate wherever a bin ends
        key = ((bins << bits) | np.arange(m)[:, None]).ravel()
        key.sort()
        at, bins = key & ((np.int64(1) << bits) - 1), key >> bits
        ends = np.flatnonzero((bins[1:] != bins[:-1]) & (bins[1:] // MAX_BINS == bins[:-1] // MAX_BINS))
        if not len(ends):
            continue
        cw, cs = np.cumsum(w[at]), np.cumsum(wy[at])
        where, b = bins[ends] // MAX_BINS, bins[ends] % MAX_BINS
        node, pos = where // k, where % k
        first = start[node] * k + pos * count[node]
        low_w = cw[ends] - np.where(first > 0, cw[first - 1], 0.0)
        low_s = cs[ends] - np.where(first > 0, cs[first - 1], 0.0)
        g = low_s * low_s * total[node] / (low_w * (total[node] - low_w))
        begins = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        top = np.repeat(np.maximum.reduceat(g, begins), np.diff(np.append(begins, len(g))))
        hit = np.flatnonzero(g >= top * (1 - 1e-12))
        hit = hit[np.append(True, node[hit][1:] != node[hit][:-1])]
        better(node[hit], part[node[hit], pos[hit]], b[hit], g[hit])
    return feature, cut, gain


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, look: int, rng) -> dict[str, np.ndarray]:
    """One tree: per node its feature (-1: a leaf), cut, first child (the second follows it) and value; gains by feature."""
    d = codes.shape[1]
    row = np.flatnonzero(w > 0)
    start, at = np.zeros(1, np.int64), np.zeros(1, np.int64)
    feature, cut, child, value = [], [], [], []
    gains, made = np.zeros(d), 1
    for level in range(depth + 1):
        count = np.diff(np.append(start, len(row)))
        rw, ry = w[row], y[row]
        mean = np.add.reduceat(rw * ry, start) / np.add.reduceat(rw, start)
        wy = rw * (ry - np.repeat(mean, count))
        feature.append(np.full(len(start), -1, np.int32))
        cut.append(np.zeros(len(start), np.uint8))
        child.append(np.zeros(len(start), np.int32))
        value.append(mean)
        mixed = np.minimum.reduceat(ry, start) < np.maximum.reduceat(ry, start)
        if level == depth or not d or not mixed.any():
            break
        nodes = np.flatnonzero(mixed)
        keep = np.repeat(mixed, count)
        row, rw, wy, count = row[keep], rw[keep], wy[keep], count[nodes]
        start = np.cumsum(count) - count
        f, b, gain = best_splits(codes, row, start, rw, wy, looked_at(len(nodes), d, look, rng))
        split = gain > 1e-14 * np.add.reduceat(wy * wy / rw, start)
        if not split.any():
            break
        feature[-1][nodes[split]], cut[-1][nodes[split]] = f[split], b[split]
        child[-1][nodes[split]] = made + 2 * np.arange(split.sum())
        made += 2 * int(split.sum())
        gains += np.bincount(f[split], gain[split], d)
        keep = np.repeat(split, count)
        slot = np.repeat(np.cumsum(split) - 1, count)[keep]
        row = row[keep]
        side = slot * 2 + (codes[row, f[split][slot]] > b[split][slot])
        row = row[np.argsort(side, kind="stable")]
        count = np.bincount(side, minlength=2 * int(split.sum()))
        start = np.cumsum(count) - count
    return {"feature": np.concatenate(feature), "cut": np.concatenate(cut), "child": np.concatenate(child),
            "value": np.concatenate(value), "gains": gains}


def descend(codes: np.ndarray, feature, cut, child) -> np.ndarray:
    """The node without a split that each row ends in."""
    at = np.zeros(len(codes), np.int64)
    live = np.arange(len(codes)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(live):
        n = at[live]
        n = child[n] + (codes[live, feature[n]] > cut[n])
        at[live] = n
        live = live[feature[n] >= 0]
    return at


class _Top:
    """The nodes of one tree whose rows no group may hold, and their children."""

    def __init__(self) -> None:
        self.feature, self.cut, self.child, self.depth = [-1], [0], [0], [0]

    def split(self, node: int, feature: int, cut: int) -> int:
        self.feature[node], self.cut[node], self.child[node] = feature, cut, len(self.feature)
        for _ in range(2):
            self.feature.append(-1), self.cut.append(0), self.child.append(0), self.depth.append(self.depth[node] + 1)
        return self.child[node]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.child)


def _coded(rows: DataFrame, edges: list[list[float]], chunk_rows: int) -> DataFrame:
    """(chunk, n, rids, codes, ys): rows in chunks of at most ``chunk_rows``, features as bins, one byte each."""
    ends = [np.array(e) for e in edges]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for lo in range(0, len(big), chunk_rows):
                g = big.iloc[lo:lo + chunk_rows]
                x, y = np.stack(g["_x"].to_numpy()).astype(float), g["_y"].to_numpy(float)
                if x.shape[1] != len(ends):
                    raise ValueError(f"vectors have {x.shape[1]} entries, not {len(ends)}")
                codes = np.zeros(x.shape, np.uint8)
                for j, e in enumerate(ends):
                    codes[:, j] = np.searchsorted(e, x[:, j], side="left")
                rid = g["_rid"].to_numpy(np.int64)
                yield pd.DataFrame({"chunk": [int(rid[0])], "n": [len(g)], "rids": [rid.tobytes()], "codes": [codes.tobytes()], "ys": [y.tobytes()]})

    return rows.mapInPandas(run, "chunk bigint, n bigint, rids binary, codes binary, ys binary")


def _chunk(r, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r.rids, np.int64), np.frombuffer(r.codes, np.uint8).reshape(r.n, d), np.frombuffer(r.ys)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by ``keys`` to a fixed number of partitions: groups are few bytes and much work, so they are not merged by size."""
    conf = df.sparkSession
    return df.repartition(max(int(conf.conf.get("spark.sql.shuffle.partitions")), 4 * conf.sparkContext.defaultParallelism), *keys)


def _split_large(chunks: DataFrame, tops: list[_Top], open_: list[tuple[int, int]], d: int, look: int, seed: int, bootstrap: bool) -> list:
    """Best split (tree, node, feature, cut, gain, weight of the lower part, of the whole, mean) of every open node."""
    spark = chunks.sparkSession
    wanted = defaultdict(set)
    for t, n in open_:
        wanted[t].add(n)
    known = spark.sparkContext.broadcast({t: (tops[t].arrays(), sorted(ns)) for t, ns in wanted.items()})
    size = 3 + look * MAX_BINS * 2

    def features(t: int, n: int) -> np.ndarray:
        return looked_at(1, d, look, np.random.default_rng([seed, t, n]))[0]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def hand_on() -> pd.DataFrame:
            out = pd.DataFrame([(t, n, v) for (t, n), v in held.items()], columns=["tree", "node", "v"])
            held.clear()
            return out

        for b in batches:
            for r in b.itertuples():
                rid, codes, y = _chunk(r, d)
                for t, (top, nodes) in known.value.items():
                    at = descend(codes, *top)
                    w = row_weights(rid, t, seed) if bootstrap else np.ones(len(rid))
                    for n in nodes:
                        of = np.flatnonzero((at == n) & (w > 0))
                        v, ow, oy = held.setdefault((t, n), np.zeros(size)), w[of], y[of]
                        v[:3] += ow.sum(), (ow * oy).sum(), (ow * oy * oy).sum()
                        key = (np.arange(look) * MAX_BINS + codes[of][:, features(t, n)]).ravel()
                        v[3:] += np.concatenate([np.bincount(key, np.repeat(x, look), look * MAX_BINS) for x in (ow, ow * oy)])
                    if len(held) * size * 8 > HIST_BYTES:
                        yield hand_on()
        yield hand_on()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                v, f = np.asarray(r.v, float), features(r.tree, r.node)
                total, mean = v[0], v[1] / v[0]
                cw, cs = v[3:].reshape(2, look, MAX_BINS).cumsum(2)
                cs, rest = cs - cw * mean, total - cw
                ok = (cw > 0) & (rest > 0)
                g = np.where(ok, cs * cs * total / np.where(ok, cw * rest, 1.0), 0.0).ravel()
                at = int((g >= g.max() * (1 - 1e-12)).argmax())
                spread = max(0.0, v[2] - v[1] * mean)
                gain = float(g[at]) if g[at] > 1e-12 * max(spread, 1e-12 * v[2]) else 0.0
                out.append((r.tree, r.node, int(f[at // MAX_BINS]), at % MAX_BINS, gain, float(cw.ravel()[at]), float(total), float(mean)))
            yield pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "gain", "low", "total", "mean"])

    part = chunks.mapInPandas(sums, "tree int, node int, v array<double>")
    summed = part.groupBy("tree", "node").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("tree", "node", vector_to_array("v").alias("v"))
    # one small row per open node, each of over GROUP_BYTES of rows
    return summed.mapInPandas(best, "tree int, node int, feature int, cut int, gain double, low double, total double, mean double").collect()


class EnsembleModel:
    """Bin ends, the few largest nodes, and a table of subtrees; ``transform`` adds ``_pred``."""

    def __init__(self, edges, tops: list[_Top], top_gains: list, subtrees: DataFrame, group_rows: int) -> None:
        self.edges, self.tops, self.top_gains, self.subtrees, self.group_rows = edges, tops, top_gains, subtrees, group_rows

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 (Spark ML's name)
        """Variance reduction by feature, each tree's summing to 1, and their mean."""
        d = len(self.edges)
        e = self.subtrees.select("tree", F.posexplode("gains").alias("feature", "g"))
        if self.top_gains:
            e = e.unionByName(e.sparkSession.createDataFrame(self.top_gains, "tree int, feature int, g double"))
        by_tree = e.groupBy("tree", "feature").agg(F.sum("g").alias("g"))
        whole = by_tree.groupBy("tree").agg(F.sum("g").alias("s")).where("s > 0")
        got = by_tree.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("s")).alias("g")).collect()  # a row per feature
        out = np.zeros(d)
        for r in got:
            out[r["feature"]] = r["g"]
        return Vectors.dense(out / out.sum() if out.sum() else out)

    def transform(self, df: DataFrame) -> DataFrame:
        d, trees = len(self.edges), len(self.tops)
        rows = materialize(df.withColumn("_rid", F.monotonically_increasing_id()))
        salts = -(-max(1, rows.count()) // self.group_rows)
        tops = rows.sparkSession.sparkContext.broadcast([t.arrays() for t in self.tops])
        coded = _coded(rows.select("_rid", vector_to_array("_f").alias("_x"), F.lit(0.0).alias("_y")), self.edges, min(10_000, self.group_rows))

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    rid, codes, _ = _chunk(r, d)
                    for t, top in enumerate(tops.value):
                        at = descend(codes, *top)
                        nodes = np.unique(at).tolist()
                        of = [np.flatnonzero(at == n) for n in nodes]
                        yield pd.DataFrame({"tree": t, "node": nodes, "chunk": r.chunk, "rids": [rid[o].tobytes() for o in of], "codes": [codes[o].tobytes() for o in of]})

        def walk(asked: pd.DataFrame, sub: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(sub):
                s = sub.iloc[0]
                feature, cut, child, value = (np.frombuffer(s[c], k) for c, k in (("feature", np.int32), ("cut", np.uint8), ("child", np.int32), ("value", float)))
                for chunk, rids, codes in zip(asked["chunk"], asked["rids"], asked["codes"]):
                    at = descend(np.frombuffer(codes, np.uint8).reshape(len(rids) // 8, d), feature, cut, child)
                    out.append((chunk, rids, value[at].tobytes()))
            return pd.DataFrame(out, columns=["chunk", "rids", "vals"])

        def add(g: pd.DataFrame) -> pd.DataFrame:
            rid = np.frombuffer(b"".join(g["rids"]), np.int64)
            val = np.frombuffer(b"".join(g["vals"]), float)
            order = np.lexsort((val, rid))  # added in one order, however they came
            rid, val = rid[order], val[order]
            start = np.flatnonzero(np.append(True, rid[1:] != rid[:-1]))
            return pd.DataFrame({"_rid": rid[start], "_pred": np.add.reduceat(val, start) / trees})

        asked = coded.mapInPandas(deal, "tree int, node int, chunk bigint, rids binary, codes binary")
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))
        subs = self.subtrees.drop("gains").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        subs = _spread(subs.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("salt").alias("_s"), "feature", "cut", "child", "value"), "_t", "_n", "_s")
        values = _spread(asked, "tree", "node", "salt").groupBy("tree", "node", "salt").cogroup(subs.groupBy("_t", "_n", "_s")).applyInPandas(
            walk, "chunk bigint, rids binary, vals binary")
        pred = values.groupBy("chunk").applyInPandas(add, "_rid bigint, _pred double")
        return rows.join(pred, "_rid").drop("_rid")


def fit_ensemble(train: DataFrame, kind: str, seed: int = 42, numTrees: int | None = None, maxDepth: int | None = None,  # noqa: N803 (Spark ML's names)
                 bootstrap: bool = True) -> EnsembleModel:
    """A forest or bagged trees of the vectors ``_f`` and targets ``_y`` of ``train``."""
    trees, depth = numTrees or KINDS[kind][0], KINDS[kind][1] if maxDepth is None else maxDepth
    finite = F.col("_y").isNotNull() & ~F.isnan("_y") & (F.abs("_y") < F.lit(float("inf")))
    y = F.when(finite, F.col("_y")).otherwise(F.raise_error(F.lit("Labels MUST NOT be Null, NaN or infinite")))
    x = vector_to_array("_f")
    whole = F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.when(whole, x).otherwise(F.raise_error(F.lit("Vectors MUST NOT be Null or hold NaN or infinite values")))
    rows = materialize(train.select(F.monotonically_increasing_id().alias("_rid"), x.alias("_x"), y.alias("_y")))
    n, d = rows.agg(F.count(F.lit(1)), F.max(F.size("_x"))).first()
    if not n or not d:
        raise ValueError("no rows or no features to fit")
    look = d if trees == 1 or KINDS[kind][2] == 1.0 else max(1, int(np.ceil(d * KINDS[kind][2])))

    def ends(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": [int(key[0])], "ends": [bin_ends(g["v"].to_numpy(float))]})

    sample = rows.sample(BIN_ROWS / n, seed) if n > BIN_ROWS else rows
    found = sample.select(A.entries("_x", "feature", "v")).groupBy("feature").applyInPandas(ends, "feature int, ends array<double>").collect()  # a row per feature
    edges: list[list[float]] = [[] for _ in range(d)]
    for r in found:
        edges[r["feature"]] = list(r["ends"])

    group_rows = max(1, GROUP_BYTES // (d + 16))
    chunks = materialize(_coded(rows, edges, min(10_000, group_rows)))
    tops, top_gains, large = [_Top() for _ in range(trees)], [], {}
    # weights bound rows from above; large leaves (no split, or too deep) get their value here
    open_ = [(t, 0) for t in range(trees)] if n > group_rows else []
    while open_:
        found, open_ = _split_large(chunks, tops, open_, d, look, seed, bootstrap), []
        for t, node, f, cut, gain, low, total, mean in found:
            if total <= group_rows:
                continue
            if not gain or tops[t].depth[node] >= depth:
                large[t, node] = mean
                continue
            child = tops[t].split(node, f, cut)
            top_gains.append((t, f, gain))
            open_ += [(t, c) for c, size in ((child, low), (child + 1, total - low)) if size > group_rows]
    known = rows.sparkSession.sparkContext.broadcast([(t.arrays(), t.depth, {m for k, m in large if k == i}) for i, t in enumerate(tops)])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                rid, codes, ys = _chunk(r, d)
                for t, (top, _, done) in enumerate(known.value):
                    w = row_weights(rid, t, seed) if bootstrap else np.ones(len(rid))
                    at = descend(codes, *top)
                    nodes = [m for m in np.unique(at).tolist() if m not in done]
                    of = [np.flatnonzero((at == m) & (w > 0)) for m in nodes]
                    yield pd.DataFrame({"tree": t, "node": nodes, "chunk": r.chunk, "codes": [codes[o].tobytes() for o in of],
                                        "ys": [ys[o].tobytes() for o in of], "ws": [w[o].astype(np.uint8).tobytes() for o in of]})

    def finish(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        t, node = int(key[0]), int(key[1])
        g = g.sort_values("chunk")  # the order in which chunks arrive decides nothing
        codes = np.frombuffer(b"".join(g["codes"]), np.uint8).reshape(-1, d)
        depth_left = depth - known.value[t][1][node]
        ys, ws = np.frombuffer(b"".join(g["ys"])), np.frombuffer(b"".join(g["ws"]), np.uint8).astype(float)
        if not len(ys):  # a tree that drew no row
            return as_row(t, node, leaf(0.0))
        return as_row(t, node, grow(codes, ys, ws, depth_left, look, np.random.default_rng([seed, t, node, 1])))

    def leaf(value: float) -> dict[str, np.ndarray]:
        return {"feature": np.full(1, -1, np.int32), "cut": np.zeros(1, np.uint8), "child": np.zeros(1, np.int32), "value": np.array([value]), "gains": np.zeros(d)}

    def as_row(t: int, node: int, out: dict[str, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"tree": [t], "node": [node], **{c: [out[c].tobytes()] for c in ("feature", "cut", "child", "value")}, "gains": [out["gains"].tolist()]})

    dealt = chunks.mapInPandas(deal, "tree int, node int, chunk bigint, codes binary, ys binary, ws binary")
    schema = "tree int, node int, feature binary, cut binary, child binary, value binary, gains array<double>"
    subtrees = _spread(dealt, "tree", "node").groupBy("tree", "node").applyInPandas(finish, schema)
    if large:
        ends_here = pd.concat([as_row(t, m, leaf(v)) for (t, m), v in large.items()])
        subtrees = subtrees.unionByName(rows.sparkSession.createDataFrame(ends_here, schema))
    return EnsembleModel(edges, tops, top_gains, materialize(subtrees), group_rows)
