"""Operator 7: near-duplicate vectors by a robust-pruned flat graph.

Vectors are compared within one label only.  Equal vectors are one class.

1. Centroids are fitted on a bounded sample (``SAMPLE`` vectors); every vector
   is stored in its ``overlap`` nearest clusters, the shards.  A shard over
   ``PIECE`` vectors is cut into pieces by a hash; queries go to all of them.
2. Each shard builds a flat graph: the nearest vectors and some random ones are
   pruned robustly (a candidate goes if a chosen neighbour is ``ALPHA`` times
   nearer to it).  The adjacency lists of all shards are united per vector.
3. Every vector is a query in its shards: greedy search starts at the shard's
   medoids and, once inside the radius, expands every vector in range.  Found
   links are cosines in double precision, so none lies below the threshold.  A
   pair met in several shards counts in the first they share.
4. Recall is audited against brute force for a bounded number of queries over
   all rows, apart for queries with up to ``FEW`` links and with more, so that a
   large group of copies hides no lost small ones; below ``TARGET`` in either the
   overlap doubles and the search runs again.  If the widest search stays below
   ``LEAST``, the call fails instead of returning an incomplete result.

Vectors that are null, zero or hold null or non-finite components, and rows
without label or id, link with nothing; a null id has a null component.  Lengths
are part of the label, so vectors of different lengths are never compared.
Repeated rows count each other as links.  Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay_spark.llm.common import stage
from assay_spark.llm.components import components

SAMPLE, SHARD, PIECE, MAX_CLUSTERS = 20_000, 500, 2000, 4096
NEAR, FAR, POOL, ALPHA = 24, 8, 64, 1.2
BEAM, ENTRIES, CHUNK = 24, 24, 256
AUDIT, TARGET, LEAST, MAX_OVERLAP = 512, 0.97, 0.9, 12
#: Links of a query that has few of them; links that a recall is measured on, at least.
FEW, ENOUGH = 64, 32


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_centroids(vectors: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = vectors[rng.permutation(len(vectors))[:k]]
    for _ in range(rounds):
        at = (vectors @ c.T).argmax(1)
        new = np.zeros_like(c)
        np.add.at(new, at, vectors)
        empty = ~new.any(1)
        new[empty] = c[empty]
        c = _unit(np.where(np.linalg.norm(new, axis=1, keepdims=True) > 0, new, c))
    return c


def medoids(x: np.ndarray, count: int) -> np.ndarray:
    """Rows nearest to the centres of a few clusters."""
    k = min(count, len(x))
    return np.unique((x @ fit_centroids(x, k, rounds=3).T).argmax(0))


def build_graph(x: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row."""
    n, rng, out = len(x), np.random.default_rng(seed), []
    for lo in range(0, n, 512):
        d = 1 - x[lo:lo + 512] @ x.T
        pool = np.argpartition(d, min(POOL, n - 1), axis=1)[:, :POOL + 1]
        for r in range(len(d)):
            i = lo + r
            kept: list[int] = []
            for cand, most in ((pool[r], NEAR), (rng.integers(0, n, POOL), NEAR + FAR)):
                cand = cand[cand != i]
                cand = cand[np.argsort(d[r, cand], kind="stable")]
                live = np.ones(len(cand), bool)
                for k in range(len(cand)):
                    if len(kept) >= most:
                        break
                    if live[k] and cand[k] not in kept:
                        kept.append(int(cand[k]))
                        live &= ALPHA * (1 - x[cand] @ x[cand[k]]) > d[r, cand]
            out.append(np.array(kept, np.int64))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(out):
        for j in own.tolist():
            if len(back[j]) < NEAR:
                back[j].append(i)
    return [np.unique(np.concatenate([a, np.array(b, np.int64)])) for a, b in zip(out, back)]


def range_search(q: np.ndarray, x: np.ndarray, adjacency: np.ndarray, entries: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query, rows found in range); ``adjacency``: neighbours, padded by -1."""
    for lo in range(0, len(q), CHUNK):
        part = q[lo:lo + CHUNK]
        sim = np.full((len(part), len(x)), -2.0)
        done = np.zeros(sim.shape, bool)
        sim[:, entries] = part @ x[entries].T
        rank = min(BEAM, len(x)) - 1
        while True:
            open_ = np.where(done, -2.0, sim)
            best = open_.argmax(1)
            r = np.arange(len(part))
            edge = -np.partition(-sim, rank, axis=1)[:, rank]
            go = (open_[r, best] > -2) & (open_[r, best] >= edge)
            take = open_ >= threshold  # everything in range is expanded
            take[r[go], best[go]] = True
            row, node = np.nonzero(take)
            if not len(row):
                break
            done[row, node] = True
            near = adjacency[node]
            row = np.repeat(row, near.shape[1])
            near = near.ravel()
            ok = near >= 0
            code = np.unique(row[ok] * len(x) + near[ok])
            row, near = code // len(x), code % len(x)
            new = sim[row, near] <= -2
            row, near = row[new], near[new]
            sim[row, near] = np.einsum("ij,ij->i", part[row], x[near])
        for k in range(len(part)):
            yield lo + k, np.flatnonzero(sim[k] >= threshold)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), np.float64)


def _centroids(classes: DataFrame) -> dict[str, np.ndarray]:
    """Centroids of each label, from a bounded sample."""
    counts = {r["label"]: r["n"] for r in classes.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    draw = F.pmod(F.col("node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = classes.where(draw < min(1.0, SAMPLE / max(1, total))).select("label", "unit").orderBy("label", "unit").limit(2 * SAMPLE).toPandas()
    out = {}
    for label, g in sample.groupby("label"):
        k = max(1, min(MAX_CLUSTERS, -(-counts[label] // SHARD), len(g)))
        out[label] = fit_centroids(_matrix(g["unit"]), k)
    return out


def _assign(classes: DataFrame, centroids: dict[str, np.ndarray], overlap: int) -> DataFrame:
    """Add shards: the numbers of each vector's nearest clusters, ascending."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shards: list = [[0]] * len(b)
            for label, g in b.reset_index(drop=True).groupby("label"):
                c = centroids.get(label)
                if c is None:
                    continue
                near = np.argsort(-(_matrix(g["unit"]) @ c.T), axis=1, kind="stable")[:, :overlap]
                for at, s in zip(g.index, np.sort(near, 1).tolist()):
                    shards[at] = s
            yield b.assign(shards=shards)

    return classes.mapInPandas(run, "label string, node bigint, size bigint, unit array<double>, shards array<int>")


def _shard_rows(assigned: DataFrame) -> DataFrame:
    """One row per vector and shard piece it is stored in or queries."""
    rows = assigned.withColumn("shard", F.explode("shards"))
    pieces = rows.groupBy("label", "shard").agg(F.ceil(F.count("*") / F.lit(float(PIECE))).cast("int").alias("pieces"))
    rows = rows.join(pieces, ["label", "shard"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return rows.select("label", "shard", "piece", (F.col("own") == F.col("piece")).alias("member"), "node", "size", "unit", "shards")


def _search(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): n vectors linked with a (b null), and links a - b that connect a shard's vectors."""
    def build(g: pd.DataFrame) -> pd.DataFrame:
        node = g["node"].to_numpy()
        return pd.DataFrame({"label": g["label"], "node": node, "next": [node[a].tolist() for a in build_graph(_matrix(g["unit"]))]})

    lists = rows.where("member").groupBy("label", "shard", "piece").applyInPandas(build, "label string, node bigint, next array<bigint>")
    union = lists.groupBy("label", "node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
    ready = rows.join(union, ["label", "node"], "left")

    def search(g: pd.DataFrame) -> pd.DataFrame:
        stored = g[g["member"]]
        if not len(stored):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        shard, x, ids = int(g["shard"].iloc[0]), _matrix(stored["unit"]), stored["node"].to_numpy()
        at = {i: k for k, i in enumerate(ids.tolist())}
        near = [[at[j] for j in a if j in at] for a in stored["next"]]
        adjacency = np.full((len(x), max(1, max(map(len, near)))), -1, np.int64)
        for k, a in enumerate(near):
            adjacency[k, :len(a)] = a
        sizes, of = stored["size"].to_numpy(), stored["shards"].tolist()
        mine, own = g["node"].to_numpy(), [set(map(int, s)) for s in g["shards"]]
        up, out = {}, []

        def find(i: int) -> int:
            while up.setdefault(i, i) != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for k, found in range_search(_matrix(g["unit"]), x, adjacency, medoids(x, ENTRIES), threshold):
            a, n = int(mine[k]), 0
            for j in found.tolist():
                b = int(ids[j])
                if a == b or min(own[k].intersection(of[j])) != shard:
                    continue
                n += int(sizes[j])
                p, q = find(a), find(b)
                if p != q:
                    up[p] = q
                    out.append((a, b, 0))
            if n:
                out.append((a, None, n))
        return pd.DataFrame({"a": np.array([r[0] for r in out], np.int64), "b": pd.array([r[1] for r in out], "Int64"), "n": np.array([r[2] for r in out], np.int64)})

    return ready.groupBy("label", "shard", "piece").applyInPandas(search, "a bigint, b bigint, n bigint")


def audit(classes: DataFrame, found: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """Share of the links of a bounded number of queries that the search found.

    The lesser share of queries with few and with many links; of all of them
    where either kind holds too few links to tell.
    """
    ask = classes.orderBy(F.xxhash64("node"), "node").limit(queries).toPandas()
    if not len(ask):
        return 1.0
    by = {label: (g["node"].to_numpy(), _matrix(g["unit"])) for label, g in ask.groupby("label")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for label, g in b.groupby("label"):
                if label in by:
                    ids, q = by[label]
                    hit = (q @ _matrix(g["unit"]).T >= threshold) & (ids[:, None] != g["node"].to_numpy()[None, :])
                    yield pd.DataFrame({"a": ids, "t": hit @ g["size"].to_numpy()})

    true = classes.mapInPandas(run, "a bigint, t bigint").groupBy("a").agg(F.sum("t").alias("t")).where("t > 0")
    got = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    kinds = true.join(got, "a", "left").groupBy((F.col("t") <= FEW).alias("few")).agg(
        F.sum("t").alias("t"), F.sum(F.least("t", F.coalesce("n", F.lit(0)))).alias("n")).collect()  # two rows at most
    parts = [(r["n"], r["t"]) for r in kinds]
    if any(t < ENOUGH for _, t in parts):
        parts = [(sum(n for n, _ in parts), sum(t for _, t in parts))]
    return min((float(n / t) for n, t in parts), default=1.0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", overlap: int = 3) -> DataFrame:
    """(id, n_links, component_id, kept, audit_recall) of every vector."""
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                          F.concat_ws("/", F.col(label_col).cast("string"), F.size(vec_col).cast("string")).alias("label"),
                          F.col(label_col).isNotNull().alias("_has"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    # scaled by the largest component first, so that no finite vector overflows
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("_has") & v.isNotNull() & ~bad & (top > 0), F.lit(False))
    rows = rows.withColumn("node", F.when(usable, F.xxhash64("label", "v")))
    good = rows.where("node IS NOT NULL").groupBy("label", "node").agg(F.count("*").alias("size"), F.min("id").alias("rep"), F.first("v").alias("v"))
    scaled = F.transform(v, lambda x: x / top)
    good = good.withColumn("s", scaled)
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    good = good.withColumn("norm", norm)
    classes = stage(good.select("label", "node", "size", "rep", F.transform("s", lambda x: x / F.col("norm")).alias("unit")), "classes")
    core = classes.select("label", "node", "size", "unit")

    centroids = _centroids(core)
    while True:
        assigned = stage(_assign(core, centroids, overlap), "assigned")
        found = stage(_search(_shard_rows(assigned), threshold), "found")
        recall = audit(core, found, threshold)
        if recall >= TARGET or overlap >= MAX_OVERLAP:
            break
        overlap *= 2
    if recall < LEAST:
        raise RuntimeError(f"the search found {recall:.3f} of the audited links with {overlap} shards a vector; {LEAST} are required")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.select("node", "size", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").join(counts, "node", "left").select(
        "node", "component_id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = rows.select("id", "node").join(named, "node", "left")
    return out.select(F.col("id").cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.coalesce("component_id", "id").cast(kind).alias("component_id"),
                      (F.coalesce("component_id", "id") == F.col("id")).alias("kept"), F.lit(recall).alias("audit_recall"))
