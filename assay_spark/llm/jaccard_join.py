"""Operator 3: n-gram Jaccard join in the Jaccard metric space, exact, to components.

Documents with equal shingle sets are one class.  Classes meet as follows.

1. Projected pivots.  The universe of shingles is hashed into m slices, m one
   more than the largest symmetric difference that two linked sets of a size
   class can have.  Two linked sets then agree on a whole slice (pigeonhole), so
   the contents of a slice are pivots whose cells have radius 0.  Size classes
   are windows too: as ||x| - |y|| is at most the difference of x and y, a set
   near a class's edge is replicated into the class below.  With g slices to
   spare, g agree, and one of them is not empty unless both sets have g empty
   slices; such sets are hashed again with the next seed, so the first seed at
   which either set of a pair stops serves the pair.  Sets that never stop give
   single shingles, by prefix filtering, so no link is lost.  Shingles that
   some 80 classes hold (by a sample of a tenth of them; the million most
   frequent) are kept out of the slices, which would else meet in widespread
   passages; this changes the work, not the links.
2. Regions.  The smallest set of a slice's content is its pivot; its cell holds
   all sets that share the content.  Sets within the radius of their pivot link
   to it, and need no comparison with each other: they are connected already.
   A set beyond the radius is compared with those sets whose distance from the
   pivot differs by the radius at most (triangle inequality).
3. Recursion.  A region over ``LEAF`` sets draws random pivots of its own; each
   set goes to its nearest pivot's Voronoi cell and, by the triangle inequality,
   to every cell whose pivot is at most twice the radius further away.  Cells
   are split again for as long as they shrink.  Those that do not (all distances
   alike, as in any metric index of high dimension) are cut into blocks whose
   pairs are dealt to tasks.
4. Leaves are compared exactly and give a spanning forest of their links.

Texts without words, null texts and null ids link with nothing (a null id has a
null component).  Rows that repeat an id are documents of their own; a
component's id is the smallest id of its documents.  Shingles are compared by
64-bit hashes, sets by 128.  Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay_spark.llm.common import may_hold, membership_filter, stage, text_slices, unstage, worker_cache
from assay_spark.llm.components import components

#: Ratio of a size class's ends, seeds tried before single shingles serve as slices.
CLASS_RATIO, SEEDS = 1.25, 6
#: Sets and shingles of a region that one task compares; pivots per region and level.
LEAF, LEAF_SHINGLES, PIVOTS = 384, 800_000, 8
#: A cell is split again if it has at most this part of its region's sets; bits that tell levels apart (never used up at that rate).
SHRINK, LEVELS = 0.7, 62
#: One class in so many tells frequent shingles; how many of those hold one, and the most that are kept.
SAMPLE_PART, FREQUENT, MOST = 10, 8, 1_000_000
#: Words whose hashes a worker remembers: a hash is cheap to take again, and idle workers keep theirs.
WORD_ENTRIES = 400_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class WordHashes:
    """64-bit hashes of words, remembered per worker."""

    def __init__(self) -> None:
        self.cache: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        cache = self.cache
        new = set(words).difference(cache)
        if len(cache) + len(new) > WORD_ENTRIES:
            cache.clear()
            new = set(words)
        for w in new:
            cache[w] = xxhash.xxh64_digest(w)
        return np.frombuffer(b"".join(map(cache.__getitem__, words)), "<u8")


def shingle_set(text: str, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (A-Z lowered, words between ASCII white space)."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h, n = hashes.of(words), min(size, len(words))
    out = _mix(h[:len(h) - n + 1] + np.uint64(n))
    for k in range(1, n):
        out = _mix(out * _C + h[k:len(h) - n + 1 + k])
    return np.unique(out)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128-bit key of a set, as two signed longs."""
    with np.errstate(over="ignore"):
        a, b = _mix(s).sum(dtype=np.uint64), _mix(s ^ _C).sum(dtype=np.uint64)
    return tuple(np.array([a, b]).astype(np.int64).tolist())


def size_classes(limit: int) -> list[int]:
    """Lower ends of the size classes up to ``limit``."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * CLASS_RATIO))))
    return out


def slice_plan(low: int, high: int, percent: int) -> tuple[int, int]:
    """(m, g) for sets of low to high - 1 shingles: slices, and the empty ones that call for the next seed.

    Linked sets differ in fewer than m - g + 1 shingles, so at least g slices agree.
    """
    differ = (high - 1) * (100 - percent) // percent  # of two linked sets, the smaller in this class
    if not differ:
        return 0, 0  # only equal sets link
    for g in range(1, differ + 2):
        empty = (differ + g) * np.exp(-low / (differ + g))
        if g > empty + 1.5 * np.sqrt(empty):
            break
    return differ + g, g


def slice_keys(s: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """Keys of a set's slices, for its size class and those below in whose window it lies.

    Frequent shingles are left out first: what two sets differ in, only shrinks.
    """
    n = len(s)
    ends = size_classes(n)
    own = int(np.searchsorted(ends, n, side="right")) - 1
    low = int(np.searchsorted(ends, -(-n * percent // 100), side="right")) - 1
    common = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(n, bool)
    rare = s[~common]
    out = []
    for c in range(low, own + 1):
        m, g = slice_plan(ends[c], ends[c + 1], percent)
        if not m:
            continue
        for seed in range(SEEDS + 1):
            salt = np.array([c * 1000 + seed], np.uint64)
            if seed == SEEDS or not len(rare):
                # linked sets share one of their first shingles in any fixed order: rare ones, then frequent ones
                first = np.concatenate([rare, s[common]])[:n - -(-n * percent // 100) + 1]
                out.append(_mix(_mix(first + np.array([c * 1000 + SEEDS], np.uint64) * _C) ^ _B))
                break
            v = _mix(rare + salt * _C)
            at = ((v >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
            size = np.bincount(at, minlength=m)
            order = np.argsort(at, kind="stable")
            full = np.flatnonzero(size)
            total = np.add.reduceat(_mix(v[order] ^ _A), (np.cumsum(size) - size)[full])
            out.append(_mix(total + full.astype(np.uint64) * _C + salt))
            if m - len(full) < g:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], text_col: str, size: int):
    hashes = worker_cache("word-hashes", WordHashes)
    for b, texts in text_slices(batches, text_col):
        yield b, [shingle_set(t, size, hashes) for t in texts]


def _inside(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Pairwise intersection sizes, over columns of shingles that several sets hold."""
    all_ = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(all_, kind="stable")
    all_, row = all_[order], row[order]
    new = np.concatenate([[True], all_[1:] != all_[:-1]])
    col = np.cumsum(new) - 1
    keep = np.bincount(col)[col] > 1
    row, col = row[keep], col[keep]
    col = np.unique(col, return_inverse=True)[1] if len(col) else col
    out, step = np.zeros((len(sets), len(sets)), np.float64), 4096
    for lo in range(0, int(col.max()) + 1 if len(col) else 0, step):
        at = slice(*np.searchsorted(col, [lo, lo + step]))
        x = np.zeros((len(sets), step), np.float32)
        x[row[at], col[at] - lo] = 1
        out += x @ x.T
    return out


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    up, out = list(range(n)), []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            up[a] = b
            out.append((i, j))
    return out


def compare_leaf(g: pd.DataFrame, percent: int, level_bits: int) -> list[tuple[str, str]]:
    """Links of one leaf, as a spanning forest."""
    if len(g) < 2:
        return []
    sets = [np.frombuffer(x, "<u8") for x in g["members"]]
    n, near, home, part, node = (g[c].to_numpy() for c in ("n", "near", "home", "part", "node"))
    both = _common(sets)
    ok = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    ok &= (near[:, None] & near[None, :]) == 0
    ok &= (home[:, None] | home[None, :] | ~np.int64(level_bits)) == -1
    if part.any():
        ok &= part[:, None] != part[None, :]
    return [(node[i], node[j]) for i, j in _forest(len(g), np.argwhere(np.triu(ok, 1)))]


def _compare(leaves: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of all leaves; leaves are dealt to buckets, each compared on its own."""
    rows = leaves.count()
    buckets = max(1, rows // 256)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, leaf in g.groupby("leaf", sort=False):
            out += compare_leaf(leaf, percent, int(leaf["levels"].iloc[0]))
        return pd.DataFrame(out, columns=["a", "b"])

    dealt = leaves.withColumn("_bucket", F.pmod(F.xxhash64("leaf"), F.lit(buckets)))
    return dealt.join(sets, "node").groupBy("_bucket").applyInPandas(run, "a string, b string")


def _measure(percent: int, keep: list[str]):
    """Distances of sets (members, n) from pivots (pivot, np), for mapInPandas."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            same = np.array([_inside(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(b["members"], b["pivot"])], np.int64)
            u = b["n"].to_numpy() + b["np"].to_numpy() - same if len(b) else same
            yield b[keep].assign(near=100 * same >= percent * u, d=1 - same / np.maximum(u, 1))

    return run


def _split(rows: DataFrame, sizes: DataFrame, sets: DataFrame, level: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Voronoi cells of random pivots of each region: (rows of the cells, links to pivots)."""
    r = 1 - percent / 100
    draw = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    pivots = rows.join(sizes.select("region", "sets"), "region").where(draw < F.lit(float(PIVOTS)) / F.col("sets"))
    pivots = pivots.join(sets, "node").select("region", F.col("node").alias("pnode"), F.col("n").alias("np"), F.col("members").alias("pivot"))
    d = rows.select("region", "node", "n").join(sets, "node").join(pivots, "region").mapInPandas(
        _measure(percent, ["region", "node", "pnode"]), "region string, node string, pnode string, near boolean, d double")
    d = stage(d, "distances")
    first = d.groupBy("region", "node").agg(F.min(F.struct("d", "pnode")).alias("home"))
    cell = d.join(first, ["region", "node"]).where(F.col("d") <= F.col("home.d") + 2 * r + 1e-9).select(
        "region", "node", "pnode", F.col("near").cast("bigint").alias("_near"), (F.col("pnode") == F.col("home.pnode")).cast("bigint").alias("_home"))
    made = rows.join(sizes.select("region", F.col("sets").alias("_was")), "region").join(cell, ["region", "node"], "left").select(
        F.concat_ws("/", "region", "pnode").alias("region"), "node", "n",  # a region that drew no pivot stays as it is
        F.col("near").bitwiseOR(F.shiftleft(F.coalesce("_near", F.lit(0).cast("bigint")), level)).alias("near"),
        F.col("home").bitwiseOR(F.shiftleft(F.coalesce("_home", F.lit(0).cast("bigint")), level)).alias("home"),
        F.col("levels").bitwiseOR(F.when(F.col("pnode").isNotNull(), F.lit(1 << level)).otherwise(F.lit(0)).cast("bigint")).alias("levels"),
        F.col("_was").alias("was"))
    return stage(made, "cells"), d.where("near").select(F.col("node").alias("a"), F.col("pnode").alias("b"))


def _sizes(rows: DataFrame) -> DataFrame:
    s = rows.groupBy("region").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"), F.first("was").alias("was"))
    return s.withColumn("cells", F.greatest(F.ceil(F.col("sets") / LEAF), F.ceil(F.col("shingles") / LEAF_SHINGLES)).cast("int"))


def _as_leaves(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("region").alias("leaf"), F.lit(0).alias("part"), "node", "n", "near", "home", "levels")


def _as_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks of regions that no pivot separates, each pair of blocks a leaf."""
    block = rows.join(sizes.select("region", "cells"), "region").withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("cells")).cast("int"))
    return block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select(
        F.concat_ws("|", "region", F.least("block", "other"), F.greatest("block", "other")).alias("leaf"),
        (F.col("block") > F.col("other")).cast("int").alias("part"), "node", "n", "near", "home", "levels")


def join_regions(rows: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """Edge tables of all links inside regions, except between sets that share a near pivot.

    ``rows`` are who is where (region, node, n, near); ``sets`` has the members
    of each node.  Regions are split as long as that makes them smaller: a cell
    of more than ``SHRINK`` of its region's sets is cut into blocks instead.
    Members are joined where distances are taken, and to leaves.
    """
    zero = F.lit(0).cast("bigint")
    rows = rows.select("region", "node", "n", "near", zero.alias("home"), zero.alias("levels"), F.lit(None).cast("bigint").alias("was"))
    edges, level = [], 1
    while True:
        sizes = stage(_sizes(rows), "sizes")
        fits, large = F.col("cells") <= 1, F.col("cells") > 1
        parted = F.coalesce(F.col("sets") <= F.col("was") * SHRINK, F.lit(True)) & F.lit(level < LEVELS)
        of = lambda which: rows.join(sizes.where(which).select("region"), "region", "left_semi")
        edges.append(_compare(_as_leaves(of(fits)), sets, percent))
        if not sizes.where(large).limit(1).count():
            return edges
        if sizes.where(large & ~parted).limit(1).count():
            edges.append(_compare(_as_blocks(of(large & ~parted), sizes.where(large & ~parted)), sets, percent))
        if not sizes.where(large & parted).limit(1).count():
            return edges
        rows, linked = _split(of(large & parted), sizes.where(large & parted), sets, level, percent)
        edges.append(linked)
        level += 1


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id): components of links of at least ``percent`` % Jaccard similarity."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, "text", shingle):
            k = [set_key(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.int64())],
                ["id", "n", "k1", "k2"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b, sets in _sets(batches, "text", shingle):
            key, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for s in sets:
                k = set_key(s)[0] if len(s) else None
                if k is None or k in done:
                    continue
                if len(done) < 200_000:
                    done.add(k)
                key.append(slice_keys(s, percent, often.value))
                of.append(np.full(len(key[-1]), k, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(of))], ["key", "k1"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, "text", shingle):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["s"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (b.filter(pa.array(may_hold(filter_.value, b.column(2).to_numpy()))) for b in batches)
        for b, sets in _sets(wanted, "text", shingle):
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{k[0]}:{k[1]}" for k in map(set_key, sets)]), pa.array([set_key(s)[0] for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["node", "k1", "n", "members"])

    sets = stage(docs.mapInArrow(keys, f"id {kind}, n bigint, k1 bigint, k2 bigint"), "sets")
    linked = docs.where("id IS NOT NULL")
    # frequent shingles, from a tenth of the classes; any list gives the same links, a good one fewer comparisons
    nodes = stage(sets.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("rep")), "nodes")
    some = F.pmod(F.xxhash64("id"), F.lit(SAMPLE_PART)) == 0
    reps = nodes.select(F.col("rep").alias("id")).where(some)
    often = linked.where(some).join(reps, "id", "left_semi").mapInArrow(each, "s bigint").groupBy("s").agg(F.count("*").alias("c"))
    often = often.where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "s").limit(MOST).select("s").toArrow()  # MOST numbers
    often = spark.sparkContext.broadcast(np.sort(often["s"].to_numpy().view(np.uint64)))
    # one shuffle by slice content
    met = linked.mapInArrow(slices, "key bigint, k1 bigint")
    met = met.withColumn("p", F.min("k1").over(Window.partitionBy("key"))).where("k1 != p")
    star = stage(met.select("k1", "p").distinct(), "star")

    no = F.lit(False)
    active = star.select("k1", no.alias("pivot")).unionByName(star.select(F.col("p").alias("k1"), (~no).alias("pivot")))
    active = active.groupBy("k1").agg(F.max("pivot").alias("is_pivot"))
    # texts stay where they are read: a filter of fixed size picks the few whose sets are shipped
    reps = nodes.join(active, "k1").select(F.xxhash64(F.col("rep")).alias("h"))
    filter_ = spark.sparkContext.broadcast(membership_filter(reps, "h"))
    active_sets = linked.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(
        members, "node string, k1 bigint, n bigint, members binary")
    active_sets = stage(active_sets.join(active, "k1").groupBy("node", "k1", "n", "is_pivot").agg(F.first("members").alias("members")), "members")

    pivot = active_sets.where("is_pivot").select(F.col("k1").alias("p"), F.col("node").alias("pnode"), F.col("n").alias("np"), F.col("members").alias("pivot"))
    cell = star.join(active_sets.drop("is_pivot"), "k1").join(pivot, "p").mapInPandas(
        _measure(percent, ["pnode", "node", "n"]), "pnode string, node string, n bigint, near boolean, d double")
    cell = stage(cell.withColumnRenamed("pnode", "region"), "cells")
    beyond = cell.where("NOT near").groupBy("region").agg(F.min("d").alias("least"))
    window = cell.join(beyond, "region").where(~F.col("near") | (F.col("d") >= F.col("least") - (1 - percent / 100) - 1e-9))
    rows = stage(window.select("region", "node", "n", F.col("near").cast("bigint").alias("near")), "regions")
    edges = join_regions(rows, active_sets.select("node", "members"), percent)
    links = cell.where("near").select(F.col("node").alias("a"), F.col("region").alias("b"))
    for e in edges:
        links = links.unionByName(e)
    roots = stage(components(links), "roots")
    unstage(star, active_sets, cell, rows)

    named = nodes.withColumn("node", F.concat_ws(":", "k1", "k2")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("k1", "k2", "component_id")
    out = sets.join(named, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).cast(kind).alias("component_id"))
