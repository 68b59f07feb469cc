"""Distance operators: exact k-nearest neighbours, RBF kernel, centroid
assignment (J7, J8, C2, L7).

kNN is exact and never materialises the test x train pair table.  Groups
are bounded on both sides: train rows of a cell fall into blocks, test rows
into chunks, of BLOCK_BYTES or BLOCK_ROWS and GROUP_BYTES or GROUP_ROWS at most;
Spark shuffles both, packed, to (cell, chunk, block) keys, each cogroup walks its chunk x block
distances in tiles of bounded size (in many dimensions single-precision products, from
which the few that may be near are measured again) and keeps every test row's k best, and a
window keeps the k best over blocks.  A hot cell just has more keys, so no
task sees more than one chunk and one block; rows are copied once per group
they meet, so groups are as large as memory allows, not small.
With pivots the blocks belong to pivot partitions, and a test row is sent
only to those that the triangle inequality does not rule out.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay_spark import constants as C
from assay_spark.functions import arrays as A
from assay_spark.functions import packed as P
from assay_spark.functions.keys import draw_int
from assay_spark.operators.sampling import _attach, _list
from assay_spark.session import materialize

# most bytes of centre vectors held as one array or one collected block
CENTRE_BYTES = 4 << 20
# hard cap on rows that meet the pivots or the centres in one group
MAX_BLOCK_ROWS = 8192
# most vector bytes and rows of a test chunk and of a train block, and the blocks
# that a cell, and all cells together, are cut into below that
GROUP_BYTES, BLOCK_BYTES = 16 << 20, 64 << 20
GROUP_ROWS, BLOCK_ROWS = 32768, 131072
CELL_BLOCKS, GRID_BLOCKS = 8, 32
# distances held at once, and the width from which a matrix product finds candidates
TILE = 1 << 22
PRODUCT_WIDTH = 4
# rows and columns of a product that stays in the processor's cache, and vector entries
# of the candidates that are measured at once
PRODUCT_ROWS, PRODUCT_COLS = 1024, 1024
MEASURED = 1 << 16
# squared distance from the mean train row, in those of the furthest one, up to which
# single precision serves
FAR_OFF = 1e4
# distances that are work enough for a task of its own
TASK_PAIRS = 1 << 26
# most pivots of a cell, the train rows of a cell from which they pay, and the
# width up to which they do: in more dimensions they rule out next to nothing
MAX_PIVOTS = 256
PRUNE_ROWS = 16 * 256
PRUNE_WIDTH = 8


def _sizes(te: DataFrame, tr: DataFrame, by: list, block_rows: int, chunk_rows: int) -> DataFrame:
    """Per cell: train rows, width, number of pivots, train blocks and test
    chunks, and the rows they hold at most."""
    tn = tr.groupBy(*by).agg(F.count(F.lit(1)).alias("_tn"), F.max(F.size("_x")).alias("_w"))
    qn = te.groupBy(*by).agg(F.count(F.lit(1)).alias("_qn"))
    s = tn.join(qn, by, "inner") if by else _attach(tn, qn, [])
    def most(rows: int, size: int):
        wide = 8 * (F.greatest("_w", F.lit(0)) + 8)
        return F.greatest(F.lit(1.0), F.least(F.lit(float(rows)), F.floor(F.lit(float(size)) / wide)))

    # a row is copied once per group it meets: a cell is cut into CELL_BLOCKS
    # blocks, enough to spread it, into fewer where other cells spread the work,
    # and into more only where they grow too large
    s = s.withColumn("_all", F.sum("_tn").over(Window.partitionBy(F.lit(0))))
    size = F.greatest(F.lit(float(block_rows)), F.ceil(F.col("_tn") / CELL_BLOCKS), F.ceil(F.col("_all") / GRID_BLOCKS))
    size = F.least(size, most(BLOCK_ROWS, BLOCK_BYTES))
    chunk = F.greatest(F.least(F.lit(float(chunk_rows)), most(GROUP_ROWS, GROUP_BYTES)), F.lit(1.0))
    pivots = F.ceil(F.col("_tn") / F.lit(float(block_rows))).cast("int").alias("_np")
    return s.select(*by, "_tn", "_qn", "_w", pivots, F.greatest(F.lit(1), F.ceil(F.col("_tn") / size)).cast("int").alias("_nb"),
                    F.greatest(F.lit(1), F.ceil(F.col("_qn") / chunk)).cast("int").alias("_nc"),
                    size.alias("_rows"), chunk.alias("_chunk"))


def _zip_groups(left: DataFrame, right: DataFrame, keys: list, fn, schema: str) -> DataFrame:
    """Cogroup by ``keys``.  They match by position; the right side's are
    renamed because both sides may come from one DataFrame (a split)."""
    other = right.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(keys)],
                         *[c for c in right.columns if c not in keys])
    return left.groupBy(*keys).cogroup(other.groupBy(*[f"_t{i}" for i in range(len(keys))])).applyInPandas(fn, schema)


def _key_ddl(df: DataFrame, by: list) -> list:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"`{c}` {types[c]}" for c in by]


def _table(q, t):
    """Squared distances between two frames' vectors, summed dimension by
    dimension from left to right: equal distances then round identically to
    a sequential SQL sum, so ties break by id the same way everywhere, and
    only one table is held."""
    import numpy as np

    qx, tx = (np.stack(f["_x"].to_numpy()).astype(float) for f in (q, t))
    d = np.zeros((len(qx), len(tx)))
    for j in range(tx.shape[1]):
        d += (qx[:, j, None] - tx[None, :, j]) ** 2
    return d


def _tile_least(x, tx, kk: int):
    """(row, column, squared distance) of every entry that may be among its
    row's ``kk`` least; the distances are those of ``_table``.

    In many dimensions a matrix product finds the candidates: whatever its
    rounding may hide is a candidate too, and all candidates are measured
    again, dimension by dimension.
    """
    import numpy as np

    width = tx.shape[1]
    a, b = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", tx, tx)
    if width > PRODUCT_WIDTH and a.max() < 1e300 and b.max() < 1e300:
        d = x @ tx.T
        d *= -2.0
        d += a[:, None]
        d += b
        slack = 1e-15 * (width + 8) * (a + b.max()) + 1e-290
        row, col = np.nonzero(d <= (np.partition(d, kk - 1, axis=1)[:, kk - 1] + 4 * slack)[:, None])
        del d
        dist = np.zeros(len(row))
        for j in range(width):
            dist += (x[row, j] - tx[col, j]) ** 2
        return row, col, dist
    d = np.zeros((len(x), len(tx)))
    for j in range(width):
        d += (x[:, j, None] - tx[None, :, j]) ** 2
    row, col = np.nonzero(~(d > np.partition(d, kk - 1, axis=1)[:, kk - 1, None]))  # at least kk a row, more on ties
    return row, col, d[row, col]


def _least(q, t, k: int):
    """(row, column, squared distance) of every test row's k least entries,
    ties to the smaller column, none beyond the row's ``_far``, if it has one.

    In few dimensions both sides are walked along their widest one, and a
    tile of test rows meets only the train rows within its reach there.
    """
    import numpy as np

    qx, tx = (np.stack(f["_x"].to_numpy()).astype(float) for f in (q, t))
    return _least_rows(qx, tx, k, q["_far"].to_numpy(dtype=float) if "_far" in q else np.full(len(q), np.inf))


def _first_copies(x, k: int):
    """Numbers of the rows that fewer than ``k`` equal ones precede."""
    import numpy as np

    code = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    code = code[order]
    return np.sort(order[np.arange(len(code)) - np.searchsorted(code, code) < k])


def _set_places(mask):
    """Places of the few set entries of a contiguous mask: its words first, then their bytes."""
    import numpy as np

    if mask.size % 8:
        return np.flatnonzero(mask)
    words = np.flatnonzero(mask.reshape(-1).view(np.uint64) != 0)
    word, at = np.nonzero(mask.reshape(-1, 8)[words])
    return words[word] * 8 + at


def _exact(qx, tx, row, col):
    """Squared distances of the listed pairs, summed as those of ``_table``."""
    import numpy as np

    dist, step = np.zeros(len(row)), max(1, MEASURED // qx.shape[1])
    for at in range(0, len(row), step):
        apart = qx[row[at:at + step]]
        apart -= tx[col[at:at + step]]
        apart *= apart
        dist[at:at + step] = np.cumsum(apart, axis=1, out=apart)[:, -1]  # from left to right
    return dist


def _least_wide(qx, tx, k: int, far):
    """``_least`` of two matrices of many dimensions, no limit being NaN, after
    the numbers of the test rows that are left out: those not finite or far off
    the train rows, or all if the train rows are not finite, too large or too small.

    A product in single precision says which distances may be among the least:
    with the centred and scaled rows q and t, and e above all rounding,
    q.t - (1 - 2e) t.t/2 is at least ((1 - e) q.q - d)/2 wherever q and t are no
    further apart than d.  d is the k-th least so far; it is settled anew
    whenever the columns met have doubled, so only few entries a row are ever
    measured, as those of ``_table``.  Products are small enough for the cache.
    """
    import numpy as np

    n, width = tx.shape
    with np.errstate(over="ignore", invalid="ignore"):
        mid = tx.mean(axis=0)
        q, t = qx - mid, tx - mid
        a, b = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", t, t)
    top = b.max()
    met = a <= FAR_OFF * top if 1e-280 < top < 1e290 else np.zeros(len(a), bool)
    rest, met = np.flatnonzero(~met), np.flatnonzero(met)
    if not len(met):
        return rest, np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if len(rest):
        qx, q, a, far = qx[met], q[met], a[met], far[met]
    e = (width + 8) * 2.0 ** -23
    a, b, limit = a / top, b / top, far / top
    q /= np.sqrt(top)
    t /= np.sqrt(top)
    q = np.hstack([q.astype(np.float32), np.ones((len(q), 1), np.float32)])
    t, wide = np.empty((width + 1, n), np.float32), t
    t[:width], t[width] = wide.T, (2 * e - 1) * b / 2
    del wide
    ahead, most, out = b.max(), max(1, TILE // 8), []
    tile = min(PRODUCT_ROWS, len(q)), max(PRODUCT_COLS, 2 * k)
    products, masks = np.empty(tile, np.float32), np.empty(tile, bool)  # one memory for all tiles

    for start in range(0, len(q), PRODUCT_ROWS):
        x, a_x = q[start:start + PRODUCT_ROWS], a[start:start + PRODUCT_ROWS]
        kth = limit[start:start + PRODUCT_ROWS].copy()  # scaled

        def least():
            """From where on the product says near, rounded down."""
            h = ((1 - e) * a_x - kth * (1 + 4e-15 * (width + 8)) - 1e-36 * width) / 2
            return np.nextafter(h.astype(np.float32), np.float32(-np.inf))[:, None]

        row, col, dist = np.zeros(0, int), np.zeros(0, int), np.zeros(0)

        def settled(found):
            """The k least so far and those ``found``; the k-th becomes the bound."""
            nonlocal row, col, dist, kth
            r, c = (np.concatenate(p) for p in zip(*found))
            d = _exact(qx, tx, r + start, c)
            held = np.bincount(row, minlength=len(x))
            # columns rise: one as far as the k-th held so far comes after it
            last = np.full(len(x), np.inf)
            full = np.flatnonzero(held >= k)
            last[full] = dist[np.searchsorted(row, full) + k - 1]
            keep = (d < last[r]) & ~(d > far[start + r])
            r, c, d = (np.concatenate(p) for p in ((row, r[keep]), (col, c[keep]), (dist, d[keep])))
            near = np.lexsort((c, d, r))
            near = near[np.arange(len(r)) - np.searchsorted(r[near], r[near]) < k]
            row, col, dist = r[near], c[near], d[near]
            full = np.flatnonzero(np.bincount(row, minlength=len(x)) >= k)
            kth[full] = np.minimum(kth[full], dist[np.searchsorted(row, full) + k - 1] / top)

        lo, span, bound = 0, min(n, max(PRODUCT_COLS, 2 * k)), least()
        while lo < n:
            end, found, size = min(n, lo + span), [], 0
            while lo < end:
                hi = min(end, lo + (span if lo == 0 else PRODUCT_COLS))
                g, near = (m.reshape(-1)[:len(x) * (hi - lo)].reshape(len(x), hi - lo) for m in (products, masks))
                np.matmul(x, t[:, lo:hi], out=g)
                if lo == 0 and hi >= k:  # some k entries: the k least are no further away
                    some = np.partition(g, hi - k, axis=1)[:, hi - k].astype(float) - 2 * e * (a_x + ahead)
                    bound = np.maximum(bound, np.nextafter(some.astype(np.float32), np.float32(-np.inf))[:, None])
                np.greater_equal(g, bound, out=near)
                r, c = np.divmod(_set_places(near), hi - lo)
                found.append((r, c + lo))
                size, lo = size + len(r), hi
                if size > most:
                    settled(found)
                    found, size, bound = [], 0, least()
            if size:
                settled(found)
            bound, span = least(), lo
        out.append((met[row + start], col, dist))
    return rest, *(np.concatenate(p) for p in zip(*out))


def _least_rows(qx, tx, k: int, far):
    """``_least`` of two matrices."""
    import numpy as np

    far = np.where(np.isnan(far), np.inf, far)
    order, at, out = np.arange(len(tx)), np.arange(len(qx)), []
    if tx.shape[1] > PRUNE_WIDTH and len(qx) and len(tx):
        order = _first_copies(tx, k)  # of equal rows only the first k can be among the k least
        tx = tx[order] if len(order) < len(tx) else tx
        at, row, col, dist = _least_wide(qx, tx, k, far)
        out.append((row, order[col], dist))
    walk = 0 < tx.shape[1] <= PRUNE_WIDTH and np.isfinite(tx).all() and np.isfinite(qx).all()
    if walk:
        axis = np.ptp(tx, axis=0).argmax()
        order, at = np.argsort(tx[:, axis], kind="stable"), np.argsort(qx[:, axis], kind="stable")
        tx = tx[order]
        line = tx[:, axis]
    step = min(256, max(1, TILE // len(tx))) if walk else max(1, TILE // len(tx))
    for start in range(0, len(at), step):
        rows = at[start:start + step]
        x, lo, hi = qx[rows], 0, len(tx)
        if walk:
            ends = x[0, axis], x[-1, axis]
            lo, hi = np.searchsorted(line, ends)
            lo, hi = max(0, min(lo - 2 * k, len(tx) - k)), min(len(tx), hi + 2 * k)
            reach = far[rows]
            if hi - lo >= k:  # some k rows: the k least are no further away
                d = np.zeros((len(x), hi - lo))
                for j in range(tx.shape[1]):
                    d += (x[:, j, None] - tx[None, lo:hi, j]) ** 2
                reach = np.minimum(reach, np.partition(d, k - 1, axis=1)[:, k - 1])
            reach = np.sqrt(reach.max()) * (1 + 1e-9) + 1e-12 * (abs(ends[0]) + abs(ends[1]))
            lo, hi = np.searchsorted(line, ends[0] - reach), np.searchsorted(line, ends[1] + reach, side="right")
        kk = min(k, hi - lo)
        if not kk:
            continue
        row, col, dist = _tile_least(x, tx[lo:hi], kk)
        col = order[lo + col]
        near = np.lexsort((col, dist, row))
        row, col, dist = row[near], col[near], dist[near]
        keep = (np.arange(len(row)) - np.searchsorted(row, row) < kk) & ~(dist > far[rows[row]])
        out.append((rows[row[keep]], col[keep], dist[keep]))
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


class _Sent:
    """Rows of one side on their way to the groups they meet, packed."""

    def __init__(self, rows: DataFrame, keys: list, rest: list):
        self.packed = P.pack(rows, keys, "_x", ["_id", *(c for c in rest if c in rows.columns)])

    def copied(self, name: str, number: str) -> "_Sent":
        """A copy for each ``name`` below ``number``: packed rows are copied, not single ones."""
        self.packed = self.packed.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(number) - 1))).drop(number)
        return self

    def count(self) -> int:
        return self.packed.agg(F.sum(F.size("_id"))).first()[0] or 0


def _block_nearest(te: _Sent, tr: _Sent, by: list, keys: list, k: int) -> DataFrame:
    """The k nearest train rows of each test row within every group of
    ``keys``, except those beyond its ``_far`` (squared), if it has one.
    Rows travel packed: many cells of few distinct values are few bytes."""
    import numpy as np
    import pandas as pd

    cols = by + ["_qid", "nn_id", "nn_dist2", "nn_y"]

    def nearest(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(t) == 0:
            return pd.DataFrame(columns=cols)
        qid, tid, ty = P.column(q, "_id"), P.column(t, "_id"), P.column(t, "_y").astype(float)
        qx, tx = P.matrix(q, len(qid)), P.matrix(t, len(tid))
        limit = P.column(q, "_far").astype(float) if "_far" in q else np.full(len(qid), np.inf)
        if len(np.unique(qid)) < len(qid):  # a repeated test id is one query, the same one in every block
            at = np.lexsort((*qx.T[::-1], qid))
            at = at[np.unique(qid[at], return_index=True)[1]]
            qid, qx, limit = qid[at], qx[at], limit[at]
        at = np.argsort(tid, kind="stable")  # column order is then id order
        tid, tx, ty = tid[at], tx[at], ty[at]
        row, col, dist = _least_rows(qx, tx, k, limit)
        res = pd.DataFrame({"_qid": qid[row], "nn_id": tid[col], "nn_dist2": dist, "nn_y": ty[col]})
        for c in by:
            res[c] = q[c].iat[0]
        return res[cols]

    schema = ", ".join([*_key_ddl(tr.packed, by), "_qid long", "nn_id long", "nn_dist2 double", "nn_y double"])
    return _zip_groups(te.packed, tr.packed, keys, nearest, schema)


def _few(d: DataFrame, small: DataFrame, by: list) -> DataFrame:
    """``_attach`` for a table bounded by the grid of cells: the rows are not shuffled for it."""
    return _attach(d, F.broadcast(small) if by else small, by)


def _tasks(sizes: DataFrame) -> int:
    """Tasks that the groups of all cells are worth: two a group, so that few
    share one, if each has TASK_PAIRS distances."""
    groups, pairs = sizes.agg(F.sum(F.col("_nb") * F.col("_nc")), F.sum(F.col("_tn") * F.col("_qn").cast("double"))).first()
    return int(min(2 * (groups or 0), (pairs or 0) // TASK_PAIRS))


def _all_blocks(te: DataFrame, tr: DataFrame, sizes: DataFrame, by: list, k: int) -> DataFrame:
    """Every chunk of test rows against every block of train rows; rows are
    packed before they are copied to the groups they meet."""
    tr = _few(tr, sizes, by).withColumn("_blk", F.pmod(draw_int("_id", seed=17), F.col("_nb")).cast("int"))
    tr = _Sent(tr, [*by, "_blk", "_nc"], ["_y"]).copied("_chk", "_nc")
    te = _few(te, sizes, by).withColumn("_chk", F.pmod(draw_int("_id", seed=19), F.col("_nc")).cast("int"))
    te = _Sent(te, [*by, "_chk", "_nb"], ["_far"]).copied("_blk", "_nb")
    keys, tasks = [*by, "_chk", "_blk"], _tasks(sizes)
    if tasks > sizes.sparkSession.sparkContext.defaultParallelism:  # packed groups are few bytes of much work: not to be merged
        for side in (te, tr):
            side.packed = side.packed.repartition(tasks, *keys)
    return _block_nearest(te, tr, by, keys, k)


def _asked_blocks(te: DataFrame, tr: DataFrame, sizes: DataFrame, by: list, k: int) -> DataFrame:
    """Test rows against the blocks (``_part``, ``_sub``) they name; a block
    that many name meets them in chunks, one that none names is not sent."""
    keys = [*by, "_part", "_sub"]
    nc = _few(te.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), sizes.select(*by, "_chunk"), by)
    nc = nc.select(*keys, F.ceil(F.col("_n") / F.col("_chunk")).cast("int").alias("_nc"))
    tr = _few(tr, nc, keys).withColumn("_chk", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)))
    te = _few(te, nc, keys).withColumn("_chk", F.pmod(draw_int("_id", seed=19), F.col("_nc")).cast("int"))
    keys = [*keys, "_chk"]
    return _block_nearest(_Sent(te, keys, ["_far"]), _Sent(tr, keys, ["_y"]), by, keys, k)


def _pruned_blocks(te: DataFrame, tr: DataFrame, sizes: DataFrame, by: list, k: int, pivots: int) -> DataFrame:
    """Candidates from the pivot partitions that can hold one.

    Each cell draws up to ``pivots`` train rows; every row belongs to its
    nearest pivot.  A first pass meets one block of a test row's own
    partition: its k-th distance there bounds the true one from above.  A
    partition with pivot p, whose rows lie between ``lo`` and ``hi`` from p,
    holds nothing nearer to q than the greatest of d(q,p) - hi, lo - d(q,p)
    and q's distance to the plane between p and its own pivot.  Only blocks
    of partitions below the bound get a second pass; a test row meets the
    pivots again for it, so no list of its bounds is ever stored.
    """
    import numpy as np
    import pandas as pd

    # many branches read these: computed once, and what made them (draws,
    # scalar subqueries) stays out of the joins below
    tr, te = materialize(tr), materialize(te)
    # a partition is cut into hashed blocks, so copies of one row fill many
    cells = sizes.withColumn("_np", F.least(F.lit(int(pivots)), F.greatest("_nb", "_np")))
    drawn = _few(tr, cells, by).withColumn("_slot", F.pmod(draw_int("_id", seed=23), F.col("_np")).cast("int"))
    piv = (drawn.groupBy(*by, "_slot").agg(F.min(F.struct(draw_int("_id", seed=29).alias("h"), "_id", "_x")).alias("_p"))
                .select(*by, F.col("_slot").alias("_part"), F.col("_p._x").alias("_x")))
    piv = materialize(piv)

    def meet(rows: DataFrame, points: DataFrame, fn, schema: list) -> DataFrame:
        """Rows in chunks of about MAX_BLOCK_ROWS with the pivots of their cell."""
        n = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(MAX_BLOCK_ROWS))).cast("int").alias("_nk"))
        rows = _few(rows, n, by).withColumn("_chk", F.pmod(draw_int("_id", seed=31), F.col("_nk")).cast("int"))
        points = _few(points, n, by).withColumn("_chk", F.explode(F.sequence(F.lit(0), F.col("_nk") - 1)))
        return _zip_groups(rows.drop("_nk"), points.drop("_nk"), [*by, "_chk"], fn,
                           ", ".join([*_key_ddl(rows, by), *schema]))

    def home(rows: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        cols = by + ["_id", "_x", "_y", "_part", "_d"]
        if len(rows) == 0 or len(points) == 0:
            return pd.DataFrame(columns=cols)
        points = points.sort_values("_part")
        d = np.sqrt(_table(rows, points))
        at = d.argmin(axis=1)
        return rows.assign(_part=points["_part"].to_numpy()[at], _d=d[np.arange(len(at)), at])[cols]

    placed = ["_id long", "_x array<double>", "_y double", "_part int", "_d double"]
    tr = materialize(meet(tr, piv, home, placed))
    part = tr.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    part = _few(part, sizes, by)
    part = materialize(part.select(*by, "_part", "_lo", "_hi", F.ceil(F.col("_n") / F.col("_rows")).cast("int").alias("_ns")))
    blocks = part.select(*by, "_part", "_ns")
    tr = _few(tr, blocks, [*by, "_part"])
    tr = tr.withColumn("_sub", F.pmod(draw_int("_id", seed=17), F.col("_ns")).cast("int")).drop("_ns", "_d")
    points = materialize(_few(piv, part, [*by, "_part"]))

    def reach(rows: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        cols = by + ["_id", "_x", "_far", "_own", "_seen", "_parts"]
        if len(rows) == 0 or len(points) == 0:
            return pd.DataFrame(columns=cols)
        points = points.sort_values("_part")
        lo, hi = points["_lo"].to_numpy(), points["_hi"].to_numpy()
        d2, apart = _table(rows, points), np.sqrt(_table(points, points))
        d = np.sqrt(d2)
        part = points["_part"].to_numpy()
        at = np.searchsorted(part, rows["_part"].to_numpy())
        own = d2[np.arange(len(at)), at][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            # slack far above the rounding of each bound: never prune a tie
            plane = (d2 - own - 1e-9 * (d2 + own)) / (2 * apart[at])
        bound = np.maximum(np.maximum(d - hi, lo - d) - 1e-9 * (d + hi), np.where(np.isfinite(plane), plane, 0.0))
        # fewer than k rows met: no bound, everything may be near
        limit = np.sqrt(rows["_far"].to_numpy(dtype=float)) * (1 + 1e-9)
        near = ~(bound > limit[:, None])
        return rows.assign(_own=part[at], _seen=rows["_sub"], _parts=[part[r] for r in near])[cols]

    te = te.withColumn("_y", F.lit(None).cast("double"))
    te = materialize(meet(te, points.select(*by, "_part", "_x"), home, placed))
    te = _few(te.drop("_y", "_d"), blocks, [*by, "_part"])
    te = te.withColumn("_sub", F.coalesce(F.pmod("_id", F.col("_ns")), F.lit(0)).cast("int")).drop("_ns")
    first = materialize(_asked_blocks(te, tr, sizes, by, k))
    kth = first.groupBy(*by, "_qid").agg(F.count(F.lit(1)).alias("_m"), F.max("nn_dist2").alias("_far"))
    kth = kth.select(*by, F.col("_qid").alias("_id"), F.when(F.col("_m") >= k, F.col("_far")).alias("_far"))
    more = meet(_attach(te, kth, [*by, "_id"], "left"), points, reach,
                ["_id long", "_x array<double>", "_far double", "_own int", "_seen int", "_parts array<int>"])
    more = materialize(more).withColumn("_part", F.explode("_parts")).drop("_parts")
    more = _few(more, blocks, [*by, "_part"])
    more = more.withColumn("_sub", F.explode(F.sequence(F.lit(0), F.col("_ns") - 1))).drop("_ns")
    more = more.filter((F.col("_part") != F.col("_own")) | (F.col("_sub") != F.col("_seen"))).drop("_own", "_seen")
    return first.unionByName(_asked_blocks(more, tr, sizes, by, k))


def knn_join(test: DataFrame, train: DataFrame, k: int = C.KNN_K, by: Sequence[str] = (), id_col: str = "row_id",
             x: str = "x", y: str | None = "y", block_rows: int = 256, chunk_rows: int = GROUP_ROWS,
             pivots: int | None = None) -> DataFrame:
    """For every test row, its ``k`` nearest train rows of the same cell.

    Output: cell keys, test id, ``nn_rank`` 1..k, ``nn_id``, ``nn_dist2``
    (squared Euclidean) and ``nn_y``.  Ties on distance go to the smaller id.
    A test id that repeats within a cell (draws with replacement) is one
    query; repeated train rows count as often as they occur.  Rows whose
    vector is null or holds nulls must be imputed first.

    ``pivots``: partitions per cell that the triangle inequality may leave
    out; 0 compares all blocks.  None prunes with up to MAX_PIVOTS if some
    cell has over PRUNE_ROWS train rows and vectors have PRUNE_WIDTH entries
    at most.  The rows returned are the same.
    """
    by = _list(by)
    ycol = [F.col(y).cast("double").alias("_y")] if y is not None else [F.lit(None).cast("double").alias("_y")]
    tr = train.select(*by, F.col(id_col).cast("long").alias("_id"), F.col(x).cast("array<double>").alias("_x"), *ycol)
    te = test.select(*by, F.col(id_col).cast("long").alias("_id"), F.col(x).cast("array<double>").alias("_x"))
    sizes = materialize(_sizes(te, tr, by, block_rows, chunk_rows))  # one row a cell, read by every branch
    if pivots is None:
        largest, width = sizes.agg(F.max("_tn"), F.max("_w")).first()
        pivots = MAX_PIVOTS if (largest or 0) > PRUNE_ROWS and width <= PRUNE_WIDTH else 0
    if pivots:
        cand = _pruned_blocks(te.dropDuplicates([*by, "_id"]), tr, sizes, by, k, pivots)
    else:
        cand = _all_blocks(te, tr, sizes, by, k)
    w = Window.partitionBy(*by, "_qid").orderBy(F.col("nn_dist2"), F.col("nn_id"))
    c = cand.withColumn("nn_rank", F.row_number().over(w)).filter(F.col("nn_rank") <= k)
    out = [*by, F.col("_qid").alias(id_col), "nn_rank", "nn_id", "nn_dist2"]
    if y is not None:
        out.append("nn_y")
    return c.select(*out)


def knn_regression(test: DataFrame, train: DataFrame, k: int = C.KNN_K, by: Sequence[str] = (),
                   id_col: str = "row_id", x: str = "x", y: str = "y", block_rows: int = 256,
                   chunk_rows: int = GROUP_ROWS) -> DataFrame:
    """k-NN regression (uniform weights): y_hat = mean of the k neighbours' y.
    Output: cell keys, id, y (truth), y_hat."""
    by = _list(by)
    nn = knn_join(test, train, k, by, id_col, x, y, block_rows, chunk_rows)
    pred = nn.groupBy(*by, id_col).agg(F.avg("nn_y").alias("y_hat"))
    truth = test.select(*by, id_col, F.col(y).cast("double").alias("y"))
    return truth.join(pred, by + [id_col], "left")


def _centre_blocks(centres: DataFrame, x: str) -> int:
    """Blocks the centres need so that none passes CENTRE_BYTES or MAX_BLOCK_ROWS."""
    n, width = centres.agg(F.count(F.lit(1)), F.max(F.size(x))).first()
    per = max(1, min(MAX_BLOCK_ROWS, CENTRE_BYTES // (8 * max(1, width or 1))))
    return max(1, -(-n // per))


def _meet_centres(rows: DataFrame, centres: DataFrame, blocks: int, fn, schema: str, chunk_rows: int = 256) -> DataFrame:
    """Every chunk of ``rows`` (_id, _x) with every block of ``centres`` (_c, _x)."""
    chunks = max(1, -(-rows.count() // chunk_rows))
    rows = rows.withColumn("_chk", F.pmod(F.xxhash64("_id"), F.lit(chunks)).cast("int"))
    rows = rows.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    centres = centres.withColumn("_blk", F.pmod(F.xxhash64("_c"), F.lit(blocks)).cast("int"))
    centres = centres.withColumn("_chk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return _zip_groups(rows, centres, ["_chk", "_blk"], fn, schema)


def _packed(centres: DataFrame, key, x: str) -> DataFrame:
    return centres.agg(F.sort_array(F.collect_list(F.struct(key.alias("c"), F.col(x).alias("v")))).alias("_cents"))


def rbf_kernel(df: DataFrame, centres: DataFrame, length: float, id_col: str = "row_id",
               x: str = "x", centre_id: str = "centre_id") -> DataFrame:
    """Kernel table k(a, c) = exp(-|a - c|² / (2 l²)) between every row and
    every centre (landmarks, inducing points, another split's sample).
    Output: row id, ``centre_id``, ``k``; rows x centres entries.

    Centres that fit one block (measured) travel as one array and no row is
    shuffled; more are dealt in blocks that meet chunks of rows.
    """
    import numpy as np
    import pandas as pd

    g = -1.0 / (2.0 * float(length) ** 2)
    blocks = _centre_blocks(centres, x)
    if blocks == 1:
        d = _attach(df.select(id_col, F.col(x).alias("_ax")), _packed(centres, F.col(centre_id), x), [])
        kv = F.transform("_cents", lambda t: F.struct(t["c"].alias("centre_id"),
                                                      F.exp(A.sq_dist(F.col("_ax"), t["v"]) * F.lit(g)).alias("k")))
        return d.select(id_col, F.inline(kv))

    rows = df.select(F.col(id_col).alias("_id"), F.col(x).cast("array<double>").alias("_x"))
    cents = centres.select(F.col(centre_id).alias("_c"), F.col(x).cast("array<double>").alias("_x"))

    def kernel(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(t) == 0:
            return pd.DataFrame(columns=["_id", "_cs", "_ks"])
        ids = t["_c"].to_numpy()
        return pd.DataFrame({"_id": q["_id"], "_cs": [ids] * len(q), "_ks": list(np.exp(_table(q, t) * g))})

    types = {f.name: f.dataType.simpleString() for f in [*rows.schema.fields, *cents.schema.fields]}
    # a vector that is null has null entries with every centre
    known = _meet_centres(rows.filter("_x IS NOT NULL"), cents, blocks, kernel,
                          f"_id {types['_id']}, _cs array<{types['_c']}>, _ks array<double>")
    out = known.select(F.col("_id").alias(id_col), F.inline(F.arrays_zip(F.col("_cs").alias("centre_id"), F.col("_ks").alias("k"))))
    unknown = _meet_centres(rows.filter("_x IS NULL"), cents, blocks,
                            lambda q, t: pd.DataFrame({"_id": q["_id"], "_cs": [t["_c"].to_numpy()] * len(q)}),
                            f"_id {types['_id']}, _cs array<{types['_c']}>")
    return out.unionByName(unknown.select(F.col("_id").alias(id_col), F.explode("_cs").alias("centre_id"),
                                          F.lit(None).cast("double").alias("k")))


def assign(df: DataFrame, centroids: DataFrame, x: str = "x", cluster: str = "cluster",
           centroid_x: str = "centroid") -> DataFrame:
    """Nearest given centroid per row (ties to the smaller cluster id); null
    for a vector that is null.

    Centroids that fit one block (measured) are scanned as one array, so the
    rows are never joined or shuffled; more are dealt in blocks that meet
    chunks of rows, and each row keeps the least of its blocks' answers.
    """
    import numpy as np
    import pandas as pd

    blocks = _centre_blocks(centroids, centroid_x)
    if blocks == 1:
        d = _attach(df, _packed(centroids, F.col(cluster).cast("int"), centroid_x), [])
        best = F.array_min(F.transform(F.col("_cents"),
                                       lambda t: F.struct(A.sq_dist(F.col(x), t["v"]).alias("d"), t["c"].alias("c"))))
        best = F.when(F.col(x).isNotNull(), best)
        return d.withColumns({cluster: best["c"], "dist2": best["d"]}).drop("_cents")

    # a checkpoint fixes the row numbers that the answers come back by
    rows = materialize(df.withColumn("_rid", F.monotonically_increasing_id()))
    asks = rows.filter(F.col(x).isNotNull()).select(F.col("_rid").alias("_id"), F.col(x).cast("array<double>").alias("_x"))
    cents = centroids.select(F.col(cluster).cast("int").alias("_c"), F.col(centroid_x).cast("array<double>").alias("_x"))

    def least(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(t) == 0:
            return pd.DataFrame(columns=["_id", "_d", "_c"])
        t = t.sort_values("_c", kind="stable")
        d = _table(q, t)
        at = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
        return pd.DataFrame({"_id": q["_id"], "_d": d[np.arange(len(at)), at], "_c": t["_c"].to_numpy()[at]})

    best = (_meet_centres(asks, cents, blocks, least, "_id long, _d double, _c int")
            .groupBy(F.col("_id").alias("_rid")).agg(F.min(F.struct("_d", "_c")).alias("_b")))
    out = rows.drop(cluster, "dist2").join(best, "_rid", "left")
    return out.withColumns({cluster: F.col("_b._c"), "dist2": F.col("_b._d")}).drop("_rid", "_b")
