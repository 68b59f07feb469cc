"""Exact, repeatable sampling and splitting.

All draws order rows by an md5 key (``functions.keys``), so results do not
depend on partitioning and match a plain ``row_number() OVER (PARTITION BY g
ORDER BY key, id)`` in SQL.

Skew: a window partitioned by the group alone would put a hot group (say a
third of all rows) into one task.  ``rank_within`` instead splits every group
into 4096 hash buckets, counts rows per bucket (partial aggregation, only
counts are shuffled), turns the counts into per-bucket offsets, and ranks
inside (group, bucket) only.  With a row limit, rows past it are dropped
map-side before anything is shuffled: without group keys the offsets (at
most 4096 rows, a proven bound) are broadcast; with group keys each group's
last needed bucket (one row per group) filters the rows first.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay_spark import constants as C
from assay_spark.functions.keys import KEY_BITS, draw_int, permuted

BUCKET_BITS = 12


def _list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def rank_within(df: DataFrame, by: Sequence[str], order_col: str, tiebreak: Sequence[str],
                limit=None, out: str = "rank", bucket_bits: int = BUCKET_BITS,
                group_fn=None) -> DataFrame:
    """Exact 1-based rank of each row inside its ``by`` group, ordered by
    (``order_col``, ``tiebreak``...).  ``order_col`` must be a non-negative
    bigint below 2**60 (a draw key).

    ``limit``: None (rank every row), an int, or the name of a column that is
    constant inside each group; rows ranked past it are dropped.

    ``group_fn``: optional function of the small per-group table
    (``by`` + ``_gn`` = group size, derived from the bucket counts) returning
    it with extra per-group columns (an allocation, a draw size); those
    columns, and ``_gn``, reach the rows through the same join as the bucket
    offsets, so group sizes cost no extra pass over the data.  ``limit`` may
    name one of them.
    """
    by = _list(by)
    tiebreak = _list(tiebreak)
    d = df.withColumn("_b", F.shiftright(F.col(order_col), KEY_BITS - bucket_bits))
    counts = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    extra: list[str] = []
    if group_fn is not None:
        groups = counts.groupBy(*by).agg(F.sum("_n").alias("_gn"))
        groups = group_fn(groups)
        extra = [c for c in groups.columns if c not in by]
        counts = _attach(counts, groups, by)
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    lim = None
    if limit is not None:
        lim = F.col(limit) if isinstance(limit, str) else F.lit(int(limit))
        counts = counts.filter(F.col("_before") < lim)
        if by:
            # prune rows map-side before any shuffle: each group's last
            # needed bucket is one row per group.  (Joining the rows to the
            # offsets directly could plan a shuffle of every row when the
            # groups x buckets table is too big to broadcast.)
            last = counts.groupBy(*by).agg(F.max("_b").alias("_bmax"))
            d = _attach_stats(d, last, by).filter(F.col("_b") <= F.col("_bmax")).drop("_bmax")
    renamed = {k: f"_k{i}" for i, k in enumerate(by)}
    counts = counts.select(*[F.col(k).alias(v) for k, v in renamed.items()],
                           F.col("_b").alias("_cb"), "_before", *extra)
    conds = [F.col(k).eqNullSafe(F.col(v)) for k, v in renamed.items()]
    conds.append(F.col("_b") == F.col("_cb"))
    if not by:
        # without group keys the offsets have at most 2**bucket_bits rows:
        # a proven bound, so broadcast them and prune/attach map-side
        counts = F.broadcast(counts)
    joined = d.join(counts, reduce(lambda a, b: a & b, conds), "inner")
    joined = joined.drop(*renamed.values(), "_cb")
    wr = Window.partitionBy(*by, "_b").orderBy(F.col(order_col), *[F.col(t) for t in tiebreak])
    ranked = joined.withColumn(out, F.col("_before") + F.row_number().over(wr))
    if lim is not None:
        ranked = ranked.filter(F.col(out) <= lim)
    return ranked.drop("_b", "_before")


def with_draw_key(df: DataFrame, id_col: str, seed: int, salt: Sequence = (), out: str = "_h") -> DataFrame:
    return df.withColumn(out, draw_int(id_col, *_list(salt), seed=seed))


# ---------------------------------------------------------------- M1, T3
def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42, by: Sequence[str] = (),
             salt: Sequence = ()) -> DataFrame:
    """Exact-size simple random sample without replacement: the ``n`` rows
    with the smallest draw key per group (all rows if fewer)."""
    d = with_draw_key(df, id_col, seed, salt)
    out = rank_within(d, by, "_h", [id_col], limit=n, out="draw_rank")
    return out.drop("_h")


def head_rows(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """First ``n`` rows by a column (T3): a top-n, not a shuffle of everything."""
    return df.orderBy(F.col(order_col)).limit(n)


# ---------------------------------------------------------------- M2
def split_exact(df: DataFrame, id_col: str, test_pct: int = C.TEST_PCT, seed: int = 42,
                by: Sequence[str] = (), out: str = "split") -> DataFrame:
    """Exact split: per group, ``ceil(test_pct * n / 100)`` rows (integer
    arithmetic) with the smallest key are 'test', the rest 'train'."""
    by = _list(by)
    d = with_draw_key(df, id_col, seed)
    r = rank_within(d, by, "_h", [id_col], out="_r",
                    group_fn=lambda g: g.withColumn("_m", F.expr(f"(_gn * {int(test_pct)} + 99) div 100")))
    return (r.withColumn(out, F.when(F.col("_r") <= F.col("_m"), F.lit("test")).otherwise(F.lit("train")))
             .drop("_h", "_r", "_m", "_gn"))


def _attach(d: DataFrame, small: DataFrame, by: list, how: str = "inner") -> DataFrame:
    """Join a per-group table (one row per group) onto rows.  With no group
    keys the table has exactly one row (a global aggregate) and becomes a
    scalar subquery instead of a join."""
    if not by:
        # a global aggregate has exactly one row: attach it as a scalar
        # subquery (computed once, inlined as a value) -- no join at all
        sub = small.select(F.struct(*[F.col(c) for c in small.columns]).alias("_s")).scalar()
        return d.withColumns({c: sub[c] for c in small.columns})
    renamed = small
    for i, k in enumerate(by):
        renamed = renamed.withColumnRenamed(k, f"_g{i}")
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(by)])
    return d.join(renamed, cond, how).drop(*[f"_g{i}" for i in range(len(by))])


# places a group's rows are dealt to when statistics are joined onto them
STAT_SALTS = 32


def _attach_stats(d: DataFrame, small: DataFrame, by: list, how: str = "inner") -> DataFrame:
    """``_attach`` for statistics of groups that may hold most rows: where the
    join is not a broadcast, a group's rows go to STAT_SALTS places, each with
    a copy of its one statistics row.  The salt depends on the input partition
    and the row, so copies of one row spread and a task that is run again
    deals its rows alike."""
    if not by:
        return _attach(d, small, by, how)
    plain = [f.name for f in d.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType))]
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.lit(STAT_SALTS)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(STAT_SALTS - 1))))
    return _attach(d.withColumn("_salt", salt), copies, [*by, "_salt"], how).drop("_salt")


def allocate(counts: DataFrame, by: list, stratum: str, n_col: str, test_pct: int) -> DataFrame:
    """Largest-remainder allocation of ``ceil(test_pct * n / 100)`` test rows
    over strata, proportional to stratum size.  Ties on the remainder go to
    the smaller stratum value.  Integer arithmetic throughout."""
    wg = Window.partitionBy(*by)
    c = (counts
         .withColumn("_tot", F.sum(n_col).over(wg))
         .withColumn("_m", F.expr(f"(_tot * {int(test_pct)} + 99) div 100"))
         .withColumn("_q", F.col("_m") * F.col(n_col))
         .withColumn("_fl", F.expr("_q div _tot"))
         .withColumn("_rem", F.expr("_q % _tot"))
         .withColumn("_left", F.col("_m") - F.sum("_fl").over(wg)))
    wr = Window.partitionBy(*by).orderBy(F.col("_rem").desc(), F.col(stratum))
    c = c.withColumn("_pos", F.row_number().over(wr))
    c = c.withColumn("alloc", F.col("_fl") + F.when(F.col("_pos") <= F.col("_left"), 1).otherwise(0))
    return c.select(*by, stratum, n_col, "alloc")


# ---------------------------------------------------------------- M3
def stratified_split(df: DataFrame, id_col: str, stratum: str, test_pct: int = C.TEST_PCT, seed: int = 42,
                     by: Sequence[str] = (), out: str = "split", key_cols: Sequence[str] | None = None) -> DataFrame:
    """Exact stratified split: each stratum gives its largest-remainder share
    of the ``ceil(test_pct * n / 100)`` test rows, chosen by draw key.  The
    stratum sizes come from the rank's bucket counts (two passes in all)."""
    by = _list(by)
    key_cols = _list(key_cols) or [id_col]
    d = df.withColumn("_h", draw_int(*key_cols, seed=seed))
    r = rank_within(d, by + [stratum], "_h", key_cols, out="_r",
                    group_fn=lambda g: allocate(g, by, stratum, "_gn", test_pct))
    return (r.withColumn(out, F.when(F.col("_r") <= F.col("alloc"), F.lit("test")).otherwise(F.lit("train")))
             .drop("_h", "_r", "alloc", "_gn"))


# ---------------------------------------------------------------- M4
def stratified_sample(df: DataFrame, id_col: str, stratum: str, n: int, seed: int = 42,
                      by: Sequence[str] = (), replace: bool = False, strict: bool = False,
                      salt: Sequence = ()) -> DataFrame:
    """Equal-size draw per stratum: ``n div k`` rows from each of the k
    strata of a group.

    Without replacement a stratum smaller than its share gives all its rows
    (``strict=True`` fails the job instead).  With replacement each of the
    ``m`` draws of a stratum picks position ``1 + key mod size`` in the
    stratum's key order, so repeats are possible; column ``draw`` numbers the
    draws 1..m inside the stratum.
    """
    by = _list(by)
    salt = _list(salt)
    d = df.withColumn("_h", draw_int(id_col, *salt, seed=seed))
    if not replace:
        def share(g):
            g = g.withColumn("_m", (F.lit(int(n)) / F.count(F.lit(1)).over(Window.partitionBy(*by))).cast("long"))
            if strict:
                g = g.withColumn("_m", F.when(F.col("_gn") >= F.col("_m"), F.col("_m")).otherwise(
                    F.raise_error(F.concat(F.lit("stratum smaller than its draw: "),
                                           F.col(stratum).cast("string")))).cast("long"))
            return g
        r = rank_within(d, by + [stratum], "_h", [id_col], limit="_m", out="draw", group_fn=share)
        return r.drop("_h", "_m", "_gn")
    counts = d.groupBy(*by, stratum).agg(F.count(F.lit(1)).alias("_sn"))
    counts = counts.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    counts = counts.withColumn("_m", (F.lit(int(n)) / F.col("_k")).cast("long"))
    # with replacement: positions are drawn per (group, stratum, j)
    draws = counts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))))
    draws = draws.filter(F.col("_m") > 0)
    draws = draws.withColumn(
        "_pos", F.lit(1) + F.pmod(draw_int(stratum, "draw", *salt, seed=seed + 7919), F.col("_sn")))
    draws = draws.select(*by, stratum, "draw", "_pos")
    r = rank_within(d, by + [stratum], "_h", [id_col], out="_pos")
    out = r.join(draws, by + [stratum, "_pos"], "inner")
    return out.drop("_h", "_pos")


# ---------------------------------------------------------------- M5
def subsamples(df: DataFrame, id_col: str, stratum: str, sizes: Iterable[int], repeats: int,
               seed: int = 42, replace: bool = True, test_pct: int = C.TEST_PCT, disjoint: bool = False) -> DataFrame:
    """All repeated stratified draws in one job: for every size ``rec`` and
    subsample ``sub`` in 1..repeats, an equal-per-stratum draw of ``rec``
    rows, then an exact stratified test/train split inside the cell.

    ``replace=True`` (the default, as the reference draws) may repeat a row
    inside a cell; ``draw`` then tells the copies apart.  ``replace=False``
    takes the first places of a keyed permutation of each stratum instead, one
    permutation per cell.  Either way the rows are ranked once per stratum,
    whatever the number of cells, and the small table of drawn positions is
    joined to them.  ``disjoint=True`` draws without replacement *and* without overlap between the subsamples
    of one size: rows are ranked once per (size, stratum) and rank r goes to
    subsample ceil(r / m) -- exact, one pass, no sequential removal.
    """
    sizes = [int(r) for r in sizes]
    if disjoint:
        g = df.withColumn("rec", F.explode(F.array(*[F.lit(r) for r in sizes])))
        drawn = _disjoint_share(g, id_col, stratum, repeats, seed)
        replace = False
    else:
        drawn = _drawn_positions(df, id_col, stratum, sizes, repeats, seed, replace)
    key_cols = [id_col] if not replace else [id_col, "draw"]
    return stratified_split(drawn, id_col, stratum, test_pct=test_pct, seed=seed + 1,
                            by=["rec", "sub"], key_cols=key_cols + ["rec", "sub"])


def _disjoint_share(g: DataFrame, id_col: str, stratum: str, repeats: int, seed: int) -> DataFrame:
    """``repeats`` disjoint equal-per-stratum draws of ``rec`` rows each."""
    d = g.withColumn("_h", draw_int(id_col, "rec", seed=seed))
    share = lambda t: t.withColumn(
        "_m", (F.col("rec") / F.count(F.lit(1)).over(Window.partitionBy("rec"))).cast("long")
    ).withColumn("_lim", F.col("_m") * F.lit(int(repeats)))
    r = rank_within(d, ["rec", stratum], "_h", [id_col], limit="_lim", out="_r", group_fn=share)
    r = r.filter(F.col("_m") > 0)
    r = r.withColumn("sub", (F.floor((F.col("_r") - 1) / F.col("_m")) + 1).cast("int"))
    r = r.withColumn("draw", F.col("_r") - (F.col("sub") - 1) * F.col("_m"))
    return r.drop("_h", "_m", "_lim", "_r", "_gn")


def _drawn_positions(df: DataFrame, id_col: str, stratum: str, sizes: list, repeats: int, seed: int,
                     replace: bool) -> DataFrame:
    """Equal-per-stratum draws for every cell: one rank per stratum, joined to
    the positions each (rec, sub) draws.  Without replacement a stratum smaller
    than its share is drawn whole."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_sn"))
    counts = counts.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy()))  # one row per stratum
    grid = F.array(*[F.struct(F.lit(r).alias("rec"), F.lit(int(s)).alias("sub")) for r in sizes for s in range(1, repeats + 1)])
    cells = counts.withColumn("_cell", F.explode(grid)).select("*", "_cell.rec", "_cell.sub").drop("_cell")
    cells = cells.withColumn("_m", (F.col("rec") / F.col("_k")).cast("int")).filter(F.col("_m") > 0)
    last = F.col("_m") if replace else F.least(F.col("_m"), F.col("_sn").cast("int"))
    # a handful of small rows grows to every draw of the grid: dealt out first
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(parts, stratum, "rec", "sub")
    draws = cells.withColumn("draw", F.explode(F.sequence(F.lit(1), last)))
    if replace:
        place = F.pmod(draw_int(stratum, "draw", "rec", "sub", seed=seed + 7919), F.col("_sn"))
    else:
        place = permuted(F.col("draw") - 1, F.col("_sn"), stratum, "rec", "sub", seed=seed + 7919)
    draws = draws.withColumn("_pos", F.lit(1) + place)
    ranked = rank_within(df.withColumn("_h", draw_int(id_col, seed=seed)), [stratum], "_h", [id_col], out="_pos")
    return ranked.join(draws.select(stratum, "_pos", "rec", "sub", "draw"), [stratum, "_pos"], "inner").drop("_h", "_pos")


# ---------------------------------------------------------------- J6, U2
def exclude_drawn(df: DataFrame, drawn: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id was not drawn yet (keyed left-anti join)."""
    return df.join(drawn.select(id_col).distinct(), id_col, "left_anti")


# ---------------------------------------------------------------- E6
def overlap(cells: DataFrame, id_col: str, by: Sequence[str], split_col: str = "split") -> DataFrame:
    """Per cell: distinct source rows in train, in test, and in both."""
    by = _list(by)
    per_row = (cells.groupBy(*by, id_col)
               .agg(F.max(F.when(F.col(split_col) == "train", 1).otherwise(0)).alias("_tr"),
                    F.max(F.when(F.col(split_col) == "test", 1).otherwise(0)).alias("_te")))
    return (per_row.groupBy(*by)
            .agg(F.sum("_tr").cast("long").alias("train_ids"),
                 F.sum("_te").cast("long").alias("test_ids"),
                 F.sum(F.col("_tr") * F.col("_te")).cast("long").alias("both_ids")))


# ---------------------------------------------------------------- W1
def dedupe_first(df: DataFrame, key: Sequence[str], order_col: str) -> DataFrame:
    """Keep the first row (smallest ``order_col``) of each duplicate key.
    An aggregate, not a window: partial aggregation copes with hot keys."""
    key = _list(key)
    rest = [c for c in df.columns if c not in key]
    agg = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order_col)).alias("_first"))
    return agg.select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest])
