import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay_spark.operators import kernels as K


def nearest(test, train, k):
    out = {}
    for tid, tx in test:
        d = [(sum((a - b) ** 2 for a, b in zip(tx, x)), i) for i, x in train]
        out[tid] = [i for _, i in sorted(d)[:k]]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["row_id"], r["nn_rank"])):
        out.setdefault(r["row_id"], []).append(r["nn_id"])
    return out


def points(rng, n, first, copies=0):
    """Clustered points on a coarse lattice (many ties), then copies of one."""
    x = np.round(rng.normal(size=(n, 3)) + 12 * rng.integers(0, 6, (n, 1)), 1)
    x[n - copies:] = x[0]
    return [(first + i, [float(v) for v in r]) for i, r in enumerate(x)]


@pytest.mark.parametrize("seed,copies", [(0, 0), (1, 600)])
def test_pruned_knn_equals_brute_force(spark, seed, copies):
    rng = np.random.default_rng(seed)
    test, train = points(rng, 150, -75), points(rng, 1500, 1000, copies)
    te, tr = (spark.createDataFrame(r, "row_id long, x array<double>") for r in (test, train))
    got = K.knn_join(te, tr, k=4, y=None, block_rows=64, chunk_rows=32, pivots=16)
    assert found(got.collect()) == nearest(test, train, 4)


def test_pruned_knn_cells_short_of_rows_and_one_sided(spark):
    rng = np.random.default_rng(3)
    te, tr = points(rng, 40, 0), points(rng, 300, 100)
    test = [("a", *r) for r in te] + [("b", *r) for r in te] + [("c", *r) for r in te]
    train = [("a", *r) for r in tr] + [("b", *r) for r in tr[:2]] + [("d", *r) for r in tr]
    te_df, tr_df = (spark.createDataFrame(r, "g string, row_id long, x array<double>") for r in (test, train))
    got = K.knn_join(te_df, tr_df, k=3, by=["g"], y=None, block_rows=32, pivots=8).collect()
    assert found([r for r in got if r["g"] == "a"]) == nearest(te, tr, 3)
    assert found([r for r in got if r["g"] == "b"]) == nearest(te, tr[:2], 3)
    assert {r["g"] for r in got} == {"a", "b"}


def test_pruned_knn_of_no_rows(spark):
    e = spark.createDataFrame([], "row_id long, x array<double>")
    t = spark.createDataFrame([(1, [0.0])], "row_id long, x array<double>")
    assert K.knn_join(e, t, y=None, pivots=4).collect() == []
    assert K.knn_join(t, e, y=None, pivots=4).collect() == []


@pytest.mark.parametrize("n", [2000, 4000])
def test_pruned_knn_sends_fewer_rows_than_all_blocks(spark, n, monkeypatch):
    rng = np.random.default_rng(5)
    te, tr = (spark.createDataFrame(points(rng, m, f), "row_id long, x array<double>") for m, f in ((400, 0), (n, 10_000)))
    sent = []
    plain = K._block_nearest

    def counted(te, tr, by, keys, k):
        sent.append(te.count() + tr.count())
        return plain(te, tr, by, keys, k)

    monkeypatch.setattr(K, "_block_nearest", counted)
    K.knn_join(te, tr, k=5, y=None, block_rows=64, chunk_rows=64, pivots=0).count()
    all_rows, sent[:] = sum(sent), []
    K.knn_join(te, tr, k=5, y=None, block_rows=64, chunk_rows=64, pivots=64).count()
    assert len(sent) == 2 and sum(sent) < all_rows / 2


@pytest.mark.parametrize("width", [1, 2, 5, 12])
@pytest.mark.parametrize("k", [1, 4, 3000])
def test_least_entries_equal_the_whole_table(width, k):
    rng = np.random.default_rng(width)
    def frame(n):  # far from the origin, with ties and copies
        x = 1e3 + np.round(rng.normal(size=(n, width)), 1)
        x[n - n // 4:] = x[0]
        return pd.DataFrame({"_id": np.arange(n), "_x": list(x)})

    q, t = frame(700), frame(2500)
    d = K._table(q, t)
    want = np.argsort(d, axis=1, kind="stable")[:, :k]
    row, col, dist = K._least(q, t, k)
    got = np.lexsort((col, dist, row))
    assert (row[got].reshape(want.shape) == np.arange(700)[:, None]).all()
    assert (col[got].reshape(want.shape) == want).all()
    assert (dist == d[row, col]).all()
    far = np.sort(d, axis=1)[:, 2]
    row, col, dist = K._least(q.assign(_far=far), t, k)
    assert set(zip(row, col)) == {(r, c) for r in range(700) for c in want[r] if d[r, c] <= far[r]}


def test_least_entries_with_unknown_and_endless_values():
    q = pd.DataFrame({"_id": [0, 1], "_x": [np.array([0.0, 1.0]), np.array([np.nan, 0.0])]})
    t = pd.DataFrame({"_id": [0, 1, 2], "_x": [np.array([np.inf, 0.0]), np.array([0.0, 0.0]), np.array([0.0, 2.0])]})
    row, col, dist = K._least(q, t, 2)
    assert sorted(zip(row.tolist(), col.tolist())) == [(0, 1), (0, 2), (1, 0), (1, 1)]


def test_pruned_knn_of_a_split_that_is_not_computed_yet(spark):
    from assay_spark.operators.sampling import split_exact

    rows = points(np.random.default_rng(6), 900, 0)
    s = split_exact(spark.createDataFrame(rows, "row_id long, x array<double>"), "row_id", 20, seed=42)
    test, train = s.filter("split = 'test'"), s.filter("split = 'train'")
    got = K.knn_join(test, train, k=3, y=None, pivots=4)
    sides = [[(r["row_id"], r["x"]) for r in d.collect()] for d in (test, train)]
    assert found(got.collect()) == nearest(*sides, 3)


def test_rows_are_copied_a_bounded_number_of_times(spark, monkeypatch):
    rng = np.random.default_rng(8)
    plain, sent = K._block_nearest, []

    def counted(te, tr, by, keys, k):
        sent.append(te.count() + tr.count())
        return plain(te, tr, by, keys, k)

    monkeypatch.setattr(K, "_block_nearest", counted)
    for pivots in (0, None):
        copies = []
        for n in (3000, 9000):
            te, tr = (spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(m, 2)))],
                                            "row_id long, x array<double>") for m in (n, n))
            sent.clear()
            K.knn_join(te, tr, k=5, y=None, pivots=pivots)
            copies.append(sum(sent) / n)
        # each chunk of 256 test rows used to ask for a copy of every train row: 12 and 36
        assert max(copies) <= 10


def test_two_hundred_thousand_centres(spark):
    n = 200_000
    # a line of centres, every point's nearest one is known
    cents = spark.range(n).select(F.col("id").cast("int").alias("cluster"),
                                  F.array(F.col("id").cast("double"), F.lit(0.0)).alias("centroid"))
    rows = spark.createDataFrame([(1, [3.2, 1.0]), (2, [199_999.9, 0.0]), (3, [100.5, 0.0]), (4, None)],
                                 "row_id long, x array<double>")
    got = {r["row_id"]: (r["cluster"], r["dist2"]) for r in K.assign(rows, cents).collect()}
    assert got[1] == (3, pytest.approx(1.04)) and got[2] == (199_999, pytest.approx(0.81))
    assert got[3] == (100, 0.25) and got[4] == (None, None)

    kern = K.rbf_kernel(rows, cents.select(F.col("cluster").alias("centre_id"), F.col("centroid").alias("x")), 2.0)
    per = {r["row_id"]: r for r in kern.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("centre_id").alias("c"), F.max_by("centre_id", "k").alias("top"),
        F.sum("k").alias("s"), F.count("k").alias("known")).collect()}
    assert all(r["n"] == r["c"] == n for r in per.values()) and len(per) == 4
    assert per[1]["top"] == 3 and per[2]["top"] == 199_999 and per[4]["known"] == 0
    x = np.arange(n)
    assert per[1]["s"] == pytest.approx(np.exp(-((3.2 - x) ** 2 + 1.0) / 8.0).sum())


@pytest.mark.parametrize("bytes_", [64, 4 << 20])
def test_blocks_of_centres_answer_as_one(spark, monkeypatch, bytes_):
    monkeypatch.setattr(K, "CENTRE_BYTES", bytes_)
    rows = spark.createDataFrame([("p", 1, [0.0, 0.0]), ("q", 2, [5.0, 5.0]), ("q", 2, [5.0, 5.0]), ("n", 3, None)],
                                 "name string, row_id long, x array<double>")
    cents = spark.createDataFrame([(i, [float(i), float(i)]) for i in range(9)] + [(9, [5.0, 5.0])],
                                  "cluster int, centroid array<double>")
    got = sorted((r["name"], r["cluster"], r["dist2"]) for r in K.assign(rows, cents).collect() if r["name"] != "n")
    assert got == [("p", 0, 0.0), ("q", 5, 0.0), ("q", 5, 0.0)]
    k = K.rbf_kernel(rows, cents.select(F.col("cluster").alias("centre_id"), F.col("centroid").alias("x")), 1.0).collect()
    assert len(k) == 40 and sum(r["k"] is None for r in k) == 10
