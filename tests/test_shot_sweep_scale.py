"""The shot sweep's quadratic and linear work at size (F1)."""
import numpy as np
import pandas as pd
import pytest

from assay_spark.functions import packed as P
from assay_spark.functions.keys import generators
from assay_spark.operators import features as FE
from assay_spark.operators import kernels as K


def cases(width):
    rng = np.random.default_rng(width)
    q, t = rng.normal(size=(300, width)), rng.normal(size=(2700, width))
    yield "plain", q, t
    yield "few values", np.sign(q), np.sign(t)
    yield "copies", t[rng.integers(0, 9, 300)], t[rng.integers(0, 9, 2700)]
    yield "near copies", t[rng.integers(0, 9, 300)] + 1e-9 * q, t[rng.integers(0, 9, 2700)] + 1e-9 * t
    yield "far from the origin", 1e8 + q, 1e8 + t
    yield "all equal", np.full_like(q, -3.0), np.full_like(t, -3.0)
    yield "small", q * 1e-160, t * 1e-160
    yield "one far away", q, np.vstack([t[:99], t[99:100] * 1e25, t[100:]])
    yield "tests far away", np.vstack([q[:99], q[99:100] * 1e25, q[100:200], q[200:] * 1e5]), t
    yield "fewer than k", q, t[:3]
    yield "endless ones", np.vstack([q[:9], np.full((1, width), -np.inf), q[9:]]), t
    yield "an endless train row", q, np.vstack([t[:9], np.full((1, width), np.inf)])


@pytest.mark.parametrize("tiles", [(1024, 1024), (64, 100)])
@pytest.mark.parametrize("k", [1, 5, 200])
@pytest.mark.parametrize("width", [9, 64])
def test_products_find_the_least_of_the_whole_table(width, k, tiles, monkeypatch):
    monkeypatch.setattr(K, "PRODUCT_ROWS", tiles[0])
    monkeypatch.setattr(K, "PRODUCT_COLS", tiles[1])
    for name, q, t in cases(width):
        d = K._table(pd.DataFrame({"_x": list(q)}), pd.DataFrame({"_x": list(t)}))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        for far in (np.full(len(q), np.inf), np.sort(d, axis=1)[:, min(2, len(t) - 1)], np.full(len(q), np.nan)):
            row, col, dist = K._least_rows(q, t, k, far)
            assert (dist == d[row, col]).all(), name
            want = [(r, c) for r in range(len(q)) for c in order[r] if not d[r, c] > far[r]]
            near = np.lexsort((col, dist, row))
            assert list(zip(row[near].tolist(), col[near].tolist())) == want, name


def test_few_distances_are_ranked_or_measured(monkeypatch):
    rng = np.random.default_rng(2)
    q, t = rng.normal(size=(256, 64)), rng.normal(size=(16384, 64))
    ranked, measured, rank, measure = [], [], np.partition, K._exact

    def counted(a, *args, **kw):
        ranked.append(a.size)
        return rank(a, *args, **kw)

    monkeypatch.setattr(np, "partition", counted)
    monkeypatch.setattr(K, "_exact", lambda qx, tx, r, c: measured.append(len(r)) or measure(qx, tx, r, c))
    K._least_rows(q, t, 5, np.full(len(q), np.inf))
    # every distance of the table used to be held in doubles and ranked
    assert sum(ranked) <= len(q) * len(t) / 8
    assert 0 < sum(measured) <= 60 * len(q)


def points(spark, n, groups, at=0):
    rng = np.random.default_rng(n)
    rows = [(g, at + i, [float(v) for v in rng.normal(size=12)], float(i)) for g in range(groups) for i in range(n)]
    return spark.createDataFrame(rows, "g int, row_id long, x array<double>, y double").repartition(2)


def test_groups_of_much_work_are_tasks_of_their_own(spark, monkeypatch):
    sides, zipped = [], K._zip_groups

    def seen(left, right, keys, fn, schema):
        sides[:] = [left, right]
        return zipped(left, right, keys, fn, schema)

    monkeypatch.setattr(K, "_zip_groups", seen)
    te, tr = points(spark, 60, 8), points(spark, 300, 8, 1000)
    plain = K.knn_join(te, tr, 3, ["g"]).collect()
    assert not any("RepartitionByExpression" in d._jdf.queryExecution().logical().toString() for d in sides)
    monkeypatch.setattr(K, "TASK_PAIRS", 1)
    got = K.knn_join(te, tr, 3, ["g"]).collect()
    # packed groups are so few bytes that adaptive execution used to merge them into few tasks
    assert all(d.rdd.getNumPartitions() >= 16 for d in sides)
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and len(got) == 8 * 60 * 3


def test_rows_are_packed_once_however_many_groups_they_meet(spark, monkeypatch):
    sent, pack = [], P.pack
    monkeypatch.setattr(K.P, "pack", lambda df, *a: sent.append(df.count()) or pack(df, *a))
    te, tr = points(spark, 200, 1), points(spark, 500, 1, 1000)
    got = K.knn_join(te, tr, 3, chunk_rows=50, block_rows=64, pivots=0).collect()
    assert len(got) == 600
    # each of eight train blocks used to be packed once for each of four test chunks, and the other way round
    assert sorted(sent) == [200, 500]


def test_generators_are_those_of_default_rng():
    rng = np.random.default_rng(4)
    for places in (1, 3, 4, 5, 7):
        entropy = [rng.integers(0, 2 ** 32, 20, dtype=np.uint64) for _ in range(places)]
        entropy[0][:2] = 0, 2 ** 32 - 1
        for i, got in enumerate(generators(entropy)):
            assert got.bit_generator.state == np.random.default_rng([int(w[i]) for w in entropy]).bit_generator.state


def test_binomial_noise_is_drawn_by_each_rows_own_generator(spark):
    xs = [[0.5, -0.5, 1.25], None, [], [-1.0, 0.0]]
    rows = [(i, x) for i in (0, 7, -1, 2 ** 32, 2 ** 53 + 1, -2 ** 63) for x in xs]
    df = spark.createDataFrame(rows, "row_id long, x array<double>")

    def drawn(rid, x, n, loop, seed):
        if not x or n == 0:
            return x
        key = rid & 0xFFFFFFFFFFFFFFFF
        rng = np.random.default_rng([seed, key & 0xFFFFFFFF, key >> 32, n, loop])
        return (2.0 * rng.binomial(n, np.clip((1.0 + np.array(x)) / 2.0, 0.0, 1.0)) / n - 1.0).tolist()

    for seed in (0, 42, 2 ** 40 + 3):
        got = FE.add_shot_noise(df, "row_id", "x", (0, 10, 5000), loops=2, seed=seed, method="binomial").collect()
        want = [(rid, x, n, loop, drawn(rid, x, n, loop, seed)) for rid, x in rows for n in (0, 10, 5000) for loop in (1, 2)]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("distinct", [1, 300, P.CODES, P.CODES + 1])
def test_entries_are_coded_as_they_are(distinct):
    flat = np.tile(np.r_[-0.0, np.arange(1, distinct) / 7.0], 5)[:4 * P.CODES]
    back = P.entries(*P._entries_packed(flat))
    assert (back.view(np.int64) == flat.view(np.int64)).all()
