import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay_spark.functions import arrays as A
from assay_spark.operators import features as FE
from assay_spark.operators import kernels as K
from assay_spark.operators import models as MO
from assay_spark.operators import report as RP


def vec_df(spark, m, y=None, cell=None):
    rows = []
    for i, r in enumerate(m):
        rows.append((i, [float(v) for v in r], float(y[i]) if y is not None else 0.0,
                     int(cell[i]) if cell is not None else 0))
    return spark.createDataFrame(rows, "row_id long, x array<double>, y double, cell int")


def test_standardize_constant_dimension_is_zero(spark):
    m = np.array([[1.0, 5.0], [2.0, 5.0], [3.0, 5.0]])
    z = FE.standardize(vec_df(spark, m), "x").orderBy("row_id").collect()
    assert [r["x"][1] for r in z] == [0.0, 0.0, 0.0]
    want = (m[:, 0] - m[:, 0].mean()) / m[:, 0].std()
    assert [r["x"][0] for r in z] == pytest.approx(list(want))


def test_scale_to_bound(spark):
    rng = np.random.default_rng(0)
    df = vec_df(spark, rng.normal(size=(50, 4)))
    s = FE.scale_to(df, "x", 6.0)
    assert FE.max_abs(s, "x").first()["max_abs"] == pytest.approx(6.0)


def test_expansion_lengths(spark):
    m = np.arange(18, dtype=float).reshape(1, 18) / 20.0
    df = vec_df(spark, m)
    c = FE.correlators(df, "x").first()["corr"]
    assert len(c) == 18 + 18 * 17 // 2
    assert c[18] == pytest.approx(m[0, 0] * m[0, 1]) and c[-1] == pytest.approx(m[0, 16] * m[0, 17])
    e = FE.response_features(df, "x", t_end=4.3, step=0.4).first()["embedding"]
    assert len(e) == 1710 and all(-1.0 - 1e-12 <= v <= 1.0 + 1e-12 for v in e)
    one = FE.response_features(df, "x", order=1).first()["embedding"]
    assert len(one) == 180
    crc = FE.response_features(df, "x", t_end=4.0, step=0.5, layout="blocked").first()["embedding"]
    assert len(crc) == (18 + 153) * 8


def test_response_matches_formula(spark):
    df = vec_df(spark, np.array([[0.0, 1.5]]))
    e = FE.response_features(df, "x", omega=2.0, t_end=1.0, step=0.5, order=1).first()["embedding"]
    w2 = 4.0
    want = []
    for t in (0.5, 1.0):
        for x in (0.0, 1.5):
            want.append(1 - 2 * w2 / (w2 + x * x) * math.sin(math.sqrt(w2 + x * x) * t / 2) ** 2)
    assert e == pytest.approx(want)


def test_expand_modes(spark):
    df = vec_df(spark, np.array([[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]]))
    got = {m: FE.expand(df, "x", m).first()["readout"] for m in FE.READOUT_MODES}
    assert got["z"] == [3.0, 6.0] and got["zz"] == [18.0]
    assert len(got["ss"]) == 36 and got["szz"] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 18.0]


def test_shot_noise_converges(spark):
    e = np.array([[0.5, -0.2, 0.9]])
    df = vec_df(spark, e)
    n = FE.add_shot_noise(df, "row_id", "x", [0, 20, 20000], loops=1, seed=3)
    got = {r["shots"]: r["noisy"] for r in n.collect()}
    assert got[0] == [0.5, -0.2, 0.9]
    assert all(abs(k * 20 / 2 - round(k * 20 / 2)) < 1e-9 for k in np.array(got[20]) + 1)
    assert got[20000] == pytest.approx([0.5, -0.2, 0.9], abs=0.03)


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 5))
    y = rng.normal(size=300)
    cell = rng.integers(0, 2, 300)
    df = vec_df(spark, m, y, cell)
    test = df.filter("row_id % 4 = 0")
    train = df.filter("row_id % 4 != 0")
    # tiny blocks force many blocks per cell: the merge over blocks is exercised
    got = {r["row_id"]: r["y_hat"] for r in K.knn_regression(test, train, 5, ["cell"], block_rows=8).collect()}
    for i in range(0, 300, 4):
        cand = [j for j in range(300) if j % 4 and cell[j] == cell[i]]
        d = sorted(cand, key=lambda j: (float(((m[i] - m[j]) ** 2).sum()), j))[:5]
        assert got[i] == pytest.approx(float(np.mean(y[d])))


def test_assign_and_rbf(spark):
    df = vec_df(spark, np.array([[0.0, 0.0], [10.0, 10.0], [9.0, 9.0]]))
    cents = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 10.0])], "cluster int, centroid array<double>")
    a = {r["row_id"]: r["cluster"] for r in K.assign(df, cents).collect()}
    assert a == {0: 0, 1: 1, 2: 1}
    c = cents.select(F.col("cluster").alias("centre_id"), F.col("centroid").alias("x"))
    k = {(r["row_id"], r["centre_id"]): r["k"] for r in K.rbf_kernel(df, c, 1.0).collect()}
    assert k[(0, 0)] == 1.0 and k[(2, 1)] == pytest.approx(math.exp(-1.0))


def test_fit_grouped_matches_lstsq(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(400, 3))
    cell = rng.integers(0, 3, 400)
    y = m @ np.array([1.0, -2.0, 0.5]) + cell * 3.0 + rng.normal(scale=0.1, size=400)
    co = {r["cell"]: r for r in MO.fit_grouped(vec_df(spark, m, y, cell), ["cell"]).collect()}
    for c in range(3):
        xs = np.column_stack([np.ones((cell == c).sum()), m[cell == c]])
        b = np.linalg.lstsq(xs, y[cell == c], rcond=None)[0]
        assert co[c]["intercept"] == pytest.approx(b[0], abs=1e-8)
        assert co[c]["coef"] == pytest.approx(list(b[1:]), abs=1e-8)


def test_grouped_ols_equals_ml_ols(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(200, 2))
    y = m @ np.array([0.3, 1.7]) + 2.0 + rng.normal(scale=0.2, size=200)
    df = vec_df(spark, m, y)
    co = MO.fit_grouped(df, []).first()
    ml = MO.fit(df, "ols").model
    assert co["intercept"] == pytest.approx(ml.intercept, abs=1e-6)
    assert co["coef"] == pytest.approx(list(ml.coefficients.toArray()), abs=1e-6)


def test_pca_variance_non_increasing(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(100, 5)) * np.array([5.0, 3.0, 2.0, 1.0, 0.5])
    ev = [r["explained"] for r in FE.pca_variance(vec_df(spark, m), "x", 5).orderBy("component").collect()]
    assert all(a >= b - 1e-12 for a, b in zip(ev, ev[1:]))


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, y_hat double")
    r = RP.regression_metrics(df, extended=True).first()
    e = np.array([0.5, 0.0, -1.0])
    assert r["mse"] == pytest.approx((e ** 2).mean()) and r["mae"] == pytest.approx(np.abs(e).mean())
    assert r["r2"] == pytest.approx(1 - (e ** 2).sum() / (3 * np.var([1.0, 2.0, 3.0])))
    assert r["mape"] == pytest.approx(np.mean([0.5, 0.0, 1 / 3]))


def test_pair_mean_std_keeps_orphans(spark):
    df = spark.createDataFrame([("100mse", "rf", 0.2), ("100std", "rf", 0.05), ("200mse", "rf", 0.1)],
                               "key string, model string, value double")
    got = {r["n_key"]: (r["mean"], r["std"]) for r in RP.pair_mean_std(df).collect()}
    assert got == {"100": (0.2, 0.05), "200": (0.1, None)}


def test_pairs_helper_order(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    assert df.select(A.pair_products("v")).first()[0] == [2.0, 3.0, 6.0]


def test_cluster_skips_incomplete_dimension(spark):
    from assay_spark.operators.cluster import cluster, complete_dims

    rng = np.random.default_rng(6)
    m = np.vstack([rng.normal(0, 0.1, size=(20, 2)), rng.normal(5, 0.1, size=(20, 2))])
    m = np.column_stack([m, np.where(np.arange(40) == 3, np.nan, 1.0)])
    df = vec_df(spark, m)
    assert complete_dims(df, "x") == [0, 1]
    lab = {r["row_id"]: r["cluster"] for r in cluster(df, "x", k=2, seed=1).collect()}
    assert len(lab) == 40
    assert len({lab[i] for i in range(20)}) == 1 and len({lab[i] for i in range(20, 40)}) == 1
    assert lab[0] != lab[20]


def test_knn_join_many_chunks_and_blocks(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(200, 4))
    df = vec_df(spark, m)
    test, train = df.filter("row_id < 60"), df.filter("row_id >= 60")
    nn = K.knn_join(test, train, 3, [], y=None, block_rows=8, chunk_rows=7)
    got = {}
    for r in nn.collect():
        got.setdefault(r["row_id"], []).append((r["nn_rank"], r["nn_id"]))
    assert len(got) == 60
    for i in range(60):
        d = sorted(range(60, 200), key=lambda j: (float(((m[i] - m[j]) ** 2).sum()), j))[:3]
        assert [j for _, j in sorted(got[i])] == d


def test_gram_spans_several_chunks(spark):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(300, 200))  # (1 + 200)² + 201 + 2 values: two chunks
    beta = rng.normal(size=200)
    y = m @ beta + 0.5 + rng.normal(scale=0.01, size=300)
    co = MO.fit_grouped(vec_df(spark, m, y), [], reg=0.0).first()
    b = np.linalg.lstsq(np.column_stack([np.ones(300), m]), y, rcond=None)[0]
    assert co["n"] == 300 and co["intercept"] == pytest.approx(b[0], abs=1e-6)
    assert co["coef"] == pytest.approx(list(b[1:]), abs=1e-6)


def test_gram_that_is_handed_on_early_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(i % 5), [float(v) for v in rng.normal(size=6)], float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, x array<double>, y double").repartition(2)

    def coefficients():
        return {r["g"]: r["coef"] for r in MO.solve_gram(MO.gram(df, ["g"]), ["g"]).collect()}

    whole = coefficients()
    monkeypatch.setattr(MO, "GRAM_BYTES", 2 * 7 * 7 * 8)  # two accumulators
    early = coefficients()
    for g in range(5):
        x = np.array([[1.0, *r[1]] for r in rows if r[0] == g])
        want = np.linalg.lstsq(x, np.array([r[2] for r in rows if r[0] == g]), rcond=None)[0][1:]
        assert np.allclose(whole[g], want) and np.allclose(early[g], want)
