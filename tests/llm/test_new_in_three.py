"""Operators 11 to 13: brute force, gradients, held-out accuracy and edge cases."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay_spark.llm import toxicity, whitening
from assay_spark.llm.queries import QUERIES
from assay_spark.llm.toxicity import Bags, ToxicModel, WordScores, fit_toxicity, loss_and_grads, passages, score_texts, score_toxicity, subwords, train, words_of
from assay_spark.llm.whitening import deviations, fit_whitening, integer_vectors, square_sums, whiten_components
from assay_spark.llm.word_runs import collapse_runs, find_runs, lyndon_array, without_repeats

SF = "/root/testdata/sf0.001"


# --- toxicity ---

def test_subwords_do_not_depend_on_company():
    many, n = subwords(["idiot", "a", "", "théâtre"])
    at = np.concatenate([[0], np.cumsum(n)])
    for k, w in enumerate(["idiot", "a", "", "théâtre"]):
        alone, m = subwords([w])
        assert (alone == many[at[k]:at[k + 1]]).all() and m[0] == n[k]
    # <idiot> has 5 + 4 + 3 n-grams and itself
    assert n[0] == 13
    assert len(set(subwords(["idiot"])[0]) & set(subwords(["idiott"])[0])) >= 8


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    bags = Bags(["you bad bad word here now and then", "fine text", "", "all is well in this longer clean text of words"])
    y = np.array([True, False, False, False])
    m = ToxicModel(rng.normal(0, 0.3, (toxicity.BUCKETS, 3)), rng.normal(size=3), -0.5)
    loss, (dv, dw, db) = loss_and_grads(bags, y, m)
    some, eps = np.unique(bags.grams)[:12], 1e-5
    for b in some:
        for k in range(3):
            m.vectors[b, k] += eps
            up = loss_and_grads(bags, y, m)[0]
            m.vectors[b, k] -= eps
            assert abs((up - loss) / eps - dv[b, k]) < 1e-4
    for k in range(3):
        m.weights[k] += eps
        up = loss_and_grads(bags, y, m)[0]
        m.weights[k] -= eps
        assert abs((up - loss) / eps - dw[k]) < 1e-4
    m.bias += eps
    assert abs((loss_and_grads(bags, y, m)[0] - loss) / eps - db) < 1e-4


def test_scores_equal_the_formula():
    rng = np.random.default_rng(2)
    m = ToxicModel(rng.normal(0, 0.3, (toxicity.BUCKETS, 4)), rng.normal(size=4), 0.3)
    table = m.bucket_scores()
    texts = ["one two three four five six seven eight nine", "", "x" * 60, "word"]
    got = score_texts(texts, WordScores(table), m.bias)
    for t, g in zip(texts, got):
        ws, at, z = words_of(t), 0, []
        for size in passages(len(ws)).tolist():
            vectors = [m.vectors[subwords([w])[0]].mean(0) for w in ws[at:at + size]]
            z.append(float(np.mean(vectors, 0) @ m.weights) * toxicity.PASSAGE)
            at += size
        want = 1 / (1 + np.exp(-(np.log(np.exp(z).sum()) + m.bias)))
        assert abs(g - want) < 1e-5


def test_unseen_spellings_and_held_out(spark):
    rng = random.Random(0)
    plain = ["house", "river", "stone", "walks", "green", "table", "under", "paper", "water", "light"]
    bad = [f"vilx{e}" for e in ("a", "en", "ity", "os", "ed", "ing")]
    rows, labels = [], []
    for i in range(400):
        ws = [rng.choice(plain) for _ in range(rng.randint(3, 60))]
        toxic = i % 3 == 0
        if toxic:
            ws[rng.randrange(len(ws))] = rng.choice(bad[:4]) if zlib.crc32(str(i).encode()) % 5 else rng.choice(bad[4:])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = fit_toxicity(docs.where(~toxicity.held_out()), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in held]) >= 0.95


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (fit_toxicity(docs.where(~toxicity.held_out()), x) for x in (labels, flipped))
    assert np.array_equal(a.vectors, b.vectors) and a.bias == b.bias


@pytest.mark.parametrize("labels, want", [([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0), ([(None, 1), (3, None), (77, 1)], 0.0)])
def test_toxicity_of_one_class(spark, docs, labels, want):
    model = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = score_toxicity(docs, model).collect()
    assert len(got) == 11 and {r["score"] for r in got} == {want}


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (6, 0), (7, 0), (8, 0)], "doc_id bigint, toxic int")
    model = fit_toxicity(docs, labels)
    got = score_toxicity(docs, model).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    none = {r["doc_id"]: r["score"] for r in got}
    assert none[3] == none[4] == none[5]  # empty, null and blank
    assert score_toxicity(empty, model).count() == 0
    assert train([], []).constant == 0.0


# --- whitening ---

def reference_whitening(vectors, most=16):
    x = np.floor(64 * np.asarray(vectors, float)) + 1_000_000
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(0)
    values, basis = np.linalg.eigh(c.T @ c / len(fit))
    values, basis = values[::-1], basis[:, ::-1]
    return x, fit, (x - fit.mean(0)) @ basis[:, :most] / np.sqrt(values[:most]), values[:most] / values.sum()


def compare_whitening(rows, got, d):
    x, fit, want, explained = reference_whitening([v for _, v in rows], min(16, d))
    by_id = {i: k for k, (i, _) in enumerate(rows)}
    here = np.full(want.shape, np.nan)
    sums, n = fit.astype(np.int64).sum(0).tolist(), len(fit)
    for r in got:
        k = by_id[r["vec_id"]]
        here[k, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-6 and r["identity_error"] < 1e-6
        assert int(r["deviation"]) == sum((n * int(a) - s) ** 2 for a, s in zip(x[k].tolist(), sums))
    sign = np.sign((here * want).sum(0))
    assert np.abs(here * sign - want).max() < 1e-6


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(20, 20)) @ np.diag(2.0 ** -np.arange(20) * 8)
    rows = [(i, (rng.normal(size=20) @ mix).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a hot vector counts once
    df = spark.createDataFrame([(i, v, 1.5, "a") for i, v in rows], "vec_id bigint, embedding array<double>, component double, x string")
    got = whiten_components(df).collect()
    assert len(got) == 450 * 16
    compare_whitening(rows, got, 20)


def test_whitening_of_the_given_table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in e.select("vec_id", "embedding").collect()]
    compare_whitening(rows, QUERIES["op12_whitening"](spark, SF).collect(), 64)


def test_whitening_drops_and_keeps(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.0, 0.0, 0.5]), (2, [1.0, 0.0, 0.5]), (3, [0.0, 3.0, 0.5]), (3, [0.0, 3.0, 0.5]), (None, [2.0, 1.0, 0.5])]
    bad = [(10, None), (11, []), (12, [nan, 0.0, 0.0]), (13, [inf, 0.0, 1.0]), (14, [None, 1.0, 1.0]), (15, [1.0, 2.0]), (16, [1e300, 0.0, 0.0])]
    got = whiten_components(spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>")).collect()
    # the third dimension has no variance: two components
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted((i or 0, k) for i, _ in good for k in (1, 2))
    assert all(r["n"] == 4 and r["identity_error"] < 1e-9 for r in got)
    for rows in ([], bad[:3], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whiten_components(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).count() == 0


def test_cholesky_passes_reach_an_orthonormal_basis(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 6)) @ np.diag([3e4, 3e3, 3e2, 30, 3, 1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    df, d = integer_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id bigint, embedding array<double>"), "embedding")
    w = fit_whitening(df.select("vec_id", "x"), d)
    x = np.floor(64 * base) + 1_000_000
    q = w.orthogonalised(np.unique(x, axis=0).astype(np.int64))
    assert len(w.factors) >= 2 and np.abs(q.T @ q - np.eye(6)).max() < 1e-10
    assert w.identity_error < 1e-8


def test_exact_deviations_beyond_longs():
    x = np.array([[2 ** 40, -(2 ** 40)], [5, 7]], np.int64)
    n, sums = 10 ** 8, [3, -4]
    assert square_sums(deviations(x, n, sums)) == [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x.tolist()]
    assert whitening.Whitening().n == 0


# --- runs ---

def brute_lyndon(s):
    return [next((j - i for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s) - i) for i in range(len(s))]


def brute_runs(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, exponent * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    k = rng.choice([1, 2, 2, 3, 5])
    w = [rng.choice("abcdefgh"[:k]) for _ in range(rng.randint(0, 40))]
    if rng.random() < 0.6:
        root = [rng.choice("abcde"[:k]) for _ in range(rng.randint(1, 7))]
        w += (root * rng.randint(2, 9))[rng.randint(0, 3):] + [rng.choice("abxyz") for _ in range(rng.randint(0, 9))]
    if rng.random() < 0.2:
        w = (w or ["q"]) * rng.randint(2, 5)
    return w


def test_lyndon_arrays_equal_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        s = [ord(c) for c in random_words(rng)]
        assert lyndon_array(np.array(s, np.int64)).tolist() == brute_lyndon(s)


@pytest.mark.parametrize("least, exponent", [(6, 4), (1, 3), (2, 2)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(600):
        w = random_words(rng)
        assert find_runs(w, least, exponent) == brute_runs(w, least, exponent)


def test_repeats_are_taken_out():
    w = "x a b a b a b a b a b y".split()
    assert find_runs(w) == [(1, 10, 2)] and without_repeats(w, find_runs(w)) == ["x", "a", "b", "y"]


def test_run_edges(spark, docs, empty):
    got = collapse_runs(docs).collect()
    assert len(got) == 11
    by = {r["doc_id"]: r for r in got}
    assert by[3]["collapsed"] == by[4]["collapsed"] == by[5]["collapsed"] == "" and by[4]["runs"] == []
    assert [tuple(r) for r in by[7]["runs"]] == [(0, 6000, 1)] and by[7]["collapsed"] == "long end"
    assert collapse_runs(empty).count() == 0
    one = spark.createDataFrame([(1, "a b\x1ca b " * 8)], "doc_id int, text string")
    assert [tuple(r) for r in collapse_runs(one).first()["runs"]] == [(0, 8, 1)]  # only ASCII white space parts words


def test_runs_query_equals_brute_force(spark):
    import re

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in QUERIES["op13_word_runs"](spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    with_runs = 0
    for i, t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        r = got[i]
        if h % 10 == 0 or n < 400:
            runs = brute_runs(w) if n < 1500 else find_runs(w)
            gone = {k for a, m, q in runs for k in range(a + q, a + m)}
            assert r["n_runs"] == len(runs) and r["runs_sha256"] == sha("".join(f"{a},{m},{q}\n" for a, m, q in runs))
            assert r["collapsed_sha256"] == sha(" ".join(x for k, x in enumerate(w) if k not in gone))
            if runs:
                best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
                assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (*best, 1000 * best[1] // best[2])
                with_runs += 1
            else:
                assert r["start"] is r["length"] is r["period"] is r["exponent_milli"] is None
    assert with_runs >= 5
