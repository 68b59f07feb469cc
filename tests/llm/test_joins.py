"""Operators 3 and 7 and the components against brute force."""
import random

import numpy as np
import pytest

from assay_spark.llm import jaccard_join, vector_graph
from assay_spark.llm.components import components
from assay_spark.llm.jaccard_join import jaccard_components, slice_plan
from assay_spark.llm.vector_graph import near_duplicates


def groups(n, linked):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    linked = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                linked.append((a, b))
    root, least = groups(len(rows), linked), {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root[a]] = min(least.get(root[a], i), i)
    return sorted(((i, len(s), least.get(root[a])) for a, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(seed, count=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([4, 9, 10, 12, 20, 60]))] for _ in range(12)]
    rows = []
    for i in range(count):
        w = list(base[0] if i < count // 3 else rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            j, op = rng.randrange(len(w)), rng.random()
            if op < 0.4:
                w[j] = rng.choice(words)
            elif op < 0.7:
                w.insert(j, rng.choice(words))
            elif len(w) > 1:
                del w[j]
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "a"), (904, "A"), (904, "b c d e f"), (905, "a b"), (None, rows[0][1]), (3, rows[3][1])]


@pytest.mark.parametrize("seed,leaf,k,percent", [(1, 384, 3, 90), (2, 8, 5, 80)])
def test_jaccard_equals_brute_force(spark, monkeypatch, seed, leaf, k, percent):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rows = near_copies(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n int, node string").repartition(3)
    got = sorted(map(tuple, jaccard_components(df, shingle=k, percent=percent).collect()), key=repr)
    assert got == brute(rows, k, percent)


def test_jaccard_of_nothing(spark, empty):
    assert jaccard_components(empty).count() == 0


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
def test_linked_sets_agree_on_enough_slices(percent):
    for low, high in ((9, 12), (40, 50), (500, 625)):
        m, g = slice_plan(low, high, percent)
        for a in range(low, high):
            for b in range(a, a * 100 // percent + 1):
                both = -(-percent * (a + b) // (100 + percent))
                if both <= a and m:
                    assert m - (a + b - 2 * both) >= g


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = dict(map(tuple, components(df).collect()))
    clean = [(a, b) for a, b in edges if a is not None and a != b]
    root = groups(400, clean)
    least = {}
    for i in range(400):
        least[root[i]] = min(least.get(root[i], i), i)
    assert got == {i: least[root[i]] for e in clean for i in e}
    assert components(df.where("a < 0")).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = [(c + 0.12 * rng.normal(size=16)).tolist() for c in centres for _ in range(8)]
    rows = [(i, v, i % 3) for i, v in enumerate(x)]
    rows += [(500, x[0], 0), (501, x[0], 0), (502, [2 * t for t in x[0]], 0), (503, x[0], None), (504, None, 0), (505, [0.0] * 16, 0),
             (506, [float("nan")] + x[0][1:], 0), (507, [None] + x[0][1:], 0), (508, [float("inf")] + x[0][1:], 0), (509, x[0][:8], 0),
             (510, [], 0), (510, x[9], 0), (511, [1e300] * 16, 1), (512, [1e-300] * 16, 1)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "vec_id bigint, embedding array<double>, label int, size int, node string")
    got = {}
    for r in near_duplicates(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    ok = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(t is not None and np.isfinite(t) for t in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in ok}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    linked = [(a, b) for a in ok for b in ok if b < a and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    root, least = groups(len(rows), linked), {}
    for a, r in enumerate(rows):
        least[root[a]] = min(least.get(root[a], r[0]), r[0])
    want = {}
    for a, r in enumerate(rows):
        want.setdefault(r[0], []).append((sum(a in e for e in linked), least[root[a]], least[root[a]] == r[0]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert near_duplicates(df.where("vec_id < 0")).count() == 0


def test_audit_tells_lost_small_groups_from_a_large_one(spark):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=16)
    x = [hot + rng.normal(size=16) * 1e-3 for _ in range(300)]
    for _ in range(20):
        v = rng.normal(size=16)
        x += [v, v + rng.normal(size=16) * 1e-3]
    x = [v / np.linalg.norm(v) for v in x]
    classes = spark.createDataFrame([("1/16", k, 1, v.tolist()) for k, v in enumerate(x)], "label string, node bigint, size bigint, unit array<double>")
    own = np.array([[a @ b >= 0.93 for b in x] for a in x]).sum(1) - 1
    schema = "a bigint, b bigint, n bigint"
    whole = [(k, None, int(n)) for k, n in enumerate(own)]
    assert vector_graph.audit(classes, spark.createDataFrame(whole, schema), 0.93) == 1.0
    assert vector_graph.audit(classes, spark.createDataFrame(whole[:300], schema), 0.93) == 0.0


def test_a_search_that_misses_links_fails(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=8)
    df = spark.createDataFrame([(k, (v + rng.normal(size=8) * 1e-3).tolist(), 1) for k in range(40)], "vec_id bigint, embedding array<double>, label int")
    monkeypatch.setattr(vector_graph, "_search", lambda rows, threshold: spark.createDataFrame([], "a bigint, b bigint, n bigint"))
    with pytest.raises(RuntimeError, match="audited links"):
        near_duplicates(df)


def test_word_hashes_hold_a_bounded_number_of_words():
    from assay_spark.llm.jaccard_join import WordHashes

    h = WordHashes()
    for lot in range(12):
        words = [b"w%d" % i for i in range(lot * 50_000, lot * 50_000 + 50_000)]
        assert len(h.of(words)) == 50_000
        assert len(h.cache) <= 450_000
    again = WordHashes().of([b"w7", b"w599999"])
    assert (h.of([b"w7", b"w599999"]) == again).all()
