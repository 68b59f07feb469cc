"""Trees of all cells in one job: brute force, all kinds, edges, own estimators."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from assay_spark.operators import forests, models
from assay_spark.operators.forests import bin_edges, grouped_trees, predict_cell, to_bins


def brute_tree(codes, y, w, depth):
    """A CART tree by plain recursion; ties to the first feature and bin."""
    total, s = w.sum(), (w * y).sum()
    best, at = 0.0, None
    for f in range(codes.shape[1]):
        for b in range(forests.MAX_BINS):
            left = codes[:, f] <= b
            wl, sl = w[left].sum(), (w * y)[left].sum()
            if wl > 0 and total - wl > 0:
                g = sl ** 2 / wl + (s - sl) ** 2 / (total - wl) - s ** 2 / total
                if round(g, 10) > round(best, 10):
                    best, at = g, (f, b)
    if depth == 0 or at is None or best <= 1e-9 * max(1.0, abs(s * s / total)):
        return s / total
    left = codes[:, at[0]] <= at[1]
    return at, brute_tree(codes[left], y[left], w[left], depth - 1), brute_tree(codes[~left], y[~left], w[~left], depth - 1)


def walk(tree, code):
    while isinstance(tree, tuple):
        (f, b), low, high = tree
        tree = low if code[f] <= b else high
    return tree


@pytest.mark.parametrize("depth", [1, 3, 12])
def test_trees_equal_brute_force(depth, monkeypatch):
    rng = np.random.default_rng(depth)
    x, test = rng.normal(size=(70, 4)).round(1), rng.normal(size=(30, 4)).round(1)
    y = np.where(x[:, 1] > 0.3, 2.0, -1.0) + x[:, 0] + 0.1 * rng.normal(size=70)
    edges = bin_edges(x)
    codes, codes_test = to_bins(x, edges), to_bins(test, edges)
    weights = rng.integers(0, 4, (3, 70)).astype(float)
    for cells in (forests.HIST_CELLS, 200):  # levels split in one piece or in many
        monkeypatch.setattr(forests, "HIST_CELLS", cells)
        got = forests.grow(codes, y, weights, depth, 4, rng, codes_test)[1]
        for t in range(3):
            some = weights[t] > 0
            tree = brute_tree(codes[some], y[some], weights[t][some], depth)
            assert np.allclose(got[t], [walk(tree, c) for c in codes_test])


def test_bins_split_where_values_do():
    x = np.array([[0.0], [1.0], [1.0], [5.0]])
    assert bin_edges(x)[0].tolist() == [0.5, 3.0] and to_bins(np.array([[0.5], [0.6], [9.0]]), bin_edges(x)).ravel().tolist() == [0, 1, 2]
    assert len(bin_edges(np.arange(1000.0)[:, None])[0]) == forests.MAX_BINS - 1


@pytest.fixture()
def cells(spark):
    rng = np.random.default_rng(0)
    rows = []
    for cell in range(4):
        for i in range(60):
            x = rng.normal(size=3)
            rows.append((cell, i, x.tolist(), float(3 * (x[0] > 0) + x[1]), "test" if i % 5 == 0 else "train"))
    rows.append((0, 5, *rows[5][2:]))  # a test row that repeats
    return spark.createDataFrame(rows, "cell int, row_id int, x array<double>, y double, split string")


@pytest.mark.parametrize("kind", ["forest", "bagging", "tree", "gbt"])
def test_all_kinds_beat_the_mean(spark, cells, kind, monkeypatch):
    monkeypatch.setitem(forests.KINDS, "forest", (30, 10, 1 / 3, True, 0.0))
    got = {r["cell"]: r for r in models.evaluate(cells, ["cell"], [kind]).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert all(r["r2"] > 0.4 and r["algorithm"] == kind for r in got.values())
    assert got[0]["n"] == 13 and got[1]["n"] == 12


def test_groups_of_trees_add_up(spark, cells, monkeypatch):
    monkeypatch.setattr(forests, "GROUP_TREES", 4)
    got = {(r["cell"], r["row_id"]): r["y_hat"] for r in grouped_trees(cells, ["cell"], "bagging").collect()}
    again = {(r["cell"], r["row_id"]): r["y_hat"] for r in grouped_trees(cells.repartition(7), ["cell"], "bagging").collect()}
    assert len(got) == 48 and all(abs(got[k] - again[k]) < 1e-9 for k in got)


def test_number_of_jobs_does_not_depend_on_the_cells(spark, cells):
    plan = grouped_trees(cells, ["cell"], "forest")._jdf.queryExecution().executedPlan().toString()
    one = grouped_trees(cells.where("cell = 1"), ["cell"], "forest")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == one.count("Exchange") and plan.count("FlatMapGroupsInPandas") == 1


def test_large_cells_take_a_distributed_fit(spark, cells, monkeypatch):
    monkeypatch.setattr(forests, "MAX_CELL_VALUES", 60 * 3)
    assert forests.too_large(cells, ["cell"]) == [(0,)]
    assert {r["cell"] for r in grouped_trees(cells, ["cell"], "tree").collect()} == {1, 2, 3}
    got = {r["cell"]: r["n"] for r in models.evaluate(cells, ["cell"], ["tree"]).collect()}
    assert got == {0: 13, 1: 12, 2: 12, 3: 12}


def test_edges(spark):
    schema = "cell int, row_id int, x array<double>, y double, split string"
    assert grouped_trees(spark.createDataFrame([], schema), ["cell"], "tree").count() == 0
    rows = [(1, 1, [1.0], 2.0, "train"), (1, 2, [1.0], None, "train"), (1, 3, [9.0], None, "test"), (1, 4, [None], 5.0, "test"),
            (2, 5, [1.0], 1.0, "test"), (3, 6, [1.0], 1.0, "train")]
    got = sorted((r["cell"], r["row_id"], r["y_hat"]) for r in grouped_trees(spark.createDataFrame(rows, schema), ["cell"], "gbt").collect())
    assert got == [(1, 3, 2.0), (1, 4, 2.0)]
    assert predict_cell("forest", np.zeros((3, 0)), np.array([1.0, 2.0, 3.0]), np.zeros((2, 0)), 5, [1]).shape == (2,)


def test_own_estimators(spark, cells):
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    got = models.evaluate(cells.where("cell < 2"), ["cell"], {"mine": DecisionTreeRegressor(maxDepth=4), "made": lambda: LinearRegression(), "mean": None})
    rows = {(r["cell"], r["algorithm"]): r["r2"] for r in got.collect()}
    assert set(rows) == {(c, a) for c in (0, 1) for a in ("mine", "made", "mean")}
    assert all(rows[c, "mine"] > rows[c, "mean"] for c in (0, 1))


def test_cells_are_computed_once(spark, cells):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    models.evaluate(cells.mapInArrow(count, cells.schema), ["cell"], ["mean"]).collect()
    assert seen.value == cells.agg(F.count("*")).first()[0]
