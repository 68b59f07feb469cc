"""Counted shot noise: the draws are hashed in tables, as the md5 keys they stand for."""
import hashlib
import math

import numpy as np
import pytest

from assay_spark.functions.keys import draw_ints
from assay_spark.operators import features as FE


def draw(text: bytes) -> int:
    return int(hashlib.md5(text).hexdigest()[:15], 16)


@pytest.mark.parametrize("n", [0, 1, 9, 54, 55, 56, 63, 64, 65, 130])
def test_draw_ints_are_md5_keys(n):
    for m in (1, 7, 8, 60):
        left = [bytes(65 + (7 * r + i) % 50 for i in range(n)) for r in range(3)]
        right = [bytes(48 + (3 * r + i) % 40 for i in range(m)) for r in range(5)]
        assert draw_ints(left, right).tolist() == [[draw(a + b) for b in right] for a in left]


def test_counts_do_not_depend_on_the_tables_they_are_cut_into(monkeypatch):
    chances = np.random.default_rng(1).random((6, 12))
    keys = [f"{r}|120|1".encode() for r in range(6)]
    whole = FE._counts(keys, chances, 120, 3)
    monkeypatch.setattr(FE, "DRAWS", 50)
    assert (FE._counts(keys, chances, 120, 3) == whole).all()


def test_counted_noise_is_hashed_in_tables(spark):
    xs = [[0.5, -0.5, 1.0, -1.0] * 3, [None, math.nan, 0.25], None, [], [2.0, -3.0, -0.0]]
    rows = [(None if i % 4 == 3 else 10 ** (i % 6), x) for i, x in enumerate(xs * 3)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>")
    n = FE.add_shot_noise(df, "row_id", "x", [0, 7, 120], loops=2, seed=3)
    # one interpreted md5 expression per draw used to take most of the query's time
    assert "md5" not in n._jdf.queryExecution().executedPlan().toString()

    def below(e, u):  # no draw is below null, every one is below NaN
        return e is not None and (math.isnan(e) or u / 2 ** 60 < (1.0 + e) / 2.0)

    def wanted(rid, x, shots, loop):
        if x is None or shots == 0:
            return x
        key = "|".join(str(v) for v in (rid, shots, loop) if v is not None)
        return [2.0 * sum(below(e, draw(f"{key}|{i}|{j}|3".encode())) for j in range(1, shots + 1)) / shots - 1.0
                for i, e in enumerate(x)]

    want = [(rid, x, s, l, wanted(rid, x, s, l)) for rid, x in rows for s in (0, 7, 120) for l in (1, 2)]
    got = [(r["row_id"], r["x"], r["shots"], r["loop"], r["noisy"]) for r in n.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
