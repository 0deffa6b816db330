import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatsift.llm import exact_topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, score string, block int"
LONG = (-(1 << 63) + 1, (1 << 63) - 1)


def usable(rows):
    return [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def score(a, b):
    whole = lambda v: [math.floor(256 * Fraction(x)) for x in v]
    return min(LONG[1], max(LONG[0], sum(x * y for x, y in zip(whole(a), whole(b)))))


def brute(rows, step, k=5):
    rows, out = usable(rows), []
    for at, q in enumerate(rows):
        if q[0] % step == 0:
            best = sorted((-score(q[1], c[1]), c[0]) for i, c in enumerate(rows) if i != at and len(c[1]) == len(q[1]))[:k]
            out += [(q[0], r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def run(spark, rows, step, k=5):
    got = exact_topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % step == 0, k).collect()
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in got)


def clustered(n=1200, dim=12, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    m = centres[rng.integers(0, 9, n)] + rng.normal(size=(n, dim)) * 0.1
    m[: n // 3] = m[0]  # a third of all rows are equal
    return [(int(i), v.tolist(), 1, "x", 2) for i, v in zip(rng.permutation(n) - n // 2, m)]


ODD = [(None, [1.0, 2.0], 1, "x", 1), (-7, None, 1, "x", 1), (700, [float("nan"), 1.0], 1, "x", 1), (701, [None, 1.0], 1, "x", 1),
       (702, [float("inf"), 1.0], 1, "x", 1), (703, [], 1, "x", 1), (704, [], 1, "x", 1), (0, [], 1, "x", 1), (705, [1.0, 2.0], 1, "x", 1),
       (705, [1.0, 2.0], 1, "x", 1), (-14, [0.5, -0.25], 1, None, None), (7, [1.0], 1, "x", 1), (14, [-2.0], 1, "x", 1), (21, [0.0, 0.0], None, "x", 1),
       (7, [1.0], 1, "x", 1)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 32)
    monkeypatch.setattr(vectors, "GROUP_LEAST", 64)
    monkeypatch.setattr(vectors, "GROUP_ROWS", 128)


def test_clusters_and_ties_equal_brute_force(spark, small):
    rows = clustered()
    assert run(spark, rows, 50) == brute(rows, 50)


def test_beyond_the_held_ranges_every_group_is_asked(spark, small, monkeypatch):
    monkeypatch.setattr(vectors, "MAX_RANGE_VALUES", 10)
    rows = clustered(500)
    assert run(spark, rows, 50) == brute(rows, 50)


def test_odd_rows_equal_brute_force(spark):
    assert run(spark, ODD, 7) == brute(ODD, 7)
    assert run(spark, [], 7) == [] and run(spark, ODD[:5], 1) == []


def test_values_beyond_doubles_and_longs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(-3, 16)).tolist(), 1, "x", 1) for i in range(60)]
    rows += [(100 + i, [1e300 * (-1) ** i, 1e308, 5e-324], 1, "x", 1) for i in range(4)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(2)
    for dim in (1, 3, 16, 30):
        q, x = (np.floor(256 * rng.normal(size=(40, dim))) for _ in range(2))
        scores, before = q @ x.T, np.full((40, 40), np.inf)
        for borders in exact_topk.levels(dim):
            bound = exact_topk.statistics(q, borders) @ exact_topk.statistics(x, borders).T
            assert (bound >= scores - 1e-6 * np.abs(scores) - 1e-6).all()
            assert (bound <= before + 1e-6 * np.abs(bound) + 1e-6).all()
            before = bound


def test_most_candidates_of_other_clusters_are_dropped():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(2, 64)).repeat([1, 1], axis=0) * 4
    q = np.floor(256 * (centres[0] + rng.normal(size=(10, 64)) * 0.1))
    x = np.floor(256 * (np.concatenate([centres[0] + rng.normal(size=(20, 64)) * 0.1, -centres[0] + rng.normal(size=(500, 64)) * 0.1])))
    borders = exact_topk.levels(64)
    floor = np.partition(q @ x.T, -5, axis=1)[:, -5].astype(np.int64)
    rows, cols, alive = exact_topk.survivors(
        [exact_topk.statistics(q, b) for b in borders], [exact_topk.statistics(x, b) for b in borders], floor)
    assert len(rows) == 10 and set(cols) <= set(range(20)) and alive.sum() >= 50
