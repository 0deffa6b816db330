import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_exact_topk import ODD, SCHEMA, clustered, score, usable

from chatsift.llm import hard_negatives, vectors


def brute(rows, step):
    rows, out = [r for r in usable(rows) if r[2] is not None], []
    for at, a in enumerate(rows):
        if a[0] % step:
            continue
        others = [(-score(a[1], c[1]), c[0], c[2]) for i, c in enumerate(rows) if i != at and len(c[1]) == len(a[1])]
        others.sort(key=lambda x: x[:2])
        for ps, p, _ in [x for x in others if x[2] == a[2]][:5]:
            ps = -ps
            fit = [(-s, i) for s, i, lab in others if lab != a[2] and 80 * ps <= 100 * -s <= 100 * ps][:5]
            out += [(a[0], p, r + 1, i, ps, s) for r, (s, i) in enumerate(fit)]
    return sorted(out)


def run(spark, rows, step):
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % step == 0).collect()
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got)


def labelled(n=900):
    rng = np.random.default_rng(8)
    return [(i, v, int(lab), s, b) for (i, v, _, s, b), lab in zip(clustered(n), rng.choice(4, n, p=[0.6, 0.2, 0.1, 0.1]))]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(vectors, "GROUP_LEAST", 64)
    monkeypatch.setattr(vectors, "GROUP_ROWS", 96)


def test_skewed_labels_and_equal_vectors_equal_brute_force(spark, small):
    rows = labelled()
    expected = brute(rows, 30)
    assert run(spark, rows, 30) == expected and len(expected) > 50


def test_beyond_the_held_zone_maps_every_group_is_asked(spark, small, monkeypatch):
    monkeypatch.setattr(vectors, "MAX_RANGE_VALUES", 10)
    rows = labelled(400)
    assert run(spark, rows, 20) == brute(rows, 20)


def test_odd_rows_equal_brute_force(spark):
    rows = ODD + [(28, [1.5], 2, "x", 1), (35, [1.25], 2, "x", 1), (42, [-1.0], 3, "x", 1), (49, [1e300], 1, "x", 1), (56, [9e299], 2, "x", 1)]
    assert run(spark, rows, 7) == brute(rows, 7)
    assert run(spark, [], 7) == []


def test_hilbert_curve_visits_each_cell_once_and_steps_to_neighbours():
    for d, bits in ((2, 3), (3, 2), (4, 2), (2, 1), (1, 4)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        index = hard_negatives.hilbert_index(cells, bits)
        assert sorted(index) == list(range(1 << (d * bits)))
        steps = np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_interval_bounds_hold():
    rng = np.random.default_rng(9)
    q, x = np.floor(rng.normal(size=(30, 8)) * 50), np.floor(rng.normal(size=(64, 8)) * 50)
    low, high = x.reshape(4, 16, 8).min(axis=1), x.reshape(4, 16, 8).max(axis=1)
    least, greatest = hard_negatives.score_bounds(q, low, high)
    scores = (q @ x.T).reshape(30, 4, 16)
    assert (least <= scores.min(axis=2)).all() and (scores.max(axis=2) <= greatest).all()
