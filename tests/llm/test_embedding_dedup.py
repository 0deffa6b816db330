import numpy as np
from llm_helpers import union_smallest

from chatsift.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, links string"


def brute(rows, threshold=0.95):
    good = [(i, np.asarray(v, dtype=np.float64)) for i, v, *_ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                pairs.append((i, j))
    return pairs


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), 0, "x") for i in range(300)]
    for k in range(150):
        base = np.array(rows[k % 20][1])
        rows.append((1000 + k, (base + rng.normal(size=16) * 0.08).astype(np.float32).tolist(), 1, "x"))
    rows += [(2000 + k, rows[5][1], 1, "x") for k in range(10)]
    rows += [(3000, None, 1, "x"), (3001, [0.0] * 16, 1, "x"), (3002, [float("nan")] * 16, None, None),
             (3003, [float("inf")] + [1.0] * 15, 1, "x"), (3004, [], 1, "x"), (3005, [1.0, 2.0], 1, "x"),
             (3006, [2.0, 4.0], 1, "x"), (3007, [None] + [1.0] * 15, 1, "x")]
    return rows


def run(spark, rows, **kw):
    return embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), **kw).collect()


def test_links_equal_brute_force_where_the_window_holds_all(spark):
    rows = vectors()
    pairs = brute(rows)
    got = {r.vec_id: r for r in run(spark, rows)}
    assert len(got) == len(rows)
    low = union_smallest([r[0] for r in rows], pairs)
    for i, *_ in rows:
        assert got[i].n_links == sum(i in p for p in pairs), i
        assert got[i].component_id == low[i] and got[i].kept == (low[i] == i)


def test_narrow_windows_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "STRETCH", 16)
    monkeypatch.setattr(embedding_dedup, "GROUP", 2)
    rows = vectors()
    pairs = brute(rows)
    got = run(spark, rows, n_passes=embedding_dedup.passes_for(460, stretch=16))
    assert 0.9 * 2 * len(pairs) <= sum(r.n_links for r in got) <= 2 * len(pairs)


def test_recall_on_the_given_vectors_and_noisy_copies_of_them(spark):
    from conftest import SF01

    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rng = np.random.default_rng(12)
    rows = [(r.vec_id, list(r.embedding), r.label, "x") for r in df.collect()]
    for k in range(300):  # a third of them copies of one vector
        v = np.array(rows[0 if k % 3 == 0 else k][1])
        rows.append((10_000 + k, (v + rng.normal(size=64) * np.sqrt((v @ v) / 64) * rng.choice([0.15, 0.22])).astype(np.float32).tolist(), 0, "x"))
    pairs = brute(rows)
    assert len(pairs) > 1000
    got = run(spark, rows)
    assert 0.9 * 2 * len(pairs) <= sum(r.n_links for r in got) <= 2 * len(pairs)


def test_windows_alone_find_pairs_whose_codes_differ(spark, monkeypatch):
    """Neighbours in the order need not agree in the signs of a run."""
    monkeypatch.setattr(embedding_dedup, "plan", lambda n, codes, threshold: (embedding_dedup.BITS, 3))
    rows = vectors()
    pairs = brute(rows)
    got = run(spark, rows)  # all vectors fit into one window
    assert sum(r.n_links for r in got) == 2 * len(pairs)


def test_repeated_and_null_ids_and_empty_table(spark):
    v = [1.0, 0.5]
    got = run(spark, [(7, v, 1, "x"), (7, v, 1, "x"), (None, v, 1, "x"), (9, [0.0, 1.0], 1, "x")])
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == [
        ("7", 2, "7"), ("7", 2, "7"), ("9", 0, "9"), ("None", 2, "None")]
    assert run(spark, []) == []


def test_tight_group_larger_than_the_window(spark, monkeypatch):
    """A third of the rows lie around one centre and agree in most signs; only some of them link."""
    monkeypatch.setattr(embedding_dedup, "STRETCH", 16)
    rng = np.random.default_rng(5)
    far, centre = rng.normal(size=(2000, 64)), rng.normal(size=64)
    tight = centre + rng.normal(size=(1000, 64)) * 0.24
    rows = [(i, v.astype(np.float32).tolist(), 0, "x") for i, v in enumerate(np.concatenate([far, tight]))]
    m = np.array([r[1] for r in rows])
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    expected = near.sum(axis=1)
    assert 0 < expected.sum() < 1000 * 999  # neither none nor all pairs of the group
    for n_passes in (None, embedding_dedup.passes_for(3000, stretch=16)):
        got = {r.vec_id: r.n_links for r in run(spark, rows, n_passes=n_passes)}
        assert all(got[i] <= expected[i] for i in got)
        assert sum(got.values()) >= 0.97 * expected.sum()
