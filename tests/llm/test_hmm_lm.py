import itertools
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from chatsift.llm import hmm_lm

SCHEMA = "doc_id long, text string, score string, id int"


def corpus():
    rng = random.Random(1)
    en, fr = [f"en{i}" for i in range(60)], [f"fr{i}é" for i in range(60)]
    docs = [(i, " ".join(rng.choice(en if i % 2 else fr) for _ in range(rng.choice([3, 20, 60]))), "x", 1) for i in range(400)]
    return docs + [(1000, None, "x", 1), (1001, "", None, None), (1002, "EN1 \x0b en1 x", "x", 1),
                   (1003, "en1 " * 3000, "x", 1), docs[0], (None, "en1 unseenword", "x", 1)]


def test_base_scores_and_counts_equal_brute_force(spark):
    docs = corpus()
    got = {(r.doc_id, r.n_tokens, r.n_known, r.held_out, r.train_tokens, round(r.base_score, 6)): r.score
           for r in hmm_lm.score_documents(spark.createDataFrame(docs, SCHEMA), steps=2).collect()}
    toks = lambda t: (t or "").encode().lower().split() + [b" "]
    fold = lambda d: crc32(str(d if d is not None else "").encode()) % 7 == 2
    c = Counter(w for d, t, *_ in docs if not fold(d) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = {(d, len(toks(t)), sum(c[w] > 0 for w in toks(t)), fold(d), n,
             round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 6)) for d, t, *_ in docs}
    assert set(got) == want
    assert all(s < 0 and math.isfinite(s) for s in got.values())


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = hmm_lm.score_documents(spark.createDataFrame(corpus(), SCHEMA)).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.1 * sum(r.n_tokens for r in rows)


def test_forward_sums_equal_all_paths_and_expected_counts(monkeypatch):
    rng = np.random.default_rng(0)
    k, c = 3, hmm_lm.CLASSES + 1
    emit = rng.random((c, k))
    m = hmm_lm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), emit / emit.sum(axis=0))
    seqs = [np.array(x, dtype=np.uint16) for x in ([1, 2, 3, 1], [5], [7, 7, 2])]
    batch = hmm_lm._Batch(seqs)
    first, move, emitted, total = np.zeros(k), np.zeros((k, k)), np.zeros((c, k)), 0.0
    logs = []
    for x in seqs:
        paths = {}
        for p in itertools.product(range(k), repeat=len(x)):
            q = m.first[p[0]] * m.emit[x[0], p[0]]
            for t in range(1, len(x)):
                q *= m.move[p[t - 1], p[t]] * m.emit[x[t], p[t]]
            paths[p] = q
        z = sum(paths.values())
        logs.append(math.log10(z))
        for p, q in paths.items():
            first[p[0]] += q / z
            for t in range(len(x)):
                emitted[x[t], p[t]] += q / z
                if t:
                    move[p[t - 1], p[t]] += q / z
    assert np.allclose(batch.log10_likelihoods(m), logs)
    got = hmm_lm._Batch(seqs).expected_counts(m)
    for a, b in zip(got, (first, move, emitted, sum(logs))):
        assert np.allclose(a, b)


def test_rare_words_go_through_the_join(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known)
    whole = sorted((key(r), r.base_score) for r in hmm_lm.score_documents(docs, steps=1).collect())
    monkeypatch.setattr(hmm_lm, "FREQUENT", 3)
    few = sorted((key(r), r.base_score) for r in hmm_lm.score_documents(docs, steps=1).collect())
    assert [x[0] for x in whole] == [x[0] for x in few]
    assert [x[1] for x in whole] == pytest.approx([x[1] for x in few])


def test_empty_table_and_no_training_rows(spark):
    assert hmm_lm.score_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    out = next(i for i in range(99) if crc32(str(i).encode()) % 7 == 2)
    row = hmm_lm.score_documents(spark.createDataFrame([(out, "a b", "x", 1)], SCHEMA)).first()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and math.isfinite(row.score)
