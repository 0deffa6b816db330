import hashlib
import random

import pytest

from chatsift.llm import suffix_dedup

SCHEMA = "doc_id long, text string, spans string, d int"


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for i, t in enumerate(raw):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((i, s))
    gone = [bytearray(len(t)) for t in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + length] = b"\1" * length
    out = []
    for t, g in zip(raw, gone):
        kept = bytes(c for c, x in zip(t, g) if not x)
        runs = sum(x and (j == 0 or not g[j - 1]) for j, x in enumerate(g))
        out.append((len(t), sum(g), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, length, gram):
    df = spark.createDataFrame([(i if i % 17 else 5, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = suffix_dedup.remove_repeats(df, length=length, gram=gram).collect()
    assert sorted(tuple(r)[1:5] for r in got) == sorted(brute(texts, length))


def corpus(seed, n=60):
    rng = random.Random(seed)
    text = lambda k, letters="abcdefé日 ": "".join(rng.choice(letters) for _ in range(k))
    passages = [text(rng.choice([30, 45, 60, 150])) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [text(rng.randrange(120))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.randrange(12) if rng.random() < 0.4 else 0
            parts += [p[cut:], text(rng.randrange(60))]
        out.append("".join(parts))
    for t in list(out[:10]):
        w = list(t)
        if w:
            w[rng.randrange(len(w))] = "#"
        out.append("".join(w))
    return out + [None, "", "a" * 500, "ab" * 200, out[0], out[0], "x" + out[1], text(39), text(40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    check(spark, corpus(seed), 40, 8)


def test_large_groups_are_cut_finer_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", 3)
    check(spark, corpus(3, 120), 40, 8)


def test_buffers_cut_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcd") for _ in range(9000))
    texts = [long, long[1000:5000] + "x" + long[:700], long[4000:], "abcd" * 300]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 512)
    check(spark, texts, 64, 16)


def test_shuffled_lists_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ITEMS", -1)
    check(spark, corpus(4), 40, 8)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
