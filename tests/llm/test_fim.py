import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from chatsift.llm import fim

SCHEMA = "doc_id long, text string, n int, output string"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(11)
    alphabet = ["a", "é", "日", "😀", " ", " ", "\t", "\n", "\x0b", " ", "　", "<", "P>", "<S", ">", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 40, 300]))) for _ in range(300)]
    texts += [None, "", " ", "\n\n", "x", " x", "x ", "has <P> in it", "<M>", "a <S", "w" * 5000, " " * 5000, "é " * 40_000]
    return list(enumerate(texts))


def test_ranks_are_reached_exactly_at_every_unit():
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 500):
        units = [rng.choice(["a", "bé ", "日本", " 😀x"]) for _ in range(n)]
        chars, size = np.cumsum([len(u) for u in units], dtype=np.int64), np.cumsum([len(u.encode()) for u in units], dtype=np.int64)
        heights = fim.node_heights(n)
        lanes = fim.UnitSkipList(chars, size, heights)
        assert len(lanes.lanes) == (heights.max() if n else 0)
        for rank in range(n + 1):
            assert lanes.reach(rank) == (len("".join(units[:rank])), len("".join(units[:rank]).encode()))


def test_heights_thin_out_by_four():
    share = [(fim.node_heights(100_000) > k).mean() for k in range(4)]
    assert share[0] == 1 and all(0.2 < b / a < 0.3 for a, b in zip(share, share[1:]))


def test_odd_texts_equal_brute_force_and_are_restored(spark):
    rows = [(i, t, 7, "x") for i, t in odd_texts()] + [(None, "no id but some words here", 7, "x")] * 2
    made = fim.transform(spark.createDataFrame(rows, SCHEMA))
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(
        ((i, *brute(i, t)) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.back) for r in got), key=str) == sorted(((i, t or "") for i, t, *_ in rows), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], SCHEMA)).collect() == []
