import random

import xxhash
from llm_helpers import prose, union_smallest

from chatsift.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs))


def check(spark, docs):
    got = simhash.near_duplicates(spark.createDataFrame(docs, SCHEMA))
    rows = got.select("doc_id", simhash.fingerprint_hex(got.fp).alias("f"), "component_id").collect()
    fps = {d: brute_fp(t) for d, t, *_ in docs if d is not None}
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fps[a] ^ fps[b]).bit_count() <= 3]
    low = union_smallest(ids, links)
    want = sorted((d, f"{brute_fp(t):016x}", None if d is None else low[d]) for d, t, *_ in docs if d is not None)
    assert sorted((r.doc_id, r.f, r.component_id) for r in rows if r.doc_id is not None) == want
    return rows


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(3)
    base = [prose(rng, n) for n in (1, 2, 3, 40, 200, 400, 600)]
    docs = [(i, t, "x", 1) for i, t in enumerate(base)]
    for k in range(60):
        w = rng.choice(base[3:]).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = "edit"
        docs.append((100 + k, " ".join(w).upper() if k % 3 else " ".join(w), "x", 1))
    docs += [(300, None, "x", 1), (301, "", None, None), (302, " \n\t", "x", 1), (None, base[5], "x", 1)]
    docs += [(303, base[5] * 20, "x", 1), docs[4], docs[4]]
    rows = check(spark, docs)
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


def test_long_lists_are_cut_finer_without_loss(spark):
    """Fingerprints that share most bytes: every level of cutting is reached, links stay exact."""
    rng = random.Random(5)
    fps = {0x123456789ABCDEF0}
    while len(fps) < 700:
        x = rng.choice(sorted(fps))
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            x ^= 1 << rng.randrange(64 if rng.random() < 0.3 else 12)
        fps.add(x)
    rows = [(i, simhash._signed(f)) for i, f in enumerate(sorted(fps))]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "rep long, fp long"), list_limit=20).collect()
    value = dict(rows)
    assert all(((value[a] ^ value[b]) & (2**64 - 1)).bit_count() <= 64 for a, b in links)
    every = [(a, b) for a, x in rows for b, y in rows[:a] if ((x ^ y) & (2**64 - 1)).bit_count() <= 3]
    assert union_smallest(range(len(rows)), [(r.a, r.b) for r in links]) == union_smallest(range(len(rows)), every)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
