"""Conversation -> examples (FIXTURES 2.3), the array form, and the heavy-hitter (blocked) path of
the trailing-context operator checked against a brute-force restatement."""

import random

import pytest
from pyspark.sql import functions as F

from chatsift.config import SkewConfig
from chatsift.operators.context import array_examples, conversation_examples, trailing_context
from chatsift.operators.skew import HotKeys, with_blocks

SP = "sys prompt"


def convo(spark, roles, texts=None):
    texts = texts or [f"{r} text {i}" for i, r in enumerate(roles)]
    rows = [(1, i, {"S": "system", "U": "user", "A": "assistant"}[r], t) for i, (r, t) in enumerate(zip(roles, texts))]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def run(spark, roles, k=8, texts=None, skew=SkewConfig()):
    df = conversation_examples(convo(spark, roles, texts), system_prompt=SP, source="t", k=k, skew=skew)
    out = []
    for r in df.orderBy("turn").collect():
        out.append(([m.role[0].upper() + str(_pos(m, roles, texts)) for m in r.prompt[1:]], r.turn))
    return out


def _pos(m, roles, texts):
    texts = texts or [f"{r} text {i}" for i, r in enumerate(roles)]
    return texts.index(m.content)


@pytest.mark.parametrize("skew", [SkewConfig(), SkewConfig(hot_key_rows=1, block_rows=2)])
def test_fixture_cases(spark, skew):
    assert run(spark, "UAUA", skew=skew) == [(["U0"], 1), (["U0", "A1", "U2"], 3)]
    assert run(spark, "UAA", skew=skew) == [(["U0"], 1)]
    assert run(spark, "AUA", skew=skew) == [(["A0", "U1"], 2)]
    assert run(spark, "UUA", skew=skew) == [(["U0", "U1"], 2)]
    assert run(spark, "USA", skew=skew) == [(["U0"], 2)]
    assert run(spark, "UAA", texts=["user a", " ", "asst b"], skew=skew) == [(["U0"], 2)]
    assert run(spark, "UAUA", k=1, skew=skew) == [(["U0"], 1), (["U2"], 3)]
    assert run(spark, "UAUA", k=0, skew=skew) == [(["U0"], 1), (["U0", "A1", "U2"], 3)]
    long_reply = ["u0", "x" * 1201, "u2", "a3"]
    assert run(spark, "UAUA", texts=long_reply, skew=skew) == [(["U0", "A1", "U2"], 3)]


def test_fifth_context_starts_with_assistant(spark):
    got = run(spark, "UA" * 5)
    assert len(got) == 5 and len(got[-1][0]) == 8 and got[-1][0][0].startswith("A")


def test_array_form_equals_turn_form(spark):
    roles = "UAUAAUSAUA"
    turn_rows = run(spark, roles, k=3)
    texts = [f"{r} text {i}" for i, r in enumerate(roles)]
    msgs = [{"role": {"S": "system", "U": "user", "A": "assistant"}[r], "content": t} for r, t in zip(roles, texts)]
    df = spark.createDataFrame([(1, msgs)], "id long, messages array<struct<role:string,content:string>>")
    ex = array_examples(df, "messages", system_prompt=SP, source="t", k=3, keep=("id",))
    arr = [[m.content for m in r.prompt[1:]] for r in ex.orderBy("reply_pos").collect()]
    assert arr == [[texts[int(x[1:])] for x in p] for p, _ in turn_rows]


def brute(rows, k):
    """rows: (key, seq, is_item, is_reset, val) -> {(key, seq): ctx list}."""
    out = {}
    hist = {}
    for key, seq, is_item, is_reset, val in sorted(rows):
        if is_reset:
            hist[key] = []
        h = hist.setdefault(key, [])
        out[(key, seq)] = (h[-k:] if k > 0 else list(h))
        if is_item and not is_reset:
            h.append(val)
    return out


@pytest.mark.parametrize("k,span,hot", [(3, 4, "all"), (1, 3, "all"), (4, 5, "some"), (2, 100, "none"), (0, 5, "none"),
                                        (0, 4, "all"), (0, 7, "some")])
def test_trailing_context_blocked_matches_brute_force(spark, k, span, hot):
    rng = random.Random(k * 100 + span)
    rows = []
    for key in range(4):
        n = rng.randint(1, 60) if key else 120
        seqs = sorted(rng.sample(range(0, 400), n))
        for s in seqs:
            rows.append((key, s, rng.random() < 0.7, rng.random() < 0.05, f"v{key}-{s}"))
    df = spark.createDataFrame(rows, "key long, seq long, is_item boolean, is_reset boolean, val string")
    hk = {"all": HotKeys(all_keys=True), "some": HotKeys(rows=((0,), (2,))), "none": HotKeys()}[hot]
    out = trailing_context(df, keys=["key"], seq="seq", item=F.col("val"), k=k, is_item=F.col("is_item"),
                           is_reset=F.col("is_reset"), hot=hk, block_rows=span)
    got = {(r.key, r.seq): list(r.ctx) for r in out.collect()}
    want = brute(rows, k)
    assert got == want


def test_blocked_equals_plain_on_driver_data(spark):
    from conftest import SF01

    turns = spark.read.parquet(f"{SF01}/conversations.parquet")
    plain = conversation_examples(turns, system_prompt=SP, source="t", k=3)
    blocked = conversation_examples(turns, system_prompt=SP, source="t", k=3,
                                    skew=SkewConfig(hot_key_rows=2, block_rows=2))
    a = sorted(map(tuple, plain.select("conv_id", "turn", F.to_json("prompt")).collect()))
    b = sorted(map(tuple, blocked.select("conv_id", "turn", F.to_json("prompt")).collect()))
    assert a == b and len(a) > 100


def test_hot_conversation_found_by_sampled_probe_and_blocked(spark):
    from chatsift.operators.skew import hot_keys

    rows = [(0, t, "user" if t % 2 == 0 else "assistant", f"hot message {t}") for t in range(3000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"c{c} t{t}") for c in range(1, 40) for t in range(6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    skew = SkewConfig(hot_key_rows=1000, block_rows=256, probe_fraction=0.5)
    assert hot_keys(turns.select("conv_id"), ["conv_id"], skew).rows == ((0,),)
    plain = conversation_examples(turns, system_prompt=SP, source="t", k=8)
    blocked = conversation_examples(turns, system_prompt=SP, source="t", k=8, skew=skew)
    a = sorted(map(tuple, plain.select("conv_id", "turn", F.to_json("prompt")).collect()))
    b = sorted(map(tuple, blocked.select("conv_id", "turn", F.to_json("prompt")).collect()))
    assert a == b and len(a) == 1500 + 39 * 3


@pytest.mark.parametrize("name,seqs", [
    ("outlier", [0, *range(1_700_000_000_000, 1_700_000_010_000)]),
    ("clusters", [c * 10**15 + i for c in range(5) for i in range(1500)] + [-(10**17)]),
    ("even", list(range(0, 70_000, 7))),
    ("powers", [2**i for i in range(62)] + list(range(10**6, 10**6 + 5000))),
])
def test_blocks_of_a_hot_key_are_near_equal_however_its_sequence_lies(spark, name, seqs):
    df = spark.createDataFrame([(1, s) for s in seqs] + [(None, s) for s in seqs[::2]] + [(2, 5)], "k long, seq long")
    got = with_blocks(df, ["k"], "seq", HotKeys(rows=((1,), (None,))), 100).collect()
    assert len(got) == len(seqs) + len(seqs[::2]) + 1
    for key, own in ((1, seqs), (None, seqs[::2])):
        blocks = {}
        for r in got:
            if r.k == key:
                blocks.setdefault(r._blk, []).append(r.seq)
        assert max(map(len, blocks.values())) < 200 and len(blocks) <= len(own) / 100 + 1
        spans = sorted((b, min(x), max(x)) for b, x in blocks.items())
        assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))  # blocks follow the sequence
    assert [r._blk for r in got if r.k == 2] == [0]


def test_tied_sequences_stay_together(spark):
    df = spark.createDataFrame([(1, 7)] * 500 + [(1, i) for i in range(100, 400)], "k long, seq long")
    got = with_blocks(df, ["k"], "seq", HotKeys(all_keys=True), 50).groupBy("_blk").count().collect()
    assert sorted(r["count"] for r in got)[-1] == 500 and sorted(r["count"] for r in got)[-2] < 100
