from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatsift.llm import mixing

SCHEMA = "doc_id long, text string, source string, mix_slot int"


def test_schedule_deviates_by_less_than_one_block():
    share = mixing.shares({"a": 700, "b": 211, "c": 50, "d": 1}, 500)
    assert sum(share.values()) == 500 and min(share.values()) >= 1
    done = Counter()
    for s, i, slot in mixing.period_schedule(share, 500):
        assert i == done[s] and i * 500 // share[s] <= slot < -(-(i + 1) * 500 // share[s])
        done[s] += 1
        assert all(abs(done[x] - share[x] * (slot + 1) / 500) < 1 for x in share)


def test_every_row_once_and_in_proportion(spark):
    rows = [(i, f"t{i}", ("big", "big", "mid", None, "")[i % 5] if i % 11 else "tiny", 5) for i in range(4000)]
    rows += [(7, "t7", "mid", 1)] * 3 + [(None, None, "mid", 1)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), block_rows=8).collect()
    assert sorted(str((r.doc_id, r.text, r.source)) for r in got) == sorted(str(r[:3]) for r in rows)
    assert len({(r.mix_slot, r.mix_rank) for r in got}) == len(got)
    for s in {r.source for r in got}:
        own = sorted((r.mix_block, r.mix_rank) for r in got if r.source == s)
        assert own == [divmod(i, 8) for i in range(len(own))]
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    slots = {}
    for r in got:
        slots[r.mix_slot] = r.source
    last = min(max(r.mix_slot for r in got if r.source == s) for s in {r.source for r in got})
    counts = Counter()
    given = {s: sum(x.source == s for x in got) for s in set(slots.values())}
    share = mixing.shares({repr(s): int(n**0.5 * 1000) for s, n in given.items()}, 1000)
    for t in range(last + 1):
        counts[slots[t]] += 1
        assert all(abs(counts[s] - share[repr(s)] * (t + 1) / 1000) < 2 for s in given)


def test_given_weights_and_errors(spark):
    df = spark.createDataFrame([(i, "t", "ab"[i % 2], 0) for i in range(100)], SCHEMA)
    got = mixing.mix(df, {"a": 3, "b": 1}, block_rows=1).orderBy("mix_slot").collect()
    assert sum(r.source == "a" for r in got[:40]) == 30
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 1})
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 1, "b": 0})
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_unequal_weights_deviate_by_less_than_one_block(spark, monkeypatch):
    """100 sources, one with half of the weight and one with a 2,000th: against the weights themselves."""
    monkeypatch.setattr(mixing, "PIECE", 1500)  # the schedule comes in several pieces
    weights = {f"s{k:02d}": 100 + k for k in range(98)} | {"half": 0, "rare": 0}
    rest = sum(weights.values())
    weights["half"], weights["rare"] = rest, max(1, rest // 1000)
    total, slots = sum(weights.values()), 4000
    rows = [(i, "t", s, 0) for s, w in weights.items() for i in range(slots * w // total + 2)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights, block_rows=1).collect()
    assert len(got) == len(rows) and len({r.mix_slot for r in got}) == len(got)
    at, done = {r.mix_slot: r.source for r in got}, Counter()
    for t in range(slots):
        done[at[t]] += 1
        assert all(abs(done[s] * total - w * (t + 1)) < total for s, w in weights.items())
    for r in got:
        w = weights[r.source]
        assert r.mix_release == r.mix_block * total // w and r.mix_deadline == -(-(r.mix_block + 1) * total // w)


def test_unequal_sources_equal_the_sql(spark):
    import duckdb
    import pandas as pd
    from oracle_harness import compare

    from chatsift.llm.oracles import ORACLES

    rows = [(i, s, "x") for s, (n, base) in {"a": (3000, 0), "b": (300, 10_000), "c": (40, 20_000), None: (5, 30_000)}.items()
            for i in range(base, base + n)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "source", "text"]))
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).select(
        "doc_id", "source", *[F.col(f"mix_{c}").alias(c) for c in ("block", "rank", "slot", "release", "deadline")])
    res = compare(mixed, con, ORACLES["op2_mixing"])
    assert res["rows"] == (3345, 3345) and res["hash_match"], res["first_diff"]


def test_input_columns_of_any_name_are_kept(spark):
    cols = ["mix_at", "mix_share", "mix_nth", "mix_bucket", "mix_source", "mix_key", "mix_turn", "mix_start", "_mix_at", "mix_block"]
    rows = [(i, "s", *[f"{c}{i}" for c in cols]) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"{c} string" for c in cols))
    got = mixing.mix(df).collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in cols[:-1])
    assert {r.mix_block for r in got} == {0} and sorted(r.mix_rank for r in got) == list(range(9))
