"""Randomised differential tests on dirty fixtures (odd roles, empty and over-long texts, system
turns anywhere, random JSON objects, random chat event sequences, boundary-value requests):
Spark against the DuckDB oracle SQL, or against a small state-machine / rule restatement."""

import random

import pytest
from pyspark.sql import functions as F

from chatsift.config import SkewConfig
from chatsift.operators.context import conversation_examples
from test_text import normalized

SP = "the system prompt"
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", " User ", "ASSISTANT\t", "", None]


def random_text(rng):
    kind = rng.random()
    if kind < 0.1:
        return rng.choice(["", "  ", "\t\n", None])
    if kind < 0.15:
        return "y" * rng.choice([1200, 1201, 1300])
    words = [rng.choice(["hi", "ok", "a", "thanks", "what?", "é", "x"]) for _ in range(rng.randint(1, 6))]
    return rng.choice([" ", "  ", "\t", "\n"]).join(words)


def _duck_with(name, pdf):
    import duckdb

    con = duckdb.connect()
    con.register(name, pdf)
    return con


@pytest.mark.parametrize("k,skew", [(3, SkewConfig()), (0, SkewConfig()), (3, SkewConfig(hot_key_rows=5, block_rows=4)),
                                    (8, SkewConfig(hot_key_rows=5, block_rows=3))])
def test_random_conversations_match_sql_oracle(spark, k, skew):
    """Random conversations: the Spark generator against the DuckDB oracle SQL on the same rows."""
    import pandas as pd

    from chatsift.config import DEFAULT_SYSTEM_PROMPT
    from chatsift.plans.oracles import multi_turn_sql
    from chatsift.plans.present import example_view
    from oracle_harness import compare

    rng = random.Random(100 + k)
    rows = []
    for conv_id in range(60):
        rows += [(conv_id, t, rng.choice(ROLES), random_text(rng)) for t in range(rng.randint(0, 25))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = conversation_examples(df, system_prompt=DEFAULT_SYSTEM_PROMPT, source="conversations:chat", k=k, skew=skew)
    con = _duck_with("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    res = compare(example_view(ex, ("conv_id", "turn")), con, multi_turn_sql(k))
    assert res["cols_match"] and res["hash_match"] and res["rows"][0] == res["rows"][1] > 20, res


def expected_sessions(events, max_turns=6):
    """Per chat: history sent with each message; replies/errors answer the pending message."""
    clean = dict(zip([e[3] for e in events], normalized([e[3] for e in events])))
    state, pending, out = {}, {}, {}
    for seq, chat, kind, text, reply_to in sorted(events, key=lambda e: (e[1], e[0])):
        hist = state.setdefault(chat, [])
        if kind == "reset":
            state[chat], pending[chat] = [], None
        elif kind == "message":
            if text is None or text == "" or text.startswith("/"):
                continue
            msg = clean[text]
            sent = [m for m in hist if m[1]][-2 * max_turns:]
            out[(chat, seq)] = sent
            pending[chat] = (seq, msg, sent)
        elif kind == "reply" and pending.get(chat) and pending[chat][0] == reply_to:
            _, msg, sent = pending[chat]
            state[chat] = [m for m in sent + [("user", msg), ("assistant", clean[text])] if m[1]][-2 * max_turns:]
            pending[chat] = None
        elif kind == "error" and pending.get(chat) and pending[chat][0] == reply_to:
            pending[chat] = None
    return out


def random_events(rng, chats=6, n=400):
    events, seq = [], 0
    for _ in range(n):
        chat = rng.randrange(chats)
        seq += 1
        kind = rng.choices(["message", "reset", "start"], [0.85, 0.1, 0.05])[0]
        if kind != "message":
            events.append((seq, chat, kind, None, None))
            continue
        text = rng.choice(["hello", "how are you?", "  spaced   out ", "/help", "", "a\nb", "x" * 30])
        events.append((seq, chat, "message", text, None))
        msg_seq = seq
        seq += 1
        outcome = rng.choices(["reply", "error"], [0.8, 0.2])[0]
        at = seq if rng.random() < 0.6 else seq + rng.choice([6, 10, 25]) + 0.5  # slow answers cross later events
        events.append((at, chat, outcome, rng.choice(["sure", " ok ", "fine\tthanks"]) if outcome == "reply" else None,
                       msg_seq))
        if rng.random() < 0.1:  # answered twice
            events.append((at + 0.25, chat, "reply", "again", msg_seq))
    # whole, distinct sequence numbers in the same order
    order = {x: i for i, x in enumerate(sorted({e[0] for e in events}))}
    distinct = [(order[e[0]] * 400 + i, *e[1:4], e[4]) for i, e in enumerate(sorted(events, key=lambda e: e[0]))]
    renamed = {}
    for old, new in zip(sorted(events, key=lambda e: e[0]), distinct):
        if old[2] == "message":
            renamed[old[0]] = new[0]
    return [(*e[:4], None if e[4] is None else renamed[e[4]]) for e in distinct]


@pytest.mark.parametrize("skew", [SkewConfig(), SkewConfig(hot_key_rows=10, block_rows=16)])
def test_random_sessions_batch_twin_matches_python(spark, skew):
    from chatsift.streaming import sessions as ss

    events = random_events(random.Random(7))
    df = spark.createDataFrame(events, ss.EVENT_SCHEMA)
    got = {(r.chat_id, r.seq): [(h.role, h.content) for h in r.history]
           for r in ss.session_requests_batch(df, skew=skew).collect()}
    want = expected_sessions(events)
    assert got == want and sum(1 for h in want.values() if h) > 50


def test_random_sessions_stream_matches_python(spark, tmp_path):
    from chatsift.streaming import sessions as ss

    events = random_events(random.Random(8), n=150)
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    ss_df = spark.createDataFrame(events, ss.EVENT_SCHEMA)
    ss_df.coalesce(1).write.parquet(src)
    ss.run_available(spark.readStream.schema(ss.EVENT_SCHEMA).parquet(src), out, ck)
    got = {(r.chat_id, r.seq): [(h.role, h.content) for h in r.history] for r in spark.read.parquet(out).collect()}
    assert got == expected_sessions(events)


def test_random_sessions_stream_in_many_files(spark, tmp_path):
    """One file per micro-batch, in order of seq: the same requests as the batch twin; late rows come out
    marked."""
    from chatsift.streaming import sessions as ss

    events = sorted(random_events(random.Random(9), n=60), key=lambda e: e[0])
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    for i in range(0, len(events), 40):
        spark.createDataFrame(events[i : i + 40], ss.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    ss.run_available(ss.event_stream(spark, src, max_files=1), out, ck)
    got = {(r.chat_id, r.seq): [(h.role, h.content) for h in r.history] for r in spark.read.parquet(out).collect()}
    df = spark.createDataFrame(events, ss.EVENT_SCHEMA)
    twin = {(r.chat_id, r.seq): [(h.role, h.content) for h in r.history] for r in ss.session_requests_batch(df).collect()}
    assert got == twin == expected_sessions(events)
    chat = events[0][1]
    spark.createDataFrame([(0, chat, "message", "too late", None), (1, chat, "reset", None, None)],
                          ss.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    ss.run_available(ss.event_stream(spark, src, max_files=1), out, ck)
    # each comes out as a late row, and changes nothing
    late = spark.read.parquet(out).where("late").collect()
    assert sorted((r.seq, r.chat_id, r.message, r.history) for r in late) == [(0, chat, "too late", None), (1, chat, "", None)]


def random_item(rng):
    def msgs():
        return [{"role": rng.choice(ROLES), "content": random_text(rng)} for _ in range(rng.randint(0, 7))]
    def text():
        return rng.choice([random_text(rng), None, "fine", "answer text"])
    item = {}
    for key in rng.sample(["prompt", "completion", "input", "output", "user", "assistant", "messages", "other"],
                          rng.randint(1, 4)):
        if key in ("prompt", "completion", "messages"):
            item[key] = msgs() if rng.random() < 0.9 else None
        else:
            item[key] = text()
    return item


def test_random_jsonl_lines_match_sql_oracle(spark):
    """Random JSON objects: shape dispatch and examples against the DuckDB oracle SQL."""
    import json

    import pandas as pd

    from chatsift.config import DEFAULT_SYSTEM_PROMPT
    from chatsift.plans import sqltext as q
    from chatsift.plans.oracles import jsonl_examples_sql, jsonl_shape_sql
    from chatsift.sources.custom import jsonl_examples
    from oracle_harness import compare

    rng = random.Random(23)
    lines = [(i, json.dumps(random_item(rng))) for i in range(400)]
    df = spark.createDataFrame(lines, "line_id long, value string")
    ex = jsonl_examples(df, system_prompt=DEFAULT_SYSTEM_PROMPT, k=8, source="t")
    view = ex.select(F.col("line_id"), F.col("sub").cast("long").alias("sub"), "shape",
                     F.expr("array_join(transform(prompt, m -> concat(m.role, chr(31), m.content)), chr(30))")
                     .alias("prompt_text"),
                     F.expr("array_join(transform(completion, m -> concat(m.role, chr(31), m.content)), chr(30))")
                     .alias("completion_text"))
    con = _duck_with("rlines", pd.DataFrame(lines, columns=["line_id", "value"]))
    sql = f"""SELECT CAST(line_id AS BIGINT) AS line_id, CAST(sub AS BIGINT) AS sub, shape,
                     {q.render('prompt')} AS prompt_text, {q.render('completion')} AS completion_text
              FROM ({jsonl_examples_sql(jsonl_shape_sql('SELECT line_id, value FROM rlines'))})"""
    res = compare(view, con, sql)
    assert res["cols_match"] and res["hash_match"] and res["rows"][0] == res["rows"][1] > 50, res


def test_random_requests_match_python(spark):
    from chatsift.config import ChatConfig
    from chatsift.operators import requests as rq

    cfg = ChatConfig()
    rng = random.Random(31)

    def text():
        return rng.choice(["", "a", "hi there", "  pad  ", "x" * 4000, "x" * 4001, None, "line\r\nnext"])

    rows = []
    for i in range(400):
        hist = [{"role": rng.choice(["user", "assistant", "User", "system", None]), "content": text()}
                for _ in range(rng.randint(0, 16))] if rng.random() < 0.9 else None
        rows.append((i, text(), hist, rng.choice([None, "", "  custom\tprompt  ", "short"]),
                     rng.choice([None, 0, 31, 32, 180, 512, 513]), rng.choice([None, 0.0, 0.85, 1.5, 1.6, -0.1]),
                     rng.choice([None, 0.05, 0.1, 0.5, 1.0, 1.01])))
    schema = ("request_id long, message string, history array<struct<role:string,content:string>>, "
              "system_prompt string, max_new_tokens int, temperature double, top_p double")
    df = spark.createDataFrame(rows, schema)
    out = rq.assemble_messages(rq.with_defaults(rq.validate_requests(df), cfg), cfg)
    got = {r.request_id: (r.is_valid, [(m.role, m.content) for m in r.messages] if r.is_valid else None,
                          r.max_new_tokens_eff, r.temperature_eff, r.top_p_eff) for r in out.collect()}

    given = [msg for _, msg, *_ in rows] + [sp or cfg.system_prompt for _, _, _, sp, *_ in rows]
    given += [h["content"] for _, _, hist, *_ in rows for h in hist or []]
    norm = dict(zip(given, normalized(given)))

    def in_range(v, lo, hi):
        return v is None or lo <= v <= hi

    for rid, msg, hist, sp, mnt, temp, top in rows:
        ok = (msg is not None and 1 <= len(msg) <= 4000
              and all(h["role"] in ("user", "assistant") for h in hist or [])
              and all(h["content"] is not None and 1 <= len(h["content"]) <= 4000 for h in hist or [])
              and in_range(mnt, 32, 512) and in_range(temp, 0.0, 1.5) and in_range(top, 0.1, 1.0))
        msgs = None
        if ok:
            cleaned = [(h["role"].strip().lower(), norm[h["content"]]) for h in hist or []]
            cleaned = [m for m in cleaned if m[0] in ("user", "assistant") and m[1]][-2 * cfg.max_history_turns:]
            msgs = [("system", norm[sp or cfg.system_prompt])] + cleaned + [("user", norm[msg])]
        want = (ok, msgs, mnt or cfg.max_new_tokens, temp if temp is not None else cfg.temperature,
                top if top is not None else cfg.top_p)
        assert got[rid] == want, (rid, got[rid], want)
    assert sum(1 for v in got.values() if v[0]) > 10
