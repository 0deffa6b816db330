"""Golden cases from FIXTURES.md sections 2.2, 2.4, 2.5 and 2.6."""

import json

import pytest
from pyspark.sql import functions as F

from chatsift.functions.json_shapes import shape_label
from chatsift.functions.messages import with_example
from chatsift.operators import requests as rq
from chatsift.operators.dedup import keep_first, ordered
from chatsift.operators.sampling import exact_split, sample_exact, validation_size
from chatsift.functions.messages import example_signature
from chatsift.sources.custom import SchemaError, jsonl_examples, load_custom_dir, read_pair_csv, read_jsonl
from chatsift.streaming import sessions as ss

MSG = "array<struct<role:string,content:string>>"


def m(role, content):
    return {"role": role, "content": content}


# ---- 2.2 example builder ---------------------------------------------------------------------
def build(spark, prompt, completion):
    df = spark.createDataFrame([(prompt, completion)], f"p {MSG}, c {MSG}")
    return with_example(df, F.col("p"), F.col("c"), "t").collect()


@pytest.mark.parametrize("n,kept", [(1, False), (2, True), (1200, True), (1201, False)])
def test_length_gate_on_last_user(spark, n, kept):
    assert bool(build(spark, [m("system", "s"), m("user", "x" * n)], [m("assistant", "ok")])) == kept


def test_length_gate_on_first_completion(spark):
    assert not build(spark, [m("user", "hi")], [m("assistant", "x" * 1201)])


def test_long_earlier_history_and_second_completion_kept(spark):
    out = build(spark, [m("user", "y" * 5000), m("assistant", "a"), m("user", "hi")],
                [m("assistant", "ok"), m("assistant", "z" * 5000)])
    assert len(out) == 1 and len(out[0].completion) == 2 and len(out[0].prompt) == 3


def test_roles_are_cleaned_and_filtered(spark):
    out = build(spark, [m(" User ", "hi there"), m("tool", "x"), m("system", "s")], [m("assistant", "ok")])
    assert [x.role for x in out[0].prompt] == ["user", "system"]
    assert not build(spark, [m("user", "hi")], [m("user", "only user")])
    assert not build(spark, [m("system", "sys only")], [m("assistant", "ok")])


# ---- 2.4 JSON and CSV sources ----------------------------------------------------------------
LINES = [
    json.dumps({"input": None, "output": None, "messages": [m("user", "hello"), m("assistant", "there")]}),
    json.dumps({"prompt": [m("user", "p1")], "completion": [m("assistant", "c1")], "input": "a", "output": "b"}),
    json.dumps({"messages": [m("user", "hello"), m("assistant", "there")]}),
    json.dumps({"other": 1}),
    "bad{",
    "   ",
    json.dumps([1, 2]),
    "\u3000" + json.dumps({"user": "wrapped", "assistant": "in ideographic spaces"}) + "\x1c",
]


def test_shape_dispatch_labels(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(LINES)], "line_id long, value string")
    labels = [r.s for r in df.orderBy("line_id").select(shape_label("value").alias("s")).collect()]
    assert labels == ["input_output", "prompt_completion", "messages", "other", "invalid", "blank", "invalid",
                      "user_assistant"]
    ex = jsonl_examples(df, system_prompt="sys", k=8, source="t")
    got = sorted((r.line_id, r.shape, r.completion[0].content) for r in ex.collect())
    assert got == [(1, "prompt_completion", "c1"), (2, "messages", "there"),
                   (7, "user_assistant", "in ideographic spaces")]


def test_failfast_raises_on_bad_json(spark):
    df = spark.createDataFrame([(0, "bad{")], "line_id long, value string").withColumn("file_name", F.lit("f"))
    with pytest.raises(Exception):
        jsonl_examples(df, system_prompt="s", k=8, source="t", mode="failfast").collect()


def _write(path, text, bom=False):
    with open(path, "wb") as f:
        f.write((b"\xef\xbb\xbf" if bom else b"") + text.encode("utf-8"))


def test_custom_folder(spark, tmp_path):
    d = tmp_path / "custom"
    d.mkdir()
    _write(d / "a.csv", 'input,output\n"he said ""hi"", ok","l1\nl2"\nNA,x\nhello,null\nhey,\nhi there,fine thanks\n')
    _write(d / "b.csv", "Input,Output \nbom row,accepted\n", bom=True)
    _write(d / "c.csv", "output,input\nx,y\n")
    _write(d / "d.csv", "input, output\nx,y\n")
    _write(d / "local.csv", "input,output\nignored,row\n")
    _write(d / "e.jsonl", "\n".join(LINES) + "\n\n")
    _write(d / "notes.txt", "input,output\nnot,read\n")
    ex, rep = load_custom_dir(spark, str(d), system_prompt="sys", k=8, ignored={"local.csv"})
    rows = {(r.source, r.prompt[-1].content, r.completion[0].content) for r in ex.collect()}
    assert rows == {
        ("custom:a.csv", 'he said "hi", ok', "l1\nl2"),
        ("custom:a.csv", "hi there", "fine thanks"),
        ("custom:b.csv", "bom row", "accepted"),
        ("custom:e.jsonl", "p1", "c1"),
        ("custom:e.jsonl", "hello", "there"),
        ("custom:e.jsonl", "wrapped", "in ideographic spaces"),
    }
    assert rep["csv_skipped_header"] == ["c.csv", "d.csv"] and rep["csv_ignored"] == ["local.csv"]
    missing, _ = load_custom_dir(spark, str(tmp_path / "nope"), system_prompt="s", k=8)
    assert missing.count() == 0


def test_lfs_pointer_is_a_schema_error(spark, tmp_path):
    p = tmp_path / "pairs.csv"
    _write(p, "version https://git-lfs.github.com/spec/v1\noid sha256:abc\nsize 123\n")
    with pytest.raises(SchemaError):
        read_pair_csv(spark, str(p))


def test_jsonl_line_order_within_file(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    _write(p, "\n".join(json.dumps({"input": f"q{i}", "output": f"a{i}"}) for i in range(200)))
    lines = read_jsonl(spark, str(p)).orderBy("block", "pos").collect()
    assert [json.loads(r.value)["input"] for r in lines] == [f"q{i}" for i in range(200)]


# ---- 2.5 dedup, sample, split ------------------------------------------------------------------
def test_keep_first_by_source_order(spark):
    rows = [(1, [m("user", "Hello")], [m("assistant", "World")], "late", 1),
            (0, [m("system", "s"), m("user", "hello")], [m("assistant", "world")], "early", 0),
            (2, [m("user", "a||b")], [m("assistant", "c")], "x", 2),
            (3, [m("user", "a")], [m("assistant", "b||c")], "y", 3)]
    df = spark.createDataFrame(rows, f"id int, prompt {MSG}, completion {MSG}, source string, rank int")
    df = ordered(df, 0, pos="rank").withColumn("signature", example_signature())
    kept = sorted(r.source for r in keep_first(df, "signature").collect())
    assert kept == ["early", "x"]


def test_sample_edges(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    assert sample_exact(df, -1, 42, "k").count() == 0
    assert sample_exact(df, 0, 42, "k").count() == 0
    assert sample_exact(df, 50, 42, "k").count() == 50
    assert sample_exact(df, 500, 42, "k").count() == 50
    a = {r.k for r in sample_exact(df, 7, 42, "k").collect()}
    b = {r.k for r in sample_exact(df.repartition(5), 7, 42, "k").collect()}
    assert len(a) == 7 and a == b


@pytest.mark.parametrize("n,v", [(2, 1), (9, 1), (49, 1), (100, 2), (149, 2), (1000, 20)])
def test_split_sizes(spark, n, v):
    assert validation_size(n, 0.02) == v
    labelled, total, got = exact_split(spark.range(n).withColumnRenamed("id", "k"), 42, 0.02, "k")
    assert total == n and got == v and labelled.where("split = 'validation'").count() == v


def test_split_cap_and_guard(spark):
    assert validation_size(100, 0.5) == 10
    for n in (0, 1):
        with pytest.raises(ValueError):
            validation_size(n, 0.02)


# ---- 2.6 requests and sessions -----------------------------------------------------------------
REQ = f"request_id long, message string, history {MSG}, system_prompt string, max_new_tokens int, temperature double, top_p double"


def req(spark, rows):
    return spark.createDataFrame(rows, REQ)


def test_request_parameter_ranges(spark):
    rows = [(i, "hi", [], None, t, None, None) for i, t in enumerate([31, 32, 512, 513, None])]
    rows += [(10 + i, "hi", [], None, None, t, None) for i, t in enumerate([0.0, 1.5, 1.6, None])]
    rows += [(20 + i, "hi", [], None, None, None, p) for i, p in enumerate([0.05, 0.1, None])]
    rows += [(30, "", [], None, None, None, None), (31, "x" * 4001, [], None, None, None, None),
             (32, "hi", [m("User", "a")], None, None, None, None), (33, "hi", [m("system", "a")], None, None, None, None)]
    v = rq.with_defaults(rq.validate_requests(req(spark, rows)))
    got = {r.request_id: r for r in v.collect()}
    assert [got[i].is_valid for i in range(5)] == [False, True, True, False, True]
    assert got[4].max_new_tokens_eff == 180
    assert [got[10 + i].is_valid for i in range(4)] == [True, True, False, True]
    assert got[10].temperature_eff == 0.0 and got[13].temperature_eff == 0.85
    assert [got[20 + i].is_valid for i in range(3)] == [False, True, True] and got[22].top_p_eff == 0.92
    assert not any(got[i].is_valid for i in (30, 31, 32, 33))


def test_history_clip(spark):
    hist = [m("user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(20)]
    df = req(spark, [(1, "hi", hist, None, None, None, None)])
    out = rq.assemble_messages(rq.with_defaults(df)).collect()[0].messages
    assert [x.content for x in out[1:-1]] == [f"m{i}" for i in range(8, 20)]
    from chatsift.config import ChatConfig
    out0 = rq.assemble_messages(rq.with_defaults(df), ChatConfig(max_history_turns=0)).collect()[0].messages
    assert [x.role for x in out0] == ["system", "user"]


def events(spark, rows):
    return spark.createDataFrame(rows, ss.EVENT_SCHEMA)


def _stream_run(spark, tmp_path, batches):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    for i, rows in enumerate(batches):
        events(spark, rows).coalesce(1).write.mode("append").parquet(src)
        ss.run_available(spark.readStream.schema(ss.EVENT_SCHEMA).parquet(src), out, ck)
    return {(r.chat_id, r.seq): [h.content for h in r.history] for r in spark.read.parquet(out).collect()}


def test_stream_reply_error_reset(spark, tmp_path):
    e = [
        (1, 7, "message", "hello", None), (2, 7, "reply", "hi!", 1), (3, 7, "message", "again", None),
        (1, 8, "message", "x1", None), (2, 8, "error", None, 1), (3, 8, "message", "x2", None),
        (1, 9, "message", "y1", None), (2, 9, "reply", "r1", 1), (3, 9, "reset", None, None),
        (4, 9, "start", None, None), (5, 9, "message", "y2", None),
    ]
    got = _stream_run(spark, tmp_path / "one", [e])
    assert got == {(7, 1): [], (7, 3): ["hello", "hi!"], (8, 1): [], (8, 3): [], (9, 1): [], (9, 5): []}
    batch = {(r.chat_id, r.seq): [h.content for h in r.history]
             for r in ss.session_requests_batch(events(spark, e)).collect()}
    assert batch == got


def test_stream_state_across_micro_batches(spark, tmp_path):
    b1 = [(1, 5, "message", "hello", None), (2, 5, "reply", "hi!", 1)]
    b2 = [(3, 5, "message", "more", None), (4, 5, "reply", "sure", 3), (5, 5, "reset", None, None)]
    b3 = [(6, 5, "message", "fresh", None)]
    got = _stream_run(spark, tmp_path, [b1, b2, b3])
    assert got == {(5, 1): [], (5, 3): ["hello", "hi!"], (5, 6): []}


def test_stream_start_from_now(spark):
    import datetime as dt

    rows = [(1, 1, "message", "old", None, dt.datetime(2024, 1, 1)), (2, 1, "message", "new", None, dt.datetime(2024, 6, 1))]
    df = spark.createDataFrame(rows, ss.EVENT_SCHEMA + ", ts timestamp")
    kept = ss.drop_backlog(df, "ts", dt.datetime(2024, 3, 1)).collect()
    assert [r.text for r in kept] == ["new"]


def test_csv_field_count_quarantine(spark, tmp_path):
    from chatsift.sources.custom import malformed_pair_rows

    p = tmp_path / "q.csv"
    _write(p, 'input,output\nhello there,fine\nc,d,extra\nshort\n"x y","z w"\n')
    good = {(r.input, r.output) for r in read_pair_csv(spark, str(p)).where("input is not null").collect()}
    assert good == {("hello there", "fine"), ("x y", "z w")}
    bad = [r.record for r in malformed_pair_rows(spark, str(p)).collect()]
    assert sorted(bad) == ["c,d,extra", "short"]
    with pytest.raises(Exception):
        read_pair_csv(spark, str(p), on_malformed="failfast").collect()


def test_single_line_csv_mode_reads_the_same_rows(spark, tmp_path):
    p = tmp_path / "big.csv"
    _write(p, "input,output\n" + "".join(f'"q {i}, ok","a {i}"\n' for i in range(500)))
    a = sorted(map(tuple, read_pair_csv(spark, str(p)).select("input", "output").collect()))
    b = sorted(map(tuple, read_pair_csv(spark, str(p), multi_line=False).select("input", "output").collect()))
    assert a == b and len(a) == 500
