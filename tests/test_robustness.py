"""Inputs that once lost or invented rows: caps, line ends, loose JSON, keys, skew."""

import random

import pytest
from pyspark.sql import functions as F

from chatsift import BuildConfig, SkewConfig, trailing_context
from chatsift.operators.dedup import keep_first, ordered
from chatsift.operators.sampling import RowKeyError, exact_split, sample_exact, sample_exact_groups, validation_size
from chatsift.operators.skew import BLOCK, HotKeys, hot_keys, with_blocks
from chatsift.plans.build import Sources, build_dataset
from chatsift.sources.custom import SchemaError, jsonl_examples, read_jsonl, read_pair_csv, rejected_lines


def write(path, text):
    path.write_bytes(text.encode("utf-8"))


# ---- caps --------------------------------------------------------------------------------------


def test_a_default_build_keeps_every_row(spark):
    n = 25_000
    trans = spark.range(n).select("id", F.concat(F.lit("text "), F.col("id")).alias("hi"), F.concat(F.lit("out "), F.col("id")).alias("hi_rom"))
    res = build_dataset(spark, BuildConfig(), Sources(translation=(trans, "id")), write=False)
    assert res.total == n
    capped = build_dataset(spark, BuildConfig(cap_translation=100), Sources(translation=(trans, "id")), write=False)
    assert capped.total == 100
    capped.release()


# ---- files -------------------------------------------------------------------------------------


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_line_ends_may_be_mixed(spark, tmp_path, multi_line):
    p = tmp_path / "m.csv"
    write(p, 'input,output\r\nq one,a one\nq two,a two\r\n"q three","a three"\r\n"q, four",a four\n')
    got = sorted((r.input, r.output) for r in read_pair_csv(spark, str(p), multi_line=multi_line).collect())
    assert got == [("q one", "a one"), ("q three", "a three"), ("q two", "a two"), ("q, four", "a four")]


def test_csv_quoted_line_ends_and_missing_values_before_cr(spark, tmp_path):
    p = tmp_path / "q.csv"
    write(p, 'input,output\r\n"two\r\nlines",fine\r\nhello,NA\r\n')
    got = {r.input: r.output for r in read_pair_csv(spark, str(p)).collect()}
    assert got["hello"] is None and [v for k, v in got.items() if k != "hello"] == ["fine"] and len(got) == 2


def test_csv_with_cr_only_is_refused_by_name(spark, tmp_path):
    p = tmp_path / "cr.csv"
    write(p, "input,output\ra,b\rc,d\r")
    with pytest.raises(SchemaError, match="cr.csv"):
        read_pair_csv(spark, str(p))


LINES = {
    '{"input":"hello","output":"world"} trailing': "invalid_json",
    '{"input":"hello","output":"world"} {"input":"x y","output":"z w"}': "invalid_json",
    "{'input':'hello','output':'world'}": "invalid_json",
    '{"input":"hello","output":"world"}],[1': "invalid_json",
    '{"input":"hello","output":"world"},"y":1}': "invalid_json",
    '{"nothing":1}': "unknown_shape",
    '{"messages":[5,{"role":"user","content":"hello"},{"role":"assistant","content":"world"}]}': "bad_message",
    '{"prompt":[{"role":"user","content":"hello"},null],"completion":[{"role":"assistant","content":"w w"}]}': "bad_message",
    '{"input":"hello","output":"fine","score":NaN}': None,
    "  ": None,
}


def test_loose_json_is_rejected_with_its_reason(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    write(p, "\n".join(LINES) + "\n")
    lines = read_jsonl(spark, str(p))
    assert {r.record: r.reason for r in rejected_lines(lines).collect()} == {k: v for k, v in LINES.items() if v}
    ex = jsonl_examples(lines, system_prompt="", k=8, source="s").collect()
    # the NaN line, and what is left of the two lines with one bad message
    assert sorted(r.completion[0].content for r in ex) == ["fine", "w w", "world"]
    with pytest.raises(Exception, match="invalid_json|bad_message"):
        jsonl_examples(lines, system_prompt="", k=8, source="s", mode="failfast").collect()


def test_build_reports_rejects(spark, tmp_path):
    folder = tmp_path / "custom"
    folder.mkdir()
    write(folder / "a.jsonl", '{"input":"hello there","output":"world one"}\n{broken\n{"other":1}\n{"input":"hi again","output":"fine"}\n')
    write(folder / "b.csv", "input,output\nx y,z w\none,two,three\n")
    write(folder / "c.csv", "output,input\nx,y\n")
    out = str(tmp_path / "out")
    res = build_dataset(spark, BuildConfig(output_dir=out, custom_dir=str(folder), notes=("mine",)), Sources())
    want = {("a.jsonl", "invalid_json", 1), ("a.jsonl", "unknown_shape", 1), ("b.csv", "field_count", 1), ("c.csv", "header", 1)}
    assert {tuple(r) for r in res.reject_counts.collect()} == want
    assert {(r.file_name, r.reason, r.n) for r in spark.read.json(f"{out}/rejects.json").collect()} == want
    report = spark.read.json(f"{out}/metadata.json").first()
    assert report.rejected_rows == 4 and report.notes == ["mine"] and res.total == 3


# ---- keys --------------------------------------------------------------------------------------


def test_samples_have_the_asked_size_or_fail(spark):
    keyed = spark.createDataFrame([(i % 50,) for i in range(1000)], "id long")
    for n in (7, 60, 333):
        try:
            assert sample_exact(keyed, n, 1, "id").count() == n
        except RowKeyError:
            pass
    with pytest.raises(RowKeyError):
        sample_exact(keyed, 7, 1, "id")
    with pytest.raises(RowKeyError):
        sample_exact(spark.createDataFrame([(None,), (1,), (2,)], "id long"), 1, 1, "id")
    unique = spark.range(70_000)
    for n in (0, 1, 65_537, 69_999, 70_000, 80_000):
        assert sample_exact(unique, n, 3, "id").count() == min(n, 70_000)
    groups = keyed.withColumn("x", F.lit(1))
    assert sample_exact_groups(groups, 5, 1, "id").select("id").distinct().count() == 5


def test_validation_size_and_split():
    assert [validation_size(n, 0.02) for n in (2, 9, 10, 49, 100, 1000)] == [1, 1, 1, 1, 2, 20]
    assert validation_size(100, 0.5) == 10
    with pytest.raises(ValueError):
        validation_size(1, 0.02)


def test_split_of_string_keys(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"))
    labelled, n, v = exact_split(df, 42, 0.02, "k")
    assert (n, v) == (500, 10) and labelled.where("split = 'validation'").count() == 10


def test_string_row_keys_build_and_order(spark):
    pairs = spark.createDataFrame([("b", "same words", "reply ONE"), ("a", "Same words", "reply one"), ("c", "other words", "reply two")],
                                  "id string, input string, output string")
    res = build_dataset(spark, BuildConfig(), Sources(pairs=(pairs, "id")), write=False)
    assert sorted(r.completion[0].content for r in res.examples.collect()) == ["reply one", "reply two"]
    assert ordered(pairs, 0, pos="id").select("_order.row_key").first()[0] == "b"


def test_keep_first_equals_a_plain_window(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abcdefgh") * rng.randrange(4), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, sig string, x double")
    best = {}
    for r in rows:
        if r[1] not in best or r[0] < best[r[1]][0]:
            best[r[1]] = r
    assert sorted(tuple(r) for r in keep_first(df, "sig", F.col("id")).collect()) == sorted(best.values())
    plan = keep_first(df, "sig", F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_keep_first_takes_one_row_of_each_signature_whatever_its_order_key(spark):
    rows = [(None, "a"), (1, "b"), (2, "b"), (None, "b"), (None, "c"), (None, "c"), (4, "d"), (4, "d"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "id long, sig string")
    got = sorted((r.sig or "", r.id) for r in keep_first(df, "sig", F.col("id")).collect())
    assert got == [("", 3), ("a", None), ("b", 1), ("c", None), ("d", 4)]
    order = F.struct(F.col("id"))
    got = sorted((r.sig or "", r.id or 0) for r in keep_first(df, "sig", order).collect())
    assert [s for s, _ in got] == ["", "a", "b", "c", "d"]  # a struct is never null: a null field comes first


def test_request_ids_of_long_conversations_are_distinct(spark):
    from chatsift.plans.derive import chat_replies, chat_requests

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c, n in ((1, 150), (2, 20)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = spark.createDataFrame([(i, "click", 50.0) for i in range(400)], "event_id long, event_type string, value double")
    req = chat_requests(turns, events)
    assert req.count() == req.select("request_id").distinct().count() == 85
    assert req.agg(F.max(F.size("history"))).first()[0] == 148
    assert req.join(chat_replies(turns), "request_id").count() == 85


# ---- skew --------------------------------------------------------------------------------------


def test_sparse_and_null_hot_keys_are_cut_evenly(spark):
    rows = [(None if k else 7, 1000 * i, f"v{i}") for k in (0, 1) for i in range(600)]
    df = spark.createDataFrame(rows, "key long, seq long, val string")
    hot = hot_keys(df.select("key"), ["key"], SkewConfig(hot_key_rows=100, probe_fraction=1.0))
    assert set(hot.rows) == {(None,), (7,)}
    sizes = [r["count"] for r in with_blocks(df, ["key"], "seq", hot, 50).groupBy("key", BLOCK).count().collect()]
    assert len(sizes) == 24 and max(sizes) <= 55
    plain = trailing_context(df, keys=["key"], seq="seq", item=F.col("val"), k=3)
    cut = trailing_context(df, keys=["key"], seq="seq", item=F.col("val"), k=3, hot=hot, block_rows=50)
    as_set = lambda d: sorted((str(r.key), r.seq, tuple(r.ctx)) for r in d.collect())
    assert as_set(plain) == as_set(cut)
    assert isinstance(hot, HotKeys)


def test_shared_folder_is_asked_for_off_a_local_master(spark, monkeypatch):
    from chatsift import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
