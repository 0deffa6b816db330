"""End-to-end dataset build on small fixtures: source choice, caps, dedup order, exact split,
JSONL output and report (SURVEY S9, S10, L1-L4, K1-K3)."""

import json

import pytest
from pyspark.sql import functions as F

from chatsift.config import BuildConfig
from chatsift.plans.build import Sources, build_dataset
from chatsift.sinks.jsonl import read_splits, split_counts


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _turns(spark, n_conv):
    rows = []
    for c in range(n_conv):
        rows += [(c, 0, "user", f"question {c}"), (c, 1, "assistant", f"answer {c}"),
                 (c, 2, "user", f"follow up {c}"), (c, 3, "assistant", f"more {c}")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_build_with_local_file_custom_dir_and_caps(spark, tmp_path):
    custom = tmp_path / "custom"
    custom.mkdir()
    local = custom / "main.csv"
    _write(local, "input,output\n" + "".join(f"local q{i},local a{i}\n" for i in range(30)))
    _write(custom / "extra.csv", "input,output\nquestion 0,answer 0\nnew q,new a\n")
    _write(custom / "x.jsonl", json.dumps({"user": "jsonl q", "assistant": "jsonl a"}) + "\n")
    turns = _turns(spark, 12)
    out = str(tmp_path / "out")
    cfg = BuildConfig(output_dir=out, custom_dir=str(custom), local_pair_file=str(local), cap_pairs=10,
                      cap_chat=5)
    res = build_dataset(spark, cfg, Sources(chat_turns=(turns, "conv_id")))
    before = {r.source: r.n for r in res.counts_before.collect()}
    # local file sampled to 10 rows and hidden from the custom scan; chat capped at 5 conversations
    assert before["local:main.csv"] == 10 and before["chat"] == 10
    assert before["custom:extra.csv"] == 2 and before["custom:x.jsonl"] == 1
    assert "custom:main.csv" not in before
    after = {r.source: r.n for r in res.counts_after.collect()}
    # "question 0 -> answer 0" from extra.csv duplicates a chat example only if conversation 0 was sampled
    assert sum(after.values()) == res.total
    back = read_splits(spark, {"train": f"{out}/train.jsonl", "validation": f"{out}/validation.jsonl"})
    sizes = {r.split: r.n_rows for r in split_counts(back).collect()}
    assert sizes == {"train": res.total - res.validation_rows, "validation": res.validation_rows}
    rep = spark.read.json(f"{out}/metadata.json").collect()[0]
    assert rep.total_rows_after_dedup == res.total and rep.validation_rows == res.validation_rows


def test_cap_zero_lets_custom_scan_use_the_local_file(spark, tmp_path):
    custom = tmp_path / "custom"
    custom.mkdir()
    local = custom / "main.csv"
    _write(local, "input,output\nhello there,general reply\nsecond q,second a\n")
    cfg = BuildConfig(custom_dir=str(custom), local_pair_file=str(local), cap_pairs=0)
    res = build_dataset(spark, cfg, Sources(chat_turns=(_turns(spark, 2), "conv_id")), write=False)
    before = {r.source: r.n for r in res.counts_before.collect()}
    assert before == {"custom:main.csv": 2, "chat": 4}


def test_too_small_dataset_raises(spark):
    one = _turns(spark, 1).where(F.col("turn") < 2)
    with pytest.raises(ValueError):
        build_dataset(spark, BuildConfig(), Sources(chat_turns=(one, "conv_id")), write=False)


def test_chat_arrays_and_turn_rows_build_the_same(spark):
    from conftest import SF01

    turns = spark.read.parquet(f"{SF01}/conversations.parquet")
    arrays = (turns.groupBy("conv_id")
              .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
              .select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"),
                                                                      x["text"].alias("content"))).alias("messages")))
    a = build_dataset(spark, BuildConfig(), Sources(chat_turns=(turns, "conv_id")), write=False)
    b = build_dataset(spark, BuildConfig(), Sources(chat_arrays=(arrays, "conv_id")), write=False)
    key = lambda res: sorted(r.signature for r in res.examples.select("signature").collect())
    assert res_sizes(a) == res_sizes(b) and key(a) == key(b) and a.total == 140


def res_sizes(res):
    return (res.total, res.validation_rows)


def test_turn_pairs_source(spark):
    rows = [(i, f"question number {i}", f"answer number {i}") for i in range(30)] + [(99, "x", "too short question")]
    tp = spark.createDataFrame(rows, "id long, user_message string, assistant_message string")
    res = build_dataset(spark, BuildConfig(cap_turn_pairs=20), Sources(turn_pairs=(tp, "id")), write=False)
    before = {r.source: r.n for r in res.counts_before.collect()}
    assert before["turn_pairs"] <= 20 and res.total == before["turn_pairs"]


def test_load_source_formats(spark, tmp_path):
    from conftest import SF01

    from chatsift.sources.tables import load_source

    assert load_source(spark, f"{SF01}/conversations.parquet").count() > 0
    _write(tmp_path / "p.jsonl", '{"input": "a question", "output": "an answer"}\n')
    assert load_source(spark, str(tmp_path / "p.jsonl"), schema="input string, output string").count() == 1
    _write(tmp_path / "p.csv", "input,output\nq,a\n")
    assert load_source(spark, str(tmp_path / "p.csv")).columns == ["input", "output"]


def test_jsonl_line_format(spark, tmp_path):
    import glob

    from chatsift.sinks.jsonl import write_jsonl
    from chatsift.sources.tables import pair_examples

    df = spark.createDataFrame([(1, "héllo there", "ça va bien")], "id long, input string, output string")
    ex = pair_examples(df, "input", "output", system_prompt="sys", source="s")
    write_jsonl(ex, str(tmp_path / "out"))
    line = [ln for f in glob.glob(str(tmp_path / "out" / "part-*")) for ln in open(f, encoding="utf-8")][0].strip()
    assert line == ('{"prompt":[{"role":"system","content":"sys"},{"role":"user","content":"héllo there"}],'
                    '"completion":[{"role":"assistant","content":"ça va bien"}],"source":"s"}')


def test_both_splits_are_written_at_once_in_one_global_order(spark, tmp_path, monkeypatch):
    from chatsift.operators.sampling import order_key
    from chatsift.sinks import jsonl

    monkeypatch.setattr(jsonl, "ROWS_PER_FILE", 100)
    rows = [([("system", "s"), ("user", f"question {i}")], [("assistant", f"é answer {i}")], "src", f"k{i}",
             "validation" if i % 9 == 0 else "train") for i in range(1000)]
    df = spark.createDataFrame(rows, "prompt array<struct<role:string,content:string>>, completion array<struct<role:string,content:string>>, "
                                     "source string, key string, split string")
    key = order_key(42, F.col("key"))
    jsonl.write_splits(df, str(tmp_path), key, 1000, shuffle=True)
    order = {r.c: r.k for r in df.select(F.col("completion")[0]["content"].alias("c"), key.alias("k")).collect()}
    for name, n in (("train", 888), ("validation", 112)):
        found = sorted(p for p in (tmp_path / f"{name}.jsonl").iterdir() if p.name.startswith("part-"))
        assert len(found) == 10
        lines = [json.loads(x) for p in found for x in p.read_text().splitlines()]
        keys = [order[x["completion"][0]["content"]] for x in lines]
        assert len(keys) == n and keys == sorted(keys) and list(lines[0]) == ["prompt", "completion", "source"]
    assert not (tmp_path / "_splits").exists()
    jsonl.write_splits(df.where("split = 'train'"), str(tmp_path), key, 888)  # over what is there, one split empty
    assert not [p for p in (tmp_path / "validation.jsonl").iterdir() if p.name.startswith("part-")]


def test_a_report_over_many_files_holds_no_array_of_them(spark):
    from chatsift.sinks.report import report_frame, source_table

    names = spark.range(100_000).select(F.format_string("custom:f%06d.jsonl", "id").alias("source"), F.lit(2).cast("long").alias("n"))
    before = names.unionByName(spark.createDataFrame([("pairs", 5)], "source string, n long"))
    sources = source_table(before, names.where("source < 'custom:f050000.jsonl'").withColumn("n", F.lit(1).cast("long")))
    row = report_frame(sources, 10, 1, (), 3).first()
    assert row.source_counts_before_dedup == {"custom:*": 200_000, "pairs": 5} and row.source_counts_after_dedup == {"custom:*": 50_000}
    assert sources.count() == 100_001 and row.rejected_rows == 3


def test_several_replies_to_a_request(spark):
    from chatsift.operators.requests import apply_replies

    requests = spark.createDataFrame([(1, "hello", None), (2, "there", None)],
                                     "request_id long, message string, history array<struct<role:string,content:string>>")
    replies = spark.createDataFrame([(1, "second", 2), (1, "first", 1), (None, "lost", 1), (2, "only", 9)],
                                    "request_id long, response string, at int")
    got = apply_replies(requests, replies, order="at").collect()
    assert sorted((r.request_id, r.response, r.status) for r in got) == [(1, "first", "ok"), (2, "only", "ok")]
    with pytest.raises(Exception, match="several replies to request 1"):
        apply_replies(requests, replies).collect()
