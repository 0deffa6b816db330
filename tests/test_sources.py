"""CSV files split inside quoted fields, headers read by range, JSON lines parsed once."""

import csv
import io
import random

import pytest

from chatsift.functions.json_shapes import parsed_lines
from chatsift.sources import csv_records as cr
from chatsift.sources import files
from chatsift.sources.custom import jsonl_examples, read_pair_csv


@pytest.fixture
def tiny_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def random_field(rng):
    if rng.random() < 0.3:
        return rng.choice(["plain", "é日本", "5 inch", 'a 5" pipe', "x" * rng.randint(30, 90), "b c"])
    inner = "".join(rng.choice(["a", "é ", ",", '"', "\n", "\r\n", "\n\n", '","', "word "]) for _ in range(rng.randint(0, 12)))
    return inner


def encode(field, rng):
    needs = any(c in field for c in ',\n\r') or field.startswith('"') or field == ""
    if needs or rng.random() < 0.3:
        return '"' + field.replace('"', '""') + '"'
    return field


def random_file(rng, rows, end):
    pairs = [(random_field(rng), random_field(rng)) for _ in range(rows)]
    body = "".join(f"{encode(a, rng)},{encode(b, rng)}{rng.choice(end)}" for a, b in pairs)
    return pairs, "input,output\n" + body


@pytest.mark.parametrize("seed,end", [(1, ["\n"]), (2, ["\r\n"]), (3, ["\n", "\r\n", "\n\n"])])
def test_a_file_in_many_tasks_equals_the_whole_file(spark, tmp_path, tiny_splits, seed, end):
    rng = random.Random(seed)
    pairs, text = random_file(rng, 150, end)
    other, text2 = random_file(rng, 3, end)
    for name, body in (("a.csv", text), ("b.csv", text2)):
        (tmp_path / name).write_bytes(("﻿" + body).encode())
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert spark.read.text(paths[0]).rdd.getNumPartitions() > 20
    got = read_pair_csv(spark, paths).orderBy("file_name", "block", "pos").collect()
    tidy = lambda x: None if x in NA else x
    from chatsift.config import NA_TOKENS as NA

    assert [(r.input, r.output) for r in got if r.file_name == "a.csv"] == [(tidy(a), tidy(b)) for a, b in pairs]
    assert [(r.input, r.output) for r in got if r.file_name == "b.csv"] == [(tidy(a), tidy(b)) for a, b in other]
    assert all(r.record is None for r in got)
    if end == ["\n"]:
        rows = [x for x in csv.reader(io.StringIO(text, newline="")) if x][1:]
        assert [tuple(x) for x in rows] == pairs


def test_a_field_longer_than_many_splits_and_one_never_closed(spark, tmp_path, tiny_splits):
    long = "\n".join(f"line {i}, \"quoted\"" for i in range(60))
    quoted = '"' + long.replace('"', '""') + '"'
    (tmp_path / "a.csv").write_text(f'input,output\none,two\n{quoted},short\nshort,{quoted}\nthree,"never closed\nat all\n')
    got = read_pair_csv(spark, str(tmp_path / "a.csv")).orderBy("block", "pos").collect()
    assert [(r.input, r.output) for r in got[:3]] == [("one", "two"), (long, "short"), ("short", long)]
    assert len(got) == 4 and got[3].input == "three"


def test_states_of_lines_follow_the_plain_scan():
    def plain(lines, start):
        state, out = start, []
        for o, s in lines:
            out.append(state)
            state = s if state else o
        return [*out, state]

    import numpy as np

    rng = random.Random(4)
    for n in (0, 1, 2, 9, 60):
        for start in (0, 1):
            lines = [rng.choice([(0, 1)] * 4 + [(1, 0), (0, 0), (1, 1)]) for _ in range(n)]
            opens, stays = (np.array([x[i] for x in lines], dtype=bool) for i in (0, 1))
            assert cr._states(start, opens, stays).tolist() == plain(lines, start)


def test_headers_are_read_by_range(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}.csv").write_bytes(b"\xef\xbb\xbfinput,output\r\n" + b"a,b\n" * (10 ** i))
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "long.csv").write_bytes(b"x" * 100_000)
    got = files.first_lines(spark, [str(p) for p in sorted(tmp_path.glob("*.csv"))])
    assert {n: h for n, h in got.items() if n[0] == "f"} == {f"f{i}.csv": "input,output" for i in range(5)}
    assert got["empty.csv"] == "" and got["long.csv"] == "x" * files.HEADER_BYTES


def test_each_json_line_is_parsed_by_few_expressions(spark):
    lines = spark.range(3).selectExpr("id as line_id", "concat('{\"input\": ', id, '}') as value")
    for df in (parsed_lines(lines).where("reason is not null"), jsonl_examples(lines, system_prompt="s", k=8, source="t")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("from_json(") <= 6


ODD = {
    '{"messages": "[{\\"role\\": \\"user\\"}]"}': ("messages", None),
    '{"prompt": 5, "completion": [{"role": "assistant", "content": "x"}]}': ("prompt_completion", None),
    '{"input": "a", "input": "b", "output": {"k": [1, 2]}}': ("input_output", None),
    '{"messages": [{"role": "user", "role": "assistant", "content": 1}, 7]}': ("messages", "bad_message"),
    '{"input": null, "output": NaN}': ("input_output", None),
    '{"a": 1}] junk}': ("invalid", "invalid_json"),
    '{"a": 1}}': ("invalid", "invalid_json"),
    '{}': ("other", "unknown_shape"),
    '[{"input": 1}]': ("invalid", "invalid_json"),
    '': ("blank", None),
}


def test_fields_of_odd_lines(spark):
    df = spark.createDataFrame([(v,) for v in ODD], "value string")
    got = {r.value: r for r in parsed_lines(df).collect()}
    assert {v: (r["shape"], r.reason) for v, r in got.items()} == ODD
    dup = got['{"input": "a", "input": "b", "output": {"k": [1, 2]}}']
    assert (dup.input, dup.output) == ("b", '{"k":[1,2]}')
    assert [(m.role, m.content) for m in got['{"messages": [{"role": "user", "role": "assistant", "content": 1}, 7]}'].first] == [
        ("assistant", "1"), (None, None)]
    one = got['{"prompt": 5, "completion": [{"role": "assistant", "content": "x"}]}']
    assert one.first is None and [tuple(m) for m in one.second] == [("assistant", "x")]
    assert got['{"messages": "[{\\"role\\": \\"user\\"}]"}'].first is None
