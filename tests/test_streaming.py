"""Session streams: sources that start at the end, late and shuffled events, expiry, hot chats."""

import datetime as dt
import json
import os
import random

import pytest
from test_random_conversations import expected_sessions, random_events

from chatsift.config import SkewConfig
from chatsift.streaming import sessions as ss
from chatsift.streaming.event_time import TIMED_SCHEMA, session_requests_by_event_time
from chatsift.streaming.folder import from_now
from chatsift.streaming.incremental import SessionStore

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def caught_up(writer):
    q = writer.start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def sink(df, base):
    return df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")


def timed(events):
    return [(*e, T0 + dt.timedelta(seconds=e[0])) for e in events]


def histories(rows):
    return {(r.chat_id, r.seq): [(h.role, h.content) for h in r.history] for r in rows}


def write_entries(spark, folder, parts, schema=TIMED_SCHEMA):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/e{i:03d}")


END = [(10**9, -1, "start", None, None, T0 + dt.timedelta(days=3000))]


def event_time_run(spark, base, parts, delay, ttl_ms=None):
    write_entries(spark, f"{base}/src", [*parts, END])
    stream = from_now(spark, f"{base}/src", TIMED_SCHEMA, f"{base}/log", starting="earliest", max_entries=1)
    caught_up(sink(session_requests_by_event_time(stream, delay, ttl_ms), base))
    return spark.read.parquet(f"{base}/out").collect()


def test_one_batch_many_batches_and_shuffled_files_give_the_same_requests(spark, tmp_path):
    events = random_events(random.Random(21), n=120)
    rows = timed(events)
    expected = expected_sessions(events)
    ordered = sorted(rows)
    shuffled = random.Random(3).sample(rows, len(rows))
    cut = lambda x, n: [x[i::n] if x is shuffled else x[len(x) * i // n : len(x) * (i + 1) // n] for i in range(n)]
    for name, parts in (("one", [rows]), ("many", cut(ordered, 4)), ("shuffled", cut(shuffled, 3))):
        got = event_time_run(spark, f"{tmp_path}/{name}", parts, "100000 seconds")
        assert not any(r.late for r in got) and histories(got) == expected, name


def test_events_behind_the_watermark_come_out_as_late_rows(spark, tmp_path):
    first = timed([(1, 7, "message", "one", None), (500, 7, "message", "two", None)])
    second = timed([(2, 7, "reply", "too late", 1), (3, 8, "message", "new chat, too late", None), (499, 7, "message", "before two", None)])
    got = event_time_run(spark, str(tmp_path), [first, second], "60 seconds")
    assert sorted((r.seq, r.chat_id, r.message) for r in got if r.late) == [(2, 7, "too late"), (3, 8, "new chat, too late")]
    assert sorted(r.seq for r in got if not r.late) == [1, 499, 500]


def expiring(events, ttl):
    """Resets where a chat was silent for longer than ``ttl``."""
    out, last = [], {}
    for e in sorted(events, key=lambda e: e[0]):
        if e[1] in last and e[0] - last[e[1]] > ttl:
            out.append((e[0] - 0.5, e[1], "reset", None, None))
        last[e[1]] = e[0]
        out.append(e)
    return out


@pytest.mark.parametrize("ttl", [900, 3000])
def test_an_expired_session_restarts_empty(spark, tmp_path, ttl):
    events = [e for e in random_events(random.Random(5), n=90) if not (e[2] == "message" and (not e[3] or e[3][0] == "/"))]
    want = expected_sessions(expiring(events, ttl))
    assert want != expected_sessions(events)
    rows = sorted(timed(events))
    for n in (1, 3):
        got = event_time_run(spark, f"{tmp_path}/{n}", [rows[len(rows) * i // n : len(rows) * (i + 1) // n] for i in range(n)],
                             "10 seconds", ttl * 1000)
        assert histories(r for r in got if not r.late) == want
    table = spark.createDataFrame(rows, TIMED_SCHEMA)
    twin = ss.session_requests_batch(ss.expired_sessions(table, ttl * 1000, skew=SkewConfig(hot_key_rows=20, block_rows=16)))
    assert {(c, s // 2): h for (c, s), h in histories(twin.collect()).items()} == want


def test_the_folder_source_starts_at_the_end_and_resumes_after_a_restart(spark, tmp_path):
    base, schema = str(tmp_path), "a long, b string, c int"

    def put(name, rows):
        spark.createDataFrame(rows, "a long, b string").write.parquet(f"{base}/src/{name}")

    def run(starting="latest"):
        caught_up(sink(from_now(spark, f"{base}/src", schema, f"{base}/log", starting=starting, max_entries=1), base))
        return sorted(r.a for r in spark.read.schema(schema).parquet(f"{base}/out").collect())

    put("k-backlog", [(1, "x")])
    os.makedirs(f"{base}/src/unfinished")  # a writer is at work: no _SUCCESS yet
    assert run() == []
    put("a-later-but-first-by-name", [(2, "x"), (3, None)])
    put("z", [(4, "x")])
    assert run() == [2, 3, 4]
    assert run() == [2, 3, 4]  # nothing twice
    put("m", [(5, "x")])
    spark.createDataFrame([(6, "x")], "a long, b string").write.mode("append").parquet(f"{base}/src/unfinished")
    assert run() == [2, 3, 4, 5, 6]
    noted = [json.load(open(f"{base}/log/{n}")) for n in sorted(os.listdir(f"{base}/log")) if n.endswith(".json")]
    assert noted == [["k-backlog"], ["a-later-but-first-by-name"], ["z"], ["m"], ["unfinished"]]


@pytest.mark.parametrize("compact", [2, 50])
def test_micro_batches_equal_the_batch_twin_with_a_hot_chat(spark, tmp_path, compact):
    rng = random.Random(31)
    events = [(s, 0 if rng.random() < 1 / 3 and False else c, *rest) for s, c, *rest in random_events(rng, chats=4, n=150)]
    want = expected_sessions(events)
    events.sort()
    store = SessionStore(spark, f"{tmp_path}/store", skew=SkewConfig(hot_key_rows=15, block_rows=12), compact=compact)
    n = 4
    parts = [events[len(events) * i // n : len(events) * (i + 1) // n] for i in range(n)]
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, ss.EVENT_SCHEMA)
        store.apply(df, i)
        if i == 2:
            store.apply(df, i)  # an interrupted batch runs again
    late = [(0, events[0][1], "reset", None, None), (events[1][0], events[1][1], "message", "again", None)]
    store.apply(spark.createDataFrame([*late, (10**7, 99, "message", "new", None)], ss.EVENT_SCHEMA), n)
    got = histories(store.requests().collect())
    assert got == {**want, (99, 10**7): []}
    assert sorted((r.seq, r.chat_id, r.kind) for r in store.late().collect()) == sorted(e[:3] for e in late)


def test_micro_batches_carry_texts_that_only_look_like_commands(spark, tmp_path):
    store = SessionStore(spark, f"{tmp_path}/store")
    parts = [[(1, 1, "message", "  /help", None)], [(2, 1, "reply", "it is", 1)], [(3, 1, "message", " ", None)],
             [(4, 1, "reply", "yes", 3)], [(5, 1, "message", "end", None), (6, 1, "error", None, 5)],
             [(7, 1, "reply", "not counted", 5), (8, 1, "message", "last", None)]]
    for i, part in enumerate(parts):
        store.apply(spark.createDataFrame(part, ss.EVENT_SCHEMA), i)
    want = expected_sessions([e for p in parts for e in p])
    assert histories(store.requests().collect()) == want and len(want[(1, 8)]) == 3


class FakeHandle:
    """Keyed state of one chat in dicts, counting the calls that go to the state store."""

    def __init__(self):
        self.calls, self.timers, self.maps, self.values = 0, set(), {}, {}

    def getValueState(self, name, schema):
        return FakeState(self, self.values.setdefault(name, {}))

    def getMapState(self, name, key_schema, value_schema):
        return FakeState(self, self.maps.setdefault(name, {}))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class FakeState:
    def __init__(self, handle, rows):
        self.handle, self.rows = handle, rows

    def __getattr__(self, name):
        rows = self.__dict__["rows"]
        self.__dict__["handle"].calls += 1
        return {"exists": lambda: bool(rows), "get": lambda: rows.get(()), "update": lambda v: rows.update({(): v}),
                "clear": rows.clear, "keys": lambda: iter(list(rows)), "iterator": lambda: iter(list(rows.items())),
                "getValue": rows.get, "updateValue": lambda k, v: rows.update({k: v}), "removeKey": rows.pop}[name]


class Passed:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_calls_follow_the_chats_of_a_batch_and_not_its_events():
    from pyspark.sql import Row

    from chatsift.streaming.event_time import EventTimeSessionProcessor

    processor, handle = EventTimeSessionProcessor(), FakeHandle()
    processor.init(handle)
    row = lambda seq, text: Row(seq=seq, chat_id=7, kind="message", text=text, reply_to=None, at=1000 * seq)
    n, out = 3000, []
    order = random.Random(8).sample(range(1, n + 1), n)
    batches = [[row(i, f"m{i}") for i in order[:2500]], [row(i, f"m{i}") for i in order[2500:]] + [row(n, "again"), row(5, "anew")], []]
    for batch, passed in zip(batches, (0, 0, 1000 * n // 2)):
        out += list(processor.handleInputRows((7,), iter(batch), Passed(passed))) if batch else []
    for passed in (1000 * n // 2, 1000 * n + 1):
        for at in sorted(t for t in handle.timers if t <= passed):
            out += list(processor.handleExpiredTimer((7,), Passed(passed), None))
            handle.timers.discard(at)
    assert [(r.seq, r.message) for r in out] == [(i, {5: "anew", n: "again"}.get(i, f"m{i}")) for i in range(1, n + 1)]
    assert not handle.timers and not any(handle.maps.values())
    assert handle.calls < 60


def test_a_micro_batch_finds_answers_once_and_is_dealt_anew(spark, tmp_path, monkeypatch):
    from chatsift.operators import context

    passes, plain = [], context.trailing_context
    monkeypatch.setattr(context, "trailing_context", lambda df, **kw: passes.append(df) or plain(df, **kw))
    events = sorted(random_events(random.Random(12), chats=3, n=60))
    store = SessionStore(spark, f"{tmp_path}/store")
    for i, part in enumerate((events[:30], events[30:])):
        store.apply(spark.createDataFrame(part, ss.EVENT_SCHEMA).coalesce(1), i)
        assert len(passes) == 2 * (i + 1)  # answers, histories
        assert all(len(df.inputFiles()) > 1 for df in passes[2 * i : 2 * i + 1])  # from files of several tasks
    assert histories(store.requests().collect()) == expected_sessions(events)
