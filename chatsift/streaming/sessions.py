"""Per-chat session history as a Structured Streaming stateful operator.

Input events: ``seq LONG, chat_id LONG, kind STRING, text STRING, reply_to LONG`` with kind one of
``message`` (a user message), ``reply`` (the answer to the pending message), ``error`` (the call
for the pending message failed), ``reset`` (clear the history) and ``start`` (greeting; no state
change); ``reply_to`` names the message seq a reply or error answers. For every message the operator emits the request that goes to the model: the message and
the history clipped to the last ``2 * max_turns`` messages. A reply replaces the history with
clip(history + [user, reply]); an error leaves it as it was.

Texts are normalised by Spark column expressions before the stateful step, so the Python
processor only appends and slices lists. State per chat is bounded (at most ``2 * max_turns``
messages, one pending message and the last ``seq``) and kept in the RocksDB state store under the
query's checkpoint, so it survives restarts and lost executors. Rows of one chat inside a micro-batch
are ordered by ``seq`` in the processor; the micro-batch size (``maxFilesPerTrigger`` /
``maxOffsetsPerTrigger``) bounds that buffer. Between micro-batches events of a chat arrive in ``seq``
order, as a partitioned log delivers them; a row at or before the last ``seq`` applied for its chat
is late: it can neither see nor change a history that is not its own and comes out as a row of its
own, with ``late`` set and without a history. ``event_time`` waits for events that arrive out of
order and lets sessions expire; ``incremental`` takes micro-batches in which one chat may hold any
share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chatsift.config import CHAT_MAX_HISTORY_TURNS
from chatsift.functions.text import normalize_text

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_SCHEMA = "seq long, chat_id long, kind string, text string, reply_to long"
STATE_SCHEMA = (
    "history array<struct<role: string, content: string>>, pending_seq long, "
    "pending_text string, pending_history array<struct<role: string, content: string>>, last_seq long"
)
OUTPUT_SCHEMA = ("seq long, chat_id long, message string, history array<struct<role: string, content: string>>, "
                 "late boolean")


def _clip(messages: list[tuple[str, str]], max_turns: int) -> list[tuple[str, str]]:
    if max_turns <= 0:
        return []
    kept = [m for m in messages if m[1]]
    return kept[-2 * max_turns:]


EMPTY = ([], None, None, [])


def step(state: tuple, event, max_turns: int) -> tuple[tuple, list | None]:
    """One event applied to (history, pending seq, pending text, pending history): the new state, and
    for a message the history that it is sent with."""
    history, pending_seq, pending_text, pending_history = state
    if event.kind == "reset":
        return EMPTY, None
    if event.kind == "message":
        sent = _clip(history, max_turns)
        return (history, event.seq, event.text, sent), sent
    if event.kind == "reply" and pending_seq is not None and event.reply_to == pending_seq:
        return (_clip(pending_history + [("user", pending_text), ("assistant", event.text)], max_turns), None, None, []), None
    if event.kind == "error" and event.reply_to == pending_seq:
        return (history, None, None, []), None
    return state, None  # a greeting, or a reply without a pending message


def loaded(stored: tuple | None) -> tuple:
    """The first four fields of a stored session as ``step`` takes them."""
    if stored is None:
        return EMPTY
    pairs = lambda x: [(m[0], m[1]) for m in (x or [])]
    return pairs(stored[0]), stored[1], stored[2], pairs(stored[3])


def request_row(event, chat_id: int, history: list | None, late: bool = False) -> Row:
    sent = None if history is None else [Row(role=a, content=b) for a, b in history]
    return Row(seq=event.seq, chat_id=chat_id, message=event.text, history=sent, late=late)


class SessionProcessor(StatefulProcessor):
    def __init__(self, max_turns: int = CHAT_MAX_HISTORY_TURNS):
        self.max_turns = max_turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        chat_id = key[0]
        stored = self.state.get() if self.state.exists() else None
        state, last_seq = loaded(stored), stored[4] if stored else None
        for r in sorted(rows, key=lambda r: r.seq):
            if last_seq is not None and r.seq <= last_seq:
                yield request_row(r, chat_id, None, late=True)  # its place in the session has passed
                continue
            last_seq = r.seq
            state, sent = step(state, r, self.max_turns)
            if sent is not None:
                yield request_row(r, chat_id, sent)
        self.state.update((*state, last_seq))

    def close(self) -> None:
        pass


def prepare_events(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Normalise texts on the JVM side; drop message events a chat client would not forward
    (empty text or a command starting with a slash)."""
    staged = events.select("seq", "chat_id", F.lower(F.col("kind")).alias("kind"), "text", "reply_to", *keep)
    forwarded = (F.col("kind") != "message") | (
        F.col("text").isNotNull() & (F.col("text") != "") & ~F.col("text").startswith("/"))
    return staged.where(forwarded).withColumn("text", normalize_text(F.col("text")))


def shipped_by_value(spark) -> None:
    """Processors are pickled by value: the driver-side runner and the executors' workers need no
    installed copy of this package. State is kept in RocksDB."""
    import sys

    from pyspark import cloudpickle

    for name in (__name__, __name__.rpartition(".")[0] + ".event_time"):
        if name in sys.modules:
            cloudpickle.register_pickle_by_value(sys.modules[name])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def session_requests(events: DataFrame, max_turns: int = CHAT_MAX_HISTORY_TURNS) -> DataFrame:
    """Streaming (or batch) events -> one request row per message: ``seq, chat_id, message, history, late``."""
    shipped_by_value(events.sparkSession)
    prepared = prepare_events(events)
    return prepared.groupBy("chat_id").transformWithState(
        statefulProcessor=SessionProcessor(max_turns), outputStructType=OUTPUT_SCHEMA,
        outputMode="Append", timeMode="None",
    )


def drop_backlog(events: DataFrame, ts_col: str, start_ts) -> DataFrame:
    """Start from now: ignore events older than the job start (file sources; for Kafka use
    ``startingOffsets=latest``)."""
    return events.where(F.col(ts_col) >= F.lit(start_ts))


def event_stream(spark, path: str, *, schema: str = EVENT_SCHEMA, ts_col: str | None = None, start_ts=None,
                 max_files: int | None = None) -> DataFrame:
    """Chat events of a growing folder of Parquet files as a stream. ``start_ts`` starts from now:
    events before it are ignored. ``max_files`` bounds a micro-batch, oldest files first."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    events = reader.parquet(path)
    return events if start_ts is None else drop_backlog(events, ts_col, start_ts)


def run_available(events_stream: DataFrame, out_path: str, checkpoint: str,
                  max_turns: int = CHAT_MAX_HISTORY_TURNS, timeout_s: int | None = None) -> None:
    """Process everything available now into a parquet sink, then stop. ``timeout_s`` makes a run that
    takes longer an error; by default there is no limit."""
    write_available(session_requests(events_stream, max_turns), out_path, checkpoint, timeout_s)


def write_available(requests: DataFrame, out_path: str, checkpoint: str, timeout_s: int | None = None) -> None:
    """Run a stream into a parquet sink until all that is available now is processed."""
    await_available(requests.writeStream.format("parquet").option("path", out_path).option(
        "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(), timeout_s)


def await_available(q, timeout_s: int | None = None) -> None:
    q.awaitTermination(timeout_s) if timeout_s else q.awaitTermination()
    if q.isActive:
        q.stop()
        raise TimeoutError("session stream did not finish")
    if q.exception() is not None:
        raise q.exception()


def answers(prepared: DataFrame, chat_hot, skew) -> DataFrame:
    """(chat_id, seq, o): what answered a message first, if the message was then its chat's last one since
    the last reset; ``o`` holds the answer's kind, its seq as ``at``, and the reply."""
    from chatsift.operators.context import trailing_context

    pending = trailing_context(
        prepared.where(F.col("kind").isin("message", "reply", "error", "reset")), keys=["chat_id"], seq="seq",
        item=F.col("seq"), k=1, is_item=F.col("kind") == "message", is_reset=F.col("kind") == "reset", hot=chat_hot,
        block_rows=skew.block_rows, out="asked")
    found = pending.where(F.col("kind").isin("reply", "error") & (F.get("asked", F.lit(0)) == F.col("reply_to")))
    return found.groupBy("chat_id", F.col("reply_to").alias("seq")).agg(
        F.min_by(F.struct("kind", F.col("seq").alias("at"), F.col("text").alias("reply")), "seq").alias("o"))


def expired_sessions(events: DataFrame, ttl_ms: int, time_col: str = "ts", skew=None) -> DataFrame:
    """``events`` with a reset before each event that comes more than ``ttl_ms`` after its chat's event
    before: the batch form of sessions that expire. Event numbers are doubled to make room; ``reply_to``
    with them."""
    from chatsift.config import SkewConfig
    from chatsift.operators.context import trailing_context
    from chatsift.operators.skew import hot_keys

    skew = skew or SkewConfig()
    at = F.unix_millis(F.col(time_col).cast("timestamp"))
    timed = trailing_context(events.withColumn("_at", at), keys=["chat_id"], seq="seq", item=F.col("_at"), k=1,
                             hot=hot_keys(events.select("chat_id"), ["chat_id"], skew), block_rows=skew.block_rows, out="_before")
    numbered = timed.withColumns({"seq": F.col("seq") * 2 + 1, "reply_to": F.col("reply_to") * 2 + 1})
    gap = numbered.where(F.col("_at") - F.get("_before", F.lit(0)) > ttl_ms).withColumns({
        "seq": F.col("seq") - 1, "kind": F.lit("reset"), "text": F.lit(None).cast("string"), "reply_to": F.lit(None).cast("long")})
    return numbered.unionByName(gap).drop("_at", "_before")


def session_requests_batch(events: DataFrame, max_turns: int = CHAT_MAX_HISTORY_TURNS, skew=None,
                           prepared: bool = False, hot=None, found: DataFrame | None = None, ask=None) -> DataFrame:
    """Batch twin of ``session_requests`` on a static event table, without Python (``prepared`` says that
    ``prepare_events`` was applied; ``hot`` and ``found`` are the chats' hot keys and ``answers`` where the caller has
    them; ``ask`` limits the messages that get a request, not what their histories hold).

    A reply counts where it arrives: if the chat's last message before it, since the last reset, is
    the one it answers and nothing answered that before. Such an exchange becomes two history items
    at the reply's own place, and the skew-safe trailing-context operator (cut at resets) yields the
    history each message was sent with."""
    from chatsift.config import SkewConfig
    from chatsift.functions.messages import message
    from chatsift.operators.context import trailing_context
    from chatsift.operators.skew import hot_keys

    skew = skew or SkewConfig()
    prepared = events if prepared else prepare_events(events)
    chat_hot = hot_keys(events.select("chat_id"), ["chat_id"], skew) if hot is None else hot
    done = (answers(prepared, chat_hot, skew) if found is None else found).where("o.kind = 'reply'").select("chat_id", "seq", "o.at", "o.reply")
    msgs = prepared.where(F.col("kind") == "message").select(
        "seq", "chat_id", "text", (F.lit(True) if ask is None else ask).alias("ask"))
    blank = message(F.lit("user"), F.lit(""))

    def rows(df: DataFrame, pos, is_item, item, query, is_reset: bool) -> DataFrame:
        return df.select("chat_id", "seq", "text", pos.alias("pos"), is_item.alias("is_item"), item.alias("item"),
                         query.alias("query"), F.lit(is_reset).alias("is_reset"))

    no = F.lit(False)
    asked = rows(msgs.where("ask"), F.col("seq") * 2, no, blank, F.lit(True), False)
    exchanged = msgs.join(done, on=["chat_id", "seq"]).select("chat_id", "seq", "text", F.explode(F.array(
        F.struct((F.col("at") * 2).alias("pos"), (F.col("text") != "").alias("is_item"),
                 message(F.lit("user"), F.col("text")).alias("item")),
        F.struct((F.col("at") * 2 + 1).alias("pos"), (F.coalesce(F.col("reply"), F.lit("")) != "").alias("is_item"),
                 message(F.lit("assistant"), F.col("reply")).alias("item")),
    )).alias("r")).select("chat_id", "seq", "text", "r.*", F.lit(False).alias("query"), F.lit(False).alias("is_reset"))
    resets = rows(prepared.where(F.col("kind") == "reset"), F.col("seq") * 2, no, blank, no, True)
    both = asked.unionByName(exchanged).unionByName(resets)
    ctx = trailing_context(both, keys=["chat_id"], seq="pos", item=F.col("item"), k=2 * max_turns,
                           is_item=F.col("is_item"), is_reset=F.col("is_reset"), hot=chat_hot, block_rows=skew.block_rows,
                           out="history")
    return ctx.where("query").select("seq", "chat_id", F.col("text").alias("message"), "history")
