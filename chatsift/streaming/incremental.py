"""Chat sessions by micro-batch on the batch operators: no chat is ever sorted in one Python worker.

Each micro-batch (``foreachBatch``) meets a keyed table of what earlier batches left of its chats, and the
two go through the skew-safe batch twin ``session_requests_batch``, which cuts a chat of any share of the rows
into blocks. What a chat leaves behind is bounded: its last answered exchanges since its last reset, at
most as many as a history can show, and its last message while that is unanswered, all as events again, with
the last event number applied. Rows at or before that number are late and are written apart.

Every batch writes its requests, its late rows and the chats it touched under its own number, replacing what
an interrupted attempt left, and reads only tables of earlier numbers: running a batch again gives the
same. The newest row of a chat counts; after ``COMPACT`` batches the table is rewritten whole, and older parts
are dropped once that is written.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatsift import session
from chatsift.config import CHAT_MAX_HISTORY_TURNS, SkewConfig
from chatsift.operators.skew import hot_keys
from chatsift.sources import files
from chatsift.streaming.sessions import EVENT_SCHEMA, answers, await_available, prepare_events, session_requests_batch

COMPACT = 20
CARRY_SCHEMA = ("chat_id long, last_seq long, events array<struct<seq: long, kind: string, text: string, reply_to: long>>, "
                "batch long")


def carry_over(prepared: DataFrame, found: DataFrame, max_turns: int) -> DataFrame:
    """(chat_id, last_seq, events): what the next batch needs to know of each chat. ``found``: the ``answers``."""
    ends = prepared.groupBy("chat_id").agg(
        F.max("seq").alias("last_seq"), F.max(F.when(F.col("kind") == "message", F.col("seq"))).alias("asked"),
        F.coalesce(F.max(F.when(F.col("kind") == "reset", F.col("seq"))), F.lit(-(1 << 62))).alias("cleared"))
    messages = prepared.where("kind = 'message'").select("chat_id", "seq", "text")
    exchanges = found.where("o.kind = 'reply'").join(messages, ["chat_id", "seq"]).where(
        "text != '' or coalesce(o.reply, '') != ''")
    newest = Window.partitionBy("chat_id").orderBy(F.desc("o.at"))
    event = lambda seq, kind, text, reply_to: F.struct(
        seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"), reply_to.cast("long").alias("reply_to"))
    null = F.lit(None)
    # those after the last reset are the newest: few rows of a chat are left when its end is joined
    kept = exchanges.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= 2 * max(max_turns, 0)).join(
        ends, "chat_id").where("o.at > cleared").select(
        "chat_id", F.explode(F.array(event(F.col("seq"), "message", F.col("text"), null),
                                     event(F.col("o.at"), "reply", F.col("o.reply"), F.col("seq")))).alias("e"))
    open_ = ends.where("asked > cleared").select("chat_id", F.col("asked").alias("seq")).join(
        found.select("chat_id", "seq"), ["chat_id", "seq"], "left_anti").join(messages, ["chat_id", "seq"]).select(
        "chat_id", event(F.col("seq"), "message", F.col("text"), null).alias("e"))
    # at most 4 * max_turns + 1 events of a chat
    events = kept.unionByName(open_).groupBy("chat_id").agg(F.array_sort(F.collect_list("e")).alias("events"))
    return ends.select("chat_id", "last_seq").join(events, "chat_id", "left").select(
        "chat_id", "last_seq", F.coalesce("events", F.array().cast(
            "array<struct<seq: long, kind: string, text: string, reply_to: long>>")).alias("events"))


class SessionStore:
    """Requests, late rows and carried chats under one folder, by batch number."""

    def __init__(self, spark: SparkSession, folder: str, max_turns: int = CHAT_MAX_HISTORY_TURNS,
                 skew: SkewConfig | None = None, compact: int = COMPACT):
        self.spark, self.folder, self.max_turns = spark, folder.rstrip("/"), max_turns
        self.skew, self.compact = skew or SkewConfig(), compact

    def _path(self, kind: str, batch: int | None = None) -> str:
        return f"{self.folder}/{kind}" if batch is None else f"{self.folder}/{kind}/n={batch:012d}"

    def _numbers(self, kind: str) -> list[int]:
        return [int(posixpath.basename(p)[2:]) for p in files.list_folders(self.spark, self._path(kind), "n=*")
                if files.exists(self.spark, f"{p}/_SUCCESS")]

    def carried(self, before: int) -> DataFrame:
        """The newest row of each chat that batches before this number left."""
        whole = max((n for n in self._numbers("whole") if n < before), default=-1)
        parts = [self._path("whole", whole)] if whole >= 0 else []
        parts += [self._path("carry", n) for n in self._numbers("carry") if whole < n < before]
        if not parts:
            return self.spark.createDataFrame([], CARRY_SCHEMA)
        rows = self.spark.read.schema(CARRY_SCHEMA).parquet(*parts)
        newest = rows.groupBy("chat_id").agg(F.max("batch").alias("batch"))
        return rows.join(newest, ["chat_id", "batch"], "left_semi").select("chat_id", "last_seq", "events", "batch")

    def apply(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of events."""
        scratch = list(session._SCRATCH)
        new = self._path("input", number)
        # dealt anew: the files of a batch may be few, and a chat may hold any share of the rows
        batch.select("seq", "chat_id", "kind", "text", "reply_to").repartition("chat_id", "seq").write.mode("overwrite").parquet(new)
        events = self.spark.read.schema(EVENT_SCHEMA).parquet(new)
        chats = events.select("chat_id").distinct()
        carried = self._path("met", number)
        self.carried(number).join(chats, "chat_id", "left_semi").write.mode("overwrite").parquet(carried)
        carried = self.spark.read.schema(CARRY_SCHEMA).parquet(carried)
        placed = events.join(carried.select("chat_id", "last_seq"), "chat_id", "left")
        late = F.coalesce(F.col("seq") <= F.col("last_seq"), F.lit(False))
        placed.where(late).select("seq", "chat_id", "kind", "text", "reply_to").write.mode("overwrite").parquet(
            self._path("late", number))
        # carried texts are clean already and were forwarded once; what an earlier batch asked is not asked again
        ask = F.coalesce(F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq")), F.lit(False))
        fresh = prepare_events(placed.where(~late).withColumn("ask", ask), keep=("ask",))
        old = carried.select("chat_id", F.explode("events").alias("e")).select(
            "e.seq", "chat_id", "e.kind", "e.text", "e.reply_to", F.lit(False).alias("ask"))
        # cleaned texts and answers are written once: the requests and the carried rows both read them
        both = session.materialize(old.unionByName(fresh), "batch-events")
        hot = hot_keys(both.select("chat_id"), ["chat_id"], self.skew)
        found = session.materialize(answers(both, hot, self.skew), "batch-answers")
        asked = session_requests_batch(both, self.max_turns, self.skew, prepared=True, hot=hot, found=found, ask=F.col("ask"))
        asked.write.mode("overwrite").parquet(self._path("requests", number))
        carry_over(both, found, self.max_turns).join(
            carried.select("chat_id", F.col("last_seq").alias("before")), "chat_id", "full").select(
            "chat_id", F.greatest("last_seq", "before").alias("last_seq"),
            F.coalesce("events", F.array().cast(carried.schema["events"].dataType)).alias("events"),
            F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(self._path("carry", number))
        for kind in ("input", "met"):
            files.delete(self.spark, self._path(kind, number))
        session.release_scratch(self.spark, [p for p in session._SCRATCH if p not in scratch])
        if (number + 1) % self.compact == 0:
            self.carried(number + 1).write.mode("overwrite").parquet(self._path("whole", number))
            for kind, top in (("carry", number), ("whole", number - 1)):
                for n in self._numbers(kind):
                    if n <= top - (kind == "carry"):  # the last one is left for a repeated batch
                        files.delete(self.spark, self._path(kind, n))

    def requests(self) -> DataFrame:
        return self.spark.read.parquet(self._path("requests")).select("seq", "chat_id", "message", "history")

    def late(self) -> DataFrame:
        return self.spark.read.schema(EVENT_SCHEMA).parquet(self._path("late")).select("seq", "chat_id", "kind", "text", "reply_to")


def run_incremental(events_stream: DataFrame, store: SessionStore, checkpoint: str, timeout_s: int | None = None) -> None:
    """Process everything available now, batch by batch, into the store."""
    await_available(events_stream.writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start(), timeout_s)
