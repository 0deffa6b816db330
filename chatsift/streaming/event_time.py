"""Chat sessions in the order of event time: events may arrive late and out of order, and sessions expire.

Events carry a time ``ts`` besides ``seq, chat_id, kind, text, reply_to``. An event waits in a map state of its
chat until the watermark (the greatest time seen less ``delay``) has passed its time; an event-time
timer then applies all that is due, in order of (time, seq). So the requests do not depend
on how events are dealt over micro-batches, as long as none is more than ``delay`` behind. An event at
or before the watermark when it arrives is late: it comes out as a row with ``late`` set and changes
nothing. Of events that repeat a chat, time and seq the last to arrive counts.

A session expires ``ttl_ms`` after its last applied event: a later one finds it empty, and a timer drops its
state once the watermark is there, so silent chats cost no state.

At the end of a stream the events of the last ``delay`` still wait, as later ones may come before them.

Every call of the state store is a message between Python and the JVM, so events wait in chunks of up to
``CHUNK_ROWS``, numbered as they came: the calls follow the chats that a micro-batch touches, not its events.
A worker holds what is due of one chat and one chunk more.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chatsift.config import CHAT_MAX_HISTORY_TURNS
from chatsift.streaming.sessions import (
    EMPTY, OUTPUT_SCHEMA, STATE_SCHEMA, loaded, prepare_events, request_row, shipped_by_value, step)

TIMED_SCHEMA = "seq long, chat_id long, kind string, text string, reply_to long, ts timestamp"
# the last field of a stored session is the time of its last applied event here
SESSION_SCHEMA = STATE_SCHEMA.replace("last_seq long", "last_at long")


CHUNK_ROWS = 1000


class Event(NamedTuple):
    at: int
    seq: int
    kind: str
    text: str | None
    reply_to: int | None


CHUNK_SCHEMA = "events array<struct<at: long, seq: long, kind: string, text: string, reply_to: long>>"


class EventTimeSessionProcessor(StatefulProcessor):
    def __init__(self, max_turns: int = CHAT_MAX_HISTORY_TURNS, ttl_ms: int | None = None):
        self.max_turns, self.ttl_ms = max_turns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", SESSION_SCHEMA)
        self.waiting = handle.getMapState("waiting_chunks", "n long, first long", CHUNK_SCHEMA)

    def _chunks(self) -> list[tuple[int, int]]:
        """The chat's chunks in the order in which they came: number and earliest time. A timer is always set for
        the earliest of all."""
        return sorted(tuple(k) for k in self.waiting.keys())

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        chunk, number, timer, first = [], None, None, None
        for seq, _, kind, text, reply_to, at in rows:
            event = Event(at, seq, kind, text, reply_to)
            if at <= passed:
                yield request_row(event, key[0], None, late=True)
                continue
            if number is None:
                there = self._chunks()
                number = there[-1][0] + 1 if there else 0
                timer = min((t for _, t in there), default=None)
            chunk.append(tuple(event))
            first = at if first is None else min(first, at)
            if len(chunk) == CHUNK_ROWS:
                self._wait(number, chunk)
                chunk, number = [], number + 1
        if chunk:
            self._wait(number, chunk)
        if first is not None and (timer is None or first < timer):
            self.handle.registerTimer(first)

    def _wait(self, number: int, events: list[tuple]) -> int:
        first = min(e[0] for e in events)
        self.waiting.updateValue((number, first), (events,))
        return first

    def _due(self, passed: int) -> list[Event]:
        """The events whose time has passed, in order and taken from the state."""
        there, due, later = self._chunks(), {}, []
        for n, first in there:
            if first > passed:
                later.append(first)
                continue
            events = [Event(*e) for e in self.waiting.getValue((n, first))[0]]
            due.update(((e.at, e.seq), e) for e in events if e.at <= passed)  # the last to arrive counts
            self.waiting.removeKey((n, first))
            left = [tuple(e) for e in events if e.at > passed]
            if left:
                later.append(self._wait(n, left))
        if due and later:
            self.handle.registerTimer(min(later))
        return [due[k] for k in sorted(due)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = self._due(passed)
        stored = self.state.get() if due or self.ttl_ms is not None else None
        state, last_at = loaded(stored), stored[4] if stored else None
        for r in due:
            if self.ttl_ms is not None and last_at is not None and r.at - last_at > self.ttl_ms:
                state = EMPTY
            state, sent = step(state, r, self.max_turns)
            if sent is not None:
                yield request_row(r, key[0], sent)
            last_at = r.at
        over = None if self.ttl_ms is None or last_at is None else last_at + self.ttl_ms
        if over is not None and over <= passed:
            self.state.clear()  # any event still to come is past the watermark
        elif due:
            self.state.update((*state, last_at))
            if over is not None:
                self.handle.registerTimer(over)

    def close(self) -> None:
        pass


def session_requests_by_event_time(events: DataFrame, delay: str, ttl_ms: int | None = None,
                                   max_turns: int = CHAT_MAX_HISTORY_TURNS, time_col: str = "ts") -> DataFrame:
    """Timed events as a stream -> ``seq, chat_id, message, history, late``: a request per message in the
    order of event time, and a row per late event. ``delay`` is how far an event may lag behind (an
    interval such as ``10 minutes``)."""
    shipped_by_value(events.sparkSession)
    # a plain number of milliseconds: a column marked as event time would have its late rows dropped unseen
    timed = events.withWatermark(time_col, delay).withColumn("at", F.unix_millis(F.col(time_col)))
    return prepare_events(timed, keep=("at",)).groupBy("chat_id").transformWithState(
        statefulProcessor=EventTimeSessionProcessor(max_turns, ttl_ms), outputStructType=OUTPUT_SCHEMA,
        outputMode="Append", timeMode="EventTime")
