"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_rows`` rows in a seeded order. With target weight ``w`` of
``total`` (reduced by their common divisor) the i-th block of a source (from 0) has release time
``floor(i * total / w)`` and deadline ``ceil((i + 1) * total / w)``, in slots of one block. Earliest
deadline first over the released blocks meets every deadline (unit jobs, integer windows, total weight
one), so after any number of slots each source's blocks deviate from its target by less than one
block, up to the first slot at which a source has run out. All lags are zero after ``total`` slots, so
the schedule repeats: the driver goes once through that period or, if the data ends before, up to the
last block's slot, and hands the slots over in pieces of ``PIECE`` blocks. A source that has run out
leaves its slots empty: the rest keep their proportions to each other, and no row is dropped or
repeated. Read in the order ``mix_slot, mix_rank``.

Rows are numbered per source without one task per source: hash buckets are counted, their offsets
summed, and rows ranked inside (source, bucket), so a source with a third of all rows is spread over
all buckets.

Nulls and edges: a null source is a source of its own; rows with equal ids are ranked next to each
other; null text is carried along; an empty table gives an empty result. Input columns of the five output names are replaced, all
others kept.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatsift.llm.common import stage

BLOCK_ROWS = 64
PIECE = 1_000_000  # also the largest schedule that is broadcast
BUCKET_DIGITS = 3  # hex digits of the order key: 4096 buckets per source
MAX_SOURCES = 100_000
SEED = 42


def shares(weights: dict[str, int], period: int) -> dict[str, int]:
    """Weights rounded to integer shares summing to ``period``, at least one each, by largest remainder."""
    total, spare = sum(weights.values()), period - len(weights)
    out = {s: 1 + w * spare // total for s, w in weights.items()}
    by_rest = sorted(weights, key=lambda s: (-(weights[s] * spare % total), s))
    for s in by_rest[: period - sum(out.values())]:
        out[s] += 1
    return out


def period_schedule(share: dict[str, int], period: int, slots: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of one period, or of its first ``slots``: in each slot the released block
    of earliest deadline, ties by source name."""
    waiting = [(0, s, 0) for s in sorted(share)]  # by release
    ready: list[tuple[int, str, int]] = []  # by deadline
    for slot in range(period if slots is None else min(slots, period)):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // share[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield s, i, slot
        if i + 1 < share[s]:
            heapq.heappush(waiting, ((i + 1) * period // share[s], s, i + 1))


def _unused(columns: list[str]) -> str:
    """A prefix that no column has, for the columns that the work needs in between."""
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def source_sizes(rows: DataFrame, source_col: str) -> dict[str, int]:
    got = rows.groupBy(source_col).agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    return {r[0]: r[1] for r in got}


def default_weights(sizes: dict[str, int]) -> dict[str, int]:
    """The square root of each source's rows, in thousandths (temperature two, which raises small
    sources against large ones)."""
    return {s: int(math.sqrt(n) * 1000) for s, n in sizes.items()}


def _schedule(spark: SparkSession, share: dict[str, int], period: int, blocks: dict[str, int], own: str) -> DataFrame:
    """(source, turn, at): the slot of each block of the first period that the data has."""
    last = max((-(-n * period // share[s]) for s, n in blocks.items()), default=0)
    schema = pa.schema([(own + "source", pa.string()), (own + "turn", pa.int64()), (own + "at", pa.int64())])
    frame = lambda held: spark.createDataFrame(
        pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held) if held else ([],) * 3, schema)], schema=schema))
    held, done = [], None
    for s, i, slot in period_schedule(share, period, last):
        if i < blocks.get(s, 0):
            held.append((s, i, slot))
        if len(held) == PIECE:
            part, held = stage(frame(held), "mix-schedule"), []
            done = part if done is None else done.unionByName(part)
    return F.broadcast(frame(held)) if done is None else done.unionByName(frame(held))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, source_col: str = "source", id_col: str = "doc_id",
        block_rows: int = BLOCK_ROWS, period: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` plus mix_block, mix_rank (in its block), mix_slot, mix_release, mix_deadline.

    ``weights`` gives positive integer target weights by source name; sources it does not name are
    an error. A ``period`` rounds the weights to shares of so many slots, at least 10 per source."""
    spark = docs.sparkSession
    names = ["mix_block", "mix_rank", "mix_slot", "mix_release", "mix_deadline"]
    docs = docs.drop(*names)
    own = _unused(docs.columns)
    label = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(
        F.concat(F.lit("="), F.col(source_col).cast("string")))  # null apart from the empty name
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.withColumns({own + "source": label, own + "key": key}).withColumn(
        own + "bucket", F.substring(own + "key", 1, BUCKET_DIGITS))
    found = source_sizes(rows, own + "source")
    if weights is None:
        given = default_weights(found)
    else:
        given = {"" if s is None else f"={s}": int(w) for s, w in weights.items()}
        if any(w <= 0 for w in given.values()):
            raise ValueError("weights are positive integers")
        unnamed = sorted(s for s in found if s not in given)[:5]
        if unnamed:
            raise ValueError(f"no weight for sources {unnamed}")
    if period is None:
        common = math.gcd(*given.values())
        share = {s: w // common for s, w in given.items()}
        period = sum(share.values())
    else:
        period = max(period, 10 * len(given))
        share = shares(given, period) if given else {}
    plan = _schedule(spark, share, period, {s: -(-n // block_rows) for s, n in found.items()}, own)
    sizes = rows.groupBy(own + "source", own + "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(own + "source").orderBy(own + "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(own + "source", own + "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(own + "start"))
    inside = Window.partitionBy(own + "source", own + "bucket").orderBy(own + "key")
    at = F.col(own + "start") + F.col(own + "nth") - 1
    numbered = rows.withColumn(own + "nth", F.row_number().over(inside)).join(
        starts, [own + "source", own + "bucket"]).withColumns({
            "mix_block": F.floor(at / block_rows).cast("long"), "mix_rank": (at % block_rows).cast("long")})
    given_shares = F.broadcast(spark.createDataFrame(list(share.items()), f"{own}source string, {own}share long"))
    turned = numbered.join(given_shares, own + "source").withColumn(own + "turn", F.col("mix_block") % F.col(own + "share"))
    placed = turned.join(plan, [own + "source", own + "turn"])
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns], "mix_block", "mix_rank",
        (F.expr(f"mix_block div {own}share") * period + F.col(own + "at")).cast("long").alias("mix_slot"),
        F.expr(f"(mix_block * {period}) div {own}share").cast("long").alias("mix_release"),
        F.expr(f"((mix_block + 1) * {period} + {own}share - 1) div {own}share").cast("long").alias("mix_deadline"))
