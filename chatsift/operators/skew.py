"""Heavy-hitter detection for per-key sequence operators.

A window partitioned by a key puts the whole key in one task. When one conversation or chat
holds a large share of all rows that task dominates the job, and AQE cannot split window
partitions. ``hot_keys`` finds the keys above a row threshold with one partially-aggregated
count over a seeded sample of the key columns (blocking a key is always correct, so the probe
need not be exact, only find the big keys); the result sent to the driver is capped, so it is
bounded by construction. ``with_blocks`` then gives rows of hot keys a block number from an
equi-depth histogram of the key's sequence, so a hot key spreads over many window partitions
of bounded size, outliers and clusters in the sequence included. Which keys are blocked never changes a result, only where it is computed: a block's
rows see exactly the items before them, from their block and from the halo, so a borderline key that
the probe misses costs time, not rows (tests compare both ways with brute force).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from chatsift.config import SkewConfig
from chatsift.session import materialize

BLOCK = "_blk"
SLOTS = 4096  # cells that a range of sequences is cut into at a time
BROADCAST_SLOTS = 1_000_000  # larger tables of slots are joined by a shuffle


@dataclass(frozen=True)
class HotKeys:
    """Result of the heavy-hitter probe: ``rows`` (hot key tuples), or ``all_keys`` when there were
    more than ``max_hot_keys`` of them, in which case every key is blocked."""

    rows: tuple = ()
    all_keys: bool = False

    @property
    def any(self) -> bool:
        return self.all_keys or bool(self.rows)


def hot_keys(probe: DataFrame, keys: list[str], skew: SkewConfig) -> HotKeys:
    fraction = min(1.0, max(skew.probe_fraction, 200.0 / max(skew.hot_key_rows, 1)))
    sampled = probe.select(*keys) if fraction >= 1.0 else probe.select(*keys).sample(fraction=fraction, seed=17)
    # a key at the threshold expects hot_key_rows * fraction sampled rows; flag from half of that
    cut = skew.hot_key_rows if fraction >= 1.0 else skew.hot_key_rows * fraction / 2
    counts = sampled.groupBy(*keys).count().where(F.col("count") > F.lit(cut)).select(*keys)
    found = counts.limit(skew.max_hot_keys + 1).collect()
    if len(found) > skew.max_hot_keys:
        return HotKeys(all_keys=True)
    return HotKeys(rows=tuple(tuple(r) for r in found))


def _near_equal_slots(rows: DataFrame, block_rows: int) -> tuple[list[DataFrame], DataFrame]:
    """Equi-depth blocks of ``rows`` (``_hk``, ``_seq``): the tables that lead a row to its slot, level by level,
    and the blocks of the slots (``_hk, _level, _slot, _blk``).

    A key's range of sequences is cut into ``SLOTS`` equal slots and their rows are counted; a slot with more than
    ``block_rows`` rows is cut again, over the range that its own rows span, until none is left or it holds
    one sequence value. Slots in order are then filled into blocks by running count, so a block has fewer
    than ``2 * block_rows`` rows however the sequences lie."""
    at, node = rows.select("_hk", "_seq", F.lit(0).cast("long").alias("_slot")), ["_hk", "_slot"]
    tables, leaves, level = [], None, 0
    while True:
        counts = materialize(at.groupBy(*node).agg(
            F.min("_seq").alias("_lo"), F.max("_seq").alias("_hi"), F.count(F.lit(1)).alias("_n")), "block-slots")
        dense = (F.col("_n") > block_rows) & (F.col("_hi") > F.col("_lo"))
        done = counts.where(~dense).select(*node, "_lo", "_n", F.lit(level).alias("_level"))
        leaves = done if leaves is None else leaves.unionByName(done)
        order = Window.partitionBy("_hk").orderBy("_slot")
        table = counts.where(dense).select(
            *node, "_lo", F.greatest(F.lit(1.0), (F.col("_hi") - F.col("_lo") + 1).cast("double") / SLOTS).alias("_width"),
            F.row_number().over(order).alias("_number"))
        if counts.where(dense).isEmpty():
            break
        table = materialize(table, "block-widths")
        tables.append(_small(table.withColumn("_level", F.lit(level))))
        at = _deeper(at.join(_small(table), node))
        level += 1
    before = Window.partitionBy("_hk").orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)
    blocks = leaves.select(*node, "_level", F.floor(
        F.coalesce(F.sum("_n").over(before), F.lit(0)) / block_rows).cast("long").alias(BLOCK))
    return tables, _small(materialize(blocks, "block-numbers"))


def _deeper(df: DataFrame) -> DataFrame:
    """Rows joined with a table of dense slots, moved to the slot below; other rows stay where they are."""
    inside = F.least(F.floor((F.col("_seq") - F.col("_lo")) / F.col("_width")), F.lit(SLOTS - 1)).cast("long")
    slot = F.when(F.col("_number").isNull(), F.col("_slot")).otherwise(F.col("_number") * SLOTS + inside)
    return df.withColumn("_slot", slot).drop("_lo", "_width", "_number")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_SLOTS else table


def with_blocks(df: DataFrame, keys: list[str], seq: Column | str, hot: HotKeys, block_rows: int) -> DataFrame:
    """Add ``_blk``: for hot keys (a null key included) the number of the row's stretch of the key's sequence, cut so
    that a stretch holds fewer than ``2 * block_rows`` rows (more only where rows share one sequence value);
    0 otherwise."""
    seq_c = F.col(seq) if isinstance(seq, str) else seq
    if not hot.any:
        return df.withColumn(BLOCK, F.lit(0).cast("long"))
    spark = df.sparkSession
    # one struct names the key: it is never null, so null keys join like any other
    keyed = df.withColumns({"_hk": F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), "_seq": seq_c})
    rows = keyed.select("_hk", "_seq")
    if not hot.all_keys:
        fields = [StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
        listed = spark.createDataFrame([(r,) for r in hot.rows], StructType([StructField("_hk", StructType(fields))]))
        # at most max_hot_keys rows: a proven bound, so broadcasting it is safe
        rows = rows.join(F.broadcast(listed), "_hk", "left_semi")
    tables, blocks = _near_equal_slots(rows, block_rows)
    placed = keyed.withColumns({"_slot": F.lit(0).cast("long"), "_level": F.lit(0)})
    for table in tables:
        met = placed.join(table, ["_hk", "_level", "_slot"], "left")
        placed = _deeper(met.withColumn("_level", F.col("_level") + F.col("_number").isNotNull().cast("int")))
    return placed.join(blocks, ["_hk", "_level", "_slot"], "left").withColumn(
        BLOCK, F.coalesce(BLOCK, F.lit(0).cast("long"))).drop("_hk", "_seq", "_slot", "_level")
