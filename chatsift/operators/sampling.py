"""Seeded exact-size sampling and the exact train/validation split, without a global sort.

Row order is ``md5(seed || '|' || row_key)`` (hex). The end of the first ``n`` rows in that order is
found by bucketing on hex prefixes: one grouped count per level (at most 65,536 buckets, summed in
order inside Spark; one row per level reaches the driver), descending into the bucket that holds the
n-th row until a bucket ends there, which for N rows takes about log(N) / log(65,536) levels. The
result is a threshold, and the sample/split is a plain filter (no global sort, no row numbering, no
shuffle of the data itself). Row keys must be unique and not null; a null key, or equal keys that
straddle the threshold, raise ``RowKeyError``, so a sample never has another size than asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatsift.session import materialize

PREFIX_STEP = 4  # hex digits per level: 65,536 buckets
KEY_DIGITS = 32
PAST = "~"  # sorts after every hex digit


class RowKeyError(ValueError):
    """Row keys that do not identify rows."""


def order_key(seed: int, row_key: Column | str) -> Column:
    rk = F.col(row_key) if isinstance(row_key, str) else row_key
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), rk.cast("string")))


@dataclass(frozen=True)
class Threshold:
    """Rows whose order key is below ``key`` are the first ``n``; ``everything`` / ``nothing`` cover
    ``n >= total`` and ``n <= 0``."""

    key: str | None = None
    everything: bool = False
    nothing: bool = False
    total: int = 0
    n: int = 0

    def predicate(self, key: Column) -> Column:
        if self.everything or self.nothing:
            return F.lit(self.everything)
        return key < F.lit(self.key)


def first_n_threshold(df: DataFrame, key: Column, n: int | Callable[[int], int]) -> Threshold:
    """Threshold of the first ``n`` rows of ``df`` in ``key`` order (keys are hex md5).

    Per level: a grouped count by key prefix (partial aggregation; at most 65,536 groups), then a
    running sum over those groups to find the bucket holding the n-th row; only that bucket's row
    reaches the driver. ``n`` may be a function of the row count, which comes from the first level."""
    if isinstance(n, int) and n <= 0:
        return Threshold(nothing=True)
    base = df.select(key.alias("_k"))
    prefix, total, remaining = "", 0, 0
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        plen = len(prefix) + PREFIX_STEP
        scope = base.where(F.col("_k").startswith(prefix)) if prefix else base
        # the last row's running sum is the total: both come from one small table of buckets
        running = scope.groupBy(F.substring("_k", 1, plen).alias("b")).count().withColumn("cum", F.sum("count").over(upto))
        if not prefix:
            running = running.cache()
            try:
                head = running.agg(F.max("cum").alias("total"), F.max(F.col("b").isNull()).alias("null_key")).first()
                if head["null_key"]:
                    raise RowKeyError("a row key is null")
                total = head["total"] or 0
                remaining = n = n(total) if callable(n) else n
                if n <= 0 or n >= total:
                    return Threshold(everything=n > 0, nothing=n <= 0, total=total, n=max(0, min(n, total)))
                edge = running.where(F.col("cum") >= remaining).orderBy("b").first()
            finally:
                running.unpersist()
        else:
            edge = running.where(F.col("cum") >= remaining).orderBy("b").first()
        prefix = edge["b"]
        if edge["cum"] == remaining:
            return Threshold(key=prefix + PAST, total=total, n=n)
        if plen >= KEY_DIGITS:
            raise RowKeyError(f"{edge['count']} rows share one row key")
        remaining -= edge["cum"] - edge["count"]


def validation_size(n: int, ratio: float) -> int:
    """The share ``ratio`` of ``n`` rows, at most a tenth and at least one; fewer than 2 rows raise."""
    if n < 2:
        raise ValueError(f"dataset too small to split: {n} rows (need at least 2)")
    return max(1, min(int(n * ratio), n // 10))


def sample_exact(df: DataFrame, n: int, seed: int, row_key: Column | str) -> DataFrame:
    """Seeded exact-``n`` sample (``n <= 0``: empty; ``n >=`` rows: everything)."""
    rk = F.col(row_key) if isinstance(row_key, str) else row_key
    key = order_key(seed, rk)
    return df.where(first_n_threshold(df, key, n).predicate(key))


def exact_split(df: DataFrame, seed: int, ratio: float, row_key: Column | str,
                split_col: str = "split") -> tuple[DataFrame, int, int]:
    """Label each row ``validation`` (the first v rows in seeded order) or ``train``.
    Returns (labelled frame, n, v). ``row_key`` must be unique per row; fewer than 2 rows raise."""
    rk = F.col(row_key) if isinstance(row_key, str) else row_key
    key = order_key(seed, rk)
    t = first_n_threshold(df, key, lambda total: validation_size(total, ratio))
    labelled = df.withColumn(split_col, F.when(t.predicate(key), F.lit("validation")).otherwise(F.lit("train")))
    return labelled, t.total, t.n


def sample_exact_groups(df: DataFrame, n: int, seed: int, group_key: str) -> DataFrame:
    """Keep all rows of ``n`` seeded-randomly chosen groups (e.g. conversations stored one row per
    turn): the threshold is found over the distinct keys, then applied as a row filter."""
    keys = materialize(df.select(group_key).distinct(), "group-keys")  # read once per level
    key = order_key(seed, F.col(group_key))
    return df.where(first_n_threshold(keys, key, n).predicate(key))
