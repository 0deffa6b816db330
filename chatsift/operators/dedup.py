"""Priority union and keep-first deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from chatsift.session import materialize

ORDER = "_order"
ROW = "_row"


def ordered(df: DataFrame, rank: int, file_name: Column | str | None = None, pos: Column | str | None = None,
            sub: Column | str | None = None, block: Column | str | None = None) -> DataFrame:
    """Attach the global order key ``(source_rank, file_name, block, row_pos, row_key, sub_pos)`` that
    decides which copy survives deduplication (earlier sources, then file name, then position win).
    Integer positions order by number, keys of any other type as text."""

    def c(x, default):
        if x is None:
            return default
        return F.col(x) if isinstance(x, str) else x

    place = c(pos, F.lit(0))
    numeric = isinstance(df.select(place).schema[0].dataType, IntegralType)

    key = F.struct(
        F.lit(rank).cast("int").alias("source_rank"),
        c(file_name, F.lit("")).cast("string").alias("file_name"),
        c(block, F.lit(0)).cast("long").alias("block"),
        (place if numeric else F.lit(0)).cast("long").alias("row_pos"),
        (F.lit("") if numeric else F.coalesce(place.cast("string"), F.lit(""))).alias("row_key"),
        c(sub, F.lit(0)).cast("long").alias("sub_pos"),
    )
    return df.withColumn(ORDER, key)


def priority_union(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name of frames that each carry ``_order``."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with a row number of its own in ``_row``; lasting only once the frame is written."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def keep_first(df: DataFrame, signature: Column | str, order: Column | str = ORDER, *, staged: bool = False,
               payload: list[str] | None = None) -> DataFrame:
    """Exactly one row per signature: the row with the smallest order key, whole. Rows without an order
    key come after those with one; of rows equal in order any one is kept. A null signature is the empty one.

    The winner is found on fixed-width keys alone: a 128-bit hash of the signature plus its length,
    the order key and a row number, reduced per map task before the shuffle (a hash aggregation for a
    numeric order), so a signature shared by a large part of the data never lands in one task and no
    text is sorted or shuffled for it. Signatures of a single row are settled by that; for the others
    the rows of the smallest order are met again and the smallest row number decides. Whole rows are then
    fetched by row number, a unique key, so that join spreads evenly too (AQE broadcasts the winners while
    they are small). All passes read one written table; ``staged`` says that ``df`` already is one, made from
    a ``numbered`` frame. ``payload`` names the columns wanted (default: all).
    """
    cols = payload or [c for c in df.columns if c != ROW]
    order_c = F.col(order) if isinstance(order, str) else order
    sig = F.coalesce(F.col(signature) if isinstance(signature, str) else signature, F.lit(""))
    keyed = df.withColumns({"_h1": F.xxhash64(sig), "_h2": F.xxhash64(F.lit("keep-first"), sig), "_n": F.length(sig),
                            "_first": order_c})
    if not staged:
        keyed = materialize(numbered(keyed.select(*dict.fromkeys([*cols, "_h1", "_h2", "_n", "_first"]))), "keep-first")
    keys = ["_h1", "_h2", "_n"]
    found = keyed.groupBy(*keys).agg(F.min("_first").alias("_low"), F.min(ROW).alias(ROW), F.count(F.lit(1)).alias("_rows"))
    several = found.where("_rows > 1").select(*keys, "_low")
    first = keyed.select(*keys, "_first", ROW).join(several, keys).where(F.col("_first").eqNullSafe(F.col("_low")))
    winners = found.where("_rows = 1").select(ROW).unionByName(first.groupBy(*keys).agg(F.min(ROW).alias(ROW)).select(ROW))
    return keyed.join(winners, ROW, "left_semi").select(*cols)
