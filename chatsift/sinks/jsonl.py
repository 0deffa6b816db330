"""JSONL split writer (K1) and split reader (S11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.functions.messages import EXAMPLE
from chatsift.sources import files


def write_jsonl(df: DataFrame, path: str, *, order_key: Column | None = None, shuffle: bool = False) -> None:
    """Write ``prompt, completion, source`` as JSON lines (UTF-8, non-ASCII unescaped, key order
    kept), overwriting ``path``. With ``order_key`` each part file is written in that (seeded random)
    order; ``shuffle`` also range-distributes rows over part files by that key, so the files in name
    order hold one global order, which does not depend on how many files there are."""
    out = df.select("prompt", "completion", "source")
    if order_key is not None:
        out = df.select("prompt", "completion", "source", order_key.alias("_okey"))
        if shuffle:
            out = out.repartitionByRange("_okey")
        out = out.sortWithinPartitions("_okey").drop("_okey")
    out.write.mode("overwrite").option("compression", "none").json(path)


ROWS_PER_FILE = 200_000
SPREAD = 1 << 32  # values of a key's first eight hex digits


def write_splits(labelled: DataFrame, folder: str, order_key: Column, rows: int, *, shuffle: bool = False) -> None:
    """Write the rows labelled ``train`` and ``validation`` (column ``split``) as ``<folder>/train.jsonl`` and
    ``<folder>/validation.jsonl`` in one job, as ``write_jsonl`` does one by one.

    ``order_key`` is a uniform hash in hex: its leading digits say which of ``rows / ROWS_PER_FILE`` ranges a row belongs to,
    so no range has to be sampled; the files of a split, in name order, hold one global order."""
    spark = labelled.sparkSession
    out = labelled.select("prompt", "completion", "source", "split", order_key.alias("_okey"))
    if shuffle:
        parts = max(1, -(-rows // ROWS_PER_FILE))
        place = F.conv(F.substring("_okey", 1, 8), 16, 10).cast("long") * parts / SPREAD
        out = out.repartitionById(parts, F.floor(place).cast("int"))
    folder, tmp = folder.rstrip("/"), f"{folder.rstrip('/')}/_splits"
    out.sortWithinPartitions("split", "_okey").drop("_okey").write.mode("overwrite").partitionBy("split").option(
        "compression", "none").json(tmp)
    for name in ("train", "validation"):
        files.delete(spark, f"{folder}/{name}.jsonl")
        files.mkdirs(spark, f"{tmp}/split={name}")  # a split without rows
        files.rename(spark, f"{tmp}/split={name}", f"{folder}/{name}.jsonl")
    files.delete(spark, tmp)


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Read JSONL splits back as one frame with a ``split`` column (schema given, not inferred)."""
    frames = [spark.read.schema(EXAMPLE).json(p).withColumn("split", F.lit(name)) for name, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def split_counts(df: DataFrame) -> DataFrame:
    """Rows per split (the data part of the training summary)."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
