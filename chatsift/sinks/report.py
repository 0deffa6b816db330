"""Build report (K2): split sizes and per-source counts before/after dedup as a one-row frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


FILES = "custom:*"  # stands for all files of a custom folder in the report's one row


def source_table(counts_before: DataFrame, counts_after: DataFrame) -> DataFrame:
    """(source, n_before, n_after) of every source, each file of a custom folder included."""
    none = F.lit(0).cast("long")
    return counts_before.withColumnRenamed("n", "n_before").join(
        counts_after.withColumnRenamed("n", "n_after"), "source", "left").select(
        "source", "n_before", F.coalesce("n_after", none).alias("n_after"))


def report_frame(sources: DataFrame, train_rows: int, validation_rows: int, notes: tuple[str, ...] = (),
                 rejected_rows: int = 0) -> DataFrame:
    """One row: train_rows, validation_rows, total_rows_after_dedup, source_counts_before_dedup,
    source_counts_after_dedup (maps), notes, rejected_rows (rejected lines, rows and files). Files of a custom folder
    may be many: the maps sum them up as ``custom:*``; by file they are rows of ``source_table`` and of
    the reject counts, which are tables of their own."""
    name = F.when(F.col("source").startswith("custom:"), F.lit(FILES)).otherwise(F.col("source"))
    sums = sources.groupBy(name.alias("source")).agg(F.sum("n_before").alias("before"), F.sum("n_after").alias("after"))
    both = sums.select("source", F.col("before").alias("n"), F.lit(True).alias("_before")).unionByName(
        sums.where("after > 0").select("source", F.col("after").alias("n"), F.lit(False).alias("_before")))

    def as_map(before: bool):
        entries = F.collect_list(F.when(F.col("_before") == F.lit(before), F.struct("source", "n")))
        return F.map_from_entries(F.array_sort(entries))

    maps = both.agg(
        as_map(True).alias("source_counts_before_dedup"),
        as_map(False).alias("source_counts_after_dedup"),
    )
    return maps.select(
        F.lit(train_rows).cast("long").alias("train_rows"),
        F.lit(validation_rows).cast("long").alias("validation_rows"),
        F.lit(train_rows + validation_rows).cast("long").alias("total_rows_after_dedup"),
        "source_counts_before_dedup",
        "source_counts_after_dedup",
        F.array(*[F.lit(n) for n in notes]).cast("array<string>").alias("notes"),
        F.lit(rejected_rows).cast("long").alias("rejected_rows"),
    )


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)
