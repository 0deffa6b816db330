"""CSV files read in many tasks although quoted fields may hold line ends.

A file is read as text lines, split anywhere. Whether a line ends inside a quoted field depends on
whether it began in one, so each line is a function on two states (between records, inside quotes), found by
two patterns. First the functions of the lines of each split are composed, in file order, and the splits of a file
after each other: that gives the state at the start of every split, one small row each. Then each split
forms its records from that state; a record that runs across splits leaves its pieces, which are joined
afterwards by the split that it began in. Single-line records, nearly all, pass as whole Arrow columns.
A file's header, the first record of its first split, is marked there: no look back at the records.
Files too small to be split need neither the states nor a table of pieces.

A quote opens a field only at the field's start; doubled quotes inside a field are quotes. Splits keep
their line order in a task, so there is no shuffle of the lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatsift.session import materialize
from chatsift.sources import files

_FIELDS = r'(?:(?:"(?:[^"]++|"")*+"|[^",][^,]*+|),)*+'
_OPEN = r'"(?:[^"]++|"")*+'  # a quoted field without its end
OPENS = f"^{_FIELDS}{_OPEN}$"  # a line that begins between records ends inside quotes
STAYS = f'^(?:[^"]++|"")*+(?:",{_FIELDS}{_OPEN})?$'  # a line that begins inside quotes ends there
BROADCAST_SPLITS = 1_000_000
SPLITS = "file_name string, block long, from_out boolean, from_in boolean"
PIECES = "file_name string, block long, pos long, kind int, value string"
# a record, the first piece of one, a further piece; a header, the first piece of one
WHOLE, BEGIN, REST, HEADER, HEADER_BEGIN = range(5)


def _runs(file_name: pa.Array, block: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of rows of one split."""
    names = file_name.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((np.diff(names) != 0) | (np.diff(block) != 0)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]))


def _states(start: int, opens: np.ndarray, stays: np.ndarray) -> np.ndarray:
    """State before each line, and after the last one, of lines read from ``start``."""
    fixed = np.flatnonzero(opens == stays)  # these end in one state whatever came before
    turns = np.concatenate(([0], np.cumsum(opens & ~stays)))
    last = np.searchsorted(fixed, np.arange(len(opens) + 1)) - 1  # the latest such line before
    at = np.where(last >= 0, fixed[last] if len(fixed) else 0, -1)
    base = np.where(last >= 0, opens[at], start) if len(opens) else np.full(1, start)
    return (base.astype(np.int64) + turns - np.where(last >= 0, turns[at + 1], 0)) % 2


def _split_functions(batches):
    """Per split the state at its end from either state at its start."""
    key, ends = None, (0, 1)
    emit = lambda: pa.RecordBatch.from_arrays(
        [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([bool(ends[0])]), pa.array([bool(ends[1])])],
        names=["file_name", "block", "from_out", "from_in"])
    for batch in batches:
        block = batch.column("block").to_numpy()
        opens, stays = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("opens", "stays"))
        for lo, hi in _runs(batch.column("file_name"), block) if batch.num_rows else ():
            here = (batch.column("file_name")[lo].as_py(), int(block[lo]))
            if here != key:
                if key is not None:
                    yield emit()
                key, ends = here, (0, 1)
            ends = tuple(int(_states(s, opens[lo:hi], stays[lo:hi])[-1]) for s in ends)
    if key is not None:
        yield emit()


def _records(batches):
    """Records and pieces of records of each split, in order."""
    key, state, held, held_pos, kinds = None, 0, [], 0, None

    def rows(items):
        cols = list(zip(*items))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
             pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())],
            names=["file_name", "block", "pos", "kind", "value"])

    for batch in batches:
        if not batch.num_rows:
            continue
        block, pos = batch.column("block").to_numpy(), batch.column("pos").to_numpy()
        opens, stays = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("opens", "stays"))
        whole, kind = np.zeros(batch.num_rows, dtype=bool), np.full(batch.num_rows, WHOLE, dtype=np.int32)
        out = []
        for lo, hi in _runs(batch.column("file_name"), block):
            here = (batch.column("file_name")[lo].as_py(), int(block[lo]))
            if here != key:
                if held:
                    out.append((*key, held_pos, kinds[1], "\n".join(held)))
                key, held, top = here, [], here[1] == 0
                state = int(bool(batch.column("inside")[lo].as_py()))
            else:
                top = False
            states = _states(state, opens[lo:hi], stays[lo:hi])
            state = int(states[-1])
            whole[lo:hi] = (states[:-1] == 0) & (states[1:] == 0)
            if top and whole[lo]:
                kind[lo] = HEADER
            for i in np.flatnonzero(~whole[lo:hi]).tolist():
                if not held:
                    held_pos = int(pos[lo + i])  # then the kinds if the record ends here, and if it does not
                    kinds = (REST, REST) if states[i] else (HEADER, HEADER_BEGIN) if top and i == 0 else (WHOLE, BEGIN)
                held.append(batch.column("value")[lo + i].as_py())
                if states[i + 1] == 0:
                    out.append((*key, held_pos, kinds[0], "\n".join(held)))
                    held = []
        plain = batch.select(["file_name", "block", "pos", "value"]).filter(pa.array(whole))
        yield pa.RecordBatch.from_arrays(
            [*plain.columns[:3], pa.array(kind[whole]), plain.column(3)],
            names=["file_name", "block", "pos", "kind", "value"])
        if out:
            yield rows(out)
    if held:
        yield rows([(*key, held_pos, kinds[1], "\n".join(held))])


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    first = F.col("_metadata.file_block_start")
    lines = spark.read.option("encoding", "UTF-8").option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_name").alias("file_name"), first.alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
    tidy = F.regexp_replace("value", "\r$", "")  # an end of line, inside quotes as well
    quoted = F.contains("value", F.lit('"'))
    return lines.withColumns({"opens": quoted & tidy.rlike(OPENS), "stays": ~quoted | tidy.rlike(STAYS)})


def inside_splits(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """(file_name, block): the splits that begin inside quotes; None if no file is large enough to be split."""
    limit = min(_bytes(spark, "spark.sql.files.openCostInBytes"), _bytes(spark, "spark.sql.files.maxPartitionBytes"))
    if all(n <= limit for n in files.sizes(spark, paths)):
        return None
    ends = _lines(spark, paths).select("file_name", "block", "opens", "stays").mapInArrow(_split_functions, SPLITS)
    before = Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed, turn = F.col("from_out") == F.col("from_in"), F.col("from_out") & ~F.col("from_in")
    turns = F.coalesce(F.sum(turn.cast("int")).over(before), F.lit(0))
    counted = ends.withColumn("turns", turns).withColumn(
        "fix", F.last(F.when(fixed, F.struct("from_out", "turns")), ignorenulls=True).over(before))
    state = F.coalesce(F.col("fix.from_out").cast("int"), F.lit(0)) + F.col("turns") - F.coalesce("fix.turns", F.lit(0))
    found = materialize(counted.where(state % 2 == 1).select("file_name", "block"), "csv-splits")
    return F.broadcast(found) if found.count() <= BROADCAST_SPLITS else found


def _bytes(spark: SparkSession, name: str) -> int:
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))


def csv_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_name, block, pos, record): the records of CSV files, line ends inside quotes kept, the CR of a
    record's own end and a byte-order mark cut, blank lines and each file's header left out."""
    inside = inside_splits(spark, paths)
    lines = _lines(spark, paths)
    if inside is None:
        lines = lines.withColumn("inside", F.lit(False))
    else:
        lines = lines.join(inside.withColumn("inside", F.lit(True)), ["file_name", "block"], "left")
    pieces = lines.select("file_name", "block", "pos", "value", "opens", "stays", "inside").mapInArrow(_records, PIECES)
    if inside is None:  # a first piece has no second: a quote that is never closed
        rows = pieces.where(F.col("kind").isin(WHOLE, BEGIN)).select("file_name", "block", "pos", "value")
    else:
        pieces = materialize(pieces, "csv-records")
        whole = pieces.where(F.col("kind") == WHOLE).select("file_name", "block", "pos", "value")
        order = Window.partitionBy("file_name").orderBy("block", "pos")
        begun = F.sum(F.col("kind").isin(BEGIN, HEADER_BEGIN).cast("int")).over(order)
        split = pieces.where(F.col("kind").isin(BEGIN, REST, HEADER_BEGIN)).withColumn("record", begun).groupBy(
            "file_name", "record").agg(F.array_sort(F.collect_list(F.struct("block", "pos", "value", "kind"))).alias("p"))
        rows = whole.unionByName(split.where(F.col("p")[0]["kind"] != HEADER_BEGIN).select(
            "file_name", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["pos"].alias("pos"),
            F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value")))
    record = F.when(F.col("value").endswith("\r"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return rows.select("file_name", "block", "pos", record.alias("record")).where("record != ''")
