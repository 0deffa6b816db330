"""A stream over a growing folder of Parquet data that starts at the folder's current end.

``spark.readStream.format("growing_folder")`` reads what appears in a folder: plain Parquet files, or sub-folders
that a writer has finished (they hold ``_SUCCESS``), in order of name. With ``startingOffsets`` at ``latest``, the
default, the entries that are there when the stream first starts are its backlog and are never read;
``earliest`` begins with them. No clock is compared, so neither file times nor event times decide
what is new.

An offset is a number: how many times new entries were noted. Each time, their names are written to the
``log`` folder (shared storage, like the checkpoint) before the offset is handed out, so a restarted query reads
the same entries for the same offsets and knows what it has seen. ``maxEntriesPerTrigger`` bounds a micro-batch.
Files are read in tasks of about ``SPLIT_BYTES`` by row groups, as Arrow batches.
"""

from __future__ import annotations

import json
import posixpath

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "growing_folder"
SPLIT_BYTES = 128 << 20


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


class FolderLog:
    """What was noted so far: entry ``n`` of the log lists the names that offset ``n`` added."""

    def __init__(self, folder: str, log: str):
        self.fs, self.folder = _located(folder)
        self.log_fs, self.log = _located(log)
        self.seen: set[str] = set()
        self.last = -1

    def _entry(self, n: int) -> str:
        return posixpath.join(self.log, f"{n:012d}.json")

    def read(self, n: int) -> list[str]:
        with self.log_fs.open_input_stream(self._entry(n)) as f:
            return json.loads(f.read())

    def catch_up(self) -> None:
        while self.log_fs.get_file_info(self._entry(self.last + 1)).type == pafs.FileType.File:
            self.last += 1
            self.seen.update(self.read(self.last))

    def note(self, names: list[str]) -> None:
        self.log_fs.create_dir(self.log, recursive=True)
        part = self._entry(self.last + 1) + ".part"
        with self.log_fs.open_output_stream(part) as f:
            f.write(json.dumps(names).encode())
        self.log_fs.move(part, self._entry(self.last + 1))
        self.last += 1
        self.seen.update(names)

    def unseen(self) -> list[str]:
        """Finished entries of the folder that were not noted yet, in order of name."""
        names = []
        for info in self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True)):
            name = info.base_name
            if name[0] in "._" or name in self.seen:
                continue
            done = posixpath.join(info.path, "_SUCCESS")
            if info.type == pafs.FileType.File or self.fs.get_file_info(done).type == pafs.FileType.File:
                names.append(name)
        return sorted(names)

    def files(self, name: str) -> list[pafs.FileInfo]:
        path = posixpath.join(self.folder, name)
        info = self.fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [info]
        inside = self.fs.get_file_info(pafs.FileSelector(path, recursive=True))
        return sorted((i for i in inside if i.type == pafs.FileType.File and i.base_name[0] not in "._"), key=lambda i: i.path)


class RowGroups(InputPartition):
    def __init__(self, path: str, groups: list[int]):
        self.path, self.groups = path, groups


class GrowingFolderReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options):
        self.schema = schema
        self.folder, self.log_path = options["path"], options["log"]
        self.start = options.get("startingOffsets", "latest")
        if self.start not in ("latest", "earliest"):
            raise ValueError(f"startingOffsets is latest or earliest, not {self.start!r}")
        self.most = int(options.get("maxEntriesPerTrigger", 0))
        self.log = None

    def _log(self) -> FolderLog:
        if self.log is None:
            self.log = FolderLog(self.folder, self.log_path)
        self.log.catch_up()
        return self.log

    def initialOffset(self) -> dict:
        log = self._log()
        if log.last < 0:
            log.note(log.unseen() if self.start == "latest" else [])
        return {"noted": 0}

    def latestOffset(self) -> dict:
        log = self._log()
        if log.last < 0:
            self.initialOffset()
        new = log.unseen()
        if new:
            log.note(new[: self.most] if self.most else new)
        return {"noted": log.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        log, out = self._log(), []
        for n in range(start["noted"] + 1, end["noted"] + 1):
            for name in log.read(n):
                for info in log.files(name):
                    if info.size <= SPLIT_BYTES:  # no need to look inside
                        out.append(RowGroups(info.path, []))
                        continue
                    with log.fs.open_input_file(info.path) as f:
                        meta = pq.ParquetFile(f).metadata
                    held, size = [], 0
                    for g in range(meta.num_row_groups):
                        held.append(g)
                        size += meta.row_group(g).total_byte_size
                        if size >= SPLIT_BYTES or g == meta.num_row_groups - 1:
                            out.append(RowGroups(info.path, held))
                            held, size = [], 0
        return out

    def read(self, partition: RowGroups):
        fs, _ = _located(self.folder)
        wanted = to_arrow_schema(self.schema)
        with fs.open_input_file(partition.path) as f:
            file = pq.ParquetFile(f)
            there = set(file.schema_arrow.names)
            for batch in file.iter_batches(row_groups=partition.groups or range(file.num_row_groups),
                                           columns=[n for n in wanted.names if n in there]):
                cols = [batch.column(batch.schema.get_field_index(x.name)).cast(x.type) if x.name in there
                        else pa.nulls(batch.num_rows, x.type) for x in wanted]
                yield pa.RecordBatch.from_arrays(cols, schema=wanted)

    def commit(self, end: dict) -> None:
        pass


class GrowingFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        raise ValueError("give the schema of the folder's rows: readStream.schema(...)")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingFolderReader(schema, self.options)


def from_now(spark: SparkSession, path: str, schema: str, log: str, *, starting: str = "latest",
             max_entries: int | None = None) -> DataFrame:
    """The rows that appear in the folder ``path`` from the first start of the query on. ``log`` is a folder of this
    query's own on shared storage."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy
    spark.dataSource.register(GrowingFolder)
    reader = spark.readStream.format(FORMAT).schema(schema).option("log", log).option("startingOffsets", starting)
    if max_entries:
        reader = reader.option("maxEntriesPerTrigger", max_entries)
    return reader.load(path)
