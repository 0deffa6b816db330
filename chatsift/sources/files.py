"""File-system helpers on the cluster's Hadoop FileSystem (works for local, HDFS, object stores).

Only file *names* and the first few KB of files reach the driver; contents are read by Spark.
"""

from __future__ import annotations

import fnmatch
import posixpath
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Full paths of the plain files directly in ``folder`` whose base name matches ``pattern``,
    sorted by base name (no recursion)."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    found = []
    for st in fs.listStatus(p):
        if st.isFile():
            name = st.getPath().getName()
            if fnmatch.fnmatchcase(name, pattern):
                found.append((name, st.getPath().toString()))
    return [path for _, path in sorted(found)]


def list_folders(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Full paths of the folders directly in ``folder`` whose base name matches ``pattern``, sorted."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(st.getPath().toString() for st in fs.listStatus(p)
                  if st.isDirectory() and fnmatch.fnmatchcase(st.getPath().getName(), pattern))


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


HEADER_BYTES = 4096  # as much of a file as is read for its header
OPEN_FILES = 32


def sizes(spark: SparkSession, paths: list[str]) -> list[int]:
    """Bytes of each file."""
    found = []
    for path in paths:
        fs, p = _fs(spark, path)
        found.append(int(fs.getFileStatus(p).getLen()))
    return found


def _head(spark: SparkSession, path: str) -> bytes:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(HEADER_BYTES))
    finally:
        stream.close()


def first_lines(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """First line of each file by base name (empty for an empty file), UTF-8, without a leading
    byte-order mark or closing CR, cut to ``HEADER_BYTES``. Only so many bytes of each file are read, ``OPEN_FILES`` files
    at a time, whatever the files' sizes."""
    if not paths:
        return {}
    with ThreadPoolExecutor(min(OPEN_FILES, len(paths))) as pool:
        heads = list(pool.map(lambda p: _head(spark, p), paths))
    line = lambda head: head.split(b"\n", 1)[0].decode("utf-8", "replace").removeprefix("\ufeff").rstrip("\r")
    return {posixpath.basename(p): line(head) for p, head in zip(paths, heads)}


def rename(spark: SparkSession, src: str, dst: str) -> None:
    fs, s = _fs(spark, src)
    _, d = _fs(spark, dst)
    if not fs.rename(s, d):
        raise OSError(f"rename failed: {src} -> {dst}")


def mkdirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
