"""Quantised vectors: shared helpers of the exact searches (top-k search and hard-negative mining).

A component ``x`` becomes ``floor(256 * x)`` and scores are integer inner products. Where all sums stay
below 2**53 they are computed by float64 matrix products, which are exact there; else by Python
integers, and a score beyond the range of a long counts as the end of that range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 256
LOW = np.iinfo(np.int64).min  # stands for "not allowed"; scores begin above it
HIGH = np.iinfo(np.int64).max
CHUNK = 1 << 20  # scores looked at together
GROUP_ROWS, GROUP_VALUES, GROUP_LEAST = 8192, 1 << 21, 1024  # of a group of candidates or queries
MAX_RANGE_VALUES = 1 << 22  # numbers of all blocks' ranges that are sent to the tasks


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str, *extra) -> DataFrame:
    """(vec_id long, vec, dim, extra...): rows with an id and a vector of finite components only."""
    vec = F.col(vec_col)
    floats = isinstance(vectors.select(vec_col).schema[0].dataType.elementType, T.FloatType)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          (vec if floats else vec.cast("array<double>")).alias("vec"), *extra)
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & fine).withColumn("dim", F.size("vec"))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """The quantised rows of a list column: whole numbers as float64, or as Python integers where a
    double cannot hold them all."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    m = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)
    if not m.size or np.abs(m).max() < 2.0 ** 44:
        return np.floor(m * SCALE)
    whole = lambda x: SCALE * x.as_integer_ratio()[0] // x.as_integer_ratio()[1]
    return np.array([[whole(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)


def exact_in_doubles(a: np.ndarray, b: np.ndarray) -> bool:
    if a.dtype == object or b.dtype == object:
        return False
    top = lambda x: np.abs(x).max() if x.size else 0.0
    return bool(top(a) * top(b) * max(1, a.shape[1]) < 2.0 ** 53)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b`` as longs."""
    if exact_in_doubles(a, b):
        return (a @ b.T).astype(np.int64)
    whole = lambda m: m if m.dtype == object else np.array(
        [[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    a, b = whole(a), whole(b)
    out = np.empty((len(a), len(b)), dtype=np.int64)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i, j] = min(HIGH, max(LOW + 1, sum(p * q for p, q in zip(x, y))))
    return out


def best_of_rows(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest allowed scores of each row; ties to the earlier column."""
    s = np.where(allowed, scores, LOW)
    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), LOW)
    above = s > kth[:, None]
    level = allowed & (s == kth[:, None])
    level &= level.cumsum(axis=1) <= (k - above.sum(axis=1))[:, None]
    return np.nonzero(above | level)


class Best:
    """The ``k`` best (score, id, row) of each of ``n`` lists, kept while blocks of candidates pass by."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.of = np.zeros(0, dtype=np.int64)
        self.score, self.id, self.row = self.of, self.of, self.of
        self.floor = np.full(n, LOW)  # the k-th score so far

    def add(self, of, score, id_, row) -> None:
        of, score, id_, row = (np.concatenate(x) for x in (
            (self.of, of), (self.score, score), (self.id, id_), (self.row, row)))
        order = np.lexsort((row, id_, -score, of))
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        order, of, place = (x[place < self.k] for x in (order, of, place))
        self.of, self.score, self.id, self.row = of, score[order], id_[order], row[order]
        last = place == self.k - 1
        self.floor[of[last]] = self.score[last]


def collected_ranges(ranges: DataFrame) -> dict | None:
    """Per vector length the blocks and their ranges (columns dim, block, low, high and others, which
    come back as arrays by name), or None if there are too many to send to the tasks."""
    values = ranges.agg(F.sum(F.size("low") + F.size("high") + 4)).first()[0]
    if values is not None and values > MAX_RANGE_VALUES:
        return None
    got, out = ranges.toArrow(), {}
    dims = got.column("dim").to_numpy()
    for d in np.unique(dims):
        part = got.take(pa.array(np.flatnonzero(dims == d)))
        low, high = (part.column(c).to_pylist() for c in ("low", "high"))
        whole = int(d) > 0 and all(low)
        out[int(d)] = {c: part.column(c).to_numpy() for c in part.schema.names if c not in ("dim", "low", "high")} | {
            "low": np.array(low) if whole else None, "high": np.array(high) if whole else None}
    return out


def group_rows(n: int, asks: int, dim: int, tasks: int) -> int:
    """Rows of a group: so many groups of either side that all tasks have work, within fixed bounds."""
    most = max(1, min(GROUP_ROWS, GROUP_VALUES // max(1, dim)))
    return int(min(most, max(GROUP_LEAST, math.sqrt(max(1, n) * max(1, asks) / max(1, 4 * tasks)))))
