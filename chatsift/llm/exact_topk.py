"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into equal segments, at several resolutions from one segment to ``SEGMENTS``; of each
segment its mean and deviation are kept. For vectors q and x and segments of n components the squared distance is at least
the sum of ``n * ((mean q - mean x)**2 + (dev q - dev x)**2)``, and never less at a finer resolution. The score is
``(|q|**2 + |x|**2 - distance**2) / 2``, so a lower bound on the distance is an upper bound on the score.

Vectors are laid in blocks of ``BLOCK`` in the order of their coarse segment means, so a block holds alike
vectors, and each block keeps the range of its statistics. Every query is first compared with its own
block, which gives it a k-th score to beat. It then goes to the blocks whose ranges allow a score
that reaches it. There, candidates are dropped coarse to fine by their own statistics, and exact
products are computed for the survivors alone; the k-th score rises as blocks pass.

Queries and candidates meet in groups of bounded size (``cogroup`` on candidate group and query
group), so the work is cut evenly whatever the values: equal vectors in any number, or one label, or one
direction, only tie. The ranges of all blocks are sent to the tasks while they hold at most
``MAX_RANGE_VALUES`` numbers; beyond, every query goes to every group and is held against the ranges there.

Nulls and edges: rows without an id, with a null vector or with null or non-finite components take no
part; vectors of different lengths never meet (empty ones score 0 with each other); rows are told
apart by row, not by id, so a repeated id is a candidate of its copy and each copy asks for itself;
ties go to the smaller id; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatsift.llm.common import key_runs, stage
from chatsift.llm.embedding_dedup import ranked
from chatsift.llm.vectors import CHUNK, LOW, Best, best_of_rows, collected_ranges, group_rows, exact_in_doubles, matrix, products, valid_vectors

K = 5
BLOCK = 1024
SEGMENTS = 16
ORDER_SEGMENTS, ORDER_BITS = 8, 6  # of the key that orders vectors; results do not depend on it
SLACK = 1e-9  # relative rounding of the bounds


def levels(dim: int) -> list[np.ndarray]:
    """Segment borders of each resolution, coarse to fine."""
    counts, out = 1, []
    while counts <= min(SEGMENTS, dim):
        out.append(np.round(np.linspace(0, dim, counts + 1)).astype(np.int64))
        counts *= 2
    return out


def statistics(m: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Per row the means and deviations of the segments, each times the root of the segment's length:
    the inner product of two rows' statistics is then the bound on their score."""
    size = np.diff(borders).astype(np.float64)
    first = np.add.reduceat(m, borders[:-1], axis=1)
    second = np.add.reduceat(m * m, borders[:-1], axis=1)
    return np.concatenate([first / np.sqrt(size), np.sqrt(np.maximum(second - first * first / size, 0.0))], axis=1)


def _order_key(batches):
    """Adds ``key``: the coarse segment means, interleaved bit by bit."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            part = batch.take(pa.array(np.flatnonzero(dims == d)))
            key = np.zeros(part.num_rows, dtype=np.int64)
            if d:
                m = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                m = m / np.maximum(np.abs(m).max(axis=1), 1e-300)[:, None]
                borders = np.round(np.linspace(0, d, min(ORDER_SEGMENTS, d) + 1)).astype(np.int64)
                mean = np.add.reduceat(m, borders[:-1], axis=1) / np.diff(borders)
                spread = np.sqrt((m * m).mean(axis=1) / np.diff(borders).mean())[:, None]
                cell = np.clip((mean / np.maximum(spread, 1e-300) + 2) / 4 * (1 << ORDER_BITS), 0, (1 << ORDER_BITS) - 1)
                cell = cell.astype(np.int64)
                for bit in range(ORDER_BITS - 1, -1, -1):
                    for s in range(cell.shape[1]):
                        key = (key << 1) | ((cell[:, s] >> bit) & 1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key)], names=[*part.schema.names, "key"])


def _own_blocks(k: int):
    """Per block its ranges (one row, no id), and its queries with the k-th score found in the block."""

    def run(batches):
        for t in key_runs(batches, ["dim", "block"], 1):
            dims, blocks = t.column("dim").to_numpy(), t.column("block").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(dims) != 0) | (np.diff(blocks) != 0)) + 1, [len(dims)]))
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
                own, dim = t.slice(lo, hi - lo), int(dims[lo])
                own = own.take(pa.array(np.argsort(own.column("vec_id").to_numpy(), kind="stable")))
                m = matrix(own.column("vec"), dim)
                low, high = ([], [])
                if m.dtype != object and dim:
                    s = statistics(m, levels(dim)[-1])
                    low, high = s.min(axis=0).tolist(), s.max(axis=0).tolist()
                asks = np.flatnonzero(own.column("asks").to_numpy(zero_copy_only=False))
                best = Best(len(asks), k)
                for at in range(0, len(asks), max(1, CHUNK // len(m))):
                    q = asks[at : at + max(1, CHUNK // len(m))]
                    scores = products(m[q], m)
                    i, j = best_of_rows(scores, q[:, None] != np.arange(len(m))[None, :], k)
                    best.add(i + at, scores[i, j], j, j)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([blocks[lo]], pa.int64()), pa.array([low], pa.list_(pa.float64())),
                     pa.array([high], pa.list_(pa.float64())), *(pa.nulls(1, pa.int64()) for _ in range(2))],
                    names=["dim", "block", "low", "high", "row", "floor"])
                n = len(asks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, blocks[lo]), pa.int64()),
                     *(pa.nulls(n, pa.list_(pa.float64())) for _ in range(2)),
                     own.column("row").combine_chunks().take(pa.array(asks)), pa.array(best.floor)],
                    names=["dim", "block", "low", "high", "row", "floor"])

    return run


def reachable(stats: np.ndarray, floor: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a block of these ranges may hold a score of at least ``floor``, per query and block."""
    half = stats.shape[1] // 2
    bound = np.zeros((len(stats), len(low)))
    for s in range(half):  # means of either sign; deviations are never negative
        bound += np.maximum(stats[:, s, None] * low[None, :, s], stats[:, s, None] * high[None, :, s])
    bound += stats[:, half:] @ high[:, half:].T
    scale = np.abs(stats) @ np.maximum(np.abs(low), np.abs(high)).T
    floor = np.where(floor <= float(LOW + 1), -np.inf, floor)  # the end of the range stands for all below
    return bound + SLACK * (scale + 1) >= floor[:, None]


def _groups_of(ranges: dict | None, group_blocks: int):
    """Adds ``groups``: the candidate groups that hold a block within the query's reach."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            floor = batch.column("floor").to_numpy().astype(np.float64)
            out = [None] * batch.num_rows
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                blocks, low, high = (ranges[int(d)][c] for c in ("block", "low", "high"))
                group = blocks // group_blocks
                m = matrix(batch.column("vec").take(pa.array(rows)), int(d))
                if m.dtype == object or low is None:
                    near = np.ones((len(rows), len(blocks)), dtype=bool)
                else:
                    near = np.concatenate([reachable(statistics(m[at : at + 256], levels(int(d))[-1]), floor[rows[at : at + 256]], low, high)
                                           for at in range(0, len(rows), 256)])
                for i, r in enumerate(rows.tolist()):
                    out[r] = np.unique(group[near[i]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))],
                                             names=[*batch.schema.names, "groups"])

    return run


def survivors(q: list[np.ndarray], x: list[np.ndarray], floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries and candidates with a pair left after all resolutions, and which of their pairs are."""
    rows, cols = np.arange(len(q[0])), np.arange(len(x[0]))
    alive = np.ones((len(rows), len(cols)), dtype=bool)
    for stats_q, stats_x in zip(q, x):
        bound = stats_q[rows] @ stats_x[cols].T
        size = np.sqrt((stats_q[rows] ** 2).sum(axis=1))[:, None] * np.sqrt((stats_x[cols] ** 2).sum(axis=1))[None, :]
        alive &= bound + SLACK * (size + 1) >= floor[rows, None]
        r, c = alive.any(axis=1), alive.any(axis=0)
        rows, cols, alive = rows[r], cols[c], alive[np.ix_(r, c)]
        if not alive.size:
            break
    return rows, cols, alive


def _search(k: int):
    def run(key, asks: pa.Table, cands: pa.Table) -> pa.Table:
        dim = int(key[0].as_py())
        query_row, query_id = (asks.column(c).to_numpy() for c in ("row", "vec_id"))
        q, best = matrix(asks.column("vec"), dim), Best(asks.num_rows, k)
        floor = asks.column("floor").to_numpy()
        borders = levels(dim)
        blocks = cands.column("block").to_numpy()
        for block in np.unique(blocks) if asks.num_rows else ():
            part = cands.take(pa.array(np.flatnonzero(blocks == block)))
            part = part.take(pa.array(np.lexsort((part.column("row").to_numpy(), part.column("vec_id").to_numpy()))))
            row, id_ = part.column("row").to_numpy(), part.column("vec_id").to_numpy()
            x = matrix(part.column("vec"), dim)
            exact = exact_in_doubles(q, x)
            stats_x = [statistics(x, b) for b in borders] if exact else []
            step = max(1, CHUNK // len(x))
            for at in range(0, len(q), step):
                own = q[at : at + step]
                if exact and borders:
                    rows, cols, alive = survivors([statistics(own, b) for b in borders], stats_x,
                                                  np.maximum(floor, best.floor)[at : at + step])
                else:
                    rows, cols, alive = np.arange(len(own)), np.arange(len(x)), np.ones((len(own), len(x)), dtype=bool)
                if not alive.size:
                    continue
                scores = products(own[rows], x[cols])
                alive &= query_row[at + rows][:, None] != row[cols][None, :]
                i, j = best_of_rows(scores, alive, k)
                best.add(at + rows[i], scores[i, j], id_[cols[j]], row[cols[j]])
        return pa.table([query_row[best.of], query_id[best.of], best.id, best.row, best.score],
                        names=["query_row", "query_id", "vec_id", "row", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores among all other rows for each row where
    ``is_query`` (over ``vec_id``) holds."""
    spark = vectors.sparkSession
    rows = valid_vectors(vectors, id_col, vec_col).withColumn("asks", F.coalesce(is_query, F.lit(False)))
    kind = rows.schema["vec"].dataType.simpleString()
    keyed = rows.mapInArrow(_order_key, f"vec_id long, vec {kind}, dim int, asks boolean, key long")
    placed = ranked(keyed, ["dim", "key", "vec_id"], "vectors-in-order").withColumn(
        "block", F.floor(F.col("rank") / BLOCK).cast("long")).withColumnRenamed("rank", "row")
    seen = stage(placed.repartition("dim", "block").sortWithinPartitions("dim", "block").select(
        "dim", "block", "row", "vec_id", "vec", "asks").mapInArrow(
        _own_blocks(k), "dim int, block long, low array<double>, high array<double>, row long, floor long"), "own-blocks")
    ranges = collected_ranges(seen.where("row is null").select("dim", "block", "low", "high"))
    n, n_asks, dim = placed.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.max("dim")).first()
    size = group_rows(n, n_asks, dim or 0, spark.sparkContext.defaultParallelism)
    group_blocks = -(-size // BLOCK)
    floors = seen.where("row is not null").select("row", "floor")
    asks = placed.where("asks").join(floors, "row").select("dim", "row", "vec_id", "vec", "floor")
    if ranges is None:
        last = (n // BLOCK) // group_blocks
        wanted = asks.withColumn("groups", F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))
    else:
        wanted = asks.mapInArrow(_groups_of(ranges, group_blocks),
                                 f"dim int, row long, vec_id long, vec {kind}, floor long, groups array<long>")
    many = max(1, -(-n_asks // size))
    part = F.pmod(F.xxhash64("row"), F.lit(many)).alias("part")
    meets = ["dim", "group", "part"]
    wanted = stage(wanted.select("dim", "row", "vec_id", "vec", "floor", part, F.explode("groups").alias("group")), "asked-groups")
    pairs = wanted.select(*[F.col(c).alias(c) for c in meets]).distinct()
    cands = placed.withColumn("group", F.floor(F.col("block") / group_blocks).cast("long")).select(
        "dim", "group", "block", "row", "vec_id", "vec").join(pairs, ["dim", "group"])
    found = wanted.groupBy(*meets).cogroup(cands.groupBy(*meets)).applyInArrow(
        _search(k), "query_row long, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
