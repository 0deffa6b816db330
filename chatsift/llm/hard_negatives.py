"""Hard-negative mining over Hilbert-ordered candidate blocks with zone maps.

Candidates are written to Parquet in the order of their place on a Hilbert curve, cut into blocks of
``BLOCK`` rows. Each block has a zone map: the least and greatest value of every dimension and of the
label. Interval arithmetic over a zone map gives the least and the greatest score that an anchor can
have in the block: the sums over the dimensions of the smaller and the larger of ``a * least`` and ``a * greatest``.

An anchor's positives are its best rows of the same label. It is first compared with its own block, which gives
it a k-th score to beat, then reads the blocks that hold its label and whose greatest score reaches that. Each positive's score
opens a window of scores for negatives; an anchor reads the blocks that hold another label and whose
interval of scores meets one of its windows. Blocks that no anchor needs are not read, and within a task every
anchor skips the blocks that its bounds exclude.

Anchors and blocks meet in groups of bounded size (``cogroup`` on candidate group and anchor group), so
the work is cut evenly whatever the values: a label, or equal vectors, may hold any share of the rows.
Zone maps are sent to the tasks while they are few (``MAX_RANGE_VALUES`` numbers); beyond, every anchor
goes to every group and is held against the zone maps there.

Nulls and edges: rows without an id or a label, with a null vector or with null or non-finite components take
no part; vectors of different lengths never meet; rows are told apart by row, not by id, so copies of an
anchor may be its positives and each copy asks for itself; ties go to the smaller id; an anchor without
positives, or a window without rows, gives no output (so does a negative positive score, whose window
is empty); an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatsift.llm.common import key_runs, stage
from chatsift.llm.embedding_dedup import ranked
from chatsift.llm.vectors import (
    CHUNK, HIGH, LOW, Best, best_of_rows, collected_ranges, group_rows, matrix, products, valid_vectors)

POSITIVES = 5
NEGATIVES = 5
LOWEST, HIGHEST = 80, 100  # of a hundred parts of the positive's score
BLOCK = 256
CURVE_BITS = 60
CURVE_DIMS = 15
SLACK = 1e-9  # relative rounding of the bounds


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (whole numbers below ``2**bits``), by
    Skilling's transformation of the axes."""
    x, d = cells.astype(np.int64).copy(), cells.shape[1]
    for b in range(bits - 1, 0, -1):
        mask = (1 << b) - 1
        for i in range(d):
            swap = np.where((x[:, i] >> b) & 1, 0, (x[:, 0] ^ x[:, i]) & mask)
            flip = np.where((x[:, i] >> b) & 1, mask, 0)
            x[:, i] ^= swap
            x[:, 0] ^= swap | flip
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, d - 1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn[:, None]
    index = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | ((x[:, i] >> b) & 1)
    return index


def _on_curve(batches):
    """Adds ``key``: the place on the curve of some evenly spaced dimensions, scaled by the vector's
    root mean square."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.take(pa.array(np.flatnonzero(dims == dim)))
            key = np.zeros(part.num_rows, dtype=np.int64)
            if dim:
                m = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                d = min(CURVE_DIMS, int(dim))
                bits = min(16, CURVE_BITS // d)
                m = m / np.maximum(np.abs(m).max(axis=1), 1e-300)[:, None]
                m = m / np.maximum(np.sqrt((m * m).mean(axis=1)), 1e-300)[:, None]
                at = np.linspace(0, dim - 1, d).astype(np.int64)
                cells = np.clip((m[:, at] + 3) / 6 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                key = hilbert_index(cells, bits)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key)], names=[*part.schema.names, "key"])


def score_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each query in each block of these zone maps, rounded outward."""
    up, down = np.maximum(q, 0.0), np.minimum(q, 0.0)
    room = SLACK * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T + 1)
    return up @ low.T + down @ high.T - room, up @ high.T + down @ low.T + room


def _zones(k: int):
    """Per block its zone map (one row, no anchor), and its anchors with the k-th score among the
    block's rows of their label."""

    def run(batches):
        names = ["dim", "block", "low", "high", "label_low", "label_high", "row", "floor"]
        for t in key_runs(batches, ["dim", "block"], 1):
            dims, blocks = t.column("dim").to_numpy(), t.column("block").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(dims) != 0) | (np.diff(blocks) != 0)) + 1, [len(dims)]))
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
                own, dim = t.slice(lo, hi - lo), int(dims[lo])
                label, row = own.column("label").to_numpy(), own.column("row").to_numpy()
                m = matrix(own.column("vec"), dim)
                low, high = (m.min(axis=0).tolist(), m.max(axis=0).tolist()) if m.dtype != object and dim else ([], [])
                asks = np.flatnonzero(own.column("asks").to_numpy(zero_copy_only=False))
                best = Best(len(asks), k)
                if len(asks):
                    scores = products(m[asks], m)
                    i, j = best_of_rows(scores, (label[asks][:, None] == label[None, :]) & (asks[:, None] != np.arange(len(m))), k)
                    best.add(i, scores[i, j], j, j)
                n = len(asks) + 1  # the zone map, then the anchors
                empty = [[]] * (n - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, blocks[lo])),
                     pa.array([low, *empty], pa.list_(pa.float64())), pa.array([high, *empty], pa.list_(pa.float64())),
                     pa.array(np.full(n, label.min())), pa.array(np.full(n, label.max())),
                     pa.array([None, *row[asks].tolist()], pa.int64()), pa.array([None, *best.floor.tolist()], pa.int64())],
                    names=names)

    return run


def _may_hold(bounds, floor, windows, same_label, other_label):
    """Which blocks an anchor must read: for positives (``floor``) or for negatives (``windows`` of lowest and
    highest score, NaN where there is none)."""
    least, greatest = bounds
    if windows is None:
        return (greatest >= np.where(floor <= float(LOW + 1), -np.inf, floor)[:, None]) & same_label
    near = np.zeros(least.shape, dtype=bool)
    for w in range(windows.shape[1]):
        near |= (greatest >= windows[:, w, 0, None]) & (least <= windows[:, w, 1, None])
    return near & other_label


def window_of(score: int, lowest: int, highest: int) -> tuple[int, int]:
    """The least and greatest whole score between these parts of a hundred of ``score``."""
    return max(LOW + 1, -((-lowest * score) // 100)), min(HIGH, highest * score // 100)


def _windows(positives: pa.ChunkedArray, lowest: int, highest: int, k: int) -> np.ndarray:
    """(anchors, k, 2) score windows of each anchor's positives; an empty window where there is none."""
    out = np.empty((len(positives), k, 2), dtype=np.int64)
    out[:, :, 0], out[:, :, 1] = HIGH, LOW
    for i, own in enumerate(positives.to_pylist()):
        for w, p in enumerate(own or ()):
            out[i, w] = window_of(p["score"], lowest, highest)
    return out


def _asked(t, lowest: int, highest: int, k: int):
    """Floors of anchors that look for positives, or windows of those that look for negatives."""
    if "positives" in t.schema.names:
        return None, _windows(t.column("positives"), lowest, highest, k)
    return t.column("floor").to_numpy(), None


def _groups_of(zones: dict, group_blocks: int, lowest: int, highest: int, k: int):
    """Adds ``groups``: the candidate groups that hold a block the anchor must read."""

    def run(batches):
        for batch in batches:
            dims, label = batch.column("dim").to_numpy(), batch.column("label").to_numpy()
            floor, windows = _asked(batch, lowest, highest, k)
            out = [None] * batch.num_rows
            for d in np.unique(dims):
                z = zones[int(d)]
                group = z["block"] // group_blocks
                for rows in np.array_split(np.flatnonzero(dims == d), -(-int((dims == d).sum()) // 256)):
                    m = matrix(batch.column("vec").take(pa.array(rows)), int(d))
                    own = label[rows][:, None]
                    same = (z["label_low"][None, :] <= own) & (own <= z["label_high"][None, :])
                    other = (z["label_low"] != z["label_high"])[None, :] | (z["label_low"][None, :] != own)
                    if m.dtype == object or z["low"] is None:
                        near = other if windows is not None else same
                    else:
                        near = _may_hold(score_bounds(m, z["low"], z["high"]), None if floor is None else floor[rows].astype(np.float64),
                                         None if windows is None else windows[rows], same, other)
                    for i, r in enumerate(rows.tolist()):
                        out[r] = np.unique(group[near[i]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))],
                                             names=[*batch.schema.names, "groups"])

    return run


def _search(k: int, negatives: int, lowest: int, highest: int):
    def run(key, asks: pa.Table, cands: pa.Table) -> pa.Table:
        dim = int(key[0].as_py())
        row, id_, label = (asks.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        floor, windows = _asked(asks, lowest, highest, k)
        q = matrix(asks.column("vec"), dim)
        lists = 1 if windows is None else k
        best = Best(len(q) * lists, k if windows is None else negatives)
        blocks = cands.column("block").to_numpy()
        for block in np.unique(blocks) if len(q) else ():
            part = cands.take(pa.array(np.flatnonzero(blocks == block)))
            part = part.take(pa.array(np.lexsort((part.column("row").to_numpy(), part.column("vec_id").to_numpy()))))
            x_row, x_id, x_label = (part.column(c).to_numpy() for c in ("row", "vec_id", "label"))
            x = matrix(part.column("vec"), dim)
            step = max(1, CHUNK // len(x))
            for at in range(0, len(q), step):
                own = np.arange(at, min(len(q), at + step))
                if q.dtype != object and x.dtype != object and dim:
                    reach = None if floor is None else np.maximum(floor, best.floor)[own].astype(np.float64)
                    wide = None
                    if windows is not None:  # below the scores found already a window is closed
                        wide = windows[own].copy()
                        wide[:, :, 0] = np.maximum(wide[:, :, 0], best.floor.reshape(len(q), lists)[own])
                    near = _may_hold(score_bounds(q[own], x.min(axis=0)[None, :], x.max(axis=0)[None, :]), reach, wide,
                                     np.isin(label[own], x_label)[:, None], np.ones((len(own), 1), dtype=bool))
                    own = own[near[:, 0]]
                if not len(own):
                    continue
                scores = products(q[own], x)
                alike = label[own][:, None] == x_label[None, :]
                if windows is None:
                    i, j = best_of_rows(scores, alike & (row[own][:, None] != x_row[None, :]), k)
                    best.add(own[i], scores[i, j], x_id[j], x_row[j])
                    continue
                for w in range(lists):
                    low, high = windows[own, w, 0, None], windows[own, w, 1, None]
                    i, j = best_of_rows(scores, ~alike & (scores >= low) & (scores <= high), negatives)
                    best.add(own[i] * lists + w, scores[i, j], x_id[j], x_row[j])
        of = best.of // lists
        return pa.table([row[of], id_[of], best.of % lists, best.id, best.row, best.score],
                        names=["anchor_row", "anchor_id", "list", "vec_id", "row", "score"])

    return run


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label",
         n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where ``is_anchor``
    (over ``vec_id``) holds and each of its ``n_positives`` best rows of its label, the ``n_negatives`` best rows
    of another label with a score from ``lowest`` to ``highest`` hundredths of the positive's."""
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = valid_vectors(vectors, id_col, vec_col, label.cast("long").alias("label")).where("label is not null").withColumn(
        "asks", F.coalesce(is_anchor, F.lit(False)))
    kind = rows.schema["vec"].dataType.simpleString()
    placed = ranked(rows.mapInArrow(_on_curve, f"vec_id long, vec {kind}, label long, dim int, asks boolean, key long"),
                    ["dim", "key", "vec_id"], "candidate-blocks").withColumn(
        "block", F.floor(F.col("rank") / BLOCK).cast("long")).withColumnRenamed("rank", "row")
    seen = stage(placed.repartition("dim", "block").sortWithinPartitions("dim", "block").select(
        "dim", "block", "row", "vec", "label", "asks").mapInArrow(
        _zones(n_positives), "dim int, block long, low array<double>, high array<double>, label_low long, label_high long, "
        "row long, floor long"), "zone-maps")
    zones = collected_ranges(seen.where("row is null").select("dim", "block", "low", "high", "label_low", "label_high"))
    n, n_asks, dim = placed.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.max("dim")).first()
    size = group_rows(n, n_asks, dim or 0, spark.sparkContext.defaultParallelism)
    group_blocks, many = -(-size // BLOCK), max(1, -(-n_asks // size))
    meets, own = ["dim", "group", "part"], ["dim", "row", "vec_id", "vec", "label"]

    def search(asks: DataFrame, state: str, state_kind: str, name: str) -> DataFrame:
        if zones is None:
            last = n // BLOCK // group_blocks
            wanted = asks.withColumn("groups", F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))
        else:
            wanted = asks.mapInArrow(_groups_of(zones, group_blocks, lowest, highest, n_positives),
                                     f"dim int, row long, vec_id long, vec {kind}, label long, {state} {state_kind}, groups array<long>")
        wanted = stage(wanted.select(*own, state, F.pmod(F.xxhash64("row"), F.lit(many)).alias("part"),
                                     F.explode("groups").alias("group")), name)
        cands = placed.withColumn("group", F.floor(F.col("block") / group_blocks).cast("long")).select(
            *own, "group", "block").join(wanted.select(*[F.col(c).alias(c) for c in meets]).distinct(), ["dim", "group"])
        return wanted.groupBy(*meets).cogroup(cands.groupBy(*meets)).applyInArrow(
            _search(n_positives, n_negatives, lowest, highest),
            "anchor_row long, anchor_id long, list long, vec_id long, row long, score long")

    anchors = placed.where("asks").select(*own)
    floors = seen.where("row is not null").select("row", "floor")
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "vec_id", "row")
    found = search(anchors.join(floors, "row").select(*own, "floor"), "floor", "long", "anchors")
    positives = stage(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives).groupBy(
        "anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id"))).alias("positives")), "positives")
    asks = anchors.join(positives, anchors["row"] == positives["anchor_row"]).select(*own, "positives")
    found = search(asks, "positives", positives.schema["positives"].dataType.simpleString(), "anchor-windows")
    order = Window.partitionBy("anchor_row", "list").orderBy(F.desc("score"), "vec_id", "row")
    ranks = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    own_list = F.get("positives", F.col("list").cast("int"))
    return ranks.join(positives, "anchor_row").select(
        "anchor_id", own_list["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        own_list["score"].alias("positive_score"), F.col("score").alias("negative_score"))
