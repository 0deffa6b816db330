"""Embedding near-duplicates by sorted projection passes.

In each pass every vector gets a code, the signs of ``BITS`` random projections concatenated, and the vectors are
ordered lexicographically by their codes (ties by a hash of the pass). A vector is compared with its
neighbours in that order: the order is cut into stretches of ``STRETCH`` vectors, and each stretch is compared with itself
and the next, so every vector meets at least its ``STRETCH`` neighbours on either side. Verified pairs (cosine at
least the threshold, in double precision) of all passes are united.

A bounded window alone would lose pairs wherever more vectors lie close together than it holds. So
each pass also finds the runs of the order whose codes agree in their first ``bits`` signs and that are longer than a
stretch, the dense runs that saturate the windows, and compares those whole. Any two vectors that agree in
``bits`` signs of a pass are thus compared. Two vectors at the threshold angle agree in a sign with
probability ``1 - angle / pi``, whatever the other vectors are, so ``passes_at`` gives the passes that bring such a
pair together with probability ``RECALL`` also inside tight groups; the windows add to that. ``plan`` weighs
fewer signs (longer runs) against fewer passes by the runs of hashed vectors. Bits and passes decide which
pairs are met, and with it the recall, never whether a pair that was met is linked.

Equal vectors are one representative with a multiplicity, so any number of copies costs one row.
Each representative carries its code and its stretch in every pass: a pair is counted where it is met
first, which needs no table of pairs. A run of more than ``GROUP * STRETCH`` vectors is dealt into
parts, and each two parts are a task's tile of their own, so no task grows with a run; the work
grows with the square of a tight group, as its pairs do. Links between representatives leave a task
as stars of linked vectors, and connected components are computed from those.

Nulls and edges: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are kept; vectors of different lengths never link; repeated ids are vectors of their own
(a component's id is its smallest id); a null id counts as a vector but gets a null component; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsift.llm.common import key_runs, local_roots, stage
from chatsift.llm.components import components

THRESHOLD = 0.95
RECALL = 0.99
BITS = 30
STRETCH = 512
GROUP = 8
SEED = 42
PLAN_ROWS = 1 << 16  # vectors that the choice of bits looks at
PASS_PAIRS = 1000  # comparisons that cost as much as taking one vector through a pass
BROADCAST_BUCKETS = 1_000_000


def passes_at(bits: float, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Passes in which a pair at the threshold agrees in all of ``bits`` signs at least once with
    probability ``recall``."""
    meet = min(0.999, (1 - math.acos(threshold) / math.pi) ** bits)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def passes_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL, stretch: int = STRETCH) -> int:
    """Passes for ``n`` vectors that the signs spread evenly over buckets of two stretches."""
    return max(2, passes_at(max(0.0, math.log2(max(1, n) / (2 * stretch))), threshold, recall))


def plan(n: int, codes: np.ndarray, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, passes) of least work for ``n`` vectors, from the ``BITS`` signs of some of them."""
    def work(bits: int) -> float:
        sizes = np.unique(codes >> (BITS - bits), return_counts=True)[1].astype(np.float64)
        pairs = (sizes * (sizes - 1)).sum() / 2 * (n / max(1, len(codes))) ** 2
        return passes_at(bits, threshold) * (pairs + PASS_PAIRS * n)

    bits = min(range(BITS + 1), key=work)
    return bits, passes_at(bits, threshold)


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a float64 matrix."""
    return _matrix_of(col).astype(np.float64)


def _matrix_of(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _codes(n_passes: int, bits: int):
    """Adds ``codes``: the signs of each pass as one number."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, int(d)]).normal(size=(d, n_passes * bits))
                signs = (_matrix(part.column("vec")) @ planes[d] >= 0).reshape(part.num_rows, n_passes, bits)
                code = (signs * weights).sum(axis=2, dtype=np.int64)
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * n_passes)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(code.ravel()))],
                    names=[*part.schema.names, "codes"])

    return run


def ranked(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``rank``: its place in the order of ``keys``. One range-partitioned sort; the
    driver sees one count per partition."""
    spark = df.sparkSession
    at = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    start, starts = 0, []
    for p, n in at.groupBy(part.alias("p")).agg(F.count(F.lit(1))).orderBy("p").collect():
        starts.append((p, start))
        start += n
    offsets = spark.createDataFrame(starts, "p long, start long")
    return at.join(F.broadcast(offsets), part == F.col("p")).withColumn(
        "rank", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("p", "start", "at")


TILE = ["dim", "pass", "code", "i", "j"]


class _Links:
    """Links found in a task's table: counts with multiplicities, and a star per group of linked vectors."""

    def __init__(self, t: pa.Table, bits: int, threshold: float):
        self.rep, self.mult = t.column("rep").to_numpy(), t.column("mult").to_numpy()
        self.vecs, self.codes, self.blocks = (t.column(c).combine_chunks() for c in ("vec", "codes", "blocks"))
        self.shift, self.threshold = BITS - bits, threshold
        self.count = np.zeros(len(self.rep), dtype=np.int64)
        self.first, self.second = [], []

    def compare(self, rows: np.ndarray, own: int, start: int, number: int, windows: bool) -> None:
        """Compare ``rows[:own]`` with ``rows[start:]`` (with those behind them where ``start`` is 0), met in pass ``number``
        by its windows or by a run."""
        m = _matrix(self.vecs.take(pa.array(rows)))
        runs = _matrix_of(self.codes.take(pa.array(rows))) >> self.shift
        blocks = _matrix_of(self.blocks.take(pa.array(rows)))
        unit = m / np.sqrt((m * m).sum(axis=1))[:, None]
        step = max(1, (1 << 20) // max(1, len(rows) - start))
        for at in range(0, own, step):
            cos = unit[at : min(own, at + step)] @ unit[start:].T
            i, j = np.nonzero(cos >= self.threshold - 1e-9)
            near = cos[i, j]
            i, j = i + at, j + start
            if not start:
                i, j, near = i[i < j], j[i < j], near[i < j]
            for k in np.flatnonzero(np.abs(near - self.threshold) <= 1e-9):  # at the threshold: without normalising first
                a, c = m[i[k]], m[j[k]]
                near[k] = (a @ c) / math.sqrt((a @ a) * (c @ c))
            i, j = i[near >= self.threshold], j[near >= self.threshold]
            if not len(i):
                continue
            new = np.ones(len(i), dtype=bool)
            for p in range(number + (not windows)):
                new &= np.abs(blocks[i, p] - blocks[j, p]) > 1
                if p < number:
                    new &= runs[i, p] != runs[j, p]
            np.add.at(self.count, rows[i[new]], self.mult[rows[j[new]]])
            np.add.at(self.count, rows[j[new]], self.mult[rows[i[new]]])
            root = local_roots(len(rows), i, j)
            hung = np.flatnonzero(root != np.arange(len(rows)))
            self.first.append(rows[hung])
            self.second.append(rows[root[hung]])

    def batch(self) -> pa.RecordBatch | None:
        """(rep, links, root): newly counted links, and the star of each group."""
        if not self.first:
            return None
        names, at = np.unique(self.rep, return_inverse=True)
        root = local_roots(len(names), at[np.concatenate(self.first)], at[np.concatenate(self.second)])
        total = np.zeros(len(names), dtype=np.int64)
        np.add.at(total, at, self.count)
        out = np.flatnonzero((root != np.arange(len(names))) | (total > 0))
        return pa.RecordBatch.from_arrays(
            [pa.array(names[out]), pa.array(total[out]), pa.array(names[root[out]])], names=["rep", "links", "root"])


def _compare_windows(bits: int, threshold: float):
    """Per stretch: its vectors with each other and with the next stretch of the same pass."""

    def run(batches):
        for t in key_runs(batches, ["stretch"], 1):
            stretch, block, number, dim = (t.column(c).to_numpy().astype(np.int64) for c in ("stretch", "block", "pass", "dim"))
            links = _Links(t, bits, threshold)
            for s in np.unique(stretch):
                for p, d in {(int(p), int(d)) for p, d in zip(number[stretch == s], dim[stretch == s])}:
                    rows = np.flatnonzero((stretch == s) & (number == p) & (dim == d))
                    own, after = rows[block[rows] == s], rows[block[rows] != s]
                    if len(own) > 1:
                        links.compare(own, len(own), 0, p, True)
                    if len(own) and len(after):
                        links.compare(np.concatenate([own, after]), len(own), len(own), p, True)
            out = links.batch()
            if out is not None:
                yield out

    return run


def _compare_runs(bits: int, threshold: float):
    """Per tile of a run: one part with itself, or two parts."""

    def run(batches):
        for t in key_runs(batches, TILE, 1):
            keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in (*TILE, "part")])
            links = _Links(t, bits, threshold)
            cuts = np.concatenate(([0], np.flatnonzero(np.any(np.diff(keys[:-1]) != 0, axis=0)) + 1, [keys.shape[1]]))
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
                _, number, _, one, other = keys[:-1, lo]
                own = hi - lo if one == other else int(np.searchsorted(keys[-1, lo:hi], other))
                if hi - lo > 1 and own:
                    links.compare(np.arange(lo, hi), own, 0 if one == other else own, int(number), False)
            out = links.batch()
            if out is not None:
                yield out

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                    n_passes: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "vec", lambda x: x != 0)
    rows = rows.withColumn("vec", F.when(F.coalesce(fine, F.lit(False)), F.col("vec")))
    # the smallest id of equal vectors stands for them; vectors known by null ids only cannot be named
    reps = stage(rows.where("vec is not null").groupBy("vec").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult")).where("rep is not null")
        .withColumn("dim", F.size("vec")), "representatives")
    n, tile, kind = reps.count(), GROUP * STRETCH, reps.schema["vec"].dataType.simpleString()
    coded = lambda df, k, bits: df.select("rep", "mult", "dim", "vec").mapInArrow(
        _codes(k, bits), f"rep long, mult long, dim int, vec {kind}, codes array<long>")
    if n_passes:
        bits = max(b for b in range(BITS + 1) if b == 0 or passes_at(b, threshold) <= n_passes)
    else:
        drawn = reps.where(F.pmod(F.xxhash64("vec"), F.lit(max(1, n // PLAN_ROWS))) == 0)
        bits, n_passes = plan(n, np.array([r[0] for r in coded(drawn, 1, BITS).select(
            F.col("codes")[0]).collect()], dtype=np.int64), threshold)
    signs = stage(coded(reps, n_passes, BITS), "signs")
    # the order of each pass; only codes are sorted
    codes = signs.select("rep", "dim", F.posexplode("codes").alias("pass", "code"))
    order = ranked(codes.withColumn("tie", F.xxhash64("pass", "rep")), ["dim", "pass", "code", "tie"], "pass-order")
    blocks = order.select("rep", "pass", F.floor(F.col("rank") / STRETCH).cast("long").alias("block")).groupBy("rep").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pass", "block"))), lambda x: x["block"]).alias("blocks"))
    placed = stage(signs.join(blocks, "rep"), "stretches")
    carried = ["rep", "mult", "vec", "codes", "blocks"]
    near = placed.select("*", F.posexplode("blocks").alias("pass", "block")).withColumn(
        "stretch", F.explode(F.array(F.col("block"), F.col("block") - 1)))
    met = near.select("stretch", "block", "pass", "dim", *carried).repartition("stretch").sortWithinPartitions(
        "stretch").mapInArrow(_compare_windows(bits, threshold), "rep long, links long, root long")
    # the runs that are longer than a stretch
    bucket = ["dim", "pass", "code"]
    spread = placed.select("*", F.posexplode("codes").alias("pass", "whole")).withColumn(
        "code", F.shiftright("whole", BITS - bits)).drop("whole")
    large = stage(spread.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > STRETCH), "dense-runs")
    small = large.count() <= BROADCAST_BUCKETS
    dealt = spread.join(F.broadcast(large) if small else large, bucket).withColumn(
        "parts", F.ceil(F.col("n") / tile).cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(
        F.least("part", x).alias("i"), F.greatest("part", x).alias("j")))
    dense = dealt.withColumn("t", F.explode(tiles)).select(
        *bucket, "t.i", "t.j", "part", *carried).repartition(*TILE).sortWithinPartitions(
        *TILE, "part", "rep").mapInArrow(_compare_runs(bits, threshold), "rep long, links long, root long")
    found = stage(met.unionByName(dense), "links")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found, "rep", "root").withColumnRenamed("node", "rep")
    named = reps.select("vec", "rep", "mult").join(sums, "rep", "left").join(groups, "rep", "left").select(
        "vec", "rep", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, "vec", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
