"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes. Fingerprints within ``max_distance = 3`` bits differ in at most
three bytes, so they share at least five positional bytes: the guaranteed minimum. Postings are kept
per set of four byte positions; the 14 sets ``{a, b, c, d}`` with ``a ^ b ^ c ^ d = 0`` meet every
five shared positions (each three differing positions lie outside at least one set), so every pair
that reaches the minimum meets in some posting list, and unrelated pairs almost never do. In a list
the shared positional bytes of each pair are tallied, pairs below the minimum are dropped, and the
rest is verified by Hamming distance. Lists longer than ``list_limit`` are cut finer, exactly: their
members agree outside some remaining bits and differ in at most three of those, so of four parts of
the remaining bits at least one agrees. After three cuts at most 14 bits remain, which bounds a list
by 2**14 distinct fingerprints whatever the input.

Nulls and edges: null or empty text has fingerprint zero and links like any other; a null id gets a
fingerprint but no component and no links; every repeated row gets its own output row; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsift.llm.common import arrow_slices, key_runs, local_roots, stage, texts_of
from chatsift.llm.components import components

SHINGLE = 3
MAX_DISTANCE = 3
MIN_SHARED_BYTES = 5
LIST_LIMIT = 256
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of ``text`` (bytes of lower-cased A-Z)."""
    words = text.lower().split()  # bytes: lowers A-Z only, splits on \x20 \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):  # a slice of hashes at a time: 64 counters, whatever the length
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, ``keep`` columns): one row per input row, ``fp`` the fingerprint as a signed long."""

    def run(batches):
        for batch in arrow_slices(batches, "text", 16_000_000):
            fps = np.fromiter((fingerprint(t, shingle) for t in texts_of(batch, "text")), dtype=np.uint64,
                              count=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *keep])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    return cols.mapInArrow(run, ", ".join(["doc_id long, fp long", *(
        f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[2:])]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _byte_sets() -> list[int]:
    """Masks of the 14 sets of four byte positions."""
    return [_signed(sum(0xFF << (8 * p) for p in s)) for s in combinations(range(8), 4)
            if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


def _finer(mask: int) -> list[int]:
    """The mask plus each of four parts of the bits it leaves out."""
    rest = [b for b in range(64) if not (mask >> b) & 1]
    cuts = [round(len(rest) * i / 4) for i in range(5)]
    return [_signed((mask & (2**64 - 1)) | sum(1 << b for b in rest[i:j])) for i, j in zip(cuts, cuts[1:])]


def _list_links(max_distance: int, min_shared: int):
    """Links inside posting lists: tally shared positional bytes, keep the minimum, verify."""

    def run(batches):
        for t in key_runs(batches, ["mask", "key"]):
            rep, fp = t.column("rep").to_numpy(), t.column("fp").to_numpy()
            mask, key = t.column("mask").to_numpy(), t.column("key").to_numpy()
            first, second = [], []
            left = np.arange(len(fp))
            for step in range(1, len(fp)):  # at most the longest list's length
                left = left[left + step < len(fp)]
                left = left[(key[left] == key[left + step]) & (mask[left] == mask[left + step])]
                if not len(left):
                    break
                diff = np.bitwise_xor(fp[left], fp[left + step])
                shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
                ok = shared >= min_shared
                ok[ok] = np.bitwise_count(diff[ok].view(np.uint64)) <= max_distance
                first.append(left[ok])
                second.append(left[ok] + step)
            if not first:
                continue
            i, j = np.concatenate(first), np.concatenate(second)
            names, at = np.unique(rep, return_inverse=True)
            root = local_roots(len(names), at[i], at[j])  # a spanning star per group instead of all pairs
            hung = np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[hung]), pa.array(names[root[hung]])], names=["a", "b"])

    return run


def fingerprint_links(distinct: DataFrame, max_distance: int = MAX_DISTANCE,
                      list_limit: int = LIST_LIMIT) -> DataFrame:
    """(a, b) links that span every group of distinct fingerprints within ``max_distance`` bits.

    ``distinct`` has one row (rep, fp) per fingerprint. Links between members of a list are given as
    stars around the smallest member of each group found there, so the table stays linear in the
    postings while its connected components are those of all verified pairs."""
    if not 0 <= max_distance <= 3:
        raise ValueError("the byte sets guarantee distances of 0 to 3 bits")
    spark = distinct.sparkSession
    masks = F.array(*[F.lit(m).cast("long") for m in _byte_sets()])
    lists = distinct.select("rep", "fp", F.explode(masks).alias("mask"))
    found = None
    rest = 32
    while True:
        keyed = lists.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        kept = stage(keyed.join(sizes, ["mask", "key"]), "postings")
        last = rest <= 14
        small = kept if last else kept.where(F.col("n") <= list_limit)
        links = small.select("mask", "key", "rep", "fp").repartition("mask", "key").sortWithinPartitions(
            "mask", "key", "fp").mapInArrow(_list_links(max_distance, MIN_SHARED_BYTES), "a long, b long")
        found = links if found is None else found.unionByName(links)
        long_lists = kept.where(F.col("n") > list_limit)
        if last or long_lists.isEmpty():
            return found
        used = [r[0] for r in long_lists.select("mask").distinct().collect()]  # at most 14 * 4**level masks
        finer = spark.createDataFrame([(m, f) for m in used for f in _finer(m)], "mask long, finer long")
        lists = long_lists.join(F.broadcast(finer), "mask").select("rep", "fp", F.col("finer").alias("mask")).distinct()
        rest -= {32: 8, 24: 6, 18: 4}[rest]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_distance: int = MAX_DISTANCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, ``keep`` columns) per input row: ``component_id`` is the smallest id
    reachable over links of at most ``max_distance`` bits, the row's own included."""
    fps = stage(fingerprints(docs, id_col, text_col, shingle, keep), "fingerprints")
    distinct = stage(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fps")
    nodes = components(fingerprint_links(distinct, max_distance))
    named = distinct.join(nodes, distinct.rep == nodes.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), *keep)


def fingerprint_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
