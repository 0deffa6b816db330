"""Repeated-passage removal: merged suffix orders by interleave refinement.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere is removed. Suffix orders
of separate shards are merged without re-sorting suffixes: the interleave of all shards' suffixes is
refined from right to left, each step stably reordering it by the byte in front of each suffix (the
shards' Burrows-Wheeler columns) while common-prefix lengths of neighbours are carried along; a
string is repeated where a neighbour's common prefix reaches ``LENGTH``.

Refining whole texts costs one pass over all bytes per byte of depth. Here a shard is a stretch of
text around an anchor, and the interleave of a group of stretches with the same anchor needs one pass
per column. The anchor of a ``LENGTH``-byte string is its leftmost ``GRAM``-byte piece of least hash,
so equal strings have equal anchors at equal offsets, each string belongs to exactly one stretch,
and comparing the stretches of a group column by column compares each string with all its equals.

1. Tasks find the anchors of their texts; a stretch is named by its anchor and a 128-bit digest.
2. Stretches that occur at least twice are repeated from end to end: grouped counts, with partial
   sums, settle all exact copies whatever their number.
3. Single stretches whose anchor occurs in other stretches are cut from the texts, and their
   interleave is refined group by group.
4. A group of more than ``GROUP_LIMIT`` stretches is cut finer first: by offset ranges of 32, then 4,
   then 1 bytes, each under the bytes that all strings of the range share, again counted by digest.
   A range of one byte is the string itself, so counting settles whatever is left: no group is ever
   capped, and none is collected beyond the limit.

Nulls and edges: null is empty; texts shorter than ``LENGTH`` bytes keep everything; null ids and
repeated rows are texts of their own (a repeated row repeats all its strings); an empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsift.llm.common import arrow_slices, key_runs, stage, texts_of

LENGTH = 400
GRAM = 128
CHUNK = 1 << 20
GROUP_LIMIT = 200
PIECES = (32, 4, 1)
BROADCAST_ITEMS = 500_000  # lists of at most so many items in all are broadcast, joined by a shuffle beyond

_RNG = np.random.default_rng(42)
_BYTE = _RNG.integers(0, 2**64, size=256, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, size=8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_AT = np.uint64((1 << 22) - 1)


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from each position."""
    h, size, level = _BYTE[buf], 1, 0
    while size < gram:
        h = h[:-size] * _MUL[level] + h[size:]
        size, level = 2 * size, level + 1
    h = (h ^ (h >> np.uint64(33))) * _MUL[7]
    return h ^ (h >> np.uint64(29))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size:]) if width > size else x


def stretches(buf: np.ndarray, last_start: np.ndarray, length: int, gram: int):
    """(anchor, first, last, hash) of the stretches in a buffer of texts: runs of string starts with
    one anchor. ``last_start``: for each position the last start in its text (below it: none)."""
    none = np.zeros(0, dtype=np.int64)
    if len(buf) < length:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(buf, gram)
    low = _window_min((h & ~_AT) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    anchor = (low & _AT).astype(np.int64)
    start = np.flatnonzero(np.arange(len(anchor)) <= last_start[: len(anchor)])
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    a = anchor[start]
    new = np.flatnonzero((np.diff(a) != 0) | (np.diff(start) != 1) | (np.diff(last_start[start]) != 0)) + 1
    begin = np.concatenate(([0], new))
    end = np.concatenate((new, [len(start)])) - 1
    return a[begin], start[begin], start[end], h[a[begin]]


def _pieces_of(texts: list[bytes], length: int):
    """Texts packed into buffers of about ``CHUNK`` bytes, longer ones cut with an overlap:
    (buffer, owner texts, offset of the buffer's part in its text, where each part begins)."""
    parts, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for off in range(0, len(t) - length + 1, CHUNK):
            part = t[off : off + CHUNK + length - 1]
            if size and size + len(part) > CHUNK + length:
                yield parts
                parts, size = [], 0
            parts.append((i, off, part))
            size += len(part)
    if parts:
        yield parts


def _anchors(length: int, gram: int):
    def run(batches):
        for batch in arrow_slices(batches, "text", 8_000_000):
            texts = texts_of(batch, "text")
            cols = {c: [] for c in ("row", "a", "lo", "hi", "h", "c1", "c2")}
            for parts in _pieces_of(texts, length):
                raw = b"".join(p[2] for p in parts)
                sizes = np.array([len(p[2]) for p in parts])
                begins = np.cumsum(sizes) - sizes
                own = np.repeat(np.arange(len(parts)), sizes)
                a, lo, hi, h = stretches(np.frombuffer(raw, dtype=np.uint8), (begins + sizes - length)[own], length, gram)
                part = own[lo]
                shift = np.array([p[1] for p in parts])[part] - begins[part]
                digest = b"".join(xxhash.xxh3_128_digest(raw[i : j + length]) for i, j in zip(lo.tolist(), hi.tolist()))
                both = np.frombuffer(digest, dtype=">i8").astype(np.int64).reshape(-1, 2)
                for c, x in zip(cols, (np.array([p[0] for p in parts])[part], a + shift, lo + shift, hi + shift,
                                       h.view(np.int64), both[:, 0], both[:, 1])):
                    cols[c].append(x)
            if not cols["row"]:
                continue
            at = {c: np.concatenate(x) for c, x in cols.items()}
            rows = pa.array(at.pop("row"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("d").take(rows), batch.column("x").take(rows), *(pa.array(at[c]) for c in at)],
                names=["d", "x", *at])

    return run


def _cut(length: int):
    """The bytes of the listed stretches of each text."""

    def run(batches):
        for batch in arrow_slices(batches, "text", 4_000_000):
            texts, lists = texts_of(batch, "text"), batch.column(batch.schema.get_field_index("parts"))
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
            lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
            cut = [texts[o][i : j + length] for o, i, j in zip(owner.tolist(), lo.tolist(), hi.tolist())]
            names = ["h", "a", "lo", "hi", "n"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("d").take(pa.array(owner)), batch.column("x").take(pa.array(owner)),
                 *(flat.field(c) for c in names), pa.array(cut, pa.binary())], names=["d", "x", *names, "bytes"])

    return run


def _finer(length: int, size: int):
    """Stretches cut by offset ranges of ``size``: a range's name is the bytes all its strings share."""

    def run(batches):
        for batch in arrow_slices(batches, "bytes", 2_000_000):
            h, a, lo, hi, n = (batch.column(c).to_pylist() for c in ("h", "a", "lo", "hi", "n"))
            rows, out = [], {c: [] for c in ("lo", "hi", "h", "c1", "c2")}
            for i, text in enumerate(texts_of(batch, "bytes")):
                first, last = (a[i] - hi[i]) // size, (a[i] - lo[i]) // size
                for p in range(first, last + 1):
                    s1, s2 = max(lo[i], a[i] - p * size - size + 1), min(hi[i], a[i] - p * size)
                    core = text[a[i] - p * size - lo[i] : a[i] - p * size - size + 1 + length - lo[i]]
                    name = xxhash.xxh3_64_intdigest(b"%d %d " % (h[i], p) + core) - (1 << 63)
                    c = xxhash.xxh3_128_intdigest(text[s1 - lo[i] : s2 + length - lo[i]])
                    rows.append(i)
                    for k, v in zip(out, (s1, s2, name, (c >> 64) - (1 << 63), (c & (2**64 - 1)) - (1 << 63))):
                        out[k].append(v)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("d", "x", "a", "n", "bytes")), batch.column("lo").take(at),
                 *(pa.array(v, pa.int64()) for v in out.values())],
                names=["d", "x", "a", "n", "bytes", "from", *out])

    return run


def refine(group: np.ndarray, rows: list[bytes], left: np.ndarray, length: int) -> np.ndarray:
    """For stretches aligned at their anchors, which string starts are repeated in their group.

    ``group``: group of each stretch, ascending; ``left``: bytes before the anchor. Returns a matrix
    (stretch x offset before the anchor, at most ``length``) of repeated starts."""
    n, most = len(rows), int(left.max())
    right = np.array([len(r) for r in rows]) - left
    width = most + int(right.max())
    text = np.full((n, width), 256, dtype=np.int16)  # 256: outside the stretch, equal to nothing
    for i, r in enumerate(rows):
        text[i, most - left[i] : most - left[i] + len(r)] = np.frombuffer(r, dtype=np.uint8)
    text = np.ascontiguousarray(text.T)
    order = np.arange(n)  # the interleave: at first as the shards came
    joint = np.concatenate(([False], group[1:] == group[:-1]))  # groups stay where they are
    common = np.zeros(n, dtype=np.int32)  # common prefix with the one before, from the current column on
    found = np.zeros((n, most + 1), dtype=bool)
    for col in range(width - 1, -1, -1):
        b = text[col][order]
        same = joint.copy()
        same[1:] &= b[1:] == b[:-1]
        mixed = joint & ~same
        if mixed.any():
            # only groups with different bytes in this column are reordered
            odd = np.zeros(int(group[-1]) + 1, dtype=bool)
            odd[group[mixed]] = True
            at = np.flatnonzero(odd[group])
            key = group[at].astype(np.int64) * 512 + b[at]
            move = np.argsort(key, kind="stable")
            old = at[move]  # the new neighbours' places before this step
            key = key[move]
            held = np.zeros(len(at), dtype=np.int32)
            pair = np.flatnonzero(key[1:] == key[:-1]) + 1
            if len(pair):
                # least common prefix between the old places of both neighbours
                ends = np.stack([old[pair - 1] + 1, old[pair] + 1], axis=1).ravel()
                held[pair] = np.minimum.reduceat(np.append(common, 0), ends)[::2] + 1
            plain = np.ones(n, dtype=bool)
            plain[at] = False
            common[plain] = np.where(same[plain], common[plain] + 1, 0)
            common[at] = held
            order[at] = order[old]
            b[at] = b[old]
        else:
            common = np.where(same, common + 1, 0)
        common[b == 256] = 0
        if col <= most:
            hit = common >= length
            hit[:-1] |= hit[1:] & joint[1:]
            found[order[hit], most - col] = True
    return found


def _repeats(length: int):
    """Covered intervals of single stretches, from the refined interleave of their groups."""

    def run(batches):
        for t in key_runs(batches, ["h"], 2_000):
            h, a, lo, hi, n, base = (t.column(c).to_numpy() for c in ("h", "a", "lo", "hi", "n", "from"))
            raw = t.column("bytes").to_pylist()
            rows = [r[i - f : j - f + length] for r, i, j, f in zip(raw, lo.tolist(), hi.tolist(), base.tolist())]
            group = np.cumsum(np.concatenate(([0], np.diff(h) != 0)))
            found = refine(group, rows, a - lo, length)
            found[n > 1] = False  # known to be repeated from end to end
            who, back = np.nonzero(found[:, ::-1])  # string starts in ascending order
            start = a[who] - (found.shape[1] - 1 - back)
            new = np.flatnonzero((np.diff(who) != 0) | (np.diff(start) != 1)) + 1
            if not len(who):
                continue
            begin = np.concatenate(([0], new))
            end = np.concatenate((new, [len(who)])) - 1
            at = pa.array(who[begin])
            whole = t.combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [whole.column("d").combine_chunks().take(at), whole.column("x").combine_chunks().take(at),
                 pa.array(start[begin]), pa.array(start[end] + length)], names=["d", "x", "begin", "end"])

    return run


def _settle(found: DataFrame, length: int, name: str):
    """From stretches (h, c1, c2, n, ...): intervals of those that occur twice, and the members of
    groups in which single stretches remain, one row per different stretch."""
    keys = ["h", "c1", "c2"]
    own = [c for c in found.columns if c not in (*keys, "n")]
    kinds = stage(found.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(F.struct(*own)).alias("one")), f"{name}-kinds")
    twice = found.join(kinds.where("n > 1").select(*keys), keys, "left_semi").select(
        "d", "x", F.col("lo").alias("begin"), (F.col("hi") + length).alias("end"))
    groups = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).where(
        "size > 1 and least = 1").select("h", "size")
    rest = kinds.join(groups, "h").select("h", "size", F.least("n", F.lit(2)).alias("n"), "one.*")
    return twice, rest


def _with_lists(docs: DataFrame, lists: DataFrame, items: str, how: str) -> DataFrame:
    """``docs`` joined with one list per text; the lists are broadcast while all of them together are
    small (items of at most 48 bytes)."""
    few = (lists.agg(F.sum(F.size(items))).first()[0] or 0) <= BROADCAST_ITEMS
    return docs.join(F.broadcast(lists) if few else lists, ["d", "x"], how)


def repeated_intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(d, x, begin, end): covered byte intervals of texts (d, x, text); they may overlap."""
    if length <= gram:
        raise ValueError("the string is longer than the anchor")
    found = stage(docs.mapInArrow(
        _anchors(length, gram), "d long, x long, a long, lo long, hi long, h long, c1 long, c2 long").withColumn(
        "n", F.lit(1).cast("long")), "stretches")
    twice, rest = _settle(found, length, "stretch")
    out = stage(twice, "intervals")
    wanted = stage(rest.groupBy("d", "x").agg(F.collect_list(F.struct(
        "h", "a", "lo", "hi", "n", "size")).alias("parts")), "wanted")
    cut = _with_lists(docs, wanted, "parts", "inner").select("d", "x", "text", "parts").mapInArrow(
        _cut(length), "d long, x long, h long, a long, lo long, hi long, n long, bytes binary")
    members = stage(cut.withColumn("from", F.col("lo")).join(
        rest.groupBy("h").agg(F.first("size").alias("size")), "h"), "members")
    for size in (*PIECES, None):
        small = members.where(F.col("size") <= GROUP_LIMIT)
        spans = small.select("h", "a", "lo", "hi", "n", "from", "d", "x", "bytes").repartition("h").sortWithinPartitions(
            "h").mapInArrow(_repeats(length), "d long, x long, begin long, end long")
        out = out.unionByName(stage(spans, "intervals"))
        large = members.where(F.col("size") > GROUP_LIMIT)
        if size is None or large.isEmpty():
            break
        finer = stage(large.select("d", "x", "h", "a", "lo", "hi", "n", F.expr(
            f"substring(bytes, cast(lo - `from` + 1 as int), cast(hi - lo + {length} as int))").alias("bytes")).mapInArrow(
            _finer(length, size), "d long, x long, a long, n long, bytes binary, `from` long, lo long, hi long, "
            "h long, c1 long, c2 long"), "finer")
        twice, members = _settle(finer, length, "finer")
        members = stage(members, "members")
        out = out.unionByName(stage(twice, "intervals"))
    return out


def _remove(batches):
    for batch in arrow_slices(batches, "text", 8_000_000):
        spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
        removed, runs, kept = [], [], []
        for text, own in zip(texts_of(batch, "text"), spans):
            at, gone, n, parts = 0, 0, 0, []
            end = -1  # of the current run
            for s in sorted((s["begin"], s["end"]) for s in own or ()):
                if s[0] > end:
                    parts.append(text[at : s[0]])
                    n += 1
                    gone += s[1] - s[0]
                elif s[1] > end:
                    gone += s[1] - end
                end = max(end, s[1])
                at = end
            parts.append(text[at:])
            removed.append(gone)
            runs.append(n)
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts_of(batch, "text")], pa.int64()), pa.array(removed, pa.int64()),
             pa.array(runs, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
             pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary): one row per input row."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumns({
            # a text is known by its id and a digest: rows equal in both have equal results
            "d": F.xxhash64("doc_id"), "x": F.xxhash64("text")})
    spans = repeated_intervals(rows.select("d", "x", "text"), length, gram)
    lists = stage(spans.groupBy("d", "x").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "interval-lists")
    return _with_lists(rows, lists, "spans", "left").select("doc_id", "text", "spans").mapInArrow(
        _remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
