"""Fill-in-middle transformation over an indexable skip list of each text's units.

A unit is a word with the white space before it, or the white space at the end. The units of a text
are the bottom lane of a skip list; each express lane links a part of the nodes below it, and every
link carries how many units, code points and bytes it spans. A cut rank is reached from the top lane
down: a link is taken while the units accumulated so far and its own stay within the rank, else the
walk goes down a lane. The sums of the widths on the way are the cut's place in code points and bytes,
so the text is cut exactly, in about ``log4(units)`` lanes, without decoding it or adding up its units.

Node heights come from a hash of the unit's number, so the lists need no random state. Lanes are built
in numpy from the unit ends of a slice of texts at a time, which bounds a task's memory; a text is
never split between tasks and there is no shuffle.

The draws follow from the document's id: the first four 8-digit groups of the hex sha256 of
``seed:id`` give the two cut ranks, whether the text is rearranged, and in which form.

Nulls and edges: null text is empty; an empty text, or one that holds a marker, stays plain; a null id
draws as an empty one; repeated rows give repeated results; cuts may be equal or at an end, which leaves
parts empty; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsift.llm.common import arrow_slices, texts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
FIM_PERCENT = 50  # of the texts that are rearranged
SPM_PERCENT = 80  # of those, in suffix-prefix-middle order
LANES = 24
SLICE_BYTES = 4_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def node_heights(n: int) -> np.ndarray:
    """Lanes of each of ``n`` nodes: one, and another with probability 1/4 each."""
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    low = x & (~x + np.uint64(1))  # the lowest set bit
    zeros = np.where(low == 0, 64, np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64)
    return np.minimum(1 + zeros // 2, LANES)


class UnitSkipList:
    """Lanes over the units of one text, from the running code points and bytes at each unit's end."""

    def __init__(self, chars: np.ndarray, size: np.ndarray, heights: np.ndarray):
        self.lanes = []  # (units, code points, bytes) of each link, index of its node in the lane below
        nodes = np.arange(len(chars))
        below = None
        lane = 1
        while len(nodes):
            widths = [np.diff(x, prepend=0) for x in (nodes + 1, chars[nodes], size[nodes])]
            self.lanes.append((*widths, below))
            up = np.flatnonzero(heights[nodes] > lane)
            below, nodes = up, nodes[up]
            lane += 1

    def reach(self, rank: int) -> tuple[int, int]:
        """(code points, bytes) before the unit of this rank (from 0; the number of units is the end)."""
        units = chars = size = 0
        at = 0  # links of the lane already behind
        for units_of, chars_of, bytes_of, below in reversed(self.lanes):
            while at < len(units_of) and units + units_of[at] <= rank:
                units += int(units_of[at])
                chars += int(chars_of[at])
                size += int(bytes_of[at])
                at += 1
            if below is not None and at:
                at = int(below[at - 1]) + 1
        if units != rank:
            raise IndexError(rank)
        return chars, size


def unit_ends(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the code points and bytes up to each unit's end."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    stops = np.cumsum([len(t) for t in texts], dtype=np.int64)
    space = _SPACE[data]
    end = np.zeros(len(data), dtype=bool)
    end[:-1] = ~space[:-1] & space[1:]
    end[stops[np.diff(stops, prepend=0) > 0] - 1] = True
    ends = np.flatnonzero(end) + 1
    points = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)  # a slice is far below 2**31 bytes, or one text
    out, start, done = [], 0, 0
    for stop, cut in zip(stops.tolist(), np.searchsorted(ends, stops, side="right").tolist()):
        own = ends[done:cut]
        base = int(points[start - 1]) if start else 0
        out.append((points[own - 1].astype(np.int64) - base, own - start))
        start, done = stop, cut
    return out


def rearranged(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def _transform(fim_percent: int, spm_percent: int):
    markers = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches):
        heights = node_heights(1024)
        for batch in arrow_slices(batches, "text", SLICE_BYTES):
            texts = texts_of(batch, "text")
            draws = [batch.column(f"h{i}").to_pylist() for i in range(1, 5)]
            n, forms, first, second, outputs = [], [], [], [], []
            for text, (chars, size), h1, h2, h3, h4 in zip(texts, unit_ends(texts), *draws):
                units = len(size)
                n.append(units)
                if not text or h3 % 100 >= fim_percent or any(x in text for x in markers):
                    forms.append("plain")
                    first.append(None)
                    second.append(None)
                    outputs.append(text)
                    continue
                if units > len(heights):
                    heights = node_heights(2 * units)
                form = "spm" if h4 % 100 < spm_percent else "psm"
                units_of_text = UnitSkipList(chars, size, heights)
                a, b = sorted((h1 % (units + 1), h2 % (units + 1)))
                (chars_a, at_a), (chars_b, at_b) = units_of_text.reach(a), units_of_text.reach(b)
                forms.append(form)
                first.append(chars_a)
                second.append(chars_b - chars_a)
                outputs.append(rearranged(text[:at_a], text[at_a:at_b], text[at_b:], form))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(first, pa.int64()),
                 pa.array(second, pa.int64()), pa.array(outputs, pa.binary())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
              fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n units, form plain/psm/spm, prefix_chars, middle_chars, output): one row per input row."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *draws)
    out = rows.mapInArrow(_transform(fim_percent, spm_percent),
                          f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. A rearranged text held no marker, and no marker can begin
    inside another, so the first one of each kind ends its part."""
    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        head = F.substring_index(output, two, 1)
        rest = F.substring(output, F.length(head) + len(two) + 1, F.length(output))
        other = F.substring_index(rest, MIDDLE, 1)
        return (F.substring(head, F.lit(len(one) + 1), F.length(head)), other,
                F.substring(rest, F.length(other) + len(MIDDLE) + 1, F.length(rest)))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))
