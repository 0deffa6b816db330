"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The exact finders give the base spans: e-mail addresses, IP addresses, payment cards (Luhn) and
international phone numbers. The field adds spans that the patterns miss, such as a phone number
directly followed by a card number, where the greedy pattern runs across both and is dropped.

The field labels words (runs of non-white space). Words without a digit or an at sign can only be
outside, so a text falls into independent runs of the other words and decoding the runs is decoding
the text; a plain neighbour still counts as context. Features are a word's shape (letters ``a``,
digits ``d``, other characters as they are; once with runs collapsed, once with digit-run lengths),
Luhn, IP-range and digit-count marks, and the shapes of both neighbours. It is trained by maximum
likelihood on a small labelled table: the runs of at most about ``SAMPLE_ROWS`` documents whose words
the base spans explain entirely or not at all. Runs are decoded by Viterbi in numpy batches.

Nulls and edges: null and empty texts have no spans; rows are handled one by one, so repeated rows
and null ids do not matter; whole texts of any length are scanned; with nothing to train on no spans
are added; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsift.llm.common import arrow_slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SAMPLE_ROWS = 4_000
TRAIN_RUNS = 20_000
TRAIN_RUN_WORDS = 12
STEPS = 150
RIDGE = 1e-3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a start inside a digit run can only match what the run's first digit could
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SPACE = " \t\n\x0b\x0c\r"
_GAP = re.compile(r"[ \t-\r]+")
_MARK = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _in_range(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind; code points, end exclusive."""
    out = []
    last = 0
    for m in _TAIL.finditer(text):
        begin = m.start()
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < m.start():
            out.append((begin, m.end(), 0))
            last = m.end()
    for m in _IP.finditer(text):
        if _in_range(m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def marked_runs(text: str):
    """Runs of consecutive words with a digit or an at sign: (words as (start, end), plain word
    before?, plain word after?)."""
    pos, run, n = 0, [], len(text)
    while m := _MARK.search(text, pos):
        begin = m.start()
        while begin > pos and text[begin - 1] not in _SPACE:
            begin -= 1
        gap = _GAP.search(text, m.end())
        end = gap.start() if gap else n
        if run and text[run[-1][1]:begin].strip(_SPACE):
            yield run, True
            run = []
        run.append((begin, end))
        pos = end
    if run:
        yield run, bool(text[run[-1][1]:].strip(_SPACE))


def _short(shape: str) -> str:
    """Long shapes by their hash."""
    return shape if len(shape) <= 40 else hashlib.md5(shape.encode("utf-8", "surrogatepass")).hexdigest()


def word_features(word: str) -> tuple[str, ...]:
    """Shape marks of one word."""
    shape, sized, i = [], [], 0
    while i < len(word):
        c = word[i]
        kind = "d" if "0" <= c <= "9" else "a" if c.isalpha() else c
        j = i + 1
        while j < len(word) and (("d" if "0" <= word[j] <= "9" else "a" if word[j].isalpha() else word[j]) == kind):
            j += 1
        shape.append(kind)
        sized.append(f"d{j - i}" if kind == "d" else kind)
        i = j
    digits = "".join(c for c in word if "0" <= c <= "9")
    core = word.strip(".,;:!?()[]{}<>\"'%&$#*")
    parts = core.split(".")
    marks = [f"n={min(len(digits), 20)}"]
    if "@" in word:
        marks.append("at-dot" if "." in word.rpartition("@")[2] else "at")
    if 12 <= len(digits) <= 19:
        marks.append("luhn" if luhn(digits) else "no-luhn")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        marks.append("ip" if _in_range(parts) else "no-ip")
    if word.startswith("+"):
        marks.append("plus")
    return (f"s={_short(''.join(shape))}", f"z={_short(''.join(sized))}", *marks)


class _Shapes(dict):
    """Features by word; emptied when it has grown large."""

    def __missing__(self, word):
        found = word_features(word)
        if len(word) <= 200:  # longer ones are not kept
            if len(self) > 100_000:
                self.clear()
            self[word] = found
        return found


def run_features(words: list[str], after: bool, shapes: _Shapes) -> list[list[str]]:
    own = [shapes[w] for w in words]
    out = []
    for t, f in enumerate(own):
        before = own[t - 1][:2] if t else ("edge",)
        behind = own[t + 1][:2] if t + 1 < len(own) else ("plain" if after else "end",)
        out.append([*f, *("<" + x for x in before), *(">" + x for x in behind)])
    return out


@dataclass
class Field:
    """Weights of a trained field."""

    index: dict[str, int]
    emit: np.ndarray  # features + 1 (none) x labels
    move: np.ndarray  # label x label
    first: np.ndarray

    def parts(self):
        """As plain values: a broadcast is unpickled by workers that need no copy of this package."""
        return self.index, self.emit, self.move, self.first

    def scores(self, runs: list[list[list[str]]], length: int) -> np.ndarray:
        """Emission scores (runs x length x labels) of runs of one length."""
        none, flat, ends = len(self.index), [], []
        for run in runs:
            for feats in run:
                flat.extend(self.index.get(f, none) for f in feats)
                ends.append(len(flat))
        # whole numbers also for a single word, which has no end before it
        cum = np.add.reduceat(self.emit[flat], np.array([0, *ends[:-1]]), axis=0)
        return cum.reshape(len(runs), length, -1)


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties that forbid an inside label without its own kind before it."""
    move, first = np.zeros((len(LABELS),) * 2), np.zeros(len(LABELS))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            first[j] = -1e4
            for i, a in enumerate(LABELS):
                if a[2:] != b[2:]:
                    move[i, j] = -1e4
    return move, first


def train(patterns: list[tuple[list[list[str]], list[int], int]], steps: int = STEPS, ridge: float = RIDGE) -> Field | None:
    """Maximum-likelihood weights from (run features, labels, count) rows, by Adam on the exact
    gradient: observed minus expected counts from forward and backward sums."""
    if not patterns:
        return None
    index: dict[str, int] = {}
    for run, _, _ in patterns:
        for feats in run:
            for f in feats:
                index.setdefault(f, len(index))
    n_f, n_l = len(index), len(LABELS)
    hard_move, hard_first = _allowed()
    by_length = defaultdict(list)
    for p in patterns:
        by_length[len(p[0])].append(p)
    groups = []
    for length, ps in by_length.items():
        width = max(len(f) for run, _, _ in ps for f in run)
        ids = np.full((len(ps), length, width), n_f)
        for i, (run, _, _) in enumerate(ps):
            for t, feats in enumerate(run):
                ids[i, t, : len(feats)] = [index[f] for f in feats]
        groups.append((ids, np.array([p[1] for p in ps]), np.array([p[2] for p in ps], dtype=float)))
    total = sum(g[2].sum() for g in groups)
    w = [np.zeros((n_f + 1, n_l)), np.zeros((n_l, n_l)), np.zeros(n_l)]
    m1, m2 = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for step in range(1, steps + 1):
        grad = [-ridge * x for x in w]
        move, first = w[1] + hard_move, w[2] + hard_first
        for ids, gold, weight in groups:
            n, length, _ = ids.shape
            emit = w[0][ids].sum(axis=2)
            fwd, bwd = np.empty_like(emit), np.zeros_like(emit)
            fwd[:, 0] = emit[:, 0] + first
            for t in range(1, length):
                fwd[:, t] = emit[:, t] + lse(fwd[:, t - 1, :, None] + move, 1)
            for t in range(length - 2, -1, -1):
                bwd[:, t] = lse(move + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            norm = lse(fwd[:, -1], 1)
            share = weight / total
            gap = -np.exp(fwd + bwd - norm[:, None, None])
            gap[np.arange(n)[:, None], np.arange(length), gold] += 1
            gap *= share[:, None, None]
            for l in range(n_l):
                grad[0][:, l] += np.bincount(ids.ravel(), np.repeat(gap[:, :, l].ravel(), ids.shape[2]), n_f + 1)
            grad[2] += gap[:, 0].sum(axis=0)
            for t in range(1, length):
                pair = np.exp(fwd[:, t - 1, :, None] + move + (emit[:, t] + bwd[:, t])[:, None, :] - norm[:, None, None])
                grad[1] -= (pair * share[:, None, None]).sum(axis=0)
                np.add.at(grad[1], (gold[:, t - 1], gold[:, t]), share)
        grad[0][n_f] = 0
        for x, g, a, b in zip(w, grad, m1, m2):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += 0.2 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Field(index, w[0], w[1] + hard_move, w[2] + hard_first)


def viterbi(emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best label sequences (runs x length) for emission scores (runs x length x labels)."""
    n, length, _ = emit.shape
    back = np.zeros(emit.shape, dtype=np.int8)
    best = emit[:, 0] + first
    for t in range(1, length):
        reach = best[:, :, None] + move
        back[:, t] = reach.argmax(axis=1)
        best = reach.max(axis=1) + emit[:, t]
    out = np.empty((n, length), dtype=np.int64)
    out[:, -1] = best.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out


def _trim(text: str, begin: int, end: int, kind: int) -> tuple[int, int]:
    """A labelled stretch without the punctuation around it."""
    opening = "+(" if KINDS[kind] == "phone" else ""
    while begin < end and not (text[begin].isalnum() or text[begin] in opening):
        begin += 1
    while end > begin and not text[end - 1].isalnum():
        end -= 1
    return begin, end


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field | None) -> list[list[tuple[int, int, int]]]:
    """Spans the field finds beside the base spans, per text; they overlap no base span."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if field is None:
        return out
    shapes = _Shapes()
    by_length = defaultdict(list)
    for at, text in enumerate(texts):
        for run, after in marked_runs(text):
            by_length[len(run)].append((at, run, after))
    for length, found in by_length.items():
        size = max(1, 50_000 // length)
        for i in range(0, len(found), size):
            part = found[i : i + size]
            feats = [run_features([texts[at][b:e] for b, e in run], after, shapes) for at, run, after in part]
            labels = viterbi(field.scores(feats, length), field.move, field.first)
            for (at, run, _), row in zip(part, labels):
                t = 0
                while t < length:
                    if not row[t]:
                        t += 1
                        continue
                    kind, stop = (int(row[t]) - 1) // 2, t + 1
                    while stop < length and row[stop] == 2 * kind + 2:
                        stop += 1
                    begin, end = _trim(texts[at], run[t][0], run[stop - 1][1], kind)
                    if begin < end:
                        out[at].append((begin, end, kind))
                    t = stop
    for at, spans in enumerate(out):
        if spans and base[at]:
            starts = np.array([s[0] for s in base[at]])
            ends = np.maximum.accumulate([s[1] for s in base[at]])
            out[at] = [s for s in spans if not (k := int(np.searchsorted(starts, s[1]))) or ends[k - 1] <= s[0]]
    return out


def _strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _labelled_runs(batches):
    shapes = _Shapes()
    for batch in arrow_slices(batches, "text", 8_000_000):
        rows = defaultdict(int)
        for text in _strings(batch, "text"):
            spans = base_spans(text)
            for run, after in marked_runs(text):
                if len(run) > TRAIN_RUN_WORDS:
                    continue
                labels = []
                for begin, end in run:
                    own = [s for s in spans if s[0] < end and s[1] > begin]
                    labels.append(2 * own[0][2] + (1 if own[0][0] >= begin else 2) if own else 0)
                words = [text[b:e] for b, e in run]
                digits = sum(c.isdigit() for w in words for c in w)
                if 0 in labels and (any(labels) or (len(run) > 1 and digits >= 9)):
                    continue  # explained in part, or digits over several words that may hide a match: no evidence
                feats = run_features(words, after, shapes)
                rows["\x1e".join("\x1f".join(f) for f in feats), ",".join(map(str, labels))] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()),
             pa.array(list(rows.values()), pa.int64())], names=["feats", "labels", "n"])


def last_drawn(n: int, sample_rows: int) -> int:
    """The largest 64-bit hash that draws about ``sample_rows`` of ``n`` rows."""
    return min((1 << 63) - 1, (sample_rows << 64) // n - (1 << 63))


def labelled_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The small labelled table (feats, labels, n): distinct labelled runs of about ``sample_rows``
    documents that hold a digit or an at sign, drawn by hash of their id."""
    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text")).where(
        F.col("text").rlike("[0-9@]"))
    n = max(1, rows.count())
    drawn = rows.where(F.xxhash64(F.coalesce("key", F.lit(""))) <= last_drawn(n, sample_rows))
    return drawn.select("text").mapInArrow(_labelled_runs, "feats string, labels string, n long").groupBy(
        "feats", "labels").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, max_runs: int = TRAIN_RUNS) -> Field | None:
    rows = labelled.orderBy(F.desc("n"), "feats", "labels").limit(max_runs).collect()
    return train([([f.split("\x1f") for f in r[0].split("\x1e")], [int(x) for x in r[1].split(",")], r[2])
                  for r in rows])


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_spans(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per input row: all spans by start, then kind, marked where they are base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(field and field.parts())  # bounded by the training table

    def run(batches):
        field = shared.value and Field(*shared.value)
        for batch in arrow_slices(batches, "text", 8_000_000):
            texts = _strings(batch, "text")
            base = [base_spans(t) for t in texts]
            rows = []
            for own, more in zip(base, added_spans(texts, base, field)):
                spans = sorted([(*s, True) for s in own] + [(*s, False) for s in more], key=lambda s: (s[0], s[2]))
                rows.append([{"kind": KINDS[k], "start": b, "end": e, "base": own} for b, e, k, own in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                       ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, spans {SPANS}")


def mask_spans(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each stretch of overlapping spans replaced by its first span's kind in brackets."""
    out, at = [], 0
    for begin, end, kind in spans:
        if begin >= at:
            out += [text[at:begin], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` masked; null stays null, other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(field and field.parts())

    def run(batches):
        field = shared.value and Field(*shared.value)
        for batch in arrow_slices(batches, text_col, 8_000_000):
            at = batch.schema.get_field_index(text_col)
            raw = batch.column(at).to_pylist()
            texts = [x or "" for x in raw]
            base = [base_spans(t) for t in texts]
            done = []
            for x, t, own, more in zip(raw, texts, base, added_spans(texts, base, field)):
                spans = sorted(own + more, key=lambda s: (s[0], s[2]))
                done.append(mask_spans(t, spans) if spans else x)
            cols = list(batch.columns)
            cols[at] = pa.array(done, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
