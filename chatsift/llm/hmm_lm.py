"""Hidden Markov language model: Baum-Welch over partitions, exact likelihood by scaled forward sums.

A token's probability is P(class | state) * P(word | class). Words fall into ``CLASSES`` hash classes,
plus one class for the end of a text, so the trained parameters have a fixed size while every word
keeps its exact corpus count: P(word | class) = (c + 1) / (words counted in the class + distinct
words in it + 1), the last 1 standing for all unseen words. P(class | state) and the transitions are
trained by Baum-Welch on all training texts: each task sums expected counts over its texts, the sums
are added up, and the driver normalises matrices of ``STATES * (CLASSES + 1)`` numbers. The
likelihood of a text is the scaled forward recursion over its whole length.

Counts of the commonest ``FREQUENT`` words reach the tasks as a dictionary; the rest of the lookups
go through a join on the word, so the vocabulary may be of any size. Class sequences are written
once, long and short texts in partitions of their own, and read by every training step. Texts are
batched by length, about ``BATCH_TOKENS`` tokens at a time, which bounds a task's memory by that and
its longest text.

Nulls and edges: null and empty texts are one end token; a null id is trained on like an id with an
empty name; repeated rows are each counted and scored; without training rows every word is unseen and
scores are finite; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsift.llm.common import arrow_slices, stage, texts_of

CLASSES = 1 << 14
STATES = 8
STEPS = 5
FREQUENT = 500_000
BATCH_TOKENS = 1_500_000
PART_TOKENS = 3_000_000
MAX_PARTS = 20_000
LONG = 2_048
SPREAD = 50.0  # weight, in tokens, of the corpus's class shares in each state's emissions
SEED = 42
_END = b" "  # cannot be a word


def tokens(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased, split on \\x20 and \\x09-\\x0D."""
    return text.lower().split()


def word_class(word: bytes) -> int:
    return CLASSES if word == _END else crc32(word) % CLASSES


def _count_words(batches):
    counts: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in arrow_slices(batches, "text", 8_000_000):
        for text in texts_of(batch, "text"):
            counts.update(tokens(text))
        counts[_END] += batch.num_rows
        if len(counts) > 1_000_000:
            yield rows()
    if counts:
        yield rows()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n): every token of the texts, the end token under its own name."""
    return texts.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    first: np.ndarray  # state
    move: np.ndarray  # state x state
    emit: np.ndarray  # class x state


def _frequent(counts: DataFrame, limit: int) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """At most ``limit`` of the commonest words: index, class and log10(c + 1) of each."""
    step = F.floor(4 * F.log2("n"))
    sizes = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("s")).collect()
    low, held = None, 0
    for s, k in sizes:
        held += k
        if held > limit:
            break
        low = s
    rows = counts.where(step >= low if low is not None else F.lit(False)).toArrow()  # at most ``limit`` rows
    words = rows.column("word").to_pylist()
    return ({w: i for i, w in enumerate(words)},
            np.array([word_class(w) for w in words] + [0], dtype=np.uint16),
            np.log10(np.append(rows.column("n").to_numpy(), 0) + 1.0))


def _encode(shared):
    def run(batches):
        index, classes, logs = shared.value
        for batch in arrow_slices(batches, "text", 4_000_000):
            seqs, lens, sums, known, rare_words, rare_counts, rare_ends = [], [], [], [], [], [], [0]
            for text in texts_of(batch, "text"):
                words = tokens(text)
                words.append(_END)
                at = np.fromiter((index.get(w, -1) for w in words), dtype=np.int64, count=len(words))
                cls = classes[at]
                odd = np.flatnonzero(at < 0)
                rest = Counter([words[i] for i in odd])
                if len(odd):
                    own = {w: word_class(w) for w in rest}
                    cls[odd] = [own[words[i]] for i in odd]
                seqs.append(cls.astype("<u2").tobytes())
                lens.append(len(words))
                sums.append(float(logs[at[at >= 0]].sum()))
                known.append(len(words) - len(odd))
                rare_words.extend(rest.keys())
                rare_counts.extend(rest.values())
                rare_ends.append(len(rare_words))
            rare = pa.StructArray.from_arrays(
                [pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], names=["word", "m"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(seqs, pa.binary()), pa.array(lens, pa.int64()),
                 pa.array(sums), pa.array(known, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), rare)],
                names=["id", "held_out", "seq", "n_tokens", "log_sum", "known", "rare"])

    return run


class _Batch:
    """Class sequences laid out by time: at step t the texts longer than t, longest first."""

    def __init__(self, seqs: list[np.ndarray]):
        lens = np.array([len(s) for s in seqs])
        self.order = np.argsort(-lens, kind="stable")
        lens = lens[self.order]
        self.active = np.searchsorted(-lens, -np.arange(lens[0]), side="left")  # texts longer than t
        self.at = np.concatenate(([0], np.cumsum(self.active)))
        rank = np.repeat(np.arange(len(seqs)), lens)
        step = np.arange(len(rank)) - np.repeat(np.cumsum(lens) - lens, lens)
        self.x = np.empty(len(rank), dtype=np.int64)
        self.x[self.at[step] + rank] = np.concatenate([seqs[i] for i in self.order])

    def forward(self, m: Model, keep: bool):
        """Scaled forward sums: (alpha by time or None, scales by time, emissions by time)."""
        emit = m.emit[self.x]
        scale = np.empty(len(self.x))
        alpha = np.empty_like(emit) if keep else None
        ones, a = np.ones(len(m.first)), None
        for n, lo in zip(self.active.tolist(), self.at.tolist()):
            a = (m.first if a is None else a[:n] @ m.move) * emit[lo : lo + n]
            c = a @ ones
            a /= c[:, None]
            scale[lo : lo + n] = c
            if keep:
                alpha[lo : lo + n] = a
        return alpha, scale, emit

    def log10_likelihoods(self, m: Model) -> np.ndarray:
        _, scale, _ = self.forward(m, keep=False)
        logs, total = np.log10(scale), np.zeros(len(self.order))
        for t, n in enumerate(self.active):
            total[:n] += logs[self.at[t] : self.at[t] + n]
        out = np.empty_like(total)
        out[self.order] = total
        return out

    def expected_counts(self, m: Model):
        """Expected first-state, transition and emission counts, and the log10 likelihood."""
        alpha, scale, emit = self.forward(m, keep=True)
        emit /= scale[:, None]
        moved = np.zeros_like(m.move)
        beta = np.ones((0, len(m.first)))
        for t in range(len(self.active) - 1, -1, -1):
            n, lo = self.active[t], self.at[t]
            own = np.ones((n, len(m.first)))
            if len(beta):
                k, nxt = len(beta), self.at[t + 1]
                ahead = emit[nxt : nxt + k] * beta
                moved += alpha[lo : lo + k].T @ ahead
                own[:k] = ahead @ m.move.T
            beta = own
            alpha[lo : lo + n] *= beta  # state posteriors from here on
        states = alpha.shape[1]
        emitted = np.stack([np.bincount(self.x, alpha[:, s], CLASSES + 1) for s in range(states)], axis=1)
        return alpha[: self.active[0]].sum(axis=0), moved * m.move, emitted, np.log10(scale).sum()


def _batches(batches):
    """(rows, _Batch) over a partition sorted by length, about ``BATCH_TOKENS`` tokens each."""
    rows, seqs, held = [], [], 0
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("seq"))
        for i in range(batch.num_rows):
            seqs.append(np.frombuffer(col[i].as_buffer(), dtype="<u2"))
            rows.append((batch, i))
            held += len(seqs[-1])
            if held >= BATCH_TOKENS:
                yield rows, _Batch(seqs)
                rows, seqs, held = [], [], 0
    if rows:
        yield rows, _Batch(seqs)


def _expect(shared):
    def run(batches):
        m = Model(*shared.value)
        total = None
        for _, b in _batches(batches):
            got = b.expected_counts(m)
            total = got if total is None else tuple(x + y for x, y in zip(total, got))
        if total is not None:
            flat = np.concatenate([np.ravel(x) for x in total]).astype("<f8")
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["sums"])

    return run


def _add(batches):
    total = None
    for batch in batches:
        for x in batch.column(0):
            part = np.frombuffer(x.as_buffer(), dtype="<f8")
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _normalise(first, moved, emitted, share: np.ndarray) -> Model:
    first = (first + 0.1) / (first.sum() + 0.1 * len(first))
    move = (moved + 1.0) / (moved.sum(axis=1, keepdims=True) + len(first))
    emit = (emitted + SPREAD * share[:, None]) / (emitted.sum(axis=0) + SPREAD)
    return Model(first, move, emit)


def train(seqs: DataFrame, share: np.ndarray, states: int = STATES, steps: int = STEPS) -> Model:
    """Baum-Welch on the training sequences; ``share`` is the corpus's class distribution."""
    spark = seqs.sparkSession
    rng = np.random.default_rng(SEED)
    emit = share[:, None] * np.exp(rng.normal(size=(len(share), states)))
    m = Model(np.full(states, 1 / states), 0.1 / states + 0.9 * np.eye(states), emit / emit.sum(axis=0))
    m.move /= m.move.sum(axis=1, keepdims=True)
    for _ in range(steps):
        shared = spark.sparkContext.broadcast((m.first, m.move, m.emit))
        # at most 16 sums of fixed size reach the driver
        parts = seqs.select("seq").mapInArrow(_expect(shared), "sums binary").repartition(16).mapInArrow(
            _add, "sums binary").collect()
        shared.destroy()
        if not parts:
            break
        total = np.sum([np.frombuffer(bytes(p[0]), dtype="<f8") for p in parts], axis=0)
        m = _normalise(total[:states], total[states : states + states**2].reshape(states, states),
                       total[states + states**2 : -1].reshape(-1, states), share)
    return m


def _score(shared):
    def run(batches):
        *parts, log_size = shared.value
        m = Model(*parts)
        keep = ["row", "id", "held_out", "n_tokens", "log_sum", "known"]
        for rows, b in _batches(batches):
            ll = b.log10_likelihoods(m)
            inside = np.array([log_size[np.frombuffer(batch.column("seq")[i].as_buffer(), dtype="<u2")].sum()
                               for batch, i in rows])
            cols = [pa.array([batch.column(c)[i].as_py() for batch, i in rows], rows[0][0].column(c).type) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ll - inside)], names=[*keep, "part"])

    return run


def held_out(id_col):
    """The fold that is not learnt from: crc32 of the id as text, modulo 7, is 2."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7) == 2


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES,
                    steps: int = STEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per input row."""
    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    counts = stage(word_counts(rows.where(~F.col("held_out"))), "word-counts")
    n, v = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    end = F.lit(_END)
    per_class = counts.groupBy(
        F.when(F.col("word") == end, F.lit(CLASSES)).otherwise(F.crc32("word") % CLASSES).alias("c")
    ).agg(F.sum("n"), F.count(F.lit(1))).collect()  # at most CLASSES + 1 rows
    size = np.ones(CLASSES + 1)
    for c, total, words in per_class:
        size[c] += total + words
    frequent = spark.sparkContext.broadcast(_frequent(counts, FREQUENT))
    encoded = rows.mapInArrow(
        _encode(frequent), f"id {kind}, held_out boolean, seq binary, n_tokens long, log_sum double, known long, "
        "rare array<struct<word:binary,m:long>>").withColumn("row", F.monotonically_increasing_id())
    # rare words are looked up by a join on the word
    table = stage(encoded, "encoded-texts")
    seqs = _by_length(table.drop("rare"))
    m = train(seqs.where(~F.col("held_out")), size / size.sum(), states, steps)
    looked = table.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.m").join(counts, "word")
    rare = looked.groupBy("row").agg(
        F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("rare_sum"), F.sum("m").alias("rare_known"))
    shared = spark.sparkContext.broadcast((m.first, m.move, m.emit, np.log10(size)))
    scored = seqs.mapInArrow(_score(shared), f"row long, id {kind}, held_out boolean, n_tokens long, log_sum double, "
                             "known long, part double").join(rare, "row", "left")
    log_sum = F.col("log_sum") + F.coalesce("rare_sum", F.lit(0.0))
    return scored.select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (log_sum - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (log_sum + F.col("part")).alias("score"))


def _by_length(table: DataFrame) -> DataFrame:
    """The sequences in partitions of about ``PART_TOKENS`` tokens, long texts apart from short ones,
    each sorted by length; written once and read by every step."""
    is_long = F.col("n_tokens") > LONG
    sums = dict(table.groupBy(is_long).agg(F.sum("n_tokens")).collect())
    per_part = max(PART_TOKENS, sum(sums.values()) // MAX_PARTS)
    parts = {k: max(1, -(-sums.get(k, 0) // per_part)) for k in (False, True)}
    part = F.when(is_long, parts[False] + F.pmod(F.xxhash64("row"), F.lit(parts[True]))).otherwise(
        F.pmod(F.xxhash64("row"), F.lit(parts[False]))).cast("int")
    return stage(table.withColumn("part", part).repartitionById(sum(parts.values()), F.col("part"))
                 .sortWithinPartitions("n_tokens").drop("part"), "sequences")
