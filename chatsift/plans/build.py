"""End-to-end dataset build: sources -> examples -> priority union -> keep-first dedup ->
seeded exact split -> JSONL splits + report.

Shuffles of the full data: the per-conversation exchange of the multi-turn generator, the
signature aggregation of the dedup (partially aggregated map-side) and, when the output is
shuffled, one hash repartition before writing. Counts and thresholds are small aggregate jobs;
per-source caps (the original's row limits, applied to raw rows before validation; conversations
are counted as conversations) are seeded exact samples, skipped for the "unlimited" cap value.
The source union and the deduplicated set are written as tables in the shared checkpoint folder:
each is computed once, the counts, split passes and writers re-read them, and a lost executor
re-reads a table instead of recomputing the lineage.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chatsift.config import NO_CAP, BuildConfig
from chatsift.functions.messages import EXAMPLE, example_signature
from chatsift.operators.context import array_examples, conversation_examples
from chatsift.operators.dedup import ORDER, keep_first, numbered, ordered
from chatsift.operators.sampling import exact_split, order_key, sample_exact, sample_exact_groups
from chatsift.session import ensure_checkpoint_dir, materialize, release_scratch
from chatsift.sinks.jsonl import write_splits
from chatsift.sinks.report import counts_by_source, report_frame, source_table, write_report
from chatsift.sources import files
from chatsift.sources.custom import REJECTS, load_custom_dir, malformed_rows, read_pair_csv
from chatsift.sources.tables import instruction_examples, pair_examples

# fixed source tags of the built-in sources
PAIRS = "pairs"
TURN_PAIRS = "turn_pairs"
CHAT = "chat"
TRANSLATION = "translation"


@dataclass
class Sources:
    """Input tables. Each is ``(DataFrame, row_key_column)``; the key must be unique per row (per
    conversation for ``chat_turns``) and drives seeded sampling and the keep-first order.

    - ``pairs``: ``input, output``; ``turn_pairs``: ``user_message, assistant_message``
    - ``chat_turns``: ``conv_id, turn, role, text`` (one row per turn) or ``chat_arrays``:
      ``messages ARRAY<STRUCT<role, content>>`` (one conversation per row)
    - ``translation``: ``hi, hi_rom``
    """

    pairs: tuple[DataFrame, str] | None = None
    turn_pairs: tuple[DataFrame, str] | None = None
    chat_turns: tuple[DataFrame, str] | None = None
    chat_arrays: tuple[DataFrame, str] | None = None
    translation: tuple[DataFrame, str] | None = None
    tags: dict = field(default_factory=lambda: {PAIRS: "pairs", TURN_PAIRS: "turn_pairs", CHAT: "chat",
                                                 TRANSLATION: "translation"})


@dataclass
class BuildResult:
    examples: DataFrame  # deduplicated, with ``split``
    train: DataFrame
    validation: DataFrame
    report: DataFrame
    counts_before: DataFrame
    counts_after: DataFrame
    total: int
    validation_rows: int
    files_report: dict
    rejects: DataFrame  # file_name, reason, record: lines, rows and files that gave nothing
    reject_counts: DataFrame  # file_name, reason, n
    sources: DataFrame  # source, n_before, n_after

    def release(self) -> None:
        """Delete the build's intermediate tables once its frames are no longer needed."""
        release_scratch(self.examples.sparkSession, self.scratch)

    scratch: list[str] = field(default_factory=list)


def _capped(df: DataFrame, cap: int, seed: int, key: str) -> DataFrame | None:
    if cap <= 0:
        return None
    if cap >= NO_CAP:
        return df
    return sample_exact(df, cap, seed, key)


def _rank_of(name: str) -> int:
    return {PAIRS: 0, TURN_PAIRS: 1, CHAT: 2, TRANSLATION: 3}[name]


def build_examples(spark: SparkSession, cfg: BuildConfig, src: Sources) -> tuple[DataFrame, dict]:
    """All sources as one example frame with ``_order`` (before dedup)."""
    frames: list[DataFrame] = []
    ignored: set[str] = set()
    rejects: list[DataFrame] = []
    seed = cfg.seed

    # main pairs: a local pair file wins when it exists and its cap is positive
    local = cfg.local_pair_file
    if local and cfg.cap_pairs > 0 and files.exists(spark, local):
        name = posixpath.basename(local)
        raw = read_pair_csv(spark, local, on_malformed=cfg.json_mode, multi_line=cfg.multi_line).withColumn(
            "_rk", F.format_string("%d:%d", "block", "pos"))
        rejects.append(malformed_rows(raw))
        raw = _capped(raw, cfg.cap_pairs, seed, "_rk")
        ex = pair_examples(raw, "input", "output", system_prompt=cfg.system_prompt, source=f"local:{name}",
                           keep=("block", "pos"))
        frames.append(ordered(ex, 0, F.lit(name), pos="pos", block="block"))
        ignored.add(name)
    elif src.pairs is not None:
        df, key = src.pairs
        raw = _capped(df, cfg.cap_pairs, seed, key)
        if raw is not None:
            ex = pair_examples(raw, "input", "output", system_prompt=cfg.system_prompt, source=src.tags[PAIRS],
                               keep=(key,))
            frames.append(ordered(ex, _rank_of(PAIRS), pos=key))

    if src.turn_pairs is not None:
        df, key = src.turn_pairs
        raw = _capped(df, cfg.cap_turn_pairs, seed, key)
        if raw is not None:
            ex = pair_examples(raw, "user_message", "assistant_message", system_prompt=cfg.system_prompt,
                               source=src.tags[TURN_PAIRS], keep=(key,))
            frames.append(ordered(ex, _rank_of(TURN_PAIRS), pos=key))

    if src.chat_turns is not None:
        df, key = src.chat_turns
        # the cap counts conversations, not turns
        if cfg.cap_chat <= 0:
            raw = None
        elif cfg.cap_chat >= NO_CAP:
            raw = df
        else:
            raw = sample_exact_groups(df, cfg.cap_chat, seed, key)
        if raw is not None:
            ex = conversation_examples(raw, system_prompt=cfg.system_prompt, source=src.tags[CHAT],
                                       k=cfg.max_context_messages, key=key, skew=cfg.skew)
            frames.append(ordered(ex, _rank_of(CHAT), pos=key, sub="turn"))
    elif src.chat_arrays is not None:
        df, key = src.chat_arrays
        raw = _capped(df, cfg.cap_chat, seed, key)
        if raw is not None:
            ex = array_examples(raw, "messages", system_prompt=cfg.system_prompt, source=src.tags[CHAT],
                                k=cfg.max_context_messages, keep=(key,))
            frames.append(ordered(ex, _rank_of(CHAT), pos=key, sub="reply_pos"))

    if src.translation is not None:
        df, key = src.translation
        raw = _capped(df, cfg.cap_translation, seed, key)
        if raw is not None:
            ex = instruction_examples(raw, "hi", "hi_rom", instruction=cfg.translation_instruction,
                                      system_prompt=cfg.translation_system_prompt, source=src.tags[TRANSLATION],
                                      keep=(key,))
            frames.append(ordered(ex, _rank_of(TRANSLATION), pos=key))

    files_report: dict = {}
    if cfg.custom_dir:
        custom, files_report = load_custom_dir(spark, cfg.custom_dir, system_prompt=cfg.system_prompt,
                                               k=cfg.max_context_messages, ignored=ignored, mode=cfg.json_mode,
                                               multi_line=cfg.multi_line)
        frames.append(custom)
        rejects.append(files_report["rejects"])

    if not frames:
        raise ValueError("no sources")
    cols = [*EXAMPLE.names, ORDER]
    out = frames[0].select(*cols)
    for f in frames[1:]:
        out = out.unionByName(f.select(*cols))
    files_report["rejects"] = reduce(DataFrame.unionByName, rejects, spark.createDataFrame([], REJECTS))
    return out, files_report


def build_dataset(spark: SparkSession, cfg: BuildConfig, src: Sources, *, write: bool = True) -> BuildResult:
    ensure_checkpoint_dir(spark)
    union, files_report = build_examples(spark, cfg, src)
    # both the per-source counts and the dedup read the union: write it once; rows are counted as they are written
    union = materialize(numbered(union.withColumn("signature", example_signature())), "build-union")
    deduped = materialize(keep_first(union, "signature", staged=True), "build-deduped")
    labelled, n, v = exact_split(deduped, cfg.seed, cfg.validation_ratio, "signature")
    counts_before, counts_after = counts_by_source(union), counts_by_source(deduped)
    train = labelled.where(F.col("split") == "train")
    validation = labelled.where(F.col("split") == "validation")
    seen = Observation("rejects")
    rejects = materialize(files_report["rejects"].observe(seen, F.count(F.lit(1)).alias("n")), "build-rejects")
    reject_counts = rejects.groupBy("file_name", "reason").agg(F.count(F.lit(1)).alias("n"))
    sources = materialize(source_table(counts_before, counts_after), "build-sources")
    report = report_frame(sources, n - v, v, cfg.notes, seen.get["n"])
    if write and cfg.output_dir:
        base = cfg.output_dir.rstrip("/")
        write_splits(labelled, base, order_key(cfg.seed, F.col("signature")), n, shuffle=cfg.shuffle_output)
        write_report(report, f"{base}/metadata.json")
        sources.write.mode("overwrite").json(f"{base}/sources.json")
        reject_counts.write.mode("overwrite").json(f"{base}/rejects.json")
    return BuildResult(labelled, train, validation, report, counts_before, counts_after, n, v, files_report,
                       rejects, reject_counts, sources, scratch=[p.rsplit("/", 1)[0] for f in (union, deduped, rejects, sources) for p in f.inputFiles()[:1]])
