"""Registered driver queries: each takes ``(spark, sf_dir)`` and returns a DataFrame whose
columns match the DuckDB oracle of the same name in ``plans.oracles``.

Every query reads whole driver tables (``conversations``, ``documents``, ``events``) or data
Spark derives from them; nothing runs on fixed inputs alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.config import (
    DEFAULT_SEED,
    DEFAULT_SYSTEM_PROMPT,
    DEFAULT_VALIDATION_RATIO,
    TRANSLATION_INSTRUCTION,
    TRANSLATION_SYSTEM_PROMPT,
    BuildConfig,
    ChatConfig,
    SkewConfig,
)
from chatsift.functions.messages import (
    example_signature,
    first_content,
    last_user_content,
    message,
    render_messages,
    with_example,
)
from chatsift.functions.text import is_valid_text, normalize_text
from chatsift.operators import requests as rq
from chatsift.operators.context import conversation_examples, trailing_context
from chatsift.operators.dedup import keep_first, numbered, ordered, priority_union
from chatsift.operators.sampling import exact_split, sample_exact
from chatsift.operators.skew import hot_keys
from chatsift.plans.build import Sources, build_dataset, build_examples
from chatsift.plans.derive import (
    adjacent_pairs,
    SLOW_EVENTS,
    chat_events,
    chat_replies,
    chat_requests,
    csv_pairs,
    dirty_documents,
    dirty_turns,
    event_requests,
    jsonl_lines,
    translation_pairs,
)
from chatsift.plans.present import example_view
from chatsift.session import materialize, scratch_path
from chatsift.sinks.jsonl import read_splits, split_counts
from chatsift.sources import files
from chatsift.sources.custom import jsonl_examples, load_custom_dir, read_pair_csv, rejected_lines
from chatsift.sources.tables import instruction_examples, pair_examples, read_table
from chatsift.streaming import sessions as ss
from chatsift.streaming.event_time import TIMED_SCHEMA, session_requests_by_event_time
from chatsift.streaming.folder import from_now
from chatsift.streaming.incremental import SessionStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

CHAT_SOURCE = "conversations:chat"


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def _multi_turn(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    ex = conversation_examples(turns, system_prompt=DEFAULT_SYSTEM_PROMPT, source=CHAT_SOURCE, k=k)
    return example_view(ex, ("conv_id", "turn"))


@register("examples_multi_turn")
def examples_multi_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multi_turn(spark, sf_dir, 8)


@register("examples_context_3")
def examples_context_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multi_turn(spark, sf_dir, 3)


@register("examples_unbounded_context")
def examples_unbounded_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multi_turn(spark, sf_dir, 0)


# ---- shared conversation/document sources ---------------------------------------------------


PAIR_SOURCE = "conversations:pairs"
TRANSLATION_SOURCE = "documents:translation"
SAMPLE_N = 300


def pair_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = adjacent_pairs(read_table(spark, sf_dir, "conversations"))
    return pair_examples(pairs, "input", "output", system_prompt=DEFAULT_SYSTEM_PROMPT, source=PAIR_SOURCE,
                         keep=("conv_id", "turn"))


def chat_source(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return conversation_examples(turns, system_prompt=DEFAULT_SYSTEM_PROMPT, source=CHAT_SOURCE, k=k)


def translation_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = translation_pairs(read_table(spark, sf_dir, "documents"))
    return instruction_examples(pairs, "src_text", "target_text", instruction=TRANSLATION_INSTRUCTION,
                                system_prompt=TRANSLATION_SYSTEM_PROMPT, source=TRANSLATION_SOURCE,
                                keep=("doc_id",))


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority union: pairs, then multi-turn chat, then translation pairs. ``row_ref`` names the
    originating row."""
    cols = ["row_ref", "prompt", "completion", "source", "_order"]
    pairs = ordered(pair_source(spark, sf_dir), 0, pos="conv_id", sub="turn").withColumn(
        "row_ref", F.format_string("c:%d:%d", "conv_id", "turn"))
    chat = ordered(chat_source(spark, sf_dir), 1, pos="conv_id", sub="turn").withColumn(
        "row_ref", F.format_string("c:%d:%d", "conv_id", "turn"))
    trans = ordered(translation_source(spark, sf_dir), 2, pos="doc_id").withColumn(
        "row_ref", F.format_string("d:%d", "doc_id"))
    return priority_union([pairs.select(*cols), chat.select(*cols), trans.select(*cols)])


def deduped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    union = union_sources(spark, sf_dir)
    cols = union.columns
    return keep_first(union.withColumn("signature", example_signature()), "signature", payload=[*cols, "signature"])


@register("examples_single_turn")
def examples_single_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example_view(pair_source(spark, sf_dir), ("conv_id", "turn"))


@register("role_and_message_cleaning")
def role_and_message_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty roles and texts; prompt = system + the 3 previous raw turns, completion = the current
    raw turn; clean both arrays and validate (role whitelist, empty content, user present, length)."""
    turns = read_table(spark, sf_dir, "conversations")
    dirty = dirty_turns(turns)
    skew = SkewConfig()
    with_ctx = trailing_context(
        dirty, keys=["conv_id"], seq="turn", item=message(F.col("role"), F.col("text")), k=3,
        hot=hot_keys(turns.select("conv_id"), ["conv_id"], skew), block_rows=skew.block_rows,
    )
    prompt = F.concat(F.array(message(F.lit("system"), F.lit(DEFAULT_SYSTEM_PROMPT))), F.col("ctx"))
    completion = F.array(message(F.col("role"), F.col("text")))
    ex = with_example(with_ctx, prompt, completion, "conversations:dirty", keep=("conv_id", "turn"))
    return example_view(ex, ("conv_id", "turn"))


@register("normalize_text")
def normalize_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dirty_documents(read_table(spark, sf_dir, "documents"))
    staged = docs.select("doc_id", "lang", normalize_text(F.col("text")).alias("text_norm"))
    return staged.select("doc_id", "lang", "text_norm", F.length("text_norm").cast("long").alias("n_chars_norm"))


@register("last_user_first_reply")
def last_user_first_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = chat_source(spark, sf_dir)
    return ex.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.lower(last_user_content("prompt")).alias("last_user"),
        F.lower(first_content("completion")).alias("first_reply"),
        example_signature().alias("signature"),
    )


@register("length_gate_by_lang")
def length_gate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    n = F.length(normalize_text(F.col("text")))
    staged = docs.select("lang", n.alias("n"), is_valid_text("text").alias("valid"))
    return staged.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count(F.when(F.col("valid"), 1)).alias("n_valid"),
        F.count(F.when(F.col("n") < 2, 1)).alias("n_short"),
        F.count(F.when(F.col("n") > 1200, 1)).alias("n_long"),
    )


@register("instruction_template")
def instruction_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example_view(translation_source(spark, sf_dir), ("doc_id",))


@register("dedup_keep_first_documents")
def dedup_keep_first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    # computed once into a column, hashed from there; the text itself is not written
    sig = docs.select("doc_id", "lang", "source", "n_chars", F.lower(normalize_text(F.col("text"))).alias("sig"))
    return keep_first(sig, "sig", F.col("doc_id"), payload=["doc_id", "lang", "source", "n_chars"])


@register("dedup_null_and_repeated_ids")
def dedup_null_and_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-first where a fifth of the rows have no order key and the others share theirs in pairs: one
    row of each signature stays, with the smallest key there is."""
    docs = read_table(spark, sf_dir, "documents")
    key = F.when(F.col("doc_id") % 5 != 0, F.floor(F.col("doc_id") / 2))
    sig = docs.select(key.cast("long").alias("id"), F.lower(normalize_text(F.col("text"))).alias("sig"))
    return keep_first(sig, "sig", F.col("id"), payload=["id", "sig"]).select("id", F.md5("sig").alias("signature"))


@register("dedup_across_sources")
def dedup_across_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduped_sources(spark, sf_dir)
    return example_view(kept, ("row_ref",))


def _signed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union with its signatures, written once as in the build. (Computing a signature where its
    texts are not kept trips Spark's code generator, which then runs the stage interpreted.)"""
    return materialize(numbered(union_sources(spark, sf_dir).withColumn("signature", example_signature())), "source-union")


@register("source_counts")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    union = _signed_union(spark, sf_dir)
    before = union.groupBy("source").agg(F.count(F.lit(1)).alias("n_before"))
    kept = keep_first(union, "signature", staged=True, payload=["source"])
    after = kept.groupBy("source").agg(F.count(F.lit(1)).alias("n_after"))
    return before.join(after, "source", "left").select(
        "source", "n_before", F.coalesce("n_after", F.lit(0)).cast("long").alias("n_after"))


@register("sample_exact_n")
def sample_exact_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sample_exact(docs, SAMPLE_N, DEFAULT_SEED, "doc_id")


@register("split_assignment")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = materialize(dedup_keep_first_documents(spark, sf_dir).select("doc_id"), "split-docs")
    labelled, _, _ = exact_split(kept, DEFAULT_SEED, DEFAULT_VALIDATION_RATIO, "doc_id")
    return labelled


@register("split_sizes")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    union = _signed_union(spark, sf_dir)
    kept = materialize(keep_first(union, "signature", staged=True, payload=["signature", "source"]), "split-examples")
    labelled, _, _ = exact_split(kept, DEFAULT_SEED, DEFAULT_VALIDATION_RATIO, "signature")
    return labelled.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- files: JSONL shapes, CSV, custom folder, JSONL splits, report ----------------------------

JSONL_SOURCE = "jsonl"
CSV_SOURCE = "csv:pairs"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl_lines(read_table(spark, sf_dir, "conversations"), DEFAULT_SYSTEM_PROMPT)


@register("jsonl_shape_dispatch")
def jsonl_shape_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape label of every line (``sub = -1``) plus every example the lines yield."""
    from chatsift.functions.json_shapes import shape_label

    lines = _lines(spark, sf_dir)
    labels = lines.select(
        "line_id", shape_label("value").alias("shape"),
        F.lit(-1).cast("long").alias("sub"), F.lit(None).cast("string").alias("prompt_text"),
        F.lit(None).cast("string").alias("completion_text"))
    ex = jsonl_examples(lines, system_prompt=DEFAULT_SYSTEM_PROMPT, k=8, source=JSONL_SOURCE)
    view = example_view(ex.withColumn("sub", F.col("sub").cast("long")), ("line_id", "shape", "sub"))
    return labels.unionByName(view.select("line_id", "shape", "sub", "prompt_text", "completion_text"))


CSV_FILES = 4


def _write_pairs_csv(df: DataFrame, path: str, header: str = "input,output") -> None:
    """``CSV_FILES`` CSV files: a header line (every other one ending in CRLF), quoted fields, CRLF and
    LF row ends mixed, and after every tenth row or so a row of three fields."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in ("input", "output")]
    n = F.col("conv_id") + F.col("turn")
    row = F.concat_ws(",", *quoted)
    value = F.concat(
        F.when(n % 10 == 0, F.concat(row, F.lit(",extra\n"))).otherwise(F.lit("")), row,
        F.when(F.col("turn") % 3 == 0, F.lit("\r")).otherwise(F.lit("")))
    rows = df.select(F.pmod(n, F.lit(CSV_FILES)).cast("int").alias("p"), F.lit(1).alias("o"), value.alias("value"))
    heads = df.sparkSession.range(CSV_FILES).select(
        F.col("id").cast("int").alias("p"), F.lit(0).alias("o"),
        F.concat(F.lit(header), F.when(F.col("id") % 2 == 0, F.lit("\r")).otherwise(F.lit(""))).alias("value"))
    (heads.unionByName(rows).repartitionById(CSV_FILES, F.col("p")).sortWithinPartitions("o").select("value")
     .write.mode("overwrite").option("compression", "none").text(path))


@register("csv_pairs_round_trip")
def csv_pairs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with quotes, newlines and missing-value tokens -> CSV files -> header-checked scan
    -> examples."""
    path = scratch_path(spark, "csv-pairs")
    _write_pairs_csv(csv_pairs(read_table(spark, sf_dir, "conversations")), path)
    parts = files.list_files(spark, path, "part-*")
    raw = read_pair_csv(spark, parts)
    ex = pair_examples(raw, "input", "output", system_prompt=DEFAULT_SYSTEM_PROMPT, source=CSV_SOURCE)
    return example_view(ex)


def _write_custom_folder(spark: SparkSession, sf_dir: str) -> tuple[str, set[str]]:
    """A folder of CSV and JSONL files written by Spark from the driver tables: good headers, a
    reordered header (skipped), a case/space variant header (accepted), an ignored local file and
    JSONL lines of every shape. Part files are renamed to stable names."""
    turns = read_table(spark, sf_dir, "conversations")
    pairs = csv_pairs(turns)
    folder = scratch_path(spark, "custom")
    files.mkdirs(spark, folder)
    # every pair lands in one of the two used files; the reordered-header file (skipped by the
    # header gate) and the ignored local file are extra full copies
    groups = {
        "a_pairs": (pairs.where(F.col("conv_id") % 2 == 0), "input,output"),
        "b_reordered": (pairs, "output,input"),
        "c_variant": (pairs.where(F.col("conv_id") % 2 == 1), "Input,Output "),
        "z_local": (pairs, "input,output"),
    }
    ignored = set()
    for name, (df, header) in groups.items():
        tmp = f"{folder}/_tmp_{name}"
        _write_pairs_csv(df, tmp, header)
        for i, part in enumerate(files.list_files(spark, tmp, "part-*")):
            target = f"{name}-{i:05d}.csv"
            files.rename(spark, part, f"{folder}/{target}")
            if name == "z_local":
                ignored.add(target)
    tmp = f"{folder}/_tmp_lines"
    # the broken lines hold raw line ends: one line of the file each
    one_line = F.translate("value", "\n\r", "  ").alias("value")
    _lines(spark, sf_dir).select(one_line).write.mode("overwrite").option("compression", "none").text(tmp)
    for i, part in enumerate(files.list_files(spark, tmp, "part-*")):
        files.rename(spark, part, f"{folder}/e_lines-{i:05d}.jsonl")
    return folder, ignored


@register("custom_directory_scan")
def custom_directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, ignored = _write_custom_folder(spark, sf_dir)
    ex, _ = load_custom_dir(spark, folder, system_prompt=DEFAULT_SYSTEM_PROMPT, k=8, ignored=ignored)
    group = F.regexp_extract(F.col("source"), r"^custom:([a-z_]+)-\d+\.(csv|jsonl)$", 1)
    return example_view(ex.withColumn("source", group))


@register("rejected_rows")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every JSON line that yields nothing or less than it holds, with the reason."""
    return rejected_lines(_lines(spark, sf_dir), keep=("line_id",))


@register("custom_directory_rejects")
def custom_directory_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected lines, rows and files of the custom folder, counted by group of files and reason."""
    folder, ignored = _write_custom_folder(spark, sf_dir)
    _, report = load_custom_dir(spark, folder, system_prompt=DEFAULT_SYSTEM_PROMPT, k=8, ignored=ignored)
    group = F.regexp_extract("file_name", r"^([a-z_]+)-", 1)
    return report["rejects"].groupBy(group.alias("files"), "reason").agg(F.count(F.lit(1)).alias("n"))


TURN_SOURCE = "conversations:turn_pairs"


def _turn_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Each user turn and the reply after it, the reply prefixed so that it is a pair of its own."""
    pairs = adjacent_pairs(read_table(spark, sf_dir, "conversations"))
    return pairs.select((F.col("conv_id") * 1_000_000_000 + F.col("turn")).alias("pair_key"), F.col("input").alias("user_message"),
                        F.when(F.col("turn") % 4 == 0, F.col("output")).otherwise(F.concat(F.lit("well, "), F.col("output")))
                        .alias("assistant_message")), "pair_key"


def _build_sources(spark: SparkSession, sf_dir: str, turn_pairs: bool = False) -> Sources:
    turns = read_table(spark, sf_dir, "conversations")
    pairs = adjacent_pairs(turns).withColumn("pair_key", F.col("conv_id") * 1_000_000_000 + F.col("turn"))
    docs = read_table(spark, sf_dir, "documents")
    trans = translation_pairs(docs).select("doc_id", F.col("src_text").alias("hi"), F.col("target_text").alias("hi_rom"))
    return Sources(
        pairs=(pairs, "pair_key"), chat_turns=(turns, "conv_id"), translation=(trans, "doc_id"),
        turn_pairs=_turn_pairs(spark, sf_dir) if turn_pairs else None,
        tags={"pairs": PAIR_SOURCE, "turn_pairs": TURN_SOURCE, "chat": CHAT_SOURCE,
              "translation": TRANSLATION_SOURCE},
    )


@register("jsonl_round_trip")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full build -> train/validation JSONL -> read back both splits."""
    out = scratch_path(spark, "build")
    build_dataset(spark, BuildConfig(output_dir=out), _build_sources(spark, sf_dir))
    back = read_splits(spark, {"train": f"{out}/train.jsonl", "validation": f"{out}/validation.jsonl"})
    return example_view(back, ("split",))


@register("build_report")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = build_dataset(spark, BuildConfig(), _build_sources(spark, sf_dir), write=False)

    def flat(m):
        return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")

    return res.report.select(
        "train_rows", "validation_rows", "total_rows_after_dedup",
        flat("source_counts_before_dedup").alias("counts_before"),
        flat("source_counts_after_dedup").alias("counts_after"),
        F.size("notes").cast("long").alias("n_notes"), "rejected_rows",
    )


def _group_of(source):
    return F.regexp_replace(source, r"-[0-9]+[.](csv|jsonl)$", "")


@register("six_source_counts")
def six_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole priority union, twice: with a local pair file (it replaces the pair table and is hidden
    from the custom folder) and a custom folder of CSV and JSONL files; and with neither file there."""
    folder, _ = _write_custom_folder(spark, sf_dir)
    out = None
    for name, cfg in {
        "files": BuildConfig(custom_dir=folder, local_pair_file=f"{folder}/z_local-00000.csv"),
        "missing": BuildConfig(custom_dir=f"{folder}/none", local_pair_file=f"{folder}/none.csv"),
    }.items():
        union, _ = build_examples(spark, cfg, _build_sources(spark, sf_dir, turn_pairs=True))
        union = materialize(numbered(union.withColumn("signature", example_signature())), "six-sources")
        before = union.groupBy(_group_of("source").alias("source")).agg(F.count(F.lit(1)).alias("n_before"))
        after = keep_first(union, "signature", staged=True, payload=["source"]).groupBy(_group_of("source").alias("source")).agg(
            F.count(F.lit(1)).alias("n_after"))
        part = before.join(after, "source", "left").select(
            F.lit(name).alias("variant"), "source", "n_before", F.coalesce("n_after", F.lit(0)).cast("long").alias("n_after"))
        out = part if out is None else out.unionByName(part)
    return out


@register("examples_turn_pairs")
def examples_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn-pair source (``user_message, assistant_message``) through the build's own union."""
    src = Sources(turn_pairs=_turn_pairs(spark, sf_dir), tags={"turn_pairs": TURN_SOURCE})
    union, _ = build_examples(spark, BuildConfig(), src)
    return example_view(union.withColumn("pair_key", F.col("_order.row_pos")), ("pair_key",))


CAPS = {"cap_pairs": 60, "cap_turn_pairs": 0, "cap_chat": 12, "cap_translation": 150}


@register("capped_build")
def capped_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit caps, as seeded exact samples: on raw rows, on conversations, and none of a source."""
    union, _ = build_examples(spark, BuildConfig(**CAPS), _build_sources(spark, sf_dir, turn_pairs=True))
    return example_view(union)


@register("split_summary")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split, counted from the written JSONL splits."""
    out = scratch_path(spark, "build")
    build_dataset(spark, BuildConfig(output_dir=out), _build_sources(spark, sf_dir))
    return split_counts(read_splits(spark, {"train": f"{out}/train.jsonl", "validation": f"{out}/validation.jsonl"}))


# ---- chat requests ----------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_requests(read_table(spark, sf_dir, "conversations"), read_table(spark, sf_dir, "events"))


def _valid_assembled(spark: SparkSession, sf_dir: str, cfg: ChatConfig = ChatConfig()) -> DataFrame:
    valid = rq.validate_requests(_requests(spark, sf_dir)).where("is_valid")
    return rq.assemble_messages(rq.with_defaults(valid, cfg), cfg)


@register("request_validation")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rq.validate_requests(_requests(spark, sf_dir))
    return v.select("request_id", "is_valid", F.array_join("violations", ",").alias("violations"),
                    rq.is_text_message("message").alias("processed"))


@register("request_defaults")
def request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rq.with_defaults(event_requests(read_table(spark, sf_dir, "events")))
    return d.select("request_id", "max_new_tokens_eff", "temperature_eff", "top_p_eff", "system_prompt_eff", "model")


@register("request_assembly")
def request_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _valid_assembled(spark, sf_dir)
    return a.select("request_id", F.size("messages").cast("long").alias("n_messages"),
                    render_messages("messages").alias("messages_text"))


@register("render_prompt")
def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.render_prompts(_valid_assembled(spark, sf_dir)).select("request_id", "prompt")


@register("history_clip")
def history_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories longer than two turns are clipped; the requests were validated whole."""
    a = _valid_assembled(spark, sf_dir, ChatConfig(max_history_turns=2))
    return a.select("request_id", F.size("history").cast("long").alias("n_raw"),
                    F.size("messages").cast("long").alias("n_messages"), render_messages("messages").alias("messages_text"))


@register("model_choice")
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged model, else adapter, else base model, from columns that are null, empty or set."""
    events = read_table(spark, sf_dir, "events")
    merged = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("merged/"), F.col("event_type"))).when(F.col("event_id") % 3 == 1, F.lit(""))
    adapter = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("adapter/"), F.col("props"))).when(F.col("event_id") % 4 == 1, F.lit(""))
    return events.select("event_id", rq.model_reference(merged, adapter, F.concat(F.lit("base/"), F.col("event_type"))).alias("model"))


@register("apply_replies")
def apply_replies_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = rq.validate_requests(_requests(spark, sf_dir)).where("is_valid")
    out = rq.apply_replies(valid, chat_replies(read_table(spark, sf_dir, "conversations")))
    return out.select("request_id", "status", "response_clean", render_messages("new_history").alias("history_text"),
                      F.size("new_history").cast("long").alias("n_history"))


# ---- chat sessions ----------------------------------------------------------------------------


def _session_view(df: DataFrame) -> DataFrame:
    if "late" in df.columns:
        df = df.where("not late")
    return df.select(
        (F.col("seq") / 4).cast("long").alias("event_id"), F.col("chat_id").alias("user_id"), "message",
        F.size("history").cast("long").alias("n_history"), render_messages("history").alias("history_text"))


@register("session_context_batch")
def session_context_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_view(ss.session_requests_batch(chat_events(read_table(spark, sf_dir, "events"))))


SESSION_START = "2024-01-15 00:00:00"


@register("session_from_now")
def session_from_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session stream that starts at a point in time: events before it are ignored, so histories
    begin empty there."""
    from datetime import datetime

    src = scratch_path(spark, "chat-events")
    chat_events(read_table(spark, sf_dir, "events"), keep=("ts",)).write.mode("overwrite").parquet(src)
    out = scratch_path(spark, "session-out")
    stream = ss.event_stream(spark, src, schema=f"{ss.EVENT_SCHEMA}, ts timestamp_ntz", ts_col="ts",
                             start_ts=datetime.fromisoformat(SESSION_START))
    ss.run_available(stream, out, scratch_path(spark, "session-ckpt"))
    return _session_view(spark.read.parquet(out))


EPOCH = 1_700_000_000


def _event_waves(spark: SparkSession, sf_dir: str, folder: str, where: str, names: list[str], wave) -> None:
    """Chat events with a time of their own (``ts``: their seq in seconds), written as finished sub-folders."""
    events = read_table(spark, sf_dir, "events").where(where).repartition("event_id")  # the table may be one file
    events = chat_events(events).withColumn("ts", F.timestamp_seconds(F.col("seq") + EPOCH))
    events = materialize(events.withColumn("wave", wave(events)), "event-waves")
    for i, name in enumerate(names):
        events.where(F.col("wave") == i).drop("wave").write.parquet(f"{folder}/{name}")


@register("session_starts_at_end")
def session_starts_at_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session stream over a growing folder that holds a backlog when the stream starts: the backlog is not
    read, whatever its times, and what is written later is, in two waves."""
    folder, out, log = (scratch_path(spark, n) for n in ("chat-folder", "session-out", "folder-log"))
    _event_waves(spark, sf_dir, folder, f"ts < TIMESTAMP_NTZ '{SESSION_START}'", ["a-backlog"], lambda e: F.lit(0))
    q = ss.session_requests(from_now(spark, folder, ss.EVENT_SCHEMA, log)).writeStream.format("parquet").option(
        "path", out).option("checkpointLocation", scratch_path(spark, "session-ckpt")).start()
    try:
        q.processAllAvailable()
        _event_waves(spark, sf_dir, folder, f"ts >= TIMESTAMP_NTZ '{SESSION_START}'", ["b-first", "c-second"],
                     lambda e: F.when(F.col("seq") <= e.agg(F.avg("seq")).first()[0], 0).otherwise(1))
        q.processAllAvailable()
    finally:
        q.stop()
    return _session_view(spark.read.parquet(out))


WAVES, LATE_WAVES, WAVE_DELAY = 4, 3, 2  # the watermark stays two waves' time behind


def _wave_span(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Event numbers of a wave, and how many waves they fill with the last slow replies and their delay."""
    last = 4 * (read_table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0)
    span = last // WAVES + 1
    return span, (last + 4 * SLOW_EVENTS + 4) // span + 2


def _caught_up(writer, spark: SparkSession | None = None) -> None:
    """Run a stream until it has processed all that is there; with ``spark``, without batches in between
    that only move the watermark."""
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting) if spark else None
    if spark:
        spark.conf.set(setting, "false")
    q = writer.start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
        if spark:
            spark.conf.set(setting, before)


@register("session_out_of_order")
def session_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time sessions from waves that hold each other's events, one wave a micro-batch: a third of the events
    comes a wave late, within the delay, and some of the first wave come so late that the watermark has
    passed them; those are late rows."""
    folder, out, log = (scratch_path(spark, n) for n in ("chat-folder", "session-out", "folder-log"))
    span, waves = _wave_span(spark, sf_dir)
    event, own = F.floor(F.col("seq") / 4), F.floor(F.col("seq") / span)
    behind = (F.when((event % 37 == 0) & (event % 5 != 0) & (8 * event < span), LATE_WAVES)
              .when(F.col("seq") % 3 == 0, 1).otherwise(0))
    _event_waves(spark, sf_dir, folder, "true", [f"w{i:02d}" for i in range(waves)], lambda e: (own + behind).cast("int"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("seq"), F.lit(-1).cast("long").alias("chat_id"), F.lit("start").alias("kind"),
                                F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("reply_to"),
                                F.timestamp_seconds(F.lit(EPOCH + 100 * WAVES * span)).alias("ts"))
    for name in ("x-end", "y-end"):  # a time past all others, and a batch that sees it: every event becomes due
        end.write.parquet(f"{folder}/{name}")
    stream = from_now(spark, folder, TIMED_SCHEMA, log, starting="earliest", max_entries=1)
    _caught_up(session_requests_by_event_time(stream, f"{WAVE_DELAY * span} seconds").writeStream.format("parquet").option(
        "path", out).option("checkpointLocation", scratch_path(spark, "session-ckpt")), spark)
    rows = spark.read.parquet(out)
    late = rows.where("late").select(
        F.col("seq").alias("event_id"), F.col("chat_id").alias("user_id"), "message", F.lit(None).cast("long").alias("n_history"),
        F.lit(None).cast("string").alias("history_text"), "late")
    return _session_view(rows).withColumn("late", F.lit(False)).unionByName(late)


@register("session_micro_batches")
def session_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches through the batch operators, with a third of all users in one chat."""
    folder, log = scratch_path(spark, "chat-folder"), scratch_path(spark, "folder-log")
    events = read_table(spark, sf_dir, "events").withColumn(
        "user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    events = materialize(chat_events(events.repartition("event_id")), "chat-events")  # the table may be one file
    half = events.agg(F.avg("seq")).first()[0] or 0
    events.where(F.col("seq") <= half).write.parquet(f"{folder}/a")
    events.where(F.col("seq") > half).write.parquet(f"{folder}/b")
    store = SessionStore(spark, scratch_path(spark, "session-store"))
    stream = from_now(spark, folder, ss.EVENT_SCHEMA, log, starting="earliest", max_entries=1)
    _caught_up(stream.writeStream.foreachBatch(store.apply).option("checkpointLocation", scratch_path(spark, "session-ckpt")))
    return _session_view(store.requests())


@register("session_context_stream")
def session_context_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests from the stateful stream: events are written as a file source, processed
    with ``availableNow`` into a parquet sink, and the sink is read back."""
    src = scratch_path(spark, "chat-events")
    chat_events(read_table(spark, sf_dir, "events")).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(ss.EVENT_SCHEMA).parquet(src)
    out = scratch_path(spark, "session-out")
    ss.run_available(stream, out, scratch_path(spark, "session-ckpt"))
    return _session_view(spark.read.parquet(out))
