"""CSV pair files, mixed-shape JSONL files and the custom-data folder.

Row order inside a file is carried as ``(file_name, file_block_start, monotonically_increasing_id)``:
within one split rows keep their file order and a later split of the same file starts at a larger
offset, so this orders the lines of every file exactly without numbering them on the driver.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatsift.config import CSV_HEADER, NA_TOKENS
from chatsift.functions.json_shapes import parsed_lines
from chatsift.functions.messages import (
    EXAMPLE,
    clean_messages,
    empty_messages,
    example_is_valid,
    message,
)
from chatsift.functions.text import clean_role, normalize_text, py_strip
from chatsift.operators.context import system_messages
from chatsift.operators.dedup import ORDER, ordered
from chatsift.session import materialize
from chatsift.sources import files
from chatsift.sources.csv_records import csv_records


class SchemaError(ValueError):
    """A pair file whose header is not ``input,output``."""


def header_ok(line: str) -> bool:
    return line.strip().lower() == CSV_HEADER


def _positions(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "file_name": F.col("_metadata.file_name"),
            "block": F.col("_metadata.file_block_start"),
            "pos": F.monotonically_increasing_id(),
        }
    )


def _whole_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV rows of files whose fields hold no line ends, by the plain reader (rows end with LF; the CR of a
    CRLF file, or of some rows of a mixed one, is trimmed afterwards)."""
    rows = _positions(spark.read.options(
        header=True, quote='"', escape='"', encoding="UTF-8", mode="PERMISSIVE", lineSep="\n", columnNameOfCorruptRecord="_corrupt",
    ).schema("input string, output string, _corrupt string").csv(paths))
    output = F.when(F.col("output").endswith("\r"), F.expr("substring(output, 1, length(output) - 1)")).otherwise(F.col("output"))
    return rows.withColumn("output", output).withColumnRenamed("_corrupt", "record")


def pair_csv_rows(spark: SparkSession, paths: list[str] | str, *, multi_line: bool = True) -> DataFrame:
    """All rows of RFC-4180 pair CSV files, written once to a table: ``input, output, file_name, block, pos,
    record``. ``record`` is the row's text where it has a wrong number of fields (a row without texts), else
    null; pandas' missing-value tokens become null.

    Files are split over tasks and quoted fields may hold line ends (``csv_records``); a caller who knows
    that no field holds one can pass ``multi_line=False``, which saves a look at the quotes."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if multi_line:
        options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "columnNameOfCorruptRecord": "_corrupt"}
        fields = F.from_csv("record", "input string, output string, _corrupt string", options)
        rows = csv_records(spark, paths).select("file_name", "block", "pos", F.inline(F.array(fields)))
        rows = rows.withColumnRenamed("_corrupt", "record")
    else:
        rows = _whole_lines(spark, paths)
    ok, na = F.col("record").isNull(), list(NA_TOKENS)
    # a malformed row keeps its place (it is a raw row for seeded caps) but has no texts, so it
    # never becomes an example
    return materialize(rows.select(
        F.when(ok & ~F.col("input").isin(*na), F.col("input")).alias("input"),
        F.when(ok & ~F.col("output").isin(*na), F.col("output")).alias("output"), "file_name", "block", "pos", "record",
    ), "pair-rows")


def read_pair_csv(spark: SparkSession, paths: list[str] | str, *, check_header: bool = True,
                  on_malformed: str = "quarantine", multi_line: bool = True) -> DataFrame:
    """Pair CSV files with header ``input,output`` (BOM, case and edge spaces tolerated), as ``pair_csv_rows``.

    LF and CRLF row ends may be mixed within a file; a file whose only line ends are CR has no
    readable header. Raises ``SchemaError`` naming the file if a header does not match (a Git-LFS
    pointer, a reordered header ...) instead of mapping columns by position silently. Rows with a
    wrong number of fields get no texts (``quarantine``; their ``record`` says what they hold) or fail
    the job (``failfast``); a short row would have lost its output and been dropped anyway."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if on_malformed not in ("failfast", "quarantine"):
        raise ValueError(f"unknown on_malformed {on_malformed!r}")
    if check_header:
        found = files.first_lines(spark, paths)
        for p in paths:
            line = found[posixpath.basename(p)]
            if not header_ok(line):
                raise SchemaError(f"{p}: expected header 'input,output', found {line[:80]!r}")
    rows = pair_csv_rows(spark, paths, multi_line=multi_line)
    if on_malformed == "failfast":
        bad = rows.where("record is not null").select("file_name", "record").first()
        if bad is not None:
            raise ValueError(f"{bad.file_name}: wrong number of fields in {bad.record[:80]!r}")
    return rows


def malformed_rows(rows: DataFrame) -> DataFrame:
    """The rejects among rows of ``read_pair_csv``: ``file_name, reason, record``."""
    return rows.where("record is not null").select("file_name", F.lit("field_count").alias("reason"), "record")


def malformed_pair_rows(spark: SparkSession, paths: list[str] | str, multi_line: bool = True) -> DataFrame:
    """The quarantined rows of pair CSV files (wrong number of fields): ``file_name, pos, record``."""
    return pair_csv_rows(spark, paths, multi_line=multi_line).where("record is not null").select("file_name", "pos", "record")


REJECTS = "file_name string, reason string, record string"


def rejected_lines(lines: DataFrame, keep: tuple[str, ...] = ("file_name",)) -> DataFrame:
    """JSON lines that yield nothing, or less than they hold: ``keep..., reason, record``."""
    return parsed_lines(lines).where(F.col("reason").isNotNull()).select(*keep, "reason", F.col("value").alias("record"))


def read_jsonl(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row per line: ``value, file_name, block, pos``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _positions(spark.read.option("encoding", "UTF-8").text(paths))


def jsonl_examples(lines: DataFrame, *, system_prompt: str, k: int, source: Column | str,
                   mode: str = "quarantine", parsed: DataFrame | None = None) -> DataFrame:
    """Mixed JSON lines -> examples in one pass (one scan, no union, no shuffle).

    Adds ``shape`` and ``sub`` (example index within the line). Pair-like shapes yield one
    candidate, ``messages`` yields one per reply that follows a user message (context of the last
    ``k`` cleaned messages, 0 = all). Blank, other and invalid lines yield none; with
    ``mode='failfast'`` an invalid line fails the job like the original tool. ``parsed`` gives the
    ``parsed_lines`` of ``lines`` where they are there already.
    """
    if mode not in ("quarantine", "failfast"):
        raise ValueError(f"unknown mode {mode!r}")
    src = F.lit(source) if isinstance(source, str) else source
    keep = [c for c in lines.columns if c != "value"]
    staged = (parsed_lines(lines) if parsed is None else parsed).withColumn("source", src)
    if mode == "failfast":
        where = F.concat(F.lit(" in a JSON line of "), F.col("file_name") if "file_name" in keep else F.lit("the input"))
        staged = staged.withColumn("shape", F.when(F.col("reason").isin("invalid_json", "bad_message"), F.raise_error(
            F.concat("reason", where))).otherwise(F.col("shape")))
    sys_msgs = system_messages(system_prompt, lines.sparkSession)

    def pair(user: Column, assistant: Column) -> Column:
        # roles are constants: clean by normalising the two texts and dropping empty messages
        def one(role: str, text: Column) -> Column:
            return F.filter(F.array(message(F.lit(role), normalize_text(text))), lambda m: m["content"] != F.lit(""))

        return F.struct(F.concat(sys_msgs, one("user", user)).alias("prompt"),
                        one("assistant", assistant).alias("completion"))

    # cleaned messages of the conversation shape, computed once per line
    staged = staged.withColumn(
        "_r",
        F.when(
            F.col("shape") == "messages",
            F.filter(
                F.transform(F.coalesce("first", empty_messages()),
                            lambda m: message(clean_role(m["role"]), normalize_text(m["content"]))),
                lambda m: m["role"].isin("user", "assistant") & (m["content"] != F.lit("")),
            ),
        ),
    )
    r = F.col("_r")
    replies = F.filter(
        F.sequence(F.lit(2), F.greatest(F.size(r), F.lit(2))),
        lambda i: (F.size(r) >= i)
        & (F.element_at(r, i)["role"] == F.lit("assistant"))
        & (F.element_at(r, i - 1)["role"] == F.lit("user")),
    )

    def conv_candidate(i: Column) -> Column:
        start = F.greatest(i - F.lit(k), F.lit(1)) if k > 0 else F.lit(1)
        return F.struct(
            F.concat(sys_msgs, F.slice(r, start, i - start)).alias("prompt"),
            F.array(F.element_at(r, i)).alias("completion"),
        )

    # two texts of a pair, whichever names they have: one expression normalises them
    user = F.when(F.col("shape") == "input_output", F.col("input")).otherwise(F.col("user"))
    assistant = F.when(F.col("shape") == "input_output", F.col("output")).otherwise(F.col("assistant"))
    candidates = (
        F.when(F.col("shape") == "prompt_completion", F.array(F.struct(
            clean_messages(F.col("first")).alias("prompt"),
            clean_messages(F.col("second"), ("assistant",)).alias("completion"))))
        .when(F.col("shape").isin("input_output", "user_assistant"), F.array(pair(user, assistant)))
        .when(F.col("shape") == "messages", F.transform(replies, conv_candidate))
    )
    exploded = staged.select(
        *keep, "shape", "source",
        F.posexplode(F.coalesce(candidates, F.array().cast(
            T.ArrayType(T.StructType([T.StructField("prompt", EXAMPLE["prompt"].dataType),
                                      T.StructField("completion", EXAMPLE["completion"].dataType)]))))
        ).alias("sub", "c"),
    )
    return exploded.select(
        *keep, "shape", "sub",
        F.col("c.prompt").alias("prompt"), F.col("c.completion").alias("completion"), "source",
    ).where(example_is_valid("prompt", "completion"))


def _empty_examples(spark: SparkSession) -> DataFrame:
    schema = T.StructType(list(EXAMPLE.fields) + [T.StructField(ORDER, T.StructType([
        T.StructField("source_rank", T.IntegerType()), T.StructField("file_name", T.StringType()),
        T.StructField("block", T.LongType()), T.StructField("row_pos", T.LongType()), T.StructField("row_key", T.StringType()),
        T.StructField("sub_pos", T.LongType())]))])
    return spark.createDataFrame([], schema)


def load_custom_dir(spark: SparkSession, folder: str, *, system_prompt: str, k: int,
                    ignored: set[str] | frozenset = frozenset(), csv_rank: int = 4, jsonl_rank: int = 5,
                    mode: str = "quarantine", multi_line: bool = True) -> tuple[DataFrame, dict]:
    """All ``*.csv`` (header-gated) then all ``*.jsonl`` files directly in ``folder``, each sorted
    by name, files whose base name is in ``ignored`` left out. Source tag ``custom:<file name>``.
    A missing folder gives no rows. Returns (examples with ``_order``, report of files); the report's
    ``rejects`` is a frame of the rejected lines, rows and files (``file_name, reason, record``)."""
    from chatsift.sources.tables import pair_examples

    report = {"csv_used": [], "csv_skipped_header": [], "csv_ignored": [], "jsonl_used": [],
              "rejects": spark.createDataFrame([], REJECTS)}
    if not files.exists(spark, folder):
        return _empty_examples(spark), report
    frames = []
    csv_paths, skipped = [], []
    found = [(posixpath.basename(p), p) for p in files.list_files(spark, folder, "*.csv")]
    report["csv_ignored"] = [name for name, _ in found if name in ignored]
    found = [(name, p) for name, p in found if name not in ignored]
    headers = files.first_lines(spark, [p for _, p in found])
    for name, p in found:
        if header_ok(headers[name]):
            csv_paths.append(p)
            report["csv_used"].append(name)
        else:
            skipped.append((name, "header", headers[name]))
            report["csv_skipped_header"].append(name)
    if skipped:
        report["rejects"] = report["rejects"].unionByName(spark.createDataFrame(skipped, REJECTS))
    if csv_paths:
        raw = read_pair_csv(spark, csv_paths, check_header=False, on_malformed=mode, multi_line=multi_line)
        report["rejects"] = report["rejects"].unionByName(malformed_rows(raw))
        ex = pair_examples(raw, "input", "output", system_prompt=system_prompt,
                           source=F.concat(F.lit("custom:"), F.col("file_name")),
                           keep=("file_name", "block", "pos"))
        frames.append(ordered(ex, csv_rank, "file_name", pos="pos", block="block").select(*EXAMPLE.names, ORDER))
    jsonl_paths = files.list_files(spark, folder, "*.jsonl")
    report["jsonl_used"] = [posixpath.basename(p) for p in jsonl_paths]
    if jsonl_paths:
        # parsed once: the examples and the rejects both read the table
        lines = materialize(parsed_lines(read_jsonl(spark, jsonl_paths)), "parsed-lines")
        report["rejects"] = report["rejects"].unionByName(lines.where("reason is not null").select(
            "file_name", "reason", F.col("value").alias("record")))
        ex = jsonl_examples(lines.select("value", "file_name", "block", "pos"), system_prompt=system_prompt, k=k,
                            source=F.concat(F.lit("custom:"), F.col("file_name")), mode=mode, parsed=lines)
        frames.append(ordered(ex, jsonl_rank, "file_name", pos="pos", sub="sub", block="block")
                      .select(*EXAMPLE.names, ORDER))
    if not frames:
        return _empty_examples(spark), report
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out, report


__all__ = [
    "SchemaError", "header_ok", "jsonl_examples", "load_custom_dir", "malformed_pair_rows", "malformed_rows", "pair_csv_rows",
    "read_jsonl", "read_pair_csv", "rejected_lines",
]
