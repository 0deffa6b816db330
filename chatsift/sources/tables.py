"""Table scans and the pair/turn/chat/translation source shapes (column maps + templates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.functions.messages import message


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_source(spark: SparkSession, ref: str, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """A named dataset for the build: a catalog table (``db.table``) or a path/glob of Parquet,
    JSON lines or CSV (with header) files; the format comes from ``fmt`` or the file extension.
    Give ``schema`` for JSON/CSV to avoid an inference pass over the data."""
    if fmt is None and "/" not in ref and "." in ref and not ref.endswith((".parquet", ".json", ".jsonl", ".csv")):
        return spark.table(ref)
    kind = fmt or ("json" if ref.endswith((".json", ".jsonl")) else "csv" if ref.endswith(".csv") else "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.options(header=True, multiLine=True, quote='"', escape='"').csv(ref)
    if kind == "json":
        return reader.json(ref)
    return reader.parquet(ref)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pair_examples(df: DataFrame, user: Column | str, assistant: Column | str, *, system_prompt: str,
                  source: Column | str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pair rows -> examples: prompt ``[system, user]``, completion ``[assistant]``, cleaned and
    validated. Used for input/output pairs, turn pairs, translation pairs and CSV files.

    Same result as cleaning the two arrays generically, computed directly: the roles are
    constants, so the user text is valid iff it normalises to 2..1200 characters (which also
    makes it non-empty and present), likewise the reply, and the constant system message is
    normalised once per plan. Each text is normalised once, inside a one-element array that is
    filtered and unpacked with ``inline`` (a ``where`` would be pushed below the projection and
    normalise again), the reply only where the user text passed.
    """
    from chatsift.functions.messages import constant_system
    from chatsift.functions.text import is_valid_length, normalize_text

    src = F.lit(source) if isinstance(source, str) else source
    # the reply is normalised inside the lambda, so only for user texts that passed
    asked = F.filter(F.array(normalize_text(_c(user))), lambda u: is_valid_length(u))
    pairs = F.transform(asked, lambda u: F.struct(u.alias("u"), normalize_text(_c(assistant)).alias("a")))
    staged = df.select(*keep, F.inline(F.filter(pairs, lambda e: is_valid_length(e["a"]))), src.alias("source"))
    return staged.select(
        *keep,
        F.concat(constant_system(df.sparkSession, system_prompt), F.array(message(F.lit("user"), F.col("u")))).alias("prompt"),
        F.array(message(F.lit("assistant"), F.col("a"))).alias("completion"),
        "source",
    )


def instruction_examples(df: DataFrame, text: Column | str, target: Column | str, *, instruction: str,
                         system_prompt: str, source: Column | str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Translation pairs -> examples: the user message is ``instruction + LF + text``. A missing
    source text drops the row (the original would have embedded the word None)."""
    staged = df.where(_c(text).isNotNull())
    user = F.concat(F.lit(instruction), F.lit("\n"), _c(text).cast("string"))
    return pair_examples(staged, user, target, system_prompt=system_prompt, source=source, keep=keep)
