"""Corpus pipeline: language ID, near-duplicates, decontamination, personal data, source mixing.

Each stage takes the documents its predecessor kept and returns the documents it keeps, with the same
columns; the last adds the place of each document in the mixture (``mix_`` columns).

Rows are told apart by a digest of all their columns, so null and repeated ids are checked like any
other: each row by its own values. Of rows equal in every column the duplicate stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.llm import decontamination, language_id, mixing, pii_crf, simhash
from chatsift.llm.common import bounded_batches, stage, table

BROADCAST_ROWS = 1_000_000  # a set of row keys is broadcast up to this size, joined by a shuffle beyond
KEYS = ("pipeline_row1", "pipeline_row2")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the row keys: 96 bits of digest over all columns."""
    cols = [F.col(f"`{c}`") for c in docs.columns if c not in KEYS]
    return docs.withColumns({KEYS[0]: F.xxhash64(*cols), KEYS[1]: F.hash(*cols[::-1])})


def _small(table: DataFrame, name: str) -> DataFrame:
    """``table`` written once, and broadcast where it is small."""
    table = stage(table, name)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose keys are not in ``gone``."""
    return keyed.join(_small(gone.select(*KEYS).distinct(), "gone"), [*KEYS], "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the rest go."""
    bounded_batches(spark)
    keyed = _keyed(docs)
    found = language_id.identify(keyed, [*KEYS], "text", F.col("lang"), F.lit(None), F.col("source"))
    return _without(keyed, found.where(language_id.rejected())).drop(*KEYS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id (no id comes last)."""
    keyed = _keyed(docs)
    marked = keyed.select(F.col(KEYS[0]).alias("row"), "text", F.col("doc_id").alias("name"), *KEYS)
    found = stage(simhash.near_duplicates(marked, id_col="row", keep=("name", *KEYS)), "near-duplicates")
    first = F.min(F.struct(F.col("name").isNull().alias("unnamed"), "name", *KEYS)).alias("first")
    groups = _small(found.groupBy("component_id").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    other = F.lit(False)
    for k in KEYS:
        other = other | (F.col(k) != F.col(f"first.{k}"))
    kept = _without(keyed, found.join(groups, "component_id").where(other))
    # rows equal in all columns have one key: one of them stays
    equal = _small(found.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEYS), "equal-rows")
    if equal.isEmpty():
        return kept.drop(*KEYS)
    once = kept.join(equal, [*KEYS], "left_semi").groupBy(*KEYS).agg(
        F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return kept.join(equal, [*KEYS], "left_anti").drop(*KEYS).unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    keyed = _keyed(docs)
    found = decontamination.contamination(keyed, table(spark, sf_dir, "benchmark"), keep=KEYS)
    return _without(keyed, found.where("n_hit > 0")).drop(*KEYS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the text."""
    masked = pii_crf.redact(docs, pii_crf.fit(pii_crf.labelled_runs(docs)))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, placed in the mixture of sources."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", mask_personal_data),
    ("mixing sources", mix_sources),
]

ORACLE_SQL = None  # fingerprints and the trained models are outside SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, keep in STAGES:
        docs = stage(keep(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
