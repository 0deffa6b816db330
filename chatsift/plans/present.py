"""Flat, engine-neutral views of nested results (for oracle comparison and reports)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsift.functions.messages import render_messages


def example_view(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys + prompt_text, completion_text, n_prompt, n_completion, source."""
    return df.select(
        *[F.col(k).cast("long").alias(k) if k in ("conv_id", "turn", "doc_id", "reply_pos") else F.col(k)
          for k in keys],
        render_messages("prompt").alias("prompt_text"),
        render_messages("completion").alias("completion_text"),
        F.size("prompt").cast("long").alias("n_prompt"),
        F.size("completion").cast("long").alias("n_completion"),
        F.col("source"),
    )
