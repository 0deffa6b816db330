"""Chat-request table operators: validation, parameter defaults, message assembly, prompt
rendering, and applying replies to update histories.

Requests: ``request_id, message, history ARRAY<STRUCT<role, content>>, system_prompt,
max_new_tokens, temperature, top_p``. Replies: ``request_id, response`` (null = failed call).
All row-wise expressions except ``apply_replies``, which is one equi-join on the unique
``request_id`` (AQE chooses broadcast or sort-merge from the runtime sizes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsift.config import (
    MAX_NEW_TOKENS_RANGE,
    REQUEST_MESSAGE_MAX,
    ROLES_HISTORY,
    TEMPERATURE_RANGE,
    TOP_P_RANGE,
    ChatConfig,
)
from chatsift.functions.messages import clip_history, empty_messages, message, render_chat_prompt
from chatsift.functions.text import normalize_text

# ---- fixed values: violation names in report order -------------------------------------------
VIOLATIONS = (
    "message_length",
    "history_role",
    "history_content_length",
    "max_new_tokens_range",
    "temperature_range",
    "top_p_range",
)
# -----------------------------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def violations(message_col="message", history="history", max_new_tokens="max_new_tokens",
               temperature="temperature", top_p="top_p") -> Column:
    """Array of violated rules (empty when the request is valid). Message 1..4000 characters;
    history roles exactly user/assistant (no case folding) with content 1..4000; optional
    max_new_tokens 32..512, temperature 0..1.5, top_p 0.1..1.0. A missing history is empty."""
    msg = _c(message_col)
    hist = F.coalesce(_c(history), empty_messages())
    mnt, tmp, tp = _c(max_new_tokens), _c(temperature), _c(top_p)
    in_range = lambda c, lo_hi: c.isNull() | c.between(*lo_hi)
    checks = [
        F.coalesce(F.length(msg).between(1, REQUEST_MESSAGE_MAX), F.lit(False)),
        ~F.exists(hist, lambda m: ~F.coalesce(m["role"].isin(*ROLES_HISTORY), F.lit(False))),
        ~F.exists(hist, lambda m: ~F.coalesce(F.length(m["content"]).between(1, REQUEST_MESSAGE_MAX), F.lit(False))),
        in_range(mnt, MAX_NEW_TOKENS_RANGE),
        in_range(tmp, TEMPERATURE_RANGE),
        in_range(tp, TOP_P_RANGE),
    ]
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for ok, name in zip(checks, VIOLATIONS)]))


def validate_requests(df: DataFrame) -> DataFrame:
    """Adds ``violations`` (array) and ``is_valid``; split with ``where(is_valid)``."""
    return df.withColumn("violations", violations()).withColumn("is_valid", F.size("violations") == 0)


def is_text_message(c: Column | str = "message") -> Column:
    """Messages a chat front end forwards: non-empty text that is not a command (leading slash)."""
    m = _c(c)
    return F.coalesce(m.isNotNull() & (m != F.lit("")) & ~m.startswith("/"), F.lit(False))


def model_reference(merged: Column, adapter: Column, base: Column) -> Column:
    """First non-empty of merged model path, adapter path, base model name."""
    return F.coalesce(F.nullif(merged, F.lit("")), F.nullif(adapter, F.lit("")), base)


def with_defaults(df: DataFrame, cfg: ChatConfig = ChatConfig()) -> DataFrame:
    """Effective generation parameters: ``max_new_tokens`` falls back when null or 0, temperature and
    top_p only when null (0.0 is kept); an empty system prompt falls back; plus ``model``."""
    return df.withColumns(
        {
            "max_new_tokens_eff": F.coalesce(F.nullif(F.col("max_new_tokens"), F.lit(0)), F.lit(cfg.max_new_tokens)),
            "temperature_eff": F.coalesce(F.col("temperature"), F.lit(cfg.temperature)),
            "top_p_eff": F.coalesce(F.col("top_p"), F.lit(cfg.top_p)),
            "repetition_penalty": F.lit(cfg.repetition_penalty),
            "system_prompt_eff": normalize_text(
                F.coalesce(F.nullif(F.col("system_prompt"), F.lit("")), F.lit(cfg.system_prompt))
            ),
            "model": model_reference(F.lit(cfg.merged_model_path).cast("string"),
                                     F.lit(cfg.adapter_path).cast("string"), F.lit(cfg.base_model)),
        }
    )


def assemble_messages(df: DataFrame, cfg: ChatConfig = ChatConfig()) -> DataFrame:
    """``messages = [system] + clipped history + [user]``; the user message is kept even when it
    normalises to empty. Needs ``system_prompt_eff`` (see ``with_defaults``)."""
    return df.withColumn(
        "messages",
        F.concat(
            F.array(message(F.lit("system"), F.col("system_prompt_eff"))),
            clip_history("history", cfg.max_history_turns),
            F.array(message(F.lit("user"), normalize_text(F.col("message")))),
        ),
    )


def render_prompts(df: DataFrame, cfg: ChatConfig = ChatConfig()) -> DataFrame:
    return df.withColumn(
        "prompt", render_chat_prompt("messages", cfg.turn_prefix, cfg.role_suffix, cfg.turn_suffix,
                                     cfg.generation_marker)
    )


def one_reply(replies: DataFrame, order: Column | str | None = None) -> DataFrame:
    """(request_id, response): one reply per request. With ``order`` the first in that order counts; without,
    a request with several replies fails the job, as which of them counts would be chance."""
    answered = replies.where(F.col("request_id").isNotNull()).groupBy("request_id")
    if order is not None:
        return answered.agg(F.min_by("response", _c(order)).alias("response"))
    several = F.raise_error(F.concat(F.lit("several replies to request "), F.col("request_id").cast("string")))
    counted = answered.agg(F.count(F.lit(1)).alias("_n"), F.first("response").alias("_reply"))
    return counted.select("request_id", F.when(F.col("_n") > 1, several.cast("string")).otherwise(F.col("_reply")).alias("response"))


def apply_replies(requests: DataFrame, replies: DataFrame, cfg: ChatConfig = ChatConfig(),
                  order: Column | str | None = None) -> DataFrame:
    """Join replies to requests and compute the history the client keeps next.

    ``ok``: history = clip(history + [user, reply], turns) with the reply normalised;
    ``failed`` (no reply) and ``rejected`` (an updated message longer than 4000 characters, which
    the response model refuses) keep the old history unchanged. A request has one reply (``one_reply``); its
    grouping has the join's partitioning, so it costs no shuffle of its own."""
    joined = requests.join(one_reply(replies, order), on="request_id", how="left")
    staged = joined.withColumn("response_clean", normalize_text(F.col("response"))).withColumn(
        "_updated",
        clip_history(
            F.concat(
                F.coalesce(F.col("history"), empty_messages()),
                F.array(message(F.lit("user"), normalize_text(F.col("message"))),
                        message(F.lit("assistant"), F.col("response_clean"))),
            ),
            cfg.max_history_turns,
        ),
    )
    too_long = F.exists("_updated", lambda m: F.length(m["content"]) > REQUEST_MESSAGE_MAX)
    status = (F.when(F.col("response").isNull(), F.lit("failed"))
              .when(too_long, F.lit("rejected")).otherwise(F.lit("ok")))
    return staged.withColumn("status", status).withColumn(
        "new_history",
        F.when(F.col("status") == "ok", F.col("_updated")).otherwise(F.coalesce(F.col("history"), empty_messages())),
    ).drop("_updated")
