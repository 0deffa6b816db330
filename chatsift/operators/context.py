"""Trailing context per key and the conversation -> examples generator.

``trailing_context`` gives each row the last ``k`` items of earlier rows of the same key (ordered
by a sequence column), optionally cut at reset rows. It is the shared core of multi-turn example
generation (items = retained messages) and of chat-session history (items = exchanged messages,
resets = reset commands).

Plan shape: one hash exchange on the key (plus block for heavy hitters); the running counts and
the bounded RANGE frame (or, for the whole history, an unbounded frame per reset epoch) are
computed by Window operators on that same partitioning. For hot keys each block also needs the
items that precede it (the halo). Then the windowed rows are written once; a per-block summary
(its last ``k`` items, or all of them, after its last reset, taken from the block's last row) is
folded by a small window over the summaries of each key, and only the head of each block (rows
whose in-block context is not yet full) is joined with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatsift.config import SkewConfig
from chatsift.functions.messages import empty_messages, last_n, message
from chatsift.functions.text import clean_role, is_valid_length, normalize_text
from chatsift.operators.skew import BLOCK, HotKeys, hot_keys, with_blocks

_TMP = ("_isit", "_it", "_rs", "_ep", "_nb", "_o", "_cin", "_halo")


def trailing_context(
    df: DataFrame,
    *,
    keys: list[str],
    seq: str,
    item: Column,
    k: int,
    is_item: Column | None = None,
    is_reset: Column | None = None,
    hot: HotKeys | None = None,
    block_rows: int = SkewConfig().block_rows,
    out: str = "ctx",
) -> DataFrame:
    """Add ``out``: array of the last ``k`` items strictly before each row within its key, counting
    only rows where ``is_item`` holds and only rows after the latest reset (a reset row is not an
    item, clears the history and itself gets an empty context). ``k == 0`` means the whole
    history (output grows quadratically with the key's length by definition). ``seq`` must be
    unique within a key; keys in ``hot`` are split into blocks of about ``block_rows`` rows."""
    if k < 0:
        raise ValueError("k must be >= 0")
    hot = hot or HotKeys()
    d = df.withColumn("_rs", F.coalesce(is_reset, F.lit(False)) if is_reset is not None else F.lit(False))
    # a reset row is never an item; it sees the (cleared) empty history
    d = d.withColumn(
        "_isit", (F.coalesce(is_item, F.lit(False)) if is_item is not None else F.lit(True)) & ~F.col("_rs")
    )
    d = d.withColumn("_it", F.when(F.col("_isit"), item))
    has_resets = is_reset is not None

    blocked = hot.any
    if blocked:
        # one struct names the key from here on: it is never null, so null keys join like any other
        d = with_blocks(d, keys, seq, hot, block_rows).withColumn("_key", F.struct(*keys))
    part = ["_key", BLOCK] if blocked else list(keys)

    # every row an item and no resets (conversation turns): the last k items are simply the
    # previous k rows, one ROWS frame on the sequence order; otherwise running counts place rows on
    # a scale where a RANGE frame selects exactly the last k items
    simple = is_item is None and is_reset is None
    w_run = Window.partitionBy(*part).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = {"_ep": F.sum(F.col("_rs").cast("long")).over(w_run) if has_resets else F.lit(0).cast("long")}
    if k > 0 and not simple:
        running["_nb"] = F.sum(F.col("_isit").cast("long")).over(w_run) - F.col("_isit").cast("long")
    d = d.withColumns(running)  # one projection, so both running sums share one Window operator
    if k > 0 and simple:
        w_seq = Window.partitionBy(*part).orderBy(seq)
        frame_before = w_seq.rowsBetween(-k, -1)
        d = d.withColumn("_cin", F.collect_list("_it").over(frame_before))
    elif k > 0:
        # items sit on even values 2*(n+1), other rows on odd values 2*n+1, and each reset adds a
        # gap wider than the frame
        d = d.withColumn(
            "_o",
            F.col("_ep") * F.lit(2 * k + 2) + F.col("_nb") * 2 + F.when(F.col("_isit"), 2).otherwise(1),
        )
        w_o = Window.partitionBy(*part).orderBy("_o")
        frame_before = w_o.rangeBetween(-2 * k, -1)
        d = d.withColumn("_cin", F.collect_list("_it").over(frame_before))
    else:
        # whole history since the last reset (quadratic output by definition)
        w_ep = Window.partitionBy(*part, "_ep").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("_cin", F.collect_list("_it").over(w_ep))
    if not blocked:
        return d.withColumnRenamed("_cin", out).drop(*[c for c in _TMP if c in d.columns])

    item_type = d.schema["_it"].dataType.simpleString()
    empty = F.array().cast(f"array<{item_type}>")
    # Hot keys exist, so the data is large: write the windowed rows once; the block summaries and
    # the output both read that table instead of repeating the scan and the big shuffle.
    from chatsift.session import materialize

    d = materialize(d, "context-blocks")
    # A block's tail (its last k items after its last reset, or all of them when k == 0) follows
    # from its last row: that row's context plus its own item, or nothing if it is a reset.
    last = d.groupBy(*part).agg(
        F.max_by(F.struct("_cin", "_it", "_isit", "_rs"), seq).alias("_last"), F.max("_rs").alias("_hr"))
    own = F.when(F.col("_last._isit"), F.array(F.col("_last._it"))).otherwise(empty)
    through_last = F.concat(F.col("_last._cin"), own)
    tail = F.when(F.col("_last._rs"), empty).otherwise(last_n(through_last, k) if k > 0 else through_last)
    summary = last.select(*part, "_hr", tail.alias("_tail"))
    # Context after each significant block (one with items or a reset): fold the significant blocks
    # up to it (the last k of them when k > 0; they hold >= k items), starting at the latest reset.
    significant = summary.where((F.size("_tail") > 0) | F.col("_hr"))
    first = -(k - 1) if k > 0 else Window.unboundedPreceding
    w_sig = Window.partitionBy("_key").orderBy(BLOCK).rowsBetween(first, 0)
    recent = F.collect_list(F.struct("_hr", "_tail")).over(w_sig)
    cut = F.aggregate(
        "_recent",
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("r")),
        lambda acc, e: F.struct((acc["i"] + 1).alias("i"), F.when(e["_hr"], acc["i"] + 1).otherwise(acc["r"]).alias("r")),
    )["r"]
    folded = F.flatten(F.transform(F.slice("_recent", F.greatest(cut, F.lit(1)), F.size("_recent")), lambda e: e["_tail"]))
    after = significant.select(*part, recent.alias("_recent")).select(
        *part, (last_n(folded, k) if k > 0 else folded).alias("_after"))
    # every block's halo is the context after the latest significant block before it
    w_prev = Window.partitionBy("_key").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    halo = (
        summary.select(*part)
        .join(after, on=part, how="left")
        .select(*part, F.last("_after", ignorenulls=True).over(w_prev).alias("_halo"))
    )
    # Only rows whose in-block context is not yet full (epoch 0, before the block's k-th item; all of
    # epoch 0 when k == 0) need the halo: that block head is joined, the rest pass unchanged, so the
    # big table is not shuffled again.
    needs_halo = (F.col("_ep") == 0) & ((F.size("_cin") < k) if k > 0 else F.lit(True))
    head = d.where(needs_halo).join(halo, on=part, how="left")
    with_halo = F.concat(F.coalesce(F.col("_halo"), empty), F.col("_cin"))
    head = head.withColumn(out, last_n(with_halo, k) if k > 0 else with_halo)
    rest = d.where(~needs_halo).withColumn(out, F.col("_cin"))
    temps = [BLOCK, "_key", *[c for c in _TMP if c in head.columns]]
    return head.drop(*temps).unionByName(rest.drop(*[c for c in temps if c in rest.columns]))


def conversation_examples(
    turns: DataFrame,
    *,
    system_prompt: str,
    source: str | Column,
    k: int,
    key: str = "conv_id",
    seq: str = "turn",
    role: str = "role",
    text: str = "text",
    skew: SkewConfig = SkewConfig(),
) -> DataFrame:
    """Conversation turn rows -> 0..n examples per conversation.

    Keep user/assistant turns with non-empty normalised content; every assistant turn whose
    preceding retained turn is a user turn yields an example whose prompt is the system prompt
    plus the last ``k`` retained turns (``k == 0``: all of them). Rejected examples still count as
    history. Output: ``key, seq, prompt, completion, source``.
    """
    # cleaned once and filtered inside an array (a plain where would be pushed below the
    # projection and normalise every text twice)
    cleaned = F.filter(
        F.array(message(clean_role(F.col(role)), normalize_text(F.col(text)))),
        lambda m: m["role"].isin("user", "assistant") & (m["content"] != F.lit("")),
    )
    retained = turns.select(key, seq, F.inline(cleaned))
    hot = hot_keys(turns.select(key), [key], skew)
    with_ctx = trailing_context(
        retained, keys=[key], seq=seq, item=message(F.col("role"), F.col("content")), k=k, hot=hot,
        block_rows=skew.block_rows,
    )
    prev = F.try_element_at(F.col("ctx"), F.lit(-1))
    ok = (
        (F.col("role") == "assistant")
        & (prev["role"] == F.lit("user"))
        & is_valid_length(prev["content"])
        & is_valid_length(F.col("content"))
    )
    src = F.lit(source) if isinstance(source, str) else source
    return with_ctx.where(F.coalesce(ok, F.lit(False))).select(
        key,
        seq,
        F.concat(system_messages(system_prompt, turns.sparkSession), F.col("ctx")).alias("prompt"),
        F.array(message(F.col("role"), F.col("content"))).alias("completion"),
        src.alias("source"),
    )


def system_messages(system_prompt: str | Column, spark=None) -> Column:
    """``[system]`` with the normalised prompt, or ``[]`` when it normalises to empty. A constant
    prompt is normalised once (needs ``spark``); a column is normalised per row."""
    if isinstance(system_prompt, str) and spark is not None:
        from chatsift.functions.messages import constant_system

        return constant_system(spark, system_prompt)
    sp = F.lit(system_prompt) if isinstance(system_prompt, str) else system_prompt
    return F.filter(F.array(message(F.lit("system"), normalize_text(sp))), lambda m: m["content"] != F.lit(""))


def array_examples(
    df: DataFrame,
    messages: str | Column,
    *,
    system_prompt: str,
    source: str | Column,
    k: int,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Conversation arrays (one conversation per row) -> 0..n examples, without any shuffle:
    clean the array, explode the positions of replies that follow a user message, slice the
    context. Output: ``keep..., reply_pos, prompt, completion, source``."""
    msgs = F.col(messages) if isinstance(messages, str) else messages
    src = F.lit(source) if isinstance(source, str) else source
    cleaned = df.select(
        *keep,
        src.alias("source"),
        F.filter(
            F.transform(
                F.coalesce(msgs, empty_messages()),
                lambda m: message(clean_role(m["role"]), normalize_text(m["content"])),
            ),
            lambda m: m["role"].isin("user", "assistant") & (m["content"] != F.lit("")),
        ).alias("_r"),
    )
    r = F.col("_r")
    positions = F.when(
        F.size(r) >= 2,
        F.filter(
            F.sequence(F.lit(2), F.size(r)),
            lambda i: (F.element_at(r, i)["role"] == F.lit("assistant"))
            & (F.element_at(r, i - 1)["role"] == F.lit("user")),
        ),
    ).otherwise(F.array().cast("array<int>"))
    exploded = cleaned.select(*keep, "source", "_r", F.explode(positions).alias("reply_pos"))
    i = F.col("reply_pos")
    start = F.greatest(i - F.lit(k), F.lit(1)) if k > 0 else F.lit(1)
    ctx = F.slice(r, start, i - start)
    reply = F.element_at(r, i)
    prev = F.element_at(r, i - 1)
    ok = is_valid_length(prev["content"]) & is_valid_length(reply["content"])
    return exploded.where(ok).select(
        *keep,
        "reply_pos",
        F.concat(system_messages(system_prompt, df.sparkSession), ctx).alias("prompt"),
        F.array(reply).alias("completion"),
        "source",
    )
