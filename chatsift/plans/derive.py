"""Source shapes derived by Spark from the driver tables (pairs, translation pairs, dirt).

The driver tables hold conversations as one row per turn and documents as plain text; the
original tool's inputs are pair tables, turn-pair tables, conversation arrays and translation
pairs. These functions derive those shapes from the whole tables so every operator runs on data
that grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsift.functions.text import clean_role

# ---- fixed values: deterministic dirt injected identically in Spark SQL and DuckDB ----------
# (only replace / || / chr(n<128) / CASE and literal characters: valid in both dialects;
#  no backslashes, since Spark SQL literals unescape them and DuckDB literals do not)
DOC_DIRT_SQL = (
    "CASE doc_id % 3 "
    "WHEN 0 THEN replace(replace(text, '. ', '.' || chr(13) || chr(10) || chr(9) || '  '), ', ', ',\u200b  ') "
    "WHEN 1 THEN '\u3000 ' || replace(text, chr(10), chr(10) || chr(10) || ' ' || chr(13)) || ' ' || chr(11) "
    "ELSE replace(replace(text, ' a', ' \u2018a\u2019'), ' e', ' \u201ce\u201d  ') END"
)
ROLE_DIRT_SQL = (
    "CASE conv_id % 4 "
    "WHEN 0 THEN role "
    "WHEN 1 THEN ' ' || upper(role) || chr(9) "
    "WHEN 2 THEN '\u3000' || role || chr(11) "
    "ELSE CASE WHEN turn = 1 THEN 'tool' ELSE role END END"
)
TEXT_DIRT_SQL = (
    "CASE (conv_id + turn) % 4 "
    "WHEN 0 THEN text "
    "WHEN 1 THEN replace(text, ' ', ' ' || chr(9) || ' ') || chr(13) || chr(10) "
    "WHEN 2 THEN '\u200b' || replace(text, '. ', '.' || chr(13) || chr(10) || chr(13) || chr(10)) "
    "ELSE CASE WHEN turn % 3 = 0 THEN ' ' || chr(9) || '\u00a0 ' ELSE '\u201c' || text || '\u201d' END END"
)
# accented letters folded to ASCII to derive the target side of translation pairs
FOLD_FROM = "éèêàçüöäñáíóú"
FOLD_TO = "eeeacuoanaiou"
# ---------------------------------------------------------------------------------------------


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """Raw (user turn, next assistant turn) pairs: ``conv_id, turn, input, output``.

    An equi-join on the unique key ``(conv_id, turn)``: no key repeats, so no join task can be
    skewed, whatever the conversation lengths."""
    role = clean_role(F.col("role"))
    users = turns.where(role == "user").select("conv_id", "turn", F.col("text").alias("input"))
    replies = turns.where(role == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return users.join(replies, on=["conv_id", "turn"], how="inner")


def translation_pairs(documents: DataFrame) -> DataFrame:
    """``doc_id, src_text, target_text`` with the target derived by folding accents."""
    return documents.select(
        "doc_id", F.col("text").alias("src_text"), F.translate("text", FOLD_FROM, FOLD_TO).alias("target_text")
    )


def dirty_documents(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "lang", F.expr(DOC_DIRT_SQL).alias("text"))


def dirty_turns(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.expr(ROLE_DIRT_SQL).alias("role"), F.expr(TEXT_DIRT_SQL).alias("text"))


# fixed values: lines that hold no single JSON object, and one with a message that is no object
BAD_LINES = (
    '{"other": 1}',
    '{"input": "hello there", "output": "general remark"} trailing',
    '{"input": "hello there", "output": "general remark"} {"input": "a second", "output": "one here"}',
    "{'input': 'hello there', 'output': 'general remark'}",
)
BAD_MESSAGE_LINE = (
    '{"messages": [5, {"role": "user", "content": "hello there"}, {"role": "assistant", "content": "general remark"}]}'
)


def jsonl_lines(turns: DataFrame, system_prompt: str) -> DataFrame:
    """One JSON line per conversation turn, cycling through every record shape plus blank, other,
    non-object and broken lines: ``line_id, value``."""
    t = F.col("text")
    m = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    convo = F.array(m("user", F.concat(F.lit("q "), t)), m("assistant", F.concat(F.lit("a "), t)),
                    m("user", F.concat(F.lit("q2 "), t)), m("assistant", F.concat(F.lit("a2 "), t)))
    prompt = F.array(m("system", F.lit(system_prompt)), m("user", t))
    completion = F.array(m("assistant", t))
    keep_nulls = {"ignoreNullFields": "false"}
    s = (F.col("conv_id") + F.col("turn")) % 8
    value = (
        F.when((s == 0) & (F.col("conv_id") % 2 == 0),
               F.to_json(F.struct(prompt.alias("prompt"), completion.alias("completion"),
                                  F.lit("x").alias("input"), F.lit("y").alias("output"))))
        .when(s == 0, F.to_json(F.struct(prompt.alias("prompt"), completion.alias("completion"))))
        .when(s == 1, F.to_json(F.struct(t.alias("input"), F.concat(F.lit("re: "), t).alias("output"))))
        .when(s == 2, F.to_json(F.struct(t.alias("user"), F.concat(F.lit("ok "), t).alias("assistant"))))
        .when(s == 3, F.to_json(F.struct(convo.alias("messages"))))
        .when(s == 4, F.to_json(F.struct(F.lit(None).cast("string").alias("input"),
                                         F.lit(None).cast("string").alias("output"), convo.alias("messages")),
                                keep_nulls))
        .when(s == 5, F.element_at(F.array(*[F.lit(x) for x in BAD_LINES]), (F.col("turn") % 4 + 1).cast("int")))
        .when((s == 6) & (F.col("conv_id") % 2 == 1), F.lit(BAD_MESSAGE_LINE))
        .when(s == 6, F.lit("   "))
        .when(F.col("turn") % 2 == 0, F.lit("[1, 2]"))
        .otherwise(F.concat(F.lit('{"input": '), t))
    )
    return turns.select(F.format_string("%d:%d", "conv_id", "turn").alias("line_id"), value.alias("value"))


def jsonl_lines_sql(system_prompt: str) -> str:
    """The same lines in DuckDB SQL."""
    from chatsift.plans.sqltext import lit

    def m(role, content):
        return f"json_object('role', '{role}', 'content', {content})"

    convo = (f"json_array({m('user', lit('q ') + ' || text')}, {m('assistant', lit('a ') + ' || text')}, "
             f"{m('user', lit('q2 ') + ' || text')}, {m('assistant', lit('a2 ') + ' || text')})")
    prompt = f"json_array({m('system', lit(system_prompt))}, {m('user', 'text')})"
    completion = f"json_array({m('assistant', 'text')})"
    s = "((conv_id + turn) % 8)"
    return f"""SELECT conv_id || ':' || turn AS line_id, CAST(CASE
      WHEN {s} = 0 AND conv_id % 2 = 0 THEN CAST(json_object('prompt', {prompt}, 'completion', {completion}, 'input', 'x', 'output', 'y') AS VARCHAR)
      WHEN {s} = 0 THEN CAST(json_object('prompt', {prompt}, 'completion', {completion}) AS VARCHAR)
      WHEN {s} = 1 THEN CAST(json_object('input', text, 'output', 're: ' || text) AS VARCHAR)
      WHEN {s} = 2 THEN CAST(json_object('user', text, 'assistant', 'ok ' || text) AS VARCHAR)
      WHEN {s} = 3 THEN CAST(json_object('messages', {convo}) AS VARCHAR)
      WHEN {s} = 4 THEN CAST(json_object('input', NULL, 'output', NULL, 'messages', {convo}) AS VARCHAR)
      WHEN {s} = 5 THEN [{', '.join(lit(x) for x in BAD_LINES)}][turn % 4 + 1]
      WHEN {s} = 6 AND conv_id % 2 = 1 THEN {lit(BAD_MESSAGE_LINE)}
      WHEN {s} = 6 THEN '   '
      WHEN turn % 2 = 0 THEN '[1, 2]'
      ELSE '{{"input": ' || text END AS VARCHAR) AS value
    FROM conversations"""


def csv_pairs(turns: DataFrame) -> DataFrame:
    """Adjacent pairs with CSV hazards injected: quotes, embedded newlines, missing-value tokens."""
    p = adjacent_pairs(turns)
    sel = (F.col("conv_id") + F.col("turn")) % 6
    inp = (F.when(sel == 0, F.lit("NA"))
           .when(sel == 1, F.concat(F.col("input"), F.lit(' he said "hi", ok')))
           .otherwise(F.col("input")))
    out = (F.when(sel == 2, F.lit("null"))
           .when(sel == 3, F.concat(F.lit("line one\nline two, "), F.col("output")))
           .when(sel == 4, F.lit(""))
           .otherwise(F.col("output")))
    return p.select("conv_id", "turn", inp.alias("input"), out.alias("output"))


CSV_PAIRS_SQL = """SELECT conv_id, turn,
  CASE WHEN (conv_id + turn) % 6 = 0 THEN 'NA'
       WHEN (conv_id + turn) % 6 = 1 THEN input || ' he said "hi", ok' ELSE input END AS input,
  CASE WHEN (conv_id + turn) % 6 = 2 THEN 'null'
       WHEN (conv_id + turn) % 6 = 3 THEN 'line one' || chr(10) || 'line two, ' || output
       WHEN (conv_id + turn) % 6 = 4 THEN '' ELSE output END AS output
FROM ({pairs})"""


# ---- chat requests derived from conversations (+ parameters from events) --------------------
# fixed values: deterministic request dirt, identical in Spark SQL and DuckDB
REQUEST_MESSAGE_SQL = (
    "CASE (conv_id + turn) % 9 WHEN 0 THEN '' WHEN 1 THEN '/start' "
    "WHEN 2 THEN text || '  ' || chr(9) || ' ' WHEN 3 THEN repeat(text || ' ', 30) ELSE text END"
)
HISTORY_ROLE_SQL = "CASE WHEN conv_id % 5 = 0 THEN upper(role) ELSE role END"
SYSTEM_PROMPT_SQL = (
    "CASE conv_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' "
    "ELSE '  Custom   prompt' || chr(9) || CAST(conv_id AS STRING) || ' ' END"
)
MAX_NEW_TOKENS_SQL = "CASE WHEN event_type = 'view' THEN NULL ELSE CAST(floor(value * 1.2) AS INT) END"
TEMPERATURE_SQL = "CASE WHEN event_type = 'click' THEN NULL ELSE value / 100.0 END"
TOP_P_SQL = "CASE WHEN event_type = 'purchase' THEN NULL ELSE CAST(event_id % 12 AS DOUBLE) / 10.0 END"
REPLY_SQL = (
    "CASE WHEN (conv_id + turn) % 11 = 0 THEN repeat(text || ' ', 25) "
    "ELSE '  ' || text || chr(13) || chr(10) END"
)


def chat_requests(turns: DataFrame, events: DataFrame, *, skew=None) -> DataFrame:
    """One request per user turn: ``request_id = 'conv_id:turn'``, all raw previous turns as history,
    parameters from the event numbered ``conv_id * 100 + turn`` (left join; event ids are unique)."""
    from chatsift.config import SkewConfig
    from chatsift.functions.messages import message
    from chatsift.operators.context import trailing_context
    from chatsift.operators.skew import hot_keys

    skew = skew or SkewConfig()
    hist = trailing_context(
        turns.select("conv_id", "turn", "role", "text", F.expr(HISTORY_ROLE_SQL).alias("_hrole")),
        keys=["conv_id"], seq="turn", item=message(F.col("_hrole"), F.col("text")), k=0,
        hot=hot_keys(turns.select("conv_id"), ["conv_id"], skew), block_rows=skew.block_rows, out="history",
    )
    users = hist.where(clean_role(F.col("role")) == "user").select(
        F.format_string("%d:%d", "conv_id", "turn").alias("request_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("event_id"),
        F.expr(REQUEST_MESSAGE_SQL).alias("message"),
        "history",
        F.expr(SYSTEM_PROMPT_SQL).alias("system_prompt"),
    )
    params = events.select(
        "event_id",
        F.expr(MAX_NEW_TOKENS_SQL).alias("max_new_tokens"),
        F.expr(TEMPERATURE_SQL).cast("double").alias("temperature"),
        F.expr(TOP_P_SQL).cast("double").alias("top_p"),
    )
    return users.join(params, on="event_id", how="left").drop("event_id")


def chat_replies(turns: DataFrame) -> DataFrame:
    """The assistant turn after each user turn is the reply to that turn's request."""
    return turns.where(clean_role(F.col("role")) == "assistant").select(
        F.format_string("%d:%d", "conv_id", F.col("turn") - 1).alias("request_id"), F.expr(REPLY_SQL).alias("response")
    )


def event_requests(events: DataFrame) -> DataFrame:
    """Requests built from events alone (for parameter defaulting)."""
    return events.select(
        F.col("event_id").alias("request_id"),
        F.expr(MAX_NEW_TOKENS_SQL).alias("max_new_tokens"),
        F.expr(TEMPERATURE_SQL).cast("double").alias("temperature"),
        F.expr(TOP_P_SQL).cast("double").alias("top_p"),
        F.expr(SYSTEM_PROMPT_SQL.replace("conv_id", "user_id")).alias("system_prompt"),
    )


# ---- chat events derived from the events table -----------------------------------------------
SLOW_EVENTS = 300


def chat_events(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``user_id`` is the chat, ``signup`` a reset; every other event is a user message
    (``event_type props``) whose call fails for ``error`` events and otherwise gets the reply
    ``ack <event_id>``. An event's own seq is 4*event_id and its outcome's the next; every fifth reply
    is slow and comes ``SLOW_EVENTS`` events later, often after the chat's next message or reset.
    Every eleventh event is followed by a greeting (``start``)."""
    msg = F.concat(F.col("event_type"), F.lit(" "), F.col("props"))
    seq = F.col("event_id") * 4
    slow = F.when(F.col("event_id") % 5 == 0, F.lit(4 * SLOW_EVENTS + 2)).otherwise(F.lit(1))
    ev = lambda s, kind, text, reply_to: F.struct(
        s.alias("seq"), F.lit(kind).alias("kind"), text.cast("string").alias("text"), reply_to.cast("long").alias("reply_to"))
    null = F.lit(None)
    arr = (
        F.when(F.col("event_type") == "signup", F.array(ev(seq, "reset", null, null)))
        .when(F.col("event_type") == "error", F.array(ev(seq, "message", msg, null), ev(seq + 1, "error", null, seq)))
        .otherwise(F.array(ev(seq, "message", msg, null),
                           ev(seq + slow, "reply", F.concat(F.lit("ack "), F.col("event_id").cast("string")), seq)))
    )
    greeted = F.when(F.col("event_id") % 11 == 0, F.concat(arr, F.array(ev(seq + 3, "start", null, null)))).otherwise(arr)
    return events.select(*keep, F.col("user_id").alias("chat_id"), F.explode(greeted).alias("e")).select(
        "e.seq", "chat_id", "e.kind", "e.text", "e.reply_to", *keep)
