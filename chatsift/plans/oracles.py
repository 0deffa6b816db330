"""DuckDB oracle SQL for every registered query (tables are pre-registered views)."""

from __future__ import annotations

from chatsift.config import (
    DEFAULT_SYSTEM_PROMPT,
    NA_TOKENS,
    TRANSLATION_INSTRUCTION,
    TRANSLATION_SYSTEM_PROMPT,
    ChatConfig,
)
from chatsift.plans import sqltext as q
from chatsift.plans.derive import (
    BAD_MESSAGE_LINE,
    CSV_PAIRS_SQL,
    DOC_DIRT_SQL,
    FOLD_FROM,
    FOLD_TO,
    HISTORY_ROLE_SQL,
    MAX_NEW_TOKENS_SQL,
    REPLY_SQL,
    REQUEST_MESSAGE_SQL,
    ROLE_DIRT_SQL,
    SLOW_EVENTS,
    SYSTEM_PROMPT_SQL,
    TEMPERATURE_SQL,
    TEXT_DIRT_SQL,
    TOP_P_SQL,
    jsonl_lines_sql,
)

ORACLES: dict[str, str] = {}

CHAT_SOURCE = "conversations:chat"


def _example_select(keys: str, prompt: str, completion: str, source: str) -> str:
    lead = f"{keys}, " if keys else ""
    return (
        f"{lead}{q.render(prompt)} AS prompt_text, {q.render(completion)} AS completion_text, "
        f"CAST(len({prompt}) AS BIGINT) AS n_prompt, CAST(len({completion}) AS BIGINT) AS n_completion, "
        f"{source} AS source"
    )


def retained_turns_sql() -> str:
    return f"""
    SELECT conv_id, turn, role, content FROM (
      SELECT conv_id, turn, {q.clean_role('role')} AS role, {q.normalize('text')} AS content FROM conversations
    ) WHERE role IN ('user', 'assistant') AND content <> ''"""


def multi_turn_sql(k: int) -> str:
    frame = f"ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING" if k > 0 else "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    prompt = f"list_concat({q.system_list(DEFAULT_SYSTEM_PROMPT)}, ctx)"
    completion = f"[{q.msg('role', 'content')}]"
    return f"""
    WITH r AS ({retained_turns_sql()}),
    c AS (
      SELECT *,
        coalesce(list({q.msg('role', 'content')}) OVER (PARTITION BY conv_id ORDER BY turn {frame}), []) AS ctx,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role,
        lag(content) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_content
      FROM r
    )
    SELECT {_example_select('CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn', prompt, completion, q.lit(CHAT_SOURCE))}
    FROM c
    WHERE role = 'assistant' AND prev_role = 'user' AND {q.valid_len('prev_content')} AND {q.valid_len('content')}"""


ORACLES["examples_multi_turn"] = multi_turn_sql(8)
ORACLES["examples_context_3"] = multi_turn_sql(3)
ORACLES["examples_unbounded_context"] = multi_turn_sql(0)


# ---- shared SQL pieces ------------------------------------------------------------------------

PAIR_SOURCE = "conversations:pairs"
TRANSLATION_SOURCE = "documents:translation"
PROMPT_ROLES = ("system", "user", "assistant")
SAMPLE_N = 300
CSV_FILES = 4


def last_user(p: str) -> str:
    return f"list_filter({p}, lambda m: m.role = 'user')[-1].content"


def first_content(c: str) -> str:
    return f"{c}[1].content"


def example_valid(p: str, c: str) -> str:
    return (f"(len({p}) > 0 AND len({c}) > 0 AND {q.valid_len(last_user(p))} "
            f"AND {q.valid_len(first_content(c))})")


def signature(p: str = "prompt", c: str = "completion") -> str:
    return f"(lower(coalesce({last_user(p)}, '')) || '||' || lower(coalesce({first_content(c)}, '')))"


def cleaned_example_cte(raw_prompt: str, raw_completion: str, keys: str, source: str, frm: str) -> str:
    return (f"SELECT {keys}, {q.clean_list(raw_prompt, PROMPT_ROLES)} AS prompt, "
            f"{q.clean_list(raw_completion, ('assistant',))} AS completion, {source} AS source FROM {frm}")


def pairs_sql() -> str:
    raw_p = f"[{q.msg(q.lit('system'), q.lit(DEFAULT_SYSTEM_PROMPT))}, {q.msg(q.lit('user'), 'input')}]"
    raw_c = f"[{q.msg(q.lit('assistant'), 'output')}]"
    return f"""
    SELECT * FROM (
      {cleaned_example_cte(raw_p, raw_c, 'conv_id, turn', q.lit(PAIR_SOURCE), f'''(
        SELECT u.conv_id, u.turn, u.text AS input, a.text AS output
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE {q.clean_role('u.role')} = 'user' AND {q.clean_role('a.role')} = 'assistant')''')}
    ) WHERE {example_valid('prompt', 'completion')}"""


def chat_sql(k: int = 8) -> str:
    frame = f"ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING" if k > 0 else "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
    SELECT conv_id, turn, list_concat({q.system_list(DEFAULT_SYSTEM_PROMPT)}, ctx) AS prompt,
           [{q.msg('role', 'content')}] AS completion, {q.lit(CHAT_SOURCE)} AS source
    FROM (
      SELECT *,
        coalesce(list({q.msg('role', 'content')}) OVER (PARTITION BY conv_id ORDER BY turn {frame}), []) AS ctx,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role,
        lag(content) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_content
      FROM ({retained_turns_sql()})
    )
    WHERE role = 'assistant' AND prev_role = 'user' AND {q.valid_len('prev_content')} AND {q.valid_len('content')}"""


def translation_sql() -> str:
    user = f"{q.lit(TRANSLATION_INSTRUCTION)} || chr(10) || text"
    target = f"translate(text, {q.lit(FOLD_FROM)}, {q.lit(FOLD_TO)})"
    raw_p = f"[{q.msg(q.lit('system'), q.lit(TRANSLATION_SYSTEM_PROMPT))}, {q.msg(q.lit('user'), user)}]"
    raw_c = f"[{q.msg(q.lit('assistant'), target)}]"
    return f"""
    SELECT * FROM (
      {cleaned_example_cte(raw_p, raw_c, 'doc_id', q.lit(TRANSLATION_SOURCE), '(SELECT * FROM documents WHERE text IS NOT NULL)')}
    ) WHERE {example_valid('prompt', 'completion')}"""


def union_sql() -> str:
    return f"""
    SELECT 'c:' || conv_id || ':' || turn AS row_ref, prompt, completion, source, 0 AS r, conv_id AS pos, turn AS sub
      FROM ({pairs_sql()})
    UNION ALL
    SELECT 'c:' || conv_id || ':' || turn, prompt, completion, source, 1, conv_id, turn FROM ({chat_sql(8)})
    UNION ALL
    SELECT 'd:' || doc_id, prompt, completion, source, 2, doc_id, 0 FROM ({translation_sql()})"""


def deduped_sql() -> str:
    return f"""
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY sig ORDER BY r, pos, sub) AS rn
      FROM (SELECT *, {signature()} AS sig FROM ({union_sql()}))
    ) WHERE rn = 1"""


def split_sql(frm: str, row_key: str) -> str:
    """Label rows of ``frm`` train/validation: the first v rows in md5(seed|key) order."""
    return f"""
    SELECT *, CASE WHEN rn <= v THEN 'validation' ELSE 'train' END AS split FROM (
      SELECT *,
        row_number() OVER (ORDER BY md5('42|' || CAST({row_key} AS VARCHAR)), CAST({row_key} AS VARCHAR)) AS rn,
        count(*) OVER () AS n_all,
        least(greatest(1, CAST(floor(count(*) OVER () * 0.02::DOUBLE) AS BIGINT)),
              greatest(1, count(*) OVER () // 10)) AS v
      FROM ({frm})
    )"""


ORACLES["examples_single_turn"] = f"""
SELECT {_example_select('CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn', 'prompt', 'completion', 'source')}
FROM ({pairs_sql()})"""

ORACLES["role_and_message_cleaning"] = f"""
WITH d AS (SELECT conv_id, turn, {ROLE_DIRT_SQL} AS role, {TEXT_DIRT_SQL} AS text FROM conversations),
c AS (
  SELECT *, coalesce(list({q.msg('role', 'text')}) OVER (PARTITION BY conv_id ORDER BY turn
           ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS ctx
  FROM d
),
e AS ({cleaned_example_cte(f"list_concat([{q.msg(q.lit('system'), q.lit(DEFAULT_SYSTEM_PROMPT))}], ctx)",
                           f"[{q.msg('role', 'text')}]", 'conv_id, turn', q.lit('conversations:dirty'), 'c')})
SELECT {_example_select('CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn', 'prompt', 'completion', 'source')}
FROM e WHERE {example_valid('prompt', 'completion')}"""

ORACLES["normalize_text"] = f"""
SELECT doc_id, lang, text_norm, CAST(length(text_norm) AS BIGINT) AS n_chars_norm
FROM (SELECT doc_id, lang, {q.normalize(DOC_DIRT_SQL)} AS text_norm FROM documents)"""

ORACLES["last_user_first_reply"] = f"""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
       lower({last_user('prompt')}) AS last_user, lower({first_content('completion')}) AS first_reply,
       {signature()} AS signature
FROM ({chat_sql(8)})"""

ORACLES["length_gate_by_lang"] = f"""
SELECT lang, count(*) AS n_docs,
       count(*) FILTER (WHERE n BETWEEN 2 AND 1200) AS n_valid,
       count(*) FILTER (WHERE n < 2) AS n_short,
       count(*) FILTER (WHERE n > 1200) AS n_long
FROM (SELECT lang, length({q.normalize('text')}) AS n FROM documents)
GROUP BY lang"""

ORACLES["instruction_template"] = f"""
SELECT {_example_select('CAST(doc_id AS BIGINT) AS doc_id', 'prompt', 'completion', 'source')}
FROM ({translation_sql()})"""

ORACLES["dedup_keep_first_documents"] = f"""
SELECT doc_id, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY sig ORDER BY doc_id) AS rn
  FROM (SELECT doc_id, lang, source, n_chars, lower({q.normalize('text')}) AS sig FROM documents)
) WHERE rn = 1"""

ORACLES["dedup_null_and_repeated_ids"] = f"""
SELECT min(CASE WHEN doc_id % 5 <> 0 THEN CAST(floor(doc_id / 2) AS BIGINT) END) AS id, md5(sig) AS signature
FROM (SELECT doc_id, coalesce(lower({q.normalize('text')}), '') AS sig FROM documents) GROUP BY sig"""

ORACLES["dedup_across_sources"] = f"""
SELECT {_example_select('row_ref', 'prompt', 'completion', 'source')}
FROM ({deduped_sql()})"""

ORACLES["source_counts"] = f"""
WITH b AS (SELECT source, count(*) AS n_before FROM ({union_sql()}) GROUP BY source),
a AS (SELECT source, count(*) AS n_after FROM ({deduped_sql()}) GROUP BY source)
SELECT b.source, b.n_before, CAST(coalesce(a.n_after, 0) AS BIGINT) AS n_after
FROM b LEFT JOIN a ON a.source = b.source"""

ORACLES["sample_exact_n"] = f"""
SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) AS rn
  FROM documents
) WHERE rn <= {SAMPLE_N}"""

ORACLES["split_assignment"] = f"""
SELECT doc_id, split FROM ({split_sql(ORACLES['dedup_keep_first_documents'], 'doc_id')})"""

ORACLES["split_sizes"] = f"""
SELECT split, count(*) AS n_rows FROM ({split_sql(f'SELECT sig, source FROM ({deduped_sql()})', 'sig')})
GROUP BY split"""


# ---- files ------------------------------------------------------------------------------------


def jsonl_shape_sql(lines_sql: str | None = None) -> str:
    """Shape label per line of ``lines_sql`` (``line_id, value``; default: the derived lines)."""
    lines_sql = lines_sql or jsonl_lines_sql(DEFAULT_SYSTEM_PROMPT)
    obj = "CASE WHEN json_valid(value) THEN value ELSE '[]' END"
    keys = f"json_keys(CASE WHEN json_type({obj}) = 'OBJECT' THEN {obj} ELSE '{{}}' END)"
    return f"""
    SELECT line_id, value, CASE
      WHEN {q.strip('value')} = '' THEN 'blank'
      WHEN NOT json_valid(value) OR json_type(value) <> 'OBJECT' THEN 'invalid'
      WHEN list_contains(k, 'prompt') AND list_contains(k, 'completion') THEN 'prompt_completion'
      WHEN list_contains(k, 'input') AND list_contains(k, 'output') THEN 'input_output'
      WHEN list_contains(k, 'user') AND list_contains(k, 'assistant') THEN 'user_assistant'
      WHEN list_contains(k, 'messages') THEN 'messages'
      ELSE 'other' END AS shape
    FROM (SELECT *, {keys} AS k FROM ({lines_sql}))"""


def jsonl_examples_sql(lines_sql: str) -> str:
    """Examples from shaped lines (line_id, value, shape) -> line_id, shape, sub, prompt, completion."""
    msgs_t = "'{\"messages\":[{\"role\":\"VARCHAR\",\"content\":\"VARCHAR\"}]}'"
    pc_t = ("'{\"prompt\":[{\"role\":\"VARCHAR\",\"content\":\"VARCHAR\"}],"
            "\"completion\":[{\"role\":\"VARCHAR\",\"content\":\"VARCHAR\"}]}'")
    sysm = q.msg(q.lit("system"), q.lit(DEFAULT_SYSTEM_PROMPT))

    def pair(u, a):
        prompt = f"[{sysm}, {q.msg(q.lit('user'), u)}]"
        completion = f"[{q.msg(q.lit('assistant'), a)}]"
        return q.clean_list(prompt, PROMPT_ROLES), q.clean_list(completion, ("assistant",))

    io_p, io_c = pair("json_extract_string(value, '$.input')", "json_extract_string(value, '$.output')")
    ua_p, ua_c = pair("json_extract_string(value, '$.user')", "json_extract_string(value, '$.assistant')")
    r = q.clean_list(f"json_transform(value, {msgs_t}).messages", ("user", "assistant"))
    return f"""
    WITH s AS ({lines_sql}),
    pc AS (
      SELECT line_id, shape, 0 AS sub,
        {q.clean_list(f'json_transform(value, {pc_t}).prompt', PROMPT_ROLES)} AS prompt,
        {q.clean_list(f'json_transform(value, {pc_t}).completion', ('assistant',))} AS completion
      FROM s WHERE shape = 'prompt_completion'
      UNION ALL
      SELECT line_id, shape, 0, {io_p}, {io_c} FROM s WHERE shape = 'input_output'
      UNION ALL
      SELECT line_id, shape, 0, {ua_p}, {ua_c} FROM s WHERE shape = 'user_assistant'
    ),
    rm AS (SELECT line_id, shape, {r} AS r FROM s WHERE shape = 'messages'),
    pos AS (
      SELECT line_id, shape, r, unnest(p) AS i, generate_subscripts(p, 1) - 1 AS sub
      FROM (SELECT *, list_filter(range(2, len(r) + 1), lambda i: r[i].role = 'assistant' AND r[i - 1].role = 'user') AS p FROM rm)
    ),
    ms AS (
      SELECT line_id, shape, sub,
        list_concat({q.system_list(DEFAULT_SYSTEM_PROMPT)}, list_slice(r, greatest(i - 8, 1), i - 1)) AS prompt,
        [r[i]] AS completion
      FROM pos
    )
    SELECT * FROM (SELECT * FROM pc UNION ALL SELECT * FROM ms) WHERE {example_valid('prompt', 'completion')}"""


ORACLES["jsonl_shape_dispatch"] = f"""
SELECT line_id, shape, CAST(-1 AS BIGINT) AS sub, CAST(NULL AS VARCHAR) AS prompt_text,
       CAST(NULL AS VARCHAR) AS completion_text FROM ({jsonl_shape_sql()})
UNION ALL
SELECT line_id, shape, CAST(sub AS BIGINT), {q.render('prompt')}, {q.render('completion')}
FROM ({jsonl_examples_sql(jsonl_shape_sql())})"""


def csv_examples_sql(pairs_sql: str, source: str) -> str:
    na = ", ".join(q.lit(t) for t in NA_TOKENS)
    raw_p = f"[{q.msg(q.lit('system'), q.lit(DEFAULT_SYSTEM_PROMPT))}, {q.msg(q.lit('user'), 'input')}]"
    raw_c = f"[{q.msg(q.lit('assistant'), 'output')}]"
    frm = f"""(SELECT CASE WHEN input IN ({na}) THEN NULL ELSE input END AS input,
                     CASE WHEN output IN ({na}) THEN NULL ELSE output END AS output, grp FROM ({pairs_sql}))"""
    return f"""SELECT * FROM ({cleaned_example_cte(raw_p, raw_c, 'grp', source, frm)})
    WHERE {example_valid('prompt', 'completion')}"""


_CSV_PAIRS = CSV_PAIRS_SQL.format(pairs=f"""
  SELECT u.conv_id, u.turn, u.text AS input, a.text AS output
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE {q.clean_role('u.role')} = 'user' AND {q.clean_role('a.role')} = 'assistant'""")

ORACLES["csv_pairs_round_trip"] = f"""
SELECT {_example_select('', 'prompt', 'completion', 'source')}
FROM ({csv_examples_sql(f"SELECT *, '' AS grp FROM ({_CSV_PAIRS})", q.lit('csv:pairs'))})"""

ORACLES["custom_directory_scan"] = f"""
WITH csv AS ({csv_examples_sql(f'''SELECT *, CASE conv_id % 2 WHEN 0 THEN 'a_pairs' ELSE 'c_variant' END AS grp
                                   FROM ({_CSV_PAIRS})''', 'grp')}),
js AS ({jsonl_examples_sql(jsonl_shape_sql())})
SELECT {_example_select('', 'prompt', 'completion', 'source')} FROM csv
UNION ALL
SELECT {_example_select('', 'prompt', 'completion', q.lit('e_lines'))} FROM js"""

_REJECTED = f"""
SELECT line_id, CASE shape WHEN 'invalid' THEN 'invalid_json' WHEN 'other' THEN 'unknown_shape' ELSE 'bad_message' END AS reason,
  {q.strip('value')} AS record
FROM ({jsonl_shape_sql()}) WHERE shape IN ('invalid', 'other') OR value = {q.lit(BAD_MESSAGE_LINE)}"""
ORACLES["rejected_rows"] = _REJECTED

# four files per group; a row of three fields follows rows of every tenth sum
ORACLES["custom_directory_rejects"] = f"""
SELECT 'e_lines' AS files, reason, count(*) AS n FROM ({_REJECTED}) GROUP BY reason
UNION ALL
SELECT CASE conv_id % 2 WHEN 0 THEN 'a_pairs' ELSE 'c_variant' END, 'field_count', count(*)
FROM ({_CSV_PAIRS}) WHERE (conv_id + turn) % 10 = 0 GROUP BY 1
UNION ALL
SELECT 'b_reordered', 'header', CAST({CSV_FILES} AS BIGINT)"""

ORACLES["jsonl_round_trip"] = f"""
SELECT {_example_select('split', 'prompt', 'completion', 'source')}
FROM ({split_sql(deduped_sql(), 'sig')})"""

ORACLES["build_report"] = f"""
WITH d AS (SELECT * FROM ({split_sql(deduped_sql(), 'sig')})),
b AS (SELECT source, count(*) AS n FROM ({union_sql()}) GROUP BY source),
a AS (SELECT source, count(*) AS n FROM d GROUP BY source)
SELECT
  (SELECT count(*) FROM d WHERE split = 'train') AS train_rows,
  (SELECT count(*) FROM d WHERE split = 'validation') AS validation_rows,
  (SELECT count(*) FROM d) AS total_rows_after_dedup,
  (SELECT string_agg(source || '=' || n, ';' ORDER BY source) FROM b) AS counts_before,
  (SELECT string_agg(source || '=' || n, ';' ORDER BY source) FROM a) AS counts_after,
  CAST(0 AS BIGINT) AS n_notes, CAST(0 AS BIGINT) AS rejected_rows"""


ORACLES["split_summary"] = ORACLES["split_sizes"]

TURN_SOURCE = "conversations:turn_pairs"
_PAIR_KEY = "conv_id * 1000000000 + turn"


def raw_pairs_sql() -> str:
    return f"""SELECT u.conv_id, u.turn, u.conv_id * 1000000000 + u.turn AS pair_key, u.text AS input, a.text AS output
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE {q.clean_role('u.role')} = 'user' AND {q.clean_role('a.role')} = 'assistant'"""


def pair_examples_sql(raw: str, source: str, keys: str, prompt: str = DEFAULT_SYSTEM_PROMPT) -> str:
    raw_p = f"[{q.msg(q.lit('system'), q.lit(prompt))}, {q.msg(q.lit('user'), 'input')}]"
    raw_c = f"[{q.msg(q.lit('assistant'), 'output')}]"
    return f"SELECT * FROM ({cleaned_example_cte(raw_p, raw_c, keys, source, f'({raw})')}) WHERE {example_valid('prompt', 'completion')}"


def turn_pairs_sql() -> str:
    raw = f"SELECT pair_key, input, CASE WHEN turn % 4 = 0 THEN output ELSE 'well, ' || output END AS output FROM ({raw_pairs_sql()})"
    return pair_examples_sql(raw, q.lit(TURN_SOURCE), "pair_key")


ORACLES["examples_turn_pairs"] = f"""
SELECT {_example_select('pair_key', 'prompt', 'completion', 'source')} FROM ({turn_pairs_sql()})"""


def _first_n(frm: str, key: str, n: int) -> str:
    return f"SELECT * FROM ({frm}) QUALIFY row_number() OVER (ORDER BY md5('42|' || CAST({key} AS VARCHAR))) <= {n}"


_CAPPED_CONVS = _first_n("SELECT DISTINCT conv_id FROM conversations", "conv_id", 12)
_TRANSLATION_RAW = f"""SELECT doc_id, {q.lit(TRANSLATION_INSTRUCTION)} || chr(10) || text AS input,
  translate(text, {q.lit(FOLD_FROM)}, {q.lit(FOLD_TO)}) AS output FROM ({_first_n('SELECT * FROM documents', 'doc_id', 150)}) WHERE text IS NOT NULL"""
ORACLES["capped_build"] = f"""
SELECT {_example_select('', 'prompt', 'completion', 'source')} FROM (
  SELECT prompt, completion, source FROM ({pair_examples_sql(_first_n(raw_pairs_sql(), 'pair_key', 60), q.lit(PAIR_SOURCE), 'pair_key')})
  UNION ALL
  SELECT prompt, completion, source FROM ({chat_sql(8)}) WHERE conv_id IN (SELECT conv_id FROM ({_CAPPED_CONVS}))
  UNION ALL
  SELECT prompt, completion, source FROM ({pair_examples_sql(_TRANSLATION_RAW, q.lit(TRANSLATION_SOURCE), 'doc_id', TRANSLATION_SYSTEM_PROMPT)}))"""


def _six(local: bool) -> str:
    """Signature, source and rank of every example of the priority union."""
    csv = lambda where, group: csv_examples_sql(
        f"SELECT *, {group} AS grp FROM ({_CSV_PAIRS}) WHERE {where}", "grp")
    file = "(CASE conv_id % 2 WHEN 0 THEN 'a_pairs' ELSE 'c_variant' END)"
    parts = [f"SELECT {signature()} AS sig, 'local:z_local' AS source, 0 AS r FROM ({csv('(conv_id + turn) % 4 = 0', repr('x'))})"
             if local else f"SELECT {signature()} AS sig, source, 0 AS r FROM ({pairs_sql()})",
             f"SELECT {signature()}, source, 1 FROM ({turn_pairs_sql()})",
             f"SELECT {signature()}, source, 2 FROM ({chat_sql(8)})",
             f"SELECT {signature()}, source, 3 FROM ({translation_sql()})"]
    if local:
        # the other z_local files are not hidden: only the local file's own name is
        parts += [f"SELECT {signature()}, 'custom:' || source, CASE source WHEN 'a_pairs' THEN 4 WHEN 'c_variant' THEN 5 ELSE 6 END FROM ({csv('true', file)})",
                  f"SELECT {signature()}, 'custom:' || source, 6 FROM ({csv('(conv_id + turn) % 4 <> 0', repr('z_local'))})",
                  f"SELECT {signature()}, 'custom:e_lines', 7 FROM ({jsonl_examples_sql(jsonl_shape_sql())})"]
    return " UNION ALL ".join(parts)


def _six_counts(name: str, local: bool) -> str:
    return f"""SELECT '{name}' AS variant, source, count(*) AS n_before, count(*) FILTER (rn = 1) AS n_after
    FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY r) AS rn FROM ({_six(local)})) GROUP BY source"""


ORACLES["six_source_counts"] = f"""{_six_counts('files', True)} UNION ALL {_six_counts('missing', False)}"""


# ---- chat requests ----------------------------------------------------------------------------

_CHAT = ChatConfig()


def requests_sql() -> str:
    return f"""
    SELECT r.*, p.max_new_tokens, p.temperature, p.top_p FROM (
      SELECT conv_id || ':' || turn AS request_id, conv_id * 100 + turn AS event_id, {REQUEST_MESSAGE_SQL} AS message, history,
             {SYSTEM_PROMPT_SQL} AS system_prompt
      FROM (
        SELECT *, coalesce(list({q.msg('hrole', 'text')}) OVER (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS history
        FROM (SELECT *, {HISTORY_ROLE_SQL} AS hrole FROM conversations)
      ) WHERE {q.clean_role('role')} = 'user'
    ) r LEFT JOIN (
      SELECT event_id, {MAX_NEW_TOKENS_SQL} AS max_new_tokens,
             CAST({TEMPERATURE_SQL} AS DOUBLE) AS temperature, CAST({TOP_P_SQL} AS DOUBLE) AS top_p
      FROM events
    ) p USING (event_id)"""


def violations_sql() -> str:
    bad_role = "len(list_filter(coalesce(history, []), lambda m: NOT coalesce(m.role IN ('user', 'assistant'), false)))"
    bad_len = "len(list_filter(coalesce(history, []), lambda m: NOT coalesce(length(m.content) BETWEEN 1 AND 4000, false)))"
    return f"""concat_ws(',',
      CASE WHEN NOT coalesce(length(message) BETWEEN 1 AND 4000, false) THEN 'message_length' END,
      CASE WHEN {bad_role} > 0 THEN 'history_role' END,
      CASE WHEN {bad_len} > 0 THEN 'history_content_length' END,
      CASE WHEN NOT (max_new_tokens IS NULL OR max_new_tokens BETWEEN 32 AND 512) THEN 'max_new_tokens_range' END,
      CASE WHEN NOT (temperature IS NULL OR temperature BETWEEN 0.0 AND 1.5) THEN 'temperature_range' END,
      CASE WHEN NOT (top_p IS NULL OR top_p BETWEEN 0.1 AND 1.0) THEN 'top_p_range' END)"""


def clip_sql(e: str, turns: int) -> str:
    c = q.clean_list(e, ("user", "assistant"))
    return f"list_slice({c}, greatest(len({c}) - {2 * turns} + 1, 1), len({c}))"


def defaults_cols() -> str:
    return f"""coalesce(nullif(max_new_tokens, 0), {_CHAT.max_new_tokens}) AS max_new_tokens_eff,
      coalesce(temperature, {_CHAT.temperature}::DOUBLE) AS temperature_eff,
      coalesce(top_p, {_CHAT.top_p}::DOUBLE) AS top_p_eff,
      {q.normalize(f"coalesce(nullif(system_prompt, ''), {q.lit(_CHAT.system_prompt)})")} AS system_prompt_eff,
      {q.lit(_CHAT.model_reference)} AS model"""


def assembled_sql(turns: int = _CHAT.max_history_turns) -> str:
    return f"""
    SELECT *, list_concat([{q.msg(q.lit('system'), 'system_prompt_eff')}], {clip_sql('history', turns)},
                          [{q.msg(q.lit('user'), q.normalize('message'))}]) AS messages
    FROM (SELECT *, {defaults_cols()} FROM ({requests_sql()}) WHERE {violations_sql()} = '')"""


ORACLES["request_validation"] = f"""
SELECT request_id, {violations_sql()} = '' AS is_valid, {violations_sql()} AS violations,
       coalesce(message IS NOT NULL AND message <> '' AND NOT starts_with(message, '/'), false) AS processed
FROM ({requests_sql()})"""

ORACLES["request_defaults"] = f"""
SELECT request_id, max_new_tokens_eff, temperature_eff, top_p_eff, system_prompt_eff, model FROM (
  SELECT event_id AS request_id, {MAX_NEW_TOKENS_SQL} AS max_new_tokens,
         CAST({TEMPERATURE_SQL} AS DOUBLE) AS temperature, CAST({TOP_P_SQL} AS DOUBLE) AS top_p,
         {SYSTEM_PROMPT_SQL.replace('conv_id', 'user_id')} AS system_prompt
  FROM events
), LATERAL (SELECT {defaults_cols()})"""

ORACLES["request_assembly"] = f"""
SELECT request_id, CAST(len(messages) AS BIGINT) AS n_messages, {q.render('messages')} AS messages_text
FROM ({assembled_sql()})"""

ORACLES["history_clip"] = f"""
SELECT request_id, CAST(len(history) AS BIGINT) AS n_raw, CAST(len(messages) AS BIGINT) AS n_messages, {q.render('messages')} AS messages_text
FROM ({assembled_sql(2)})"""

ORACLES["model_choice"] = """
SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'merged/' || event_type END,
  CASE WHEN event_id % 4 = 0 THEN 'adapter/' || props END, 'base/' || event_type) AS model FROM events"""

ORACLES["render_prompt"] = f"""
SELECT request_id,
  array_to_string(list_transform(messages, lambda m: {q.lit(_CHAT.turn_prefix)} || m.role || {q.lit(_CHAT.role_suffix)}
    || m.content || {q.lit(_CHAT.turn_suffix)}), '') || {q.lit(_CHAT.generation_marker)} AS prompt
FROM ({assembled_sql()})"""

ORACLES["apply_replies"] = f"""
WITH v AS (SELECT * FROM ({requests_sql()}) WHERE {violations_sql()} = ''),
rp AS (SELECT conv_id || ':' || (turn - 1) AS request_id, {REPLY_SQL} AS response FROM conversations
       WHERE {q.clean_role('role')} = 'assistant'),
u AS (
  SELECT v.*, rp.response, {q.normalize('rp.response')} AS response_clean,
    {clip_sql(f"list_concat(coalesce(v.history, []), [{q.msg(q.lit('user'), q.normalize('v.message'))}, {q.msg(q.lit('assistant'), q.normalize('rp.response'))}])", _CHAT.max_history_turns)} AS upd
  FROM v LEFT JOIN rp USING (request_id)
),
s AS (
  SELECT *, CASE WHEN response IS NULL THEN 'failed'
                 WHEN len(list_filter(upd, lambda m: length(m.content) > 4000)) > 0 THEN 'rejected'
                 ELSE 'ok' END AS status FROM u
)
SELECT request_id, status, response_clean,
  {q.render("CASE WHEN status = 'ok' THEN upd ELSE coalesce(history, []) END")} AS history_text,
  CAST(len(CASE WHEN status = 'ok' THEN upd ELSE coalesce(history, []) END) AS BIGINT) AS n_history
FROM s"""


# ---- chat sessions ----------------------------------------------------------------------------
def session_sql(events: str = "events") -> str:
    msg = q.normalize("event_type || ' ' || props")
    reply = q.normalize("'ack ' || CAST(event_id AS VARCHAR)")
    turns = 2 * _CHAT.max_history_turns
    return f"""
    WITH e AS (
      SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS epoch,
             {msg} AS mtext, {reply} AS rtext,
             -- a slow reply is lost if the user's next message or reset comes first
             event_type NOT IN ('signup', 'error') AND NOT (event_id % 5 = 0 AND coalesce(
               lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <= event_id + {SLOW_EVENTS}, false)) AS answered
      FROM {events}
    ),
    c AS (
      SELECT *, list_filter(coalesce(list(CASE WHEN answered
                  THEN [{q.msg(q.lit('user'), 'mtext')}, {q.msg(q.lit('assistant'), 'rtext')}] END)
               OVER (PARTITION BY user_id, epoch ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []),
               lambda x: x IS NOT NULL) AS prior
      FROM e WHERE event_type <> 'signup'
    ),
    h AS (SELECT *, list_slice(flatten(prior), greatest(len(flatten(prior)) - {turns} + 1, 1), len(flatten(prior))) AS hist FROM c)
    SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id, mtext AS message,
           CAST(len(hist) AS BIGINT) AS n_history, {q.render('hist')} AS history_text
    FROM h"""


ORACLES["session_context_batch"] = session_sql()
ORACLES["session_context_stream"] = session_sql()

SESSION_START = "2024-01-15 00:00:00"
ORACLES["session_from_now"] = session_sql(f"(SELECT * FROM events WHERE ts >= TIMESTAMP '{SESSION_START}')")

ORACLES["session_starts_at_end"] = ORACLES["session_from_now"]

_LATE = ("(event_id % 37 = 0 AND event_id % 5 <> 0 AND 8 * event_id < "
         "(SELECT 4 * max(event_id) // 4 + 1 FROM events))")
ORACLES["session_out_of_order"] = f"""
SELECT *, false AS late FROM ({session_sql(f"(SELECT * FROM events WHERE NOT {_LATE})")})
UNION ALL
SELECT seq, CAST(user_id AS BIGINT), coalesce(text, ''), NULL, NULL, true FROM (
  SELECT user_id, 4 * event_id AS seq,
    CASE WHEN event_type <> 'signup' THEN {q.normalize("event_type || ' ' || props")} END AS text FROM events WHERE {_LATE}
  UNION ALL
  SELECT user_id, 4 * event_id + 1, CASE WHEN event_type <> 'error' THEN 'ack ' || CAST(event_id AS VARCHAR) END
  FROM events WHERE {_LATE} AND event_type <> 'signup'
  UNION ALL
  SELECT user_id, 4 * event_id + 3, NULL FROM events WHERE {_LATE} AND event_id % 11 = 0)"""

ORACLES["session_micro_batches"] = session_sql(
    "(SELECT * REPLACE (CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS user_id) FROM events)")
