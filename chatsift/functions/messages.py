"""Message-array column functions: cleaning, validation, example building, history clipping.

A message is ``STRUCT<role STRING, content STRING>``; a conversation is an array of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatsift.config import MAX_CHARS, MIN_CHARS, ROLES_HISTORY, ROLES_PROMPT
from chatsift.functions.text import clean_role, dedupe_signature, is_valid_length, normalize_text

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)
EXAMPLE = T.StructType(
    [
        T.StructField("prompt", MESSAGES),
        T.StructField("completion", MESSAGES),
        T.StructField("source", T.StringType()),
    ]
)

# Separators used to render message arrays as one comparable string.
RENDER_FIELD_SEP = "\x1f"
RENDER_MESSAGE_SEP = "\x1e"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def message(role: Column | str, content: Column | str) -> Column:
    role_c = F.lit(role) if isinstance(role, str) else role
    content_c = F.lit(content) if isinstance(content, str) else content
    return F.struct(role_c.alias("role"), content_c.alias("content"))


def empty_messages() -> Column:
    return F.array().cast(MESSAGES)


def clean_messages(arr: Column | str, roles: tuple[str, ...] = ROLES_PROMPT) -> Column:
    """Lower/strip roles, normalise contents, keep messages whose role is allowed and content non-empty.

    A null array becomes an empty array.
    """
    cleaned = F.transform(
        F.coalesce(_col(arr), empty_messages()),
        lambda m: F.struct(clean_role(m["role"]).alias("role"), normalize_text(m["content"]).alias("content")),
    )
    return F.filter(cleaned, lambda m: m["role"].isin(*roles) & (m["content"] != F.lit("")))


def last_user_content(arr: Column | str) -> Column:
    """Content of the last user message, null when there is none."""
    return F.try_element_at(F.filter(_col(arr), lambda m: m["role"] == F.lit("user")), F.lit(-1))["content"]


def first_content(arr: Column | str) -> Column:
    """Content of the first message, null for an empty array."""
    return F.try_element_at(_col(arr), F.lit(1))["content"]


def prompt_is_valid(prompt: Column | str, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """Prompt half of the checks on a cleaned array: non-empty, has a user message, and the last
    user message passes the length gate. Never null."""
    last_user = last_user_content(prompt)
    return F.coalesce(
        (F.size(_col(prompt)) > 0) & last_user.isNotNull() & is_valid_length(last_user, min_chars, max_chars),
        F.lit(False),
    )


def completion_is_valid(completion: Column | str, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """Completion half: non-empty and the first message passes the length gate. Never null."""
    return F.coalesce(
        (F.size(_col(completion)) > 0) & is_valid_length(first_content(completion), min_chars, max_chars),
        F.lit(False),
    )


def example_is_valid(prompt: Column | str, completion: Column | str,
                     min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """Checks on cleaned arrays: both non-empty, a user message exists, and the last user message and
    the first completion pass the length gate. Never null."""
    return prompt_is_valid(prompt, min_chars, max_chars) & completion_is_valid(completion, min_chars, max_chars)


def with_example(df, prompt: Column, completion: Column, source: Column | str,
                 min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, keep: tuple[str, ...] = (),
                 system_prompt: str | None = None):
    """Build examples from raw prompt/completion arrays: clean both, drop rows that fail validation.

    Returns ``keep`` columns plus ``prompt``, ``completion``, ``source``. ``system_prompt`` (a
    constant) is normalised once and prepended to the cleaned prompt, which equals cleaning
    ``[system] + prompt`` row by row. The candidate is carried
    in a one-element array through two filter stages and unpacked with ``inline``: the prompt is
    cleaned and checked first, and the completion is cleaned only for rows whose prompt passed.
    (A plain ``where`` on top of a cleaning projection would be pushed below it by the optimizer
    and re-evaluate the cleaning inside the filter condition.)
    """
    src = F.lit(source) if isinstance(source, str) else source
    prefix = constant_system(df.sparkSession, system_prompt) if system_prompt is not None else None
    raw = F.array(F.struct(prompt.alias("p"), completion.alias("c")))

    def cleaned_prompt(p):
        c = clean_messages(p, ROLES_PROMPT)
        return F.concat(prefix, c) if prefix is not None else c

    stage1 = F.filter(
        F.transform(raw, lambda e: F.struct(cleaned_prompt(e["p"]).alias("prompt"), e["c"].alias("c"))),
        lambda e: prompt_is_valid(e["prompt"], min_chars, max_chars),
    )
    stage2 = F.filter(
        F.transform(stage1, lambda e: F.struct(e["prompt"].alias("prompt"),
                                               clean_messages(e["c"], ("assistant",)).alias("completion"))),
        lambda e: completion_is_valid(e["completion"], min_chars, max_chars),
    )
    return df.select(*keep, F.inline(stage2), src.alias("source"))


def constant_system(spark, system_prompt: str) -> Column:
    """``[system]`` with the prompt normalised once on the driver, or ``[]`` when it is empty."""
    from chatsift.functions.text import normalized_literal

    content = normalized_literal(spark, system_prompt)
    if not content:
        return empty_messages()
    return F.array(message(F.lit("system"), F.lit(content)))


def example_signature(prompt: Column | str = "prompt", completion: Column | str = "completion") -> Column:
    return dedupe_signature(last_user_content(prompt), first_content(completion))


def clip_history(arr: Column | str, max_turns: int | Column) -> Column:
    """Clean a history (user/assistant only, non-empty) and keep its last ``2 * max_turns`` messages;
    ``max_turns <= 0`` or null gives an empty history."""
    cleaned = clean_messages(arr, ROLES_HISTORY)
    turns = F.lit(max_turns) if isinstance(max_turns, int) else max_turns
    keep = turns * 2
    clipped = F.slice(cleaned, F.greatest(F.size(cleaned) - keep + 1, F.lit(1)), keep)
    return F.when(F.coalesce(turns, F.lit(0)) > 0, clipped).otherwise(empty_messages())


def last_n(arr: Column, n: int) -> Column:
    """Last ``n`` elements of an array (all of them when shorter)."""
    return F.slice(arr, F.greatest(F.size(arr) - F.lit(n) + 1, F.lit(1)), n)


def render_messages(arr: Column | str) -> Column:
    """One comparable string per message array: ``role<US>content`` joined by ``<RS>``."""
    return F.array_join(
        F.transform(_col(arr), lambda m: F.concat(m["role"], F.lit(RENDER_FIELD_SEP), m["content"])),
        RENDER_MESSAGE_SEP,
    )


def render_chat_prompt(arr: Column | str, turn_prefix: str, role_suffix: str, turn_suffix: str,
                       generation_marker: str) -> Column:
    """Messages -> one prompt text with a trailing generation marker (markers are parameters)."""
    body = F.array_join(
        F.transform(
            _col(arr),
            lambda m: F.concat(F.lit(turn_prefix), m["role"], F.lit(role_suffix), m["content"], F.lit(turn_suffix)),
        ),
        "",
    )
    return F.concat(body, F.lit(generation_marker))
