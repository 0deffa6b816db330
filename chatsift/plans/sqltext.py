"""DuckDB SQL fragments used by the oracle queries (an independent restatement in SQL of the
column functions, so the Spark plans can be checked against another engine)."""

from __future__ import annotations

from chatsift.config import MAX_CHARS, MIN_CHARS

# ---- fixed values ---------------------------------------------------------------------
# Python's str.strip() character class in RE2 syntax.
WS_RE2 = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# ----------------------------------------------------------------------------------------

US = "chr(31)"
RS = "chr(30)"


def lit(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')"


def normalize(e: str) -> str:
    s = f"coalesce(CAST({e} AS VARCHAR), '')"
    s = f"regexp_replace({s}, '\\r\\n?', chr(10), 'g')"
    quotes_from = lit("\u200b\u2018\u2019\u201c\u201d")
    quotes_to = lit(" ''\"\"")
    s = f"translate({s}, {quotes_from}, {quotes_to})"
    collapse = "regexp_replace(l, '[ \\t]+', ' ', 'g')"
    lines = f"string_split({s}, chr(10))"
    lines = f"list_transform({lines}, lambda l: {strip(collapse)})"
    lines = f"list_filter({lines}, lambda l: l <> '')"
    return f"array_to_string({lines}, chr(10))"


def clean_role(e: str) -> str:
    return "lower(" + strip(f"coalesce(CAST({e} AS VARCHAR), '')") + ")"


def valid_len(e: str, lo: int = MIN_CHARS, hi: int = MAX_CHARS) -> str:
    return f"coalesce(length({e}) BETWEEN {lo} AND {hi}, false)"


def render(e: str) -> str:
    """Same rendering as ``render_messages``: role<US>content joined by <RS>."""
    return f"array_to_string(list_transform({e}, lambda m: m.role || {US} || m.content), {RS})"


def msg(role: str, content: str) -> str:
    return f"{{'role': {role}, 'content': {content}}}"


def system_list(system_prompt: str) -> str:
    """``[system]`` with the normalised prompt, empty when it normalises to empty."""
    n = normalize(lit(system_prompt))
    return f"list_filter([{msg(lit('system'), n)}], lambda m: m.content <> '')"


def clean_list(e: str, roles: tuple[str, ...]) -> str:
    roles_sql = ", ".join(lit(r) for r in roles)
    t = f"list_transform(coalesce({e}, []), lambda m: {msg(clean_role('m.role'), normalize('m.content'))})"
    return f"list_filter({t}, lambda m: m.role IN ({roles_sql}) AND m.content <> '')"
