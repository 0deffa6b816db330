"""Text column functions: Python-exact strip, normalisation, length gate, dedup signature.

All functions map Column -> Column and stay inside Spark's built-in expressions (no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatsift.config import MAX_CHARS, MIN_CHARS, SIGNATURE_SEPARATOR

# ---- fixed values ---------------------------------------------------------------------
# The 29 characters Python's str.strip() removes.
PY_WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Characters rewritten before line splitting: zero-width space and curly quotes.
TRANSLATE_FROM = "\u200b\u2018\u2019\u201c\u201d"
TRANSLATE_TO = " ''\"\""
# ----------------------------------------------------------------------------------------

# UTF-8 lead bytes shared by every character of TRANSLATE_FROM
_MAPPED_PREFIX = bytes([0xE2, 0x80])
assert all(ch.encode("utf-8").startswith(_MAPPED_PREFIX) for ch in TRANSLATE_FROM)
# Python whitespace without LF: what stripping a single line removes
_WS_NO_LF_CHARS = PY_WHITESPACE_CHARS.replace("\n", "")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Strip exactly the characters Python's ``str.strip()`` strips (plain ``trim`` only strips
    U+0020). ``btrim`` with the explicit character set only touches the two ends of the string."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE_CHARS))


def _lines_stripped(s: Column) -> Column:
    """Split on LF, strip every line (Python whitespace), drop empty lines, join by LF."""
    lines = F.transform(F.split(s, "\n", -1), lambda line: F.btrim(line, F.lit(_WS_NO_LF_CHARS)))
    return F.array_join(F.filter(lines, lambda line: line != F.lit("")), "\n")


def _collapse_spaces(s: Column) -> Column:
    return F.regexp_replace(s, " {2,}", " ")


def normalize_text(c: Column | str) -> Column:
    """Canonical message text.

    Rules: null -> ""; CRLF/CR -> LF; U+200B -> space; curly quotes -> straight; in every line
    collapse runs of space/tab to one space and strip (Python whitespace); drop empty lines; join
    by LF. (The original's "3+ newlines -> 2" step can never fire once empty lines are gone, and
    its final strip is a no-op after per-line stripping.)

    Evaluation is chosen per row by cheap byte-level checks, so clean text pays for
    no regex and no split: texts with CR, tab, U+200B or curly quotes take the full path; other
    multi-line texts only collapse double spaces (if any) and strip lines; single-line texts only
    collapse double spaces (if any) and strip the ends. Each branch holds its work once; only the
    cheap input expression repeats.
    """
    s = F.coalesce(_col(c).cast("string"), F.lit(""))
    # U+200B and the four curly quotes all start with the UTF-8 bytes E2 80 (block U+2000-U+203F):
    # one byte search finds any of them; other characters of that block only send the row down
    # the exact full path.
    needs_mapping = (
        s.contains("\r") | s.contains("\t") | F.contains(s.cast("binary"), F.lit(_MAPPED_PREFIX))
    )
    mapped = F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for src, dst in zip(TRANSLATE_FROM, TRANSLATE_TO):
        mapped = F.replace(mapped, F.lit(src), F.lit(dst))
    mapped = F.replace(mapped, F.lit("\t"), F.lit(" "))
    has_double_space = s.contains("  ")
    return (
        F.when(needs_mapping, _lines_stripped(_collapse_spaces(mapped)))
        .when(s.contains("\n"), _lines_stripped(F.when(has_double_space, _collapse_spaces(s)).otherwise(s)))
        .when(has_double_space, F.btrim(_collapse_spaces(s), F.lit(_WS_NO_LF_CHARS)))
        .otherwise(F.btrim(s, F.lit(_WS_NO_LF_CHARS)))
    )


def clean_role(c: Column | str) -> Column:
    """``str(role).strip().lower()``; a missing role becomes "" (dropped by every role whitelist)."""
    return F.lower(py_strip(F.coalesce(_col(c).cast("string"), F.lit(""))))


def is_valid_length(c: Column | str, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """Length gate on an already normalised text (code points, like Python ``len``)."""
    return F.length(_col(c)).between(min_chars, max_chars)


def is_valid_text(c: Column | str, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """Normalise, then apply the length gate."""
    return is_valid_length(normalize_text(c), min_chars, max_chars)


def dedupe_signature(last_user: Column | str, first_completion: Column | str) -> Column:
    """``lower(last user) || '||' || lower(first completion)``; missing parts are empty strings."""
    return F.concat(
        F.lower(F.coalesce(_col(last_user), F.lit(""))),
        F.lit(SIGNATURE_SEPARATOR),
        F.lower(F.coalesce(_col(first_completion), F.lit(""))),
    )


_LITERAL_CACHE: dict[str, str] = {}


def normalized_literal(spark, text: str) -> str:
    """``normalize_text`` of a constant, evaluated once with Spark (the same function as for
    columns) and cached, so constant prompts are not re-normalised for every row."""
    if text not in _LITERAL_CACHE:
        _LITERAL_CACHE[text] = spark.range(1).select(normalize_text(F.lit(text))).first()[0]
    return _LITERAL_CACHE[text]
