"""JSON record-shape dispatch for mixed JSONL lines.

A line's shape is decided by key presence (not by non-null values), first match wins:
prompt+completion, input+output, user+assistant, messages; anything else is ``other``.
Blank lines are ``blank``; unparsable text and JSON values that are not objects are ``invalid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsift.functions.text import py_strip

# ---- fixed values: shapes in match order ------------------------------------------------------
SHAPE_KEYS = (
    ("prompt_completion", ("prompt", "completion")),
    ("input_output", ("input", "output")),
    ("user_assistant", ("user", "assistant")),
    ("messages", ("messages",)),
)
# -----------------------------------------------------------------------------------------------

_STRICT = {"allowSingleQuotes": "false"}
FIELDS = ("struct<prompt: array<string>, completion: array<string>, messages: array<string>, input: string, output: string, "
          "user: string, assistant: string>")


def _col_or_name(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_object(value: Column | str) -> Column:
    """``keys`` (null unless the line holds exactly one JSON object) and ``fields`` of a stripped line.

    The parser stops after the first value, so the line is read twice, as the only element of an array and
    as the only field of an object: text that ends the one early leaves the other open. The one
    reading gives the keys, the other the fields that the shapes need (missing or of another type: null;
    scalars read as strings keep their JSON spelling). Accepts what Python's ``json`` accepts (NaN and
    infinities included), and neither trailing text, a second value, nor single quotes."""
    v = _col_or_name(value)
    element = F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<map<string,string>>", _STRICT)
    field = F.from_json(F.concat(F.lit('{"x":'), v, F.lit("}")), f"struct<x: {FIELDS}>", _STRICT)
    return F.struct(F.when(F.size(element) == 1, F.map_keys(F.get(element, F.lit(0)))).alias("keys"), field["x"].alias("fields"))


def _shape(value: Column, keys: Column, fields: Column) -> Column:
    expr = F.when(value == F.lit(""), F.lit("blank")).when(keys.isNull() | fields.isNull(), F.lit("invalid"))
    for label, names in SHAPE_KEYS:
        cond = F.lit(True)
        for n in names:
            cond = cond & F.array_contains(keys, n)
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit("other"))


def shape_label(value: Column | str) -> Column:
    """Shape of a line after stripping Python whitespace (as the original strips each line)."""
    v = py_strip(F.coalesce(_col_or_name(value), F.lit("")))
    read = line_object(v)
    return _shape(v, read["keys"], read["fields"])


def _last(entries: Column, key: str) -> Column:
    """The value of a key, of the last one where it is repeated."""
    own = F.filter(F.map_entries(entries), lambda e: e["key"] == F.lit(key))
    return F.try_element_at(own, F.lit(-1))["value"]


def parsed_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The other columns of ``lines`` plus ``value`` (stripped as Python does), ``shape``, ``input, output, user, assistant``, the
    message arrays ``first`` (messages or prompt) and ``second`` (completion), and ``reason``: why the line, or part of
    it, yields nothing (``invalid_json``: no single JSON object; ``unknown_shape``; ``bad_message``: an element
    of its message arrays is not an object).

    A line is read twice and each element of its message arrays once, on its own, so one bad element
    does not lose the others. Each step ends in a generator, below which the optimiser moves nothing, so
    whatever follows reads the columns and parses nothing again."""
    keep = [F.col(f"`{c}`") for c in lines.columns if c != value]
    text = py_strip(F.coalesce(F.col(value), F.lit("")))
    read = lines.select(*keep, F.inline(F.array(F.struct(text.alias("value"))))).select(
        *keep, "value", F.inline(F.array(line_object("value"))))
    shape = _shape(F.col("value"), F.col("keys"), F.col("fields"))
    shaped = read.withColumn("shape", shape)
    is_chat, is_pair = F.col("shape") == "messages", F.col("shape") == "prompt_completion"
    arrays = F.array(F.when(is_chat, F.col("fields.messages")).when(is_pair, F.col("fields.prompt")),
                     F.when(is_pair, F.col("fields.completion")))
    elements = F.transform(arrays, lambda a: F.transform(a, lambda e: F.from_json(e, "map<string,string>", _STRICT)))
    opened = shaped.select(*keep, "value", "shape", "fields", F.inline(F.array(F.struct(elements.alias("elements")))))
    bad = F.exists("elements", lambda a: F.coalesce(F.exists(a, lambda e: e.isNull()), F.lit(False)))
    reason = (F.when(F.col("shape") == "invalid", F.lit("invalid_json")).when(F.col("shape") == "other", F.lit("unknown_shape"))
              .when(bad, F.lit("bad_message")))
    both = lambda i: F.transform(F.get("elements", F.lit(i)), lambda e: F.struct(
        _last(e, "role").alias("role"), _last(e, "content").alias("content")))
    return opened.select(*keep, "value", "shape", *[F.col(f"fields.{c}").alias(c) for c in ("input", "output", "user", "assistant")],
                         both(0).alias("first"), both(1).alias("second"), reason.alias("reason"))
