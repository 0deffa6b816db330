"""WARC derivatives: linked metadata and plain-text conversion records from response records.

Responses are rows (record_id, target_uri, date, content_type, payload). Each gives two records of
the WARC 1.1 format: ``metadata`` (application/warc-fields: source headers, language, links, sizes
and digests of the payload) and ``conversion`` (text/plain: the payload's text). Both name the
response in WARC-Refers-To with its target URI and date, have their own WARC-Record-ID, derived from
the response's so that a rebuild gives the same records, and carry the digests of their blocks; the
conversion also names the metadata record's source digest. Everything works on one row: no shuffle, no
state, any number of rows. All numeric and named character references are decoded; texts with others than
the common ones take a step in Python.

Nulls and edges: a null payload is an empty one; a missing target URI or date is left out of the
headers; a null record id is derived from the other columns; repeated rows give equal records; very
long payloads are converted whole; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
BLOCKS = ("address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|"
          "head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul")
# fixed values: the character references that column expressions decode
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
# what html.unescape may take for a reference, but for those above
_OTHER = rf"&(?!(?:{'|'.join(ref[1:] for ref, _ in ENTITIES)}))(?:#[0-9]|#[xX][0-9a-fA-F]|[A-Za-z])"


def record_id(*parts):
    """A urn:uuid made of a digest of the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def digest(text):
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


@F.arrow_udf(StringType())
def _decoded(texts: pa.Array) -> pa.Array:
    one = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
    space = re.compile("[\xa0\t\n\r\f]")  # as &nbsp; above; references to white space are folded too
    text = lambda m: space.sub(" ", entities.unescape(m[0]))
    return pa.array([None if t is None else one.sub(text, t) for t in texts.to_pylist()], pa.string())


def tagless(html):
    """A page with scripts, styles, comments and tags gone and block elements as line ends."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    t = F.regexp_replace(t, r"[ \t\r\n\f]+", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    return F.regexp_replace(t, r"<[^>]*>", "")


def decoded_text(t):
    """Text of a tagless page: references decoded once, white space folded, empty lines dropped."""
    known = t
    for ref, char in ENTITIES:
        known = F.replace(known, F.lit(ref), F.lit(char))
    t = F.coalesce(_decoded(F.when(t.rlike(_OTHER), t)), known)
    t = F.regexp_replace(t, r" *\n[ \n]*", "\n")
    return F.regexp_replace(F.regexp_replace(t, r" +", " "), r"^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response rows of a page table (page_id, url, html)."""
    return pages.select(
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                  F.coalesce("url", F.lit(""))).alias("record_id"),
        "page_id", F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.lit("text/html; charset=utf-8").alias("content_type"), F.col("html").alias("payload"))


def _header(name: str, value):
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))


def derivatives(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per response: ``keep`` columns, warc_type, record_id, refers_to, target_uri, date,
    content_type, content_length, block_digest, block, record (headers, blank line, block)."""
    src = rows.select(
        *keep, F.coalesce("record_id", record_id(
            F.lit("response"), F.coalesce("target_uri", F.lit("")), F.coalesce("payload", F.lit("")))).alias("refers_to"),
        "target_uri", "date", "content_type", F.coalesce("payload", F.lit("")).alias("payload"))
    src = src.withColumn("bare", tagless(F.col("payload"))).withColumns({"text": decoded_text(F.col("bare")), "payload_digest": digest(F.col("payload")),
                           "links": F.regexp_count("payload", F.lit(r"(?i)<a\b[^>]*\bhref"))})
    fields = F.concat_ws(
        CRLF, F.concat(F.lit("sourcePayloadDigest: "), F.col("payload_digest")),
        F.concat(F.lit("sourceContentLength: "), F.octet_length("payload").cast("string")),
        _header("sourceContentType", F.col("content_type")),
        _header("language", F.nullif(F.lower(F.regexp_extract("payload", r"(?i)<html\b[^>]*\blang=[\"']?([a-z]+)", 1)), F.lit(""))),
        F.concat(F.lit("outlinks: "), F.col("links").cast("string")),
        F.concat(F.lit("textLength: "), F.octet_length("text").cast("string")), F.lit(""))
    both = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("type"),
                 F.col("text").alias("block")))
    # the union of both kinds in one pass over the responses
    out = src.withColumn("r", F.explode(both)).select(
        *keep, F.col("r.warc_type").alias("warc_type"), record_id(F.col("r.warc_type"), F.col("refers_to")).alias("record_id"),
        "refers_to", "target_uri", "date", F.col("r.type").alias("content_type"),
        F.octet_length("r.block").cast("long").alias("content_length"), digest(F.col("r.block")).alias("block_digest"),
        "payload_digest", F.col("r.block").alias("block"))
    header = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("warc_type")),
        F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")), F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to")),
        _header("WARC-Refers-To-Target-URI", F.col("target_uri")), _header("WARC-Refers-To-Date", F.col("date")),
        _header("WARC-Target-URI", F.col("target_uri")), _header("WARC-Date", F.col("date")),
        F.concat(F.lit("WARC-Block-Digest: "), F.col("block_digest")),
        F.concat(F.lit("WARC-Source-Payload-Digest: "), F.col("payload_digest")),
        F.concat(F.lit("Content-Type: "), F.col("content_type")),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")))
    return out.withColumn("record", F.concat(header, F.lit(CRLF + CRLF), F.col("block")))


def write_warc(records: DataFrame, path: str) -> None:
    """Records as gzip part files, each record ended by two line ends as the format asks."""
    records.select("record").write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)
