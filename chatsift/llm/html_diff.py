"""Main text of web pages by nearest-URL page differencing.

Pages of a host are sorted by URL path; each is paired with the neighbour whose path shares the
longer prefix, and the text lines of both are aligned by longest common subsequence. Lines that two
different pages share are template lines: menus, notices, footers. A shared line is deleted unless
the page says that it is article text, or it is on no more than the two pages and its place in the
markup holds different lines on most pages of the host (so that a copy of an article does not delete it). What pages never share word for word but
mark up as something else than article text (``nav``, ``footer``, ``form``, ``script``, elements
classed as adverts, and so on) is deleted from the markup alone.

Only line hashes travel for pairing, in blocks of ``BLOCK`` consecutive pages plus one page on either
side, so a host with a third of all pages is cut into many tasks; the lines to delete then meet the
pages again by a join. Pages of a host with equal lines are one page for pairing, at the first of their
paths, and each of them loses the lines that it shares. Alignment keeps one bit vector per line,
so pages of thousands of lines are aligned whole, and longer ones by halves in bounded memory.

Nulls and edges: null and empty html have no text; pages without a readable address pair within the
empty host; repeated rows each get their own result; unclosed and stray tags are tolerated; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsift.llm.common import arrow_slices, key_runs, stage
from chatsift.llm.embedding_dedup import ranked
from chatsift.llm.language_id import url_host

BLOCK = 256
MAX_BITS = 1 << 30  # of the vectors kept to align two pages
COPIES = 256  # pages of equal lines that one task gives their deletions
MANY_PAGES = 3  # different pages of a host: a shared line on so many is a template line at any place
SHARED_PLACE = 0.5  # share of a place's lines that must be shared for it to be a template's place

# fixed values: elements of the markup language by their role
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg iframe object select canvas audio video math".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "section summary table tbody td tfoot th thead tr ul".split())
_CLOSED_BY_BLOCK = frozenset(["p"])
_SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                 "th": ("td", "th"), "option": ("option",)}
_OUTSIDE = frozenset("nav footer aside form menu dialog button head".split())
_ARTICLE = frozenset(["article", "main"])
_OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup skip "
    "social sponsor sponsored subscribe toolbar widget".split())
_ARTICLE_WORDS = frozenset("ad ads advert comment comments promo related replies reply sponsored teaser".split())
_PAGE_WORDS = _OUTSIDE_WORDS | {"header", "topbar"}  # an article's own header holds its title
_MODIFIERS = frozenset("has is no with without".split())  # has-sidebar says something about the neighbours
_OUTSIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)>",
    re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAMES = re.compile(r"[A-Za-z]+")


def _is_outside(name: str, attrs: str, in_article: bool) -> bool:
    if name in _OUTSIDE or (name == "header" and not in_article):
        return True
    if "=" not in attrs and "hidden" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and not _OUTSIDE_ROLES.isdisjoint(value.split()):
            return True
        if key in ("class", "id") and name not in ("html", "body", "main"):
            words = _ARTICLE_WORDS if name == "article" else _OUTSIDE_WORDS if in_article else _PAGE_WORDS
            for one in value.split():
                parts = _NAMES.findall(one)
                if parts and parts[0] not in _MODIFIERS and not words.isdisjoint(parts):
                    return True
    return False


def page_lines(html: str) -> list[tuple[str, str, int]]:
    """(text, place, role) of each block with text, in page order. Place: the open block elements;
    role 0: unmarked, 1: in an article, -1: marked as something else."""
    out: list[tuple[str, str, int]] = []
    pieces: list[str] = []
    open_names: list[str] = []
    roles = [0]  # role after each open element
    at, n = 0, len(html)

    def flush():
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append((text, ">".join(x for x in open_names if x in _BLOCK and x != "p"), roles[-1]))

    def close_to(depth: int):
        del open_names[depth:]
        del roles[depth + 1:]

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            pieces.append(html[at:])
            break
        if lt > at:
            pieces.append(html[at:lt])
        m = _TOKEN.match(html, lt)
        if not m:  # a stray sign is text
            pieces.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["close"]:
            if name in _BLOCK:
                flush()
            if name in open_names:
                close_to(len(open_names) - 1 - open_names[::-1].index(name))
            continue
        attrs = m["attrs"]
        if name in _RAW:
            if name in ("svg", "math", "object", "select", "canvas", "audio", "video", "iframe"):
                pieces.append(" ")
            if not attrs.endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if name in _BLOCK:
            flush()
            if "p" in open_names and name != "br":
                close_to(len(open_names) - 1 - open_names[::-1].index("p"))
            for other in _SELF_CLOSING.get(name, ()):
                if open_names and open_names[-1] == other:
                    close_to(len(open_names) - 1)
        if name in _VOID or attrs.endswith("/"):
            continue
        role = roles[-1]
        if role >= 0 and _is_outside(name, attrs, role == 1):
            role = -1
        elif role == 0 and name in _ARTICLE:
            role = 1
        open_names.append(name)
        roles.append(role)
    flush()
    return out


def _growth(a: list[int], b: list[int]) -> np.ndarray:
    """Longest common subsequence with ``b`` of each prefix of ``a``, the empty one first."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        hit = v & where.get(y, 0)
        v = ((v + hit) | (v - hit)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(a)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices of ``a`` on a longest common subsequence with ``b``. Bit vectors over ``a``: one step
    and one kept vector per line of ``b`` between the common head and tail; where those would take more
    than ``MAX_BITS``, the lines are aligned by halves, which takes twice the steps."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    shared = list(range(head))
    if len(mid_a) * len(mid_b) > MAX_BITS and len(mid_b) > 1:  # by halves of b, each with the part of a that it fits best
        half = len(mid_b) // 2
        cut = int(np.argmax(_growth(mid_a, mid_b[:half]) + _growth(mid_a[::-1], mid_b[half:][::-1])[::-1]))
        shared += [head + i for i in common_lines(mid_a[:cut], mid_b[:half])]
        shared += [head + cut + i for i in common_lines(mid_a[cut:], mid_b[half:])]
    elif mid_a and mid_b:
        where: dict[int, int] = {}
        for i, x in enumerate(mid_a):
            where[x] = where.get(x, 0) | (1 << i)
        full = (1 << len(mid_a)) - 1
        v, kept = full, []  # a zero bit: the subsequence grows at this line of a
        for y in mid_b:
            hit = v & where.get(y, 0)
            v = ((v + hit) | (v - hit)) & full
            kept.append(v)
        i, j, picked = len(mid_a) - 1, len(mid_b) - 1, []
        while i >= 0 and j >= 0:
            if (kept[j] >> i) & 1:  # no growth at i with b[..j]
                i -= 1
            elif j and not (kept[j - 1] >> i) & 1:  # the same growth without b[j]
                j -= 1
            else:
                picked.append(head + i)
                i -= 1
                j -= 1
        shared += picked[::-1]
    return shared + list(range(len(a) - tail, len(a)))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _hashes(batches):
    """Keys and addresses of pages with the hashes, places and roles of their lines."""
    for batch in arrow_slices(batches, "html", 8_000_000):
        lines, places, roles = [], [], []
        for text in batch.column(batch.schema.get_field_index("html")).to_pylist():
            found = page_lines(text or "")
            lines.append([_hash(x[0]) for x in found])
            places.append([_hash(x[1]) for x in found])
            roles.append([x[2] for x in found])
        keep = ["k1", "k2", "host", "path"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(lines, pa.list_(pa.int64())),
             pa.array(places, pa.list_(pa.int64())), pa.array(roles, pa.list_(pa.int8()))],
            names=[*keep, "lines", "places", "roles"])


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _shared(batches):
    """Per page of a block: its shared lines, from the nearer different neighbour in its host."""
    for t in key_runs(batches, ["block"], 1):
        block, rank = t.column("block").to_numpy(), t.column("rank").to_numpy()
        host, path, lines = (t.column(c).to_pylist() for c in ("host", "path", "lines"))
        rows, shared, hits, paired = [], [], [], []
        for i in range(len(rank)):
            if rank[i] // BLOCK != block[i]:
                continue  # a neighbour of the block's first or last page
            best, size = None, -1
            for j in (i - 1, i + 1):
                if (0 <= j < len(rank) and abs(rank[j] - rank[i]) == 1 and block[j] == block[i] and host[j] == host[i]
                        and lines[j] != lines[i] and _prefix(path[i], path[j]) > size):
                    best, size = j, _prefix(path[i], path[j])
            rows.append(i)
            paired.append(best is not None)
            shared.append(common_lines(lines[i], lines[best]) if best is not None else [])
            hit = np.zeros(len(lines[i]), dtype=bool)
            hit[shared[-1]] = True
            hits.append(hit.tolist())
        if not rows:
            continue  # only the copy of a neighbour's last page
        part = t.take(pa.array(rows, pa.int64())).combine_chunks()
        cols = [part.column(c).combine_chunks() for c in ("host", "d1", "d2", "mixed", "lines", "places", "roles")]
        yield pa.RecordBatch.from_arrays(
            [*cols, pa.array(shared, pa.list_(pa.int32())), pa.array(hits, pa.list_(pa.bool_())), pa.array(paired, pa.bool_())],
            names=["host", "d1", "d2", "mixed", "lines", "places", "roles", "shared", "hits", "paired"])


def _texts(batches):
    for batch in arrow_slices(batches, "html", 8_000_000):
        pages = batch.column(batch.schema.get_field_index("html")).to_pylist()
        gone = batch.column(batch.schema.get_field_index("gone")).to_pylist()
        texts = []
        for html, drop in zip(pages, gone):
            drop = frozenset(drop or ())
            texts.append("\n".join(x[0] for i, x in enumerate(page_lines(html or ""))
                                   if x[2] > 0 or (x[2] == 0 and i not in drop)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per input row."""
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    keyed = rows.withColumns({"k1": F.xxhash64("page_id", "url", "html"), "k2": F.hash("html", "page_id", "url")})
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    hashed = keyed.select("k1", "k2", url_host(F.col("url")).alias("host"), path.alias("path"), "html").mapInArrow(
        _hashes, "k1 long, k2 int, host string, path string, lines array<long>, places array<long>, roles array<tinyint>")
    hashed = hashed.withColumns({"d1": F.xxhash64("lines"), "d2": F.hash("lines")})
    same = ["host", "d1", "d2"]
    marks = F.xxhash64("roles")
    once = hashed.groupBy(same).agg(
        F.min(F.struct("path", "k1", "k2", "lines", "places", "roles")).alias("m"),
        (F.min(marks) != F.max(marks)).alias("mixed"), F.count(F.lit(1)).alias("n"))
    order = ranked(once.select(*same, "mixed", "n", "m.path", "m.lines", "m.places", "m.roles"),
                   ["host", "path", "d1", "d2"], "page-lines")
    own = F.floor(F.col("rank") / BLOCK).cast("long")
    inside = F.col("rank") % BLOCK
    blocks = F.when((inside == 0) & (own > 0), F.array(own - 1, own)).when(
        inside == BLOCK - 1, F.array(own, own + 1)).otherwise(F.array(own))
    diffs = stage(
        order.select("*", F.explode(blocks).alias("block")).repartition("block").sortWithinPartitions(
            "block", "rank").select("block", "rank", *same, "mixed", "path", "lines", "places", "roles").mapInArrow(
            _shared, "host string, d1 long, d2 int, mixed boolean, lines array<long>, places array<long>, roles array<tinyint>, "
            "shared array<int>, hits array<boolean>, paired boolean"), "page-differences")
    # places of a host whose lines are mostly shared between paired pages
    at = diffs.where("paired").select("host", F.inline(F.arrays_zip("places", "hits")))
    held = at.groupBy("host", F.col("places").alias("place")).agg(F.avg(F.col("hits").cast("double")).alias("part")).where(
        F.col("part") >= SHARED_PLACE).select("host", "place")
    unmarked = F.filter(F.arrays_zip("lines", "roles"), lambda x: (x["roles"] == 0) | F.col("mixed"))
    often = diffs.select("host", F.explode(F.array_distinct(F.transform(unmarked, lambda x: x["lines"]))).alias("line")).groupBy(
        "host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MANY_PAGES).select("host", "line")
    # copies may be marked otherwise than the page that stands for them: each applies its own marks
    lines = diffs.select(*same, "mixed", "lines", "places", "roles", F.explode("shared").alias("i")).select(
        *same, "mixed", "i", F.get("lines", F.col("i")).alias("line"), F.get("places", F.col("i")).alias("place"),
        F.get("roles", F.col("i")).alias("role")).where("role = 0 or mixed")
    found = lines.join(held.withColumn("held", F.lit(True)), ["host", "place"], "left").join(
        often.withColumn("often", F.lit(True)), ["host", "line"], "left").where("held or often").groupBy(same).agg(
        F.collect_list("i").alias("gone"))
    # back to every copy; large groups of copies are dealt over several tasks
    many = F.broadcast(order.where(F.col("n") > COPIES).select(*same, F.ceil(F.col("n") / COPIES).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    copies = hashed.select("k1", "k2", *same).distinct().join(many, same, "left").withColumn(
        "salt", F.pmod("k1", parts).cast("int"))
    found = found.join(many, same, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    gone = copies.join(found, [*same, "salt"]).select("k1", "k2", "gone")
    return keyed.join(gone, ["k1", "k2"], "left").select("page_id", "url", "html", "gone").mapInArrow(
        _texts, f"page_id {kind}, url string, text string, n_chars long")
