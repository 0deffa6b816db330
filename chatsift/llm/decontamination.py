"""Benchmark decontamination with a positional inverted index. DataFrame operations only.

Phrases are looked up from their rarest terms: the corpus is scanned once to count the test terms,
each phrase picks its two rarest terms, a second scan stores the postings (document, term, position)
of just those terms, and the offset-adjusted lists of both are intersected: a phrase can only start
at ``position - offset`` where both lists agree. The few survivors are checked word for word against
the neighbourhood stored with the rarest term's posting. Phrases with a term the corpus lacks are
dropped before the second scan, as they cannot occur.

Size: only the set of looked-up terms is broadcast, in blocks of at most ``TERM_BLOCK`` terms, each
block being one scan; postings, phrases and matches are joined by shuffles on their keys, so neither
a large test set nor a hot term has to fit in one task. A third of all documents sharing a passage
costs matches in proportion to its occurrences.

Nulls and edges: null or empty text has no words; rows are told apart by id and text together, so null
and repeated ids are matched like any other, each row by its own text; test items without words match nothing; items with equal windows are all reported; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsift.llm.common import ascii_lower, stage

# one character per entry, not ranges: such a class is a single table lookup per character
SEPARATORS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
_ENUM = "".join(f"\\x{ord(c):02x}" for c in SEPARATORS)
WORD, GAP = f"[^{_ENUM}]+", f"[{_ENUM}]+"  # of a text whose A-Z are still upper case
WINDOW = 10
TERM_BLOCK = 200_000


def raw_words(text):
    """Words of a text, A-Z as they are, with an empty last entry after a closing separator. Null has
    none; splitting is about twice as fast as extracting matches."""
    return F.coalesce(F.split(F.ltrim(text, F.lit(SEPARATORS)), GAP), F.array().cast("array<string>"))


def phrase_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, phrase array): all runs of ``window`` words; a shorter item is one run."""
    words = items.select(F.col(id_col).alias("item_id"),
                         F.transform(F.filter(raw_words(F.col(text_col).cast("string")), lambda w: w != ""), ascii_lower).alias("w")).where(F.size("w") > 0)
    at = words.select("item_id", "w", F.explode(
        F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("s"))
    return at.select("item_id", F.slice("w", F.col("s") + 1, F.least(F.size("w"), F.lit(window))).alias("phrase"))


def _terms(docs: DataFrame) -> DataFrame:
    """(doc_id, words, pos, term): one row per word. The array column is only referred to, never
    copied, as long as a filter follows within the same generated code."""
    return docs.select("doc_id", raw_words(F.col("text")).alias("words")).select(
        "doc_id", "words", F.posexplode("words").alias("pos", "raw")).withColumn("term", ascii_lower(F.col("raw")))


def _blocks(terms: DataFrame, size: int) -> list[DataFrame]:
    """The term table cut into blocks of about ``size`` rows, each small enough to broadcast."""
    n = max(1, -(-terms.count() // size))
    return [terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i).select("term", "first") for i in range(n)]


def _scan(docs: DataFrame, terms: DataFrame, reach: int, block: int) -> DataFrame:
    """Postings (doc_id, term, pos, near, near_at) of the given terms; ``near`` holds the words at
    most ``reach`` away where ``first`` is set."""
    out = None
    for part in _blocks(terms, block):
        hit = _terms(docs).join(F.broadcast(part), "term")
        low = F.greatest(F.col("pos") - reach, F.lit(0))
        rows = hit.select(
            "doc_id", "term", "pos",
            F.when(F.col("first"), F.slice("words", low + 1, F.lit(2 * reach + 1))).alias("near"),
            F.when(F.col("first"), low).alias("near_at"))
        out = rows if out is None else out.unionByName(rows)
    return out


def phrase_matches(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   block: int = TERM_BLOCK) -> DataFrame:
    """Exact matches (doc_id, phrase_id, start, n_words, items) of ``phrases`` (item_id, phrase
    array of lower-cased words) in ``docs``. Equal phrases are looked up once; ``items`` lists the
    items that hold the phrase."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(
        "doc_id is not null")
    phrases = stage(
        phrases.groupBy("phrase").agg(F.collect_set("item_id").alias("items"))
        .withColumn("phrase_id", F.xxhash64(F.concat_ws(" ", "phrase"))), "phrases")
    reach = max(0, (phrases.agg(F.max(F.size("phrase"))).first()[0] or 1) - 1)
    offsets = phrases.select("phrase_id", F.posexplode("phrase").alias("off", "term"))
    asked = offsets.select("term", F.lit(False).alias("first")).distinct()
    counted = None
    for part in _blocks(asked, block):
        hit = _terms(docs).join(F.broadcast(part), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        counted = hit if counted is None else counted.unionByName(hit)
    counted = stage(counted, "term-counts")
    # per phrase its two rarest terms; a phrase with a term that never occurs is left out
    rare = offsets.join(counted, "term", "left").groupBy("phrase_id").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("r"))
    rare = rare.where(F.col("r")[0]["n"] > 0).select(
        "phrase_id", F.col("r")[0].alias("r1"), F.get(F.col("r"), F.lit(1)).alias("r2"))
    plan = stage(phrases.join(rare, "phrase_id").select(
        "phrase_id", "phrase", "items", F.col("r1.term").alias("t1"), F.col("r1.off").alias("o1"),
        F.col("r2.term").alias("t2"), F.col("r2.off").alias("o2")), "phrase-plan")
    needed = plan.select(F.col("t1").alias("term"), F.lit(True).alias("first")).unionByName(
        plan.where("t2 is not null").select(F.col("t2").alias("term"), F.lit(False).alias("first"))
    ).groupBy("term").agg(F.max("first").alias("first"))
    postings = stage(_scan(docs, needed, reach, block), "postings")
    one = postings.where("near is not null").join(plan.withColumnRenamed("t1", "term"), "term").select(
        "doc_id", "phrase_id", (F.col("pos") - F.col("o1")).alias("start"), "phrase", "items", "near", "near_at",
        F.col("t2").isNull().alias("single")).where("start >= 0")
    two = postings.join(plan.where("t2 is not null").select(F.col("t2").alias("term"), "phrase_id", "o2"), "term").select(
        "doc_id", "phrase_id", (F.col("pos") - F.col("o2")).alias("start"))
    met = one.where("not single").join(two, ["doc_id", "phrase_id", "start"], "left_semi").unionByName(
        one.where("single"))
    begin = F.greatest(F.col("start") - F.col("near_at") + 1, F.lit(1))  # filters may be reordered
    found = F.transform(F.slice("near", begin, F.size("phrase")), ascii_lower)
    return met.where(found == F.col("phrase")).select(
        "doc_id", "phrase_id", F.col("start").cast("long").alias("start"), F.size("phrase").alias("n_words"), "items")


def proximity_matches(docs: DataFrame, queries: DataFrame, span: int, id_col: str = "doc_id", text_col: str = "text",
                      block: int = TERM_BLOCK) -> DataFrame:
    """(doc_id, query_id, start): stretches of at most ``span`` words, beginning at word ``start``
    with a query term, that hold every distinct term of the query in any order.

    ``queries`` is (query_id, terms array of lower-cased words). The rarest term's postings are the
    anchors; the other lists join them on (document, query, position bucket), so a pair of distant
    positions never meets."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(
        "doc_id is not null")
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).where("term is not null")
    wanted = terms.select("term", F.lit(False).alias("first")).distinct()
    postings = stage(_scan(docs, wanted, 0, block).select("doc_id", "term", "pos"), "postings")
    counts = terms.join(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term", "left").na.fill(0, ["n"])
    rarest = counts.groupBy("query_id").agg(
        F.min(F.struct("n", "term")).alias("low"), F.count(F.lit(1)).alias("k")).where("low.n > 0").select(
        "query_id", F.col("low.term").alias("rare"), "k")
    lists = postings.join(terms.join(rarest, "query_id"), "term")
    anchors = lists.where("term = rare").select(
        "doc_id", "query_id", "k", F.col("pos").alias("at"),
        F.explode(F.sequence(F.floor(F.col("pos") / span) - 1, F.floor(F.col("pos") / span) + 1)).alias("cell"))
    others = lists.select("doc_id", "query_id", "term", "pos", F.floor(F.col("pos") / span).alias("cell"))
    near = anchors.join(others, ["doc_id", "query_id", "cell"]).where(F.abs(F.col("pos") - F.col("at")) < span)
    # at most 2 * span positions around one anchor
    around = near.groupBy("doc_id", "query_id", "k", "at").agg(
        F.collect_set(F.struct("pos", "term")).alias("p"))
    begins = around.select("doc_id", "query_id", "k", "at", "p", F.explode("p.pos").alias("start")).where(
        "start <= at and at < start + %d" % span)
    held = F.size(F.array_distinct(F.transform(
        F.filter("p", lambda x: (x["pos"] >= F.col("start")) & (x["pos"] < F.col("start") + span)),
        lambda x: x["term"])))
    return begins.where(held == F.col("k")).select("doc_id", "query_id", "start").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, items array of strings, ``keep`` columns): per document row its words, the
    words inside any occurrence of an item window, and the items with occurring windows."""
    text, kept = F.col(text_col).cast("string"), [f"kept{i}" for i in range(len(keep))]
    # a row is known by its id and text: rows equal in both have equal results
    row = F.struct(F.xxhash64(id_col, text).alias("a"), F.hash(text, F.col(id_col)).alias("b"))
    docs = docs.select(row.alias("row"), F.col(id_col).alias("name"), text.alias("text"),
                       *[F.col(c).alias(k) for c, k in zip(keep, kept)])
    found = stage(phrase_matches(docs, phrase_windows(items, item_col, item_text_col, window), "row", "text"),
                  "matches")
    hits = found.select("doc_id", "start", "n_words").distinct().select(
        "doc_id", F.explode(F.sequence("start", F.col("start") + F.col("n_words") - 1)).alias("at")).distinct(
    ).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("doc_id", F.explode("items").alias("item")).where("item is not null").distinct().groupBy(
        "doc_id").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items"))
    counts = docs.select(F.col("row").alias("doc_id"), "name", *kept, F.coalesce(
        F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    return counts.join(hits.join(named, "doc_id", "left"), "doc_id", "left").select(
        F.col("name").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        *[F.col(k).alias(c) for c, k in zip(keep, kept)])
