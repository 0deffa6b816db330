"""Language identification by Bayesian evidence fusion.

The posterior of a language adds four log terms:

- text: byte-trigram likelihood of the whole text, from a multinomial model of every declared
  language, fitted on a bounded sample of at most about ``SAMPLE_ROWS`` rows that declare it. Trigrams are not independent,
  so the log-likelihood ratio counts as if it came from at most ``EVIDENCE`` trigrams;
- declared markup language: P(declared | language);
- address suffix: P(last label of the host and leading language-like path segment | language);
- host prior: P(language | host), smoothed towards the registered domain, then towards all hosts, by
  Dirichlet weights, with the row's own vote taken out.

The last three are grouped counts over all rows of the languages that the text alone suggests; only
per-host, per-domain and per-value sums are shuffled, so a host with a third of all rows costs one
partial sum per task.

Nulls and edges: null and empty texts carry no text evidence and get the language of the other
terms; missing declarations, addresses and hosts count as values of their own; rows are judged one
by one, so repeated rows and ids do not matter; without any declared language the result has null
languages; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsift.llm.common import arrow_slices, stage, texts_of

SAMPLE_ROWS = 20_000
BUCKETS = 1 << 15
EVIDENCE = 200
PRIOR_WEIGHT = 10.0
_FOLD = bytes(0x20 if i in b"\t\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram of space-padded texts, and where each text's trigrams begin."""
    buf = np.frombuffer(b"".join(b" " + t.translate(_FOLD) + b" " for t in texts) + b"  ", dtype=np.uint8)
    wide = buf.astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2)
    bucket[ends[:-1] - 1] = bucket[-1]  # the one trigram that reaches into the next text counts as white space
    return bucket, np.concatenate(([0], ends[:-1]))


def _counter(langs: list[str]):
    at = {name: i for i, name in enumerate(langs)}

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in arrow_slices(batches, "text", 4_000_000):
            texts, names = texts_of(batch, "text"), batch.column("declared").to_pylist()
            own: dict[str, list[bytes]] = {}
            for t, name in zip(texts, names):
                own.setdefault(name, []).append(t)
            for name, held in own.items():
                n = np.bincount(_codes(held)[0], minlength=BUCKETS)
                total[name] = total[name] + n if name in total else n
        for name, n in total.items():
            bucket = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(bucket), at[name])), pa.array(bucket), pa.array(n[bucket])],
                names=["lang", "bucket", "n"])

    return run


def fit_text_model(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (language x bucket) from rows (text, declared, key).

    Languages are all declared values; the fit reads about ``sample_rows`` rows of each, drawn by hash
    of the key."""
    known = rows.where("declared is not null")
    counts = {r[0]: r[1] for r in known.groupBy("declared").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, BUCKETS))
    # the largest hash that is drawn, of all 2**64
    bounds = rows.sparkSession.createDataFrame(
        [(x, min((1 << 63) - 1, (sample_rows << 64) // n - (1 << 63))) for x, n in counts.items()], "declared string, top long")
    sample = known.join(F.broadcast(bounds), "declared").where(F.xxhash64("key") <= F.col("top"))
    grams = sample.select("text", "declared").mapInArrow(_counter(langs), "lang long, bucket long, n long").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS sums a language
    total = np.full((len(langs), BUCKETS), 0.5)
    total[grams.column("lang").to_numpy(), grams.column("bucket").to_numpy()] += grams.column("n").to_numpy()
    return langs, np.log(total / total.sum(axis=1, keepdims=True))


def _text_scores(model: np.ndarray, evidence: int):
    """Adds ``ll``: the tempered log-likelihood per language, less the best one; empty texts all 0."""

    def run(batches):
        for batch in arrow_slices(batches, "text", 2_000_000):
            texts = texts_of(batch, "text")
            bucket, starts = _codes(texts)
            n = np.fromiter(map(len, texts), dtype=np.float64, count=len(texts))
            ll = np.stack([np.add.reduceat(row[bucket], starts) for row in model], axis=1)
            ll *= (np.minimum(n, evidence) / (n + 2))[:, None]
            ll -= ll.max(axis=1, keepdims=True)
            flat = pa.array(ll.ravel())
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(model))
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep]
                + [pa.ListArray.from_arrays(offsets, flat), pa.array(n.astype(np.int64))],
                names=[*keep, "ll", "n_bytes"])

    return run


def _posterior(langs: list[str], base: np.ndarray, n_values: dict[str, int], prior_weight: float):
    """Best language and its probability from the text's scores and the counted votes."""
    k, overall, names = len(langs), (base + 1) / (base.sum() + len(langs)), pa.array(langs)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            matrix = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, k)
            voted = batch.column("vote").is_valid().to_numpy(zero_copy_only=False)
            vote = batch.column("vote").fill_null(0).to_numpy(zero_copy_only=False)
            own = np.zeros((n, k))
            own[np.arange(n), vote] = voted  # a row's own vote is taken out
            lp = matrix("ll") + sum(np.log((matrix(f"{c}_n") - own + 1) / (base + n_values[c])) for c in ("declared", "suffix"))
            domain, host = matrix("domain_n"), matrix("host_n")
            domain_total, host_total = (x.sum(axis=1, keepdims=True) - voted[:, None] + prior_weight for x in (domain, host))
            domain = (domain - own + prior_weight * overall) / domain_total
            lp += np.log((host - own + prior_weight * domain) / host_total)
            top = lp.argmax(axis=1)
            likely = 1 / np.exp(lp - lp[np.arange(n), top][:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), names.take(pa.array(top)), pa.array(likely), names.take(batch.column("vote")),
                 batch.column("declared"), batch.column("n_bytes")],
                names=["kept", "lang", "probability", "text_lang", "declared", "n_bytes"])

    return run


def url_host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def address_suffix(url):
    """Last label of the host plus a leading path segment that looks like a language tag."""
    last = F.regexp_extract(url_host(url), r"([^.]*)$", 1)
    tag = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2}(?:-[A-Za-z]{2})?)(?:[/?#]|$)", 1))
    return F.concat_ws("/", last, tag)


def markup_language(html):
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    return F.nullif(F.lower(found), F.lit(""))


def _domain(host):
    return F.regexp_extract(host, r"([^.]*\.[^.]*)$|^([^.]*)$", 0)


def identify(rows: DataFrame, keep: list[str], text: str, declared, suffix, host, sample_rows: int = SAMPLE_ROWS,
             evidence: int = EVIDENCE, prior_weight: float = PRIOR_WEIGHT) -> DataFrame:
    """``keep`` columns plus lang, probability, text_lang, declared, n_bytes: one row per input row.

    ``declared``, ``suffix`` and ``host`` are column expressions over ``rows``; pass a null literal
    where a table has no such evidence."""
    table = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text}`").cast("string").alias("text"),
        declared.cast("string").alias("declared"), F.coalesce(suffix.cast("string"), F.lit("")).alias("suffix"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"))
    langs, model = fit_text_model(
        table.select("text", "declared", F.coalesce(*[F.col(f"kept.`{c}`").cast("string") for c in keep]).alias("key")),
        sample_rows)
    if not langs:
        return table.select("kept.*", F.lit(None).cast("string").alias("lang"),
                            F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"),
                            "declared", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    k = len(langs)
    kind = table.schema["kept"].dataType.simpleString()
    scored = stage(
        table.mapInArrow(_text_scores(model, evidence),
                         f"kept {kind}, declared string, suffix string, host string, ll array<double>, n_bytes long")
        .withColumn("vote", F.when(F.col("n_bytes") > 0, F.array_position("ll", 0.0) - 1).cast("int"))
        .withColumn("domain", _domain(F.col("host"))), "language-evidence")
    # grouped counts of the votes, as one array of k sums per value
    def sums(key: str) -> DataFrame:
        pairs = scored.groupBy(key, "vote").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy(key).agg(
            F.map_from_entries(F.filter(F.collect_list(F.struct("vote", "n")), lambda x: x["vote"].isNotNull())).alias("votes"))
        return pairs.select(key, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(
            F.element_at("votes", i), F.lit(0.0))).alias(f"{key}_n"))

    base = np.zeros(k)
    for vote, n in scored.where("vote is not null").groupBy("vote").agg(F.count(F.lit(1))).collect():
        base[vote] = n
    given = {c: sums(c) for c in ("declared", "suffix")}
    n_values = {c: given[c].count() for c in given}
    out = scored
    for c in ("declared", "suffix"):
        out = out.join(given[c].withColumnRenamed(c, "value"), F.col(c).eqNullSafe(F.col("value")), "left").drop("value")
    out = out.join(sums("host"), "host", "left").join(sums("domain"), "domain", "left")
    return out.select("kept", "declared", "n_bytes", "vote", "ll", "declared_n", "suffix_n", "host_n", "domain_n").mapInArrow(
        _posterior(langs, base, n_values, prior_weight),
        f"kept {kind}, lang string, probability double, text_lang string, declared string, n_bytes long").select(
        "kept.*", "lang", "probability", "text_lang", "declared", "n_bytes")


def page_languages(pages: DataFrame) -> DataFrame:
    """Languages of web pages (page_id, url, html): declared markup language, address and host."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    rows = pages.select("page_id", "url", body.alias("page_text"), markup_language(F.col("html")).alias("markup"))
    return identify(rows, ["page_id", "url"], "page_text", F.col("markup"), address_suffix(F.col("url")),
                    url_host(F.col("url")))


def document_languages(docs: DataFrame) -> DataFrame:
    """Languages of documents (doc_id, text, lang, source): the language column is the declaration,
    the source the host."""
    return identify(docs, ["doc_id"], "text", F.col("lang"), F.lit(None), F.col("source"))


def rejected(min_probability: float = 0.5):
    """True for rows whose language cannot be told: no text, or no language ahead of the rest."""
    return (F.col("n_bytes") == 0) | F.col("lang").isNull() | (F.col("probability") < min_probability)
