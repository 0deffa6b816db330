"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"""regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_BLOCKS = ("address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|"
           "head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul")


def _warc() -> str:
    uuid = lambda x: (f"'<urn:uuid:' || substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-' || substr({x}, 13, 4) || '-' "  # noqa: E731
                      f"|| substr({x}, 17, 4) || '-' || substr({x}, 21, 12) || '>'")
    text = r"regexp_replace(payload, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gis')"
    text = rf"regexp_replace({text}, '[ \t\r\n\f]+', ' ', 'g')"
    text = rf"regexp_replace({text}, '</?(?:{_BLOCKS})\b[^>]*>', chr(10), 'gi')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for ref, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"),
                      ("&apos;", "chr(39)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&amp;", "'&'")):
        text = f"replace({text}, '{ref}', {char})"
    text = rf"regexp_replace({text}, ' *\n[ \n]*', chr(10), 'g')"
    text = rf"regexp_replace(regexp_replace({text}, ' +', ' ', 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    lang = r"""nullif(lower(regexp_extract(payload, '(?i)<html\b[^>]*\blang=["'']?([a-z]+)', 1)), '')"""
    return f"""
WITH src AS (SELECT page_id, url, coalesce(html, '') AS payload,
  md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS m FROM pages),
p AS (SELECT page_id, url, payload, {uuid('m')} AS refers_to, 'sha256:' || sha256(payload) AS payload_digest,
  {text} AS text FROM src),
b AS (
  SELECT page_id, url, refers_to, payload_digest, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    'sourcePayloadDigest: ' || payload_digest || chr(13) || chr(10) || 'sourceContentLength: ' || strlen(payload) || chr(13) || chr(10)
    || 'sourceContentType: text/html; charset=utf-8' || chr(13) || chr(10)
    || coalesce('language: ' || {lang} || chr(13) || chr(10), '')
    || 'outlinks: ' || len(regexp_extract_all(payload, '(?i)<a\\b[^>]*\\bhref')) || chr(13) || chr(10)
    || 'textLength: ' || strlen(text) || chr(13) || chr(10) AS block FROM p
  UNION ALL
  SELECT page_id, url, refers_to, payload_digest, 'conversion', 'text/plain; charset=utf-8', text FROM p),
r AS (SELECT *, md5(warc_type || '|' || refers_to) AS m, strlen(block) AS content_length,
  'sha256:' || sha256(block) AS block_digest, '2024-01-01T00:00:00Z' AS date FROM b),
i AS (SELECT *, {uuid('m')} AS record_id FROM r)
SELECT page_id, warc_type, record_id, refers_to, url AS target_uri, date, content_type,
  CAST(content_length AS BIGINT) AS content_length, block_digest, payload_digest, block,
  concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: ' || warc_type, 'WARC-Record-ID: ' || record_id,
    'WARC-Refers-To: ' || refers_to, 'WARC-Refers-To-Target-URI: ' || url, 'WARC-Refers-To-Date: ' || date,
    'WARC-Target-URI: ' || url, 'WARC-Date: ' || date, 'WARC-Block-Digest: ' || block_digest,
    'WARC-Source-Payload-Digest: ' || payload_digest, 'Content-Type: ' || content_type,
    'Content-Length: ' || content_length) || chr(13) || chr(10) || chr(13) || chr(10) || block AS record
FROM i"""


_QUANTISED = "[floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding]"
_FINITE = ("vec_id IS NOT NULL AND embedding IS NOT NULL "
           "AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)")

ORACLES = {
    "op1_decontamination": f"""
WITH iw AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS p, least(len(w), 10) AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM win),
runs AS (
  SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM dw CROSS JOIN ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, runs.k, item_id FROM runs JOIN win ON runs.p = win.p AND runs.k = win.k),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + k - 1)) AS at FROM (SELECT DISTINCT doc_id, s, k FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op2_mixing": """
WITH RECURSIVE k AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s,
    md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
r AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY key) - 1 AS nth FROM k),
g AS (SELECT s, count(*) AS n, CAST(floor(sqrt(count(*)) * 1000) AS BIGINT) AS raw FROM k GROUP BY s),
d AS (SELECT list_reduce(list(raw), lambda x, y: gcd(x, y)) AS common FROM g),
w AS (SELECT s, n, raw // common AS a, sum(raw // common) OVER () AS total FROM g, d),
al AS (SELECT list(a ORDER BY s) AS a, list(s ORDER BY s) AS names, CAST(max(total) AS BIGINT) AS p,
  max(CAST(((n + 63) // 64 * total + a - 1) // a AS BIGINT)) AS slots FROM w),
edf(t, c, pick) AS (
  SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT) FOR x IN a], CAST(NULL AS BIGINT) FROM al
  UNION ALL
  SELECT t + 1, [CASE WHEN i = best THEN c[i] + 1 ELSE c[i] END FOR i IN generate_series(1, len(c))], best FROM (
    SELECT t, c, list_min([CASE WHEN (c[i] * p) // a[i] <= t THEN ((c[i] + 1) * p + a[i] - 1) // a[i] * 1000000 + i
      ELSE 9000000000000000000 END FOR i IN generate_series(1, len(c))]) % 1000000 AS best
    FROM edf, al WHERE t < slots)),
placed AS (SELECT names[pick] AS s, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS block
  FROM edf, al WHERE pick IS NOT NULL),
bl AS (SELECT doc_id, source, r.s, nth // 64 AS block, nth % 64 AS rank, a, total FROM r JOIN w ON r.s = w.s)
SELECT doc_id, source, CAST(bl.block AS BIGINT) AS block, CAST(rank AS BIGINT) AS rank, CAST(slot AS BIGINT) AS slot,
  CAST((bl.block * total) // a AS BIGINT) AS release, CAST(((bl.block + 1) * total + a - 1) // a AS BIGINT) AS deadline
FROM bl JOIN placed ON bl.s = placed.s AND bl.block = placed.block""",
    "op6_warc": _warc(),
    "op11_hard_negatives": f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_QUANTISED} AS e
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
p AS (SELECT * FROM (
  SELECT a.vec_id AS anchor_id, a.label, a.e, b.vec_id AS positive_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS ps,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.e, b.e) DESC, b.vec_id) AS r
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE r <= 5),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS negative_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS ns
  FROM v a JOIN v b ON a.label <> b.label WHERE a.vec_id % 100 = 0),
n AS (SELECT anchor_id, positive_id, negative_id, ps, ns,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY ns DESC, negative_id) AS r
  FROM p JOIN s USING (anchor_id) WHERE 80 * ps <= 100 * ns AND 100 * ns <= 100 * ps)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE r <= 5""",
    "op13_exact_top_k": f"""
WITH v AS (SELECT vec_id, {_QUANTISED} AS e FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM r WHERE r <= 5""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k,
  CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(k) AS n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS a, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(k[1:a], '') AS prefix, array_to_string(k[a + 1:b], '') AS middle,
  array_to_string(k[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p""",
}
