"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

#: Words, stripping and case of the contracts: ASCII white space, A-Z only.
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM d),
k AS (SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS key FROM e),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUALITY = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS th,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {SPACES}) <> '') AS l FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS v FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, v) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, source, th, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
x AS (SELECT DISTINCT source, th, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM d),
y AS (SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS key FROM x),
z AS (SELECT source, th, p, key, len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words FROM y WHERE key <> ''),
n AS (SELECT source, key FROM z GROUP BY source, key HAVING count(DISTINCT th) >= 10),
u AS (SELECT z.* FROM z JOIN n ON n.source IS NOT DISTINCT FROM z.source AND n.key = z.key),
o AS (SELECT z.source, z.th FROM z LEFT JOIN n ON n.source IS NOT DISTINCT FROM z.source AND n.key = z.key
      GROUP BY z.source, z.th HAVING sum(words) FILTER (WHERE n.key IS NOT NULL) > 0 AND sum(words) - sum(words) FILTER (WHERE n.key IS NOT NULL) >= 0.75 * sum(words)),
f AS (SELECT u.source, key FROM u JOIN o ON o.source IS NOT DISTINCT FROM u.source AND o.th = u.th GROUP BY u.source, key HAVING count(DISTINCT u.th) >= 10),
b AS (SELECT u.source, th, sum(words) AS gone FROM u JOIN f ON f.source IS NOT DISTINCT FROM u.source AND f.key = u.key GROUP BY u.source, th)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - coalesce(gone, 0) >= 0.5 * n_words AS kept,
       CAST(n_words - coalesce(gone, 0) AS BIGINT) AS n_left_words
FROM s LEFT JOIN b ON b.source IS NOT DISTINCT FROM s.source AND b.th = s.th
"""

#: Base 32 from the hexadecimal SHA-1: quintet i starts at bit 5i, so within the hexadecimal digits 5i//4 and the next.
ARCHIVE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS body FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h || '0', CAST(5 * i // 4 AS INTEGER) + 1, 2))::INTEGER >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM g
"""

#: Bytes as pairs of hexadecimal digits; islands of repeated window starts at most 200 apart are spans.
REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT r, doc_id, x, length(x) // 2 AS n_bytes FROM d),
p AS (SELECT r, unnest(range(0, n_bytes - 199)) AS i FROM n WHERE n_bytes >= 200),
w AS (SELECT p.r, i, md5(substr(x, CAST(2 * i + 1 AS INTEGER), 400)) AS h FROM p JOIN n ON n.r = p.r),
t AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
g AS (SELECT r, i, count(*) FILTER (WHERE gap IS NULL OR gap > 200) OVER (PARTITION BY r ORDER BY i) AS k FROM t),
s AS (SELECT r, k, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, k),
e AS (SELECT r, k, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY k), 0) AS z FROM s),
f AS (SELECT n.r, sum(b - a) AS n_removed, count(*) AS n_spans,
             string_agg(substr(x, CAST(2 * z + 1 AS INTEGER), CAST(2 * (a - z) AS INTEGER)), '' ORDER BY k) || substr(any_value(x), CAST(2 * max(b) + 1 AS INTEGER)) AS kept
      FROM e JOIN n ON n.r = e.r GROUP BY n.r)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM n LEFT JOIN f ON f.r = n.r
"""

#: Two start words before each text; the scored occurrence is left out of the counts; scores in millionths, each rounded before the sum.
SCORES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
t AS (SELECT r, unnest(w) AS w, unnest(list_concat([' '], w[:-2])) AS v, unnest(list_concat([' ', ' '], w)[:len(w)]) AS u FROM d WHERE len(w) > 0),
n3 AS (SELECT u, v, w, count(*) AS n FROM t GROUP BY u, v, w),
x3 AS (SELECT u, v, sum(n) AS x FROM n3 GROUP BY u, v),
n2 AS (SELECT v, w, sum(n) AS n FROM n3 GROUP BY v, w),
x2 AS (SELECT v, sum(n) AS x FROM n2 GROUP BY v),
n1 AS (SELECT w, sum(n) AS n FROM n2 GROUP BY w),
n0 AS (SELECT sum(n) AS n FROM n1),
m AS (SELECT n3.u, n3.v, n3.w, n3.n < 2 AS back, CAST(round(1e6 * CASE
        WHEN n3.n > 1 THEN ln((n3.n - 1)::DOUBLE / (x3.x - 1)::DOUBLE)
        WHEN n2.n > 1 THEN ln((n2.n - 1)::DOUBLE / (x2.x - 1)::DOUBLE * 0.4::DOUBLE)
        ELSE ln(n1.n::DOUBLE / n0.n::DOUBLE * {0.4**2!r}::DOUBLE) END) AS BIGINT) AS micro
      FROM n3 JOIN x3 USING (u, v) JOIN n2 USING (v, w) JOIN x2 USING (v) JOIN n1 USING (w), n0),
s AS (SELECT r, count(*) FILTER (WHERE back) AS n_backoff, sum(micro) AS micro FROM t JOIN m USING (u, v, w) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_backoff, 0) AS n_backoff, CAST(coalesce(micro, 0) AS BIGINT) AS score_micro FROM d LEFT JOIN s ON s.r = d.r
"""

#: Phrases as arrays of words; HUGEINT, as products may pass 64 bits.
PHRASES = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, (SELECT unnest(range(1, 5)) AS k)),
c AS (SELECT lang, g, k, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
s AS (SELECT c.lang, c.g, c.k, c.a, j, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
      FROM c, LATERAL (SELECT unnest(range(1, c.k)) AS j) JOIN c AS l ON l.lang = c.lang AND l.g = c.g[1:j] JOIN c AS r ON r.lang = c.lang AND r.g = c.g[j + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
i AS (SELECT lang, a, unnest(list_distinct(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda x: g[x:x + m - 1]))))) AS g FROM c WHERE k > 2),
m AS (SELECT lang, g, max(a) AS longer FROM i GROUP BY ALL),
f AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN m ON m.lang = b.lang AND m.g = b.g WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * b.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM f)
SELECT o.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""

#: div rounds down; all its operands are positive.
RANKED = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
d AS (SELECT r, doc_id, t, len(t) AS n FROM t WHERE len(t) > 0),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, a GROUP BY term, docs),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM benchmark),
q AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
s AS (SELECT q, item_id, d.r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN d ON d.r = f.r, a GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""

SQL = {"op3_backoff_scores": SCORES, "op8_suffix_dedup": REPEATS, "op2_warc_archive": ARCHIVE, "op6_quality_rules": QUALITY, "op9_line_dedup": LINES, "op12_suffix_phrases": PHRASES, "op13_clustered_search": RANKED}
