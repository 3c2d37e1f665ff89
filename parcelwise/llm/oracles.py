"""SQL for DuckDB that computes the same rows as the queries, where SQL can express the operator."""

from __future__ import annotations

from .queries import CONTROL_CASE, LISTED_HOSTS, RULES, WARC_START

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URL_PARTS = r"""
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
""".replace("{UPPER}", UPPER).replace("{LOWER}", LOWER)

URLS = f"""
WITH u AS ({URL_PARTS}),
rules(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
listed(host) AS (VALUES {", ".join(f"('{h}')" for h in LISTED_HOSTS)}),
fits AS (
  SELECT u.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM u JOIN rules r ON ('.' || u.host) LIKE ('%.' || r.host) AND starts_with(u.path, r.path)
  GROUP BY u.page_id
), hit AS (SELECT DISTINCT u.page_id FROM u JOIN listed l ON ('.' || u.host) LIKE ('%.' || l.host))
SELECT u.page_id, u.host, u.path, f.rule, h.page_id IS NOT NULL AS listed,
  coalesce(f.verdict, CASE WHEN h.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fits f USING (page_id) LEFT JOIN hit h USING (page_id)
"""

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACE}'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
held AS (SELECT doc_id, n, x FROM e QUALIFY count(*) OVER (PARTITION BY x) > 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.x = b.x AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(id, other) AS (SELECT DISTINCT a, a FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = s.doc_id
"""

CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_CASE}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_CASE}'
), x AS (
  SELECT *, length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g')) +
    length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{WORD}') AS w FROM d),
windows AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM w),
grams AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM windows),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (VALUES (0), (1), (2)) o(k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
worded AS (
  SELECT *, translate(trim(regexp_replace(line, '{SPACE}', ' ', 'g'), ' '), '{UPPER}', '{LOWER}') AS h,
    len(regexp_extract_all(line, '{WORD}')) AS n
  FROM lines WHERE regexp_matches(line, '{WORD}')
),
sizes AS (SELECT source, count(DISTINCT t) AS documents FROM d GROUP BY source),
often AS (
  SELECT source, h FROM (SELECT source, h, count(DISTINCT t) AS n FROM worded GROUP BY source, h) c JOIN sizes s USING (source)
  WHERE s.documents >= 20 AND c.n > 0.1 * s.documents
),
per AS (
  SELECT l.doc_id, count(*) - count(DISTINCT l.line) AS n_dup_lines, count(o.h) AS n_frequent_lines, coalesce(sum(l.n) FILTER (o.h IS NOT NULL), 0) AS gone
  FROM worded l LEFT JOIN often o ON o.source = l.source AND o.h = l.h GROUP BY l.doc_id
),
all_ AS (
  SELECT d.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
    len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS n_symbols, coalesce(p.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    coalesce(p.n_frequent_lines, 0) AS n_frequent_lines, len(w.w) - coalesce(p.gone, 0) AS n_left_words
  FROM d JOIN w USING (doc_id) LEFT JOIN per p USING (doc_id) LEFT JOIN covered c USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_frequent_lines::BIGINT AS n_frequent_lines, n_left_words::BIGINT AS n_left_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left_words >= 0.5 * n_words AS kept
FROM all_
"""

DEDUP = f"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""

WARC = rf"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, html IS NULL AS bare, md5(coalesce(html, '')) AS m, {WARC_START} + (page_id % 97) * 3600 AS start,
    'day ' || (page_id % 97) AS modified, regexp_replace(url, '#.*$', '', 's') AS plain
  FROM pages
), r AS (SELECT *, regexp_replace(plain, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM p),
q AS (
  SELECT *, regexp_replace(regexp_replace(translate(regexp_extract(rest, '^[^/?]*', 0, 's'), '{UPPER}', '{LOWER}'), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1, 's'), '/(index\.html?)?$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1, 's'), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|ref)(=|$)'))), '&') AS query
  FROM r
), k AS (SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM q),
c AS (
  SELECT page_id * 8 + v.n AS record_id, url_key, start + 86400 * v.days AS seconds, v.n = 0 AS response, html, bare, m, modified, v.n,
    CASE WHEN v.n = 0 AND page_id % 5 <> 0 OR v.n IN (1, 4) THEN '"' || m || '"' WHEN v.n = 3 THEN '"x' || m || '"' END AS etag,
    CASE WHEN v.n IN (1, 4) THEN 'W/' ELSE '' END AS weak,
    CASE WHEN v.n IN (0, 1, 2) THEN modified END AS last_modified, CASE WHEN v.n IN (0, 4, 5) THEN m END AS digest
  FROM k CROSS JOIN (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (4, -400), (5, 5), (6, 6)) v(n, days)
), f AS (
  SELECT *, last_value(CASE WHEN response THEN {{'id': record_id, 'etag': etag, 'last_modified': last_modified, 'digest': digest, 'html': html, 'bare': bare}} END IGNORE NULLS)
    OVER (PARTITION BY url_key ORDER BY seconds, response DESC, record_id ROWS UNBOUNDED PRECEDING) AS found
  FROM c
), j AS (
  SELECT *, CASE WHEN found IS NULL THEN 'no_response'
    WHEN coalesce(found.etag = etag, found.last_modified = last_modified, found.digest = digest) IS NULL THEN 'unverified'
    WHEN coalesce(found.etag = etag, found.last_modified = last_modified, found.digest = digest) THEN 'resolved' ELSE 'mismatch' END AS verdict
  FROM f WHERE NOT response
)
SELECT record_id, url_key, seconds, verdict, CASE WHEN verdict = 'resolved' THEN found.id ELSE -1 END AS response_id,
  CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=' || n ||
    CASE WHEN found.bare THEN '' ELSE chr(10) || 'content-length: ' || length(found.html) END || chr(10) || 'content-type: text/html' ||
    coalesce(chr(10) || 'etag: ' || coalesce(weak || etag, found.etag), '') ||
    coalesce(chr(10) || 'last-modified: ' || coalesce(last_modified, found.last_modified), '') END AS headers,
  CASE WHEN verdict = 'resolved' AND NOT found.bare THEN length(found.html) ELSE -1 END AS payload_chars,
  CASE WHEN verdict = 'resolved' AND NOT found.bare THEN md5(found.html) END AS payload_md5
FROM j
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op2_url_filters": URLS,
        "op3_ngram_jaccard": JACCARD,
        "op6_chat_formatting": CHAT,
        "op7_quality_rules": QUALITY,
        "op9_exact_dedup": DEDUP,
        "op10_warc_revisits": WARC,
    }
