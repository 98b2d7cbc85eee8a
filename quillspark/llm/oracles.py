"""DuckDB statements that return the rows of the queries of the same names.

op2 (Feistel networks), op3 (byte-level suffixes of whole tables), op4 (BPE), op5 (a learned model)
and op8 (Huffman files) have none: their tests hold them against brute-force versions.
"""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op6_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS safe,
    length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS safe_role FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + safe_role + 2 + safe + 9)::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM marked GROUP BY conv_id
"""

ORACLES["op10_quality"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM words WHERE len(w) >= 8),
hashed AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS k FROM places),
twice AS (SELECT doc_id, i FROM hashed QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM words),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    (length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    w, l, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words
    OR 2 * len([x FOR x IN w IF regexp_matches(x, '\p{L}')]) < n_words
    OR bullets >= 5 AND n_lines >= 5 AND 10 * bullets > 9 * n_lines
    OR n_lines >= 5 AND 10 * dotted > 3 * n_lines) AS kept
FROM (SELECT *, len([x FOR x IN l IF regexp_matches(x, '^[ \t]*[-*•‣▪·][ \t]')]) AS bullets, len([x FOR x IN l IF regexp_matches(x, '(\.\.\.|…)[ \t\r]*\z')]) AS dotted FROM measured)
"""
# the character class of what is taken away is written the other way round
ORACLES["op10_quality"] = ORACLES["op10_quality"].replace(r"length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g'))", r"length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))")

ORACLES["op1_decontaminate"] = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, list_slice(w, i, i + least(8, len(w)) - 1) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 6, 2))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS k FROM places) JOIN windows USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLES["op7_minhash"] = rf"""
WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_slice(w, i, i + least(4, len(w)) - 1) AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM grams GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.k = y.k AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.a),
least AS (SELECT a, min(c) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""

ORACLES["op9_warc"] = r"""
WITH records AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
digests AS (
  SELECT page_id, html, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) % 32 + 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest
  FROM records),
lasts AS (SELECT html, max(page_id) AS last FROM records GROUP BY html)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, nullif(last, page_id) AS refers_to
FROM digests JOIN lasts USING (html)
"""
