"""DuckDB formulations of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: lower() would change other letters as well
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op4_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
keyed AS (SELECT *, {ASCII_LOWER.format(f"trim(line, {WHITE})")} AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, pos, line, s.last IS NOT NULL AND s.last <> doc_id AS gone FROM keyed LEFT JOIN shared s USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

ORACLES["op10_decontaminate"] = f"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS size FROM windows),
doc_words AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, size, unnest(generate_series(1, len(w) - size + 1)) AS i, w FROM doc_words, sizes WHERE len(w) >= size),
found AS (SELECT doc_id, i, size, item_id FROM places JOIN windows ON list_slice(w, i, i + size - 1) = win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

ORACLES["op2_url_rules"] = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, {ASCII_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts),
rules(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT s.page_id, host, path, rule,
       coalesce(action, CASE WHEN regexp_matches({ASCII_LOWER.format("host || path")}, '(^|[^a-z0-9])(adserver|adult|ads|betting|bets|bet|casino|casinos|clickbait|escort|escorts|gambling|hentai|keygen|lottery|nude|nudes|payday|poker|porn|popunder|sex|sexy|slots|spam|torrent|torrents|track|tracker|tracking|viagra|warez|webcam|xxx)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fit USING (page_id)"""

ORACLES["op7_lsh_forest"] = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(list_slice(w, i, i + least(len(w), 5) - 1)) AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes m ON m.doc_id = x JOIN sizes n ON n.doc_id = y WHERE 100 * shared >= 75 * (m.n + n.n - shared)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, w.y FROM reach r JOIN ways w ON r.y = w.x),
roots AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN roots ON x = d.doc_id LEFT JOIN sizes USING (doc_id)"""

ORACLES["op8_line_quality"] = f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
windows AS (SELECT doc_id, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, host, line FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM lines GROUP BY doc_id),
keyed AS (SELECT doc_id, host, {ASCII_LOWER.format(f"trim(line, {WHITE})")} AS k, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM lines),
hosts AS (SELECT host, count(DISTINCT doc_id) AS every FROM docs GROUP BY host),
common AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT doc_id) AS c FROM keyed GROUP BY host, k) JOIN hosts USING (host) WHERE c >= 10 AND c > every * 0.1),
gone AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS lost FROM keyed JOIN common USING (host, k) GROUP BY doc_id),
figures AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(lost, 0) AS n_removed_words
  FROM docs d JOIN words USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_removed_words <= n_words AS kept
FROM figures"""
