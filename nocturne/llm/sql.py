"""The numbered queries as SQL (DuckDB), where SQL can express them."""

SQL: dict[str, str] = {}

SQL["op1_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, line, doc_id * 2147483648 + i AS place FROM l WHERE line <> ''),
d AS (SELECT line, length(line) AS n, min(place) AS place FROM o GROUP BY line),
links AS (SELECT a.line AS a, b.line AS b FROM d a JOIN d b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND a.place < b.place WHERE a.n >= 32 AND b.n >= 32 AND levenshtein(a.line, b.line) <= 1),
near AS (SELECT line, count(*) AS links, bool_or(late) AS late FROM (SELECT a AS line, false AS late FROM links UNION ALL SELECT b, true FROM links) GROUP BY line),
judged AS (SELECT o.doc_id, length(o.line) AS n, o.place > d.place OR coalesce(late, false) AS goes, coalesce(links, 0) AS links FROM o JOIN d ON o.line = d.line LEFT JOIN near ON o.line = near.line),
sums AS (SELECT doc_id, count(*) FILTER (goes) AS n_removed, sum(n) FILTER (goes) AS n_chars_removed, sum(links) AS n_links FROM judged GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_chars_removed, 0)::BIGINT AS n_chars_removed, coalesce(n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sizes ON d.doc_id = sizes.doc_id LEFT JOIN sums ON d.doc_id = sums.doc_id"""

# DuckDB's levenshtein counts bytes (4 a character at most), so letters beyond ASCII become single bytes, pair by pair.
SQL["op1_line_dedup_whole"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, line, doc_id * 2147483648 + i AS place FROM l WHERE line <> ''),
d AS (SELECT line, length(line) AS n, min(place) AS place FROM o GROUP BY line),
rough AS MATERIALIZED (SELECT a.line AS a, b.line AS b FROM d a JOIN d b ON b.n BETWEEN a.n - 3 AND a.n + 3 AND a.place < b.place WHERE a.n >= 32 AND b.n >= 32 AND levenshtein(a.line, b.line) <= 12),
m AS (SELECT string_agg(chr(i::INTEGER), '' ORDER BY i) AS marks FROM range(1, 32) r(i) WHERE i NOT IN (9, 10, 13)),
told AS (SELECT a, b, marks, array_to_string(list_sort(list_distinct(regexp_extract_all(a || b, '[^\x00-\x7F]'))), '') AS wide FROM rough CROSS JOIN m),
links AS (SELECT a, b FROM told WHERE CASE WHEN length(wide) > length(marks) THEN error('too many letters beyond ASCII') ELSE levenshtein(translate(a, wide, marks), translate(b, wide, marks)) <= 3 END),
near AS (SELECT line, count(*) AS links, bool_or(late) AS late FROM (SELECT a AS line, false AS late FROM links UNION ALL SELECT b, true FROM links) GROUP BY line),
judged AS (SELECT o.doc_id, length(o.line) AS n, o.place > d.place OR coalesce(late, false) AS goes, coalesce(links, 0) AS links FROM o JOIN d ON o.line = d.line LEFT JOIN near ON o.line = near.line),
sums AS (SELECT doc_id, count(*) FILTER (goes) AS n_removed, sum(n) FILTER (goes) AS n_chars_removed, sum(links) AS n_links FROM judged GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_chars_removed, 0)::BIGINT AS n_chars_removed, coalesce(n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sizes ON d.doc_id = sizes.doc_id LEFT JOIN sums ON d.doc_id = sums.doc_id"""

SQL["op2_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS word,
    generate_subscripts(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) AS i FROM documents),
g AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER f AS words, count(*) OVER f AS n FROM w
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY words) AS low FROM g WHERE n = 13),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM m WHERE low < doc_id),
kept AS (
  SELECT w.doc_id, count(*) AS n_words, count(gone.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.i) FILTER (gone.i IS NULL), '') AS text
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

_RULED = """CASE WHEN host = 'example.org' OR host LIKE '%.example.org' THEN
    CASE WHEN starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN starts_with(path, '/es/') THEN 'example.org/es/' WHEN starts_with(path, '/') THEN 'org/' END
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' END"""
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _parts(url: str) -> str:
    rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"{_ASCII_LOWER.format(f'regexp_extract({rest}, $q$^[^/?#]*$q$)')} AS host, regexp_extract({rest}, $q$^[^/?#]*([^?#]*)$q$, 1) AS path, regexp_extract({rest}, $q$^[^/?#]*([^#]*)$q$, 1) AS tail"


_NAME = "CASE WHEN host <> '' THEN host || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END END"

SQL["op3_url_filters"] = f"""
WITH RECURSIVE p AS (SELECT page_id, html, {_parts("coalesce(url, '')")} FROM pages),
named AS (SELECT *, {_NAME} AS name, {_RULED} AS rule FROM p),
tags AS (SELECT name, host, path, unnest(regexp_extract_all(html, '<(?:link|meta)\\s[^>]*>', 0, 'i')) AS tag FROM named WHERE name IS NOT NULL),
told AS (
  SELECT name, host, path, replace(trim(regexp_extract(tag, '\\shref\\s*=\\s*[''"]?([^''">\\s]*)', 1, 'i')), '&amp;', '&') AS t FROM tags WHERE regexp_matches(tag, '\\srel\\s*=\\s*[''"]?[^''">]*canonical', 'i')
  UNION ALL
  SELECT name, host, path, replace(trim(regexp_extract(tag, '[;,]\\s*url\\s*=\\s*([^">]*)', 1, 'i'), ' ''"'), '&amp;', '&') FROM tags WHERE regexp_matches(tag, '\\shttp-equiv\\s*=\\s*[''"]?refresh', 'i')),
full_urls AS (
  SELECT name, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
    WHEN starts_with(t, '/') THEN 'http://' || host || t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(t, '?') THEN 'http://' || host || path || t
    WHEN starts_with(t, '#') THEN NULL ELSE 'http://' || host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || t END AS target FROM told WHERE t <> ''),
ends AS (SELECT name AS a, {_parts("target")} FROM full_urls WHERE target IS NOT NULL),
one_way AS (SELECT a, {_NAME} AS b FROM ends),
e AS (SELECT a, b FROM one_way WHERE a <> b UNION SELECT b, a FROM one_way WHERE a <> b),
all_names AS (SELECT a AS name, {_parts("'x://' || a")} FROM (SELECT DISTINCT a FROM e)),
blocked AS (
  SELECT name FROM all_names WHERE {_RULED} IN ('example.org/es/', 'example.org/en/1', 'com/de/')
  UNION SELECT e.b FROM blocked JOIN e ON blocked.name = e.a)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN named.name IN (SELECT name FROM blocked) THEN 'block' ELSE 'allow' END AS verdict FROM named"""

SQL["op4_decontamination"] = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word,
    generate_subscripts(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1) AS i FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS size, array_to_string(list_slice(ws, k, k + least(len(ws), 13) - 1), ' ') AS words
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS k FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT a.doc_id, a.i, s.size, string_agg(b.word, ' ' ORDER BY b.i) AS words FROM w a CROSS JOIN (SELECT size FROM sizes WHERE size < 13) s JOIN w b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + s.size - 1
  GROUP BY a.doc_id, a.i, s.size HAVING count(*) = s.size
  UNION ALL
  SELECT doc_id, i, 13, words FROM (
    SELECT doc_id, i, string_agg(word, ' ') OVER f AS words, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) WHERE n = 13),
found AS (SELECT doc_id, i, r.size, item_id FROM runs r JOIN windows v ON r.words = v.words AND r.size = v.size),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) AS contaminated
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

SQL["op5_minhash_near_dedup"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t WHERE len(ws) >= 5),
s AS (
  SELECT DISTINCT doc_id, words FROM (
    SELECT doc_id, string_agg(word, ' ') OVER f AS words, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM t WHERE len(ws) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.words = y.words AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * pairs.n >= 85 * (p.n + q.n - pairs.n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON reach.r = a),
low AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes ON d.doc_id = sizes.doc_id LEFT JOIN low ON d.doc_id = low.doc_id"""


def _told(side: int, part: str, name: str) -> str:
    return f"coalesce(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY i) FILTER (side = {side} AND i {part} n), '') AS {name}"


def _spans(side: int, name: str) -> str:
    return f"coalesce(string_agg((stop - length(text) - 11) || '-' || (stop - 1), ',' ORDER BY i) FILTER (side = {side} AND i > n AND role = 'assistant'), '') AS {name}"


def _learned(side: int, name: str) -> str:
    return f"coalesce(sum(length(text) + 10) FILTER (side = {side} AND i > n AND role = 'assistant'), 0)::BIGINT AS {name}"


SQL["op6_chat_formatting"] = f"""
WITH t AS (
  SELECT (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id, (conv_id % 2 + 2) % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, 9223372036854775807), coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
j AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i, coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i),
k AS (SELECT pair_id, coalesce(min(i) FILTER (NOT same) - 1, count(*)) AS n FROM j GROUP BY 1),
u AS (SELECT t.*, n, sum(CASE WHEN i > n THEN length(role) + length(text) + 24 ELSE 0 END) OVER (PARTITION BY t.pair_id, side ORDER BY i) AS stop FROM t JOIN k ON t.pair_id = k.pair_id)
SELECT pair_id, 2 * pair_id AS chosen_id, 2 * pair_id + 1 AS rejected_id, any_value(n) AS n_prompt_turns,
  {_told(0, "<=", "prompt")}, {_told(0, ">", "chosen")}, {_told(1, ">", "rejected")}, {_learned(0, "chosen_learned")}, {_learned(1, "rejected_learned")},
  {_spans(0, "chosen_spans")}, {_spans(1, "rejected_spans")}
FROM u GROUP BY pair_id"""
