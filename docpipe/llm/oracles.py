"""SQL, as DuckDB runs it, for the operators that SQL can express: plain set operations, not the operators' methods."""

from docpipe.llm.scripts import UNSPACED

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS h FROM documents),
w AS (SELECT doc_id, t, h, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS repeated FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, h, t, trim(regexp_replace(lower(x), '[\x09\x0B\x0C\x0D\x20]+', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, h, t, unnest(string_split(t, chr(10))) AS x FROM d)),
f AS (SELECT h, line FROM (SELECT h, line, count(DISTINCT doc_id) AS n, count(DISTINCT t) AS texts FROM l WHERE line <> '' GROUP BY h, line)
  JOIN (SELECT h, count(DISTINCT doc_id) AS docs FROM d GROUP BY h) USING (h) WHERE (n > 20 AND n > docs * 0.05) OR texts > 100),
m AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS gone FROM l JOIN f USING (h, line) GROUP BY doc_id),
b AS (SELECT doc_id, len(ws) AS n, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS symbols,
  len(ls) - len(list_distinct(ls)) AS dup, coalesce(repeated, 0) AS repeated, coalesce(gone, 0) AS gone FROM w LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
  CAST(repeated AS BIGINT) AS n_repeat_words, n < 50 OR 100 * repeated > 50 * n AS base_failed,
  NOT (n < 50 OR 100 * repeated > 50 * n) AND (n - gone) * 100 >= n * 30 AS kept, CAST(gone AS BIGINT) AS removed_words FROM b
"""

LINES = rf"""
WITH l AS (SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, trim(regexp_replace(regexp_replace(lower(xs[pos]), '([{UNSPACED}])', ' \1 ', 'g'), '[\x09\x0B\x0C\x0D\x20]+', ' ', 'g'), ' ') AS line
  FROM (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents))),
k AS (SELECT doc_id, pos, line, string_split(line, ' ') AS ws, row_number() OVER (ORDER BY doc_id, pos) AS place FROM l WHERE line <> ''),
f AS (SELECT line, min(place) AS head FROM k GROUP BY line),
e AS (SELECT line, ws, head, len(ws) AS n FROM k JOIN f USING (line) WHERE place = head AND len(ws) >= 5),
v AS (SELECT line, head, n, i, array_to_string(list_concat(list_slice(ws, 1, i - 1), list_slice(ws, i + 1, n)), ' ') AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM e)),
near AS (
  SELECT line FROM (SELECT line, head, min(head) OVER (PARTITION BY n, i, rest) AS best FROM v) WHERE best < head
  UNION SELECT v.line FROM v JOIN e ON v.rest = e.line AND e.head < v.head
  UNION SELECT e.line FROM v JOIN e ON v.rest = e.line AND v.head < e.head),
x AS (SELECT doc_id, list_sort(list(pos) FILTER (WHERE place <> head)) AS exact, list_sort(list(pos) FILTER (WHERE place = head AND near.line IS NOT NULL)) AS near
  FROM k JOIN f USING (line) LEFT JOIN near USING (line) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(exact), 0) AS BIGINT) AS n_exact, CAST(coalesce(len(near), 0) AS BIGINT) AS n_near,
  coalesce(array_to_string(exact, ','), '') AS exact_lines, coalesce(array_to_string(near, ','), '') AS near_lines
FROM documents LEFT JOIN x USING (doc_id)
"""

NEAR = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, dense_rank() OVER (ORDER BY doc_id, coalesce(text, '')) AS rid FROM documents),
o AS (SELECT DISTINCT rid, doc_id FROM t),
w AS (SELECT DISTINCT rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (SELECT DISTINCT rid, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.g = y.g AND x.rid < y.rid GROUP BY x.rid, y.rid),
e AS (SELECT a, b FROM p JOIN n AS x ON a = x.rid JOIN n AS y ON b = y.rid WHERE 100 * c >= 85 * (x.n + y.n - c)
  UNION SELECT x.rid, y.rid FROM o AS x JOIN o AS y ON x.doc_id = y.doc_id AND x.rid < y.rid WHERE x.rid IN (SELECT rid FROM n) AND y.rid IN (SELECT rid FROM n)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, reach) AS (SELECT rid, rid FROM n UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a),
m AS (SELECT node, min(doc_id) AS low FROM r JOIN o ON reach = o.rid GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(low, doc_id) = doc_id AS kept
FROM t LEFT JOIN n USING (rid) LEFT JOIN m ON rid = node
"""

URLS = r"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS u, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
w AS (SELECT *, list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(string_split_regex(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[/._-]'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g')),
    list_transform(list_filter(list_transform(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'q:' || x))) AS tokens FROM p),
l AS (SELECT row_number() OVER () AS n, tokens, quality = 0 OR toxic = 1 AS bad FROM w JOIN labels ON page_id = doc_id WHERE (quality = 0 OR toxic = 1) IS NOT NULL AND len(tokens) > 0),
a AS (SELECT count(*) FILTER (WHERE bad) / count(*) AS rate FROM l),
s AS (SELECT token, list(n) AS held, list(n) FILTER (WHERE bad) AS bads FROM (SELECT n, bad, unnest(tokens) AS token FROM l) GROUP BY token HAVING count(*) FILTER (WHERE bad) >= 20),
c(combo, held, bads) AS (SELECT [token], held, bads FROM s
  UNION ALL SELECT list_append(combo, token), list_intersect(c.held, s.held), list_intersect(c.bads, s.bads) FROM c JOIN s ON token > combo[-1] WHERE len(list_intersect(c.bads, s.bads)) >= 20),
m AS (SELECT combo FROM c, a WHERE len(bads) / len(held) >= 0.8 AND len(bads) / len(held) / rate >= 2),
f AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM w)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN EXISTS (SELECT 1 FROM m WHERE list_has_all(tokens, combo)) THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
