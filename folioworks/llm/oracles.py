"""DuckDB SQL for the rows of the queries, where SQL can express them."""

OP6 = r"""
WITH d AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT item, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS k FROM bs),
ns AS (SELECT DISTINCT n FROM win),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n),
dk AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM ds),
hit AS (SELECT dk.doc_id, dk.s, dk.n, win.item FROM dk JOIN win ON dk.n = win.n AND dk.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP9 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         md5(string_agg(turn || chr(1) || rendered, chr(2)) OVER w) AS state,
         sum(length(rendered)) OVER w - length(rendered) AS "offset"
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT n_turns, state, min(conv_id) AS conv_id FROM r WHERE position = n_turns GROUP BY ALL),
kept AS (SELECT conv_id FROM whole WHERE NOT EXISTS (
  SELECT 1 FROM r WHERE r.position < r.n_turns AND r.position = whole.n_turns AND r.state = whole.state))
SELECT conv_id, position, n_turns, role, CAST("offset" AS BIGINT) AS "offset", rendered
FROM r WHERE conv_id IN (SELECT conv_id FROM kept)
"""

OP10 = r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS rid, url,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', chr(10), 'gis'), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
l AS (SELECT rid, host, unnest(list_distinct(lines)) AS line FROM p),
drops AS (
  SELECT host, line FROM (SELECT host, line, count(*) AS n FROM l GROUP BY ALL)
  JOIN (SELECT host, count(*) AS pages FROM p GROUP BY ALL) USING (host) WHERE n >= 3 AND n > pages * 0.1),
e AS (SELECT rid, host, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM p),
k AS (SELECT rid, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY i) AS kept
      FROM e WHERE NOT EXISTS (SELECT 1 FROM drops WHERE drops.host = e.host AND drops.line = e.line) GROUP BY rid)
SELECT page_id, host, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines), 0) - coalesce(n_kept, 0) AS BIGINT) AS n_dropped,
       CASE WHEN lines IS NULL THEN NULL ELSE coalesce(kept, '') END AS kept
FROM p LEFT JOIN k USING (rid)
"""

OP2 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(other) AS component_id FROM r GROUP BY ALL) USING (doc_id)
"""

# Bars in percent as in repetition.Rules: most frequent 2- to 4-gram, coverage of 5- to 10-grams, lines.
OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest(range(2, 11)) AS n) WHERE len(w) >= n)),
dup AS (SELECT rid, n, k, count(*) AS c FROM g GROUP BY ALL HAVING count(*) > 1),
occ AS (SELECT rid, n, i, k, c FROM g JOIN dup USING (rid, n, k)),
bars AS (SELECT * FROM (VALUES (2, 20), (3, 18), (4, 16), (5, 30), (6, 28), (7, 26), (8, 24), (9, 22), (10, 20)) AS v (n, pct)),
tops AS (SELECT rid, n, max(c * length(replace(k, ' ', ''))) AS chars FROM occ WHERE n <= 4 GROUP BY ALL),
pos AS (SELECT DISTINCT rid, n, unnest(range(i, i + n)) AS p FROM occ WHERE n >= 3),
cov AS (SELECT rid, n, count(*) AS words, sum(length(w[p])) AS chars FROM pos JOIN d USING (rid) GROUP BY ALL),
ln AS (
  SELECT rid, line, count(*) AS c FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dl AS (
  SELECT rid, sum(c - 1) AS n_dup, sum(CASE WHEN c > 1 THEN c * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) ELSE 0 END) AS chars
  FROM ln GROUP BY ALL),
f AS (
  SELECT d.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c3.words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(dl.chars, 0) AS BIGINT) AS line_chars
  FROM d LEFT JOIN dl USING (rid) LEFT JOIN (SELECT * FROM cov WHERE n = 3) c3 USING (rid)),
m AS (
  SELECT rid, n, chars FROM tops UNION ALL SELECT rid, n, chars FROM cov WHERE n >= 5),
wide AS (
  SELECT rid, @columns FROM m GROUP BY rid),
over AS (
  SELECT DISTINCT rid FROM m JOIN bars USING (n) JOIN f USING (rid) WHERE 100 * chars > pct * word_chars
  UNION SELECT rid FROM f WHERE 100 * line_chars > 40 * word_chars)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND rid NOT IN (SELECT rid FROM over) AS kept,
       @filled, line_chars
FROM f LEFT JOIN wide USING (rid)
"""
_MEASURES = {n: f"top_{n}" if n < 5 else f"covered_{n}" for n in range(2, 11)}
OP12 = OP12.replace("@columns", ", ".join(f"max(chars) FILTER (n = {n}) AS {name}" for n, name in _MEASURES.items())).replace(
    "@filled", ", ".join(f"CAST(coalesce({name}, 0) AS BIGINT) AS {name}" for name in _MEASURES.values()))

ORACLES = {"op12_repetition_rules": OP12, "op7_signature_forest": OP7, "op2_segment_topk": OP2, "op6_prefix_filter": OP6, "op9_chat_snapshots": OP9, "op10_site_lines": OP10}
