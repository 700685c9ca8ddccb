"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLE_SQL = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
c AS (SELECT md5(array_to_string(list_sort(sh), chr(10))) AS node, min(doc_id) AS rep, any_value(sh) AS sh, any_value(len(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY 1),
t AS (SELECT rep, n, unnest(sh) AS g FROM c),
o AS (SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep
      AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2),
l AS (SELECT x, y FROM o WHERE 100 * k >= 90 * (nx + ny - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT rep AS v, rep AS u FROM c UNION SELECT r.v, e.y FROM r JOIN e ON e.x = r.u),
m AS (SELECT v, min(u) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.sh) > 0 AND c.node = md5(array_to_string(list_sort(s.sh), chr(10))) LEFT JOIN m ON m.v = c.rep
""",
    "op1_chat_formatting": r"""
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position, CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS n_calls,
  CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_invalid, CAST(NULL AS VARCHAR) AS call_id, '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS json
FROM conversations
""",
    "op5_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS g
      FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
s AS (SELECT DISTINCT n FROM w),
g AS (SELECT doc_id, s.n AS n, i, array_to_string(ws[i : i + s.n - 1], ' ') AS g FROM (SELECT doc_id, ws, s.n, unnest(range(1, len(ws) - s.n + 2)) AS i FROM d, s WHERE len(ws) >= s.n) s),
h AS (SELECT doc_id, item_id, i, g.n FROM g JOIN w ON g.g = w.g AND g.n = w.n),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
q AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
""",
    "op13_quality_rules": r"""
WITH
d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
o AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(ws) AS word FROM w WHERE lang IS NOT NULL) WHERE strlen(word) <= 6 AND NOT contains(word, ',') GROUP BY 1, 2),
k AS (SELECT lang, list(word ORDER BY place) AS common FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM o) WHERE place <= 16 GROUP BY 1),
c1 AS (SELECT r, t, regexp_replace(t, '\p{Ll}', '', 'g') AS a FROM d), c2 AS (SELECT *, regexp_replace(a, '\p{Lu}', '', 'g') AS b FROM c1),
c3 AS (SELECT *, regexp_replace(b, '\p{N}', '', 'g') AS c FROM c2), c4 AS (SELECT *, regexp_replace(c, '[\x20\x09-\x0D]', '', 'g') AS e FROM c3),
c5 AS (SELECT *, regexp_replace(e, '[.,;:?''\x22()-]', '', 'g') AS f FROM c4),
ch AS (SELECT r, [length(t) - length(a), length(a) - length(b), length(b) - length(c), length(c) - length(e), length(e) - length(f), length(f)] AS cs FROM c5),
hits AS (SELECT r, common, ws, list_transform(list_filter(ws, lambda x: list_contains(common, x)), lambda x: list_position(common, x)) AS h FROM w JOIN k USING (lang)),
wd AS (SELECT r, list_transform(range(1, 17), lambda i: len(list_filter(h, lambda x: x = i))) || [len(ws) - len(h)] AS us FROM hits),
m AS (SELECT w.*, len(ws) AS n, cs, us FROM w JOIN ch USING (r) LEFT JOIN wd USING (r)),
x AS (SELECT r, lang, n, 'c' AS kind, unnest(range(1, 7)) AS i, unnest(cs) / list_sum(cs) AS p FROM m WHERE n >= 30
      UNION ALL SELECT r, lang, n, 'w', unnest(range(1, 18)), unnest(us) / list_sum(us) FROM m WHERE n >= 30 AND us IS NOT NULL),
ref AS (SELECT lang, kind, i, avg(p) AS q FROM x WHERE lang IN (SELECT lang FROM m WHERE n >= 30 AND us IS NOT NULL GROUP BY lang HAVING count(*) >= 50) GROUP BY 1, 2, 3),
js AS (SELECT r, any_value(x.n) AS n, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS dist
       FROM x JOIN ref USING (lang, kind, i) GROUP BY r, kind),
far AS (SELECT DISTINCT r FROM js WHERE dist > CASE kind WHEN 'c' THEN 0.2 + 1.0 / sqrt(n) ELSE 0.18 + 2.0 / sqrt(n) END),
g AS (SELECT r, i, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, count(DISTINCT j) AS k FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
ln AS (SELECT r, count(*) - count(DISTINCT l) AS k FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
base AS (SELECT m.r, doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(t) - cs[4] AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(ln.k, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.k, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN ln USING (r) LEFT JOIN rep USING (r))
SELECT * EXCLUDE (r), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR r IN (SELECT r FROM far)) AS kept FROM base
""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE
f AS (SELECT *, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS c0,
        CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END AS c1,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
        coalesce(strlen(text) || ':' || text, '-') AS b,
        xor(list_reduce(flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
          lambda i: list_transform(range(0, 8), lambda k: (ascii(CAST(doc_id AS VARCHAR)[i]) >> k) & 1))),
          lambda c, x: xor(c >> 1, (xor(c, x) & 1) * 3988292384), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS crc FROM documents),
l AS (SELECT doc_id, lang, sha256(a || c0 || b) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256(a || c1 || b) END AS tampered FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree FROM l),
up AS (
  SELECT tree, 0 AS level, i, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM p
  UNION ALL
  SELECT tree, level + 1, i // 2, sha256(node || coalesce(next, '')), (n + 1) // 2
  FROM (SELECT *, lead(node) OVER (PARTITION BY tree ORDER BY i) AS next FROM up WHERE n > 1) WHERE i % 2 = 0),
top AS (SELECT tree, node FROM up WHERE n = 1),
hi AS (
  SELECT 0 AS level, tree - 1 AS i, node, count(*) OVER () AS n FROM top
  UNION ALL
  SELECT level + 1, i // 2, sha256(node || coalesce(next, '')), (n + 1) // 2
  FROM (SELECT *, lead(node) OVER (ORDER BY i) AS next FROM hi WHERE n > 1) WHERE i % 2 = 0),
s AS (
  SELECT p.tree, p.i, u.level, CASE WHEN v.node IS NULL THEN '-' WHEN v.i < u.i THEN 'L' || v.node ELSE 'R' || v.node END AS e
  FROM p JOIN up u ON u.tree = p.tree AND u.i = p.i >> u.level AND u.n > 1 LEFT JOIN up v ON v.tree = u.tree AND v.level = u.level AND v.i = xor(u.i, 1)
  UNION ALL
  SELECT p.tree, p.i, 1000 + u.level, CASE WHEN v.node IS NULL THEN '-' WHEN v.i < u.i THEN 'L' || v.node ELSE 'R' || v.node END
  FROM p JOIN hi u ON u.i = (p.tree - 1) >> u.level AND u.n > 1 LEFT JOIN hi v ON v.level = u.level AND v.i = xor(u.i, 1)),
q AS (SELECT tree, i, list(e ORDER BY level) AS es FROM s GROUP BY 1, 2),
r AS (SELECT node AS root FROM hi WHERE n = 1),
z AS (SELECT doc_id, leaf, top.node AS subroot, root, sha256(coalesce(array_to_string(list_transform(es, lambda x: x[2:]), ''), '')) AS proof_sha256,
        list_reduce(coalesce(es, []), lambda h, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || h) WHEN 'R' THEN sha256(h || x[2:]) ELSE sha256(h) END, coalesce(tampered, leaf)) AS folded_root
      FROM p JOIN top USING (tree) CROSS JOIN r LEFT JOIN q USING (tree, i))
SELECT *, folded_root = root AS verified FROM z
""",
}
