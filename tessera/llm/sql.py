"""DuckDB SQL for the operators' queries that SQL can express."""

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM w)),
k AS (SELECT d.doc_id, md5(string_agg(s, '|' ORDER BY s)) AS k FROM documents d LEFT JOIN sh USING (doc_id) GROUP BY 1),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM k),
r AS (SELECT sh.doc_id, sh.s FROM sh JOIN c ON c.doc_id = sh.doc_id WHERE c.class_id = c.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM r a JOIN r b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * i >= 4 * (x.n + y.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT DISTINCT class_id AS a, class_id AS r FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.r = e.a),
g AS (SELECT a, min(r) AS group_id FROM reach GROUP BY 1),
deg AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1)
SELECT c.doc_id, c.class_id, coalesce(n_links, 0) AS n_links, group_id FROM c JOIN g ON g.a = c.class_id LEFT JOIN deg ON deg.a = c.class_id
"""

NOT_SPACE = "[^\\x20\\x09-\\x0D]"
LINE_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{NOT_SPACE}+') AS w FROM documents),
gram AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d))),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p FROM gram WHERE n > 1) GROUP BY 1),
line AS (SELECT r, doc_id, source, l, trim(regexp_replace(lower(l), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS k, len(regexp_extract_all(l, '{NOT_SPACE}+')) AS w
  FROM (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{NOT_SPACE}')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM line GROUP BY 1),
often AS (SELECT source, k, min(doc_id) AS keeper FROM line GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 20),
gone AS (SELECT l.r, sum(l.w) AS n FROM line l JOIN often o ON o.source IS NOT DISTINCT FROM l.source AND o.k = l.k AND l.doc_id IS DISTINCT FROM o.keeper GROUP BY 1),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 0.3e0 * n_words AS kept FROM b
"""

PASSAGES = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d))),
hit AS (SELECT doc_id, i - 1 AS s, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM win WHERE n > 1),
isle AS (SELECT doc_id, g, min(s) AS a, max(s) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM hit) GROUP BY 1, 2),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS n, count(*) AS k, string_agg(a || ':' || b, ',' ORDER BY a) AS p FROM isle GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_repeated_words, coalesce(k, 0) AS n_passages, coalesce(p, '') AS passages FROM d LEFT JOIN t USING (doc_id)
"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
iwin AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dwin AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM iwin))),
hit AS (SELECT doc_id, i, dwin.m, item_id FROM dwin JOIN iwin ON dwin.m = iwin.m AND dwin.s = iwin.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

STORED = """
SELECT doc_id, coalesce(doc_id % 4, 0)::INTEGER AS arrival, sha256(text) AS text_sha256, length(text)::BIGINT AS n_chars, TRUE AS within_target FROM documents
"""

TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SHARE = "(1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + v))"
DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TERMS} AS w FROM documents),
t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS k FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
kept AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY 1, 2 HAVING sum(k) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(t.n) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, kept.term, coalesce(t.n, 0) AS n, {SHARE.format(n="coalesce(t.n, 0)", total="coalesce(s.n, 0)")} AS p, {SHARE.format(n="kept.n", total="l.n")} AS q
  FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', term, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) FROM (SELECT lang, source, term, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
