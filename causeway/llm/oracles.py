"""The same results in DuckDB's SQL, for the queries that SQL can express on small tables."""

from __future__ import annotations

WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

#: Components by label propagation over links(a, b), both ways, of ids(id): component of each id.
COMPONENTS = """
reach(id, root) AS (SELECT id, id FROM ids UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE r.root < l.b),
component AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

OP5 = """
WITH w AS (SELECT doc_id, WORDS AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM w),
g AS MATERIALIZED (SELECT doc_id, i, w[i] AS w1, CASE WHEN i > 1 THEN w[i - 1] END AS w0, CASE WHEN i > 2 THEN w[i - 2] END AS w00 FROM t),
c1 AS (SELECT w1 AS a, count(*) AS n FROM g GROUP BY ALL), o1 AS (SELECT doc_id, w1 AS a, count(*) AS n FROM g GROUP BY ALL),
c2 AS (SELECT w0 AS a, w1 AS b, count(*) AS n FROM g WHERE i > 1 GROUP BY ALL), o2 AS (SELECT doc_id, w0 AS a, w1 AS b, count(*) AS n FROM g WHERE i > 1 GROUP BY ALL),
c3 AS (SELECT w00 AS a, w0 AS b, w1 AS c, count(*) AS n FROM g WHERE i > 2 GROUP BY ALL), o3 AS (SELECT doc_id, w00 AS a, w0 AS b, w1 AS c, count(*) AS n FROM g WHERE i > 2 GROUP BY ALL),
total AS (SELECT count(*) AS n FROM g), size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY ALL),
e1 AS (SELECT o1.doc_id, o1.a, c1.n - o1.n AS n FROM o1 JOIN c1 USING (a)),
e2 AS (SELECT o2.doc_id, o2.a, o2.b, c2.n - o2.n AS n FROM o2 JOIN c2 USING (a, b)),
e3 AS (SELECT o3.doc_id, o3.a, o3.b, o3.c, c3.n - o3.n AS n FROM o3 JOIN c3 USING (a, b, c)),
p AS (SELECT g.doc_id, CASE WHEN i > 2 AND t3.n > 0 THEN t3.n / t2c.n WHEN i > 1 AND t2.n > 0 THEN CASE WHEN i > 2 THEN 0.4 ELSE 1 END * t2.n / t1c.n
  ELSE CASE WHEN i > 2 THEN 0.16 WHEN i > 1 THEN 0.4 ELSE 1 END * CASE WHEN t1.n > 0 THEN t1.n ELSE 0.4 END / greatest(1, total.n - size.n) END AS p
  FROM g JOIN total ON true JOIN size ON size.doc_id = g.doc_id
  JOIN e1 t1 ON t1.doc_id = g.doc_id AND t1.a = w1 LEFT JOIN e1 t1c ON t1c.doc_id = g.doc_id AND t1c.a = w0
  LEFT JOIN e2 t2 ON t2.doc_id = g.doc_id AND t2.a = w0 AND t2.b = w1 LEFT JOIN e2 t2c ON t2c.doc_id = g.doc_id AND t2c.a = w00 AND t2c.b = w0
  LEFT JOIN e3 t3 ON t3.doc_id = g.doc_id AND t3.a = w00 AND t3.b = w0 AND t3.c = w1)
SELECT w.doc_id, len(w.w) AS n_words, round(coalesce(s, 0), 4) AS log_score, round(s / nullif(len(w.w), 0), 6) AS mean_log
FROM w LEFT JOIN (SELECT doc_id, sum(ln(p)) AS s FROM p GROUP BY doc_id) x ON x.doc_id = w.doc_id
""".replace("WORDS", WORDS.format(text="coalesce(text, '')"))

U = "(CAST(CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0)"
OP6 = f"""
WITH RECURSIVE sizes AS (SELECT source AS s, CAST(sum(greatest(coalesce(length(text), 0), 1)) AS DOUBLE) AS n FROM documents GROUP BY source),
rates AS (SELECT s, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM sizes),
cuts(s, rate, k, l, total) AS (SELECT s, rate, 0, -rate, exp(-rate) FROM rates UNION ALL SELECT s, rate, k + 1, l + ln(rate / (k + 1)), total + exp(l + ln(rate / (k + 1))) FROM cuts WHERE k < rate + 12 * sqrt(rate) + 30),
drawn AS (SELECT d.*, (SELECT count(*) FROM cuts WHERE cuts.s IS NOT DISTINCT FROM d.source AND cuts.total <= {U}) AS n FROM documents d)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, CAST(CAST('0x' || substr(md5('mix-1#' || coalesce(CAST(doc_id AS VARCHAR), '') || '#' || copy), 1, 15) AS UBIGINT) AS BIGINT) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM drawn)
"""

OP7 = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
ids AS (SELECT id FROM v),
links AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id AND list_cosine_similarity(p.x, q.x) >= 0.9), {COMPONENTS}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = id
"""

OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
ids AS (SELECT id FROM w),
s AS MATERIALIZED (SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.id <> y.id GROUP BY ALL) JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)), {COMPONENTS}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM component LEFT JOIN n USING (id)
"""

OP10 = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
hit AS (SELECT doc_id, i FROM g JOIN (SELECT h, min(doc_id) AS first FROM g GROUP BY h) USING (h) WHERE first < doc_id),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit),
spans AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS spans, CAST(sum(b - a) AS BIGINT) AS n FROM (SELECT doc_id, min(i) - 1 AS a, max(i) AS b FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone) GROUP BY doc_id, run) GROUP BY doc_id),
kept AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w) t ANTI JOIN gone USING (doc_id, i) GROUP BY t.doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(spans, '') AS spans FROM w LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source)),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.n + 5 * v) AS p FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS MATERIALIZED (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(p.n) + 5) // (any_value(total) + 5 * any_value(v)) AS q FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM g GROUP BY lang) USING (lang) GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 50
"""

#: Rows whose vectors take part, in steps of 1 / 256.
QUANTIZED = """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id AS id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

OP12 = f"""
WITH {QUANTIZED},
s AS (SELECT q.r, q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP13 = f"""
WITH {QUANTIZED},
l AS MATERIALIZED (SELECT r, id, x, CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
s AS MATERIALIZED (SELECT a.r, a.id AS anchor_id, c.id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score FROM l a JOIN l c ON a.r <> c.r WHERE a.id % 100 = 0),
p AS (SELECT r, anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, positive_id ORDER BY s.score DESC, s.id) AS rank FROM p JOIN s ON s.r = p.r AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
