"""DuckDB SQL for the queries that SQL can express.

The others use XXH64, CRC-32, a trained model or a tokenizer and are tested against
brute-force versions.
"""

from __future__ import annotations

LINE_DEDUP = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents
),
f AS (SELECT doc_id, i, trim(line, ' ') AS t FROM l WHERE trim(line, ' ') <> ''),
w AS (
  SELECT doc_id, i AS first, lead(i, 2) OVER p AS last,
    t || chr(10) || lead(t, 1) OVER p || chr(10) || lead(t, 2) OVER p AS run
  FROM f WINDOW p AS (PARTITION BY doc_id ORDER BY i)
),
o AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS k FROM w WHERE last IS NOT NULL
),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS i FROM o WHERE k > 1),
r AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS removed FROM c GROUP BY doc_id
),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text
  FROM l ANTI JOIN c USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN r.n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INT) AS n_lines,
  CAST(coalesce(r.n, 0) AS INT) AS n_removed, coalesce(r.removed, '') AS removed_lines
FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: LINE_DEDUP with shorter windows.
LINE_PASSAGES = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents
),
f AS (
  SELECT doc_id, i, trim(line, ' ') AS t, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n
  FROM l WHERE trim(line, ' ') <> ''
),
w AS (
  SELECT doc_id, i AS first, lead(i, 2) OVER p AS last,
    t || chr(10) || lead(t, 1) OVER p || chr(10) || lead(t, 2) OVER p AS run
  FROM f WINDOW p AS (PARTITION BY doc_id ORDER BY i)
  UNION ALL
  SELECT doc_id, i, IF(n + lead(n) OVER p >= 50, lead(i) OVER p, NULL), t || chr(10) || lead(t) OVER p
  FROM f WINDOW p AS (PARTITION BY doc_id ORDER BY i)
  UNION ALL
  SELECT doc_id, i, i, t FROM f WHERE n >= 50
),
o AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS k FROM w WHERE last IS NOT NULL
),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS i FROM o WHERE k > 1),
r AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS removed FROM c GROUP BY doc_id
),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text
  FROM l ANTI JOIN c USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN r.n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INT) AS n_lines,
  CAST(coalesce(r.n, 0) AS INT) AS n_removed, coalesce(r.removed, '') AS removed_lines
FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
),
root AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM root LEFT JOIN n USING (vec_id)
"""

MIXING = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7') AS h
  FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3.0::DOUBLE * size AS cap FROM s
),
q AS (
  SELECT *, row_number() OVER p AS k,
    (sum(size) OVER () - coalesce(sum(cap) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w WINDOW p AS (ORDER BY cap / weight, weight, source NULLS FIRST)
),
water AS (SELECT arg_min(level, k) AS level FROM q WHERE level * weight <= cap),
t AS (
  SELECT source, size, CAST(least(cap, coalesce((SELECT level FROM water) * weight, cap)) AS DOUBLE) AS target FROM w
),
rate AS (
  SELECT *, CASE WHEN size > 0 THEN CAST(floor(target / size) AS BIGINT) ELSE 0 END AS whole FROM t
),
classes AS (
  SELECT source, h, size, sum(size) AS mass FROM d GROUP BY source, h, size
),
places AS (
  SELECT *, coalesce(sum(mass) OVER (PARTITION BY source ORDER BY h, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM classes
)
SELECT d.doc_id, d.size, rate.size AS source_size, rate.target,
  CAST(d.size * (rate.whole + CASE WHEN target - whole * rate.size > 0
    AND places.at + places.mass / 2 <= target - whole * rate.size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN rate ON d.source IS NOT DISTINCT FROM rate.source
JOIN places ON d.source IS NOT DISTINCT FROM places.source AND d.h = places.h AND d.size = places.size
"""

# Every alignment on which five neighbouring words, or the five of the second mask, agree.
DECONTAMINATION = """
WITH dt AS (
  SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}]+'),
      lambda x: x <> '') AS w FROM documents)
),
bt AS (
  SELECT item_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM (
    SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}]+'),
      lambda x: x <> '') AS w FROM benchmark)
),
ds AS (
  SELECT doc_id, p, concat_ws(' ', t, lead(t, 1) OVER o, lead(t, 2) OVER o, lead(t, 4) OVER o) AS s,
    lead(t, 3) OVER o AS x, lead(t, 5) OVER o AS y
  FROM dt WINDOW o AS (PARTITION BY doc_id ORDER BY p)
),
bs AS (
  SELECT item_id, p, concat_ws(' ', t, lead(t, 1) OVER o, lead(t, 2) OVER o, lead(t, 4) OVER o) AS s,
    lead(t, 3) OVER o AS x, lead(t, 5) OVER o AS y, lead(t, 4) OVER o AS z
  FROM bt WINDOW o AS (PARTITION BY item_id ORDER BY p)
),
hits AS (
  SELECT DISTINCT ds.doc_id, bs.item_id, ds.p - bs.p AS shift
  FROM ds JOIN bs ON ds.s = bs.s AND (ds.x = bs.x OR ds.y = bs.y) WHERE bs.z IS NOT NULL
  UNION
  SELECT dt.doc_id, bt.item_id, dt.p - bt.p FROM dt JOIN bt ON dt.t = bt.t AND bt.n < 15
  GROUP BY dt.doc_id, bt.item_id, dt.p - bt.p HAVING 5 * count(*) >= 4 * max(bt.n)
),
al AS (
  SELECT h.doc_id, h.item_id, h.shift, bt.p, least(15, bt.n) AS least,
    sum(CAST(dt.t = bt.t AS INT)) OVER (PARTITION BY h.doc_id, h.item_id, h.shift ORDER BY bt.p) AS run,
    row_number() OVER (PARTITION BY h.doc_id, h.item_id, h.shift ORDER BY bt.p) AS k
  FROM hits h JOIN bt ON bt.item_id = h.item_id JOIN dt ON dt.doc_id = h.doc_id AND dt.p = bt.p + h.shift
),
good AS (
  SELECT a.doc_id, a.item_id, a.shift, a.k, a.least, a.run - coalesce(b.run, 0) AS equal
  FROM al a LEFT JOIN al b
    ON b.doc_id = a.doc_id AND b.item_id = a.item_id AND b.shift = a.shift AND b.k = a.k - a.least
  WHERE a.k >= a.least AND 5 * (a.run - coalesce(b.run, 0)) >= 4 * a.least
),
found AS (
  SELECT doc_id, item_id, shift, count(DISTINCT k) AS overlap_words, max(equal) AS best_equal FROM (
    SELECT doc_id, item_id, shift, unnest(generate_series(k - least + 1, k)) AS k, equal FROM good)
  GROUP BY ALL
)
SELECT doc_id, item_id, CAST(m.overlap_words AS INT) AS overlap_words, CAST(m.best_equal AS INT) AS best_equal
FROM (SELECT doc_id, item_id, max(struct_pack(overlap_words := overlap_words, best_equal := best_equal)) AS m
  FROM found GROUP BY ALL)
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP,
    "op1_line_passages": LINE_PASSAGES,
    "op5_embedding_dedup": EMBEDDINGS,
    "op7_mixing": MIXING,
    "op10_decontamination": DECONTAMINATION,
}
