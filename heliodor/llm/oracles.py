"""DuckDB equivalents of the queries that SQL can express on whole tables."""

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source),
w AS (
  SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) AS whole
  FROM s),
c AS (
  SELECT *, cap / weight <= (whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped
  FROM w),
t AS (
  SELECT source, source_size, rank,
         CASE WHEN capped THEN cap ELSE (whole - sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER ()) * weight
              / sum(CASE WHEN capped THEN 0.0 ELSE weight END) OVER () END AS target
  FROM c),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.rank, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, CASE WHEN size > 0 THEN passes + CASE WHEN pos + CAST(size AS DOUBLE) / 2 <= target - passes * source_size THEN 1 ELSE 0 END ELSE 0 END AS copies,
         (pos + CAST(size AS DOUBLE) / 2) / target AS u, CAST(rank % 3 - 1 AS DOUBLE) / 2 AS a
  FROM p)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies,
       round(CASE WHEN copies = 0 THEN NULL WHEN a = 0 THEN u ELSE (sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a) END, 9) AS first_position
FROM q
"""

SUBSTRINGS = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
v AS (
  SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY md5(array_to_string(w[i:i + 34], ' '))) AS c FROM v),
x AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM h WHERE c > 1),
g AS (
  SELECT doc_id, count(*) AS n_removed, list(j) AS gone FROM x GROUP BY doc_id),
k AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, w, unnest(CASE WHEN len(w) = 0 THEN [0] ELSE range(1, len(w) + 1) END) AS j
  FROM d LEFT JOIN g USING (doc_id)),
r AS (
  SELECT k.doc_id, n_words, n_removed, string_agg(CASE WHEN x.j IS NULL AND k.j > 0 THEN w[k.j] END, ' ' ORDER BY k.j) AS kept
  FROM k LEFT JOIN x ON k.doc_id = x.doc_id AND k.j = x.j GROUP BY ALL)
SELECT doc_id, n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM r
"""

MINHASH = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
r(node, seen) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""
