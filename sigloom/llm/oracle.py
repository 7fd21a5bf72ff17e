"""DuckDB SQL with the rows of the queries of the same name, over the whole tables."""

from __future__ import annotations

SQL = {}

SQL["op1_substring_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM d, unnest(range(1, greatest(len(w) - 48, 1))) AS u(i)
),
first AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i
  FROM win JOIN first USING (h), unnest(range(0, 50)) AS u(k)
  WHERE least < doc_id
),
kept AS (
  SELECT d.doc_id, count(*) AS n, string_agg(d.w[p.i], ' ' ORDER BY p.i) AS t
  FROM d, unnest(range(1, len(d.w) + 1)) AS p(i)
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = d.doc_id AND g.i = p.i)
  GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

SQL["op2_source_mixing"] = r"""
WITH base AS MATERIALIZED (
  SELECT doc_id, source AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents
),
per AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM base GROUP BY src),
lvl AS (
  SELECT *, 2 * source_size / weight AS fills,
    (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level,
    row_number() OVER (ORDER BY 2 * source_size / weight, src NULLS LAST) AS place
  FROM per
  WINDOW b AS (ORDER BY 2 * source_size / weight, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
tgt AS MATERIALIZED (
  SELECT src, source_size, least(2.0 * source_size, coalesce(weight * (SELECT arg_min(level, place) FROM lvl WHERE level < fills), 2.0 * source_size)) AS target FROM lvl
),
cum AS MATERIALIZED (
  SELECT b.*, t.source_size, t.target,
    sum(size) OVER (PARTITION BY b.src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
  FROM base b JOIN tgt t ON b.src IS NOT DISTINCT FROM t.src
),
queue AS (
  SELECT cum.*, CAST(k * source_size + c AS DOUBLE) / target AS finish FROM cum, unnest([0, 1]) AS u(k) WHERE target > 0 AND size > 0
),
run AS (
  SELECT *, sum(size) OVER (ORDER BY finish, key, src NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM queue
),
took AS (SELECT doc_id, src, key, size, CAST(sum(size) AS BIGINT) AS taken FROM run WHERE upto <= (SELECT sum(target) FROM tgt) GROUP BY ALL)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(t.taken, 0) AS taken
FROM cum c LEFT JOIN took t ON c.doc_id = t.doc_id
"""

SQL["op4_jaccard_join"] = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 4 THEN array_to_string(w[i:i + 3], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i)
  WHERE len(w) > 0
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
),
pairs AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT a AS node, a AS other FROM pairs
  UNION
  SELECT r.node, b.b FROM reach r JOIN pairs b ON r.other = b.a
),
comp AS (SELECT node, min(other) AS c FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.node = w.doc_id
"""

SQL["op6_lm_scoring"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS t
  FROM documents
),
tok AS MATERIALIZED (
  SELECT doc_id, t, i, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS h FROM d, unnest(range(1, len(w) + 1)) AS u(i)
),
uni AS MATERIALIZED (SELECT x, count(*) AS c0, count(*) FILTER (WHERE t) AS c1 FROM tok GROUP BY x),
bi AS MATERIALIZED (SELECT h, x, count(*) AS c0, count(*) FILTER (WHERE t) AS c1 FROM tok WHERE h IS NOT NULL GROUP BY h, x),
hist AS MATERIALIZED (SELECT h, sum(c0) AS c0, sum(c1) AS c1 FROM bi GROUP BY h),
n AS (SELECT sum(c0) AS n0, sum(c1) AS n1, count(*) AS v FROM uni),
p AS (
  SELECT tok.doc_id,
    CASE WHEN hist.c0 > 0 THEN 0.7 * bi.c0 / hist.c0 + 0.3 * (uni.c0 + 0.1) / (n0 + 0.1 * v) ELSE (uni.c0 + 0.1) / (n0 + 0.1 * v) END::DOUBLE AS p0,
    CASE WHEN hist.c1 > 0 THEN 0.7 * bi.c1 / hist.c1 + 0.3 * (uni.c1 + 0.1) / (n1 + 0.1 * v) ELSE (uni.c1 + 0.1) / (n1 + 0.1 * v) END::DOUBLE AS p1
  FROM tok JOIN uni USING (x) LEFT JOIN bi ON bi.h = tok.h AND bi.x = tok.x LEFT JOIN hist ON hist.h = tok.h, n
),
s AS (SELECT doc_id, avg(-log2(p1)) AS b1, avg(-log2(p0)) AS b0 FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(b1, 6) AS target_bits, round(b0, 6) AS background_bits, round(b1 - b0, 6) AS score
FROM d LEFT JOIN s USING (doc_id)
"""

SQL["op8_suffix_array_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS h FROM d, unnest(range(0, greatest(CAST(length(x) / 2 AS BIGINT) - 99, 0))) AS u(i)
),
lost AS MATERIALIZED (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
),
runs AS (
  SELECT doc_id, min(i) AS s, max(i) + 100 AS e
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g
        FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM lost))
  GROUP BY doc_id, g
),
pieces AS (
  SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM runs
),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS last,
    string_agg(substr((SELECT x FROM d WHERE d.doc_id = pieces.doc_id), 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS t
  FROM pieces GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(t, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

SQL["op10_decontamination"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
b AS MATERIALIZED (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
),
dw AS (
  SELECT doc_id, i, l.n, array_to_string(w[i:i + l.n - 1], ' ') AS s
  FROM d, (SELECT DISTINCT n FROM bw) AS l, unnest(range(1, greatest(len(w) - l.n + 2, 1))) AS u(i)
),
hit AS MATERIALIZED (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, hit.n)) AS u(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
