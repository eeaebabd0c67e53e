"""DuckDB SQL for the queries that SQL can express, over whole tables and whole texts."""

WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '')"

OP4 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * k >= 75 * (p.n + q.n - k)
),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y
),
-- equal sets: documents of one class
keyed AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS cls FROM grams GROUP BY doc_id),
copies AS (SELECT doc_id, count(*) OVER (PARTITION BY cls) AS n_copies FROM keyed)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles,
  (SELECT min(y) FROM reach WHERE reach.x = d.doc_id)::BIGINT AS component_id,
  coalesce(c.n_copies, 1)::BIGINT AS n_copies
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN copies c ON c.doc_id = d.doc_id
"""

OP6 = f"""
WITH words AS (SELECT doc_id, {WORDS} AS w FROM documents),
placed AS (SELECT doc_id, i, w[i] AS v, CASE WHEN i > 1 THEN w[i - 1] END AS u FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
total AS (SELECT count(*)::DOUBLE AS n FROM placed),
own1 AS (SELECT doc_id, v, count(*) AS k FROM placed GROUP BY 1, 2),
all1 AS (SELECT v, sum(k) AS n FROM own1 GROUP BY 1),
own2 AS (SELECT doc_id, u, v, count(*) AS k FROM placed WHERE u IS NOT NULL GROUP BY 1, 2, 3),
all2 AS (SELECT u, v, sum(k) AS n FROM own2 GROUP BY 1, 2),
sizes AS (SELECT doc_id, len(w)::BIGINT AS n_words FROM words),
scored AS (
  SELECT p.doc_id,
    CASE WHEN p.u IS NOT NULL AND a2.n > o2.k THEN ln((a2.n - o2.k)::DOUBLE / (au.n - ou.k)::DOUBLE)
         ELSE CASE WHEN p.u IS NOT NULL THEN ln(0.4::DOUBLE) ELSE 0 END
           + CASE WHEN a1.n > o1.k THEN ln((a1.n - o1.k)::DOUBLE / (t.n - s.n_words)) ELSE -ln(t.n - s.n_words + 1) END
    END AS value,
    CASE WHEN p.u IS NOT NULL AND a2.n > o2.k THEN 1 ELSE 0 END AS hit
  FROM placed p CROSS JOIN total t
  JOIN sizes s ON s.doc_id = p.doc_id
  JOIN own1 o1 ON o1.doc_id = p.doc_id AND o1.v = p.v JOIN all1 a1 ON a1.v = p.v
  LEFT JOIN own1 ou ON ou.doc_id = p.doc_id AND ou.v = p.u LEFT JOIN all1 au ON au.v = p.u
  LEFT JOIN own2 o2 ON o2.doc_id = p.doc_id AND o2.u = p.u AND o2.v = p.v LEFT JOIN all2 a2 ON a2.u = p.u AND a2.v = p.v
)
SELECT s.doc_id, s.n_words, round(sum(value) / nullif(s.n_words, 0), 6) AS score, coalesce(sum(hit), 0)::BIGINT AS n_pairs
FROM sizes s LEFT JOIN scored x ON x.doc_id = s.doc_id GROUP BY s.doc_id, s.n_words
"""

ORACLE = {"op4_jaccard_join": OP4, "op6_backoff_scores": OP6}
