"""Registered queries of trees, retrieval on a fixed tree, evaluation and views, each next to its DuckDB oracle.

The fixed tree has the labels' mean vectors as leaves, thirds of the labels as branches, and a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import held
from ..operators import retrieval as R
from ..operators import views as W
from .model import SQL_CENTROIDS, centroids
from .queries import SQL_EDGES, TYPES, edges_emb, nodes_weighed, pairs_emb, query, read, vectors

BEAM, LEAST = 2, 0.05

_MEAN = "(SELECT list(x ORDER BY k) FROM (SELECT k, avg(v[k]) AS x FROM (SELECT v, unnest(range(1, len(v) + 1)) AS k FROM {t}) GROUP BY k))"
SQL_TREE = f"""{SQL_CENTROIDS},
bd AS (SELECT label // 3 AS b, k, avg(v[k]) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS k FROM cent) GROUP BY 1, 2),
br AS (SELECT b, list(x ORDER BY k) AS v FROM bd GROUP BY 1),
tree AS (
  SELECT 'leaf_' || label AS id, 0 AS level, [{", ".join(f"'{t}'" for t in TYPES)}][label + 1] AS name, 'branch_' || label // 3 AS parent, label AS ord, v, n AS size FROM cent
  UNION ALL SELECT 'branch_' || b, 1, 'Branch ' || b, 'root', 10 + b, v, 7 FROM br
  UNION ALL SELECT 'root', 2, 'Root', NULL, 20, {_MEAN.format(t="br")}, 3
)"""


def fixed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, level, kind, name, summary, size, vector, parent, ord, key_entities)."""
    leaves = centroids(spark, sf_dir).withColumn("b", F.floor(F.col("label") / 3).cast("int"))

    def mean(rows: DataFrame, by: str) -> DataFrame:
        dims = rows.select(by, F.posexplode("vector").alias("k", "x")).groupBy(by, "k").agg(F.avg("x").alias("x"))
        return dims.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vector"))

    branches = mean(leaves, "b")
    top = mean(branches.withColumn("_one", F.lit(1)), "_one")
    entities = lambda c: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("e"), ((c * 4 + i) % 23).cast("string")))
    text = F.lit("word " * 60)
    a = leaves.select(F.concat(F.lit("leaf_"), "label").alias("id"), F.lit(0).alias("level"), F.lit("leaf").alias("kind"), F.get(F.array(*map(F.lit, TYPES)), F.col("label")).alias("name"), text.alias("summary"), F.col("n").cast("long").alias("size"), "vector", F.concat(F.lit("branch_"), "b").alias("parent"), F.col("label").cast("int").alias("ord"), entities(F.col("label")).alias("key_entities"))
    b = branches.select(F.concat(F.lit("branch_"), "b").alias("id"), F.lit(1).alias("level"), F.lit("branch").alias("kind"), F.concat(F.lit("Branch "), "b").alias("name"), F.lit("short").alias("summary"), F.lit(7).cast("long").alias("size"), "vector", F.lit("root").alias("parent"), (F.col("b") + 10).alias("ord"), entities(F.col("b")).alias("key_entities"))
    c = top.select(F.lit("root").alias("id"), F.lit(2).alias("level"), F.lit("root").alias("kind"), F.lit("Root").alias("name"), F.lit(None).cast("string").alias("summary"), F.lit(3).cast("long").alias("size"), "vector", F.lit(None).cast("string").alias("parent"), F.lit(20).alias("ord"), F.array().cast("array<string>").alias("key_entities"))
    return a.unionByName(b).unionByName(c)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("id % 20 = 0")


# --------------------------------------------------------------------------------------- measures

_KIDS = "kids AS (SELECT parent, count(*) AS k FROM tree WHERE parent IS NOT NULL GROUP BY 1)"


@query(f"WITH {SQL_TREE}, {_KIDS} SELECT count(DISTINCT level)::BIGINT AS total_levels, count(*)::BIGINT AS total_nodes, count(CASE WHEN level = 0 THEN 1 END)::BIGINT AS leaf_count, (SELECT round(avg(k), 9) FROM kids) AS branching_factor FROM tree")
def tree_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.structure(fixed_tree(spark, sf_dir)).withColumn("branching_factor", F.round("branching_factor", 9))


@query(f"WITH {SQL_TREE} SELECT level, count(*)::BIGINT AS nodes FROM tree GROUP BY 1")
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.level_sizes(fixed_tree(spark, sf_dir))


_SCORES = f"""{SQL_TREE}, {_KIDS}, wide AS (SELECT parent AS id FROM kids WHERE k > 1),
ok AS (SELECT id FROM wide WHERE id = 'root' OR id IN (SELECT t.id FROM tree t WHERE t.parent = 'root' AND 'root' IN (SELECT id FROM wide))),
pc AS (SELECT t.parent AS id, avg(list_cosine_similarity(t.v, p.v)) AS a FROM tree t JOIN tree p ON p.id = t.parent JOIN ok ON ok.id = p.id GROUP BY 1),
cc AS (SELECT a.parent AS id, avg(list_cosine_similarity(a.v, b.v)) AS b FROM tree a JOIN tree b ON a.parent = b.parent AND a.id <> b.id JOIN ok ON ok.id = a.parent GROUP BY 1)"""


@query(f"WITH {_SCORES} SELECT round(avg(a - 0.3 * b), 6) AS avg_parent_child_quality, count(*)::BIGINT AS num_evaluated_nodes, round(avg(0.7 * a + 0.3 * (1 - b)), 6) AS avg_branch_quality FROM pc JOIN cc ON cc.id = pc.id")
def branch_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with one child end the walk, so what is below them has no say."""
    tree = fixed_tree(spark, sf_dir)
    a, b = E.parent_child_quality(tree), E.branch_quality(tree)
    return a.join(F.broadcast(b)).select(F.round("avg_parent_child_quality", 6).alias("avg_parent_child_quality"), "num_evaluated_nodes", F.round("avg_branch_quality", 6).alias("avg_branch_quality"))


@query(f"WITH {SQL_TREE} SELECT a.level, round(1 - avg(list_cosine_similarity(a.v, b.v)), 6) AS diversity FROM tree a JOIN tree b ON a.level = b.level AND a.id <> b.id GROUP BY 1")
def level_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.level_diversity(fixed_tree(spark, sf_dir)).withColumn("diversity", F.round("diversity", 6))


@query(f"WITH {SQL_TREE}, s AS (SELECT list_cosine_similarity(t.v, p.v) AS s, p.id FROM tree t JOIN tree p ON p.id = t.parent) SELECT round(avg(s), 6) AS parent_child, (SELECT round(avg(k), 6) FROM (SELECT count(*) AS k FROM s GROUP BY id)) AS branching, round(avg(1 - abs(s - 0.65)), 6) AS topic_subtopic FROM s")
def topic_subtopic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tree_quality(fixed_tree(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("parent_child", "branching", "topic_subtopic")])


@query("WITH c AS (SELECT a.label, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1), z AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT (SELECT round(avg(c), 6) FROM c) AS avg_coherence, (SELECT round(min(c), 6) FROM c) AS min_coherence, (SELECT round(max(c), 6) FROM c) AS max_coherence, count(*)::BIGINT AS num_topics, round(avg(n), 6) AS avg_size, round(stddev_pop(n), 6) AS std_size FROM z")
def coherence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    per = E.topic_coherence(v.select(F.col("label").alias("topic"), F.lit(1).alias("rank"), "vector"), None)
    out = E.coherence_report(per, v.groupBy("label").agg(F.count(F.lit(1)).alias("size")))
    return out.select("num_topics", *[F.round(c, 6).alias(c) for c in ("avg_coherence", "min_coherence", "max_coherence", "avg_size", "std_size")])


#: Five measures of lines, for two halves of them.
_METRICS = {"modularity": "avg(l_discount) * 10", "silhouette_score": "avg(l_tax) * 8", "topic_coherence": "avg(l_quantity) / 40", "coverage": "avg(l_discount + l_tax) * 10", "avg_degree": "avg(l_quantity) / 10"}
_METRICS_SQL = "(" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {e} AS value FROM lineitem WHERE l_suppkey % 2 = {{0}}" for m, e in _METRICS.items()) + ")"


def _metrics(spark: SparkSession, sf_dir: str, half: int) -> DataFrame:
    row = read(spark, sf_dir, "lineitem").where(f"l_suppkey % 2 = {half}").agg(*[F.expr(e).alias(m) for m, e in _METRICS.items()])
    return row.unpivot([], list(_METRICS), "metric", "value")


_RATE = "CASE metric WHEN 'avg_degree' THEN CASE WHEN value > 2 THEN 'Good' ELSE 'Fair' END WHEN 'silhouette_score' THEN CASE WHEN value > 0.5 THEN 'Excellent' WHEN value > 0.25 THEN 'Good' ELSE 'Fair' END WHEN 'coverage' THEN CASE WHEN value > 0.9 THEN 'Excellent' WHEN value > 0.7 THEN 'Good' ELSE 'Fair' END ELSE CASE WHEN value > 0.7 THEN 'Excellent' WHEN value > 0.5 THEN 'Good' ELSE 'Fair' END END"


@query(f"SELECT metric, round(value, 6) AS value, {_RATE} AS rating FROM {_METRICS_SQL.format(0)}")
def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rated(_metrics(spark, sf_dir, 0)).withColumn("value", F.round("value", 6))


@query(f"SELECT a.metric, round(a.value, 6) AS before, round(b.value, 6) AS after, round(b.value - a.value, 6) + 0.0 AS delta FROM {_METRICS_SQL.format(0)} a JOIN {_METRICS_SQL.format(1)} b ON a.metric = b.metric")
def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.deltas(_metrics(spark, sf_dir, 0), _metrics(spark, sf_dir, 1))
    return out.select("metric", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), (F.round("delta", 6) + 0.0).alias("delta"))


@query(f"SELECT round(sum(CASE metric WHEN 'avg_degree' THEN 0 WHEN 'silhouette_score' THEN value + 0.5 ELSE value END) / 4, 6) AS overall FROM {_METRICS_SQL.format(0)}")
def overall_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gauge(_metrics(spark, sf_dir, 0)).withColumn("overall", F.round("overall", 6))


_DUEL = f"duel AS (SELECT a.metric, a.value AS flat, CASE WHEN a.metric <> 'modularity' THEN b.value END AS hierarchical, a.metric <> 'coverage' AS higher FROM {_METRICS_SQL.format(0)} a JOIN {_METRICS_SQL.format(1)} b ON a.metric = b.metric), won AS (SELECT metric, CASE WHEN hierarchical IS NULL OR (higher AND flat > hierarchical) OR (NOT higher AND flat < hierarchical) THEN 'flat' ELSE 'hierarchical' END AS winner FROM duel)"


def _duel(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _metrics(spark, sf_dir, 0), _metrics(spark, sf_dir, 1)
    both = a.select("metric", F.col("value").alias("flat")).join(b.select("metric", F.col("value").alias("hierarchical")), "metric")
    return both.withColumns({"hierarchical": F.when(F.col("metric") != "modularity", F.col("hierarchical")), "higher": F.col("metric") != "coverage"})


@query(f"WITH {_DUEL} SELECT * FROM won")
def benchmark_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.wins(_duel(spark, sf_dir)).select("metric", "winner")


@query(f"WITH {_DUEL}, t AS (SELECT count(CASE WHEN winner = 'flat' THEN 1 END)::BIGINT AS flat_wins, count(CASE WHEN winner <> 'flat' THEN 1 END)::BIGINT AS hierarchical_wins FROM won) SELECT *, CASE WHEN flat_wins > hierarchical_wins THEN 'flat' WHEN flat_wins < hierarchical_wins THEN 'hierarchical' ELSE 'tie' END AS overall_winner FROM t")
def win_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tally(E.wins(_duel(spark, sf_dir)))


@query("SELECT count(*)::BIGINT AS edges, count(CASE WHEN o_orderpriority NOT LIKE '1%' THEN 1 END)::BIGINT AS with_confidence, round(avg(CASE WHEN o_orderpriority NOT LIKE '1%' THEN (o_orderkey % 10) / 10.0 ELSE 0 END), 9) AS avg_confidence FROM orders")
def confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "orders").select(F.when(~F.col("o_orderpriority").like("1%"), F.col("o_orderkey") % 10 / 10.0).alias("confidence"))
    return E.confidence_stats(edges).withColumn("avg_confidence", F.round("avg_confidence", 9))


# -------------------------------------------------------------------------------------- retrieval

_SIMS = f"{SQL_TREE}, sims AS (SELECT q.vec_id AS query, t.id, t.level, t.parent, t.ord, t.name, list_cosine_similarity(q.embedding::DOUBLE[], t.v) AS sim FROM embeddings q, tree t WHERE q.vec_id % 20 = 0)"


def _step(k: int, front: str) -> str:
    return f"r{k} AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, ord DESC) AS r FROM sims WHERE {front}), s{k} AS (SELECT query, {k} AS step, id, level, sim, ord, name FROM r{k} WHERE r <= {BEAM} AND sim >= {LEAST})"


_PATH = f"{_SIMS}, " + ", ".join(_step(k, "parent IS NULL" if not k else f"(query, parent) IN (SELECT (query, id) FROM s{k - 1})") for k in range(3)) + ", path AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)"


@query(f"WITH {_PATH} SELECT query, step, id, level, round(sim, 6) AS sim FROM path")
def tree_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.retrieve(_asked(spark, sf_dir), fixed_tree(spark, sf_dir), "tree_traversal", BEAM, LEAST)
    return out.select("query", "step", "id", "level", F.round("sim", 6).alias("sim"))


@query(f"WITH {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, level, ord) AS rank FROM sims WHERE sim >= {LEAST}) SELECT query, id, level, round(sim, 6) AS sim, rank::INT AS rank FROM r WHERE rank <= {3 * BEAM}")
def tree_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.retrieve(_asked(spark, sf_dir), fixed_tree(spark, sf_dir), "collapsed", BEAM, LEAST)
    return out.select("query", "id", "level", F.round("sim", 6).alias("sim"), "rank")


@query(f"""
WITH {_PATH}, lv AS (SELECT query, level, max(sim) AS m FROM sims GROUP BY 1, 2),
best AS (SELECT query, first(level ORDER BY m DESC, level) AS best, max(CASE WHEN level = 0 THEN m END) AS leaf FROM lv GROUP BY 1),
nar AS (SELECT query, best, best = 0 OR leaf > 0.7 AS narrow FROM best),
b AS (SELECT sims.*, row_number() OVER (PARTITION BY sims.query ORDER BY sim DESC, ord DESC) AS r FROM sims JOIN nar ON nar.query = sims.query AND best = level WHERE NOT narrow)
SELECT path.query, id, level, round(sim, 6) AS sim, 'narrow' AS mode FROM path JOIN nar ON nar.query = path.query WHERE narrow
UNION ALL SELECT query, id, level, round(sim, 6), 'broad' FROM b WHERE r <= {BEAM}
""")
def tree_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.retrieve(_asked(spark, sf_dir), fixed_tree(spark, sf_dir), "adaptive", BEAM, LEAST)
    return out.select("query", "id", "level", F.round("sim", 6).alias("sim"), "mode")


@query(f"""
WITH {_PATH}, o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY step, sim DESC, ord DESC) AS p FROM path),
e AS (SELECT query, p, i, 'e' || ((ord * 4 + i) % 23) AS e FROM (SELECT *, unnest(range(0, 6)) AS i FROM o WHERE level = 0)),
d AS (SELECT query, e, min(p * 10 + i) AS f FROM e GROUP BY 1, 2), f AS (SELECT query, list(e ORDER BY f)[1:20] AS e FROM d GROUP BY 1),
t AS (SELECT query, string_agg(name, ',' ORDER BY p) FILTER (WHERE level = 0) AS t, avg(sim) AS a FROM o GROUP BY 1)
SELECT vec_id AS query, coalesce(t.t, '') AS topics, coalesce(array_to_string(f.e, ','), '') AS entities, round(coalesce(a, 0), 6) AS avg_similarity
FROM embeddings LEFT JOIN t ON t.query = vec_id LEFT JOIN f ON f.query = vec_id WHERE vec_id % 20 = 0
""")
def traversal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, tree = _asked(spark, sf_dir), fixed_tree(spark, sf_dir)
    out = R.traversal_summary(R.traverse(asked, tree, BEAM, LEAST), asked, tree)
    return out.select("query", F.array_join("topics", ",").alias("topics"), F.array_join("entities", ",").alias("entities"), F.round("avg_similarity", 6).alias("avg_similarity"))


@query()
def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph retrieval with its context; the parts have their own tests."""
    v, asked = vectors(spark, sf_dir), _asked(spark, sf_dir)
    edges = held.kept(pairs_emb(spark, sf_dir)).select("src", "dst", F.lit("related_to").alias("relation"), (F.col("src") * 1000000 + F.col("dst")).alias("ord"))
    known = v.select("id", "vector", F.lit(0.5).alias("importance"), F.lit(0.001).alias("pagerank"), F.concat(F.lit("node of label "), F.col("label").cast("string")).alias("description"))
    return R.answer_context(R.graph_retrieve(asked, v, edges, known))


# ------------------------------------------------------------------------------------------ views


@query(f"WITH {SQL_TREE} SELECT id, parent, name, level, size::BIGINT AS entity_count, CASE level WHEN 0 THEN repeat('word ', 40) || '...' WHEN 1 THEN 'short' ELSE '' END AS summary, CASE level WHEN 2 THEN 0 ELSE 5 END AS entities FROM tree")
def tree_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.tree_view(fixed_tree(spark, sf_dir))
    return out.select("id", "parent", "name", "level", "entity_count", "summary", F.size("key_entities").alias("entities"))


@query(f"WITH {SQL_TREE}, b AS (SELECT parent, sum(size) AS s FROM tree WHERE level = 0 GROUP BY 1) SELECT id, CASE level WHEN 0 THEN size WHEN 1 THEN size + (SELECT s FROM b WHERE b.parent = tree.id) ELSE size + (SELECT sum(size) FROM tree t WHERE t.level < 2) END::BIGINT AS value FROM tree")
def sunburst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sunburst(fixed_tree(spark, sf_dir))


@query(f"WITH {SQL_EDGES}, n AS (SELECT vec_id AS id FROM embeddings ORDER BY vec_id LIMIT 100) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) ORDER BY src, dst LIMIT 200")
def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred nodes, two hundred edges: the limits are the feature."""
    nodes = vectors(spark, sf_dir).select("id", F.col("id").alias("ord"))
    return W.graph_view(nodes, edges_emb(spark, sf_dir).withColumn("ord", F.struct("src", "dst")))[1].select("src", "dst")


@query(f"""
WITH {SQL_EDGES}, n AS (SELECT vec_id AS id, (vec_id % 11) / 10.0 AS imp FROM embeddings), top AS (SELECT *, row_number() OVER (ORDER BY imp DESC, id) AS r FROM n ORDER BY r LIMIT 15),
w AS (SELECT src AS id, dst AS o, 0 AS way, src * 1000000 + dst AS k FROM edges UNION ALL SELECT dst, src, 1, src * 1000000 + dst FROM edges),
f AS (SELECT o AS id FROM (SELECT *, row_number() OVER (PARTITION BY id, way ORDER BY k) AS p FROM w WHERE id IN (SELECT id FROM top WHERE r <= 10)) WHERE p <= 3),
u AS (SELECT id, min(k) AS k FROM (SELECT id, 0 AS k FROM top UNION ALL SELECT id, 1 FROM f) GROUP BY 1)
SELECT u.id FROM u JOIN n ON n.id = u.id ORDER BY k, imp DESC, u.id LIMIT 50
""")
def neighbour_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty nodes around the most important ones: the limits are the feature."""
    edges = edges_emb(spark, sf_dir).withColumn("ord", F.col("src") * 1000000 + F.col("dst"))
    return W.neighbour_sample(nodes_weighed(spark, sf_dir).select("id", "importance"), edges)


@query("SELECT event_type AS relation, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY n DESC, relation LIMIT 3")
def relation_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.relation_shares(read(spark, sf_dir, "events").select(F.col("event_type").alias("relation")), 3)
