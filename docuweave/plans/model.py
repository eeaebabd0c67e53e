"""Registered queries of the graph build, enhancement, communities and topics, each next to its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import build as B
from ..operators import community as K
from ..operators import enhance as H
from ..operators import graph as G
from ..operators import topics as P
from .queries import SQL_EDGES, SQL_GRAPH, SQL_NAMES, SQL_NODES, SQL_WEIGHED, edges_emb, names, nodes_emb, nodes_weighed, pairs_emb, query, read, relations, vectors

# ------------------------------------------------------------------------------------- documents

_RELATIONS_SQL = f"""
r AS (
  SELECT doc_id, n[ord] AS subject, n[ord + 1] AS object, ord, CASE ord % 3 WHEN 0 THEN 'Utilizes' WHEN 1 THEN 'type_of' ELSE 'near' END AS predicate,
    CASE WHEN ord % 4 > 0 THEN (ord % 5) / 10.0 END AS confidence
  FROM ({SQL_NAMES}) WHERE ord < len(n)
)"""


def relation_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring names as relations, with a predicate and a confidence by their place; places count from 1."""
    at = F.col("ord") + 1
    verb = F.when(at % 3 == 0, "Utilizes").when(at % 3 == 1, "type_of").otherwise("near")
    return relations(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("src").alias("subject"), F.col("dst").alias("object"), verb.alias("predicate"), F.when(at % 4 > 0, at % 5 / 10.0).alias("confidence"), at.alias("ord"))


@query(f"""
WITH {_RELATIONS_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(subject), predicate, lower(object) ORDER BY coalesce(confidence, 0) DESC, ord) AS p,
  min(ord) OVER (PARTITION BY doc_id, lower(subject), predicate, lower(object)) AS first FROM r)
SELECT doc_id, subject, predicate, object, coalesce(confidence, -1)::DOUBLE AS confidence, first::BIGINT AS ord FROM k WHERE p = 1
""")
def relation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.dedupe_relations(relation_mentions(spark, sf_dir))
    return out.select(F.col("doc").alias("doc_id"), "subject", "predicate", "object", F.coalesce("confidence", F.lit(-1.0)).cast("double").alias("confidence"), F.col("ord").cast("long").alias("ord"))


@query(f"SELECT doc_id, array_to_string(list_sort(list(DISTINCT n[ord]))[1:15], ',') AS topics, least(count(DISTINCT n[ord]), 15)::BIGINT AS num_topics FROM ({SQL_NAMES}) GROUP BY 1")
def topic_label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen labels a document at most: the limit is the feature."""
    chunks = names(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.array("name").alias("topics"))
    return B.topic_labels(chunks).select(F.col("doc").alias("doc_id"), F.array_join("topics", ",").alias("topics"), "num_topics")


_MENTIONS_SQL = f"m AS (SELECT doc_id, n[ord] AS name, doc_id * 100000 + ord AS o, CASE ord % 2 WHEN 0 THEN 'concept' ELSE 'method' END AS type, 'text ' || ord AS description, (ord % 3) / 10.0 AS confidence FROM ({SQL_NAMES}))"


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ord") + 1
    return names(spark, sf_dir).select(F.col("doc_id").alias("doc"), "name", (F.col("doc_id") * 100000 + at).alias("ord"), F.when(at % 2 == 0, "concept").otherwise("method").alias("type"), F.concat(F.lit("text "), at.cast("string")).alias("description"), (at % 3 / 10.0).alias("confidence"))


@query(f"""
WITH {_MENTIONS_SQL}
SELECT lower(name) AS id, arg_min(type, o) AS type, count(*)::BIGINT AS mentions, md5(array_to_string(list(doc_id ORDER BY o), ',')) AS documents,
  array_to_string(list_sort(list(DISTINCT name)), ',') AS aliases, first(description ORDER BY confidence DESC, o) AS description
FROM m GROUP BY 1
""")
def node_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with all their attributes: first type, documents as a bag in order, description of the most sure mention."""
    merged = G.merge_nodes(entity_mentions(spark, sf_dir).withColumn("canonical", F.lower("name")))
    return merged.select("id", "type", "mentions", F.md5(F.array_join(F.col("documents").cast("array<string>"), ",")).alias("documents"), F.array_join("aliases", ",").alias("aliases"), "description")


@query(f"""
WITH {_RELATIONS_SQL}, c AS (SELECT DISTINCT n[ord] AS name FROM ({SQL_NAMES})),
k AS (SELECT name, min(name) OVER (PARTITION BY lower(name)) AS canonical FROM c),
e AS (
  SELECT s.canonical AS src, t.canonical AS dst, CASE predicate WHEN 'Utilizes' THEN 'uses' WHEN 'type_of' THEN 'is_a' ELSE predicate END AS relation, doc_id * 100000 + ord AS o, coalesce(confidence, 0)::DOUBLE AS confidence
  FROM r JOIN k s ON s.name = subject JOIN k t ON t.name = object WHERE length(subject) <> 5 AND length(object) <> 5
),
p AS (SELECT src, dst, relation, min(o) AS o FROM e GROUP BY 1, 2, 3),
l AS (SELECT src, dst, list(relation ORDER BY o) AS relations FROM p GROUP BY 1, 2)
SELECT e.src, e.dst, any_value(array_to_string(l.relations, ',')) AS relations, count(*)::BIGINT AS mentions, max(confidence) AS confidence
FROM e JOIN l ON l.src = e.src AND l.dst = e.dst GROUP BY e.src, e.dst
""")
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the whole build: names resolved, predicates normalised, ends checked; names of five signs are no nodes here."""
    found = entity_mentions(spark, sf_dir)
    canonical = found.select("name").distinct()
    least = canonical.groupBy(F.lower("name").alias("_k")).agg(F.min("name").alias("canonical"))
    canonical = canonical.withColumn("_k", F.lower("name")).join(least, "_k").select("name", "canonical")
    links = relation_mentions(spark, sf_dir).withColumn("ord", F.col("doc") * 100000 + F.col("ord"))
    _, edges = B.build_graph(found.where(F.length("name") != 5), links, canonical)
    return edges.select("src", "dst", F.array_join("relations", ",").alias("relations"), "mentions", F.col("confidence").cast("double").alias("confidence"))


@query()
def fuzzy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by edit ratio against the names that occur in ten documents; the ratio is no SQL, so it is tested by brute force."""
    found = entity_mentions(spark, sf_dir).select("name", F.lit("concept").alias("type"), "doc", "ord")
    known = found.groupBy("name", "type").agg(F.count_distinct("doc").alias("d"), F.min("ord").alias("ord")).where("d >= 10")
    return B.resolve_fuzzy(found, known)


# ----------------------------------------------------------------------------------- enhancement


@query("""
WITH o AS (SELECT o_custkey, count(*)::DOUBLE AS n, sum(o_totalprice) AS p, count(DISTINCT o_orderpriority)::DOUBLE AS d FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS id, c_acctbal AS a, coalesce(n, 0) AS b, coalesce(p, 0) AS e, coalesce(d, 0) AS t, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE c_nationkey END::DOUBLE AS m FROM customer LEFT JOIN o ON o_custkey = c_custkey),
x AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(e) AS e0, max(e) AS e1, min(t) AS t0, max(t) AS t1, min(m) AS m0, max(m) AS m1 FROM c)
SELECT id, round(0.3 * coalesce((a - a0) / nullif(a1 - a0, 0), 0.5) + 0.2 * coalesce((b - b0) / nullif(b1 - b0, 0), 0.5) + 0.2 * coalesce((e - e0) / nullif(e1 - e0, 0), 0.5)
  + 0.15 * coalesce((t - t0) / nullif(t1 - t0, 0), 0.5) + 0.15 * coalesce((m - m0) / nullif(m1 - m0, 0), 0.5), 7) AS importance FROM c, x
""")
def entity_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five-measure formula over five measures of customers; some have no mentions, which count as 1."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("betweenness"), F.sum("o_totalprice").alias("eigenvector"), F.count_distinct("o_orderpriority").alias("total_degree"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("pagerank"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("mentions"))
    return H.importance(c.join(o, "id", "left")).select("id", F.round("importance", 7).alias("importance"))


@query("""
WITH e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p, CASE l_returnflag WHEN 'A' THEN 'uses' WHEN 'N' THEN 'contains' ELSE 'is_a' END AS r FROM lineitem WHERE l_quantity > 20 AND (l_suppkey % 3 = 0 OR l_returnflag <> 'A')),
n AS (SELECT DISTINCT s AS id, CASE WHEN s LIKE '%7' THEN 'company' ELSE 'unknown' END AS type FROM e UNION SELECT DISTINCT p, 'concept' FROM e),
o AS (SELECT s AS id, count(*) AS k, max(CASE WHEN r = 'uses' THEN 1 ELSE 0 END) AS u, max(CASE WHEN r = 'contains' THEN 1 ELSE 0 END) AS c FROM e GROUP BY 1),
i AS (SELECT p AS id, count(*) AS k, max(CASE WHEN r = 'is_a' THEN 1 ELSE 0 END) AS a FROM e GROUP BY 1)
SELECT n.id, CASE WHEN type NOT IN ('unknown', 'concept') THEN type WHEN u = 1 THEN 'method' WHEN a = 1 THEN 'category' WHEN c = 1 THEN 'architecture' WHEN coalesce(i.k, 0) > coalesce(o.k, 0) THEN 'component' ELSE type END AS inferred_type
FROM n LEFT JOIN o ON o.id = n.id LEFT JOIN i ON i.id = n.id
""")
def infer_entity_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 20 and (l_suppkey % 3 = 0 or l_returnflag <> 'A')")
    verb = F.when(F.col("l_returnflag") == "A", "uses").when(F.col("l_returnflag") == "N", "contains").otherwise("is_a")
    edges = lines.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).agg(F.collect_set(verb).alias("relations"))
    sellers = edges.select(F.col("src").alias("id")).distinct().select("id", F.when(F.col("id").like("%7"), "company").otherwise("unknown").alias("type"))
    nodes = sellers.unionByName(edges.select(F.col("dst").alias("id")).distinct().withColumn("type", F.lit("concept")))
    return H.infer_types(nodes, edges)


@query(f"WITH {SQL_GRAPH}, deg AS (SELECT src AS id, count(*) AS k FROM two GROUP BY 1), tri AS (SELECT a.src AS id, count(*) / 2 AS t FROM two a JOIN two b ON b.src = a.dst JOIN two c ON c.src = b.dst AND c.dst = a.src GROUP BY 1), x AS (SELECT nodes.id, CASE WHEN k >= 2 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END AS c, cluster FROM nodes LEFT JOIN deg ON deg.id = nodes.id LEFT JOIN tri ON tri.id = nodes.id) SELECT count(*)::BIGINT AS num_nodes, round(avg(c), 9) AS avg_clustering, count(DISTINCT cluster)::BIGINT AS communities FROM x")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_emb(spark, sf_dir)
    rows = G.clustering(nodes, pairs_emb(spark, sf_dir)).join(nodes.select("id", F.col("cluster").alias("community")), "id")
    return H.graph_summary(rows).select("num_nodes", F.round("avg_clustering", 9).alias("avg_clustering"), "communities")


@query(f"WITH {SQL_GRAPH}, d AS (SELECT id, count(*)::BIGINT AS total_degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) SELECT id, total_degree FROM d ORDER BY total_degree DESC, id LIMIT 10")
def top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nodes of most edges: the limit is the feature."""
    return H.top_nodes(G.degrees(edges_emb(spark, sf_dir)), "total_degree")


@query()
def betweenness_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all nodes; it is no SQL, so it is tested against brute force."""
    from ..operators.centrality import betweenness

    return betweenness(nodes_emb(spark, sf_dir), pairs_emb(spark, sf_dir)).select("id", F.round("betweenness", 9).alias("betweenness"))


# ----------------------------------------------------------------------------------- communities


@query(f"WITH {SQL_NODES} SELECT id, CASE WHEN cluster < 5 THEN cluster ELSE id % 8 END::BIGINT AS cluster, CASE WHEN cluster < 5 THEN cluster ELSE id % 8 + 5 END::BIGINT AS apart FROM nodes")
def ensemble_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nodes_emb(spark, sf_dir)
    a = nodes.select("id", F.when(F.col("cluster") < 5, F.col("cluster")).otherwise(-1).alias("cluster"))
    b = nodes.select("id", (F.col("id") % 8).alias("cluster"))
    return K.ensemble(a, b).join(K.ensemble(a, b, offset_ids=True).withColumnRenamed("cluster", "apart"), "id")


@query("WITH c AS (SELECT c_custkey AS id, (c_custkey * c_custkey) % 997 AS k FROM customer), z AS (SELECT k, dense_rank() OVER (ORDER BY k) - 1 AS r FROM (SELECT k FROM c GROUP BY k HAVING count(*) >= 3)) SELECT id, coalesce(r, -1)::BIGINT AS cluster FROM c LEFT JOIN z ON z.k = c.k")
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.size_filter(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * F.col("c_custkey") % 997).alias("cluster")))


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_emb(spark, sf_dir).select("id", F.when(F.col("cluster") == 0, -1).otherwise(F.col("cluster")).alias("cluster"))


_Q = "round(coalesce(sum(coalesce(i, 0) / m - (d / (2 * m)) ** 2), 0), 9)"
_MOD_SQL = "m AS (SELECT count(*)::DOUBLE AS m FROM g), d AS (SELECT c, count(*)::DOUBLE AS d FROM (SELECT a AS c FROM g UNION ALL SELECT b FROM g) GROUP BY 1), i AS (SELECT a AS c, count(*)::DOUBLE AS i FROM g WHERE a = b GROUP BY 1)"


@query(f"""
WITH {SQL_NODES}, {SQL_EDGES}, k AS (SELECT id, CASE WHEN cluster = 0 THEN -1 ELSE cluster END AS cluster FROM nodes),
g AS (SELECT s.cluster AS a, t.cluster AS b FROM edges JOIN k s ON s.id = src JOIN k t ON t.id = dst), {_MOD_SQL},
q AS (SELECT {_Q} AS modularity FROM d LEFT JOIN i ON i.c = d.c CROSS JOIN m), z AS (SELECT cluster, count(*) AS n FROM k WHERE cluster >= 0 GROUP BY 1),
f AS (SELECT count(*)::BIGINT AS num_clusters, sum(n)::BIGINT AS num_clustered, avg(n) AS avg_cluster_size, min(n)::BIGINT AS min_cluster_size, max(n)::BIGINT AS max_cluster_size FROM z)
SELECT f.*, (SELECT count(*) FROM k)::BIGINT AS num_nodes, q.modularity, ((SELECT count(*) FROM k) - num_clustered)::BIGINT AS num_noise, round(num_clustered / (SELECT count(*) FROM k)::DOUBLE, 9) AS coverage FROM f, q
""")
def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels as clusters, label 0 as noise."""
    out = P.cluster_quality(edges_emb(spark, sf_dir).withColumn("weight", F.lit(1.0)), _noisy(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("modularity", "coverage")})


@query(f"WITH {SQL_NODES}, {SQL_EDGES}, g AS (SELECT s.cluster AS a, t.cluster AS b FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE s.cluster > 0 AND t.cluster > 0), {_MOD_SQL} SELECT {_Q} AS modularity FROM d LEFT JOIN i ON i.c = d.c CROSS JOIN m")
def modularity_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.modularity(edges_emb(spark, sf_dir).withColumn("weight", F.lit(1.0)), _noisy(spark, sf_dir), noise=False)
    return out.select(F.round("modularity", 9).alias("modularity"))


# ---------------------------------------------------------------------------------------- topics


@query(f"""
WITH {SQL_NODES}, {SQL_EDGES}, w AS (SELECT *, {SQL_WEIGHED}::DOUBLE AS imp FROM nodes WHERE cluster > 0),
i AS (SELECT s.cluster AS c, count(*) AS e FROM edges JOIN w s ON s.id = src JOIN w t ON t.id = dst WHERE s.cluster = t.cluster GROUP BY 1),
x AS (SELECT s.cluster AS a, t.cluster AS b FROM edges JOIN w s ON s.id = src JOIN w t ON t.id = dst WHERE s.cluster <> t.cluster), y AS (SELECT a, b FROM x UNION ALL SELECT b, a FROM x),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, b) AS p FROM y GROUP BY 1, 2),
l AS (SELECT a, string_agg('topic_' || lpad(b::VARCHAR, 3, '0'), ',' ORDER BY p) AS related FROM r WHERE p <= 5 GROUP BY 1),
z AS (SELECT cluster, count(*) AS k, avg(imp) AS imp, sum(id % 4) AS m, list(id::VARCHAR ORDER BY imp DESC, id) AS names,
  string_agg(CASE WHEN imp > 0.7 THEN 'core' WHEN imp > 0.4 THEN 'supporting' ELSE 'peripheral' END, ',' ORDER BY imp DESC, id) AS roles,
  array_to_string(list_sort(list(DISTINCT type)), ',') AS keywords, array_to_string(list_sort(list(DISTINCT 'd' || id % 7)), ',') AS documents FROM w GROUP BY 1),
s AS (SELECT z.*, coalesce(e, 0) / greatest(k * (k - 1), 1)::DOUBLE AS density, least(1.0, 0.4 * imp + 0.3 * coalesce(e, 0) / greatest(k * (k - 1), 1) + 0.2 * least(1.0, m / 50.0) + 0.1 * least(1.0, k / 20.0)) AS score FROM z LEFT JOIN i ON i.c = cluster)
SELECT 'topic_' || lpad(cluster::VARCHAR, 3, '0') AS topic_id, (row_number() OVER (ORDER BY round(score, 12) DESC, cluster) - 1)::BIGINT AS topic_pos, names[1] AS topic_name,
  'Cluster of related concepts including ' || array_to_string(names[1:3], ', ') || CASE WHEN least(k, 5) > 3 THEN ' and ' || (least(k, 5) - 3) || ' more' ELSE '' END AS description,
  array_to_string(names, ',') AS entities, roles, round(score, 9) AS score, k::BIGINT AS entity_count, keywords, coalesce(related, '') AS related, round(density, 9) AS internal_density, documents
FROM s LEFT JOIN l ON l.a = cluster
""")
def topic_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole topics of the labels, label 0 as noise."""
    nodes = nodes_weighed(spark, sf_dir).withColumns({"cluster": F.when(F.col("cluster") == 0, -1).otherwise(F.col("cluster")), "pagerank": F.lit(0.0), "documents": F.array(F.concat(F.lit("d"), (F.col("id") % 7).cast("string")))})
    out = P.build_topics(nodes, edges_emb(spark, sf_dir))
    part = lambda f: F.array_join(F.transform("key_entities", lambda x: x[f]), ",")
    return out.select("topic_id", "topic_pos", "topic_name", "description", part("name").alias("entities"), part("role").alias("roles"), F.round("score", 9).alias("score"), "entity_count", F.array_join("keywords", ",").alias("keywords"), F.array_join(F.transform("related_topics", lambda x: x["topic_id"]), ",").alias("related"), F.round("internal_density", 9).alias("internal_density"), F.array_join("documents", ",").alias("documents"))


@query("WITH t AS (SELECT label::BIGINT AS pos, vec_id AS id FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT label + 1, vec_id FROM embeddings WHERE vec_id % 9 = 0) SELECT vec_id AS id, coalesce(max(pos), -1)::BIGINT AS cluster FROM embeddings LEFT JOIN t ON t.id = vec_id GROUP BY 1")
def clusters_from_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", F.col("label").cast("long").alias("p"))
    rows = v.where("id % 3 = 0").unionByName(v.where("id % 9 = 0").withColumn("p", F.col("p") + 1))
    return P.clusters_from_topics(v, rows.groupBy(F.col("p").alias("topic_pos")).agg(F.collect_list("id").alias("entities")))


SQL_CENTROIDS = "cent AS (SELECT label, list(x ORDER BY k) AS v, max(n) AS n FROM (SELECT label, k, avg(embedding[k]::DOUBLE) AS x, count(*) AS n FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, vector, n): the labels' mean vectors."""
    dims = vectors(spark, sf_dir).select("label", F.posexplode("vector").alias("k", "x"))
    means = dims.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vector"), F.max("n").alias("n"))


@query(f"WITH {SQL_CENTROIDS}, s AS (SELECT vec_id AS id, cent.label AS p, list_cosine_similarity(embedding::DOUBLE[], v) AS sim FROM embeddings, cent WHERE embeddings.label >= 8 AND cent.label < 8) SELECT id, CASE WHEN max(sim) >= 0.2 THEN first(p ORDER BY sim DESC, p) ELSE -1 END::BIGINT AS cluster, round(max(sim), 6) AS sim FROM s GROUP BY 1")
def noise_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of two labels as noise, against the others' centroids."""
    topics = centroids(spark, sf_dir).where("label < 8").select(F.col("label").alias("topic_pos"), "vector")
    return P.rescue(vectors(spark, sf_dir).where("label >= 8"), topics, 0.2).withColumn("sim", F.round("sim", 6))


@query("""
SELECT p_partkey AS id, p_name || '. Type: ' || p_type || '. ' || p_brand AS node, p_name || '. ' || p_type || '. ' || p_brand AS plain,
  p_name || '. ' || array_to_string(string_split(p_name, ' ')[1:5], ', ') AS topic, p_name || '. Key concepts: ' || array_to_string(string_split(p_name, ' '), ', ') || '. Types: ' || p_type AS leaf,
  p_name[1:6] || CASE WHEN length(p_name) > 6 THEN '...' ELSE '' END AS cut, p_name || ' → ' || p_type AS pair, array_to_string(list_distinct(string_split(p_brand, ''))[1:0], '') AS nothing FROM part
""")
def text_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, name, kind, brand = F.split("p_name", " "), F.col("p_name"), F.col("p_type"), F.col("p_brand")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.node_text(name, kind, brand).alias("node"), T.node_text(name, kind, brand, labelled=False).alias("plain"), T.topic_text(name, words).alias("topic"), T.leaf_text(name, words, F.array(kind), F.lit("")).alias("leaf"), T.preview(name, 6).alias("cut"), F.concat_ws(" → ", name, kind).alias("pair"), F.lit("").alias("nothing"))


@query("SELECT n_regionkey AS region, n_name AS name, n_nationkey AS number FROM nation WHERE n_nationkey % 4 <> 1")
def parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply a region, ``name:number, ...``, where some numbers are none."""
    cell = F.concat("n_name", F.lit(" : "), F.when(F.col("n_nationkey") % 4 == 1, "many").otherwise(F.col("n_nationkey").cast("string")))
    replies = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.collect_list(cell), ", ").alias("reply"))
    return replies.select("region", F.explode(T.name_numbers(F.col("reply"))).alias("x")).select("region", "x.name", "x.number")


@query("WITH p AS (SELECT p_partkey AS id, p_name, p_partkey % 10 AS k FROM part) SELECT id, CASE k WHEN 0 THEN 'uses' WHEN 1 THEN 'extends' ELSE 'word' END AS kind, CASE WHEN k < 2 THEN k / 10.0 ELSE 0.7 END::DOUBLE AS confidence FROM p")
def parse_type_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line a part, ``type|confidence``; where there is no number the confidence is 0.7."""
    k = F.col("p_partkey") % 10
    line = F.when(k == 0, "Uses | 0.0").when(k == 1, "extends|0.1").when(k == 2, "word|much").otherwise("word")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(T.type_lines(line), F.lit(0)).alias("t"))
    return rows.select("id", F.col("t.type").alias("kind"), F.col("t.confidence").alias("confidence"))


@query()
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default embedder over parts; its hashes are no SQL, so it is tested by brute force."""
    from ..plugins import hash_embedder

    text = T.node_text(F.col("p_name"), F.col("p_type"), F.col("p_brand"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hash_embedder(text, 64).alias("vector"))
    return rows.withColumn("vector", F.transform("vector", lambda x: F.round(x, 6)))


