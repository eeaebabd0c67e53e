"""Registered queries of the graph engine, each next to its DuckDB oracle.

Fixture graphs on the driver's tables: G_emb has an edge for each pair of embeddings with a
cosine of at least 0.3, its nodes typed by label; G_doc has the capitalised names of documents
and an edge between neighbouring names; G_trade links suppliers to parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import centrality as C
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import held
from ..operators import retrieval as R
from ..operators import topics as P
from ..operators import vectors as V

NAME = r"[A-Z][A-Za-z0-9-]+(?: [A-Z][A-Za-z0-9-]+)*"
TYPES = ["model", "dataset", "method", "task", "architecture", "person", "component", "concept", "technique", "unknown"]
EDGE = 0.3
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def nodes_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, TYPES)), F.col("label"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), kind.alias("type"), F.col("label").cast("long").alias("cluster"))


def pairs_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G_emb's edges as they are found, for what reads them once."""
    return V.similar_pairs(vectors(spark, sf_dir), EDGE).select(F.col("i").alias("src"), F.col("j").alias("dst"), "sim")


def edges_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cut(pairs_emb(spark, sf_dir))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(NAME), F.lit(0))
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("ord", "name"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(NAME), F.lit(0))
    docs = read(spark, sf_dir, "documents").select("doc_id", found.alias("n"))
    return docs.where(F.size("n") > 1).select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("n") - 2), lambda i: F.struct(F.get("n", i).alias("src"), F.get("n", i + 1).alias("dst"), i.alias("ord")))).alias("r")).select("doc_id", "r.*")


WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SQL_NAMES = f"SELECT doc_id, n, unnest(range(1, len(n) + 1)) AS ord FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{NAME}') AS n FROM documents)"
SQL_NODES = "nodes AS (SELECT vec_id AS id, label::BIGINT AS cluster, [" + ", ".join(f"'{t}'" for t in TYPES) + "][label + 1] AS type FROM embeddings)"
SQL_EDGES = f"edges AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {EDGE})"
SQL_TWO = "two AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"
SQL_GRAPH = f"{SQL_NODES}, {SQL_EDGES}, {SQL_TWO}"


# ------------------------------------------------------------------------------------------- text


@query(f"SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n FROM (SELECT doc_id, replace(replace(replace(trim(regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g'), ' '), chr(0), ''), chr(61623), ''), chr(8226), '') AS t FROM documents)")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = T.clean_text(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(cleaned).alias("digest"), F.length(cleaned).cast("long").alias("n"))


_CHUNK = "CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 7000 THEN 1 ELSE ceil((length(t) - 7000) / 6500.0)::INT + 1 END"


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, k::INT AS chunk_no, md5(substring(t, k * 6500 + 1, 7000)) AS digest FROM (SELECT doc_id, t, unnest(range(0, {_CHUNK})) AS k FROM d)")
def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = T.chunks(F.coalesce("text", F.lit("")), 7000, 500)
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("chunk_no", "t")).select("doc_id", "chunk_no", F.md5("t").alias("digest"))


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, k::INT AS chunk_no, CASE WHEN length(t) > 15000 THEN md5(substring(t, k * 6500 + 1, 7000)) ELSE md5(substring(t, 1, 8000)) END AS digest FROM (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) > 15000 THEN least(5, {_CHUNK}) ELSE 1 END)) AS k FROM d WHERE t <> '')")
def chunk_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts: five pieces of 7,000; others: the first 8,000 signs.  These limits are the feature."""
    docs = read(spark, sf_dir, "documents").where(F.length("text") > 0)
    pieces = F.when(F.length("text") > 15000, F.slice(T.chunks(F.col("text"), 7000, 500), 1, 5)).otherwise(F.array(F.substring("text", 1, 8000)))
    return docs.select("doc_id", F.posexplode(pieces).alias("chunk_no", "t")).select("doc_id", "chunk_no", F.md5("t").alias("digest"))


@query("SELECT event_type, CASE lower(event_type) " + " ".join(f"WHEN '{w}' THEN '{v}'" for v, ws in T.RELATIONS.items() for w in ws) + " ELSE lower(event_type) END AS relation, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def relation_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", T.normalize_relation(F.col("event_type")).alias("relation"), "n")


# ------------------------------------------------------------------------------------- extraction


@query(f"SELECT doc_id, lower(n[ord]) AS key, arg_min(n[ord], ord) AS name, count(*)::BIGINT AS n FROM ({SQL_NAMES}) GROUP BY 1, 2")
def entity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = names(spark, sf_dir)
    return found.groupBy("doc_id", F.lower("name").alias("key")).agg(F.min_by("name", "ord").alias("name"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT lower(n[ord]) AS id, count(*)::BIGINT AS mentions, count(DISTINCT doc_id)::BIGINT AS documents, list_sort(list(DISTINCT n[ord])) AS aliases FROM ({SQL_NAMES}) GROUP BY 1")
def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = names(spark, sf_dir).select("name", F.lower("name").alias("canonical"), F.lit("concept").alias("type"), F.col("doc_id").alias("doc"), "ord")
    merged = G.merge_nodes(found)
    return merged.select("id", "mentions", F.size(F.array_distinct("documents")).cast("long").alias("documents"), "aliases")


_EDGE_SQL = f"""
WITH r AS (
  SELECT n[ord] AS src, n[ord + 1] AS dst, doc_id, doc_id * 100000 + ord AS o,
    CASE ord % 3 WHEN 0 THEN 'uses' WHEN 1 THEN 'is_a' ELSE 'extends' END AS relation, (ord % 7) / 10.0 AS confidence
  FROM ({SQL_NAMES}) WHERE ord < len(n)
),
p AS (SELECT src, dst, relation, min(o) AS o FROM r GROUP BY 1, 2, 3),
l AS (SELECT src, dst, list(relation ORDER BY o) AS relations FROM p GROUP BY 1, 2)
SELECT r.src, r.dst, any_value(array_to_string(l.relations, ',')) AS relations, count(*)::BIGINT AS mentions,
  md5(array_to_string(list(doc_id ORDER BY o), ',')) AS sources, max(confidence)::DOUBLE AS confidence
FROM r JOIN l ON l.src = r.src AND l.dst = r.dst GROUP BY r.src, r.dst
"""


@query(_EDGE_SQL)
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring names, with a verb and a confidence by their place, merged to one edge a pair."""
    at = F.col("ord") + 1
    verb = F.when(at % 3 == 0, "uses").when(at % 3 == 1, "is_a").otherwise("extends")
    found = relations(spark, sf_dir).select("src", "dst", verb.alias("relation"), F.col("doc_id").alias("doc"), (at % 7 / 10.0).alias("confidence"), (F.col("doc_id") * 100000 + at).alias("ord"))
    merged = G.merge_edges(found)
    return merged.select("src", "dst", F.array_join("relations", ",").alias("relations"), "mentions", F.md5(F.array_join(F.col("sources").cast("array<string>"), ",")).alias("sources"), F.col("confidence").cast("double").alias("confidence"))


# ------------------------------------------------------------------------------------------ graph


@query("WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), n AS (SELECT count(*) AS n FROM (SELECT 's' || s FROM e UNION SELECT 'p' || p FROM e)), m AS (SELECT count(*) AS m FROM e) SELECT n::BIGINT AS num_nodes, m::BIGINT AS num_edges, round(m / (n * (n - 1.0)), 9) AS density, round(2.0 * m / n, 9) AS avg_degree FROM n, m")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return G.statistics(nodes, edges).select("num_nodes", "num_edges", F.round("density", 9).alias("density"), F.round("avg_degree", 9).alias("avg_degree"))


@query(f"WITH {SQL_GRAPH} SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*)::BIGINT AS total_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(edges_emb(spark, sf_dir))


@query("SELECT coalesce(event_type, 'unknown') AS relation, count(*)::BIGINT AS n FROM events GROUP BY 1")
def relation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.coalesce("event_type", F.lit("unknown")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_EDGES} SELECT src AS i, dst AS j, round(sim, 6) AS sim FROM edges")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.similar_pairs(vectors(spark, sf_dir), EDGE).select("i", "j", F.round("sim", 6).alias("sim"))


@query("WITH s AS (SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS sim FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id DESC) AS rank FROM s) SELECT query, id, round(sim, 6) AS sim, rank::INT AS rank FROM r WHERE rank <= 5 AND sim > 0.3")
def knn_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return V.nearest(v.where("id % 20 = 0"), v).select("query", "id", F.round("sim", 6).alias("sim"), "rank")


def _sql_pagerank(rounds: int, tolerance: float) -> str:
    """Rounds of common table expressions; from the round on whose change ``c`` is below nodes * tolerance, ranks stay."""
    ctes = [SQL_NODES, SQL_EDGES, "n AS (SELECT count(*)::DOUBLE AS n FROM nodes)", "deg AS (SELECT src AS id, count(*)::DOUBLE AS d FROM edges GROUP BY 1)", "p0 AS MATERIALIZED (SELECT id, 1 / n AS r, 1e9 AS c FROM nodes, n)"]
    for k in range(rounds):
        lost = f"(SELECT coalesce(sum(r), 0) FROM p{k} WHERE id NOT IN (SELECT id FROM deg))"
        flow = f"SELECT e.dst AS id, sum(p.r / deg.d) AS f FROM edges e JOIN p{k} p ON p.id = e.src JOIN deg ON deg.id = e.src GROUP BY 1"
        new = f"SELECT o.id, o.r AS old, CASE WHEN o.c < n * {tolerance} THEN o.r ELSE 0.15 / n + 0.85 * {lost} / n + 0.85 * coalesce(f.f, 0) END AS r FROM p{k} o CROSS JOIN n LEFT JOIN ({flow}) f ON f.id = o.id"
        ctes.append(f"p{k + 1} AS MATERIALIZED (SELECT id, r, sum(abs(r - old)) OVER () AS c FROM ({new}))")
    return "WITH " + ", ".join(ctes) + f" SELECT id, round(r, 9) AS pagerank FROM p{rounds}"


@query(_sql_pagerank(100, 1e-6))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the reference's tolerance, at most 100 rounds."""
    return G.pagerank(nodes_emb(spark, sf_dir), edges_emb(spark, sf_dir), 100, tolerance=1e-6).select("id", F.round("pagerank", 9).alias("pagerank"))


@query(f"WITH {SQL_GRAPH}, deg AS (SELECT src AS id, count(*) AS k FROM two GROUP BY 1), tri AS (SELECT a.src AS id, count(*) / 2 AS t FROM two a JOIN two b ON b.src = a.dst JOIN two c ON c.src = b.dst AND c.dst = a.src GROUP BY 1) SELECT nodes.id, round(CASE WHEN k >= 2 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 9) AS clustering FROM nodes LEFT JOIN deg ON deg.id = nodes.id LEFT JOIN tri ON tri.id = nodes.id")
def clustering_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clustering(nodes_emb(spark, sf_dir), pairs_emb(spark, sf_dir)).select("id", F.round("clustering", 9).alias("clustering"))


@query(f"WITH RECURSIVE {SQL_GRAPH}, reach AS (SELECT id, id AS c FROM nodes UNION SELECT two.dst, reach.c FROM reach JOIN two ON two.src = reach.id) SELECT id, min(c) AS component FROM reach GROUP BY 1")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.weak_components(nodes_emb(spark, sf_dir), edges_emb(spark, sf_dir))


@query(f"WITH RECURSIVE {SQL_GRAPH}, walk AS (SELECT id, 0 AS hop FROM nodes WHERE id % 20 = 0 UNION SELECT two.dst, hop + 1 FROM walk JOIN two ON two.src = walk.id WHERE hop < 2) SELECT id, min(hop)::INT AS hop FROM walk GROUP BY 1")
def k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the whole stated query set, as ``knn_seeds``."""
    return G.k_hop(edges_emb(spark, sf_dir), nodes_emb(spark, sf_dir).where("id % 20 = 0"))


@query("WITH o AS (SELECT o_custkey, count(*)::DOUBLE AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey AS id, c_acctbal AS a, coalesce(n, 0) AS n FROM customer LEFT JOIN o ON o_custkey = c_custkey), e AS (SELECT min(a) AS la, max(a) AS ha, min(n) AS ln, max(n) AS hn FROM c), s AS (SELECT id, 0.5 * coalesce((a - la) / nullif(ha - la, 0), 0.5) + 0.5 * coalesce((n - ln) / nullif(hn - ln, 0), 0.5) AS x FROM c, e) SELECT id, round(x, 9) AS importance, CASE WHEN x > 0.7 THEN 'core' WHEN x > 0.4 THEN 'supporting' ELSE 'peripheral' END AS role FROM s")
def importance_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    who = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"))
    both = G.min_max(who.join(orders, "id", "left").withColumn("n", F.coalesce("n", F.lit(0.0))), ["a", "n"])
    x = 0.5 * F.col("a") + 0.5 * F.col("n")
    return both.select("id", F.round(x, 9).alias("importance"), T.role(x).alias("role"))


_RULES = """CASE WHEN (s.type LIKE '%model%' OR s.type LIKE '%architecture%') AND t.type LIKE '%dataset%' THEN 'trained_on'
 WHEN (s.type LIKE '%model%' OR s.type LIKE '%architecture%') AND (t.type LIKE '%method%' OR t.type LIKE '%technique%') THEN 'uses'
 WHEN (s.type LIKE '%model%' OR s.type LIKE '%architecture%') AND t.type LIKE '%task%' THEN 'applied_to'
 WHEN t.type LIKE '%dataset%' THEN 'evaluated_on' WHEN t.type LIKE '%architecture%' THEN 'uses'
 WHEN t.type LIKE '%person%' OR t.type LIKE '%author%' THEN 'authored_by' WHEN t.type LIKE '%component%' THEN 'part_of'
 WHEN t.type LIKE '%method%' OR t.type LIKE '%technique%' THEN 'uses' ELSE 'semantically_related' END"""


@query(f"WITH {SQL_GRAPH}, r AS (SELECT src, dst, {_RULES} AS relation FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst) SELECT src, dst, relation, CASE WHEN relation = 'semantically_related' THEN 0.3 ELSE 0.6 END AS confidence FROM r")
def relation_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edges_emb(spark, sf_dir).select("src", "dst", F.lit("semantically_related").alias("relation"), F.lit(True).alias("inferred"), F.lit(None).cast("double").alias("confidence"))
    typed = G.relation_types(edges, nodes_emb(spark, sf_dir))
    return G.fill_confidence(typed).select("src", "dst", "relation", "confidence")


@query(f"WITH {SQL_GRAPH}, m AS (SELECT count(*)::DOUBLE AS m FROM edges), d AS (SELECT c, sum(w) AS d FROM (SELECT s.cluster AS c, 1.0 AS w FROM edges JOIN nodes s ON s.id = src UNION ALL SELECT t.cluster, 1.0 FROM edges JOIN nodes t ON t.id = dst) GROUP BY 1), i AS (SELECT s.cluster AS c, count(*)::DOUBLE AS i FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE s.cluster = t.cluster GROUP BY 1) SELECT round(sum(coalesce(i, 0) / m - (d / (2 * m)) ** 2), 9) AS modularity FROM d LEFT JOIN i ON i.c = d.c CROSS JOIN m")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edges_emb(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return G.modularity(edges, nodes_emb(spark, sf_dir)).select(F.round("modularity", 9).alias("modularity"))


@query(f"WITH {SQL_GRAPH}, x AS (SELECT s.cluster AS a, t.cluster AS b FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE s.cluster <> t.cluster), y AS (SELECT a, b FROM x UNION ALL SELECT b, a FROM x), z AS (SELECT cluster, count(*) AS k FROM nodes GROUP BY 1), r AS (SELECT a, b, count(*) AS n, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, b) AS rank FROM y GROUP BY 1, 2) SELECT a AS cluster, b AS related, round(n / k::DOUBLE, 9) AS similarity, rank::INT AS rank FROM r JOIN z ON z.cluster = a WHERE rank <= 5")
def related_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.related_topics(edges_emb(spark, sf_dir), nodes_emb(spark, sf_dir))
    return out.select("cluster", "related", F.round("similarity", 9).alias("similarity"), "rank")


_COHERENCE_SQL = """
WITH r AS (SELECT label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
f AS (SELECT * FROM r WHERE k <= 10)
SELECT a.label, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS coherence
FROM f a JOIN f b ON a.label = b.label AND a.k <> b.k GROUP BY 1
"""


@query(_COHERENCE_SQL)
def topic_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of the pairs of a topic's first ten members, in closed form: linear in the vectors."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    members = vectors(spark, sf_dir).select(F.col("label").alias("topic"), place.alias("rank"), "vector")
    return E.topic_coherence(members).select(F.col("topic").alias("label"), F.round("coherence", 6).alias("coherence"))


@query()
def capped_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy in the order of similarity, so not plain SQL; tested against the sequential loop."""
    pairs = V.similar_pairs(vectors(spark, sf_dir), EDGE)
    none = pairs.select(F.col("i").alias("src"), F.col("j").alias("dst")).limit(0)
    return G.capped_edges(pairs, none, 3).select("i", "j", F.round("sim", 6).alias("sim"))


# ------------------------------------------------------------------- resolution, retrieval, measures


@query()
def leader_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders in the order of ids among vectors of one type; tested against the sequential scan."""
    v = vectors(spark, sf_dir)
    kind = lambda c: v.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}"))
    pairs = V.similar_pairs(v, EDGE).join(kind("i"), "i").join(kind("j"), "j").where("l_i = l_j")
    return C.leaders(v, pairs)


@query()
def eigenvector_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.eigenvector(nodes_emb(spark, sf_dir), edges_emb(spark, sf_dir))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = vectors(spark, sf_dir).select("label", F.posexplode("vector").alias("k", "x"))
    means = dims.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    rows = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vector"), F.max("n").alias("size"))
    return P.build_tree(rows.select(F.format_string("topic_%03d", F.col("label").cast("int")).alias("id"), F.get(F.array(*map(F.lit, TYPES)), F.col("label")).alias("name"), "vector", "size"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("id % 20 = 0")


@query()
def topic_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).drop("vector")


@query()
def tree_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tree_quality(_tree(spark, sf_dir))


@query()
def retrieve_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.traverse(_asked(spark, sf_dir), _tree(spark, sf_dir))


@query()
def retrieve_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.collapsed(_asked(spark, sf_dir), _tree(spark, sf_dir))


@query()
def retrieve_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.adaptive(_asked(spark, sf_dir), _tree(spark, sf_dir))


@query()
def retrieve_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds by similarity, two hops, scores: the queries are the vectors whose id is divisible by 20."""
    v, asked = vectors(spark, sf_dir), _asked(spark, sf_dir)
    edges = held.kept(pairs_emb(spark, sf_dir)).select("src", "dst", F.lit("related_to").alias("relation"), F.xxhash64("src", "dst").alias("ord"))
    seeds = V.nearest(asked, v)
    known = v.select("id", "vector", F.lit(None).cast("double").alias("importance"), F.lit(None).cast("double").alias("pagerank"))
    best = R.score(R.expand_best(seeds, edges, asked, known), asked, known)
    return best.select("query", "id", "hop", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_SQL_D = "p AS (SELECT a.vec_id AS id, a.label AS c, b.label AS o, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d, count(*) AS n FROM embeddings a CROSS JOIN embeddings b WHERE a.label >= 0 AND b.label >= 0 GROUP BY 1, 2, 3), s AS (SELECT id, max(CASE WHEN c = o AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN c <> o THEN d / n END) AS b FROM p GROUP BY 1)"


@query(f"WITH {_SQL_D} SELECT id, round(coalesce((b - a) / nullif(CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE greatest(a, b) END, 0), 0), 5) + 0.0 AS silhouette FROM s")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.silhouettes(vectors(spark, sf_dir).withColumnRenamed("label", "cluster"))
    return out.select("id", (F.round("silhouette", 5) + 0.0).alias("silhouette"))


SQL_WEIGHED = "(id % 11) / 10.0"
_SCORES_SQL = f"""
WITH {SQL_NODES}, {SQL_EDGES},
i AS (SELECT s.cluster AS c, count(*) AS e FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE s.cluster = t.cluster GROUP BY 1),
z AS (SELECT cluster, count(*) AS k, avg({SQL_WEIGHED}::DOUBLE) AS imp, sum(id % 4) AS m FROM nodes WHERE cluster >= 0 GROUP BY 1)
SELECT cluster, k::BIGINT AS size, round(coalesce(e, 0) / greatest(k * (k - 1), 1)::DOUBLE, 9) AS density, round(imp, 9) AS importance,
  round(least(1.0, 0.4 * imp + 0.3 * coalesce(e, 0) / greatest(k * (k - 1), 1) + 0.2 * least(1.0, m / 50.0) + 0.1 * least(1.0, k / 20.0)), 9) AS score
FROM z LEFT JOIN i ON i.c = cluster
"""


def nodes_weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G_emb's nodes with an importance and mentions made from the id."""
    return nodes_emb(spark, sf_dir).withColumns({"importance": (F.col("id") % 11) / 10.0, "mentions": F.col("id") % 4})


@query(_SCORES_SQL)
def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.topic_scores(nodes_weighed(spark, sf_dir), edges_emb(spark, sf_dir))
    return out.select("cluster", "size", *[F.round(c, 9).alias(c) for c in ("density", "importance", "score")])


@query("WITH got AS (SELECT DISTINCT o_custkey AS query, l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 25), want AS (SELECT DISTINCT o_custkey AS query, l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity <= 35), s AS (SELECT query, count(g) AS got, count(w) AS want, count(CASE WHEN g = 1 AND w = 1 THEN 1 END) AS hit FROM (SELECT *, 1 AS g FROM got) FULL JOIN (SELECT *, 1 AS w FROM want) USING (query, id) GROUP BY 1) SELECT query, round(coalesce(hit / nullif(got, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(hit / nullif(want, 0)::DOUBLE, 0), 9) AS recall, round(coalesce(2.0 * hit / nullif(got + want, 0), 0), 9) AS f1 FROM s")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    rows = lambda cond: lines.where(cond).select(F.col("o_custkey").alias("query"), F.col("l_partkey").alias("id"))
    out = E.prf(rows("l_quantity >= 25"), rows("l_quantity <= 35"))
    return out.select("query", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])
