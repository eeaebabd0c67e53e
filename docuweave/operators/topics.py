"""Topics from clusters, and the tree of topics built from the bottom up."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, role, topic_description

#: Most topics that a tree is built from: their vectors come to the driver, so more is an error.
MOST = 2000


def topic_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, size, density, importance, score) of (id, cluster, importance, mentions); noise (-1) left out."""
    own = nodes.where("cluster >= 0")
    c = lambda end: own.select(F.col("id").alias(end), F.col("cluster").alias(f"c_{end}"))
    inside = edges.join(c("src"), "src").join(c("dst"), "dst").where("c_src = c_dst").groupBy(F.col("c_src").alias("cluster")).agg(F.count(F.lit(1)).alias("e"))
    sums = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg(F.coalesce("importance", F.lit(0.0))).alias("importance"), F.sum(F.coalesce("mentions", F.lit(1))).alias("m"))
    density = F.coalesce("e", F.lit(0)) / F.greatest(F.col("size") * (F.col("size") - 1), F.lit(1))
    total = 0.4 * F.col("importance") + 0.3 * density + 0.2 * F.least(F.lit(1.0), F.col("m") / 50) + 0.1 * F.least(F.lit(1.0), F.col("size") / 20)
    return sums.join(inside, "cluster", "left").select("cluster", "size", density.alias("density"), "importance", F.least(F.lit(1.0), total).alias("score"))


def related_topics(edges: DataFrame, clusters: DataFrame, most: int = 5) -> DataFrame:
    """(cluster, related, similarity, rank): the clusters that share most edges with one, either way, by its own size."""
    own = clusters.where("cluster >= 0")
    c = lambda end: own.select(F.col("id").alias(end), F.col("cluster").alias(f"c_{end}"))
    e = edges.join(c("src"), "src").join(c("dst"), "dst").where("c_src <> c_dst")
    both = e.select(F.explode(F.array(F.struct(F.col("c_src").alias("cluster"), F.col("c_dst").alias("related")), F.struct(F.col("c_dst").alias("cluster"), F.col("c_src").alias("related")))).alias("r"))
    counts = both.groupBy("r.cluster", "r.related").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "related"))).where(F.col("rank") <= most)
    size = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    return ranked.join(size, "cluster").select("cluster", "related", (F.col("n") / F.col("k")).alias("similarity"), "rank")


def build_topics(nodes: DataFrame, edges: DataFrame, keywords: int = 10) -> DataFrame:
    """One row a topic, from (id, cluster, importance, pagerank, mentions, type, documents) and edges; noise (-1) left out.

    ``key_entities`` are all entities, the most important first, of equals the lower id; the first gives the
    topic its name.  ``topic_pos`` counts topics from 0 by score, of equals the lower cluster.
    """
    own = nodes.where("cluster >= 0").withColumns({"importance": F.coalesce("importance", F.lit(0.0)), "pagerank": F.coalesce("pagerank", F.lit(0.0))})
    entity = F.struct((-F.col("importance")).alias("o"), F.col("id").alias("name"), "importance", F.col("pagerank").alias("centrality"), role(F.col("importance")).alias("role"))
    lists = own.groupBy("cluster").agg(F.array_sort(F.collect_list(entity)).alias("e"), F.slice(F.array_sort(F.collect_set(F.coalesce("type", F.lit("unknown")))), 1, keywords).alias("keywords"))
    lists = lists.withColumn("key_entities", F.transform("e", lambda x: F.struct(x["name"].cast("string").alias("name"), x["importance"].alias("importance"), x["centrality"].alias("centrality"), x["role"].alias("role"))))
    docs = own.select("cluster", F.explode("documents").alias("d")).groupBy("cluster").agg(F.array_sort(F.collect_set("d")).alias("documents"))
    links = related_topics(edges, own).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "related", "similarity"))), lambda x: F.struct(F.format_string("topic_%03d", x["related"].cast("long")).alias("topic_id"), x["similarity"].alias("similarity"))).alias("related_topics"))
    names = F.transform("key_entities", lambda x: x["name"])
    out = lists.join(topic_scores(nodes, edges), "cluster").join(docs, "cluster", "left").join(links, "cluster", "left")
    # One row a topic: the window runs over that list alone.
    place = (F.row_number().over(Window.orderBy(F.desc("score"), "cluster")) - 1).cast("long")
    return out.select(
        "cluster",
        F.format_string("topic_%03d", F.col("cluster").cast("long")).alias("topic_id"),
        place.alias("topic_pos"),
        F.get(names, F.lit(0)).alias("topic_name"),
        topic_description(names).alias("description"),
        "key_entities",
        "score",
        F.col("size").alias("entity_count"),
        "keywords",
        F.coalesce("related_topics", F.array()).alias("related_topics"),
        F.col("density").alias("internal_density"),
        F.col("importance").alias("avg_importance"),
        F.coalesce("documents", F.array().cast("array<string>")).alias("documents"),
    )


def clusters_from_topics(nodes: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, cluster): the position of the topic that lists a node, the last of several; -1 for the rest.

    ``topics`` has (topic_pos, entities: names).
    """
    listed = topics.select("topic_pos", F.explode("entities").alias("id")).groupBy("id").agg(F.max("topic_pos").alias("cluster"))
    return nodes.select("id").join(listed, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def cluster_quality(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row of nine figures; noise is one community in the modularity, and no cluster elsewhere."""
    from .graph import modularity

    sizes = clusters.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    figures = sizes.agg(F.count(F.lit(1)).alias("num_clusters"), zero(F.sum("k"), "long").alias("num_clustered"), zero(F.avg("k"), "double").alias("avg_cluster_size"), zero(F.min("k"), "long").alias("min_cluster_size"), zero(F.max("k"), "long").alias("max_cluster_size"))
    total = clusters.agg(F.count(F.lit(1)).alias("num_nodes"))
    row = figures.join(F.broadcast(total)).join(F.broadcast(modularity(edges, clusters)))  # one row each
    share = F.coalesce(F.try_divide(F.col("num_clustered"), F.col("num_nodes")), F.lit(0.0))
    return row.withColumns({"num_noise": F.col("num_nodes") - F.col("num_clustered"), "coverage": share})


def rescue(noise: DataFrame, topics: DataFrame, threshold: float = 0.55, fallback: int = -1) -> DataFrame:
    """(id, cluster, sim) of (id, vector): the most similar topic (topic_pos, vector), the first of equals, from the threshold on.

    Others get ``fallback``.  Topics are few against nodes, but their number is not bounded: Spark
    broadcasts them if it finds them small.  Rows stay one a node: each is compared by partial aggregation.
    """
    t = topics.select("topic_pos", F.col("vector").alias("_t"))
    sims = noise.select("id", "vector").join(t, F.lit(True), "left").select("id", "topic_pos", F.when(F.col("topic_pos").isNotNull(), cosine(F.col("vector"), F.col("_t"))).alias("sim"))
    best = sims.groupBy("id").agg(F.max_by("topic_pos", F.struct("sim", -F.col("topic_pos"))).alias("p"), F.max("sim").alias("sim"))
    return best.select("id", F.when(F.col("sim") >= threshold, F.col("p").cast("long")).otherwise(F.lit(fallback).cast("long")).alias("cluster"), "sim")


def average_linkage(vectors: np.ndarray, k: int) -> list[int]:
    """Labels of ``k`` clusters by average linkage on cosine distance, numbered by first appearance."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms == 0, 1, norms)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(len(d)), np.arange(len(d)), len(d)
    while alive > k:
        i, j = sorted(map(int, np.unravel_index(np.argmin(d), d.shape)))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        alive -= 1
    return [list(dict.fromkeys(label.tolist())).index(x) for x in label.tolist()]


def cluster_name(names: list[str]) -> str:
    words = [w for n in names for w in n.replace("-", " ").replace("_", " ").split() if len(w) > 2]
    top = sorted(dict.fromkeys(words), key=lambda w: -words.count(w))[:2]
    return " & ".join(top) or (names[0] if names else "Cluster")


def build_tree(topics: DataFrame, depth: int = 4) -> DataFrame:
    """(id, level, kind, name, summary, size, vector, parent, ord) from (id, name, vector, size).

    Each level is halved by average linkage until two nodes or ``depth`` levels are left; a root
    joins what is left.  More than ``MOST`` topics are an error, since they come to the driver.
    """
    spark = topics.sparkSession
    rows = topics.select(F.col("id").cast("string").alias("id"), "name", "vector", F.col("size").cast("long").alias("size")).orderBy("id").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} topics")
    level = [{"id": r["id"], "level": 0, "kind": "leaf", "name": r["name"] or "", "summary": "", "size": r["size"] or 0, "vector": [float(x) for x in r["vector"]], "parent": None} for r in rows]
    tree, k = list(level), 0

    def parent(id_: str, kind: str, children: list[dict], name: str, summary: str) -> dict:
        for c in children:
            c["parent"] = id_
        return {"id": id_, "level": k, "kind": kind, "name": name, "summary": summary, "size": sum(c["size"] for c in children), "vector": np.mean([c["vector"] for c in children], axis=0).tolist(), "parent": None}

    while len(level) > 2 and k < depth:
        want = min(max(2, len(level) // 2), len(level) - 1)
        labels = average_linkage(np.array([x["vector"] for x in level]), want)
        k += 1
        above = []
        for c in range(max(labels) + 1):
            kids = [x for x, at in zip(level, labels, strict=True) if at == c]
            names = [x["name"] for x in kids]
            more = f" and {len(names) - 5} more" if len(names) > 5 else ""
            above.append(parent(f"cluster_L{k}_{c}", "branch", kids, cluster_name(names), f"Group containing: {', '.join(names[:5])}{more}"))
        tree += above
        level = above
    if len(level) > 1:
        k += 1
        tree.append(parent("root", "root", level, "Knowledge Base Root", "Complete knowledge base covering: " + ", ".join(x["name"] for x in level[:10])))
    cols = ["id", "level", "kind", "name", "summary", "size", "vector", "parent"]
    return spark.createDataFrame([(*[x[c] for c in cols], i) for i, x in enumerate(tree)], "id string, level int, kind string, name string, summary string, size long, vector array<double>, parent string, ord int")
