"""What a graph's nodes gain from its structure: importance, inferred types, summary figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centrality import betweenness, eigenvector
from .graph import clustering, degrees, min_max, pagerank

#: The share of each measure in a node's importance.
WEIGHTS = {"pagerank": 0.3, "betweenness": 0.2, "eigenvector": 0.2, "total_degree": 0.15, "mentions": 0.15}


def importance(metrics: DataFrame) -> DataFrame:
    """(id, importance) of (id, and the measures of ``WEIGHTS``), each scaled to 0..1; missing mentions are 1, other missing ones 0."""
    filled = metrics.select("id", *[F.coalesce(F.col(c).cast("double"), F.lit(1.0 if c == "mentions" else 0.0)).alias(c) for c in WEIGHTS])
    scaled = min_max(filled, list(WEIGHTS))
    return scaled.select("id", sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0)).alias("importance"))


def infer_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, inferred_type) of (id, type): unknown nodes and concepts by the relations that leave and reach them.

    ``edges`` has (src, dst, relations).  Only flags and counts are aggregated, never lists of relations.
    """
    # The rules.
    rows = edges.select("src", "dst", F.explode("relations").alias("r"))
    one = lambda c: F.when(c, 1).otherwise(0)
    zero = F.lit(0)
    out = rows.select(F.col("src").alias("id"), one(F.col("r").isin("uses", "implements")).alias("method"), zero.alias("category"), one(F.col("r") == "contains").alias("architecture"), F.lit(1).alias("o"), zero.alias("i"))
    back = rows.select(F.col("dst").alias("id"), zero.alias("method"), one(F.col("r") == "is_a").alias("category"), zero.alias("architecture"), zero.alias("o"), F.lit(1).alias("i"))
    sums = out.unionByName(back).groupBy("id").agg(*[F.max(c).alias(c) for c in ("method", "category", "architecture")], F.sum("o").alias("o"), F.sum("i").alias("i"))
    kind = F.coalesce("type", F.lit("unknown"))
    rule = F.when(F.col("method") == 1, "method").when(F.col("category") == 1, "category").when(F.col("architecture") == 1, "architecture").when(F.col("i") > F.col("o"), "component").otherwise(kind)
    return nodes.select("id", "type").join(sums, "id", "left").select("id", F.when(kind.isin("unknown", "concept"), rule).otherwise(kind).alias("inferred_type"))


def enhance(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """All columns of ``nodes`` with centralities, degrees, clustering, importance and the inferred type.

    ``sources`` are the ids that betweenness starts from: all of them if it is None, which suits small graphs.
    """
    zero = lambda *cs: [F.coalesce(c, F.lit(0)).alias(c) for c in cs]
    m = nodes.select("id", *(["mentions"] if "mentions" in nodes.columns else [F.lit(1).alias("mentions")]))
    m = m.join(pagerank(nodes, edges), "id", "left").join(betweenness(nodes, edges, sources), "id", "left").join(eigenvector(nodes, edges), "id", "left")
    m = m.join(degrees(edges), "id", "left").join(clustering(nodes, edges), "id", "left")
    m = m.select("id", "mentions", "pagerank", "betweenness", "eigenvector", *zero("in_degree", "out_degree", "total_degree"), "clustering")
    kinds = infer_types(nodes, edges) if "relations" in edges.columns else nodes.select("id", F.col("type").alias("inferred_type"))
    return nodes.join(m.drop("mentions"), "id").join(importance(m), "id").join(kinds, "id")


def graph_summary(enhanced: DataFrame) -> DataFrame:
    """One row: nodes, means of PageRank, betweenness and clustering, and communities."""
    cols = enhanced.columns
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") if c in cols else F.lit(0.0).alias(f"avg_{c}")
    groups = F.count_distinct("community") if "community" in cols else F.lit(0).cast("long")
    return enhanced.agg(F.count(F.lit(1)).alias("num_nodes"), mean("pagerank"), mean("betweenness"), mean("clustering"), groups.alias("communities"))


def top_nodes(enhanced: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The ``k`` nodes with the most of a measure; of equals the lower id."""
    return enhanced.orderBy(F.desc(by), "id").limit(k).select("id", by)
