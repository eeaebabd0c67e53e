"""Communities: Louvain as rounds of joins, spectral groups, the ensemble of both, small groups as noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def size_filter(clusters: DataFrame, least: int = 3) -> DataFrame:
    """(id, cluster): clusters of fewer than ``least`` nodes become -1, others are numbered from 0 in the order of their ids."""
    sizes = clusters.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    # One row a cluster that stays: the window runs over that list alone.
    numbered = sizes.select("cluster", (F.dense_rank().over(Window.orderBy("cluster")) - 1).cast("long").alias("_new"))
    return clusters.join(numbered, "cluster", "left").select("id", F.coalesce("_new", F.lit(-1)).alias("cluster"))


def _weighted(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b, w), a <= b; reciprocal ones once."""
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    w = F.coalesce(w, F.lit(1.0))
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") > F.col("dst")).alias("o"), w.alias("w")).groupBy("a", "b").agg(F.min_by("w", "o").alias("w"))


def _moved(edges: DataFrame, rounds: int) -> DataFrame:
    """Local moving: (id, cluster) of the nodes of (a, b, w).

    In each round half of the nodes, by a hash of node and round, may move to the neighbouring community of most gain, the least of
    equals.  Self-loops count for degrees alone.
    """
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    degree = cut(both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
    two_m = degree.agg(F.sum("k").alias("m")).first()["m"] or 0.0
    state = cut(degree.select("id", "k", F.col("id").alias("c")))
    if not two_m:
        return state.select("id", F.col("c").alias("cluster"))
    links = cut(both.where("a <> b"))
    still = 0
    for r in range(rounds):
        total = state.groupBy("c").agg(F.sum("k").alias("tot"))
        near = links.join(state.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("w"))
        own = state.select("id", "k", F.col("c").alias("old"))
        options = near.unionByName(state.select("id", "c", F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w"))
        scored = options.join(own, "id").join(total, "c")
        rest = F.col("tot") - F.when(F.col("c") == F.col("old"), F.col("k")).otherwise(0.0)
        scored = scored.withColumn("gain", F.round(F.col("w") - F.col("k") * rest / two_m, 9))
        best = scored.groupBy("id", "k", "old").agg(F.max_by("c", F.struct("gain", -F.col("c"))).alias("to"), F.max("gain").alias("most"), F.max(F.when(F.col("c") == F.col("old"), F.col("gain"))).alias("stay"))
        may = (F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0) & (F.col("most") > F.col("stay"))
        new = cut(best.select("id", "k", F.when(may, F.col("to")).otherwise(F.col("old")).alias("c"), may.alias("m")))
        still = still + 1 if new.where("m").isEmpty() else 0
        state = new.drop("m")
        if still == 2:
            break
    return state.select("id", F.col("c").alias("cluster"))


def louvain(nodes: DataFrame, edges: DataFrame, least: int = 3, levels: int = 4, rounds: int = 12) -> DataFrame:
    """(id, cluster) of (id: whole numbers) and (src, dst, weight): Louvain's two phases, then ``size_filter``.

    Every level moves nodes by rounds of joins, and contracts communities to nodes.  Nodes without edges are alone.
    """
    level = cut(_weighted(edges))
    place = cut(nodes.select("id", F.col("id").alias("cluster")))
    for _ in range(levels):
        step = cut(_moved(level, rounds))
        place = cut(place.join(step.select(F.col("id").alias("cluster"), F.col("cluster").alias("_to")), "cluster", "left").select("id", F.coalesce("_to", "cluster").alias("cluster")))
        c = lambda end, step=step: step.select(F.col("id").alias(end), F.col("cluster").alias(f"c{end}"))
        joined = level.join(c("a"), "a").join(c("b"), "b")
        new = joined.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w")
        new = cut(new.groupBy("a", "b").agg(F.sum("w").alias("w")))
        if step.where("id <> cluster").isEmpty():
            break
        level = new
    return size_filter(place, least)


def spectral(nodes: DataFrame, edges: DataFrame, clusters: int = 10) -> DataFrame:
    """(id, cluster) by power iteration on the normalised affinities, where reciprocal edges count twice.

    Fewer nodes than clusters give a third as many clusters as nodes, two at least.  Nodes without edges form cluster 0.
    """
    from pyspark.ml.clustering import PowerIterationClustering

    n = nodes.count()
    k = clusters if n >= clusters else max(2, n // 3)
    w = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)).alias("weight"))
    if w.isEmpty():
        return nodes.select("id", F.lit(0).cast("long").alias("cluster"))
    found = PowerIterationClustering(k=k, maxIter=20, weightCol="weight").assignClusters(cut(w))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce(F.col("cluster").cast("long"), F.lit(0)).alias("cluster"))


def ensemble(louvain_clusters: DataFrame, spectral_clusters: DataFrame, offset_ids: bool = False) -> DataFrame:
    """(id, cluster): the Louvain label, or for noise the raw spectral one; ``offset_ids`` keeps the two apart."""
    both = louvain_clusters.join(spectral_clusters.withColumnRenamed("cluster", "_s"), "id", "left")
    other = F.col("_s")
    if offset_ids:
        top = louvain_clusters.agg(F.coalesce(F.max("cluster") + 1, F.lit(0)).alias("_top"))
        both, other = both.join(F.broadcast(top)), F.col("_s") + F.col("_top")  # one row
    return both.select("id", F.when(F.col("cluster") >= 0, F.col("cluster")).otherwise(F.coalesce(other, F.lit(-1))).alias("cluster"))


def cluster(nodes: DataFrame, edges: DataFrame, method: str = "community", least: int = 3) -> DataFrame:
    """By name of the method: ``spectral``, ``ensemble``, or Louvain for any other."""
    if method == "spectral":
        return spectral(nodes, edges)
    if method == "ensemble":
        return ensemble(louvain(nodes, edges, least), spectral(nodes, edges, 8))
    return louvain(nodes, edges, least)
