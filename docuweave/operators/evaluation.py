"""Measures of clusters, trees and retrieval."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import RATINGS, cosine, rating

# Functions go to executors by value, so these need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 2000


def prf(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query, precision, recall, f1) from two tables of (query, id); zeros where either is empty."""
    a = retrieved.select("query", "id").distinct().withColumn("got", F.lit(1))
    b = relevant.select("query", "id").distinct().withColumn("want", F.lit(1))
    sums = a.join(b, ["query", "id"], "full").groupBy("query").agg(F.count("got").alias("got"), F.count("want").alias("want"), F.sum((F.col("got") + F.col("want")) / 2).alias("both"))
    over = lambda c: F.coalesce(F.try_divide(F.coalesce("both", F.lit(0.0)), F.col(c)), F.lit(0.0))
    out = sums.select("query", over("got").alias("precision"), over("want").alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def silhouettes(points: DataFrame) -> DataFrame:
    """(id, cluster, silhouette) of (id, vector, cluster), Euclidean and exact; noise (-1) left out.

    Pairs of blocks are matrix products; a block pair gives a sum for each point and cluster, and
    these are added up.  A point alone in its cluster, or without other clusters, has 0.
    """
    own = points.where("cluster >= 0").select("id", "vector", F.col("cluster").cast("long").alias("cluster"))
    k = max(1, -(-own.count() // BLOCK))
    dealt = own.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int"))
    left = dealt.withColumns({"x": F.col("b"), "y": F.explode(F.sequence(F.lit(0), F.lit(k - 1))), "side": F.lit(0)})
    right = dealt.withColumns({"y": F.col("b"), "x": F.explode(F.sequence(F.lit(0), F.lit(k - 1))), "side": F.lit(1)})

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows.side == 0], rows[rows.side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "cluster": [], "other": [], "d": [], "n": []})
        p, q = (np.array(t.vector.tolist(), np.float64) for t in (a, b))
        dist = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T, 0))
        dist[a.id.to_numpy()[:, None] == b.id.to_numpy()[None, :]] = 0
        names, at = np.unique(b.cluster.to_numpy(), return_inverse=True)
        hot = np.eye(len(names))[at]
        d = dist @ hot
        return pd.DataFrame({"id": np.repeat(a.id.to_numpy(), len(names)), "cluster": np.repeat(a.cluster.to_numpy(), len(names)), "other": np.tile(names, len(a)), "d": d.ravel(), "n": np.tile(hot.sum(0).astype(np.int64), len(a))})

    far = left.unionByName(right).groupBy("x", "y").applyInPandas(sums, "id long, cluster long, other long, d double, n long")
    far = far.groupBy("id", "cluster", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    same = F.col("cluster") == F.col("other")
    per = far.groupBy("id", "cluster").agg(F.max(F.when(same & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("d") / F.col("n"))).alias("b"))
    return per.select("id", "cluster", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def tree_quality(tree: DataFrame) -> DataFrame:
    """One row: mean similarity of parents and children, mean children, and the topic-subtopic measure 1 - |cos - 0.65|."""
    up = tree.select(F.col("id").alias("parent"), F.col("vector").alias("pv"))
    both = tree.join(up, "parent").select("parent", cosine(F.col("vector"), F.col("pv")).alias("sim"))
    per = both.groupBy("parent").agg(F.count(F.lit(1)).alias("kids"), F.sum("sim").alias("s"), F.sum(1 - F.abs(F.col("sim") - 0.65)).alias("t"))
    return per.agg((F.sum("s") / F.sum("kids")).alias("parent_child"), F.avg("kids").alias("branching"), (F.sum("t") / F.sum("kids")).alias("topic_subtopic"))


def mean_similarity(groups: DataFrame, least: int = 2) -> DataFrame:
    """(key, n, sim) of (key, vector): the mean cosine of a group's pairs, in closed form, of groups of ``least`` rows or more.

    With unit vectors the sum over all pairs is the squared length of their sum, so this is linear in the
    rows.  A zero vector has similarity 0 with all, also with itself.
    """
    length = F.sqrt(F.aggregate(F.transform("vector", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    unit = groups.select("key", F.transform("vector", lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0))).alias("u"))
    n = unit.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    dims = unit.select("key", F.posexplode("u").alias("d", "x")).groupBy("key", "d").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("own"))
    sums = dims.groupBy("key").agg(F.sum(F.col("x") * F.col("x")).alias("s"), F.sum("own").alias("own"))
    return n.where(F.col("n") >= least).join(sums, "key").select("key", "n", ((F.col("s") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("sim"))


def topic_coherence(members: DataFrame, first: int | None = 10) -> DataFrame:
    """(topic, coherence) of (topic, rank, vector): the mean similarity of a topic's ``first`` entities, two at least."""
    few = members if first is None else members.where(F.col("rank") <= first)
    return mean_similarity(few.select(F.col("topic").alias("key"), "vector")).select(F.col("key").alias("topic"), F.col("sim").alias("coherence"))


def coherence_report(coherence: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: mean, least and most coherence of topics, mean and population deviation of their sizes."""
    a = coherence.agg(*[F.coalesce(f("coherence"), F.lit(0.0)).alias(f"{n}_coherence") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])
    b = sizes.agg(F.count(F.lit(1)).alias("num_topics"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_size"), F.coalesce(F.stddev_pop("size"), F.lit(0.0)).alias("std_size"))
    return a.join(F.broadcast(b))  # one row each


def reached_parents(tree: DataFrame) -> DataFrame:
    """The ids of nodes with two children or more that the root reaches through such nodes alone.

    ``tree`` has (id, level, parent); the walk goes level by level, so it has as many rounds as the tree has levels.
    """
    from .graph import cut

    wide = cut(tree.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id"))
    front = cut(tree.where("parent is null").select("id").join(wide, "id", "left_semi"))
    out = front
    while not front.isEmpty():
        below = tree.join(front.select(F.col("id").alias("parent")), "parent", "left_semi").select("id")
        front = cut(below.join(wide, "id", "left_semi"))
        out = out.unionByName(front)
    return out


def branch_scores(tree: DataFrame) -> DataFrame:
    """(id, parent_child, child_child) of the nodes in ``reached_parents``: mean similarity of children with the parent, and among them."""
    asked = reached_parents(tree)
    kids = tree.select(F.col("parent").alias("key"), "vector").join(asked.select(F.col("id").alias("key")), "key", "left_semi")
    up = tree.select(F.col("id").alias("key"), F.col("vector").alias("pv"))
    pc = kids.join(up, "key").groupBy("key").agg(F.avg(cosine(F.col("vector"), F.col("pv"))).alias("parent_child"))
    return pc.join(mean_similarity(kids), "key").select(F.col("key").alias("id"), "parent_child", F.col("sim").alias("child_child"))


def parent_child_quality(tree: DataFrame) -> DataFrame:
    rows = branch_scores(tree).select((F.col("parent_child") - 0.3 * F.col("child_child")).alias("q"))
    return rows.agg(F.coalesce(F.avg("q"), F.lit(0.0)).alias("avg_parent_child_quality"), F.count(F.lit(1)).alias("num_evaluated_nodes"))


def branch_quality(tree: DataFrame) -> DataFrame:
    rows = branch_scores(tree).select((0.7 * F.col("parent_child") + 0.3 * (1 - F.col("child_child"))).alias("q"))
    return rows.agg(F.coalesce(F.avg("q"), F.lit(0.0)).alias("avg_branch_quality"), F.count(F.lit(1)).alias("num_branches"))


def level_diversity(tree: DataFrame) -> DataFrame:
    """(level, diversity): one less the mean similarity of a level's nodes, two at least; their mean is the tree's."""
    return mean_similarity(tree.select(F.col("level").alias("key"), "vector")).select(F.col("key").alias("level"), (1 - F.col("sim")).alias("diversity"))


def structure(tree: DataFrame) -> DataFrame:
    """One row: levels, nodes, leaves, and mean children over nodes that have any."""
    kids = tree.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.avg("k"), F.lit(0.0)).alias("branching_factor"))
    figures = tree.agg(F.count_distinct("level").alias("total_levels"), F.count(F.lit(1)).alias("total_nodes"), F.count(F.when(F.col("level") == 0, 1)).alias("leaf_count"))
    return figures.join(F.broadcast(kids))  # one row


def level_sizes(tree: DataFrame) -> DataFrame:
    return tree.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"))


def wins(metrics: DataFrame) -> DataFrame:
    """(metric, flat, hierarchical, higher) with the winner: flat if there is no opponent, the tree in a tie."""
    better = F.when(F.col("higher"), F.col("flat") > F.col("hierarchical")).otherwise(F.col("flat") < F.col("hierarchical"))
    return metrics.withColumn("winner", F.when(F.col("hierarchical").isNull() | better, "flat").otherwise("hierarchical"))


def tally(won: DataFrame) -> DataFrame:
    sums = won.agg(F.count(F.when(F.col("winner") == "flat", 1)).alias("flat_wins"), F.count(F.when(F.col("winner") == "hierarchical", 1)).alias("hierarchical_wins"))
    return sums.withColumn("overall_winner", F.when(F.col("flat_wins") > F.col("hierarchical_wins"), "flat").when(F.col("hierarchical_wins") > F.col("flat_wins"), "hierarchical").otherwise("tie"))


def confidence_stats(edges: DataFrame) -> DataFrame:
    """One row: edges, those with a confidence, and the mean where a missing one is 0."""
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.count("confidence").alias("with_confidence"), F.coalesce(F.avg(F.coalesce("confidence", F.lit(0.0))), F.lit(0.0)).alias("avg_confidence"))


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two tables (metric, value)."""
    a, b = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    return a.join(b, "metric", "full").withColumn("delta", F.col("after") - F.col("before"))


def rated(metrics: DataFrame) -> DataFrame:
    """(metric, value, rating) for the measures that have ratings; others get none."""
    out = F.lit(None).cast("string")
    for name, (high, good) in RATINGS.items():
        out = F.when(F.col("metric") == name, rating(F.col("value"), high, good)).otherwise(out)
    return metrics.select("metric", "value", out.alias("rating"))


def gauge(metrics: DataFrame) -> DataFrame:
    """One row: the mean of modularity, silhouette plus a half, coherence and coverage."""
    value = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    return metrics.agg(((value("modularity") + value("silhouette_score") + 0.5 + value("topic_coherence") + value("coverage")) / 4).alias("overall"))


def full_evaluation(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(metric, value, rating): the suite over nodes, (src, dst, relation, confidence, weight), (id, vector), (id, cluster) and (topic, rank, vector)."""
    from .graph import modularity, statistics

    rows = [
        modularity(edges, clusters, noise=False).select(F.lit("modularity").alias("metric"), F.col("modularity").alias("value")),
        silhouettes(vectors.join(clusters, "id")).agg(F.coalesce(F.avg("silhouette"), F.lit(0.0)).alias("value")).select(F.lit("silhouette_score").alias("metric"), "value"),
        topic_coherence(members).agg(F.coalesce(F.avg("coherence"), F.lit(0.0)).alias("value")).select(F.lit("topic_coherence").alias("metric"), "value"),
        clusters.agg(F.coalesce(F.avg((F.col("cluster") >= 0).cast("int")), F.lit(0.0)).alias("value")).select(F.lit("coverage").alias("metric"), "value"),
        edges.agg(F.count_distinct(F.coalesce("relation", F.lit("unknown"))).cast("double").alias("value")).select(F.lit("relation_types").alias("metric"), "value"),
        confidence_stats(edges).select(F.lit("avg_confidence").alias("metric"), F.col("avg_confidence").alias("value")),
    ]
    figures = statistics(nodes, edges)
    rows += [figures.select(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in (("graph_density", "density"), ("avg_degree", "avg_degree"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return rated(out)
