"""Tables behind charts and pages: trees, networks, samples of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview
from .graph import cut


def tree_view(tree: DataFrame) -> DataFrame:
    """A tree's nodes as a page shows them: the summary's first 200 signs, five entities at most."""
    return tree.select("id", "parent", F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("kind", F.lit("unknown")).alias("kind"), "level", F.coalesce("size", F.lit(0)).alias("entity_count"), preview(F.coalesce("summary", F.lit(""))).alias("summary"), F.slice(F.coalesce("key_entities", F.array().cast("array<string>")), 1, 5).alias("key_entities"))


def topic_network(topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and links of topics as ``build_topics`` gives them."""
    nodes = topics.select(F.col("topic_id").alias("id"), F.col("topic_name").alias("name"), "score", "entity_count", F.slice("keywords", 1, 5).alias("keywords"), preview(F.col("description"), 150, always=True).alias("description"))
    links = topics.select(F.col("topic_id").alias("source"), F.explode("related_topics").alias("r")).select("source", F.col("r.topic_id").alias("target"), "r.similarity")
    return nodes, links


def graph_view(nodes: DataFrame, edges: DataFrame, most_nodes: int = 100, most_edges: int = 200) -> tuple[DataFrame, DataFrame]:
    """The first nodes (id, ord, ...) and the first edges (src, dst, ord, ...) with both ends among them; the limits are the feature."""
    n = nodes.orderBy("ord").limit(most_nodes)
    ids = F.broadcast(n.select("id"))  # at most ``most_nodes`` rows
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return n, e.orderBy("ord").limit(most_edges)


def of_type(nodes: DataFrame, edges: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of a type, and the edges with an end among them."""
    n = nodes.where(F.col("type") == kind)
    src = edges.join(n.select(F.col("id").alias("src")), "src", "left_semi")
    dst = edges.join(n.select(F.col("id").alias("dst")), "dst", "left_semi")
    return n, src.unionByName(dst.select(src.columns)).distinct()


def neighbour_sample(nodes: DataFrame, edges: DataFrame, seeds: int = 15, grown: int = 10, each: int = 3, most: int = 50) -> DataFrame:
    """(id): the most important nodes, the first neighbours either way of the first of them, ``most`` in all.

    Seeds come first, then neighbours by their own importance and id.  ``nodes`` has (id, importance), ``edges`` (src, dst, ord).
    """
    top = nodes.orderBy(F.desc("importance"), "id").limit(seeds).withColumn("r", F.row_number().over(Window.orderBy(F.desc("importance"), "id")))
    few = F.broadcast(top.where(F.col("r") <= grown).select("id"))  # at most ``grown`` rows
    ways = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(0).alias("way"), "ord").unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(1).alias("way"), "ord"))
    near = ways.join(few, "id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("id", "way").orderBy("ord"))).where(F.col("n") <= each).select(F.col("other").alias("id")).distinct()
    both = top.select("id", F.lit(0).alias("k")).unionByName(near.withColumn("k", F.lit(1))).groupBy("id").agg(F.min("k").alias("k"))
    return both.join(nodes.select("id", "importance"), "id").orderBy("k", F.desc("importance"), "id").limit(most).select("id")


def sunburst(tree: DataFrame) -> DataFrame:
    """(id, value): a node's own size and its children's values; a level's sum goes up to the next, so shared rows count twice."""
    sizes = cut(tree.select("id", "parent", "level", F.coalesce("size", F.lit(1)).cast("long").alias("value")))
    done = None
    for level in sorted(r["level"] for r in sizes.select("level").distinct().collect()):  # one row a level
        here = sizes.where(F.col("level") == level)
        if done is not None:
            below = done.groupBy(F.col("parent").alias("id")).agg(F.sum("value").alias("b"))
            here = here.join(below, "id", "left").select("id", "parent", "level", (F.col("value") + F.coalesce("b", F.lit(0))).alias("value"))
        done = here if done is None else cut(done.unionByName(here))
    return (sizes if done is None else done).select("id", "value")


def relation_shares(edges: DataFrame, first: int = 10) -> DataFrame:
    """(relation, n): the commonest relations, the first by name of equals."""
    return edges.groupBy(F.coalesce("relation", F.lit("related_to")).alias("relation")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation").limit(first)


def qa_markdown(answers: DataFrame, entities: int = 8, relations: int = 8) -> DataFrame:
    """(query, line) of (query, asked, entities, relationships): a page's part for each question; names are cut at 30 signs."""
    some = lambda c, k: F.array_join(F.transform(F.slice(c, 1, k), lambda x: F.concat(F.lit("- "), F.substring(x, 1, 30))), "\n")
    return answers.select("query", F.concat(F.lit("### "), "asked", F.lit("\n\n"), some(F.col("entities"), entities), F.lit("\n\n"), some(F.col("relationships"), relations)).alias("line"))
