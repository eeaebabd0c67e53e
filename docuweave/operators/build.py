"""From mentions and relations to one graph: per-document dedupe, entity resolution, the global graph."""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_relation
from .graph import cut, keep_known, merge_edges, merge_nodes

# Functions go to executors by value, so these need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most subsequences that are listed for a short name.
VARIANTS = 500


def dedupe_entities(mentions: DataFrame) -> DataFrame:
    """(doc, name, ord, ...): the first of each document's mentions whose names differ in case alone."""
    rest = [c for c in mentions.columns if c != "doc"]
    keyed = mentions.groupBy("doc", F.lower("name").alias("_k")).agg(F.min_by(F.struct(*rest), "ord").alias("_r"))
    return keyed.select("doc", "_r.*")


def dedupe_relations(relations: DataFrame) -> DataFrame:
    """(doc, subject, predicate, object, confidence, ord): the most sure of each, the first of equals, at the first one's place.

    Ends are compared without case, predicates as they are; a missing confidence is 0.
    """
    sure = F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("ord"))
    keyed = relations.groupBy("doc", F.lower("subject").alias("_s"), "predicate", F.lower("object").alias("_o"))
    best = keyed.agg(F.max_by(F.struct("subject", "object", "confidence"), sure).alias("_r"), F.min("ord").alias("ord"))
    return best.select("doc", "_r.subject", "predicate", "_r.object", "_r.confidence", "ord")


def topic_labels(chunks: DataFrame, most: int = 15) -> DataFrame:
    """(doc, topics, num_topics) of (doc, topics) by chunk: each document's first distinct labels in their order by name."""
    out = chunks.select("doc", F.explode("topics").alias("t")).groupBy("doc").agg(F.slice(F.array_sort(F.collect_set("t")), 1, most).alias("topics"))
    return out.withColumn("num_topics", F.size("topics").cast("long"))


def canonical_names(mentions: DataFrame, leaders: DataFrame) -> DataFrame:
    """(name, canonical) of (id, name) and (id, leader): the leader's name; of a repeated name its last occurrence counts."""
    names = mentions.select(F.col("id").alias("leader"), F.col("name").alias("canonical"))
    named = mentions.select("id", "name").join(leaders, "id").join(names, "leader")
    return named.groupBy("name").agg(F.max_by("canonical", "id").alias("canonical"))


def build_graph(mentions: DataFrame, relations: DataFrame, canonical: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all documents' mentions (name, type, doc, ord, ...) and relations (subject, predicate, object, doc, confidence, ord).

    ``canonical`` maps names; a name that is not in it stands for itself.  Relations whose ends are no nodes are dropped.
    """
    names = canonical if canonical is not None else mentions.select("name", F.col("name").alias("canonical")).distinct()
    nodes = merge_nodes(mentions.join(names, "name", "left").withColumn("canonical", F.coalesce("canonical", "name")))
    end = lambda c, to: names.select(F.col("name").alias(c), F.col("canonical").alias(to))
    ends = relations.join(end("subject", "_s"), "subject", "left").join(end("object", "_o"), "object", "left")
    rows = ends.select(F.coalesce("_s", "subject").alias("src"), F.coalesce("_o", "object").alias("dst"), normalize_relation(F.col("predicate")).alias("relation"), "doc", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "ord")
    return nodes, merge_edges(keep_known(rows, nodes))


def _lcs(a: str, b: str) -> int:
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & place.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """0 to 100: twice the longest common subsequence by both lengths, rounded; 100 for two empty texts."""

    @F.pandas_udf("int")
    def ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([round(200 * _lcs(p, q) / (len(p) + len(q))) if p or q else 100 for p, q in zip(x, y, strict=True)], dtype="int32")

    return ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def _cuts(length: int, threshold: int) -> int:
    """How many signs a name of this length may lack from a common subsequence that reaches the threshold with any other name."""
    c = (threshold - 0.5) / 200
    return int(length * (1 - c / (1 - c)) + 1e-9)


def short_length(threshold: int) -> int:
    """The longest names whose subsequences are listed, all of them up to ``VARIANTS``."""
    n = 0
    while n < 64 and sum(math.comb(n + 1, k) for k in range(_cuts(n + 1, threshold) + 1)) <= VARIANTS:
        n += 1
    return n


def variants(name: Column, threshold: int) -> Column:
    """A short name's subsequences that are long enough to reach the threshold, itself included."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series([list({"".join(v) for k in range(_cuts(len(t), threshold) + 1) for v in itertools.combinations(t, len(t) - k)}) for t in x])

    return run(name)


def resolve_fuzzy(names: DataFrame, existing: DataFrame, threshold: int = 85) -> DataFrame:
    """(name, canonical, ratio) of (name, type) against (name, type, ord): the best ratio of a type, the first of equals.

    Short names meet where they share a subsequence that is long enough for the threshold, and the longest of these gives the
    ratio, so that no other pairs are made.  Pairs with a long name are those of a type whose lengths allow the threshold.
    """
    lower = F.lower("name")
    e = cut(existing.select(F.col("name").alias("canonical"), "type", "ord", lower.alias("c")).where("c is not null"))
    n = cut(names.select("name", "type").distinct())
    own = n.select("name", "type", lower.alias("n")).where("n is not null")
    short = short_length(threshold)
    both = F.length("n") + F.length("c")
    fits = lambda common: 200 * common >= (threshold - 0.5) * both
    v = lambda df, c: df.where(F.length(c) <= short).withColumn("v", F.explode(variants(F.col(c), threshold)))
    shared = v(own, "n").join(v(e, "c"), ["type", "v"]).where(fits(F.length("v")))
    ratio = F.when(both == 0, 100).otherwise(F.bround(200.0 * F.length("v") / both)).cast("int")
    near = shared.select("name", "type", "canonical", "ord", ratio.alias("ratio"))
    kept = ["name", "type", "canonical", "ord"]
    ends = (threshold - 0.5) / (200.5 - threshold)  # the least share that one name's length has of the other's
    either = [(own.where(F.length("n") > short), e), (own.where(F.length("n") <= short), e.where(F.length("c") > short))]
    for x, y in either:
        # By each length that fits, so that a type's names meet in many tasks.
        by = y.withColumn("l", F.explode(F.sequence(F.floor(F.length("c") * ends).cast("int"), F.ceil(F.length("c") / ends).cast("int"))))
        pairs = x.withColumn("l", F.length("n")).join(by, ["type", "l"]).where(fits(F.least(F.length("n"), F.length("c"))))
        near = near.unionByName(pairs.select(*kept, fuzzy_ratio(F.col("n"), F.col("c")).alias("ratio")))
    best = near.where(F.col("ratio") >= threshold).groupBy("name", "type").agg(F.max_by(F.struct("canonical", "ratio"), F.struct("ratio", -F.col("ord"))).alias("b"))
    return n.join(best, ["name", "type"], "left").select("name", F.coalesce("b.canonical", "name").alias("canonical"), "b.ratio")
