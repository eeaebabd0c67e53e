"""Property graphs as DataFrames: nodes(id, ...) and edges(src, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .triangles import COLOUR, triangles

#: Most nodes of a graph whose triangles are counted on bits.
BITS = 32 * COLOUR
GENERIC = ("related_to", "semantically_related")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, so that loops keep a short lineage and survive lost executors.

    The folder is ``spark.checkpoint.dir``; where that is unset, one beside the warehouse's tables.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/docuweave-shared")
    return df.checkpoint()


def first_per_key(rows: DataFrame, key: list, order: str) -> DataFrame:
    """The first row of each key, by partial aggregation instead of a window."""
    cols = [c for c in rows.columns if c != order]
    keyed = rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min_by(F.struct(*rows.columns), order).alias("_r"))
    return keyed.select(*[F.col(f"_r.{c}").alias(c) for c in cols], F.col(f"_r.{order}").alias(order))


def merge_nodes(mentions: DataFrame) -> DataFrame:
    """(name, canonical, type, doc, ord) to one node each: first type, mentions, documents (a bag), aliases.

    With the columns ``description`` and ``confidence`` also the description of the highest confidence, the first of equals.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "doc"))), lambda x: x["doc"])
    more = []
    if "description" in mentions.columns:
        sure = F.coalesce("confidence", F.lit(0.0)) if "confidence" in mentions.columns else F.lit(0.0)
        more = [F.max_by("description", F.struct(sure, -F.col("ord"))).alias("description")]
    return mentions.groupBy(F.col("canonical").alias("id")).agg(
        F.min_by("type", "ord").alias("type"),
        F.count(F.lit(1)).alias("mentions"),
        ordered.alias("documents"),
        F.array_sort(F.collect_set("name")).alias("aliases"),
        *more,
    )


def merge_edges(relations: DataFrame) -> DataFrame:
    """(src, dst, relation, doc, confidence, ord) to one edge each; self-loops stay.

    ``relations`` are distinct, in the order of their first mention; ``sources`` are the documents of all
    mentions in order.  Relations are reduced to one row each before any list is made.
    """
    per = relations.groupBy("src", "dst", "relation").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.collect_list(F.struct("ord", "doc")).alias("docs"))
    in_order = lambda c, field: F.transform(F.array_sort(c), lambda x: x[field])
    return per.groupBy("src", "dst").agg(
        in_order(F.collect_list(F.struct("ord", "relation")), "relation").alias("relations"),
        F.sum("n").alias("mentions"),
        in_order(F.flatten(F.collect_list("docs")), "doc").alias("sources"),
        F.max("confidence").alias("confidence"),
    )


def keep_known(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.count(F.lit(1)).alias("total_degree"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("num_nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("num_edges"))
    both = n.join(F.broadcast(m))  # one row each
    return both.select("num_nodes", "num_edges", F.when(F.col("num_nodes") > 1, F.col("num_edges") / (F.col("num_nodes") * (F.col("num_nodes") - 1))).otherwise(0.0).alias("density"), F.coalesce(F.try_divide(2.0 * F.col("num_edges"), F.col("num_nodes")), F.lit(0.0)).alias("avg_degree"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    u = undirected(edges).where("src <> dst")
    return u.unionByName(u.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """Power iteration with uniform dangling mass until the L1 change is below nodes * tolerance; all rounds if that is None.

    If ``rounds`` do not reach the tolerance, that is an error.  Edges to ids that are no nodes are left out,
    so that no mass is lost; no nodes give no rows.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    links = cut(keep_known(edges.select("src", "dst").distinct(), nodes))
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    base = cut(nodes.select("id").join(out.withColumnRenamed("src", "id"), "id", "left"))
    rank = base.select("id", "deg", F.lit(1.0 / n).alias("pagerank"))
    for k in range(rounds):
        dangling = rank.where("deg is null").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("d")).first()["d"]
        flow = links.join(rank.select(F.col("id").alias("src"), (F.col("pagerank") / F.col("deg")).alias("f")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("f").alias("f"))
        old = rank
        rank = base.join(flow, "id", "left").select("id", "deg", (F.lit((1 - damping) / n + damping * dangling / n) + damping * F.coalesce("f", F.lit(0.0))).alias("pagerank"))
        if tolerance is None:
            rank = cut(rank) if k % 3 == 2 or k == rounds - 1 else rank
            continue
        rank = cut(rank)
        change = rank.join(old.select("id", F.col("pagerank").alias("_old")), "id").agg(F.coalesce(F.sum(F.abs(F.col("pagerank") - F.col("_old"))), F.lit(0.0)).alias("c")).first()["c"]
        if change < n * tolerance:
            break
    else:
        if tolerance is not None:
            raise RuntimeError(f"PageRank did not reach its tolerance in {rounds} rounds")
    return rank.select("id", "pagerank")


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of a node's neighbour pairs that are linked.

    Up to ``BITS`` nodes with whole numbers as ids, triangles are counted on bits, whose work and shuffle grow with the
    edges and not with the pairs of neighbours; in larger graphs, which have to be sparse, by joins.
    """
    n = nodes.count()
    whole = all(dict(edges.dtypes)[c] in ("tinyint", "smallint", "int", "bigint") for c in ("src", "dst"))
    per = triangles(edges, max(1, -(-n // COLOUR))) if whole and n <= BITS else _triangles_joined(edges)
    out = nodes.select("id").join(per, "id", "left")
    return out.select("id", F.when(F.col("k") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))


def _triangles_joined(edges: DataFrame) -> DataFrame:
    """(id, k, t) from paths of two edges that are oriented by degree."""
    two = cut(both_ways(edges))
    deg = two.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    d = lambda c: deg.select(F.col("id").alias(c), F.col("k").alias(f"k_{c}"))
    up = two.join(d("src"), "src").join(d("dst"), "dst").where((F.col("k_src") < F.col("k_dst")) | ((F.col("k_src") == F.col("k_dst")) & (F.col("src") < F.col("dst")))).select("src", "dst")
    up = cut(up)
    a, b = up.select(F.col("src").alias("x"), F.col("dst").alias("y")), up.select(F.col("src").alias("x"), F.col("dst").alias("z"))
    tri = a.join(b, "x").where("y <> z").join(up.select(F.col("src").alias("y"), F.col("dst").alias("z")), ["y", "z"])
    per = tri.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    return deg.join(per, "id", "left")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Least reachable id, by label propagation with a jump over the label's own label."""
    two = cut(both_ways(edges))
    label = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = two.join(label.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        new = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("j"))
        new = cut(new.join(jump, "component").select("id", F.col("j").alias("component")))
        if new.join(label.withColumnRenamed("component", "old"), "id").where("component <> old").isEmpty():
            return new
        label = new


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(id, hop): the least number of steps from a seed, along and against edges."""
    two = cut(both_ways(edges))
    seen = seeds.select("id", F.lit(0).alias("hop"))
    front = seen
    for h in range(1, hops + 1):
        step = two.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(front)
    return seen


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0..1 by a one-row aggregate; a constant column gives 0.5."""
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(ends))  # one row
    return out.select(*[c for c in df.columns if c not in columns], *[F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.5)).alias(c) for c in columns])


def relation_types(edges: DataFrame, types: DataFrame, strict_reference: bool = True) -> DataFrame:
    """Type generic relations by the types and names of their ends: ordered rules, first that fits.

    A missing ``relation`` is generic; if not ``strict_reference``, the first of ``relations`` stands in for it.
    """
    # The rules' words and verbs.
    s, t = F.lower("src_type"), F.lower("dst_type")
    has = lambda c, *words: F.greatest(*[c.contains(w).cast("int") for w in words], F.lit(0)) == 1
    model = has(s, "model", "architecture")
    sn, tn = F.lower(F.col("src").cast("string")), F.lower(F.col("dst").cast("string"))
    family = has(sn, "transformer", "vit", "bert", "gpt")
    rule = (
        F.when(model & has(t, "dataset"), "trained_on")
        .when(model & has(t, "method", "technique"), "uses")
        .when(model & has(t, "task"), "applied_to")
        .when(has(t, "dataset"), "evaluated_on")
        .when(has(t, "architecture") & has(sn, "extends", "based"), "extends")
        .when(has(t, "architecture"), "uses")
        .when(has(t, "person", "author"), "authored_by")
        .when(has(t, "component"), "part_of")
        .when(has(t, "method", "technique"), "uses")
        .when(family & has(tn, "attention", "encoder", "decoder"), "uses")
        .when(family & has(tn, "imagenet", "coco", "wikipedia"), "trained_on")
    )
    end = lambda c: types.select(F.col("id").alias(c), F.col("type").alias(f"{c}_type"))
    typed = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    first = F.lit(None) if strict_reference or "relations" not in edges.columns else F.get("relations", F.lit(0))
    was = F.coalesce("relation", first, F.lit("related_to"))
    typed = typed.withColumns({"src_type": F.coalesce("src_type", F.lit("")), "dst_type": F.coalesce("dst_type", F.lit(""))})
    return typed.withColumn("relation", F.when(was.isin(*GENERIC), F.coalesce(rule, was)).otherwise(was)).select(*edges.columns)


def fill_confidence(edges: DataFrame) -> DataFrame:
    """Where confidence is missing: 0.3 for generic relations, 0.6 for inferred edges, else 0.8."""
    fill = F.when(F.coalesce("relation", F.lit("related_to")).isin(*GENERIC), 0.3).when(F.coalesce("inferred", F.lit(False)), 0.6).otherwise(0.8)
    return edges.withColumn("confidence", F.coalesce("confidence", fill))


def modularity(edges: DataFrame, clusters: DataFrame, noise: bool = True) -> DataFrame:
    """Newman's modularity of (src, dst, weight) under (id, cluster): one row.

    Reciprocal edges count once, with the weight of the one from the lower id.  Without ``noise`` nodes of
    cluster -1 and their edges are left out; with it they are one community.  No weight gives 0.
    """
    known = clusters if noise else clusters.where("cluster >= 0")
    c = lambda end: known.select(F.col("id").alias(end), F.col("cluster").alias(f"c_{end}"))
    once = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min_by(F.col("weight").cast("double"), F.col("src") > F.col("dst")).alias("weight"))
    e = once.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").join(c("src"), "src").join(c("dst"), "dst")
    m = e.agg(F.sum("weight").alias("m"))
    ends = e.select(F.explode(F.array(F.struct(F.col("c_src").alias("c"), F.when(F.col("c_src") == F.col("c_dst"), F.col("weight")).otherwise(0.0).alias("i")), F.struct(F.col("c_dst").alias("c"), F.lit(0.0).alias("i")))).alias("x"), "weight")
    per = ends.groupBy("x.c").agg(F.sum("x.i").alias("i"), F.sum("weight").alias("d"))
    rows = per.join(F.broadcast(m))  # one row
    term = F.try_divide(F.col("i"), F.col("m")) - F.pow(F.try_divide(F.col("d"), 2 * F.col("m")), F.lit(2.0))
    return rows.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("modularity"))


def capped_edges(pairs: DataFrame, existing: DataFrame, quota: int = 5) -> DataFrame:
    """Greedy choice of (i, j, sim), best first, with at most ``quota`` edges a node.

    The rounds accept each pair that is within the remaining quota of both its ends; this gives
    the sequential result under the order (sim desc, i, j).
    """
    known = existing.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct()
    alive = cut(pairs.join(known, ["i", "j"], "left_anti").select("i", "j", "sim"))
    left, taken = None, None
    while not alive.isEmpty():
        ends = alive.select(F.explode(F.array("i", "j")).alias("id"), "i", "j", "sim")
        ranked = ends.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "i", "j")))
        ranked = ranked.join(left, "id", "left").withColumn("q", F.coalesce("q", F.lit(quota))) if left is not None else ranked.withColumn("q", F.lit(quota))
        now = cut(ranked.where("r <= q").groupBy("i", "j", "sim").agg(F.count(F.lit(1)).alias("k")).where("k = 2").drop("k"))
        taken = now if taken is None else cut(taken.unionByName(now))
        used = taken.select(F.explode(F.array("i", "j")).alias("id")).groupBy("id").agg((F.lit(quota) - F.count(F.lit(1))).alias("q"))
        left = cut(used)
        full = left.where("q <= 0").select("id")
        alive = alive.join(now, ["i", "j"], "left_anti")
        for end in ("i", "j"):
            alive = alive.join(full.withColumnRenamed("id", end), end, "left_anti")
        alive = cut(alive.select("i", "j", "sim"))
    return pairs.limit(0).select("i", "j", "sim") if taken is None else taken
