"""Readers and writers of graph files and of the JSON records that documents are extracted to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of the published files.
EXTRACTED = "filename string, filepath string, text string, text_length long, extraction_method string, timestamp string, metadata struct<title: string, author: string, subject: string, creator: string, producer: string, num_pages: int>"
_ENTITY = "name: string, type: string, description: string, confidence: double"
_RELATION = "subject: string, predicate: string, object: string, confidence: double"
STRUCTURED = f"source_file string, entities array<struct<{_ENTITY}>>, relationships array<struct<{_RELATION}>>, topics array<string>"
NODE = "id: string, type: string, documents: array<string>, mentions: long, aliases: array<string>, description: string, pagerank: double, centrality: double, importance: double, community: long"
LINK = "source: string, target: string, relation: string, relations: array<string>, mentions: long, sources: array<string>, confidence: double, weight: double, inferred: boolean"
GRAPH = f"nodes array<struct<{NODE}>>, edges array<struct<{LINK}>>"


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists in whatever store Spark can read."""
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_extracted(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted texts, one JSON file each; empty texts are skipped; doc is the file's stem."""
    rows = spark.read.schema(EXTRACTED).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("doc", F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1)).where(F.length("text") > 0)


def read_structured(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(STRUCTURED).option("multiLine", True).option("pathGlobFilter", "*_structured.json").json(folder)


def mentions(structured: DataFrame) -> DataFrame:
    """One row for each entity of each document, in order."""
    return structured.select(F.col("source_file").alias("doc"), F.posexplode("entities").alias("ord", "e")).select("doc", "ord", "e.*")


def relations(structured: DataFrame) -> DataFrame:
    return structured.select(F.col("source_file").alias("doc"), F.posexplode("relationships").alias("ord", "r")).select("doc", "ord", "r.*")


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph file.  A repeated node or edge overwrites: its last record stays."""
    graph = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    n = graph.select(F.posexplode("nodes").alias("ord", "n")).groupBy("n.id").agg(F.max_by("n", "ord").alias("n")).select("n.*")
    e = graph.select(F.posexplode("edges").alias("ord", "e")).groupBy("e.source", "e.target").agg(F.max_by("e", "ord").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.*").drop("source", "target")
    return n, e


def scalars(rows: DataFrame) -> DataFrame:
    """The columns that hold no lists."""
    return rows.select(*[c for c, t in rows.dtypes if not t.startswith("array")])


def with_relation(edges: DataFrame) -> DataFrame:
    """The relation to retrieve by: ``relation``, else the first of ``relations``, else related_to."""
    return edges.withColumn("relation", F.coalesce("relation", F.get("relations", F.lit(0)), F.lit("related_to")))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, attributes) and edges (src, dst, attributes); attributes are maps by attr.name."""
    data = "data array<struct<_VALUE: string, _key: string>>"
    keys = {r["_id"]: r["_attr.name"] for r in spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string").load(path).select("_id", "`_attr.name`").collect()}
    names = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv]) if keys else F.create_map().cast("map<string,string>")
    attrs = F.map_from_entries(F.transform(F.coalesce("data", F.array()), lambda d: F.struct(F.coalesce(names[d["_key"]], d["_key"]), d["_VALUE"]))).alias("attributes")
    n = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    e = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    return n.select(F.col("_id").alias("id"), attrs), e.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), attrs)


def flat(rows: DataFrame) -> DataFrame:
    """Lists joined by commas, as the formats without lists need them."""
    return rows.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])


def write_graph_json(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """JSON lines of nodes and of edges; each executor writes its own part."""
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.withColumnsRenamed({"src": "source", "dst": "target"}).write.mode("overwrite").json(f"{folder}/edges")


def write_edge_table(edges: DataFrame, folder: str) -> None:
    flat(edges).write.mode("overwrite").option("header", True).option("sep", "\t").csv(folder)


def _xml(value: Column) -> Column:
    out = F.coalesce(value.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): a GraphML document's body, a line for each element; parts sort header, nodes, edges, end."""
    n, e = flat(nodes), flat(edges)
    kinds = {"bigint": "long", "int": "long", "double": "double", "boolean": "boolean"}
    own = [("node", c, t) for c, t in n.dtypes if c != "id"] + [("edge", c, t) for c, t in e.dtypes if c not in ("src", "dst")]
    key = {(k, c): f"d{i}" for i, (k, c, _) in enumerate(own)}
    head = "<?xml version='1.0' encoding='utf-8'?>\n<graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\">" + "".join(f'\n<key id="{key[k, c]}" for="{k}" attr.name="{c}" attr.type="{kinds.get(t, "string")}"/>' for k, c, t in own) + '\n<graph edgedefault="directed">'
    cell = lambda k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{key[k, c]}">'), _xml(F.col(c)), F.lit("</data>"))).otherwise("")
    of = lambda kind: [cell(k, c) for k, c, _ in own if k == kind]
    a = n.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), *of("node"), F.lit("</node>")).alias("line"))
    b = e.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('">'), *of("edge"), F.lit("</edge>")).alias("line"))
    ends = nodes.sparkSession.createDataFrame([(0, head), (3, "</graph>\n</graphml>")], "part int, line string")
    return ends.unionByName(a).unionByName(b)


def write_graphml(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Text parts that make one GraphML document when put together in the order of their names."""
    graphml_lines(nodes, edges).repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.mode("overwrite").text(folder)


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, ord, line): a GML document; nodes get whole numbers by the order of their ids, and keep the id as label.

    Numbers come from a sort by ranges, so no task holds all nodes.
    """
    n = flat(nodes)
    numbered = n.select("id").distinct().orderBy("id").rdd.zipWithIndex().map(lambda r: (r[0][0], r[1])).toDF(f"id {dict(n.dtypes)['id']}, number long") if not n.isEmpty() else n.select("id", F.lit(0).cast("long").alias("number"))
    quote = lambda c: F.concat(F.lit('"'), _xml(c), F.lit('"'))
    numbers = ("bigint", "int", "double", "float", "boolean")

    def cells(df: DataFrame, skip: tuple) -> list[Column]:
        return [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"    {c.replace('_', '')} "), F.col(c).cast("string") if t in numbers[:4] else quote(F.col(c)), F.lit("\n"))).otherwise("") for c, t in df.dtypes if c not in skip]

    a = n.join(numbered, "id").select(F.lit(1).alias("part"), F.col("number").alias("ord"), F.concat(F.lit("  node [\n    id "), F.col("number").cast("string"), F.lit("\n    label "), quote(F.col("id")), F.lit("\n"), *cells(n, ("id",)), F.lit("  ]")).alias("line"))
    e = flat(edges)
    end = lambda c: numbered.select(F.col("id").alias(c), F.col("number").alias(f"n_{c}"))
    b = e.join(end("src"), "src").join(end("dst"), "dst").select(F.lit(2).alias("part"), F.col("n_src").alias("ord"), F.concat(F.lit("  edge [\n    source "), F.col("n_src").cast("string"), F.lit("\n    target "), F.col("n_dst").cast("string"), F.lit("\n"), *cells(e, ("src", "dst")), F.lit("  ]")).alias("line"))
    ends = nodes.sparkSession.createDataFrame([(0, 0, "graph [\n  directed 1"), (3, 0, "]")], "part int, ord long, line string")
    return ends.unionByName(a).unionByName(b)


def write_gml(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    gml_lines(nodes, edges).repartitionByRange("part", "ord", "line").sortWithinPartitions("part", "ord", "line").select("line").write.mode("overwrite").text(folder)


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, data) of lines ``src dst {..}``; names without blanks, since lines with more are ambiguous: their ends are null."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    ends = F.regexp_extract("value", r"^(\S+) (\S+)(?: (\{.*\}))?$", 1), F.regexp_extract("value", r"^(\S+) (\S+)(?: (\{.*\}))?$", 2)
    return rows.select(*[F.nullif(c, F.lit("")).alias(n) for n, c in zip(("src", "dst"), ends, strict=True)], F.nullif(F.regexp_extract("value", r"(\{.*\})$", 1), F.lit("")).alias("data"))


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(json): a whole graph with its statistics as one document, for graphs of a size that one row can hold; ``read_graph_json`` reads it.

    Larger graphs go by ``write_graph_json``.
    """
    from ..operators.graph import statistics

    a = nodes.agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.withColumnsRenamed({"src": "source", "dst": "target"})
    b = e.agg(F.array_sort(F.collect_list(F.struct(*e.columns))).alias("edges"))
    row = a.join(F.broadcast(b)).join(F.broadcast(statistics(nodes, edges)))  # one row each
    return row.select(F.to_json(F.struct("nodes", "edges", F.struct("num_nodes", "num_edges", "density").alias("statistics")), {"pretty": "true"}).alias("json"))


def write_report(rows: DataFrame, folder: str) -> None:
    """Any table as JSON lines: metrics, answers, model parts."""
    rows.write.mode("overwrite").json(folder)


def tree_document(tree: DataFrame) -> DataFrame:
    """(id, level, json): each node with its children's documents inside, five entities each; the top row holds the whole tree.

    Goes up level by level, so it has as many rounds as the tree has levels.
    """
    from ..operators.graph import cut

    own = cut(tree.select("id", "level", "parent", "ord", F.to_json(F.struct("id", "name", "kind", "level", "summary", F.col("size").alias("entity_count"), *([F.slice("key_entities", 1, 5).alias("key_entities")] if "key_entities" in tree.columns else []))).alias("head")))
    done = None
    for level in sorted(r["level"] for r in own.select("level").distinct().collect()):  # one row a level
        here = own.where(F.col("level") == level)
        if done is None:
            kids = here.select("id", F.lit(None).cast("string").alias("k"))
        else:
            kids = done.groupBy(F.col("parent").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "json"))), lambda x: x["json"]), ",").alias("k"))
        body = F.expr("substring(head, 1, length(head) - 1)")
        here = here.join(kids, "id", "left").select("id", "level", "parent", "ord", F.concat(body, F.lit(',"children":['), F.coalesce("k", F.lit("")), F.lit("]}")).alias("json"))
        done = cut(here) if done is None else cut(done.unionByName(here))
    return done.select("id", "level", "json")
