"""Folders of documents to text: a scan of binary files, two reading backends and the rule between them."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions go to executors by value, so these need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: From so many signs on the asked backend's text is taken.
ENOUGH = 100
UNKNOWN = "Unknown"
META = "struct<title: string, author: string, subject: string, creator: string, producer: string, num_pages: int>"

#: A backend reads a file's bytes into the texts of its pages; whatever it raises makes an empty text.
Backend = Callable[[bytes], list[str]]


def read_files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(path, filename, content) of the files of a folder, not of those below it, whose names end so, in that case."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def page_text(files: DataFrame, backend: Backend, out: str, keep_empty: bool = True) -> DataFrame:
    """Add a file's text and, as ``<out>_error``, what the backend raised.  Each page is followed by an empty line; without ``keep_empty`` empty pages give nothing."""

    @F.pandas_udf(f"{out} string, {out}_error string")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for data in part:
                try:
                    pages = backend(bytes(data))
                    rows.append(("".join(f"{p or ''}\n\n" for p in pages if keep_empty or p), None))
                except Exception as e:  # noqa: BLE001  one bad file must not end the scan
                    rows.append(("", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[out, f"{out}_error"])

    return files.withColumn("_read", read("content")).select(*files.columns, "_read.*")


def with_fallback(asked: Column, other: Column) -> Column:
    """The asked backend's text, or the other's, even a shorter one, where it has fewer than ``ENOUGH`` signs."""
    return F.when(F.length(F.coalesce(asked, F.lit(""))) < ENOUGH, F.coalesce(other, F.lit(""))).otherwise(asked)


def metadata(found: Column) -> Column:
    """A struct of the fields of ``META`` from a map of strings: missing ones are unknown, pages 0."""
    text = [F.coalesce(F.nullif(found[k], F.lit("")), F.lit(UNKNOWN)).alias(k) for k in ("title", "author", "subject", "creator", "producer")]
    return F.struct(*text, F.coalesce(found["num_pages"].try_cast("int"), F.lit(0)).alias("num_pages"))


def extract(files: DataFrame, layout: Backend, fast: Backend, method: str = "layout", describe: Callable[[bytes], dict[str, str]] | None = None) -> DataFrame:
    """One extracted document a file; ``extraction_method`` is the one that was asked for; files without text by either are left out."""
    from ..functions.text import clean_text

    both = page_text(page_text(files, layout, "layout", keep_empty=False), fast, "fast")
    order = ("layout", "fast") if method == "layout" else ("fast", "layout")

    @F.pandas_udf("map<string,string>")
    def facts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = []
            for data in part:
                try:
                    rows.append({k: str(v) for k, v in (describe(bytes(data)) if describe else {}).items()})
                except Exception:  # noqa: BLE001  all fields are unknown then
                    rows.append({})
            yield pd.Series(rows)

    text = clean_text(with_fallback(F.col(order[0]), F.col(order[1])))
    out = both.select("filename", F.col("path").alias("filepath"), text.alias("text"), metadata(facts("content")).alias("metadata"), F.lit(method).alias("extraction_method"))
    return out.where(F.length("text") > 0).withColumns({"text_length": F.length("text").cast("long"), "timestamp": F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")})


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Any JSON document or folder of them, by a given schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


TOPIC = "topic_id: string, topic_name: string, description: string, key_entities: array<struct<name: string, importance: double, centrality: double, role: string>>, score: double, entity_count: long, keywords: array<string>, related_topics: array<struct<topic_id: string, similarity: double>>, documents: array<string>"


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """The topics of a semantic model with their position; a model without topics gives no rows."""
    model = read_json(spark, path, f"semantic_topics array<struct<{TOPIC}>>")
    return model.select(F.posexplode(F.coalesce("semantic_topics", F.array().cast(f"array<struct<{TOPIC}>>"))).alias("topic_pos", "t")).select("topic_pos", "t.*")


def read_level_index(spark: SparkSession, path: str) -> DataFrame:
    """(level, pos, id, name, embedding) of a stored tree's index."""
    node = "array<struct<id: string, name: string, embedding: array<double>>>"
    tree = read_json(spark, path, f"hierarchical_tree struct<level_index: map<string, {node}>>")
    rows = tree.select(F.explode("hierarchical_tree.level_index").alias("level", "nodes"))
    return rows.select(F.col("level").cast("int").alias("level"), F.posexplode("nodes").alias("pos", "n")).select("level", "pos", "n.*")
