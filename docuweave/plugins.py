"""The engine's plug-in points, with defaults that need no network and always give the same.

A plug-in is a function on columns or rows that a caller passes in place of the default:

* an embedder turns a text column into a vector column;
* an extractor turns a text column into the struct ``EXTRACTED``;
* a summariser turns names into a text column;
* a classifier and a relation typer turn their question into a reply column, which
  :mod:`docuweave.functions.text` parses.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import topic_description, type_lines
from .operators.graph import GENERIC, relation_types

# Functions go to executors by value, so these need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXTRACTED = "struct<entities: array<struct<name: string, type: string, description: string, confidence: double>>, relationships: array<struct<subject: string, predicate: string, object: string, confidence: double>>, topics: array<string>>"
_WORD = re.compile(r"[^\W_]+")
NAME = r"[A-Z][A-Za-z0-9-]+(?: [A-Z][A-Za-z0-9-]+)*"
#: The relation types that a typer may answer with.
TYPES = ("trained_on", "evaluated_on", "uses", "extends", "part_of", "applied_to", "improves", "based_on", "authored_by", "related_to")


def parsed(reply: Column) -> Column:
    """A stored or received JSON reply as ``EXTRACTED``; what is no JSON gives empty lists."""
    got = F.from_json(reply, EXTRACTED, {"mode": "PERMISSIVE"})
    kinds = {"entities": "array<struct<name: string, type: string, description: string, confidence: double>>", "relationships": "array<struct<subject: string, predicate: string, object: string, confidence: double>>", "topics": "array<string>"}
    return F.struct(*[F.coalesce(got[k], F.array().cast(t)).alias(k) for k, t in kinds.items()])


def rule_extractor(text: Column) -> Column:
    """Capitalised names as concepts, neighbours among them as relations, no topics."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NAME), F.lit(0))
    entities = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("concept").alias("type"), F.lit("").alias("description"), F.lit(0.5).alias("confidence")))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(names) - 2, F.lit(0))), lambda i: i < F.size(names) - 1)
    links = F.transform(at, lambda i: F.struct(F.get(names, i).alias("subject"), F.lit("related_to").alias("predicate"), F.get(names, i + 1).alias("object"), F.lit(0.5).alias("confidence")))
    return F.struct(entities.alias("entities"), links.alias("relationships"), F.array().cast("array<string>").alias("topics"))


def hash_embedder(text: Column, size: int = 384) -> Column:
    """Words and runs of three signs, counted by hash into ``size`` numbers, of length one; null and empty texts are all zeros.

    Texts pass by in Arrow batches; the places of a word are found once.
    """

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = {}
        for part in parts:
            rows = []
            for t in part:
                places: list[int] = []
                for w in _WORD.findall((t or "").lower()):
                    if w not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[w] = [xxhash.xxh64_intdigest(g.encode("utf-8", "replace"), seed=42) % size for g in (w, *("#" + w[i : i + 3] for i in range(len(w) - 2)))]
                    places += known[w]
                counts = np.bincount(np.array(places, np.int64), minlength=size).astype(float)
                rows.append(counts / (np.sqrt((counts * counts).sum()) or 1.0))
            yield pd.Series(rows)

    return embed(text)


def template_summary(names: Column) -> Column:
    return topic_description(names)


def typed_by_reply(edges: DataFrame, replies: DataFrame, batch: int = 15) -> DataFrame:
    """Apply lines ``type|confidence`` to the generic edges in the order of ``ord``, ``batch`` to a reply; more lines or edges are left.

    ``replies`` has (batch, reply) with batches from 0.  An unknown type changes nothing; a reply that is null, which
    stands for a failure, gives confidence 0.3.  Numbers of edges come from ``ord``, which counts generic edges from 0.
    """
    asked = edges.where(F.coalesce("relation", F.lit("related_to")).isin(*GENERIC)).withColumns({"batch": F.floor(F.col("ord") / batch).cast("long"), "pos": F.pmod("ord", F.lit(batch)).cast("int")})
    lines = replies.where("reply is not null").select(F.col("batch").cast("long").alias("batch"), F.posexplode(type_lines(F.col("reply"))).alias("pos", "t")).select("batch", "pos", F.col("t.type").alias("_type"), F.col("t.confidence").alias("_sure"))
    failed = replies.where("reply is null").select(F.col("batch").cast("long").alias("batch"), F.lit(True).alias("_failed"))
    got = asked.join(lines, ["batch", "pos"], "left").join(failed, "batch", "left")
    right = F.col("_type").isin(*TYPES)
    return got.select("src", "dst", "ord", F.when(right, F.col("_type")).otherwise(F.col("relation")).alias("relation"), F.when(right, F.col("_sure")).when(F.col("_failed"), 0.3).otherwise(F.col("confidence")).alias("confidence"))


def rule_typer(edges: DataFrame, types: DataFrame) -> DataFrame:
    return relation_types(edges, types)


def valid_key(key: str | None, placeholder: str = "your-api-key") -> bool:
    """Whether a key for a remote plug-in was set to something of its own."""
    return bool(key and key.strip() and key.strip() != placeholder)
