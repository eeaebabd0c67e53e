"""The corpus pipeline: documents in, packed training pieces out, one written stage after the other.

Each stage takes all that the one before kept.  The first four return the columns of
``documents`` and drop rows: texts predicted bad, toxic texts, all but one of each group of near
copies, and texts with passages of the benchmark.  The last packs what is left.  Classifiers
learn from the labelled rows among the documents that reach them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuweave.llm import jaccard, latent, packing, quality, toxicity
from docuweave.llm.common import table, tune, written
from docuweave.llm.queries import GOOD


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(F.col("text"), model) >= GOOD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.chain_column(F.col("text"), model)[model["names"][-1]] < model["threshold"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    hits = "__docuweave_hits"
    return latent.with_hits(docs, table(spark, sf_dir, "benchmark"), hits).where(F.size(hits) == 0).drop(hits)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_lengths),
]

#: No stage but the near copies can be said in SQL, so the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
