"""The registered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, jaccard, latent, matroska, packing, quality, sharding, styletree, toxicity, urls
from .common import crc, table, tune

#: From this score a text is predicted good.
GOOD = 0.3


def held_out() -> Column:
    """Whether a row may not teach: the CRC-32 of its id is divisible by 5; a row without id teaches nothing and is not held out."""
    return F.coalesce(F.pmod(crc("doc_id"), F.lit(5)) == 0, F.lit(False)).alias("held_out")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    scored = quality.with_quality(docs.select("doc_id", "text"), quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return styletree.extract_pages(table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return jaccard.link_counts(table(spark, sf_dir, "documents"))


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    out = backoff.backoff_scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("score", 6).alias("score"), "n_pairs")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return latent.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return matroska.media_digests(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), model, "chain")
    last = F.col("chain")[model["names"][-1]]
    links = F.array(*[F.col("chain")[n] for n in model["names"][:-1]]).cast("array<double>")
    return scored.select("doc_id", held_out(), last.alias("score"), (last >= model["threshold"]).cast("int").alias("predicted"), links.alias("categories"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_html_extraction, op3_url_filter, op4_jaccard_join, op4_jaccard_links, op5_length_buckets, op6_backoff_scores, op7_decontamination, op8_matroska, op9_sharding, op10_toxicity)}
