"""Packing into length buckets that waste the least padding.

Texts are measured in tokens, long ones are cut into pieces of at most ``max_len`` tokens, and
the global histogram of piece lengths (at most ``max_len`` rows) goes to the driver.  Dynamic
programming chooses the ``buckets`` upper bounds for which the sum of (bound - length) over all
pieces is least.  Inside a bucket, pieces form batches of floor(budget / bound) sequences.

Defined results: null and empty texts have 0 tokens and make no piece to train on, but they keep
one piece of length 0 in the first bucket, and no row is lost; repeated rows are packed each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, written

MAX_LEN = 2048
BUCKETS = 12
BUDGET = 65_536


def token_count(text: Column) -> Column:
    """Runs of signs between ASCII white space: a measure that needs no vocabulary file."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The at most ``buckets`` upper bounds, ascending, for which the padding is least."""
    lengths = sorted(histogram)
    if not lengths:
        return []
    n, c = len(lengths), np.array([histogram[x] for x in lengths], dtype=np.float64)
    x = np.array(lengths, dtype=np.float64)
    count, total = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(c * x)]
    k = min(buckets, n)
    # cost[i] after j buckets: least padding of the first i lengths
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    choice = np.zeros((k, n + 1), dtype=np.int64)
    for j in range(k):
        new = np.full(n + 1, np.inf)
        for i in range(1, n + 1):
            pad = x[i - 1] * (count[i] - count[:i]) - (total[i] - total[:i])
            options = cost[:i] + pad
            choice[j, i] = int(np.argmin(options))
            new[i] = options[choice[j, i]]
        cost = new
    bounds, i = [], n
    for j in range(k - 1, -1, -1):
        if i == 0:
            break
        bounds.append(lengths[i - 1])
        i = int(choice[j, i])
    return sorted(set(bounds))


def pieces(docs: DataFrame, tokens: Column, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, piece, n_tokens): documents longer than ``max_len`` make several pieces, none is dropped."""
    n = F.greatest(tokens, F.lit(0))
    flat = docs.select("doc_id", n.alias("_n"))
    flat = flat.withColumn("_last", F.greatest(F.ceil(F.col("_n") / max_len).cast("int") - 1, F.lit(0)))
    out = flat.select("doc_id", "_n", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("piece"))
    return out.select("doc_id", "piece", F.least(F.col("_n") - F.col("piece").cast("long") * max_len, F.lit(max_len)).cast("long").alias("n_tokens"))


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, tokens: Column | None = None) -> DataFrame:
    """One row for each piece of (doc_id, text): doc_id, piece, n_tokens, bucket, bucket_len, batch, slot.

    ``bucket`` counts from 0; ``batch`` counts from 0 inside a bucket and ``slot`` inside a batch.
    Within a bucket pieces are dealt in the order of a hash, so a batch mixes sources.
    """
    flat = written(pieces(docs, token_count(F.col("text")) if tokens is None else tokens, max_len))
    histogram = {r["n_tokens"]: r["n"] for r in flat.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = boundaries(histogram, buckets)
    bucket, bound = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, b in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(i)).otherwise(bucket)
        bound = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bound)
    dealt = flat.withColumns({"bucket": bucket, "bucket_len": bound, "_order": F.xxhash64("doc_id", "piece")})
    out = ranked(dealt, ["bucket"], ["_order", "doc_id", "piece"], "_rank", sum(histogram.values()))
    per = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1)).cast("long")
    return out.select("doc_id", "piece", "n_tokens", "bucket", "bucket_len", F.floor(F.col("_rank") / per).cast("long").alias("batch"), (F.col("_rank") % per).cast("long").alias("slot"))
