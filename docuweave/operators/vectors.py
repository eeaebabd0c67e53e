"""Exact similarity search and joins on dense vectors, block by block."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Functions go to executors by value, so these need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 8000
#: Cosines that a task holds at a time.
PRODUCTS = 4_000_000


def _matrix(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(i, j, sim), i < j, of all rows of (id, vector) with a cosine of at least ``least``: exact.

    Rows go to blocks of about ``BLOCK``; each pair of blocks meets in one task, whose products come
    ``PRODUCTS`` at a time, and only pairs over the threshold leave it.
    """
    n = vectors.count()
    k = max(1, -(-n // min(BLOCK, max(500, -(-n // 6)))))  # small tables in some blocks too, for all cores
    dealt = vectors.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int").alias("b"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumns({"x": F.least("b", "o"), "y": F.greatest("b", "o")})

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = (k.as_py() for k in key)
        rows = pa.Table.from_batches(list(batches)).select(["id", "vector", "b"]).to_pandas()
        a, b = rows[rows.b == x], rows[rows.b == y]
        if not len(a) or not len(b):
            return
        left, right, own, other = _matrix(a.vector), _matrix(b.vector).T, a.id.to_numpy(), b.id.to_numpy()
        some = max(1, PRODUCTS // len(b))
        for at in range(0, len(a), some):
            sims = left[at : at + some] @ right
            p, q = np.nonzero(sims >= least)
            i, j = own[at + p].astype(np.int64), other[q].astype(np.int64)
            keep = i < j if x == y else i != j
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)[keep]), pa.array(np.maximum(i, j)[keep]), pa.array(sims[p, q][keep])], names=["i", "j", "sim"])

    return dealt.groupBy("x", "y").applyInArrow(compare, "i long, j long, sim double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, floor: float = 0.3, block: int = 500) -> DataFrame:
    """(query, id, sim, rank): the k best of all vectors for each query, then those over ``floor``.

    Queries pass in blocks, each against one scan; a batch keeps its own k best, so what is
    shuffled is k rows a query and batch.  Equal similarities go to the higher id first.
    """
    out = None
    rows = queries.select("id", "vector").orderBy("id").collect()
    for at in range(0, max(1, len(rows)), block):
        ids = np.array([r["id"] for r in rows[at : at + block]], np.int64)
        matrix = _matrix(pd.Series([r["vector"] for r in rows[at : at + block]])) if len(ids) else np.zeros((0, 1))

        def best(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, matrix: np.ndarray = matrix) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                sims, own = matrix @ _matrix(batch.vector).T, batch.id.to_numpy()
                for q, row in zip(ids, sims, strict=True):
                    top = np.lexsort((-own, -row))[:k]
                    yield pd.DataFrame({"query": q, "id": own[top], "sim": row[top]})

        part = vectors.select("id", "vector").mapInPandas(best, "query long, id long, sim double")
        out = part if out is None else out.unionByName(part)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), F.desc("id")))
    return out.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("sim") > floor))
