"""Connected components: forests of the edges that a task has, then rounds of joins between tasks.

Edges go to one task for each ``CHUNK`` of them, which replaces every ``CHUNK`` by a forest: one edge from each node to
the least node that it reaches there.  With one task the forest is the answer.  With more, alternating
large-star and small-star rounds of joins follow.  In them a node with very many neighbours (one in ``SHARE`` of all edges or more; so
there are at most 2 ``SHARE`` such nodes) is joined by broadcast, so that its edges stay where they
are; all other nodes are joined by shuffle.

Defined results: null ends and self-loops make no edge; repeated and reversed edges count once; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import ship, sweep, written

ship(__name__)

#: Edges (16 bytes each) that a task holds at once.
CHUNK = 500_000
ROUNDS = 40
SHARE, LEAST = 1000, 1000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the roots, and the least node that it reaches by the edges (a, b)."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    low = np.arange(len(names))
    while True:
        pu, pv = low[u], low[v]
        m = np.minimum(pu, pv)
        new = low.copy()
        np.minimum.at(new, pu, m)
        np.minimum.at(new, pv, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    rest = np.flatnonzero(low != np.arange(len(low)))
    return names[rest], names[low[rest]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    size = 0
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        size += batch.num_rows
        if size > CHUNK:
            yield out()
            size = 0
    if held:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root) for every node that has an edge; the root is the least node reached.

    Each round halves distances or better, and is written to the shared folder.  Neighbourhoods
    are reduced by partial aggregation and joined, never gathered.
    """
    edges = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    tasks = -(-edges.count() // CHUNK)
    if tasks <= 1:
        return _named(edges.repartition(1).mapInArrow(_forests, "a long, b long"))
    stars, mark = _round(edges.repartition(tasks).mapInArrow(_forests, "a long, b long"))
    for _ in range(ROUNDS):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = written(_with_least(both, 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct())
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, mark[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars, new = _round(small.unionByName(lower.select("a", F.col("m").alias("b"))))
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("connected components did not settle")
    sweep(edges.sparkSession)
    return _named(stars)


def _named(stars: DataFrame) -> DataFrame:
    """Every node of the edges (node, least node) with its root."""
    both = stars.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))).alias("r"))
    return both.groupBy("r.node").agg(F.min("r.root").alias("root"))


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges, higher end first, written; with their number and a hash of them all, taken in passing.

    The hash is an exclusive or, which cannot overflow.
    """
    seen = Observation()
    out = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    out = written(out.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")))
    return out, (seen.get["n"] or 0, seen.get["h"])


def _with_least(rows: DataFrame, n: int) -> DataFrame:
    """(a, b, m): m is the least b of an a.  ``n`` is the number of rows, or more."""
    per = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_d"))
    limit = max(LEAST, n // SHARE)
    if n <= limit:
        return rows.join(per.drop("_d"), "a")
    hot = per.where(F.col("_d") >= limit).select("a", F.col("m").alias("_hot"))  # at most SHARE rows
    known = rows.join(F.broadcast(hot), "a", "left")
    cold = known.where("_hot is null").drop("_hot").join(per.where(F.col("_d") < limit).drop("_d"), "a")
    return known.where("_hot is not null").withColumnRenamed("_hot", "m").unionByName(cold)
