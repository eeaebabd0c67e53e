"""Sharding by balanced label propagation.

A document's label is its shard.  In each round every linked document counts its neighbours'
shards, proposes to move to the commonest one if that saves a cut edge, and a shard accepts
proposals, best first, up to its quota, until no document proposes to move.  The rounds are joins and aggregations of small rows
(keys and labels, never texts).  At the end excess documents, unlinked ones first, move from
over-full shards to those with room, so that counts differ by one at most.

Links are given through hubs: a row (key, hub) says that a document belongs to a hub, and two
documents are neighbours if they share one.  A hub with a third of all documents is counted by
partial aggregation into at most ``shards`` rows, and no pair is ever listed.

Defined results: null texts count as empty; empty texts are equal texts; repeated rows are
separate documents with links between them; null ids are dealt out like others; an empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, ranked, text_key, written

SHARDS = 24


def propagate(nodes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` and ``_linked`` to (key, tie, hub, ...), a written table.

    ``key`` is unique, ``tie`` is a hash of the document that orders and places it, and a null
    ``hub`` has no links.  Linked documents never exceed a shard's quota of rows / shards.
    """
    rows = nodes.count()
    quota = max(1, math.ceil(rows / shards))
    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("tie"), F.lit(shards)).cast("int"))
    sizes = written(placed.where("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    # Hubs with a thousandth of all rows are at most a thousand: what belongs to them is joined by broadcast.
    limit = max(1000, rows // 1000)
    hot = F.broadcast(sizes.where(F.col("_n") >= limit).select("hub", F.lit(True).alias("_hot")))
    marked = placed.join(hot, "hub", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    shared = sizes.where(F.col("_n") < limit).select("hub", F.lit(True).alias("_shared"))
    cool = marked.where("not _hot").join(shared, "hub", "left")
    known = written(cool.unionByName(marked.where("_hot").withColumn("_shared", F.lit(True))))
    linked = known.where("_shared").drop("_shared")
    alone = known.where("_shared is null").select(*placed.columns).withColumn("_linked", F.lit(0))
    # Rows only go from a hub's smaller shards to one as large or larger, and each asked shard has room, so
    # every round raises the sum of squares of the hubs' counts: the loop ends.
    while True:
        held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = {s: max(0, quota - held.get(s, 0)) for s in range(shards)}
        counts = linked.groupBy("hub", "shard", "_hot").agg(F.count(F.lit(1)).alias("_c"))
        open_to = counts.where(F.col("shard").isin([s for s in room if room[s]]))
        best = open_to.groupBy("hub").agg(F.max_by("shard", F.struct("_c", -F.col("shard"))).alias("_to"), F.max("_c").alias("_most"))
        gains = counts.join(best, "hub").where((F.col("_to") != F.col("shard")) & (F.col("_most") >= F.col("_c")))
        gains = written(gains.select("hub", "shard", "_hot", "_to", (F.col("_c") - F.col("_most")).alias("_order")))
        moves = written(hot_join(linked, gains, ["hub", "shard"], "_hot").select("key", "tie", "_to", "_order"))
        asked = moves.count()
        if not asked:
            break
        limit_of = _by_shard("_to", room)
        accepted = ranked(moves.withColumn("_order", F.greatest("_order", F.lit(-16))), ["_to"], ["tie", "key"], "_rank", asked, ("_order",)).where(F.col("_rank") < limit_of)
        moved = linked.join(accepted.select("key", "_to"), "key", "left").withColumn("shard", F.coalesce("_to", "shard"))
        linked = written(moved.select(*placed.columns, "_hot"))
    return alone.unionByName(linked.select(*placed.columns).withColumn("_linked", F.lit(1)))


def _by_shard(column: str, values: dict[int, int]) -> Column:
    out = F.lit(0)
    for shard, value in values.items():
        out = F.when(F.col(column) == shard, F.lit(value)).otherwise(out)
    return out


def balance(placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Move each shard's excess, unlinked documents first, until counts differ by one at most.

    ``placed`` is a written table with ``key``, ``tie``, ``shard`` and ``_linked``.  Adds
    ``slot``, gapless from 0 in the new shard.
    """
    sizes = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(sizes.values())
    base, more = divmod(rows, shards)
    # The fullest shards get the odd documents, so that fewer move.
    fullest = sorted(range(shards), key=lambda s: (-sizes.get(s, 0), s))
    target = {s: base + (i < more) for i, s in enumerate(fullest)}
    # Linked documents have a shard's first ranks, so what lies beyond the target is unlinked if it can be.
    first = placed.withColumn("_last", -F.col("_linked"))
    inside = written(ranked(first, ["shard"], ["tie", "key"], "slot", rows, ("_last",)))
    beyond = F.col("slot") >= _by_shard("shard", target)
    gone = written(inside.where(beyond).withColumn("_all", F.lit(0)))
    turns = ranked(gone, ["_all"], ["tie", "key"], "_turn", gone.count())
    to, slot, at = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        lack = max(0, target[s] - sizes.get(s, 0))
        if lack:
            here = (F.col("_turn") >= at) & (F.col("_turn") < at + lack)
            to, slot = F.when(here, F.lit(s)).otherwise(to), F.when(here, F.col("_turn") - at + sizes.get(s, 0)).otherwise(slot)
            at += lack
    moved = turns.withColumns({"shard": to, "slot": slot}).select(*inside.columns)
    return inside.where(~beyond).unionByName(moved).drop("_last")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard all rows of (doc_id, text) under the law ``rows``; equal texts are linked."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.struct(*text_key(F.col("text"))).alias("hub"),
    )
    nodes = written(flat.withColumns({"key": F.monotonically_increasing_id(), "tie": F.xxhash64("doc_id", "hub")}))
    final = balance(written(propagate(nodes, shards)), shards)
    return final.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
