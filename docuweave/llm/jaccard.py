"""N-gram Jaccard join: exact links between documents whose sets of word shingles overlap.

A document's set has its distinct shingles of ``N`` words as 64-bit hashes.  Documents with
equal sets form a class, and classes are what is joined, so copies cost nothing.  Two steps find
the links that decide the components:

1. Min-hash keys bring likely partners together; of the least classes of its keys, each class is
   compared with that of most keys.  The links, checked exactly, give preliminary components.  Two more
   rounds do so for the components of a key. This is linear in the input whatever the size of a group of near copies, but may miss links.
2. An exact pass finds what is missing.  By the prefix principle two linked sets share one of
   the first n - ceil(0.75 n) + 1 shingles of any global order; here rare ones come first.
   Shingles that lead to a single preliminary component are done.  The others form lots (those
   with the same least class) and size-banded tiles: a tile is a lot and a band of set sizes (a
   factor of 4/3, which a link can't exceed), with the classes of that band and of the one below;
   tiles of more than ``TILE`` classes are cut into blocks that meet block by block.  In a tile,
   bitmaps of hashed shingles bound the overlap from above by bit counts, and pairs that pass,
   and that are not in one component yet, go to the exact intersection of the sorted arrays.

The order of shingles follows their frequency in a sixteenth of the texts; any order gives right
results.  Only the ``HEAVY`` most frequent shingles are broadcast (8 bytes each).

``jaccard_components`` and ``keep_one`` find the links that decide components, and no more.
``jaccard_links`` and ``link_counts`` leave out step 1 and verify every candidate of step 2: all links.

Defined results: null and empty texts, and texts of white space alone, have no set, link with
nothing, and are their own component; repeated rows are copies; a null doc_id takes part but is
never a component's id unless all its members' ids are null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import columns_of, ship, small, sweep, written
from .components import components

ship(__name__)

N = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 10, 3
#: Further rounds of step 1, between the components that it has found.
AGAIN = 2
#: Least and most bits of a bitmap; between them eight bits or more for each shingle.
BITS, WIDE = 1024, 1 << 17
TILE = 1024
HEAVY = 1 << 18
HEAVY_SHARE, HEAVY_COUNT = 16, 4
#: From this level on (a power of two of the count in the sample, plus one) a shingle is hot.
HOT = 8
MAX_BROADCAST = 2_000_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SEEDS = np.random.RandomState(20240229).randint(1, 1 << 62, size=BANDS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class WordHash(dict):
    """Hashes of words, remembered; emptied before it grows without end."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: WordHash, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; with fewer words, the whole sequence as one."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            h = h * _MIX[0] + w[i : len(words) - k + 1 + i]
            h ^= h >> np.uint64(29)
        return np.unique(_mixed(h))


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def min_keys(s: np.ndarray) -> np.ndarray:
    """``BANDS`` keys, each from ``ROWS`` min-hashes."""
    with np.errstate(over="ignore"):
        least = np.array([(_mixed(s) * a).min() for a in _SEEDS]) if len(s) > 4096 else (_mixed(s)[None, :] * _SEEDS[:, None]).min(axis=1)
        keys = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            keys = _mixed(keys * _MIX[0] + least.reshape(BANDS, ROWS)[:, r])
        return keys.view(np.int64)


def wide_bitmap(s: np.ndarray) -> bytes:
    """A bitmap of eight bits or more for each shingle, a power of two up to ``WIDE`` in all: halves fold onto each other."""
    m = min(WIDE, max(BITS, 1 << (8 * len(s) - 1).bit_length()))
    bits = np.zeros(m, np.uint8)
    bits[((s * _MIX[0]) & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A wide bitmap as uint64 words, folded to ``size`` bytes."""
    x = np.frombuffer(bits, np.uint64)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def prefix(s: np.ndarray, heavy: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first shingles in the global order: a linked set shares one of them."""
    n = len(s)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
        common = np.where(heavy[at] == s, level[at], 0)
        if common.any():
            s = s[np.argsort(common, kind="stable")]
    return s[: n - -(-PERCENT * n // 100) + 1]


def bound_passes(na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether bit counts allow a link; rows of a and b (uint64 words) broadcast against each other.

    Each bit that only one bitmap has shows a shingle that only that set has, so the overlap is
    at most the set's size less those bits.
    """
    over = np.minimum(na - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))
    return over * (100 + PERCENT) >= PERCENT * (na + nb)


def _sketches(docs: DataFrame, heavy: np.ndarray, level: np.ndarray) -> DataFrame:
    """One row for each document: rkey, doc_id, n, cls, keys, wide, prefix."""
    both = docs.sparkSession.sparkContext.broadcast((heavy, level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        h, lv = both.value
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                s = shingles(t.as_py(), known)
                if len(s):
                    rows.append((len(s), class_of(s), min_keys(s), wide_bitmap(s), prefix(s, h, lv).view(np.int64)))
                else:
                    rows.append((0, None, None, None, None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("rkey"), batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.list_(pa.int64()))],
                names=["rkey", "doc_id", "n", "cls", "keys", "wide", "prefix"],
            )

    return docs.mapInArrow(run, "rkey long, doc_id long, n long, cls long, keys array<long>, wide binary, prefix array<long>")


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sixteenth of the distinct texts, with a level that rises with the count."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(HEAVY_SHARE)) == 0).select("text", F.xxhash64("text").alias("h")).dropDuplicates(["h"]).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            parts = [shingles(t.as_py(), known) for t in batch.column(0)]
            s, n = np.unique(np.concatenate(parts or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], names=["s", "n"])

    counts = some.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_COUNT)
    s, n = columns_of(counts.orderBy(F.desc("n"), "s").limit(HEAVY), {"s": "int64", "n": "float64"})
    s = s.view(np.uint64)
    order = np.argsort(s)
    return s[order], np.log2(n[order]).astype(np.int8) + 1


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, shingles) of the rows whose rkey is wanted; only those rows' texts leave the scan."""
    if small(wanted, MAX_BROADCAST):
        wanted = F.broadcast(wanted)
    texts = docs.select("rkey", "text").join(wanted, "rkey", "left_semi").dropDuplicates(["rkey"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            parts = [shingles(t.as_py(), known) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in parts], pa.int64()), pa.array([s.tobytes() for s in parts], pa.binary())], names=["cls", "shingles"])

    return texts.mapInArrow(run, "cls long, shingles binary")


@F.pandas_udf(BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(p, q, assume_unique=True))
        out.append(100 * both >= PERCENT * (len(p) + len(q) - both))
    return pd.Series(out, dtype=bool)


@F.pandas_udf(BooleanType())
def _may_link(na: pd.Series, a: pd.Series, nb: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for n, x, m, y in zip(na, a, nb, b, strict=True):
        size = min(len(x), len(y))
        out.append(bool(bound_passes(np.int64(n), folded(x, size), np.int64(m), folded(y, size))))
    return pd.Series(out, dtype=bool)


def _sized(na: Column, nb: Column) -> Column:
    return F.lit(100) * F.least(na, nb) >= F.lit(PERCENT) * F.greatest(na, nb)


def _verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked, by the exact intersection of their sets."""
    info = heads.select("cls", "rkey")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(info, "cls").select("rkey")
    sets = written(_sets(docs, wanted), few=True)
    x = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(x, "a").join(y, "b").where(_linked("sa", "sb")).select("a", "b").distinct()


def _likely(heads: DataFrame) -> DataFrame:
    """Step 1: (a, b), each class b with one least class of a key: that of most of its keys, if a link is possible."""
    keyed = heads.select("cls", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("cls").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    met = keyed.join(least, "key").where("cls <> a").groupBy("a", F.col("cls").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    best = met.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a")).select("a", "b")
    return _pass_bound(best, heads)


def _between(placed: DataFrame) -> DataFrame:
    """Step 1 again: the least class of each component in a key with the key's least class."""
    keyed = placed.select("cls", "comp", F.explode("keys").alias("key"))
    parts = keyed.groupBy("key", "comp").agg(F.min("cls").alias("b"))
    least = parts.groupBy("key").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return _pass_bound(parts.join(least, "key").where("a <> b").select("a", "b").distinct(), placed)


def _pass_bound(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    x = heads.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("wide").alias("ba"))
    y = heads.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("bb"))
    near = pairs.join(x, "a").join(y, "b").where(_sized(F.col("na"), F.col("nb")))
    return near.where(_may_link("na", "ba", "nb", "bb")).select("a", "b")


def _undecided(heads: DataFrame, partitions: int, hot: np.ndarray) -> DataFrame:
    """(lot, cls, comp, n) of the classes whose prefix shingles lead to two components or more.

    Shingles whose least class is the same share a lot, since they nearly always come from the
    same passage: its classes are compared once and not once for each shingle.  Shingles meet in
    a task by their hash, but the ``hot`` ones, which very many texts have, are counted by partial
    aggregation instead and never gathered; they are at most ``HEAVY``, and so are broadcast.
    """
    rows = heads.select("cls", "comp", "n", F.explode("prefix").alias("token")).select("token", "cls", "comp", "n")
    often = None
    if len(hot):
        tokens = F.broadcast(heads.sparkSession.createDataFrame(pa.table({"token": hot.view(np.int64)})))
        often = rows.join(tokens, "token", "left_semi")
        mixed = often.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("cls").alias("lot")).where("c1 <> c2").select("token", "lot")
        often = often.join(F.broadcast(mixed), "token").select("lot", "cls", "comp", "n")
        rows = rows.join(tokens, "token", "left_anti").select("token", "cls", "comp", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if not parts:
            return
        token, cls, comp, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(token, kind="stable")
        t, c = token[order], comp[order]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        lengths = np.diff(np.r_[starts, len(t)])
        mixed = np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts)
        keep = order[np.repeat(mixed, lengths)]
        lot = np.repeat(np.minimum.reduceat(cls[order], starts)[mixed], lengths[mixed])
        by = np.lexsort((cls[keep], lot))
        lot, keep = lot[by], keep[by]
        once = np.ones(len(keep), bool)
        once[1:] = (lot[1:] != lot[:-1]) | (cls[keep][1:] != cls[keep][:-1])
        lot, keep = lot[once], keep[once]
        for i in range(0, len(keep), 50_000):
            k = keep[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(lot[i : i + 50_000]), pa.array(cls[k]), pa.array(comp[k]), pa.array(n[k])], names=["lot", "cls", "comp", "n"])

    found = rows.repartition(partitions, "token").mapInArrow(run, "lot long, cls long, comp long, n long")
    return (found if often is None else found.unionByName(often)).distinct()


def _tiles(rows: DataFrame, count: int) -> DataFrame:
    """Deal the undecided rows to tiles: (lot, band, i, j), with the row's own block and whether it is at home.

    ``count`` is the number of rows.  Lots with a thousandth of them or more are at most 2,000: they are joined by broadcast.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)) + F.lit(1e-9)).cast("int")
    dealt = rows.select("*", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home")))).alias("_b"))
    dealt = dealt.select("lot", "cls", "comp", "n", "_b.band", "_b.home")
    sizes = dealt.groupBy("lot", "band").agg(F.count(F.lit(1)).alias("k"), F.max("home").alias("any_home"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    limit = max(1000, count // 1000)
    blocks = sizes.where("any_home and c1 <> c2").select("lot", "band", F.ceil(F.col("k") / TILE).cast("int").alias("nb"))
    hot = F.broadcast(sizes.where(F.col("k") >= limit).select("lot", "band"))
    cold = dealt.join(hot, ["lot", "band"], "left_anti").join(blocks.where(F.col("nb") <= max(1, -(-limit // TILE))), ["lot", "band"])
    wide = sizes.where((F.col("k") >= limit) & F.expr("any_home and c1 <> c2")).select("lot", "band", F.ceil(F.col("k") / TILE).cast("int").alias("nb"))
    dealt = cold.unionByName(dealt.join(F.broadcast(wide), ["lot", "band"]))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("nb", "other")


def _compare(tiles: DataFrame, heads: DataFrame, partitions: int) -> DataFrame:
    """(a, b): the pairs of a tile whose sizes and bit counts allow a link and that no component joins yet.

    Rows come sorted by tile, and a worker holds one tile at a time: at most about 2 ``TILE`` bitmaps.
    """
    rows = tiles.join(heads.select("cls", "wide"), "cls").select("lot", "band", "i", "j", "block", "home", "cls", "comp", "n", "wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()

        def out() -> pa.RecordBatch:
            pairs = sorted(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        def tile(pieces: list[tuple[dict, list]]) -> Iterator[pa.RecordBatch]:
            col = {c: np.concatenate([p[0][c] for p in pieces]) for c in pieces[0][0]}
            maps = [m.as_py() for p in pieces for m in p[1]]
            if len(maps) < 2:
                return
            split = col["i"][0] != col["j"][0]
            left = np.flatnonzero(col["block"] == col["i"][0]) if split else np.arange(len(maps))
            right = np.flatnonzero(col["block"] == col["j"][0]) if split else np.arange(len(maps))
            size = min(map(len, maps))
            bits = np.stack([folded(m, size) for m in maps])
            cls, comp, n, home = (col[c] for c in ("cls", "comp", "n", "home"))
            for k in range(0, len(left), 128):
                x, y = left[k : k + 128][:, None], right[None, :]
                ok = (home[x] | home[y]) & (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]))
                p, q = np.nonzero(ok if split else ok & (x < y))
                p, q = left[k : k + 128][p], right[q]
                step = max(256, 8_000_000 // size)
                for u in range(0, len(p), step):
                    pu, qu = p[u : u + step], q[u : u + step]
                    good = bound_passes(n[pu], bits[pu], n[qu], bits[qu])
                    a, b = cls[pu[good]], cls[qu[good]]
                    found.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
                    if len(found) > 200_000:
                        yield out()

        held: list[tuple[dict, list]] = []
        now = None
        for batch in batches:
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "wide"}
            wide = batch.column("wide")
            keys = np.stack([col[c].astype(np.int64) for c in ("lot", "band", "i", "j")])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]) if batch.num_rows else []
            for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                key = tuple(keys[:, s])
                if key != now and held:
                    yield from tile(held)
                    held = []
                now = key
                held.append(({c: v[s:e] for c, v in col.items()}, wide.slice(s, e - s)))
        if held:
            yield from tile(held)
        if found:
            yield out()

    dealt = rows.repartition(partitions, "lot", "band", "i", "j").sortWithinPartitions("lot", "band", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _settled(extra: DataFrame, near: DataFrame, first: DataFrame, heads: DataFrame, docs: DataFrame) -> DataFrame:
    """The components (node, root), written, of all of ``near`` and of the linked pairs of ``extra``; ``first`` are those of ``near``.

    Groups of near copies that differ give many candidates between the same two components, and
    one link decides.  So one pair of each two components is verified first, ``AGAIN`` times; what
    then still lies between two components is verified whole.
    """
    links, roots, left = near, first, extra
    for k in range(AGAIN + 1):
        end = lambda c, roots=roots: roots.select(F.col("node").alias(c), F.col("root").alias(f"c{c}"))
        placed = left.join(end("a"), "a", "left").join(end("b"), "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
        apart = written(placed.where("ca <> cb"), few=True)
        if apart.isEmpty():
            break
        left = apart.select("a", "b")
        pick = left
        if k < AGAIN:
            two = apart.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"))
            pick = written(two.agg(F.min_by(F.struct("a", "b"), F.xxhash64("a", "b", F.lit(k))).alias("p")).select("p.a", "p.b"), few=True)
        links = written(links.unionByName(_verified(pick, heads, docs)), few=True)
        roots = written(components(links), few=True)
    return roots


def _candidates(placed: DataFrame, flat: DataFrame, heads: DataFrame, hot: np.ndarray) -> DataFrame:
    """(a, b), written: all pairs of classes of different ``comp`` that the prefixes, sizes and bit counts allow."""
    total = flat.agg(F.coalesce(F.sum(F.size(F.coalesce("prefix", F.array().cast("array<long>")))), F.lit(0)).alias("t")).first()["t"]
    undecided = written(_undecided(placed, max(12, int(total // 1_000_000)), hot), few=True)
    count = undecided.count()
    sweep(placed.sparkSession)
    return written(_compare(_tiles(undecided, count), heads, max(12, count // 20_000)), few=True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(doc_id, text)


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, np.ndarray]:
    """The rows with keys, their sketches, the classes (cls, first_doc, rkey, copies), one sketch of each class, and hot shingles."""
    docs = docs.select(row_key().alias("rkey"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    heavy, level = _frequent(docs)
    flat = written(_sketches(docs, heavy, level))
    known = flat.where("cls is not null")
    classes = written(known.groupBy("cls").agg(F.min("doc_id").alias("first_doc"), F.min("rkey").alias("rkey"), F.count(F.lit(1)).alias("copies")), few=True)
    copied = classes.where("copies > 1")
    # Of copies one row goes on: rows that are alone in their class need no look.
    spare = known.select("cls", "rkey").join(copied.select("cls", F.col("rkey").alias("head")), "cls").where("rkey <> head").select("rkey").distinct()
    spare = written(spare, few=True)
    if small(spare, MAX_BROADCAST):
        spare = F.broadcast(spare)
    heads = known.join(spare, "rkey", "left_anti")
    repeated = not known.groupBy("rkey").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()
    if repeated:  # the same row twice: its sketch would meet itself
        heads = written(heads.dropDuplicates(["cls"]))
    return docs, flat, classes, heads, heavy[level >= HOT]


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (rkey, doc_id, n, cls) and classes (cls, root, first_doc, rkey, copies); both written tables."""
    docs, flat, classes, heads, hot = _prepared(docs)
    near = written(_verified(written(_likely(heads), few=True), heads, docs), few=True)
    sweep(docs.sparkSession)
    for k in range(AGAIN + 1):
        first = written(components(near), few=True)
        spread = F.broadcast(first) if small(first, MAX_BROADCAST) else first
        placed = heads.join(spread.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("root", "cls"))
        if k < AGAIN:
            more = written(_verified(written(_between(placed), few=True), heads, docs), few=True)
            if more.isEmpty():
                break
            near = written(near.unionByName(more), few=True)
    extra = _candidates(placed, flat, heads, hot)
    final = _settled(extra, near, first, heads, docs)
    ids = classes.join(final.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    return flat, written(ids.select("cls", "root", "first_doc", "rkey", "copies"), few=True)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_copies of every row of (doc_id, text).

    ``n_copies`` counts the rows with the same set, the row itself included; 1 for empty ones.
    """
    flat, ids = _joined(docs)
    least = ids.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = ids.join(least, "root").select("cls", "component_id", "copies")
    out = flat.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(named, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The join itself: all links (a, b), a < b, between classes, and the members (cls, doc_id, n_shingles, n_copies).

    Every row is a member; rows of one class are linked with each other, and with all rows of the
    classes that theirs is linked with.  Rows without words have a null class and no links.
    Each class is its own component here, so no pair is skipped: the work grows with the number of
    links, which in a group of near copies is the square of its distinct texts.
    """
    docs, flat, classes, heads, hot = _prepared(docs)
    pairs = _candidates(heads.withColumn("comp", F.col("cls")), flat, heads, hot)
    links = written(_verified(pairs, heads, docs), few=True)
    members = flat.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(classes.select("cls", "copies"), "cls", "left")
    return links, members.select("cls", "doc_id", "n_shingles", F.coalesce("copies", F.lit(1)).alias("n_copies"))


def link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, n_copies and n_links, the number of other rows it is linked with, of every row of (doc_id, text)."""
    links, members = jaccard_links(docs)
    sizes = members.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("k"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("k").alias("others"))
    return members.join(others, "cls", "left").select("doc_id", "n_shingles", "n_copies", (F.coalesce("others", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, with one row of each group of linked documents: that of the least doc_id.

    Documents without words all stay, repeated ones too, since they are linked with nothing.  Of
    rows with that doc_id the one with the least hash stays, and of repeated rows one.
    """
    flat, ids = _joined(docs)
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rkey")
    placed = flat.where("cls is not null").join(ids.select("cls", "root"), "cls").select("rkey", "doc_id", "root")
    heads = placed.groupBy("root").agg(F.min(order).alias("head")).select(F.col("head.rkey").alias("rkey"))
    gone = written(placed.select("rkey").distinct().join(heads, "rkey", "left_anti"), few=True)
    key = "__docuweave_rkey"
    keyed = docs.withColumn(key, row_key())
    few = F.broadcast(gone) if small(gone, MAX_BROADCAST) else gone
    kept = keyed.join(few.withColumnRenamed("rkey", key), key, "left_anti")
    if not flat.where("cls is not null").groupBy("rkey").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
        worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        kept = kept.where(worded).dropDuplicates([key]).unionByName(kept.where(~worded))
    return kept.select(*docs.columns)
