"""Stupid-backoff language-model scores, computed relationally over the whole corpus.

A document's score is the mean natural logarithm of S over its words, where counts leave the
document itself out: S(v | u) = c(u v) / c(u) if other documents have the pair, else
ALPHA * c(v) / N, else ALPHA / (N + 1); the first word has no context and no ALPHA.

``backoff_scores``, for pairs of words, explodes each document into its distinct words and pairs
with their counts inside it, deals these rows out by the hash of their n-gram, sums the n-gram's
count there, joins it to the rows in the same sort, and sums what they are worth by document.
One plan serves all sizes:

* The ``HOT`` commonest words and pairs of a sixteenth of the rows are counted exactly in a pass of
  their own, and these two tables, whose size does not depend on the corpus, are broadcast.  So an
  n-gram that very many documents have is counted by partial aggregation, joined where the document is,
  and never gathered.  Which n-grams are hot has no say in the result.
* A pair of hot words goes to a bucket of its own, by its hash, and brings the counts of both words.
* Any other pair goes to the bucket of its cold word, where that word's rows from all documents meet, so that
  the word's count is known there too.  If both words are cold the pair goes to both buckets: the
  first word's knows what a hit is worth, the second word's what a miss is worth.
* What a bucket finds for a document goes to the document's bucket, where it is summed.

Rows travel as compressed columns: a pair takes about 6 bytes and not 40.

``backoff_scores_joined``, for any order, gives the same scores with explode, count tables, joins and sums
of DataFrames, at several times the shuffle.

Defined results: null and empty texts have 0 words and a null score; repeated rows count as
documents of their own, so each sees its copies; a null doc_id is scored like others; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, ship, written

ship(__name__)

ALPHA = 0.4
#: Most n-grams of a length that are broadcast, the share of rows that they are picked from, and how often one must be there.
HOT, HOT_SHARE, HOT_COUNT = 1 << 18, 16, 3
BUCKET_ROWS = 1_500_000
FLUSH_ROWS = 1_000_000
#: Words that are looked at together, and rows that a bucket weighs at once.
CHUNK = 250_000
WEIGH_ROWS = 250_000
#: Parts of the hot n-grams' counts, each of which one task sums.
COUNT_PARTS = 16

#: Roles of rows: a pair of hot words; a word; a pair by its cold first or second word; both, where both are cold.
PAIR, WORD, FIRST, SECOND, BOTH_FIRST, BOTH_SECOND = range(6)

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


class _Hash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers as one compressed value, byte planes side by side."""
    planes = [np.ascontiguousarray(c.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // (4 * columns)
    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 4 * n * i).reshape(4, n).T).view(np.uint32).ravel() for i in range(columns)]


def _pack_wide(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = values.astype(np.int64).view(np.uint64)
    return (v >> np.uint64(32)).astype(np.uint32), (v & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _wide(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return ((high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)).view(np.int64)


#: Kinds of the columns of rows that are kept: key, partner, role, count, two counts of words, document; and in a bucket.
_SPREAD = (np.uint64, np.uint64, np.uint8, np.uint32, np.uint32, np.uint32, np.int32)
_NEAR = (np.uint64, np.int32, np.uint32, np.uint32, np.uint32)
_COLD = (*_NEAR, np.uint64, np.uint8)


def _columns(parts: list[tuple]) -> list[np.ndarray]:
    """The parts' columns, one after the other, each part's let go of as soon as it is copied; ``parts`` is empty then."""
    rows = [list(p) for p in parts]
    parts.clear()
    out = []
    for i in range(len(rows[0])):
        out.append(np.concatenate([r[i] for r in rows]))
        for r in rows:
            r[i] = None
    return out


def _by_key(key: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of about ``most`` rows at a time, all rows of a key together."""
    order = np.argsort(key, kind="stable")
    at = 0
    while at < len(key):
        end = min(at + most, len(key))
        while end < len(key) and key[order[end]] == key[order[end - 1]]:
            rest = key[order[end : end + most]]
            end += int(np.argmax(rest != rest[0])) or len(rest)
        yield order[at:end]
        at = end


def _floats(values: np.ndarray) -> np.ndarray:
    return values.astype(np.float64).view(np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple]]]:
    """Of about ``CHUNK`` words of whole documents at a time: the words' hashes, their documents' numbers from 0, and the documents.

    A document is its row's values before ``column``, which holds the text, and its number of words.
    """
    known = _Hash()
    words: list[int] = []
    docs: list[tuple] = []

    def out() -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        found = np.array(words, np.uint64), np.repeat(np.arange(len(docs)), [d[-1] for d in docs]), docs.copy()
        words.clear()
        docs.clear()
        return found

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(column)]
        for i, t in enumerate(batch.column(column)):
            w = words_of(t.as_py())
            words.extend(map(known.__getitem__, w))
            docs.append((*(c[i] for c in columns), len(w)))
            if len(words) > CHUNK:
                yield out()
    if docs:
        yield out()


def _hot_grams(docs: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest words of a share of the rows, as sorted hashes, and pairs of them, as sorted codes of two places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, d, _ in _chunks(batches):
            names, at, n = np.unique(h, return_inverse=True, return_counts=True)
            code, m = np.unique((at[:-1] * len(names) + at[1:])[d[:-1] == d[1:]], return_counts=True)
            for u, v, k in ((names, np.zeros(len(names), np.uint64), n), (names[code // len(names)], names[code % len(names)], m)):
                kind = np.full(len(u), 0 if u is names else 1, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(k.astype(np.int64))], names=["kind", "u", "v", "n"])

    some = docs.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(HOT_SHARE)) == 0).select("text")
    counts = written(some.mapInArrow(run, "kind int, u long, v long, n long").groupBy("kind", "u", "v").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_COUNT))
    top = [columns_of(counts.where(F.col("kind") == k).orderBy(F.desc("n"), "u", "v").limit(hot), {"u": "int64", "v": "int64"}) for k in (0, 1)]
    words = np.sort(top[0][0].view(np.uint64))
    u, v = (_places(words, x.view(np.uint64)) for x in top[1])
    return words, np.sort((u << 32 | v)[(u >= 0) & (v >= 0)])


def _places(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Where the grams are in a sorted table; -1 for those that are not."""
    if not len(table):
        return np.full(len(grams), -1, np.int64)
    at = np.minimum(np.searchsorted(table, grams), len(table) - 1)
    return np.where(table[at] == grams, at, -1)


def _counted(docs: DataFrame, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """How often all documents have each hot word and each hot pair, and the number of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, pairs), total = shared.value, 0
        word_n, pair_n = np.zeros(len(words), np.int64), np.zeros(len(pairs), np.int64)
        for h, d, _ in _chunks(batches):
            total += len(h)
            names, at, n = np.unique(h, return_inverse=True, return_counts=True)
            place = _places(words, names)
            word_n[place[place >= 0]] += n[place >= 0]
            token = place[at]
            u, v = token[:-1], token[1:]
            codes, n = np.unique((u << 32 | v)[(u >= 0) & (v >= 0) & (d[:-1] == d[1:])], return_counts=True)
            place = _places(pairs, codes)
            pair_n[place[place >= 0]] += n[place >= 0]
        yield from sums((total, word_n, pair_n))

    def sums(counts: tuple) -> Iterator[pa.RecordBatch]:
        """A row for each part of the tables, so that a task's rows don't depend on what it has read."""
        total, *tables = counts
        for part in range(COUNT_PARTS):
            cut = [n[part::COUNT_PARTS] for n in tables]
            data = _pack(*_pack_wide(np.concatenate([[total if part == 0 else 0], *cut])))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data])], names=["part", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = _wide(*_unpack(data.as_py(), 2))
                found[part] = found[part] + n if part in found else n
        for part, n in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_pack(*_pack_wide(n))])], names=["part", "n"])

    rows = docs.select("text").mapInArrow(run, "part int, n binary").repartition(COUNT_PARTS, "part").mapInArrow(add, "part int, n binary")
    out, total = [np.zeros(len(t), np.int64) for t in tables], 0
    for r in rows.collect():  # ``COUNT_PARTS`` rows
        n = _wide(*_unpack(r["n"], 2))
        total += int(n[0])
        split = 1 + len(out[0][r["part"] :: COUNT_PARTS])
        out[0][r["part"] :: COUNT_PARTS], out[1][r["part"] :: COUNT_PARTS] = n[1:split], n[split:]
    shared.destroy()
    return out[0], out[1], total


def _grouped(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row the sum of ``n`` over the rows with its value."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    out = np.empty(len(v), np.int64)
    out[order] = np.repeat(np.add.reduceat(n[order], starts), np.diff(np.r_[starts, len(v)]))
    return out


def backoff_scores(docs: DataFrame, hot: int = HOT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_words, score and n_pairs (whose context other documents share) of each (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tables = _hot_grams(docs, hot)
    word_n, pair_n, total = _counted(docs, tables)
    model = spark.sparkContext.broadcast((*tables, word_n, pair_n))
    buckets = max(64, math.ceil(total / bucket_rows))
    log_alpha = math.log(ALPHA)

    def single(others: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return np.where(others > 0, np.log(np.maximum(others, 1)) - np.log(np.maximum(rest, 1)), -np.log(rest + 1.0))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, word_n, pair_n = model.value
        held: list[tuple] = []
        docs_held: list[tuple] = []
        bases: list[np.ndarray] = []
        hits_held: list[np.ndarray] = []
        rows = 0

        def out() -> Iterator[pa.RecordBatch]:
            key, other, role, n, a, b, local = _columns(held)
            base, hits = np.concatenate(bases), np.concatenate(hits_held)
            rowkey, size = (np.array([d[i] for d in docs_held], np.int64) for i in (0, 2))
            ids = np.array([0 if d[1] is None else d[1] for d in docs_held], np.int64)
            null = np.array([d[1] is None for d in docs_held], np.uint32)
            for x in (held, docs_held, bases, hits_held):
                x.clear()
            with np.errstate(over="ignore"):
                at = (((key * _MIX[0]) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            cold = role != PAIR
            by = np.lexsort((key, at * 2 + cold))
            starts = np.searchsorted((at * 2 + cold)[by], np.arange(2 * buckets + 1))
            high, low = _pack_wide(rowkey)
            for bucket in range(buckets):
                first, split, last = starts[2 * bucket : 2 * bucket + 3]
                if first == last:
                    continue
                used, where = np.unique(local[by[first:last]], return_inverse=True)
                who = _pack(high[used], np.diff(low[used].astype(np.int64), prepend=0) & 0xFFFFFFFF, size[used])
                parts = []
                for p, q in ((first, split), (split, last)):
                    pick = by[p:q]
                    columns = [np.diff((key[pick] >> np.uint64(32)).astype(np.int64), prepend=0), key[pick] & np.uint64(0xFFFFFFFF), where[p - first : q - first], n[pick], a[pick], b[pick]]
                    if p == split:
                        columns += [other[pick] >> np.uint64(32), other[pick] & np.uint64(0xFFFFFFFF), role[pick]]
                    parts.append(_pack(*columns) if q > p else b"")
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([0], pa.int32()), pa.array([parts[0]]), pa.array([parts[1]]), pa.array([who])], names=["bucket", "kind", "main", "cold", "docs"])
            home = rowkey % buckets
            for bucket in np.unique(home):
                pick = np.flatnonzero(home == bucket)
                main = _pack(*_pack_wide(rowkey[pick]), *_pack_wide(ids[pick]), null[pick], size[pick], *_pack_wide(_floats(base[pick]).view(np.int64)), hits[pick])
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket)], pa.int32()), pa.array([1], pa.int32()), pa.array([main]), pa.array([b""]), pa.array([b""])], names=["bucket", "kind", "main", "cold", "docs"])

        for h, d, docs_here in _chunks(batches, 2):
            count = len(docs_here)
            rest = total - np.array([x[-1] for x in docs_here], np.int64)
            names, at = np.unique(h, return_inverse=True)
            place = _places(words, names)
            # The distinct words of each document.
            code, token, own = np.unique(d * len(names) + at, return_inverse=True, return_counts=True)
            doc, word = code // max(1, len(names)), code % max(1, len(names))
            hot_word = place[word] >= 0
            others = np.where(hot_word, (word_n[place[word]] if len(words) else 0) - own, 0)
            begins = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.empty(0, np.int64)
            opening = np.zeros(len(code), bool)
            opening[token[begins]] = True
            given = opening & hot_word
            base = np.bincount(doc[given], single(others[given], rest[doc[given]]), count)
            lone = np.flatnonzero(~hot_word)
            put = [(names[word[lone]], np.zeros(len(lone), np.uint64), np.full(len(lone), WORD), own[lone], opening[lone].astype(np.int64), np.zeros(len(lone), np.int64), doc[lone])]
            # The distinct pairs of each document: a pair's first place tells its words' numbers.
            inside = np.flatnonzero(d[:-1] == d[1:])
            _, first, n = np.unique(token[inside] * np.int64(max(1, len(names))) + at[inside + 1], return_index=True, return_counts=True)
            u, v = token[inside[first]], token[inside[first] + 1]
            pd_ = doc[u]
            hu, hv = hot_word[u], hot_word[v]
            pu, pv = place[word[u]], place[word[v]]
            pair = np.where(hu & hv, pu << 32 | pv, -1)
            settled = _places(pairs, pair)
            here = (settled >= 0) & hu & hv
            more = pair_n[settled[here]] - n[here]
            hit = more > 0
            worth = np.where(hit, np.log(np.maximum(more, 1)) - np.log(np.maximum(others[u[here]], 1)), log_alpha + single(others[v[here]], rest[pd_[here]]))
            base += np.bincount(pd_[here], worth * n[here], count)
            hits = np.bincount(pd_[here], n[here] * hit, count).astype(np.int64)
            far = hu & hv & ~here
            put.append((pair[far].view(np.uint64), np.zeros(int(far.sum()), np.uint64), np.full(int(far.sum()), PAIR), n[far], others[u[far]], others[v[far]], pd_[far]))
            for pick, keys, there, role in ((~hu & hv, u, pv, FIRST), (hu & ~hv, v, pu, SECOND), (~hu & ~hv, u, None, BOTH_FIRST), (~hu & ~hv, v, None, BOTH_SECOND)):
                if pick.any():
                    x, y = u[pick], v[pick]
                    partner = there[pick].view(np.uint64) if there is not None else names[word[y if role == BOTH_FIRST else x]]
                    a = own[x] if role in (FIRST, BOTH_FIRST) else others[x]
                    b = own[y] if role in (SECOND, BOTH_SECOND) else others[y]
                    put.append((names[word[keys[pick]]], partner, np.full(len(x), role), n[pick], a, b, pd_[pick]))
            joined = [np.concatenate(x) for x in zip(*put, strict=True)]
            joined[-1] = joined[-1] + len(docs_held)
            held.append(tuple(x.astype(kind) for x, kind in zip(joined, _SPREAD, strict=True)))
            docs_held.extend(docs_here)
            bases.append(base)
            hits_held.append(hits)
            rows += len(joined[0])
            if rows > FLUSH_ROWS or len(docs_held) > 100_000:
                yield from out()
                rows = 0
        if docs_held:
            yield from out()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(payloads: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            near, cold, rowkeys, sizes, at = [], [], [], [], 0
            while payloads:
                main, other, who = payloads.pop()
                high, low, size = _unpack(who, 3)
                rowkeys.append(_wide(high, np.cumsum(low.astype(np.uint64)).astype(np.uint64) & np.uint64(0xFFFFFFFF)))
                sizes.append(size.astype(np.int64))
                for data, width, to in ((main, 6, near), (other, 9, cold)):
                    if data:
                        du, lo, local, n, a, b, *more = _unpack(data, width)
                        key = (np.cumsum(du.astype(np.uint64)) << np.uint64(32)) | lo
                        row = (key, local.astype(np.int64) + at, n, a, b)
                        if more:
                            ph, pl, role = more
                            row = (*row, ph.astype(np.uint64) << np.uint64(32) | pl, role)
                        to.append(tuple(x.astype(kind, copy=False) for x, kind in zip(row, _COLD if more else _NEAR, strict=True)))
                at += len(size)
            rowkey, size = np.concatenate(rowkeys), np.concatenate(sizes)
            rows, inverse = np.unique(rowkey, return_inverse=True)
            part, hits = np.zeros(len(rows)), np.zeros(len(rows), np.int64)

            def add(who: np.ndarray, value: np.ndarray, found: np.ndarray) -> None:
                nonlocal part, hits
                part += np.bincount(inverse[who], value, len(rows))
                hits += np.bincount(inverse[who], found, len(rows)).astype(np.int64)

            if near:
                columns = _columns(near)
                for pick in _by_key(columns[0], WEIGH_ROWS):
                    key, who, *counts = (x[pick] for x in columns)
                    n, cu, cv = (x.astype(np.int64) for x in counts)
                    others = _grouped(key, n) - n
                    hit = others > 0
                    miss = log_alpha + single(cv, total - size[who])
                    add(who, np.where(hit, np.log(np.maximum(others, 1)) - np.log(np.maximum(cu, 1)), miss) * n, n * hit)
                del columns
            if cold:
                columns = _columns(cold)
                for pick in _by_key(columns[0], WEIGH_ROWS):
                    key, who, *counts, partner, role = (x[pick] for x in columns)
                    n, a, b = (x.astype(np.int64) for x in counts)
                    rest = total - size[who]
                    is_word = role == WORD
                    # A word's own rows give its count to all rows of its key.
                    in_all = _grouped(key, np.where(is_word, n, 0))
                    with np.errstate(over="ignore"):
                        pair = key * _MIX[0] ^ (partner + role.astype(np.uint64) * _MIX[2]) * _MIX[1]
                    others = _grouped(pair ^ (pair >> np.uint64(32)), n) - n
                    hit = (others > 0) & ~is_word
                    cu = np.where((role == FIRST) | (role == BOTH_FIRST), in_all - a, a)
                    cv = np.where((role == SECOND) | (role == BOTH_SECOND), in_all - b, b)
                    worth_hit = np.log(np.maximum(others, 1)) - np.log(np.maximum(cu, 1))
                    worth_miss = log_alpha + single(cv, rest)
                    value = np.where(hit, worth_hit, worth_miss) * n
                    value = np.where(role == BOTH_FIRST, np.where(hit, worth_hit * n, 0.0), value)
                    value = np.where(role == BOTH_SECOND, np.where(hit, 0.0, worth_miss * n), value)
                    value = np.where(is_word, np.where(a == 1, single(in_all - n, rest), 0.0), value)
                    add(who, value, n * (hit & (role != BOTH_SECOND)))
                del columns
            home = rows % buckets
            by = np.argsort(home, kind="stable")
            edges = np.searchsorted(home[by], np.arange(buckets + 1))
            for b in range(buckets):
                pick = by[edges[b] : edges[b + 1]]
                if len(pick):
                    main = _pack(*_pack_wide(rows[pick]), *_pack_wide(_floats(part[pick]).view(np.int64)), hits[pick])
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([0], pa.int32()), pa.array([main])], names=["home", "kind", "main"])

        now, payloads = None, []
        for batch in batches:
            for bucket, kind, main, cold, who in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([1], pa.int32()), pa.array([main])], names=["home", "kind", "main"])
                    continue
                if bucket != now and payloads:
                    yield from one(payloads)
                    payloads = []
                now = bucket
                payloads.append((main, cold, who))
        if payloads:
            yield from one(payloads)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(parts: list[tuple[int, bytes]]) -> pa.RecordBatch | None:
            base = [_unpack(m, 9) for k, m in parts if k == 1]
            sums = [_unpack(m, 5) for k, m in parts if k == 0]
            if not base:
                return None
            ids = np.concatenate([_wide(b[0], b[1]) for b in base])
            doc = np.concatenate([_wide(b[2], b[3]) for b in base])
            null = np.concatenate([b[4] for b in base]).astype(bool)
            size = np.concatenate([b[5] for b in base]).astype(np.int64)
            score = np.concatenate([_wide(b[6], b[7]).view(np.float64) for b in base]).copy()
            hits = np.concatenate([b[8] for b in base]).astype(np.int64)
            order = np.argsort(ids)
            for s in sums:
                at = order[np.searchsorted(ids[order], _wide(s[0], s[1]))]
                score[at] += _wide(s[2], s[3]).view(np.float64)
                hits[at] += s[4]
            empty = size == 0
            return pa.RecordBatch.from_arrays([pa.array(doc, mask=null), pa.array(size), pa.array(score / np.maximum(size, 1), mask=empty), pa.array(hits)], names=["doc_id", "n_words", "score", "n_pairs"])

        now, parts = None, []
        for batch in batches:
            for home, kind, main in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if home != now and parts:
                    if (out := one(parts)) is not None:
                        yield out
                    parts = []
                now = home
                parts.append((kind, main))
        if parts and (out := one(parts)) is not None:
            yield out

    keyed = docs.select(F.monotonically_increasing_id().alias("rowkey"), "doc_id", "text")
    rows = keyed.mapInArrow(spread, "bucket int, kind int, main binary, cold binary, docs binary")
    weighed = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(weigh, "home int, kind int, main binary")
    return weighed.repartition(buckets, "home").sortWithinPartitions("home").mapInArrow(gather, "doc_id long, n_words long, score double, n_pairs long")


def backoff_scores_joined(docs: DataFrame, order: int = 2) -> DataFrame:
    """The same scores for any order, by exploded n-grams, count tables and joins.

    Each level below the highest multiplies by ALPHA.  n_pairs counts the words scored above
    the single-word level.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    letters = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = rows.select("row", "doc_id", F.filter(F.split(letters, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"))
    sizes = listed.select("row", "doc_id", F.size("w").cast("long").alias("n_words"))
    total = sizes.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    # Each place's n-grams as hashes: the words themselves are not carried along.
    spans = {f"g{k}": (k, 0) for k in range(1, order + 1)} | {f"c{k}": (k, 1) for k in range(2, order + 1)}
    gram = lambda i, k, less: F.when(i >= k, F.xxhash64(F.array_join(F.slice("w", F.greatest(i - (k - 1), F.lit(1)), k - less), " ")))
    places = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct(*[gram(i, *x).alias(name) for name, x in spans.items()]))
    placed = listed.where(F.size("w") > 0).select("row", F.size("w").alias("size"), F.explode(places).alias("_g")).select("row", "size", "_g.*")
    if order > 1:
        placed = written(placed)
    own = {}
    for k in range(1, order + 1):
        inside = placed.where(F.col(f"g{k}").isNotNull()).groupBy("row", F.col(f"g{k}").alias("g")).agg(F.count(F.lit(1)).alias("in_doc"))
        # The corpus count next to the document's own: others' count is their difference.
        both = inside.join(inside.groupBy("g").agg(F.sum("in_doc").alias("in_all")), "g")
        own[k] = written(both.select("row", "g", (F.col("in_all") - F.col("in_doc")).alias("n")))
    scored = placed
    for k in range(1, order + 1):
        scored = scored.join(own[k].select("row", F.col("g").alias(f"g{k}"), F.col("n").alias(f"n{k}")), ["row", f"g{k}"], "left")
        if k > 1:
            scored = scored.join(own[k - 1].select("row", F.col("g").alias(f"c{k}"), F.col("n").alias(f"d{k}")), ["row", f"c{k}"], "left")
    rest = (F.lit(total) - F.col("size")).cast("double")
    value = F.when(F.col("n1") > 0, F.log(F.col("n1") / rest)).otherwise(-F.log(rest + 1))
    above = F.lit(0)
    levels = F.lit(0)
    for k in range(2, order + 1):
        levels = F.when(F.col(f"g{k}").isNotNull(), F.lit(k - 1)).otherwise(levels)
    value = value + levels * math.log(ALPHA)
    for k in range(2, order + 1):
        hit = F.coalesce(F.col(f"n{k}") > 0, F.lit(False))
        value = F.when(hit, F.log(F.col(f"n{k}") / F.col(f"d{k}")) + (levels - (k - 1)) * math.log(ALPHA)).otherwise(value)
        above = F.when(hit, F.lit(1)).otherwise(above)
    sums = scored.groupBy("row").agg(F.sum(value).alias("s"), F.sum(above).cast("long").alias("n_pairs"))
    out = sizes.join(sums, "row", "left")
    return out.select("doc_id", "n_words", (F.col("s") / F.nullif(F.col("n_words"), F.lit(0))).alias("score"), F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"))
