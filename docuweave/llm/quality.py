"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from well and one from badly marked text.  All labelled
rows teach, half of them the dictionaries and half the calibration: dictionaries of lots of rows are
merged, and the calibration's sums are added up over all tasks.  A text is
cut into blocks of ``BLOCK`` bytes; every block of the whole text is compressed once with each
dictionary.  The normalised difference of the compressed sizes says which of the two the text
resembles; a logistic calibration, fitted on labelled rows that the dictionaries have not seen,
turns it into a probability.

Defined results: a null text counts as the empty text, and an empty text gets the probability of
its features (one empty block) like any other.  Only labels whose value is 0 or 1 and whose
doc_id is not null teach; of repeated labels for one doc_id the smaller counts.  If the
labelled rows hold only one class, or none, every score is that class's smoothed share.  Extra
columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc, ship, small, written

ship(__name__)

BLOCK = 512
LEVEL = 3
DICT_BYTES = 112_640
#: Labelled rows in a lot, characters of a lot's text that make a dictionary, and lots whose dictionaries make one.
LOT = 2048
POOL = 8_000_000
MERGE = 16
MAX_BROADCAST = 2_000_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, holdout: bool = True) -> DataFrame:
    """Every row that may teach (lot, doc_id, text, y), written, in lots of about ``LOT`` rows.

    A lot lies in one partition, sorted by doc_id; it depends on the ids only.  ``holdout`` leaves out
    the fifth of the ids whose CRC-32 is divisible by 5.  Of repeated ids each text is there, the least first.
    """
    ids = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    if holdout:
        ids = ids.where(F.pmod(crc("doc_id"), F.lit(5)) != 0)
    ids = ids.groupBy("doc_id").agg(F.min("y").alias("y"))
    lots = max(1, math.ceil(ids.count() / LOT))
    if small(ids, MAX_BROADCAST):
        ids = F.broadcast(ids)
    known = docs.select("doc_id", "text").where("text is not null").join(ids, "doc_id")
    known = known.select(F.pmod(F.xxhash64(F.lit("lot"), "doc_id"), F.lit(lots)).cast("int").alias("lot"), "doc_id", "text", "y")
    return written(known.repartition(lots, "lot").sortWithinPartitions("lot", "doc_id", "text"))


def by_lot(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[str, int]]]]:
    """Each lot of a partition with its (text, y), one for each doc_id, read as they are taken."""

    def rows() -> Iterator[tuple[int, object, str, int]]:
        last = None
        for batch in batches:
            lots, ids, ys = (batch.column(c).to_pylist() for c in ("lot", "doc_id", "y"))
            for lot, doc_id, text, y in zip(lots, ids, batch.column("text"), ys, strict=True):
                if (lot, doc_id) != last:
                    last = (lot, doc_id)
                    yield lot, doc_id, text.as_py(), y

    for lot, part in groupby(rows(), key=lambda r: r[0]):
        yield lot, ((t, y) for _, _, t, y in part)


def class_shares(labels: DataFrame, label: str) -> tuple[float, float]:
    """The shares of 0 and 1 among all labels that may teach."""
    counts = {r["y"]: r["n"] for r in labels.where(F.pmod(crc("doc_id"), F.lit(5)) != 0).groupBy(F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = max(1, counts.get(0, 0) + counts.get(1, 0))
    return counts.get(0, 0) / n, counts.get(1, 0) / n


def class_counts(rows: DataFrame) -> tuple[int, int]:
    """How many ids of the labelled ``rows`` have 0 and 1."""
    got = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.countDistinct("doc_id").alias("n")).collect()}
    return got.get(0, 0), got.get(1, 0)


def blocks(data: bytes, size: int = BLOCK) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)] or [b""]


def _dictionary(texts: list[str]) -> bytes:
    return _dictionary_of([b for t in texts for b in blocks(t.encode("utf-8", "replace"))])


def _dictionary_of(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train: the text itself is the dictionary
        return b"".join(pieces)[-DICT_BYTES:] or b"\0" * 8


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> list[float]:
    """Normalised difference of the sizes over the whole text, least and most of a block, and the ratio."""
    data = (text or "").encode("utf-8", "replace")
    pieces = blocks(data)
    g = np.array([len(good.compress(b)) for b in pieces], dtype=float)
    h = np.array([len(bad.compress(b)) for b in pieces], dtype=float)
    d = (h - g) / np.maximum(np.maximum(g, h), 1)
    whole = (h.sum() - g.sum()) / max(g.sum(), h.sum(), 1)
    ratio = min(g.sum(), h.sum()) / max(1, len(data))
    return [whole, min(ratio, 2.0), d.max(), d.min()]


def _expand(x: np.ndarray) -> np.ndarray:
    return np.c_[x, x[:, 0] ** 2, x[:, 1] ** 2, x[:, 0] * x[:, 1]]


def _newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; ``sums`` gives the gradient and the curvature of the fit."""
    beta = np.zeros(width)
    for _ in range(50):
        grad, curve = sums(beta)
        step = np.linalg.solve(curve + ridge * np.eye(width), grad - ridge * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The regression on rows in memory; the first column is the intercept."""

    def sums(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        return x.T @ (w * (y - p)), (x.T * (w * p * (1 - p))) @ x

    return _newton(sums, x.shape[1])


def halves(rows: Iterator[tuple[str, int]], lot: int = 0) -> Iterator[tuple[str, int, bool]]:
    """Every other row of each class is for the dictionaries (true), the others are for the calibration; odd lots begin with these."""
    seen = {0: lot % 2, 1: lot % 2}
    for text, y in rows:
        yield text, y, seen[y] % 2 == 0
        seen[y] += 1


def fit(sample: list[tuple[int, str, int]], shares: tuple[float, float] = (0.5, 0.5)) -> dict:
    """The model of rows in memory: the dictionaries from one half and the calibration from the other.

    ``shares`` are the classes' shares among all labels, to which the calibration is weighted.
    """
    y_all = [y for _, _, y in sample]
    if too_few(y_all.count(0), y_all.count(1)):
        return {"constant": (sum(y_all) + 1) / (len(y_all) + 2)}
    parts = list(halves((t, y) for _, t, y in sample))
    good, bad = (_dictionary([t for t, y, teaches in parts if teaches and y == k]) for k in (1, 0))
    cg, cb = _compressor(good), _compressor(bad)
    rest = [(t, y) for t, y, teaches in parts if not teaches]
    x = np.array([features(t, cg, cb) for t, _ in rest])
    y = np.array([k for _, k in rest], dtype=float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = np.where(y == 1, shares[1] / max(1, y.sum()), shares[0] / max(1, (1 - y).sum())) * len(y)
    z = _expand((x - mean) / scale)
    beta = _logistic(np.c_[np.ones(len(z)), z], y, w)
    return {"good": good, "bad": bad, "mean": mean, "scale": scale, "beta": beta}


def too_few(others: int, marked: int) -> bool:
    return min(others, marked) < 4


def _dictionaries(rows: DataFrame) -> dict[int, bytes]:
    """The dictionaries of bad (0) and of good text (1), from all teaching rows; none for a class without any.

    Each ``POOL`` bytes of a lot's text of one class make a dictionary; those of ``MERGE`` lots are
    the text of the next, until one is left.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, part in by_lot(batches):
            pools: dict[int, list[str]] = {0: [], 1: []}
            sizes, at = {0: 0, 1: 0}, 0

            def out(k: int) -> pa.RecordBatch:
                made = _dictionary(pools[k])
                pools[k], sizes[k] = [], 0
                return pa.RecordBatch.from_arrays([pa.array([lot], pa.int32()), pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([made], pa.binary())], names=["lot", "y", "at", "dictionary"])

            for text, y, teaches in halves(part, lot):
                if teaches:
                    pools[y].append(text)
                    sizes[y] += len(text)
                    if sizes[y] > POOL:
                        yield out(y)
                        at += 1
            for k in (0, 1):
                if pools[k]:
                    yield out(k)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot, y, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                made = parts.as_py()
                one = made[0]["dictionary"] if len(made) == 1 else _dictionary_of([b for d in made for b in blocks(d["dictionary"])])
                yield pa.RecordBatch.from_arrays([pa.array([lot], pa.int32()), pa.array([y], pa.int32()), pa.array([0], pa.int32()), pa.array([one], pa.binary())], names=["lot", "y", "at", "dictionary"])

    kind = "lot int, y int, at int, dictionary binary"
    made = written(rows.mapInArrow(learn, kind))
    while any((top := made.agg(F.max("lot").alias("lot"), F.max("at").alias("at")).first()).asDict().values()):
        step = MERGE if top["at"] == 0 else 1  # first a lot's own, then those of neighbours
        grouped = made.groupBy(F.floor(F.col("lot") / step).cast("int").alias("lot"), "y").agg(F.sort_array(F.collect_list(F.struct("lot", "at", "dictionary"))).alias("parts"))
        made = written(grouped.mapInArrow(merge, kind), few=True)
    return {r["y"]: bytes(r["dictionary"]) for r in made.collect()}


def _calibrated(x: DataFrame, shares: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and coefficients of the calibration on all rows of ``x`` (y, x0 to x3); only sums come to the driver."""
    stats = x.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(4) for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    mean, scale = (np.array([stats[f"{c}{i}"] for i in range(4)]) for c in "ms")
    scale += 1e-9
    n, marked = stats["n"], stats["p"]
    weight = shares[0] / max(1, n - marked) * n, shares[1] / max(1, marked) * n

    def sums(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, curve = np.zeros(8), np.zeros((8, 8))
            for batch in batches:
                y, *cols = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
                z = _expand((np.c_[*cols] - mean) / scale)
                z = np.c_[np.ones(len(z)), z]
                p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
                w = np.where(y == 1, weight[1], weight[0])
                grad += z.T @ (w * (y - p))
                curve += (z.T * (w * p * (1 - p))) @ z
            yield pa.RecordBatch.from_arrays([pa.array([np.r_[grad, curve.ravel()].tobytes()], pa.binary())], names=["s"])

        total = sum(np.frombuffer(r["s"]) for r in x.select("y", "x0", "x1", "x2", "x3").mapInArrow(run, "s binary").collect())
        return total[:8], total[8:].reshape(8, 8)

    return mean, scale, _newton(sums, 8)


def score_column(text: Column, model: dict) -> Column:
    """Probability, 0 to 1, that a text is good."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if "constant" in model:
            for part in parts:
                yield pd.Series(np.full(len(part), model["constant"]))
            return
        cg, cb = _compressor(model["good"]), _compressor(model["bad"])
        for part in parts:
            x = np.array([features(t, cg, cb) for t in part]).reshape(-1, 4)
            z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
            z = _expand(z)
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(z)), z] @ model["beta"], -30, 30))))

    return score(text)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """Fit on all labelled rows; the classes' shares come from all labels.

    Texts stay in the tasks: dictionaries, sums and coefficients are what meets.
    """
    shares = class_shares(labels, label)
    rows = labelled(docs, labels, label)
    others, marked = class_counts(rows)
    made = {} if too_few(others, marked) else _dictionaries(rows)
    if len(made) < 2:
        return {"constant": (marked + 1) / (others + marked + 2)}
    good, bad = made[1], made[0]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cg, cb = _compressor(good), _compressor(bad)
        for lot, part in by_lot(batches):
            found = [(float(y), *features(t, cg, cb)) for t, y, teaches in halves(part, lot) if not teaches]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in (zip(*found, strict=True) if found else [()] * 5)], names=["y", "x0", "x1", "x2", "x3"])

    x = written(rows.mapInArrow(measure, "y double, x0 double, x1 double, x2 double, x3 double"))
    mean, scale, beta = _calibrated(x, shares)
    return {"good": good, "bad": bad, "mean": mean, "scale": scale, "beta": beta}


def with_quality(docs: DataFrame, model: dict, score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with a column of scores, named ``score``."""
    return docs.withColumn(score, score_column(F.col("text"), model))
