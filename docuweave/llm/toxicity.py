"""Toxicity by a chain of linear classifiers.

The links of the chain are toxicity categories, in order, and toxicity itself comes last.  A
link is an L1 logistic model over the words of a text and the word beginnings of 4 to 7
letters, present or not, and over the probabilities of all earlier links.  In training a link
sees earlier probabilities that were predicted out of fold, so it learns how far to trust them.
The model's threshold on the last probability is also chosen on out-of-fold predictions.

Since only one label exists, categories are found: the marked texts' telling features fall into
``CATEGORIES`` groups by the texts in which they occur together, and a marked text belongs to the
groups of its features.  All labelled rows teach, whatever their number: features are counted, and
gradients added up, over all tasks.

Defined results: null and empty texts have no features and get the intercepts' probabilities;
labels other than 0 and 1 and null ids are left out of the training; with one class only, or no
labels, every probability is that class's smoothed share.  Extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, written
from .quality import by_lot, class_counts, class_shares, labelled, too_few

ship(__name__)

CATEGORIES = 3
FOLDS = 3
FEATURES = 3000
L1 = 3e-4
#: Texts that a feature must be in, and features of which categories are found.
LEAST_DF, TELLING = 5, 400
#: Most evaluations of a link's loss, and the relative gain under which a fit ends.
ROUNDS, TOLERANCE = 100, 1e-4
#: Numbers of features that a task holds at once, and a pack's columns.
HELD = 4_000_000
PACK = ("y", "fold", "sizes", "cols", "dense")
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def parts(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings marked by a star."""
    return [word, *(word[:k] + "*" for k in range(4, 8) if len(word) > k)]


def _counted(lot: Iterator[tuple[str, int]]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Features, and how many marked and how many other texts of a lot have each; a piece for every ``HELD`` numbers."""
    place: dict[str, int] = {}
    known: dict[str, tuple] = {}
    found: tuple[list, list] = ([], [])
    size = 0

    def out() -> tuple[list[str], np.ndarray, np.ndarray]:
        others, marked = (np.bincount(np.concatenate([*f, np.empty(0, np.int32)]).astype(np.int64), minlength=len(place)) for f in found)
        return list(place), marked, others

    for text, y in lot:
        hits: set[int] = set()
        for w in words(text):
            ids = known.get(w)
            if ids is None:
                ids = known[w] = tuple(place.setdefault(f, len(place)) for f in parts(w))
            hits.update(ids)
        found[y].append(np.fromiter(hits, np.int32, len(hits)))
        size += len(hits)
        if size > HELD:
            yield out()
            place, known, found, size = {}, {}, ([], []), 0
    if place:
        yield out()


def _packed(lot: Iterator[tuple[str, int]], index: dict[str, int]) -> Iterator[dict]:
    """The texts of a lot as packs: class, fold, and the sorted numbers of the features in ``index``."""
    known: dict[str, tuple] = {}
    ys, sizes, cols = [], [], []
    size = before = 0

    def out() -> dict:
        n = len(ys)
        fold = (np.arange(before, before + n) % FOLDS).astype(np.uint8)
        return {"y": np.array(ys, np.uint8).tobytes(), "fold": fold.tobytes(), "sizes": np.array(sizes, np.int32).tobytes(), "cols": np.concatenate(cols).tobytes(), "dense": b""}

    for text, y in lot:
        hits: set[int] = set()
        for w in words(text):
            ids = known.get(w)
            if ids is None:
                if len(known) > 200_000:
                    known.clear()
                ids = known[w] = tuple(index[f] for f in parts(w) if f in index)
            hits.update(ids)
        ys.append(y)
        sizes.append(len(hits))
        cols.append(np.sort(np.fromiter(hits, np.int16, len(hits))))
        size += len(hits)
        if size > HELD:
            yield out()
            before += len(ys)
            ys, sizes, cols, size = [], [], [], 0
    if ys:
        yield out()


class Pack:
    """A pack read: y, fold, rows and cols of the features, and the earlier links' probabilities (dense)."""

    def __init__(self, raw: dict) -> None:
        self.y = np.frombuffer(raw["y"], np.uint8).astype(float)
        self.n = len(self.y)
        self.fold = np.frombuffer(raw["fold"], np.uint8)
        self.rows = np.repeat(np.arange(self.n), np.frombuffer(raw["sizes"], np.int32))
        self.cols = np.frombuffer(raw["cols"], np.int16).astype(np.int64)
        self.dense = np.frombuffer(raw["dense"]).reshape(self.n, -1) if raw["dense"] else np.zeros((self.n, 0))


class Held:
    """Packs in memory."""

    def __init__(self, packs: list[dict]) -> None:
        self.packs = packs

    def total(self, f: Callable[[Pack], np.ndarray]) -> np.ndarray:
        return sum(f(Pack(p)) for p in self.packs)

    def added(self, f: Callable[[Pack], np.ndarray]) -> Held:
        return Held([_with(p, f) for p in self.packs])


class Dealt:
    """Packs in a table; each task returns one sum."""

    def __init__(self, packs: DataFrame) -> None:
        self.packs = packs
        self.rdd = packs.rdd

    def total(self, f: Callable[[Pack], np.ndarray]) -> np.ndarray:
        def run(rows: Iterator) -> Iterator[bytes]:
            out = None
            for r in rows:
                x = f(Pack(r.asDict()))
                out = x if out is None else out + x
            if out is not None:
                yield np.asarray(out, float).tobytes()

        return sum(np.frombuffer(x) for x in self.rdd.mapPartitions(run).collect())

    def added(self, f: Callable[[Pack], np.ndarray]) -> Dealt:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    yield pa.RecordBatch.from_pylist([_with({c: batch.column(c)[r].as_py() for c in PACK}, f)], schema=pa.schema([(c, pa.binary()) for c in PACK]))

        return Dealt(written(self.packs.mapInArrow(run, ", ".join(f"{c} binary" for c in PACK))))


def _with(raw: dict, f: Callable[[Pack], np.ndarray]) -> dict:
    pack = Pack(raw)
    return raw | {"dense": np.c_[pack.dense, f(pack)].tobytes()}


def _scores(theta: np.ndarray, pack: Pack, width: int) -> np.ndarray:
    return np.bincount(pack.rows, theta[pack.cols], pack.n) + pack.dense @ theta[width:-1] + theta[-1]


def _probability(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


class Descent:
    """Orthant-wise limited-memory quasi-Newton steps for a loss with an L1 penalty (none on the last number, the bias).

    ``trial`` is the point whose loss and gradient ``take`` expects next; ``x`` is the best one so far.
    """

    def __init__(self, size: int, l1: float) -> None:
        self.x = self.trial = np.zeros(size)
        self.l1 = np.r_[np.full(size - 1, l1), 0.0]
        self.value, self.done = np.inf, False
        self.past: list[tuple[np.ndarray, np.ndarray]] = []

    def take(self, loss: float, grad: np.ndarray) -> None:
        value = loss + float(self.l1 @ np.abs(self.trial))
        if np.isfinite(self.value):
            if value > self.value + 1e-4 * float(self.slope @ (self.trial - self.x)):
                self.step /= 2
                self.done = self.step < 1e-9
                self._try()
                return
            s, y = self.trial - self.x, grad - self.grad
            if s @ y > 1e-12:
                self.past = [*self.past[-9:], (s, y)]
        self.done = self.value - value <= TOLERANCE * abs(value)
        self.x, self.value, self.grad = self.trial, value, grad
        low, high = grad - self.l1, grad + self.l1
        self.slope = np.where(self.x > 0, high, np.where(self.x < 0, low, np.where(low > 0, low, np.where(high < 0, high, 0))))
        if not self.slope.any():
            self.done = True
            return
        d, kept = -self.slope, []
        for s, y in reversed(self.past):
            a = (s @ d) / (s @ y)
            d = d - a * y
            kept.append(a)
        if self.past:
            s, y = self.past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(self.past, reversed(kept), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        self.way = np.where(d * self.slope < 0, d, 0)
        if not self.way.any():
            self.way = -self.slope
        self.step = 1.0 if self.past else min(1.0, 1 / np.linalg.norm(self.slope))
        self._try()

    def _try(self) -> None:
        side = np.where(self.x != 0, np.sign(self.x), -np.sign(self.slope))
        trial = self.x + self.step * self.way
        self.trial = np.where((trial * side < 0) & (self.l1 > 0), 0, trial)


def _fit_link(packs: Held | Dealt, target: Callable[[Pack], np.ndarray], weight: tuple[float, float], width: int, dense: int) -> list[np.ndarray]:
    """The link's numbers (words, links, bias) without each fold in turn, and last on all rows, over all packs."""
    size = width + dense + 1
    models = [Descent(size, L1) for _ in range(FOLDS + 1)]
    for _ in range(ROUNDS):
        open_ = [k for k, m in enumerate(models) if not m.done]
        if not open_:
            break
        at = [(k, models[k].trial) for k in open_]

        def sums(pack: Pack, at: list = at) -> np.ndarray:
            y, out = target(pack), []
            w = np.where(pack.y == 1, weight[1], weight[0])
            for k, theta in at:
                wk = np.where(pack.fold != k, w, 0.0)  # no fold has the number of the last
                s = _scores(theta, pack, width)
                r = wk * (_probability(s) - y)
                out.append(np.r_[wk.sum(), wk @ (np.logaddexp(0, s) - y * s), np.bincount(pack.cols, r[pack.rows], width), pack.dense.T @ r, r.sum()])
            return np.concatenate(out)

        for k, got in zip(open_, packs.total(sums).reshape(len(open_), -1), strict=True):
            models[k].take(got[1] / max(got[0], 1e-300), got[2:] / max(got[0], 1e-300))
    return [m.x for m in models]


def _z(marked: np.ndarray, others: np.ndarray, p: int, n: int) -> np.ndarray:
    """How far a feature's shares differ between the classes, by the two-proportion z score."""
    q = (marked + others) / (p + n)
    return (marked / p - others / n) / np.sqrt(q * (1 - q) * (1 / p + 1 / n) + 1e-12)


def find_categories(packs: Held | Dealt, chosen: np.ndarray, width: int, k: int = CATEGORIES) -> np.ndarray:
    """The category of each feature, -1 for none: groups of the ``chosen`` ones that occur in the same marked texts.

    Spherical k-means with seeds far apart, on the counts of the texts that two features share.
    """
    out = np.full(width, -1)
    if not len(chosen):
        return out
    at = np.full(width, -1)
    at[chosen] = np.arange(len(chosen))
    size = len(chosen)

    def shared(pack: Pack) -> np.ndarray:
        total = np.zeros((size, size))
        here = (pack.y[pack.rows] == 1) & (at[pack.cols] >= 0)
        names, rows = np.unique(pack.rows[here], return_inverse=True)
        cols = at[pack.cols[here]]
        for i in range(0, len(names), 1000):
            now = (rows >= i) & (rows < i + 1000)
            m = np.zeros((min(1000, len(names) - i), size), np.float32)
            m[rows[now] - i, cols[now]] = 1
            total += m.T @ m
        return total.ravel()

    both = packs.total(shared).reshape(size, size)
    length = np.maximum(np.sqrt(np.diag(both)), 1e-9)
    both = both / length / length[:, None]
    seeds = [0]
    near = both[0].copy()
    while len(seeds) < min(k, size):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, both[seeds[-1]])
    centre = np.zeros((len(seeds), size))
    centre[np.arange(len(seeds)), seeds] = 1
    for _ in range(10):
        group = np.argmax(both @ centre.T / np.maximum(np.sqrt(np.einsum("ij,jk,ik->i", centre, both, centre)), 1e-9), axis=1)
        centre = np.array([(group == j).astype(float) if (group == j).any() else centre[j] for j in range(len(seeds))])
    out[chosen] = group
    return out


def _has(pack: Pack, group: np.ndarray, k: int = CATEGORIES) -> np.ndarray:
    """Rows x k of 0 and 1: a marked text has the categories of at least a quarter of its telling features, and its commonest one in any case."""
    here = group[pack.cols] >= 0
    hits = np.bincount(pack.rows[here] * k + group[pack.cols[here]], minlength=pack.n * k).reshape(pack.n, k)
    return (pack.y[:, None] == 1) & (hits > 0) & ((hits == hits.max(axis=1, keepdims=True)) | (4 * hits >= hits.sum(axis=1, keepdims=True)))


def fit_chain(packs: Held | Dealt, features: list[str], group: np.ndarray, categories: list[int], label: str, weight: tuple[float, float]) -> dict:
    """One link for each category, in the order given, and the last for the label itself."""
    width, names, links = len(features), [*(f"category_{j + 1}" for j in categories), label], []
    for j in [*categories, None]:
        target = (lambda pack: pack.y) if j is None else (lambda pack, j=j: _has(pack, group)[:, j].astype(float))
        models = _fit_link(packs, target, weight, width, len(links))
        links.append(models[-1])

        def out_of_fold(pack: Pack, models: list = models) -> np.ndarray:
            return np.choose(pack.fold, [_probability(_scores(m, pack, width)) for m in models[:-1]])

        packs = packs.added(out_of_fold)
    used = np.flatnonzero(sum(np.abs(x[:width]) for x in links))
    return {
        "names": names,
        "index": {features[j]: i for i, j in enumerate(used)},
        "threshold": _threshold(packs, weight),
        "links": [{"words": x[used], "links": x[width:-1], "bias": float(x[-1])} for x in links],
    }


def _threshold(packs: Held | Dealt, weight: tuple[float, float]) -> float:
    """The cut on out-of-fold probabilities with the best F1 at the classes' weights; in the middle of equals."""
    cuts = np.linspace(0.02, 0.98, 97)

    def reached(pack: Pack) -> np.ndarray:
        cut = np.searchsorted(cuts, pack.dense[:, -1], side="right")
        return np.concatenate([np.bincount(cut[pack.y == k], minlength=len(cuts) + 1) for k in (0, 1)]).astype(float)

    others, marked = packs.total(reached).reshape(2, -1)
    false, hit = (weight[k] * x[::-1].cumsum()[::-1][1:] for k, x in ((0, others), (1, marked)))
    f1 = 2 * hit / np.maximum(hit + false + weight[1] * marked.sum(), 1e-12)
    return float(np.median(cuts[f1 >= f1.max() - 1e-12]))


def _constant(label: str, others: int, marked: int) -> dict:
    return {"names": [label], "constant": float((marked + 1) / (others + marked + 2)), "threshold": 0.5}


def _learned(features: list[str], marked: np.ndarray, others: np.ndarray, packs: Held | Dealt, label: str, shares: tuple[float, float], n: tuple[int, int]) -> dict:
    """The chain on packs of ``features``, which come with their counts, the most telling first."""
    first = np.arange(len(features)) < TELLING
    commoner = np.flatnonzero(first & (marked / n[1] > others / n[0]))
    group = find_categories(packs, commoner if len(commoner) else np.flatnonzero(first), len(features))
    sizes = packs.total(lambda pack: _has(pack, group).sum(axis=0).astype(float))
    weight = np.array([shares[0] / n[0], shares[1] / n[1]])
    weight /= (weight @ n) / sum(n)
    return fit_chain(packs, features, group, [j for j in range(CATEGORIES) if sizes[j] >= 4], label, (float(weight[0]), float(weight[1])))


def fit(rows: list[tuple[int, str, int]], label: str, shares: tuple[float, float]) -> dict:
    """The chain for (doc_id, text, y) in memory; ``shares`` are the classes' shares among all labels."""
    marked = sum(y for _, _, y in rows)
    n = (len(rows) - marked, marked)
    if too_few(*n):
        return _constant(label, *n)
    counts: dict[str, np.ndarray] = {}
    for names, pos, neg in _counted((t, y) for _, t, y in rows):
        for f, a, b in zip(names, pos, neg, strict=True):
            counts[f] = counts.get(f, 0) + np.array([a, b])
    kept = sorted(f for f, c in counts.items() if c.sum() >= LEAST_DF)
    pos, neg = np.array([counts[f] for f in kept]).reshape(-1, 2).T
    order = np.argsort(-np.abs(_z(pos, neg, n[1], n[0])), kind="stable")[:FEATURES]
    features = [kept[i] for i in order]
    packs = Held(list(_packed(((t, y) for _, t, y in rows), {f: i for i, f in enumerate(features)})))
    return _learned(features, pos[order], neg[order], packs, label, shares, n)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict:
    """Fit on all labelled rows; the classes' shares come from all labels.

    Texts stay in the tasks.  Features are counted over all rows, the chosen ones' numbers are kept in
    packs, and every step of a fit adds up the packs' gradients.
    """
    shares = class_shares(labels, label)
    rows = labelled(docs, labels, label)
    n = class_counts(rows)
    if too_few(*n):
        return _constant(label, *n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lot in by_lot(batches):
            for names, pos, neg in _counted(lot):
                for i in range(0, len(names), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 50_000], pa.string()), pa.array(pos[i : i + 50_000], pa.int64()), pa.array(neg[i : i + 50_000], pa.int64())], names=["feature", "pos", "neg"])

    counts = rows.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    q = (F.col("pos") + F.col("neg")) / F.lit(float(sum(n)))
    z = (F.col("pos") / F.lit(float(n[1])) - F.col("neg") / F.lit(float(n[0]))) / F.sqrt(q * (1 - q) * F.lit(1 / n[1] + 1 / n[0]) + F.lit(1e-12))
    best = counts.where(F.col("pos") + F.col("neg") >= LEAST_DF).withColumn("z", F.abs(z)).orderBy(F.desc("z"), "feature").limit(FEATURES).toArrow()
    features = best.column("feature").to_pylist()
    index = {f: i for i, f in enumerate(features)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lot in by_lot(batches):
            for p in _packed(lot, index):
                yield pa.RecordBatch.from_pylist([p], schema=pa.schema([(c, pa.binary()) for c in PACK]))

    packs = Dealt(written(rows.mapInArrow(pack, ", ".join(f"{c} binary" for c in PACK))))
    return _learned(features, best.column("pos").to_numpy(), best.column("neg").to_numpy(), packs, label, shares, n)


def _apply_link(link: dict, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
    return _probability(np.bincount(rows, link["words"][cols], n) + dense @ link["links"] + link["bias"])


def chain_column(text: Column, model: dict) -> Column:
    """A struct with the probability of every link, in the chain's order."""
    names = model["names"]

    @F.pandas_udf(T.StructType([T.StructField(x, T.DoubleType()) for x in names]))
    def chain(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if "constant" in model:
            for batch in batches:
                yield pd.DataFrame({x: np.full(len(batch), model["constant"]) for x in names})
            return
        index, known = model["index"], {}
        for batch in batches:
            rows, cols = [], []
            for i, text in enumerate(batch):
                hits = set()
                for w in words(text):
                    ids = known.get(w)
                    if ids is None:
                        if len(known) > 500_000:
                            known.clear()
                        ids = known[w] = tuple(index[f] for f in parts(w) if f in index)
                    hits.update(ids)
                rows.extend([i] * len(hits))
                cols.extend(hits)
            r, c = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)
            dense = np.zeros((len(batch), 0))
            for link in model["links"]:
                dense = np.c_[dense, _apply_link(link, r, c, dense, len(batch))]
            yield pd.DataFrame(dense, columns=names)

    return chain(text)


def with_toxicity(docs: DataFrame, model: dict, out: str = "toxicity") -> DataFrame:
    """All rows and columns of ``docs`` with the struct ``out`` of the links' probabilities."""
    return docs.withColumn(out, chain_column(F.col("text"), model))
