"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over the presence of hashed words and stems learn from confirmed toxic texts and unlabelled ones. The risk of
the negative class is estimated from the unlabelled texts less the class prior's part of the toxic ones; where that
estimate falls below zero, the step is taken against it, which keeps the classifier from memorising the positives.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .common import cut, stored
from .near import text_print

BITS = 20
DIMS = 1 << BITS
#: Bounds of the labelled samples that reach the driver: confirmed toxic, labelled harmless (for calibration).
MAX_TOXIC, MAX_HARMLESS = 4000, 6000
#: None: every unlabelled row counts, in sums that Spark makes. A number: a sample of so many texts is learned from instead.
MAX_UNLABELLED: int | None = None
#: Steps over all unlabelled rows, and their rate; more partial sums than ADDED are added up in tasks first.
STEPS, RATE, ADDED = 100, 0.2, 64
#: How many standard errors a feature must stand out by; the left-out folds tell which serves best.
LIFTS = (4.0, 6.0, 10.0)
#: Tasks that count the samples' features.
COUNTERS = 8

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Stems: so many first bytes of longer words; they count as a feature of their own when so many different words share one.
STEMS, SHARED = (4, 6, 7), (1, 2, 3)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the distinct lower-cased words of each text, and of the stems of one, two and three of them."""
    data, offs = ta.as_bytes(column)
    data = _LOWER[data]
    start, end, doc = ta.runs(_LETTER[data], offs)
    prints, own = ta.Prints(data), doc.astype(np.uint64) << np.uint64(40)
    words, at = np.unique(own | prints.of(start, end) >> np.uint64(24), return_index=True)
    keys, tags = [words], [0]
    for n in STEMS:
        k = at[end[at] - start[at] > n]
        stem, count = np.unique(own[k] | prints.of(start[k], start[k] + n) >> np.uint64(24), return_counts=True)
        for times in SHARED:
            keys.append(stem[count >= times])
            tags.append(10 * n + times)
    low = np.uint64((1 << 40) - 1)
    both = np.sort(np.concatenate([k >> np.uint64(40) << np.uint64(BITS) | ta.mix64((k & low) + (np.uint64(t) << np.uint64(40))) >> np.uint64(64 - BITS) for k, t in zip(keys, tags)]))
    both = both[np.concatenate((np.ones(min(len(both), 1), bool), both[1:] != both[:-1]))]
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64(DIMS - 1)).astype(np.int64)


def logits(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    doc, f = features(column)
    return bias + np.bincount(doc, weights[f], minlength=len(column))


@dataclass
class Sparse:
    """Rows of features as one array with row boundaries."""

    at: np.ndarray
    row: np.ndarray
    n: int

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Sparse:
        return cls(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]).astype(np.int64), len(rows))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], minlength=self.n)

    def back(self, g: np.ndarray, dims: int) -> np.ndarray:
        return np.bincount(self.at, g[self.row], minlength=dims)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(z, -60, 60) / 2))


def lifted(toxic: list[np.ndarray], unlabelled: list[np.ndarray], dims: int, least: float = 4.0) -> np.ndarray:
    """Features whose share of the toxic texts exceeds that of the unlabelled by so many standard errors."""
    return standing_out([np.bincount(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64), minlength=dims) for x in (toxic, unlabelled)], [len(toxic), len(unlabelled)], least)


def standing_out(df: list[np.ndarray], texts: list[int], least: float = 4.0) -> np.ndarray:
    """lifted() from the texts that have each feature, and all texts."""
    n = [max(x, 1) for x in texts]
    both = (df[0] + df[1] + 0.5) / (n[0] + n[1] + 1)
    z = (df[0] / n[0] - df[1] / n[1]) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]) + 1e-12)
    return (z > least) & (df[0] >= min(2, texts[0]))


def fit_nnpu(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 200, rate: float = 0.1, shrink: float = 1e-4, dims: int = DIMS, least: float = LIFTS[0]) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk  prior * Rp+ + max(0, Ru- - prior * Rp-)  of the logistic loss.

    Only features that are far more frequent among the toxic texts than among the unlabelled get a weight.
    """
    known = lifted(toxic, unlabelled, dims, least)
    index = np.cumsum(known) - 1
    d = int(known.sum())
    x, u = (Sparse.of([index[r[known[r]]] for r in rows]) for rows in (toxic, unlabelled))
    w, b = np.zeros(d), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        zp, zu = x.times(w) + b, u.times(w) + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gn_p, gn_u = -prior * sigmoid(zp) / max(x.n, 1), sigmoid(zu) / max(u.n, 1)
        if negative < 0:
            gp, gu = -gn_p, -gn_u
        else:
            gp, gu = gn_p - prior * sigmoid(-zp) / max(x.n, 1), gn_u
        g = np.append(x.back(gp, d) + u.back(gu, d) + shrink * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    out = np.zeros(dims)
    out[known] = w
    return out, float(b)


def unlabelled_counts(docs: DataFrame, toxic: np.ndarray, fold: Callable[[int], int], folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all rows of docs, by fold: how many have each feature of the mask toxic, and how many rows there are.

    Each task counts for itself; its sums are shuffled by feature, so that the driver gets folds * features of them at most.
    """
    at, d = np.flatnonzero(toxic), int(toxic.sum())
    place = docs.sparkSession.sparkContext.broadcast(np.where(toxic, np.cumsum(toxic) - 1, -1).astype("<i4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(folds * (d + 1), np.int64)  # a fold's last place counts its rows
        for batch in ta.chunks(batches, limit=1 << 18):
            own = np.array([fold(i) for i in batch.column(0).to_pylist()], np.int64) * (d + 1)
            doc, f = features(batch.column(1))
            f = place.value[f]
            df += np.bincount(np.concatenate((own[doc[f >= 0]] + f[f >= 0], own + d)), minlength=len(df))
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(df[k], pa.int64())], ["k", "n"])

    sums = docs.select("doc_id", "text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(folds * (d + 1), np.int64)
    df[sums["k"].to_numpy()] = sums["n"].to_numpy()
    df, out = df.reshape(folds, d + 1), np.zeros((folds, len(toxic)), np.int64)
    out[:, at] = df[:, :d]
    return out, df[:, d]


def unlabelled_sets(docs: DataFrame, known: np.ndarray, fold: Callable[[int], int]) -> DataFrame:
    """fold, f (the places, among those of the mask known, of a row's features, as 32-bit integers) and n, the rows that
    have these and no others: equal rows are one before they are shuffled."""
    place = docs.sparkSession.sparkContext.broadcast(np.where(known, np.cumsum(known) - 1, -1).astype("<i4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.chunks(batches, limit=1 << 18):
            doc, f = features(batch.column(1))
            f = place.value[f]
            doc, f = doc[f >= 0], f[f >= 0]
            data = f.tobytes()
            ends = 4 * np.searchsorted(doc, np.arange(batch.num_rows + 1))
            sets = pa.array([data[i:j] for i, j in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([fold(i) for i in batch.column(0).to_pylist()], pa.int32()), sets], ["fold", "f"])

    return docs.select("doc_id", "text").mapInArrow(run, "fold int, f binary").groupBy("fold", "f").agg(F.count("*").alias("n"))


def unlabelled_sums(sets: DataFrame, w: np.ndarray, b: np.ndarray, left_out: list[int], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each model (a row of w, b): the sum of the negative loss over the rows of the folds it doesn't leave out, and that
    of its gradient by the weights and the bias."""
    models, d = w.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((models, d + 2))
        for batch in batches:
            own, f, n = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            ends = np.frombuffer(f.buffers()[1], "<i4")[f.offset : f.offset + len(f) + 1].astype(np.int64)
            at = np.frombuffer(f.buffers()[2][ends[0] : ends[-1]], "<i4") if ends[-1] > ends[0] else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(f)), np.diff(ends) // 4)
            for j in range(models):
                z, weight = np.bincount(row, w[j][at], minlength=len(f)) + b[j], n * (own != left_out[j])
                g = weight * sigmoid(z)
                out[j] += np.concatenate((np.bincount(at, g[row], minlength=d), [g.sum(), (weight * np.logaddexp(0, z)).sum()]))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(s, np.float64) for batch in batches for s in batch.column(0).to_pylist()]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(own, axis=0).tobytes()], pa.binary())], ["s"])

    sums = sets.mapInArrow(run, "s binary")
    if parts > ADDED:
        sums = sums.repartition(ADDED).mapInArrow(add, "s binary")
    out = np.sum([np.frombuffer(r.s, np.float64) for r in sums.collect()], axis=0).reshape(models, d + 2)
    return out[:, -1], out[:, :-1]


def fit_nnpu_spread(toxic: list[list[np.ndarray]], sets: DataFrame, unlabelled: list[int], prior: float, masks: list[tuple[int, np.ndarray]], steps: int = STEPS, rate: float = RATE, shrink: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """fit_nnpu's classifiers, one for each (fold left out, mask of features) of masks, from all unlabelled rows: each step
    sums the risk and its gradient over sets (unlabelled_sets) in Spark, for all classifiers at once.

    toxic: for each fold left out, the toxic texts' places of features. unlabelled: likewise, how many rows there are.
    """
    d = len(masks[0][1])
    left_out, mask = [k for k, _ in masks], np.array([np.append(own, True) for _, own in masks])
    x = [Sparse.of(rows) for rows in toxic]
    w, m, v = (np.zeros((len(masks), d + 1)) for _ in range(3))
    w[:, -1] = np.log(prior / (1 - prior))
    parts = sets.rdd.getNumPartitions()
    for t in range(1, steps + 1):
        loss, sums = unlabelled_sums(sets, w[:, :-1], w[:, -1], left_out, parts)
        g = np.zeros_like(w)
        for j, k in enumerate(left_out):
            n, own = max(unlabelled[k], 1), x[k]
            zp = own.times(w[j, :-1]) + w[j, -1]
            gn_p, gu = -prior * sigmoid(zp) / max(own.n, 1), sums[j] / n
            if loss[j] / n < prior * np.logaddexp(0, zp).mean():
                gp, gu = -gn_p, -gu
            else:
                gp = gn_p - prior * sigmoid(-zp) / max(own.n, 1)
            g[j] = np.append(own.back(gp, d), gp.sum()) + gu + shrink * np.append(w[j, :-1], 0)
        g *= mask
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return [(row[:-1], float(row[-1])) for row in w]


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a > 0 and b of sigmoid(a z + b), by Newton steps on the weighted log loss with a small ridge."""
    scale = max(float(np.std(z)), 1e-9)
    x = np.column_stack((z / scale, np.ones(len(z))))
    t = np.zeros(2)
    for _ in range(40):
        p = sigmoid(x @ t)
        g = x.T @ (weight * (p - y)) + np.array([1e-4, 0]) * t * weight.sum()
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-4 * weight.sum()
        t = t - np.clip(np.linalg.solve(h, g), -2, 2)
    return max(float(t[0]) / scale, 1e-6), float(t[1])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def sampled_texts(docs: DataFrame, wanted: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """doc_id, t0, t1 (the print of a text) and part: at most sizes[part] different texts of the ids wanted for each part,
    one of each id before any id's second."""
    keys = ["part", "doc_id", "t0", "t1"]
    t0, t1 = text_print("text")
    own = cut(docs.select("doc_id", t0.alias("t0"), t1.alias("t1")).join(F.broadcast(wanted), "doc_id").select(keys).distinct())
    first = own.groupBy("part", "doc_id").agg(F.min(F.struct("t0", "t1")).alias("first"))
    own = own.join(F.broadcast(first), ["part", "doc_id"]).select(*keys, (F.struct("t0", "t1") != F.col("first")).alias("further"))
    out = [own.filter(F.col("part") == k).orderBy("further", F.xxhash64("doc_id", "t0", "t1"), "doc_id", "t0", "t1").limit(n).select(keys) for k, n in enumerate(sizes)]
    return reduce(DataFrame.unionByName, out)


def sampled(ids: DataFrame, n: int) -> DataFrame:
    """At most n rows, the first by a hash of their id."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        return sigmoid(logits(column, self.weights, self.bias))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3) -> Model:
    """Fits one classifier for each fold on the rest, calibrates on the scores of the left-out fold, and averages; of LIFTS,
    the one with the least loss on the left-out folds.

    docs: doc_id, text. labels: doc_id, toxic; ids with conflicting labels count as toxic. Held-out ids give neither
    labels nor texts. Without toxic labels every text scores 0. All other rows count as unlabelled, repeated ones each, in
    sums made in Spark (MAX_UNLABELLED None); of the labelled, bounded samples are learned from, each text of an id once.
    """
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = {int(r[0]): r[1] for r in own.groupBy("toxic").count().collect()}
    if not known.get(1):
        return Model(np.zeros(DIMS, np.float32), -60.0)
    prior = min(max(known[1] / sum(known.values()), 1e-4), 0.9)
    others = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text")
    sizes = (MAX_TOXIC, MAX_HARMLESS) + (() if MAX_UNLABELLED is None else (MAX_UNLABELLED,))
    wanted = sampled(own.filter("toxic = 1").select("doc_id"), MAX_TOXIC).select("doc_id", F.lit(0).alias("part"))
    wanted = wanted.unionByName(sampled(own.filter("toxic = 0").select("doc_id"), MAX_HARMLESS).select("doc_id", F.lit(1).alias("part")))
    if MAX_UNLABELLED is not None:
        wanted = wanted.unionByName(sampled(others.select("doc_id").distinct(), MAX_UNLABELLED).select("doc_id", F.lit(2).alias("part")))
    wanted = sampled_texts(docs, wanted, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of the bounded sample
        for batch in batches:
            new = []
            for i, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            for own in ta.chunks([batch.take(pa.array(new, pa.int64()))], limit=1 << 18):
                doc, f = features(own.column(4))
                rows = np.split(f.astype("<i4"), np.searchsorted(doc, np.arange(1, own.num_rows)))
                yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array([r.tobytes() for r in rows], pa.binary())], [*keys, "f"])

    fold = lambda i: (i * 2654435761 >> 8) % folds

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of this task with each feature, by part and fold."""
        df: dict[tuple[int, int], list] = {}
        for batch in batches:
            for i, part, f in zip(*(c.to_pylist() for c in batch.columns)):
                own = df.setdefault((part, fold(i)), [0, np.zeros(DIMS, "<i4")])
                own[0] += 1
                own[1][np.frombuffer(f, "<i4")] += 1
        rows = [(part, k, n, zlib.compress(x.tobytes(), 1)) for (part, k), (n, x) in df.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["part", "fold", "n", "df"])

    # wanted has a bounded number of rows (the three sample sizes); repeated rows of a text count once
    keys = ["doc_id", "part", "t0", "t1"]
    t0, t1 = text_print("text")
    whole = docs.select("doc_id", t0.alias("t0"), t1.alias("t1"), "text").join(F.broadcast(wanted), ["doc_id", "t0", "t1"]).select(*keys, "text")
    whole = whole.mapInArrow(run, "doc_id long, part int, t0 long, t1 long, f binary")
    whole = cut(whole.groupBy(keys).agg(F.any_value("f").alias("f")).select("doc_id", "part", "f"))
    # few tasks, since each sends counts for every feature
    df, texts = np.zeros((2, folds, DIMS), np.int64), np.zeros((2, folds), int)
    for r in whole.filter("part <> 1").coalesce(COUNTERS).mapInArrow(count, "part int, fold int, n long, df binary").collect():
        df[r.part // 2, r.fold] += np.frombuffer(zlib.decompress(r.df), "<i4")
        texts[r.part // 2, r.fold] += r.n
    if not texts[0].sum():
        return Model(np.zeros(DIMS, np.float32), -60.0)
    if MAX_UNLABELLED is None:
        df[1], texts[1] = unlabelled_counts(others, df[0].sum(axis=0) >= min(2, texts[0].sum()), fold, folds)

    def stands_out(k: int, least: float) -> np.ndarray:
        rest = [np.arange(folds) != k if p or texts[0].sum() > texts[0, k] else np.full(folds, True) for p in range(2)]
        return standing_out([df[p][rest[p]].sum(axis=0) for p in range(2)], [int(texts[p][rest[p]].sum()) for p in range(2)], least)

    # other features get no weight in any fold, so that only these are sent
    known = np.logical_or.reduce([stands_out(k, LIFTS[0]) for k in range(folds)])
    masks = [(k, stands_out(k, least)[known]) for least in LIFTS for k in range(folds)]
    del df
    shipped = docs.sparkSession.sparkContext.broadcast(known)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(f, "<i4") for f in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[shipped.value[f]].tobytes() for f in rows], pa.binary())], ["doc_id", "part", "f"])

    found = whole.mapInArrow(keep, "doc_id long, part int, f binary").collect()
    found.sort(key=lambda r: (r.part, r.doc_id, r.f))
    parts = [[(int(r.doc_id), np.frombuffer(r.f, "<i4").astype(np.int64)) for r in found if r.part == k] for k in range(3)]
    toxic = [[f for i, f in parts[0] if fold(i) != k] or [f for _, f in parts[0]] for k in range(folds)]
    if MAX_UNLABELLED is None:
        place = np.cumsum(known) - 1
        found = fit_nnpu_spread([[place[f] for f in rows] for rows in toxic], stored(unlabelled_sets(others, known, fold)), [int(texts[1].sum() - texts[1, k]) for k in range(folds)], prior, masks)
    tried = []
    for nth, least in enumerate(LIFTS):
        fits, z, y = [], [], []
        for k in range(folds):
            if MAX_UNLABELLED is None:
                w = np.zeros(DIMS)
                w[known], b = found[nth * folds + k]
            else:
                w, b = fit_nnpu(toxic[k], [f for i, f in parts[2] if fold(i) != k], prior, least=least)
            fits.append((w, b))
            for part, value in ((0, 1), (1, 0)):
                for i, f in parts[part]:
                    if fold(i) == k:
                        z.append(w[f].sum() + b)
                        y.append(value)
        z, y = np.array(z), np.array(y, float)
        share = np.where(y == 1, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1)) * len(y)
        a, c = platt(z, y, share)
        loss = float((share * np.logaddexp(0, np.where(y == 1, -1, 1) * (a * z + c))).sum())
        w, b = np.mean([w for w, _ in fits], axis=0), float(np.mean([b for _, b in fits]))
        tried.append((loss, Model((a * w).astype(np.float32), a * b + c)))
    return min(tried, key=lambda t: t[0])[1]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row. A null text counts as empty; repeated rows and null ids are scored like any other; no
    rows give no rows."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.chunks(batches, limit=1 << 18):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shipped.value.scores(batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.chunks(batches, limit=1 << 18):
            column = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array(shipped.value.scores(column) < threshold))

    return docs.mapInArrow(ta.frees(run), docs.schema)


def rate_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    Null and empty texts get the score of a text without words; a null doc_id isn't held out, but is never learned from.
    Equal texts get equal scores, whatever their ids. Other columns are left out; no rows give no rows.
    """
    return score(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
