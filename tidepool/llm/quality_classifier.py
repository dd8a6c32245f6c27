"""Quality classifier: a support vector machine on Naive Bayes features.

A text's features are indicators of hashed byte 2- and 3-grams, and of how large a share of its 3-word
windows occurred earlier in it.  Each indicator is scaled by the log of the ratio of its smoothed counts
in the two classes, rows are brought to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent.  A logistic curve fitted on a fifth of the sample that the model has not seen turns
margins into scores.

The model is fitted on at most ``sample_rows`` labelled rows, those with the least hash of doc_id; only
their feature numbers travel to the driver.  Scoring reads every text once, without a shuffle.

Defined cases: null and empty texts have no features and get the score of the intercept.  A document with
several labels counts as good if their mean is at least 1/2; null labels are not used.  Without labels of
both kinds every score is 1/2.  Repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, blocks, row_of, texts_of, word_spans, word_units

BITS = 16
SIZE = 1 << BITS
#: Indicators above the hashed ones: the share of repeated windows is over 1/16, 2/16, ... .
SHARES = 8


def _codes(data: np.ndarray) -> np.ndarray:
    """Hashed byte 2- and 3-grams of one text."""
    if len(data) < 2:
        return np.zeros(0, np.uint32)
    x = data.astype(np.uint32)
    two = x[:-1] << np.uint32(8) | x[1:]
    three = two[:-1] << np.uint32(8) | x[2:]
    grams = np.concatenate((two | np.uint32(1 << 24), three))
    return (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def features(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each row of a block: which of the SIZE + SHARES indicators are on."""
    starts, ends, first = word_spans(data, at)
    windows = RollingHash(word_units(data, starts, ends)).windows(3) if len(starts) > 2 else np.zeros(0, np.uint64)
    n_windows = np.maximum(np.diff(first) - 2, 0)
    row = row_of(n_windows)
    own = windows[first[:-1][row] + np.arange(len(row)) - (np.cumsum(n_windows) - n_windows)[row]]
    order = np.lexsort((own, row))
    again = np.zeros(len(row), bool)
    again[1:] = (own[order][1:] == own[order][:-1]) & (row[order][1:] == row[order][:-1])
    repeated = np.bincount(row[order][again], minlength=len(n_windows))
    for k in range(rows.num_rows):
        on = np.zeros(SIZE + SHARES, bool)
        on[_codes(data[at[k] : at[k + 1]])] = True
        on[SIZE : SIZE + int(16 * repeated[k] / max(1, n_windows[k]))] = True
        yield on


@dataclass
class Model:
    """weight and scale by feature; a margin is sum(weight) / sqrt(sum(scale squared)) + intercept over the features that are on."""

    weight: np.ndarray
    square: np.ndarray
    intercept: float
    slope: float
    shift: float

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -50, 50)))

    def margin(self, on: np.ndarray) -> float:
        norm = float(self.square[on].sum())
        return (float(self.weight[on].sum()) / norm**0.5 if norm else 0.0) + self.intercept


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, good: np.ndarray, c: float, rounds: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-regularised hinge-loss model, one dual variable at a time within [0, c]."""
    y = np.where(good, 1.0, -1.0)
    values = [scale[x] / max(1e-12, float(np.sqrt((scale[x] ** 2).sum()))) for x in rows]
    w, b, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            x, v = rows[i], values[i]
            gradient = y[i] * (v @ w[x] + b) - 1
            step = min(max(alpha[i] - gradient / 2.0, 0.0), c) - alpha[i]  # a unit row and the intercept: 1 + 1
            if step:
                alpha[i] += step
                w[x] += step * y[i] * v
                b += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def _logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, by Newton's method on smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        h = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-6:
            break
    return max(a, 0.1), b


def fit_rows(ids: list[int], rows: list[np.ndarray], good: np.ndarray, c: float = 1.0, rounds: int = 30, smoothing: float = 1.0) -> Model:
    """A model from the features that are on in each labelled row."""
    n = SIZE + SHARES
    if len(set(good.tolist())) < 2:
        return Model(np.zeros(n, np.float32), np.zeros(n, np.float32), 0.0, 1.0, 0.0)

    def train(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        counts = np.full((2, n), smoothing)
        for k in chosen:
            counts[int(good[k]), rows[k]] += 1
        scale = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        w, b = dual_descent([rows[k] for k in chosen], scale, good[chosen], c, rounds)
        return w * scale, scale**2, b

    aside = np.array([zlib.crc32(b"calibrate %d" % i) % 5 == 0 for i in ids])
    if len(set(good[aside].tolist())) == 2 == len(set(good[~aside].tolist())):
        seen = Model(*train(np.flatnonzero(~aside)), 1.0, 0.0)
        slope, shift = _logistic(np.array([seen.margin(rows[k]) for k in np.flatnonzero(aside)]), good[aside])
    else:
        slope, shift = 1.0, 0.0
    weight, square, b = train(np.arange(len(rows)))
    return Model(weight.astype(np.float32), square.astype(np.float32), b, slope, shift)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: the crc32 of doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, label: str = "quality") -> Model:
    """Fit on the labelled rows that are not held out, at most sample_rows of them."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col(label).cast("double").alias("given"))
        .dropna()
        .filter(~held_out(F.col("labelled_id")))
        .groupBy("labelled_id")
        .agg((F.avg("given") >= 0.5).alias("good"))
        .orderBy(F.xxhash64("labelled_id"), "labelled_id")
        .limit(sample_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches):
            on = [np.flatnonzero(x).astype("<i4").tobytes() for x in features(rows, data, at)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("good"), pa.array(on, pa.binary())], ["doc_id", "good", "features"])

    labelled = texts_of(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "good")
    once = labelled.mapInArrow(run, "doc_id long, good boolean, features binary").groupBy("doc_id", "good").agg(F.min("features").alias("features"))
    got = once.orderBy("doc_id").collect()  # at most sample_rows rows of at most SIZE + SHARES numbers
    return fit_rows([r.doc_id for r in got], [np.frombuffer(r.features, "<i4") for r in got], np.array([r.good for r in got], bool))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, data, at in blocks(batches):
            margins = np.array([m.margin(on) for on in features(rows, data, at)])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(m.scores(margins), pa.float64())], ["doc_id", "score"])

    scored = texts_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, with all their columns, whose score is at least threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, data, at in blocks(batches):
            good = m.scores(np.array([m.margin(on) for on in features(rows, data, at)])) >= threshold
            yield rows.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
