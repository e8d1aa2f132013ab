"""Quality classifier: naive Bayes support vectors.

A text is the set of its hashed n-grams: words and symbol runs alone and in
pairs, and triples of their shapes (case, digits, symbols, repetition of a
neighbour).  Each indicator is scaled by the log ratio of its smoothed counts in
the two classes; a linear hinge-loss model is fitted to the scaled, normalised
indicators by dual coordinate descent, and its margins are calibrated to
probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .labelled import training_texts
from .textbytes import LOWER, append_columns, chunks, mix64, slice_hashes, string_buffers

#: Hash buckets of n-gram indicators: the size of the model.
BUCKETS = 1 << 18
#: Training documents of each class, at most.
PER_CLASS = 3000
COST = 1.0
EPOCHS = 20
#: Share of the hinge-loss weights; the rest is the naive Bayes mean.
BETA = 0.5
_SHIFT = np.uint64(64 - 18)

_KIND = np.full(256, 2, np.uint8)  # 0 blank, 1 word, 2 symbol
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1


def _tokens(data: np.ndarray, off: np.ndarray):
    """Runs of word bytes and of symbol bytes: starts, ends, rows, whether words."""
    kind = _KIND[data]
    begin = np.ones(len(kind), bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin[off[:-1][off[:-1] < len(kind)]] = True
    s = np.flatnonzero(begin)
    e = np.append(s[1:], len(kind))
    real = kind[s] != 0
    s, e = s[real], e[real]
    return s, e, np.searchsorted(off, s, side="right") - 1, kind[s] == 1


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a chunk's texts, sorted."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z
    s, e, row, word = _tokens(data, off)
    if not len(s):
        z = np.zeros(0, np.int64)
        return z, z
    low = slice_hashes(LOWER[data], s, e)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data < 91))])
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
    size = e - s
    caps, digits = upper[e] - upper[s], digit[e] - digit[s]
    shape = np.where(digits > 0, 4, np.where((caps == size) & (size > 1), 3, np.where(caps > 0, 2, 1))).astype(np.uint64)
    shape = np.where(word, shape, low)
    again = np.zeros(len(s), bool)
    again[1:] = (low[1:] == low[:-1]) & (row[1:] == row[:-1])
    shape = np.where(again, np.uint64(7), shape)
    with np.errstate(over="ignore"):
        one = low
        two = mix64(low[:-1] * np.uint64(3) + low[1:] + np.uint64(11))
        three = mix64((shape[:-2] * np.uint64(31) + shape[1:-1]) * np.uint64(37) + shape[2:] + np.uint64(13))
    rows = [row, row[1:][row[1:] == row[:-1]], row[2:][row[2:] == row[:-2]]]
    keys = [one, two[row[1:] == row[:-1]], three[row[2:] == row[:-2]]]
    pair = np.unique(np.concatenate(rows).astype(np.int64) << 18 | (np.concatenate(keys) >> _SHIFT).astype(np.int64))
    return pair >> 18, pair & (BUCKETS - 1)


class Model:
    """Weight and naive Bayes scale per bucket, and the calibration of the margin."""

    def __init__(self, weight: np.ndarray, scale: np.ndarray, bias: float, slope: float, shift: float):
        self.weight, self.square = (weight * scale).astype(np.float32), (scale * scale).astype(np.float32)
        self.bias, self.slope, self.shift = bias, slope, shift

    def margins(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(row, self.weight[bucket], minlength=n)
        norm = np.sqrt(np.bincount(row, self.square[bucket], minlength=n))
        return total / np.maximum(norm, 1e-9) + self.bias

    def scores(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        z = self.slope * self.margins(row, bucket, n) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through weighted labels (Newton
    steps on smoothed targets, so that separable margins stay finite)."""
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        d, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margin).sum() + 1e-3 * a, d.sum()])
        m = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        step = np.clip(np.linalg.solve(m, g), -5, 5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int,
                 epochs: int = EPOCHS) -> np.ndarray:
    """Linear hinge-loss weights (last entry: the constant feature 1) by dual
    coordinate descent; each row's multiplier stays within 0 and its cost."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    sign = np.where(y == 1, 1.0, -1.0)
    square = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + w[size]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                w[size] += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return w


def solve(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> Model:
    """Fit on distinct buckets per training document."""
    counts = [np.ones(BUCKETS), np.ones(BUCKETS)]
    for r, c in zip(rows, y, strict=True):
        counts[c][r] += 1
    scale = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [scale[r] / max(np.linalg.norm(scale[r]), 1e-9) for r in rows]
    share = np.bincount(y, minlength=2)
    cost = COST * np.where(y == 1, len(y) / (2 * max(share[1], 1)), len(y) / (2 * max(share[0], 1)))
    w = dual_descent(rows, values, y, cost, BUCKETS)
    mean = np.abs(w[:-1]).sum() / max(np.count_nonzero(w[:-1]), 1)
    mixed = (1 - BETA) * mean + BETA * w[:-1]
    model = Model(mixed, scale, BETA * w[-1], 1.0, 0.0)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    model.slope, model.shift = platt(model.margins(owner, flat, len(rows)), y, weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", per_class: int = PER_CLASS) -> Model | None:
    """Learn ``label`` from at most ``per_class`` documents of each class that
    ``learn`` admits (the lowest by hash of the id).  None unless both classes
    occur."""
    def make():
        def fn(batch: pa.RecordBatch):
            data, off = string_buffers(batch.column(0))
            out = []
            for lo, hi, part, o in chunks(data, off):
                row, bucket = features(part, o)
                ends = np.searchsorted(row, np.arange(1, hi - lo + 1))
                out += [x.astype("<i4").tobytes() for x in np.split(bucket, ends[:-1])]
            return [pa.array(out, pa.binary())]
        return fn
    train = training_texts(docs, labels, label, learn, per_class, id_col, text_col)
    rows = append_columns(train, [("buckets", "binary")], make, ["text"], drop=["text"]).orderBy(id_col).collect()
    y = np.array([r.y for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    return solve([np.frombuffer(bytes(r.buckets), "<i4") for r in rows], y, np.array([r.w for r in rows]))


def classify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Append ``score`` (0 to 1, higher: label 1 likelier).  Null and empty
    texts get the score of a text without n-grams; without a model every
    score is 0.5.  A column named score is replaced; repeated rows are scored
    alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m: Model | None = shared.value

        def fn(batch: pa.RecordBatch):
            data, off = string_buffers(batch.column(0))
            score = np.full(batch.num_rows, 0.5)
            for lo, hi, part, o in chunks(data, off) if m else ():
                score[lo:hi] = m.scores(*features(part, o), hi - lo)
            return [pa.array(score)]
        return fn
    return append_columns(docs, [("score", "double")], make, [text_col])
