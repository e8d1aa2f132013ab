"""Toxic passages as maximum-scoring segments of token log-odds.

Every token gets the log-odds of the toxic against the clean class (by the
training texts that have the word) under Dirichlet priors that are nested: a word's prior mean is the estimate for its
first six bytes, whose prior mean is that for the first four, so unseen forms
of a known stem still count.  A linear-time scan finds all maximal segments of
a text.  The scores of best segments in clean text follow an extreme-value
law; its two parameters, fitted on clean training texts, turn segment scores
into E-values, and a document's significant segments into one statistic, which
a logistic curve maps to a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import training_texts
from .nbsvm import platt
from .scratch import stored
from .textbytes import LOWER, append_columns, chunks, runs, slice_hashes, string_buffers

#: Training documents of each class, at most.
PER_CLASS = 10_000
#: Weight of a prior, in tokens.
PRIOR = 8.0
#: Taken off every token, so that clean text has a falling score.
DRIFT = 0.7
#: Passages are significant below this E-value (expected number in clean text of that length).
SIGNIFICANT = 0.05
#: Largest rate of the extreme-value law; log ratios without drift have rate 1.
MAX_RATE = 4.0
_STEMS = (4, 6)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True


def _token_keys(data: np.ndarray, off: np.ndarray):
    """Starts, ends and rows of the lower-cased words; hashes of words and stems."""
    low = LOWER[data]
    s, e, row = runs(_IS_WORD[low], off)
    return s, e, row, [slice_hashes(low, s, np.minimum(e, s + k)) for k in _STEMS] + [slice_hashes(low, s, e)]


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, after the last, score) of a text in
    linear time (Ruzzo and Tompa).  Runs of positive scores go in as wholes."""
    up = score > 0
    if not up.any():
        return []
    total = np.concatenate([[0.0], np.cumsum(score)])
    a, b, _ = runs(up, np.array([0, len(up)]))
    found: list[list] = []  # first, after, total before, total after, index of the last one with less before it
    for first, after in zip(a.tolist(), b.tolist(), strict=True):
        seg = [first, after, float(total[first]), float(total[after]), -1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= seg[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= seg[3]:
                seg[4] = j
                found.append(seg)
                break
            seg = [found[j][0], after, found[j][2], seg[3], -1]  # take in everything from j on
            del found[j:]
            j = len(found) - 1
    return [(f, t, r - le) for f, t, le, r, _ in found]


class Model:
    """Sorted keys and log-odds of each level, the extreme-value law and the calibration."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.tables = tables
        self.rate, self.k, self.slope, self.shift = 1.0, 1.0, 1.0, 0.0

    def token_scores(self, keys: list[np.ndarray], row: np.ndarray) -> np.ndarray:
        """Log-odds less the drift, from the longest form that the model knows.
        A word that only repeats the one before it adds no evidence."""
        out = np.zeros(len(keys[0]))
        for (known, value), key in zip(self.tables, keys, strict=True):
            if len(known):
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key
                out[hit] = value[at[hit]]
        again = (keys[-1][1:] == keys[-1][:-1]) & (row[1:] == row[:-1])
        out[1:][again] = np.minimum(out[1:][again], 0)
        return out - DRIFT

    def excess(self, score: float, n: int) -> float:
        """-log of the E-value of a segment in a text of n tokens."""
        return self.rate * score - float(np.log(max(self.k * n, 1e-300)))

    def document(self, score: np.ndarray) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Statistic of a text and its significant segments (first, after, score, E-value).

        The statistic adds up -log E of the significant segments; without any
        it is that of the best segment, at most what significance begins with."""
        n = len(score)
        if not n:
            return 0.0, []
        segments = [(a, b, s, self.excess(s, n)) for a, b, s in maximal_segments(score)]
        edge = -float(np.log(SIGNIFICANT))
        strong = [x for x in segments if x[3] > edge]
        if strong:
            return sum(x[3] for x in strong), [(a, b, s, float(np.exp(-x))) for a, b, s, x in strong]
        return max([0.0, *(x[3] for x in segments)]), []

    def probability(self, statistic: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(statistic) + self.shift, -60, 60)))


def _log_odds(counts: DataFrame) -> Model:
    """Nested Dirichlet log-odds from word counts (keys, toxic, clean) in Spark.
    Every word of the training texts and every stem gets its own; the prior alone
    holds back those that are rare."""
    all_t, all_c = counts.agg(F.sum("t"), F.sum("c")).first()
    even = float(all_t) / max(float(all_c), 1.0)  # clean counts are scaled to the toxic total
    names = [f"k{i}" for i in range(len(_STEMS) + 1)]
    tables, prior = [], None
    for i, name in enumerate(names):
        level = counts.groupBy(*names[:i + 1][-2:]).agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        got = level.toArrow()
        key = got[name].to_numpy().view(np.uint64)
        t, c = got["t"].to_numpy().astype(float), got["c"].to_numpy() * even
        mean = np.full(len(key), 0.5)
        if prior is not None and len(prior[0]):
            up = got[names[i - 1]].to_numpy().view(np.uint64)
            at = np.minimum(np.searchsorted(prior[0], up), len(prior[0]) - 1)
            mean = np.where(prior[0][at] == up, prior[1][at], 0.5)
        p = (t + PRIOR * mean) / (t + c + PRIOR)
        order = np.argsort(key, kind="stable")
        tables.append((key[order], np.log(p / (1 - p))[order]))
        prior = (key[order], p[order])
    return Model(tables)


def _tail(scores: np.ndarray) -> float:
    """Positive root of mean(exp(rate * score)) = 1 over clean token scores, at
    most ``MAX_RATE`` (where hardly a clean token scores above 0 there is none)."""
    lo, hi = 1e-3, MAX_RATE
    if np.mean(np.exp(hi * scores)) < 1:
        return hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.mean(np.exp(mid * scores)) < 1 else (lo, mid)
    return hi


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", per_class: int = PER_CLASS) -> Model | None:
    """Learn ``label`` from at most ``per_class`` documents of each class that
    ``learn`` admits.  None unless both classes occur."""
    train = stored(training_texts(docs, labels, label, learn, per_class, id_col, text_col), "toxic-train")
    if train.select("y").distinct().count() < 2:
        return None

    def count(batches):
        for b in batches:
            data, off = string_buffers(b.column(0))
            y = b.column(1).to_numpy()
            for lo, _hi, part, o in chunks(data, off, 4 << 20):
                _, _, row, keys = _token_keys(part, o)
                word, at, code = np.unique(keys[-1], return_index=True, return_inverse=True)
                pair = np.unique(row.astype(np.int64) * len(word) + code)  # a text counts a word once
                code, y_of = pair % max(len(word), 1), y[lo + pair // max(len(word), 1)]
                n, t = np.bincount(code, minlength=len(word)), np.bincount(code, y_of, minlength=len(word))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[at].view(np.int64)) for k in keys] + [pa.array(t.astype(np.int64)),
                                                                      pa.array((n - t).astype(np.int64))],
                    names=["k0", "k1", "k2", "t", "c"])
    words = train.select("text", "y").mapInArrow(count, "k0 long, k1 long, k2 long, t long, c long")
    counts = stored(words.groupBy("k0", "k1", "k2").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "token-counts")
    model = _log_odds(counts)
    sc = docs.sparkSession.sparkContext

    # clean training texts: histogram of token scores, and length and best segment of each text
    shared = sc.broadcast(model)
    edges = np.linspace(-20, 20, 2001)

    def profile(batches):
        for b in batches:
            m = shared.value
            data, off = string_buffers(b.column(0))
            hist, n, best = np.zeros(len(edges) - 1, np.int64), [], []
            for lo, hi, part, o in chunks(data, off):
                _, _, row, keys = _token_keys(part, o)
                s = m.token_scores(keys, row)
                hist += np.histogram(np.clip(s, -20, 20), edges)[0]
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                for d in range(hi - lo):
                    one = s[cut[d]:cut[d + 1]]
                    n.append(len(one))
                    best.append(max([0.0, *(x[2] for x in maximal_segments(one))]))
            yield pa.RecordBatch.from_pydict({"hist": pa.array([hist.tolist()], pa.list_(pa.int64())), "n": [n], "best": [best]})
    got = train.where("y = 0").select("text").mapInArrow(profile, "hist array<long>, n array<long>, best array<double>").collect()
    hist = np.sum([r.hist for r in got], axis=0)
    mids = (edges[1:] + edges[:-1]) / 2
    n, best = np.concatenate([r.n for r in got]), np.concatenate([r.best for r in got])
    seen = hist > 0
    model.rate = _tail(np.repeat(mids[seen], np.maximum(1, (hist[seen] * (1e5 / hist.sum())).astype(np.int64))))
    full = n > 0
    model.k = float(full.sum() / max((n[full] * np.exp(-model.rate * best[full])).sum(), 1e-300))

    # calibration on all training texts
    shared = sc.broadcast(model)

    def statistics(batch: pa.RecordBatch):
        return [pa.array(_documents(shared.value, batch.column(0))[0])]
    rows = append_columns(train, [("z", "double")], lambda: statistics, ["text"], drop=["text"]).select("y", "w", "z").toArrow()
    y = rows["y"].to_numpy()
    model.slope, model.shift = platt(np.log1p(rows["z"].to_numpy()), y, rows["w"].to_numpy())
    return model


def _documents(model: Model, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    data, off = string_buffers(texts)
    z, passages = np.zeros(len(texts)), [[] for _ in range(len(texts))]
    for lo, hi, part, o in chunks(data, off):
        s, e, row, keys = _token_keys(part, o)
        score = model.token_scores(keys, row)
        cut = np.searchsorted(row, np.arange(hi - lo + 1))
        for d in range(hi - lo):
            z[lo + d], found = model.document(score[cut[d]:cut[d + 1]])
            passages[lo + d] = [{"begin": int(s[cut[d] + a] - o[d]), "end": int(e[cut[d] + b - 1] - o[d]),
                                 "score": x, "e_value": v} for a, b, x, v in found]
    return z, passages


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Append ``score`` (0 to 1, higher: label 1 likelier) and ``passages``: the
    significant segments with begin and end as byte offsets, log-odds score
    and E-value.  A null or empty text has no passage and the lowest score;
    without a model scores are 0.5.  Columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def make():
        m: Model | None = shared.value

        def fn(batch: pa.RecordBatch):
            if m is None:
                return [pa.array([0.5] * batch.num_rows), pa.array([[]] * batch.num_rows, kind)]
            z, passages = _documents(m, batch.column(0))
            return [pa.array(m.probability(z)), pa.array(passages, kind)]
        return fn
    fields = [("score", "double"), ("passages", "array<struct<begin:bigint,end:bigint,score:double,e_value:double>>")]
    return append_columns(docs, fields, make, [text_col])
