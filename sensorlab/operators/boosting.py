"""Multinomial gradient-boosted trees over quantile-binned features (B2).

Each round grows one tree per class (one in all for two classes) on the
residuals of the softmax, all classes level by level together: one pass per
level sums counts, residuals and hessians by (class, node, feature, bin) in
every task, adds the histograms up by feature in a shuffle, and returns the
best split of each node.  So a round costs ``max_depth`` jobs, not that many
per class.  Splits maximise Friedman's improvement; a leaf's value is one
Newton step, taken from the last level's histograms, so no pass of its own.

The binned table is stored once.  Scores of the rows are a function of it and
of the trees: every round adds its own to the kept scores of the round before,
and every ``ROUNDS_PER_BASE`` rounds they are checkpointed, so a lost executor
costs one such stretch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored

#: Cut points per feature at most.
BINS = 64
#: Rounds between two checkpoints of the rows' scores.
ROUNDS_PER_BASE = 10
#: Bytes of binned features and scores per partition, as long as there are cores for more partitions.
PARTITION_BYTES = 2 << 20
#: The same, at most.
MOST_BYTES = 64 << 20
#: Improvements below this share of a node's squared residuals do not split it.
_LEAST = 1e-12


@dataclass
class Trees:
    """Trees of one round, one per row; node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # -1: leaf
    cut: np.ndarray      # bins up to this one go left
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, classes: int, depth: int) -> Trees:
        n = (2 << depth) - 1
        return cls(np.full((classes, n), -1, np.int32), np.zeros((classes, n), np.int32), np.zeros((classes, n)), np.zeros((classes, n)))

    def nodes(self, bins: np.ndarray, k: int, levels: int) -> np.ndarray:
        """Node of every row after ``levels`` steps in tree ``k``."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[k][at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[rows, f] > self.cut[k][at]), at)
        return at

    def add_to(self, scores: np.ndarray, bins: np.ndarray, rate: float, depth: int) -> None:
        for k in range(len(self.feature)):
            scores[:, k] += rate * self.value[k][self.nodes(bins, k, depth)]


def probabilities(scores: np.ndarray) -> np.ndarray:
    if scores.shape[1] == 1:
        p = 1 / (1 + np.exp(-scores[:, 0]))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def residuals(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative gradients and hessians of the deviance, by row and tree."""
    p = probabilities(scores)
    if scores.shape[1] == 1:
        return (y - p[:, 1])[:, None], (p[:, 1] * p[:, 0])[:, None]
    g = -p
    g[np.arange(len(y)), y] += 1
    return g, np.abs(g) * (1 - np.abs(g))


def level_histogram(bins, g, h, trees: Trees, level: int, width: int) -> np.ndarray:
    """[(count, residual, hessian), class, node of the level, feature, bin] sums."""
    n, d = bins.shape
    first, here = (1 << level) - 1, 1 << level
    out = np.zeros((3, g.shape[1], here, d, width))
    flat = bins + np.arange(d)[None] * width
    for k in range(g.shape[1]):
        at = trees.nodes(bins, k, level)
        live = np.flatnonzero(at >= first)  # rows whose node is on this level
        if not len(live):
            continue
        cell = (flat[live] + ((at[live] - first) * (d * width))[:, None]).ravel()
        size = here * d * width
        for j, w in enumerate((None, g[live, k], h[live, k])):
            out[j, k] = np.bincount(cell, None if w is None else np.repeat(w, d), size).reshape(here, d, width)
    return out


def best_splits(hist: np.ndarray, first_feature: int) -> dict[str, np.ndarray]:
    """Best split of every (class, node) over the features of ``hist``: the lowest feature, then
    the lowest cut, of those with the largest improvement."""
    _, c, m, d, w = hist.shape
    whole = hist[:, :, :, 0].sum(axis=-1)  # every feature holds all rows of a node
    found = {"gain": np.full((c, m), -1.0), "feature": np.full((c, m), first_feature), "cut": np.zeros((c, m), np.int64),
             "left": np.zeros((c, m, 3)), "all": np.moveaxis(whole, 0, -1)}
    ck, mk = np.nonzero(whole[0] > 1.5)  # a single row is not split
    if not len(ck):
        return found
    left = hist[:, ck, mk].cumsum(axis=-1)
    total = whole[:, ck, mk][:, :, None, None]
    nl, nr = left[0], total[0] - left[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[1] / nl
        gain -= (total[1] - left[1]) / nr
        gain *= gain
        gain *= nl * nr
        gain /= total[0]
    gain[~((nl > 0.5) & (nr > 0.5))] = -1.0
    at = gain.reshape(len(ck), d * w).argmax(axis=1)
    rows = np.arange(len(ck))
    found["gain"][ck, mk] = gain.reshape(len(ck), -1)[rows, at]
    found["feature"][ck, mk], found["cut"][ck, mk] = first_feature + at // w, at % w
    found["left"][ck, mk] = left.reshape(3, len(ck), -1)[:, rows, at].T
    return found


def _better(a: dict, b: dict) -> dict:
    use = (b["gain"] > a["gain"]) | ((b["gain"] == a["gain"]) & (b["feature"] < a["feature"]))
    return {k: np.where(use.reshape(use.shape + (1,) * (a[k].ndim - use.ndim)), b[k], a[k]) for k in a}


def _newton(sums: np.ndarray, classes: int) -> np.ndarray:
    g, h = sums[..., 1], sums[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where(np.abs(h) < 1e-150, 0.0, g / h)
    return v if classes == 1 else v * (classes - 1) / classes


def grow(trees: Trees, level: int, depth: int, best: dict) -> None:
    """Enter the splits of one level, and the values of the nodes that end with it."""
    first, classes = (1 << level) - 1, len(trees.feature)
    for k in range(classes):
        for m in range(1 << level):
            i, total = first + m, best["all"][k, m]
            if total[0] < 0.5:
                continue
            trees.value[k, i] = _newton(total, classes)
            if best["gain"][k, m] <= _LEAST * total[0]:
                continue
            trees.feature[k, i], trees.cut[k, i], trees.gain[k, i] = best["feature"][k, m], best["cut"][k, m], best["gain"][k, m]
            if level == depth - 1:
                left = best["left"][k, m]
                trees.value[k, 2 * i + 1], trees.value[k, 2 * i + 2] = _newton(left, classes), _newton(total - left, classes)


def cut_points(df: DataFrame, features: str, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Ascending cut points of every feature: its quantiles, at most ``bins`` - 1."""
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.get(features, F.lit(i))), F.get(features, F.lit(i))), probs, 100 * bins).alias(f"q{i}")
                   for i in range(width)]).first()
    return [np.unique(np.array(q or [], np.float64)) for q in row]


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: the number of cut points below it (NaN: the last bin)."""
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.int64)


def _feature_array(df: DataFrame, col: str):
    """An array<double> of a vector or array column."""
    c = F.col(f"`{col}`")
    return vector_to_array(c) if isinstance(df.schema[col].dataType, VectorUDT) else c.cast("array<double>")


class GradientBoosting(Estimator):
    """B2: gradient-boosted trees with the multinomial deviance; labels are 0 .. classes - 1.

    Rows without a label or features, or whose number of features is not the
    first row's, teach nothing; missing values (NaN) go right at every split."""

    def __init__(self, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3, label: str = "label",
                 features: str = "features", bins: int = BINS):
        super().__init__()
        if n_estimators < 1 or max_depth < 1 or learning_rate <= 0 or not 2 <= bins <= 1 << 15:
            raise ValueError("n_estimators, max_depth, learning_rate and bins must be positive (bins: 2 to 32768)")
        self.n_estimators, self.learning_rate, self.max_depth = n_estimators, learning_rate, max_depth
        self.label, self.features, self.bins = label, features, bins

    def getNumTrees(self) -> int:  # noqa: N802 (Spark ML's names)
        return self.n_estimators

    def getMaxDepth(self) -> int:  # noqa: N802
        return self.max_depth

    def getStepSize(self) -> float:  # noqa: N802
        return self.learning_rate

    def _fit(self, dataset: DataFrame) -> BoostedTrees:
        x = dataset.select(F.col(f"`{self.label}`").cast("int").alias("y"), _feature_array(dataset, self.features).alias("x"))
        width = (x.where("x IS NOT NULL").select(F.size("x")).first() or [0])[0]
        x = stored(x.where((F.col("y") >= 0) & (F.size("x") == width)), "training")
        sizes = {r.y: r["count"] for r in x.groupBy("y").count().collect()}
        if not sizes or not width:
            raise ValueError("no rows to learn from")
        classes, total = max(2, max(sizes) + 1), sum(sizes.values())
        prior = np.array([sizes.get(k, 0) / total for k in range(classes)])
        prior = np.clip(prior, np.finfo(np.float32).eps, 1 - np.finfo(np.float32).eps)
        start = np.log(prior) if classes > 2 else np.log(prior[1:] / prior[:1])
        cuts = cut_points(x, "x", width, self.bins)
        size, cores = total * (2 * width + 8 * len(start)), x.sparkSession.sparkContext.defaultParallelism
        parts = max(-(-size // MOST_BYTES), min(-(-size // PARTITION_BYTES), cores))
        rounds = self._boost(_blocks(x, cuts, parts), start, max(map(len, cuts)) + 1, width)
        return BoostedTrees(self.features, cuts, start, self.learning_rate, self.max_depth, rounds)

    def _boost(self, blocks, start: np.ndarray, bin_width: int, width: int) -> list[Trees]:
        rate, depth, classes = self.learning_rate, self.max_depth, len(start)
        sc = blocks.context
        base = blocks.map(lambda b: (b[0], b[1], np.tile(start, (len(b[1]), 1)))).persist()
        rounds: list[Trees] = []
        kept = [base]  # scores of the rounds since the last checkpoint
        for _ in range(self.n_estimators):
            trees = Trees.empty(classes, depth)
            for level in range(depth):
                state = sc.broadcast(trees)

                def histograms(it, state=state, level=level):
                    total = None
                    for bins, y, scores in it:
                        part = level_histogram(bins, *residuals(scores, y), state.value, level, bin_width)
                        total = part if total is None else total + part
                    if total is not None:
                        step = max(1, width // 64)
                        yield from ((f, total[:, :, :, f:f + step]) for f in range(0, width, step))

                def best(it):
                    found = None
                    for f, hist in it:
                        b = best_splits(hist, f)
                        found = b if found is None else _better(found, b)
                    if found is not None:
                        yield found
                sums = base.mapPartitions(histograms)
                if base.getNumPartitions() > 1:  # the histograms of one partition are whole already
                    sums = sums.reduceByKey(np.add)
                found = sums.mapPartitions(best).collect()  # one row per partition of features
                whole = found[0]
                for b in found[1:]:
                    whole = _better(whole, b)
                grow(trees, level, depth, whole)
                state.destroy()
                if not (trees.feature[:, (1 << level) - 1:(2 << level) - 1] >= 0).any():
                    break
            rounds.append(trees)
            if len(rounds) == self.n_estimators:
                break

            def advance(b, trees=trees):
                scores = b[2].copy()
                trees.add_to(scores, b[0], rate, depth)
                return b[0], b[1], scores
            base = base.map(advance).persist()
            if len(rounds) % ROUNDS_PER_BASE == 0:
                base.checkpoint()
                base.foreachPartition(lambda _: None)
            kept.append(base)
            for done in kept[:-1] if len(rounds) % ROUNDS_PER_BASE == 0 else kept[:-2]:
                done.unpersist()  # the next is worked out from the last alone
            kept = kept[-1:] if len(rounds) % ROUNDS_PER_BASE == 0 else kept[-2:]
        for done in kept:
            done.unpersist()
        return rounds


def _blocks(x: DataFrame, cuts: list[np.ndarray], parts: int):
    """The binned rows as (bins, labels) arrays, stored once."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_pydict({"bins": pa.array([to_bins(m, cuts).astype(np.int16).tobytes()], pa.binary()),
                                              "y": pa.array([b.column(0).to_numpy().astype(np.int32).tobytes()], pa.binary())})
    width = len(cuts)
    packed = stored(x.select("y", "x").repartition(parts).mapInArrow(pack, "bins binary, y binary"), "binned")
    return packed.rdd.map(lambda r: (np.frombuffer(bytes(r.bins), np.int16).reshape(-1, width),
                                     np.frombuffer(bytes(r.y), np.int32).astype(np.int64)))


@dataclass(eq=False)
class _Fitted:
    features: str
    cuts: list[np.ndarray]
    start: np.ndarray
    rate: float
    depth: int
    rounds: list[Trees] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = to_bins(x, self.cuts)
        out = np.tile(self.start, (len(x), 1))
        for t in self.rounds:
            t.add_to(out, bins, self.rate, self.depth)
        return out


class BoostedTrees(Model, MLWritable, MLReadable):
    """Fitted trees: adds ``rawPrediction``, ``probability`` (vectors) and ``prediction``."""

    def __init__(self, *fitted):
        super().__init__()
        self.fitted = _Fitted(*fitted) if fitted else None

    @property
    def featureImportances(self):  # noqa: N802
        """Mean over the trees of each tree's improvements by feature, normalised to 1."""
        total = np.zeros(len(self.fitted.cuts))
        for t in self.fitted.rounds:
            for k in range(len(t.feature)):
                on = t.feature[k] >= 0
                if on.any():
                    total += np.bincount(t.feature[k][on], t.gain[k][on] / t.gain[k][on].sum(), len(total))
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held, width = dataset.sparkSession.sparkContext.broadcast(self.fitted), len(self.fitted.cuts)

        @F.pandas_udf("struct<raw: array<double>, p: array<double>>")
        def score(column):
            import pandas as pd
            model = held.value
            x = np.array([v if v is not None and len(v) == width else np.full(width, np.nan) for v in column], np.float64).reshape(-1, width)
            raw = model.scores(x)
            return pd.DataFrame({"raw": list(raw), "p": list(probabilities(raw))})
        from pyspark.ml.functions import array_to_vector
        p = F.col("__scored.p")
        return (dataset.withColumn("__scored", score(_feature_array(dataset, self.fitted.features)))
                .withColumn("rawPrediction", array_to_vector("__scored.raw")).withColumn("probability", array_to_vector(p))
                .withColumn("prediction", (F.array_position(p, F.array_max(p)) - 1).cast("double")).drop("__scored"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    """Parameters as Spark ML metadata, trees as one row per round."""

    def __init__(self, model: BoostedTrees):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m, spark = self.model.fitted, self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        head = (m.features, [[float(c) for c in x] for x in m.cuts], [float(s) for s in m.start], float(m.rate), int(m.depth))
        spark.createDataFrame([head], "features string, cuts array<array<double>>, start array<double>, rate double, depth int").write.parquet(
            f"{path}/head")
        rows = [(i, [x.tolist() for x in t.feature], [x.tolist() for x in t.cut], [x.tolist() for x in t.value], [x.tolist() for x in t.gain])
                for i, t in enumerate(m.rounds)]
        spark.createDataFrame(rows, "round int, feature array<array<int>>, cut array<array<int>>, value array<array<double>>, "
                                    "gain array<array<double>>").write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> BoostedTrees:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        h = self.sparkSession.read.parquet(f"{path}/head").first()
        rows = self.sparkSession.read.parquet(f"{path}/trees").orderBy("round").collect()
        rounds = [Trees(np.array(r.feature, np.int32), np.array(r.cut, np.int32), np.array(r.value), np.array(r.gain)) for r in rows]
        model = BoostedTrees(h.features, [np.array(c) for c in h.cuts], np.array(h.start), h.rate, h.depth, rounds)
        model._resetUid(meta["uid"])
        return model
