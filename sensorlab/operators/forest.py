"""Random forest classifier (B1, B4, S17) whose trees stay distributed.

Deep trees hold about as many nodes as there are rows, so a forest does not fit
in one process.  Nodes with more than ``SUBTREE_ROWS`` drawn rows are split over
the whole cluster, level by level for all trees at once, from histograms; below
that, the rows of a node are shuffled to one task, which grows its subtree to
the end.  The driver sees the few splits above the subtrees and nothing else:
subtrees are rows of a stored table, and scoring shuffles the rows to them.

Gini impurity, bootstrap by Poisson weights, sqrt(features) tried per node,
at most ``BINS`` bins per feature.  Draws are functions of (seed, tree, block or node).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from .boosting import _feature_array, cut_points, to_bins

#: Bins per feature at most.
BINS = 32
#: Drawn rows of a node that one task may hold.
SUBTREE_ROWS = 1 << 17
#: Rows of a scored table that meet one copy of a subtree.
SCORED_ROWS = 1 << 20
#: Rows binned together.
_BLOCK = 4096
#: Histogram cells of one step.
_CELLS = 1 << 21
#: A vote of 1; votes are whole numbers, so their sums do not depend on the order.
_VOTE = 1 << 40
_LEAST = 1e-12


def draw(seed: int, tree: int, block: int, rows: int) -> np.ndarray:
    """Bootstrap weights of a block's rows in a tree."""
    return np.random.default_rng([seed & 0x7FFFFFFF, tree, block]).poisson(1.0, rows)


def best_splits(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of [node, feature, bin, class] counts: place of the feature, cut (bins up to it go left)
    and gain (Gini, times the rows) of the best split of every node; the first on ties."""
    n, m, b, _ = hist.shape
    left = hist.cumsum(axis=2)
    total = left[:, :1, -1:]
    right = total - left
    nl, nr = left.sum(axis=3), right.sum(axis=3)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.einsum("nfbk,nfbk->nfb", left, left) / nl + np.einsum("nfbk,nfbk->nfb", right, right) / nr
    score[(nl < 0.5) | (nr < 0.5)] = -1.0
    at = score.reshape(n, m * b).argmax(axis=1)
    whole = total[:, 0, 0]
    gain = score.reshape(n, m * b)[np.arange(n), at] - (whole ** 2).sum(axis=1) / np.maximum(whole.sum(axis=1), 1)
    return at // b, at % b, gain


def _tried(rng: np.random.Generator, nodes: int, width: int, m: int) -> np.ndarray:
    """(nodes, m) different features per node, ascending."""
    if m >= width:
        return np.tile(np.arange(width), (nodes, 1))
    return np.sort(np.argpartition(rng.random((nodes, width)), m, axis=1)[:, :m], axis=1)


def _counts(x, y, w, node, tried, nodes: int, bins: int, classes: int) -> np.ndarray:
    """[node, tried feature, bin, class] weights; ``tried`` is by node."""
    m = tried.shape[1]
    f = tried[node]
    cell = ((node[:, None] * m + np.arange(m)) * bins + np.take_along_axis(x, f, 1)) * classes + y[:, None]
    return np.bincount(cell.ravel(), np.repeat(w, m), nodes * m * bins * classes).reshape(nodes, m, bins, classes)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, m: int, bins: int, classes: int,
         rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A subtree over rows (bins, label, weight): feature (-1: leaf), cut and left child of every
    node (the right one follows it; of a leaf its number), class counts by leaf, and importances."""
    feature, cut, child = [np.full(1, -1, np.int16)], [np.zeros(1, np.uint8)], [np.zeros(1, np.int32)]
    leaves, importance = [], np.zeros(x.shape[1])
    rows, node, size, made, n_leaves = np.arange(len(y)), np.zeros(len(y), np.int64), 1, 1, 0
    for level in range(depth + 1):
        counts = np.bincount(node * classes + y[rows], w[rows], size * classes).reshape(size, classes)
        split = np.zeros(size, bool)
        if level < depth:
            open_ = np.flatnonzero((counts > 0).sum(axis=1) > 1)
            renumber = np.full(size, -1)
            renumber[open_] = np.arange(len(open_))
            tried = _tried(rng, len(open_), x.shape[1], m)
            now = renumber[node]
            order = np.argsort(now, kind="stable")
            order = order[now[order] >= 0]
            now = now[order]
            step = max(1, _CELLS // (m * bins * classes))
            for a in range(0, len(open_), step):
                b = min(a + step, len(open_))
                part = rows[order[np.searchsorted(now, a):np.searchsorted(now, b)]]
                its = now[np.searchsorted(now, a):np.searchsorted(now, b)] - a
                f, c, gain = best_splits(_counts(x[part], y[part], w[part], its, tried[a:b], b - a, bins, classes))
                good = np.flatnonzero(gain > _LEAST)
                at, f = open_[a:b][good], tried[a:b][good, f[good]]
                split[at], feature[-1][at], cut[-1][at] = True, f, c[good]
                np.add.at(importance, f, gain[good])
        ends = np.flatnonzero(~split)
        child[-1][ends] = n_leaves + np.arange(len(ends))
        n_leaves += len(ends)
        leaves.append(counts[ends])
        inner = np.flatnonzero(split)
        if not len(inner):
            break
        child[-1][inner] = made + 2 * np.arange(len(inner))
        keep = split[node]
        rows, node = rows[keep], node[keep]
        right = x[rows, feature[-1][node]] > cut[-1][node]
        node = child[-1][node] - made + right
        size = 2 * len(inner)
        made += size
        feature.append(np.full(size, -1, np.int16))
        cut.append(np.zeros(size, np.uint8))
        child.append(np.zeros(size, np.int32))
    return np.concatenate(feature), np.concatenate(cut), np.concatenate(child), np.concatenate(leaves).astype(np.float32), importance


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The node without a split that every row ends in."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        f = feature[at[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        here = at[rows]
        at[rows] = child[here] + (x[rows, f] > cut[here])
    return at


@dataclass
class Top:
    """The splits of a tree above its subtrees; the nodes without one are the subtrees' roots."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    child: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])

    def arrays(self):
        return np.array(self.feature), np.array(self.cut), np.array(self.child)

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.cut[node], self.child[node] = feature, cut, left
        for new, value in ((self.feature, -1), (self.cut, 0), (self.child, 0), (self.depth, self.depth[node] + 1)):
            new += [value, value]
        return left, left + 1


@dataclass
class Fitted:
    features: str
    cuts: list[np.ndarray]
    classes: int
    tops: list[Top]
    path: str  # table of subtrees
    top_gains: list[list[float]]


class RandomForest(Estimator):
    """B1: random forest; labels are 0 .. classes - 1.  A row to learn from whose label or features are
    missing or not finite, or whose features are not as many as the first row's, is an error, as for
    Spark ML's forest; in a row to score, missing values (NaN) go right."""

    def __init__(self, n_estimators: int = 100, max_depth: int = 30, seed: int = 42, label: str = "label",
                 features: str = "features", bins: int = BINS, tried: int | None = None):
        super().__init__()
        if n_estimators < 1 or max_depth < 0 or not 2 <= bins <= 256:
            raise ValueError("n_estimators must be positive, max_depth not negative, bins 2 to 256")
        self.n_estimators, self.max_depth, self.seed = n_estimators, max_depth, seed
        self.label, self.features, self.bins, self.tried = label, features, bins, tried

    def getNumTrees(self) -> int:  # noqa: N802 (Spark ML's names)
        return self.n_estimators

    def getMaxDepth(self) -> int:  # noqa: N802
        return self.max_depth

    def _fit(self, dataset: DataFrame) -> ForestModel:
        label = F.col(f"`{self.label}`").cast("double")
        raw = dataset.select(label.alias("y"), _feature_array(dataset, self.features).alias("x"))
        width = (raw.where("x IS NOT NULL").select(F.size("x")).first() or [0])[0]
        y, off = F.col("y"), F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        x = stored(raw.select(
            F.when(y.isNull() | F.isnan(y), F.raise_error(F.lit("Labels MUST NOT be Null or NaN")))
            .when((y < 0) | (y != F.floor(y)), F.raise_error(F.lit("Labels MUST be Integers from 0"))).otherwise(y).cast("int").alias("y"),
            F.when(F.col("x").isNull() | (F.size("x") != width) | off, F.raise_error(
                F.lit("Vectors MUST NOT be Null, of different sizes, or hold NaN or Infinity"))).otherwise(F.col("x")).alias("x")), "training")
        total, most = x.agg(F.count("*"), F.max("y")).first()
        if not total or not width:
            raise ValueError("no rows to learn from")
        classes, cuts = max(2, most + 1), cut_points(x, "x", width, self.bins)
        bins, m = max(map(len, cuts)) + 1, min(self.tried or math.ceil(math.sqrt(width)), width)
        seed, trees, depth = self.seed, self.n_estimators, self.max_depth
        cores = x.sparkSession.sparkContext.defaultParallelism
        # in an order that the rows alone decide, so that a block's draws meet the same rows in every run
        dealt = (x.select("y", "x", F.xxhash64("y", "x").alias("h")).repartition(max(1, min(cores, -(-total // _BLOCK)), total >> 20), "h")
                 .sortWithinPartitions("h", "y", "x").select("y", "x"))
        blocks = stored(_blocks(dealt, cuts), "binned")
        tops, gains = self._tops(blocks, total, width, m, bins, classes)
        held = x.sparkSession.sparkContext.broadcast([t.arrays() for t in tops])

        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, xs, ys in _read(batches, width):
                for t, top in enumerate(held.value):
                    w = draw(seed, t, block, len(ys))
                    drawn = np.flatnonzero(w)
                    node = walk(xs[drawn], *top)
                    for i in np.unique(node):
                        r = drawn[node == i]
                        yield _batch(tree=[t], node=[int(i)], bins=[xs[r].tobytes()], y=[ys[r].tobytes()], w=[w[r].astype(np.int16).tobytes()])

        def subtrees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (t, node), rows in _by_key(batches, 2):
                xs = np.concatenate([np.frombuffer(r["bins"], np.uint8) for r in rows]).reshape(-1, width)
                ys = np.concatenate([np.frombuffer(r["y"], np.int32) for r in rows])
                w = np.concatenate([np.frombuffer(r["w"], np.int16) for r in rows]).astype(np.float64)
                rng = np.random.default_rng([seed & 0x7FFFFFFF, t, node, 1])
                f, c, ch, leaves, gain = grow(xs, ys, w, depth - tops_depth.value[t][node], m, bins, classes, rng)
                yield _batch(tree=[t], node=[node], feature=[f.tobytes()], cut=[c.tobytes()], child=[ch.tobytes()],
                             leaves=[leaves.tobytes()], gain=[gain.tolist()])
        tops_depth = x.sparkSession.sparkContext.broadcast([t.depth for t in tops])
        n = min(sum(t.feature.count(-1) for t in tops), 4096)
        dealt = blocks.mapInArrow(deal, "tree int, node int, bins binary, y binary, w binary")
        grown = dealt.repartition(n, "tree", "node").sortWithinPartitions("tree", "node").mapInArrow(
            subtrees, "tree int, node int, feature binary, cut binary, child binary, leaves binary, gain array<double>")
        from ..sources.results import scratch_path
        path = scratch_path(x.sparkSession, "subtrees")
        grown.write.parquet(path)
        return ForestModel(Fitted(self.features, cuts, classes, tops, path, gains))

    def _tops(self, blocks: DataFrame, total: int, width: int, m: int, bins: int, classes: int) -> tuple[list[Top], list[list[float]]]:
        """Splits of all nodes that hold more drawn rows than a task may; one job per level."""
        seed, sc = self.seed, blocks.sparkSession.sparkContext
        tops = [Top() for _ in range(self.n_estimators)]
        gains = [[0.0] * width for _ in tops]
        large = {t: [0] for t in range(len(tops))} if total > SUBTREE_ROWS // 2 and self.max_depth else {}
        while large:
            state = sc.broadcast(({t: tops[t].arrays() for t in large}, large))

            def tried(t, node):
                return _tried(np.random.default_rng([seed & 0x7FFFFFFF, t, node, 0]), 1, width, m)

            def histograms(it, state=state, tried=tried):
                arrays, wanted = state.value
                mine = [(r.block, np.frombuffer(bytes(r.bins), np.uint8).reshape(-1, width), np.frombuffer(bytes(r.y), np.int32)) for r in it]
                for t, nodes in wanted.items():
                    out = {}
                    for block, xs, ys in mine:
                        w = draw(seed, t, block, len(ys)).astype(np.float64)
                        at = walk(xs, *arrays[t])
                        for node in nodes:
                            r = np.flatnonzero((at == node) & (w > 0))
                            h = _counts(xs[r], ys[r], w[r], np.zeros(len(r), np.int64), tried(t, node), 1, bins, classes)
                            out[t, node] = out[t, node] + h if (t, node) in out else h
                    yield from out.items()

            def best(kv, tried=tried):
                (t, node), hist = kv
                f, c, gain = best_splits(hist)
                size = hist[0, f[0]].sum(axis=1)
                return t, node, int(tried(t, node)[0, f[0]]), int(c[0]), float(gain[0]), float(size[:c[0] + 1].sum()), float(size.sum())
            found = blocks.rdd.mapPartitions(histograms).reduceByKey(np.add).map(best).collect()  # one row per large node
            state.destroy()
            large = {}
            for t, node, f, c, gain, left, size in sorted(found):
                if size <= SUBTREE_ROWS or gain <= _LEAST:
                    continue
                gains[t][f] += gain
                for child, n in zip(tops[t].split(node, f, c), (left, size - left), strict=True):
                    if n > SUBTREE_ROWS and tops[t].depth[child] < self.max_depth:
                        large.setdefault(t, []).append(child)
        return tops, gains


def _batch(**columns) -> pa.RecordBatch:
    types = {"tree": pa.int32(), "node": pa.int32(), "gain": pa.list_(pa.float64()), "block": pa.int64(), "part": pa.int32(), "kind": pa.int32()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.binary())) for k, v in columns.items()})


def _blocks(x: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """The binned rows, ``_BLOCK`` at most in a row of their own number."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for i in range(0, whole.num_rows, _BLOCK):
                b = whole.slice(i, _BLOCK)
                m = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
                yield _batch(block=[block], bins=[to_bins(m, cuts).astype(np.uint8).tobytes()], y=[b.column(0).to_numpy().astype(np.int32).tobytes()])
                block += 1
    return x.mapInArrow(pack, "block long, bins binary, y binary")


def _read(batches: Iterable[pa.RecordBatch], width: int):
    for b in batches:
        for r in b.to_pylist():
            yield r["block"], np.frombuffer(r["bins"], np.uint8).reshape(-1, width), np.frombuffer(r["y"], np.int32)


def _by_key(batches: Iterable[pa.RecordBatch], keys: int):
    """Runs of rows that agree in their first columns."""
    last, held = None, []
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            key = tuple(r[c] for c in b.schema.names[:keys])
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(r)
    if held:
        yield last, held


class ForestModel(Model, MLWritable, MLReadable):
    """Fitted forest: adds ``rawPrediction`` (sums of the trees' leaf shares), ``probability`` and ``prediction``."""

    def __init__(self, fitted: Fitted | None = None):
        super().__init__()
        self.fitted = fitted

    def _table(self, spark) -> DataFrame:
        return spark.read.parquet(self.fitted.path)

    @property
    def featureImportances(self):  # noqa: N802
        """Mean over the trees of each tree's gains by feature, normalised to 1."""
        from pyspark.sql import SparkSession
        t = self._table(SparkSession.active()).select("tree", F.posexplode("gain").alias("f", "g"))
        gains = np.array(self.fitted.top_gains)
        for r in t.groupBy("tree", "f").agg(F.sum("g").alias("g")).collect():  # one number per tree and feature
            gains[r.tree, r.f] += r.g
        size = gains.sum(axis=1, keepdims=True)
        mean = (gains / np.where(size > 0, size, 1)).sum(axis=0)
        return Vectors.dense(mean / mean.sum() if mean.sum() else mean)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        m, spark = self.fitted, dataset.sparkSession
        width, k = len(m.cuts), m.classes
        rows = stored(dataset.withColumn("__row", F.monotonically_increasing_id()), "scored")
        copies = max(1, -(-rows.count() // SCORED_ROWS))
        held = spark.sparkContext.broadcast(([t.arrays() for t in m.tops], m.cuts))

        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops, cuts = held.value
            for whole in batches:
                for i in range(0, whole.num_rows, _BLOCK):
                    b = whole.slice(i, _BLOCK).to_pydict()
                    x = to_bins(np.array([v if v is not None and len(v) == width else [np.nan] * width for v in b["x"]], np.float64).reshape(-1, width), cuts)
                    ids, x = np.array(b["__row"], np.int64), x.astype(np.uint8)
                    part = (int(ids[0]) * 0x9E3779B1 >> 7) % copies
                    for t, top in enumerate(tops):
                        node = walk(x, *top)
                        for n in np.unique(node):
                            r = node == n
                            yield _batch(tree=[t], node=[int(n)], part=[part], kind=[1], a=[ids[r].tobytes()], b=[x[r].tobytes()], c=[None], d=[None])

        def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = None
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    if r["kind"] == 0:
                        leaves = np.frombuffer(r["d"], np.float32).reshape(-1, k).astype(np.float64)
                        tree = [np.frombuffer(r[c], t) for c, t in (("a", np.int16), ("b", np.uint8), ("c", np.int32))]
                        votes = np.rint(leaves / leaves.sum(axis=1, keepdims=True) * _VOTE).astype(np.int64)
                        continue
                    x = np.frombuffer(r["b"], np.uint8).reshape(-1, width)
                    v = votes[tree[2][walk(x, *tree)]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["a"], np.int64)), *map(pa.array, v.T.copy())], names=names)
        names = ["__row", *(f"v{i}" for i in range(k))]
        schema = "tree int, node int, part int, kind int, a binary, b binary, c binary, d binary"
        dealt = rows.select("__row", _feature_array(rows, m.features).alias("x")).mapInArrow(deal, schema)
        trees = self._table(spark).select("tree", "node", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("part"), F.lit(0).alias("kind"),
                                          F.col("feature").alias("a"), F.col("cut").alias("b"), F.col("child").alias("c"), F.col("leaves").alias("d"))
        n = min(copies * sum(t.feature.count(-1) for t in m.tops), 4096)
        met = trees.unionByName(dealt).repartition(n, "tree", "node", "part").sortWithinPartitions("tree", "node", "part", "kind")
        votes = met.mapInArrow(vote, ", ".join(f"{c} long" for c in names)).groupBy("__row").agg(*[F.sum(c).alias(c) for c in names[1:]])
        raw = F.transform(F.array(*names[1:]), lambda v: v / F.lit(float(_VOTE)))
        out = rows.join(votes, "__row").withColumn("__raw", raw).drop("__row", *names[1:])
        total = F.aggregate("__raw", F.lit(0.0), lambda a, v: a + v)
        return (out.withColumn("rawPrediction", array_to_vector("__raw"))
                .withColumn("probability", array_to_vector(F.transform("__raw", lambda v: v / F.lit(float(len(m.tops))))))
                .withColumn("prediction", F.when(total > 0, F.array_position("__raw", F.array_max("__raw")) - 1).cast("double")).drop("__raw"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    """Parameters as Spark ML metadata, the splits above the subtrees by tree, and the table of subtrees."""

    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m, spark = self.model.fitted, self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        spark.createDataFrame([(m.features, [[float(c) for c in x] for x in m.cuts], m.classes)],
                              "features string, cuts array<array<double>>, classes int").write.parquet(f"{path}/head")
        spark.createDataFrame([(i, t.feature, t.cut, t.child, t.depth, g) for i, (t, g) in enumerate(zip(m.tops, m.top_gains, strict=True))],
                              "tree int, feature array<int>, cut array<int>, child array<int>, depth array<int>, gain array<double>"
                              ).write.parquet(f"{path}/tops")
        self.model._table(spark).write.parquet(f"{path}/subtrees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        h = self.sparkSession.read.parquet(f"{path}/head").first()
        rows = self.sparkSession.read.parquet(f"{path}/tops").orderBy("tree").collect()
        tops = [Top(list(r.feature), list(r.cut), list(r.child), list(r.depth)) for r in rows]
        model = ForestModel(Fitted(h.features, [np.array(c) for c in h.cuts], h.classes, tops, f"{path}/subtrees", [list(r.gain) for r in rows]))
        model._resetUid(meta["uid"])
        return model
