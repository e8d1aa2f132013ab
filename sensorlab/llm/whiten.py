"""Principal components and whitening by Chebyshev-filtered subspace iteration.

Vectors become integers; the fit list holds every distinct one once.  The
leading eigenvectors of its covariance V come from subspace iteration in which
a Chebyshev polynomial of V, built by the three-term recurrence, damps the
unwanted end of the spectrum (Zhou and Saad, 2007).  V itself is never formed:
each step is one distributed pass that centres the pages of the fit list and
sums Xc' (Xc Q) over them.  QR and a Rayleigh-Ritz step follow every filter,
until the residuals |V u - e u| certify the wanted pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored
from .textbytes import limit_batches
from .vectors import integer_rows, matrix, padded

#: Columns of the subspace beyond the wanted ones.
GUARD = 28
#: Degree of the filter polynomial: passes between two Rayleigh-Ritz steps.
DEGREE = 12
#: Wanted pairs are certified at |V u - e u| <= TOLERANCE * largest eigenvalue.
TOLERANCE = 2e-15
#: Residuals that no longer fall are accepted below this (rounding level).
FLOOR = 1e-12
ROUNDS = 60
#: Eigenvalues up to this share of the trace count as zero.
NOISE = 1e-13
PAGE_BYTES = 1 << 20


class Pages:
    """The fit list in the shared folder: rows of up to ``PAGE_BYTES`` of packed vectors."""

    def __init__(self, distinct: DataFrame, width: int):
        per_page = max(1, PAGE_BYTES // (8 * max(width, 1)))
        limit_batches(distinct.sparkSession)

        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(0), width)
                for a in range(0, len(x), per_page):
                    yield pa.RecordBatch.from_pydict({"n": pa.array([len(x[a:a + per_page])], pa.int64()),
                                                      "page": pa.array([x[a:a + per_page].tobytes()], pa.binary())})
        self.width = width
        self.table = stored(distinct.select("x").mapInArrow(pack, "n bigint, page binary"), "pages")
        self.n = self.table.agg(F.sum("n")).first()[0] or 0
        self.sums = self._sums() if self.n else [0] * width
        self.whole = np.array([s // self.n for s in self.sums] if self.n else [0] * width, np.int64)
        self.part = np.array([s % self.n / self.n for s in self.sums] if self.n else [0.0] * width)

    def _sums(self) -> list[int]:
        width = self.width

        def add(batches):
            total = [0] * width
            for b in batches:
                for p in b.column(1):
                    x = np.frombuffer(p.as_buffer(), np.int64).reshape(-1, width)
                    # halves of the values, so that no sum leaves 64 bits
                    low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
                    total = [t + int(a) + (int(c) << 32) for t, a, c in zip(total, low, high, strict=True)]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "s": pa.array(map(str, total))})
        rows = (self.table.mapInArrow(add, "i int, s string").groupBy("i")
                .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
        found = {r.i: int(r.s) for r in rows}
        return [found.get(i, 0) for i in range(width)]

    def reduce(self, make, rows: int, cols: int) -> np.ndarray:
        """Sum over all pages of make(centred page), a rows x cols matrix: summed
        in every task, then by row in a shuffle; the driver gets one matrix."""
        whole, part, width = self.whole, self.part, self.width

        def add(batches):
            total = np.zeros((rows, cols))
            for b in batches:
                for p in b.column(1):
                    total += make(np.frombuffer(p.as_buffer(), np.int64).reshape(-1, width) - whole - part)
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), *[pa.array(c) for c in total.T]],
                                             names=["i", *[f"c{j}" for j in range(cols)]])
        schema = ", ".join(["i int", *[f"c{j} double" for j in range(cols)]])
        got = self.table.mapInArrow(add, schema).groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(cols)]).collect()
        out = np.zeros((rows, cols))
        for r in got:
            out[r[0]] = r[1:]
        return out

    def covariance_times(self, q: np.ndarray) -> np.ndarray:
        """V q by one pass."""
        held = self.table.sparkSession.sparkContext.broadcast(q)
        try:
            return self.reduce(lambda x: x.T @ (x @ held.value), *q.shape) / self.n
        finally:
            held.destroy()

    def trace(self) -> float:
        return float(self.reduce(lambda x: np.array([[np.square(x).sum()]]), 1, 1)[0, 0]) / self.n


@dataclass
class Whitening:
    n: int
    sums: list[int]
    vectors: np.ndarray  # unit eigenvectors as columns
    values: np.ndarray
    trace: float
    residual: float  # largest |V u - e u| over the largest eigenvalue
    passes: int
    identity_error: float | None


def leading_pairs(pages: Pages, k: int, guard: int = GUARD, degree: int = DEGREE,
                  seed: int = 0) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The ``k`` leading eigenpairs of the covariance: (values, vectors, relative residual, passes)."""
    d = pages.width
    block = min(d, k + guard)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0]
    passes, best, before = 0, None, np.inf
    for _ in range(ROUNDS):
        image = pages.covariance_times(q)
        passes += 1
        theta, w = np.linalg.eigh((lambda a: (a + a.T) / 2)(q.T @ image))
        theta, w = theta[::-1], w[:, ::-1]
        q, image = q @ w, image @ w
        top = max(float(theta[0]), 0.0)
        off = np.linalg.norm(image[:, :k] - q[:, :k] * theta[:k], axis=0).max() if top else 0.0
        rel = float(off) / top if top else 0.0
        if best is None or rel < best[2]:
            best = theta[:k].copy(), q[:, :k].copy(), rel
        if rel <= TOLERANCE or block == d or (rel <= FLOOR and rel > before / 4):
            break
        before = rel
        # V has no eigenvalue below 0; what lies under the smallest Ritz value is damped
        half = max(float(theta[-1]), 1e-12 * top) / 2
        last, now = q, (image - half * q) / half
        for _ in range(degree - 1):
            last, now = now, (pages.covariance_times(now) - half * now) * (2 / half) - last
            passes += 1
            grown = np.linalg.norm(now, axis=0).max()
            last, now = last / grown, now / grown
        q = np.linalg.qr(now)[0]
    values, vectors, rel = best
    if rel > FLOOR:
        raise ArithmeticError(f"subspace iteration left a relative residual of {rel:.1e} after {passes} passes")
    return values, vectors, rel, passes


def fit(rows: DataFrame, components: int, guard: int = GUARD, degree: int = DEGREE) -> Whitening | None:
    """Whitening of the distinct ``x`` (arrays of longs of one length) of
    ``rows``; none without rows or dimensions.  Eigenvalues that are zero to
    rounding (fewer distinct vectors than components, constant dimensions) are
    set to 0."""
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    pages = Pages(rows.select("x").distinct(), width)
    k = min(components, width)
    trace = pages.trace()
    values, vectors, rel, passes = leading_pairs(pages, k, guard, degree)
    values = np.where(values > NOISE * trace, values, 0.0)
    real = int((values > 0).sum())
    error = None
    if real:
        to = vectors[:, :real] / np.sqrt(values[:real])

        def gram(x):
            y = x @ to
            return y.T @ y
        error = float(np.abs(pages.reduce(gram, real, real) / pages.n - np.eye(real)).max())
    return Whitening(pages.n, pages.sums, vectors, values, trace, rel, passes, error)


def whiten(df: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """One row per sound vector of ``df`` and component: ``id_col``,
    ``component`` (from 1 by falling eigenvalue), ``n`` (fit list), ``deviation``
    (sum of (n x - S)^2, exact; null if it does not fit a long), ``whitened``,
    ``explained``, ``identity_error``.

    Rows with a null vector, or one holding null or non-finite components, are
    dropped; shorter vectors are filled up with zeros.  Null and repeated ids
    stay, as do repeated rows, each with its own result rows; other columns are
    ignored.  Of fewer dimensions than components, each gives one.  Where the
    eigenvalue is 0, ``whitened`` is null; ``explained`` and ``identity_error``
    are null if all are.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = integer_rows(df, scale, id_col, vec_col)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    schema = f"component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    kind = df.schema[id_col].dataType.simpleString()
    if not width:
        return spark.createDataFrame([], f"`{id_col}` {kind}, {schema}")
    rows = padded(rows, width)
    model = fit(rows, components)
    return transform(rows, model).withColumnRenamed("id", id_col)


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """Result rows of ``whiten`` for (id, x)."""
    limit_batches(rows.sparkSession)
    n, k, width = model.n, len(model.values), len(model.sums)
    big = max(map(abs, model.sums))
    whole = np.array([s // n for s in model.sums], np.int64)
    part = np.array([s % n / n for s in model.sums])
    sums = np.array(model.sums, object)
    ok = model.values > 0
    to = model.vectors / np.sqrt(np.where(ok, model.values, 1.0))

    def deviations(x: np.ndarray) -> list:
        most = n * int(np.abs(x).max(initial=0)) + big
        if width * most * most < 1 << 63:
            return list(np.square(n * x - sums.astype(np.int64)).sum(axis=1))
        exact = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), width)
            y = (x - whole - part) @ to
            w = [[float(v) if good else None for v, good in zip(r, ok, strict=True)] for r in y]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviations(x), pa.int64()),
                                              pa.array(w, pa.list_(pa.float64()))], names=["id", "deviation", "w"])
    kind = rows.schema["id"].dataType.simpleString()
    share = F.array(*[F.lit(float(v / model.trace) if model.trace > 0 else None).cast("double") for v in model.values])
    out = rows.select("id", "x").mapInArrow(run, f"id {kind}, deviation bigint, w array<double>")
    return (out.select("id", "deviation", F.posexplode("w").alias("c", "whitened"))
            .select("id", (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
                    "whitened", F.get(share, F.col("c")).alias("explained"),
                    F.lit(model.identity_error).cast("double").alias("identity_error")))
