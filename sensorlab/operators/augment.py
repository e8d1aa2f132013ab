"""Augmentation of the sample table.

Every operator maps (sample_id, label, series) -> the same schema, for one
augmentation ``round``.  Random draws are hash-uniforms of (seed, round,
operator, sample[, step]) computed as column expressions, so results are
identical on every run, partitioning and task retry, and most operators have
an exact SQL twin.  Array work is per row (higher-order functions); spline
and DTW-guided operators run in Arrow-batched pandas UDFs that receive their
random draws as array columns.  Partner samples come from equi-joins on
(class, hash position) - a bounded number per sample.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import random as R
from ..functions.arrays import let
from . import dtw as D

_ARR = ArrayType(DoubleType())
S = "series"
_ROWS = 512  # rows of an Arrow batch that a kernel works on together


def _n() -> Column:
    return F.size(S)


# ---- A1-A5, A8: pure array expressions ---------------------------------------------

def _nested(df: DataFrame) -> bool:
    """Whether the series holds an array of channel values per step."""
    return isinstance(df.schema[S].dataType.elementType, ArrayType)


def _width() -> Column:
    """Channels per step."""
    return F.size(F.get(F.col(S), 0))


def _by_channel(values: Column, body) -> Column:
    """The series with ``body(x, value of its channel)`` for every entry;
    ``values`` (one per channel) are worked out once per row."""
    return let(values, lambda v: F.transform(F.col(S), lambda step: F.zip_with(step, v, body)))


def jitter(df: DataFrame, seed: int = 0, sigma: float = 0.03) -> DataFrame:
    """A1: x + N(0, sigma) per value (of every channel)."""
    def noise(*place):
        return R.normal(seed, F.col("round"), "jitter", F.col("sample_id"), *place, sigma=sigma)
    if _nested(df):
        return df.withColumn(S, F.transform(F.col(S), lambda v, i: F.transform(v, lambda x, c: x + noise(i, c))))
    return df.withColumn(S, F.transform(F.col(S), lambda x, i: x + noise(i)))


def scaling(df: DataFrame, seed: int = 0, sigma: float = 0.1) -> DataFrame:
    """A2: x * N(1, sigma), one factor per (sample, channel)."""
    def factor(*place):
        return R.normal(seed, F.col("round"), "scaling", F.col("sample_id"), *place, mean=1.0, sigma=sigma)
    if _nested(df):
        return df.withColumn(S, _by_channel(F.transform(F.sequence(F.lit(0), _width() - 1), lambda c: factor(c)),
                                            lambda x, k: x * k))
    return df.withColumn(S, let(factor(), lambda k: F.transform(F.col(S), lambda x: x * k)))


def rotation(df: DataFrame, seed: int = 0) -> DataFrame:
    """A3: random sign per (sample, channel).  The channels of an array per step
    also change places, in one hash-random order for the whole call (for
    channel columns: ``rotate_channels``)."""
    def sign(*place):
        return F.when(R.uniform(seed, F.col("round"), "rotation", F.col("sample_id"), *place) < 0.5, -1.0).otherwise(1.0)
    if _nested(df):
        places = F.sequence(F.lit(0), _width() - 1)
        order = F.transform(F.array_sort(F.transform(places, lambda c: F.struct(
            R.uniform(seed, "rotation", "order", c).alias("u"), c.alias("c")))), lambda e: e["c"])
        moved = let(order, lambda o: F.transform(F.col(S), lambda v: F.transform(o, lambda c: F.get(v, c))))
        return df.withColumn(S, moved).withColumn(S, _by_channel(F.transform(places, lambda c: sign(c)), lambda x, k: x * k))
    return df.withColumn(S, let(sign(), lambda k: F.transform(F.col(S), lambda x: x * k)))


def rotate_channels(channels: Sequence[str], seed: int = 0) -> list[str]:
    """A3 channel shuffle: one hash-random order of the channel names."""
    import hashlib
    return sorted(channels, key=lambda c: hashlib.md5(f"{seed}|rotate|{c}".encode()).hexdigest())


def _permute_segments(a: Column, starts: Column, sizes: Column, order: Column) -> Column:
    """Concatenate slices (start, size) of ``a`` in the given segment order."""
    return F.flatten(F.transform(order, lambda j: F.slice(a, F.element_at(starts, j + 1) + 1,
                                                             F.element_at(sizes, j + 1))))


def permutation(df: DataFrame, seed: int = 0, max_segments: int = 5, mode: str = "equal") -> DataFrame:
    """A4 / A5: 1..max_segments-1 segments (hash draw); 'equal' splits like
    numpy.array_split, 'random' cuts at distinct hash-chosen points in
    0..n-3; segments are concatenated in a hash-random order."""
    op = "perm" if mode == "equal" else "rperm"
    k = (1 + F.floor(R.uniform(seed, F.col("round"), op, F.col("sample_id"), "k") * (max_segments - 1))).cast("int")
    d = df.withColumn("_k", k)
    n = _n()
    if mode == "equal":
        base, extra = (n / F.col("_k")).cast("int"), n % F.col("_k")
        starts = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: j * base + F.least(j, extra))
        sizes = F.transform(F.sequence(F.lit(0), F.col("_k") - 1),
                            lambda j: base + F.when(j < extra, 1).otherwise(0))
    else:
        cand = F.transform(F.sequence(F.lit(0), n - 3), lambda p: F.struct(
            R.uniform(seed, F.col("round"), op, F.col("sample_id"), "cut", p).alias("u"), p.alias("p")))
        cuts = F.array_sort(F.transform(F.slice(F.array_sort(cand), 1, F.col("_k") - 1), lambda e: e["p"]))
        bounds = F.concat(F.array(F.lit(0)), cuts, F.array(n))
        starts = F.slice(bounds, 1, F.col("_k"))
        sizes = F.transform(F.sequence(F.lit(1), F.col("_k")),
                            lambda j: F.element_at(bounds, j + 1) - F.element_at(bounds, j))
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: F.struct(
        R.uniform(seed, F.col("round"), op, F.col("sample_id"), "seg", j).alias("u"), j.alias("j")))),
        lambda e: e["j"])
    out = F.when(F.col("_k") > 1, _permute_segments(F.col(S), starts, sizes, order)).otherwise(F.col(S))
    return d.withColumn(S, out).drop("_k")


def interp_uniform(seg: Column, n_out: Column, x_end: Column, nested: bool = False) -> Column:
    """numpy.interp(linspace(0, x_end, n_out), arange(len(seg)), seg) as an
    array expression (clamped at both ends); per channel if ``nested``."""
    L = F.size(seg)

    def between(low, high, share):
        return F.zip_with(low, high, lambda x, y: x + share * (y - x)) if nested else low + share * (high - low)
    return F.transform(F.sequence(F.lit(0), n_out - 1), lambda i: let(
        F.when(n_out > 1, i * x_end / (n_out - 1)).otherwise(F.lit(0.0)), lambda q: F.when(
            q >= L - 1, F.element_at(seg, L)).otherwise(between(
                F.element_at(seg, F.floor(q).cast("int") + 1), F.element_at(seg, F.floor(q).cast("int") + 2),
                q - F.floor(q)))))


def window_slice(df: DataFrame, seed: int = 0, reduce_ratio: float | Column = 0.9) -> DataFrame:
    """A random window of ceil(ratio * n) steps stretched back to n
    steps by linear interpolation (unchanged when the window is the whole
    series)."""
    n = _n()
    ratio = reduce_ratio if isinstance(reduce_ratio, Column) else F.lit(float(reduce_ratio))
    tl = F.ceil(ratio * n).cast("int")
    d = df.withColumn("_tl", tl)
    start = F.floor(R.uniform(seed, F.col("round"), "wslice", F.col("sample_id")) * (n - F.col("_tl"))).cast("int")
    seg = F.slice(F.col(S), start + 1, F.col("_tl"))
    out = F.when(F.col("_tl") >= n, F.col(S)).otherwise(
        interp_uniform(seg, n, F.col("_tl").cast("double"), _nested(df)))
    return d.withColumn(S, out).drop("_tl")


def _series_udf(df: DataFrame, kernel):
    """``kernel`` (columns of a batch -> one (steps, channels) matrix per row) as a column function
    with the series' own type.  The results are often exploded; a deterministic function would
    then be evaluated a second time, for the size of its result."""
    nested = _nested(df)

    @pandas_udf(ArrayType(_ARR) if nested else _ARR)
    def f(s: pd.Series, *more: pd.Series) -> pd.Series:
        out = []
        for part, *rest in _parts(s, *more):
            out += [x.tolist() if nested else x[:, 0] for x in kernel(_matrices(part), *rest)]
        return pd.Series(out, dtype=object)
    return f.asNondeterministic()


def _parts(*columns: pd.Series):
    """The columns of a batch, ``_ROWS`` rows at a time: what a kernel holds does not grow with the batch."""
    for i in range(0, max(1, len(columns[0])), _ROWS):
        yield [c.iloc[i:i + _ROWS] for c in columns]


def _matrix(a) -> np.ndarray:
    """A series as (steps, channels)."""
    if len(a) and np.ndim(a[0]):
        return np.stack([np.asarray(v, np.float64) for v in a])
    return np.asarray(a, np.float64)[:, None]


def _matrices(s) -> list[np.ndarray]:
    return [_matrix(a) for a in s]


def _equal_rows(xs: list[np.ndarray]):
    """(shape, row numbers, (rows, steps, channels)) by shape."""
    shapes = np.array([x.shape for x in xs]).reshape(-1, 2)
    for shape in np.unique(shapes, axis=0):
        rows = np.flatnonzero((shapes == shape).all(axis=1))
        yield tuple(shape.tolist()), rows, np.stack([xs[i] for i in rows])


# ---- A6, A7, A9: spline and window warps (pandas UDFs) -----------------------------

@lru_cache(256)
def spline_basis(n: int, knots: int) -> np.ndarray:
    """Matrix (n x knots) that takes the values at ``knots`` evenly spaced places of 0 .. n - 1 to
    the not-a-knot cubic spline through them at every step: the spline is linear in its values."""
    xk, y = np.linspace(0, n - 1.0, num=knots), np.eye(knots)
    h = np.diff(xk)
    a, b = np.zeros((knots, knots)), np.zeros((knots, knots))
    # unknown second derivatives: the first derivative is continuous at the inner places
    for i in range(1, knots - 1):
        a[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    # not-a-knot: the third derivative is continuous next to both ends
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    bend = np.linalg.solve(a, b)
    at = np.arange(n)
    i = np.clip(np.searchsorted(xk, at, side="right") - 1, 0, knots - 2)
    width = (xk[i + 1] - xk[i])[:, None]
    right, left = xk[i + 1][:, None] - at[:, None], at[:, None] - xk[i][:, None]
    return (bend[i] * right ** 3 / (6 * width) + bend[i + 1] * left ** 3 / (6 * width)
            + (y[i] / width - bend[i] * width / 6) * right + (y[i + 1] / width - bend[i + 1] * width / 6) * left)


def _knot_values(knots: pd.Series, rows: np.ndarray, channels: int) -> np.ndarray:
    """(rows, knots, channels)"""
    return np.stack([np.asarray(knots.iloc[i], np.float64).reshape(-1, channels) for i in rows])


def _magnitude_warp(xs: list[np.ndarray], knots: pd.Series) -> list[np.ndarray]:
    out = list(xs)
    for (n, c), rows, x in _equal_rows(xs):
        if n < 2:
            continue
        k = _knot_values(knots, rows, c)
        for r, y in zip(rows, x * (spline_basis(n, k.shape[1]) @ k), strict=True):
            out[r] = y
    return out


def _time_warp(xs: list[np.ndarray], knots: pd.Series) -> list[np.ndarray]:
    """Where the warped axis would run backwards it stands still (running maximum)."""
    out = list(xs)
    for (n, c), rows, x in _equal_rows(xs):
        if n < 2:
            continue
        k = _knot_values(knots, rows, c)
        axis = spline_basis(n, k.shape[1]) @ (k * np.linspace(0, n - 1.0, num=k.shape[1])[None, :, None])
        axis = np.maximum.accumulate(np.clip((n - 1) / axis[:, -1:] * axis, 0, n - 1), axis=1)
        # last place of the axis at or before every step: the places are counted per step, then summed up
        flat = axis.transpose(0, 2, 1).reshape(-1, n)
        step = np.ceil(flat).astype(np.int64)
        count = np.zeros((len(flat), n + 1), np.int64)
        np.add.at(count, (np.arange(len(flat))[:, None], np.minimum(step, n)), 1)
        left = np.maximum(np.cumsum(count, axis=1)[:, :n] - 1, 0)
        right = np.minimum(left + 1, n - 1)
        y = x.transpose(0, 2, 1).reshape(-1, n)
        x0, x1 = np.take_along_axis(flat, left, 1), np.take_along_axis(flat, right, 1)
        y0, y1 = np.take_along_axis(y, left, 1), np.take_along_axis(y, right, 1)
        gap = x1 - x0
        share = np.where(gap > 0, (np.arange(n) - x0) / np.where(gap > 0, gap, 1), 0)
        done = (y0 + share * (y1 - y0)).reshape(len(rows), c, n).transpose(0, 2, 1)
        for r, v in zip(rows, done, strict=True):
            out[r] = v
    return out


def _knots(df: DataFrame, seed, op, knot, sigma) -> Column:
    """N(1, sigma) values per knot; of several channels, all of a knot follow one another."""
    def draw(*place):
        return R.normal(seed, F.col("round"), op, F.col("sample_id"), *place, mean=1.0, sigma=sigma)
    if not _nested(df):
        return F.transform(F.sequence(F.lit(0), F.lit(knot + 1)), lambda k: draw(k))
    width = F.greatest(F.coalesce(_width(), F.lit(1)), F.lit(1))
    return F.transform(F.sequence(F.lit(0), width * (knot + 2) - 1), lambda i: draw(F.floor(i / width), i % width))


def magnitude_warp(df: DataFrame, seed: int = 0, sigma: float = 0.2, knot: int = 4) -> DataFrame:
    """X times a not-a-knot cubic spline through knot+2 N(1, sigma) values (each channel its own)."""
    return df.withColumn(S, _series_udf(df, _magnitude_warp)(F.col(S), _knots(df, seed, "magwarp", knot, sigma)))


def time_warp(df: DataFrame, seed: int = 0, sigma: float = 0.2, knot: int = 4) -> DataFrame:
    """Resample x along a spline-distorted time axis (each channel its own)."""
    return df.withColumn(S, _series_udf(df, _time_warp)(F.col(S), _knots(df, seed, "timewarp", knot, sigma)))


def _window_warp(xs: list[np.ndarray], u: pd.Series, v: pd.Series) -> list[np.ndarray]:
    """All rows of a length at once.  Nothing is cut or joined: position t of the
    result falls between two positions of the stretched series, and each of
    those is a fractional position of the input, by three straight pieces
    (before, inside and after the window)."""
    out = list(xs)
    rate, place = np.where(u.to_numpy() < 0.5, 0.5, 2.0), v.to_numpy()
    for (n, _), rows, x in _equal_rows(xs):
        if n < 3:
            continue
        size = -(-n // 10)
        begin = 1 + np.floor(place[rows] * max(n - size - 2, 0)).astype(np.int64)
        inner = (size * rate[rows]).astype(np.int64)  # length of the window afterwards
        total = n - size + inner
        spot = np.arange(n) * ((total - 1) / (n - 1.0))[:, None]
        low = np.minimum(spot.astype(np.int64), np.maximum(total - 2, 0)[:, None])

        def value(k, x=x, b=begin[:, None], m=inner[:, None], n=n, size=size):
            within = b + (k - b) * ((size - 1) / np.maximum(m - 1, 1))
            at = np.where(k < b, k, np.where(k < b + m, within, k - m + size))
            left = np.clip(at.astype(np.int64), 0, n - 1)
            right = np.minimum(left + 1, n - 1)
            share = (at - left)[:, :, None]
            return np.take_along_axis(x, left[:, :, None], 1) * (1 - share) + np.take_along_axis(x, right[:, :, None], 1) * share
        share = (spot - low)[:, :, None]
        for r, y in zip(rows, value(low) * (1 - share) + value(low + 1) * share, strict=True):
            out[r] = y
    return out


def window_warp(df: DataFrame, seed: int = 0) -> DataFrame:
    """A 10 % window sped up (x0.5) or slowed down (x2), then the series
    resampled to its length; all channels alike."""
    u = R.uniform(seed, F.col("round"), "wwarp", F.col("sample_id"), "scale")
    v = R.uniform(seed, F.col("round"), "wwarp", F.col("sample_id"), "start")
    return df.withColumn(S, _series_udf(df, _window_warp)(F.col(S), u, v))


# ---- A10-A15: DTW-guided operators -------------------------------------------------

def _partners(df: DataFrame, seed: int, offsets, other_k: int = 0) -> DataFrame:
    """Partners inside the same round, of the same class or (``other_k``) of
    other classes: (_pk, d, partner_series)."""
    keyed = _with_pk(df).select("_pk", F.col("round").cast("string").alias("_round"), F.col("label").alias("_label"),
                                F.struct("round", "label").alias("_cls"), F.col(S))
    if other_k:
        p = D.other_class_partners(keyed, label="_label", key="_pk", series=S, seed=seed, k=other_k, within="_round")
        return p.select("_pk", F.col("n").alias("d"), "partner_series")
    p = D.class_partners(keyed, label="_cls", key="_pk", series=S, seed=seed, offsets=offsets)
    return p.select("_pk", "d", "partner_series")


def _spread(df: DataFrame) -> DataFrame:
    """Hash-spread rows for a CPU-heavy Python stage, whatever partitions they came in."""
    return df.repartition("round", "sample_id")


def _with_pk(df: DataFrame) -> DataFrame:
    return df.withColumn("_pk", F.concat_ws("|", F.col("round").cast("string"), F.col("sample_id").cast("string")))


def _window_len(n: int) -> int:
    return int(np.ceil(n / 10.0))


def _dtw_many(pairs, shape: bool = False, want_path: bool = False, slope: str = "symmetric"):
    """DTW of many (prototype, sample) pairs of (steps, channels) at once, one path
    for all channels: pairs of equal lengths share one batched dynamic program.  Returns [(distance, (p, q) or None)]."""
    out = [None] * len(pairs)
    groups: dict = {}
    for k, (a, b) in enumerate(pairs):
        groups.setdefault((len(a), len(b)), []).append(k)
    for (la, lb), all_idx in groups.items():
        step = max(1, D._CELLS // ((la + 1) * (lb + 1)))
        for start in range(0, len(all_idx), step):
            idx = all_idx[start:start + step]
            P, Q = (np.stack([pairs[k][side] for k in idx]) for side in (0, 1))
            w = _window_len(lb)
            cost = D._shape_cost(P, Q, w) if shape else D._band_cost(P, Q, w)
            Dm = D._cumulative(cost, slope, w)
            paths = D.warping_paths(Dm, slope) if want_path else [None] * len(idx)
            for k, d, path in zip(idx, Dm[:, -1, -1].tolist(), paths, strict=True):
                out[k] = (d, path)
    return out


def _resample(warped: np.ndarray, n: int) -> np.ndarray:
    """``n`` evenly spread steps of (steps, channels)."""
    at = np.linspace(0, n - 1.0, num=warped.shape[0])
    return np.stack([np.interp(np.arange(n), at, c) for c in warped.T], axis=1)


def _spawner(xs: list[np.ndarray], partner: pd.Series, r: pd.Series, noise: pd.Series) -> list[np.ndarray]:
    jobs, who, other = [], [], {}
    for t, (x, b, rp) in enumerate(zip(xs, partner, r, strict=True)):
        if b is not None:
            y, rp = _matrix(b), int(rp)
            jobs += [(x[:rp], y[:rp]), (x[rp:], y[rp:])]
            who.append(t)
            other[t] = y
    res = _dtw_many(jobs, want_path=True)
    out = list(xs)
    for m, t in enumerate(who):
        x, y, rp = xs[t], other[t], int(r.iloc[t])
        p1, p2 = res[2 * m][1], res[2 * m + 1][1]
        comb = np.concatenate((np.vstack(p1), np.vstack(p2) + rp), axis=1)
        out[t] = _resample((x[comb[0]] + y[comb[1]]) / 2.0, len(x))
    return [x + np.asarray(nz, np.float64).reshape(x.shape) for x, nz in zip(out, noise, strict=True)]


def spawner(df: DataFrame, seed: int = 0, sigma: float = 0.05) -> DataFrame:
    """A10: average of the sample and a same-class partner along a DTW path
    split at a random point (two symmetric DTWs with a 10 % band), resampled,
    plus N(0, sigma) jitter.  Samples without a partner keep their values
    (plus jitter)."""
    p = _partners(df, seed, (1,)).drop("d")
    d = _spread(_with_pk(df).join(p, "_pk", "left").drop("_pk"))
    r = (1 + F.floor(R.uniform(seed, F.col("round"), "spawner", F.col("sample_id")) * (_n() - 2))).cast("int")

    def jit(*place):
        return R.normal(seed, F.col("round"), "spawner-j", F.col("sample_id"), *place, sigma=sigma)
    if _nested(df):  # all channels of a step follow one another
        width = F.greatest(_width(), F.lit(1))
        noise = F.transform(F.flatten(S), lambda x, i: jit(F.floor(i / width), i % width))
    else:
        noise = F.transform(F.col(S), lambda x, i: jit(i))
    return d.withColumn(S, _series_udf(df, _spawner)(F.col(S), F.col("partner_series"), r, noise)).drop("partner_series")


def _flat(lists) -> tuple[list[np.ndarray], np.ndarray]:
    """Series of all rows in one list, and the row of each."""
    sizes = [0 if x is None else len(x) for x in lists]
    return ([_matrix(m) for x in lists if x is not None for m in x], np.repeat(np.arange(len(sizes)), sizes))


def _meet(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into left, into right) with the same row; both row lists ascend."""
    lo, hi = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
    a = np.repeat(np.arange(len(left)), hi - lo)
    b = np.arange(len(a)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    return a, b


def _distances(xs, ys, a, b, shape: bool = False) -> np.ndarray:
    return np.array([d for d, _ in _dtw_many([(xs[i], ys[j]) for i, j in zip(a, b, strict=True)], shape)])


def _best_per_row(row: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Index of the smallest score of every row that occurs (the first on ties)."""
    order = np.lexsort((score, row))
    return order[np.unique(row[order], return_index=True)[1]]


def _wdba(own: list[np.ndarray], others: pd.Series) -> list[np.ndarray]:
    """Barycentres around the medoid: every other member is laid along its path to
    the medoid with weight 0.5 ** (distance / distance of the nearest)."""
    members = [[x, *([] if o is None else map(_matrix, o))] for x, o in zip(own, others, strict=True)]
    xs, row = [m for x in members for m in x], np.repeat(np.arange(len(members)), [len(x) for x in members])
    a, b = _meet(row, row)
    a, b = a[a != b], b[a != b]
    dist = _distances(xs, xs, a, b)
    medoid = _best_per_row(row, np.bincount(a, dist, len(xs)))
    centre = np.full(len(members), -1)
    centre[row[medoid]] = medoid
    spoke = np.flatnonzero(centre[row[a]] == a)  # pairs (medoid, member)
    near = np.full(len(members), np.inf)
    np.minimum.at(near, row[a[spoke]], dist[spoke])
    spoke = spoke[near[row[a[spoke]]] > 0]  # a copy of the medoid leaves it as it is
    total = {int(row[m]): xs[m].copy() for m in medoid}
    weight = {t: np.ones(len(x)) for t, x in total.items()}
    paths = _dtw_many([(xs[a[k]], xs[b[k]]) for k in spoke], want_path=True)
    for k, (_, (p, q)) in zip(spoke, paths, strict=True):
        t = int(row[a[k]])
        w = 0.5 ** (dist[k] / near[t])
        np.add.at(total[t], p, w * xs[b[k]][q])
        np.add.at(weight[t], p, w)
    return [total[t] / weight[t][:, None] for t in range(len(members))]


def wdba(df: DataFrame, seed: int = 0, batch_size: int = 6) -> DataFrame:
    """Weighted DTW barycentre of ``batch_size`` same-class samples
    (the sample and its successors in a hash order, fewer for small classes)
    around their medoid.  Each target gathers a bounded member list."""
    p = _partners(df, seed, list(range(1, batch_size)))
    mem = p.groupBy("_pk").agg(F.collect_list(F.struct("d", "partner_series")).alias("_m"))
    d = _spread(_with_pk(df).join(mem, "_pk", "left").drop("_pk"))
    others = F.transform(F.array_sort("_m"), lambda e: e["partner_series"])
    return d.withColumn(S, _series_udf(df, _wdba)(F.col(S), others)).drop("_m")


def _guided(shape: bool):
    def kernel(xs: list[np.ndarray], proto: pd.Series) -> list[np.ndarray]:
        who = [t for t, b in enumerate(proto) if b is not None]
        out = list(xs)
        for t, (_, (_, q)) in zip(who, _dtw_many([(_matrix(proto.iloc[t]), xs[t]) for t in who], shape, True), strict=True):
            out[t] = _resample(xs[t][q], len(xs[t]))
        return out
    return kernel


def random_guided_warp(df: DataFrame, seed: int = 0, shape: bool = False) -> DataFrame:
    """Warp the sample along its DTW (or shape-DTW) path to a
    random same-class prototype, resampled to its length."""
    p = _partners(df, seed, (1,)).drop("d")
    d = _spread(_with_pk(df).join(p, "_pk", "left").drop("_pk"))
    return d.withColumn(S, _series_udf(df, _guided(shape))(F.col(S), F.col("partner_series"))).drop("partner_series")


def _disc_udf(shape: bool, nested: bool):
    from pyspark.sql.types import StructField, StructType
    rt = StructType([StructField("x", ArrayType(_ARR) if nested else _ARR), StructField("warp", DoubleType())])

    def kernel(s: pd.Series, pos: pd.Series, neg: pd.Series) -> pd.DataFrame:
        """A prototype's merit is its mean distance to the other classes less that
        to its own; the sample is laid along the path to the best one.  Rows
        without prototypes or without other classes stay as they are."""
        xs = _matrices(s)
        both = [p is not None and n is not None and len(p) > 0 and len(n) > 0 for p, n in zip(pos, neg)]
        ps, p_row = _flat([p if ok else None for p, ok in zip(pos, both)])
        ns, n_row = _flat([n if ok else None for n, ok in zip(neg, both)])
        out, amount = list(xs), np.zeros(len(xs))
        if ps:
            merit = np.zeros(len(ps))
            for other, o_row, sign in ((ns, n_row, 1.0), (ps, p_row, -1.0)):
                a, b = _meet(p_row, o_row)
                if other is ps:
                    a, b = a[a != b], b[a != b]
                count = np.maximum(np.bincount(a, minlength=len(ps)), 1)
                merit += sign * np.bincount(a, _distances(ps, other, a, b, shape), len(ps)) / count
            best = _best_per_row(p_row, -merit)
            paths = _dtw_many([(ps[k], xs[p_row[k]]) for k in best], shape, True)
            for k, (_, (_, q)) in zip(best, paths, strict=True):
                t = int(p_row[k])
                n = len(xs[t])
                out[t] = _resample(xs[t][q], n)
                amount[t] = np.abs(np.arange(n) - _resample(q.astype(np.float64)[:, None], n)[:, 0]).sum()
        return pd.DataFrame({"x": [x.tolist() if nested else x[:, 0] for x in out], "warp": amount})

    @pandas_udf(rt)
    def f(s: pd.Series, pos: pd.Series, neg: pd.Series) -> pd.DataFrame:
        return pd.concat([kernel(*part) for part in _parts(s, pos, neg)], ignore_index=True)
    return f.asNondeterministic()


def discriminative_guided_warp(df: DataFrame, seed: int = 0, batch_size: int = 6, shape: bool = False,
                               variable_slice: bool = True) -> DataFrame:
    """Among ceil(b/2) same-class prototypes pick the one whose mean
    DTW to floor(b/2) other-class samples minus its mean DTW to the other
    prototypes is largest; warp the sample along the path to it; then slice
    a window of 0.9 + 0.1 * warp / max(warp) (max over the whole table: one
    aggregate)."""
    pk, nk = int(math.ceil(batch_size / 2)), int(math.floor(batch_size / 2))
    pos = (_partners(df, seed, list(range(1, pk + 1)))
           .groupBy("_pk").agg(F.array_sort(F.collect_list(F.struct("d", "partner_series"))).alias("_p")))
    neg = (_partners(df, seed, (), other_k=nk)
           .groupBy("_pk").agg(F.array_sort(F.collect_list(F.struct("d", "partner_series"))).alias("_n")))
    d = _spread(_with_pk(df).join(pos, "_pk", "left").join(neg, "_pk", "left").drop("_pk"))
    r = _disc_udf(shape, _nested(df))(F.col(S), F.transform("_p", lambda e: e["partner_series"]),
                         F.transform("_n", lambda e: e["partner_series"]))
    d = d.withColumn("_r", r).withColumn(S, F.col("_r.x")).withColumn("warp_amount", F.col("_r.warp")).drop("_r", "_p", "_n")
    if not variable_slice:
        return d
    from ..sources.results import scratch_path
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "warped")
    d.write.parquet(path)  # the warp is computed once, for the maximum and for the result
    d = spark.read.schema(d.schema).parquet(path)
    mx = d.agg(F.max("warp_amount")).scalar()
    ratio = F.when(mx == 0, F.lit(0.9)).otherwise(F.lit(0.9) + F.lit(0.1) * F.col("warp_amount") / mx)
    return window_slice(d, seed, ratio)


# ---- A16, A17 -----------------------------------------------------------------------

# fixed values: operator names in the reference's application order, with tags
CHAIN = [("jitter", "_jitter"), ("scaling", "_scaling"), ("rotation", "_rotation"),
         ("permutation", "_permutation"), ("randompermutation", "_randomperm"), ("magwarp", "_magwarp"),
         ("timewarp", "_timewarp"), ("windowslice", "_windowslice"), ("windowwarp", "_windowwarp"),
         ("spawner", "_spawner"), ("dtwwarp", "_rgw"), ("shapedtwwarp", "_rgws"), ("wdba", "_wdba"),
         ("discdtw", "_dgw"), ("discsdtw", "_dgws")]

_OPS = {
    "jitter": jitter, "scaling": scaling, "rotation": rotation,
    "permutation": lambda d, seed: permutation(d, seed, mode="equal"),
    "randompermutation": lambda d, seed: permutation(d, seed, mode="random"),
    "magwarp": magnitude_warp, "timewarp": time_warp, "windowslice": window_slice, "windowwarp": window_warp,
    "spawner": spawner, "dtwwarp": random_guided_warp,
    "shapedtwwarp": lambda d, seed: random_guided_warp(d, seed, shape=True),
    "wdba": wdba, "discdtw": lambda d, seed: discriminative_guided_warp(d, seed).drop("warp_amount"),
    "discsdtw": lambda d, seed: discriminative_guided_warp(d, seed, shape=True).drop("warp_amount"),
}


def augment(df: DataFrame, flags: Sequence[str], seed: int = 0) -> tuple[DataFrame, str]:
    """Apply the chosen operators in the fixed order; returns the table and
    the tag string ('_jitter_scaling...')."""
    chosen = set(flags)
    unknown = chosen - set(_OPS)
    if unknown:
        raise ValueError(f"unknown augmentation {sorted(unknown)}")
    tag = ""
    for name, t in CHAIN:
        if name in chosen:
            df = _OPS[name](df, seed)
            tag += t
    return df, tag


def augmented_set(df: DataFrame, flags: Sequence[str], ratio: int = 1, seed: int = 0,
                  extra_tag: str = "") -> tuple[DataFrame, str]:
    """The originals (round 0) plus ``ratio`` augmented rounds, labels
    carried along; the tag is '<ratio>' + operator tags (+ '_' + extra)."""
    base = df.select("sample_id", "label", S).withColumn("round", F.lit(0))
    if ratio <= 0:
        return base, extra_tag
    rounds = base.select("sample_id", "label", S, F.explode(F.sequence(F.lit(1), F.lit(ratio))).alias("round"))
    aug, tags = augment(rounds, flags, seed)
    tag = f"{ratio}{tags}" + (f"_{extra_tag}" if extra_tag else "")
    return base.unionByName(aug.select("sample_id", "label", S, "round")), tag
