"""Spectral and decomposition operators on sample arrays.

FFTs run in Arrow-batched pandas UDFs: each batch stacks the series of equal
length into one matrix and calls ``numpy.fft`` once, so there is no per-row
Python loop and no shuffle (samples are independent).  Everything else -
peak picking, ranking, moving averages, smoothing, extrapolation - is a
higher-order array expression in the same projection or a small aggregate
over (bin) groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from pyspark.sql.types import ArrayType, DoubleType

from ..functions.arrays import let

_ARR = ArrayType(DoubleType())
_ARR2 = ArrayType(ArrayType(DoubleType()))


def _by_length(s: pd.Series, fn, out_len=None) -> pd.Series:
    """Apply ``fn`` (2-D array -> 2-D array) to groups of equal-length rows."""
    out = [None] * len(s)
    lens = s.map(lambda a: -1 if a is None else len(a)).to_numpy()
    for n in np.unique(lens):
        idx = np.nonzero(lens == n)[0]
        if n <= 0:
            for i in idx:
                out[i] = None if n < 0 else np.zeros(0)
            continue
        m = np.stack([np.asarray(s.iloc[i], dtype=np.float64) for i in idx])
        r = fn(m)
        for j, i in enumerate(idx):
            out[i] = r[j]
    return pd.Series(out)


@pandas_udf(_ARR)
def rfft_amp(s: pd.Series) -> pd.Series:
    """|rfft(x)| per series (bins 0..n//2)."""
    return _by_length(s, lambda m: np.abs(np.fft.rfft(m, axis=1)))


# An exploded array gets a filter on its size, into which a deterministic function would be copied.
rfft_amp = rfft_amp.asNondeterministic()


@pandas_udf(_ARR)
def rfft_polar(s: pd.Series) -> pd.Series:
    """Amplitudes of all rfft bins, then their phases: one transform for both."""
    def polar(m):
        z = np.fft.rfft(m, axis=1)
        return np.concatenate([np.abs(z), np.angle(z)], axis=1)
    return _by_length(s, polar)


# ---- G1-G3 -------------------------------------------------------------------

def amplitude_spectrum(df: DataFrame, series: str = "series", fs: float | Column = 1.0,
                       key: str = "sample_id") -> DataFrame:
    """G1: (key, bin, freq, amp) for bins 0..n//2-1 (positive half of the full
    FFT), freq = bin * fs / n."""
    n = F.size(series)
    fs_c = fs if isinstance(fs, Column) else F.lit(float(fs))
    s = df.select(key, n.alias("_n"), fs_c.alias("_fs"), rfft_amp(F.col(series)).alias("_amp"))
    x = s.select(key, "_n", "_fs", F.posexplode("_amp").alias("bin", "amp")).where(F.col("bin") < F.floor(F.col("_n") / 2))
    return x.select(key, "bin", (F.col("bin") * F.col("_fs") / F.col("_n")).alias("freq"), "amp")


def peaks(a: Column, top: int = 5, rel_height: float = 0.1) -> Column:
    """The ``top`` highest local peaks of an array with value >= ``rel_height`` *
    maximum, as ARRAY<STRUCT<neg, bin, amp>>, highest first, then by bin.

    A peak is a run of equal values above both of its neighbours; its place is the
    middle of the run (the lower of two).  Runs at the ends are none.  The runs
    follow from the places where the value changes, in one pass over the array."""
    def of_changes(x, change):
        runs = F.transform(change, lambda c, k: F.struct(c.alias("first"), F.get(change, k + 1).alias("after")))
        tops = F.filter(runs, lambda r: r.after.isNotNull() & (F.get(x, r.first) > F.get(x, r.first - 1))
                        & (F.get(x, r.after) < F.get(x, r.first)) & (F.get(x, r.first) >= F.array_max(x) * rel_height))
        found = F.transform(tops, lambda r: F.struct((-F.get(x, r.first)).alias("neg"),
                                                     ((r.first + r.after - 1) / 2).cast("int").alias("bin"), F.get(x, r.first).alias("amp")))
        return F.slice(F.array_sort(found), 1, top)

    def changes(x):
        inner = F.when(F.size(x) > 1, F.sequence(F.lit(1), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(inner, lambda i: F.get(x, i) != F.get(x, i - 1))
    return let(a, lambda x: let(changes(x), lambda c: of_changes(x, c)))


def dominant_frequencies(df: DataFrame, series: str = "series", fs: float = 1.0, top: int = 5,
                         key: str = "sample_id", rel_height: float = 0.1) -> DataFrame:
    """Local amplitude peaks (see :func:`peaks`) of the positive half
    spectrum, the ``top`` largest per sample: (key, rank, bin, freq, amp).
    Peak search is an array expression per row."""
    n = F.size(series)
    half = F.slice(rfft_amp(F.col(series)), 1, F.floor(n / 2).cast("int"))
    s = df.select(key, n.alias("_n"), half.alias("a"))
    x = s.select(key, "_n", F.posexplode(peaks(F.col("a"), top, rel_height)).alias("r", "e"))
    return x.select(key, (F.col("r") + 1).alias("rank"), F.col("e.bin").alias("bin"),
                    (F.col("e.bin") * F.lit(float(fs)) / F.col("_n")).alias("freq"), F.col("e.amp").alias("amp"))


def mean_spectrum(df: DataFrame, series: str = "series") -> DataFrame:
    """Mean rfft amplitude per bin over all samples: (bin, mean_amp, n_len).
    One partial aggregate over (bin) - the bin count is bounded by the
    series length, not by the number of samples."""
    x = df.select(F.size(series).alias("n_len"), F.posexplode(rfft_amp(F.col(series))).alias("bin", "amp"))
    return x.groupBy("n_len", "bin").agg(F.avg("amp").alias("mean_amp"))


def main_periods(df: DataFrame, series: str = "series", k: int = 2) -> DataFrame:
    """Top ``k`` bins of the mean amplitude (DC excluded) and their period
    n // bin, per series length: (n_len, rank, bin, period, mean_amp)."""
    m = mean_spectrum(df, series).where(F.col("bin") > 0)
    w = Window.partitionBy("n_len").orderBy(F.col("mean_amp").desc(), F.col("bin"))  # one row per bin
    r = m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return r.select("n_len", "rank", "bin", (F.col("n_len") / F.col("bin")).cast("int").alias("period"), "mean_amp")


def period_weights(df: DataFrame, periods: DataFrame, series: str = "series", key: str = "sample_id") -> DataFrame:
    """Per sample amplitude at each chosen bin of its length (the period
    weights).  The chosen-bin table has ``k`` rows per length."""
    x = df.select(key, F.size(series).alias("n_len"), F.posexplode(rfft_amp(F.col(series))).alias("bin", "amp"))
    chosen = periods.select("n_len", "rank", "bin", "period")
    return x.join(chosen, ["n_len", "bin"]).select(key, "rank", "period", "amp")


# ---- G4, G5: moving-average decomposition ----------------------------------------

def moving_average(a: Column, kernel: int) -> Column:
    """Centred moving average with the ends repeated (odd ``kernel``): differences of
    running sums, all series of a length at once, so a longer kernel costs nothing."""
    h = (kernel - 1) // 2

    def means(m: np.ndarray) -> np.ndarray:
        level = m.mean(axis=1, keepdims=True)  # sums about the mean stay small
        run = np.cumsum(np.pad(m - level, ((0, 0), (h, h)), mode="edge"), axis=1)
        run = np.pad(run, ((0, 0), (1, 0)))
        return (run[:, kernel:] - run[:, :-kernel]) / kernel + level

    @pandas_udf(_ARR)
    def smooth(s: pd.Series) -> pd.Series:
        return _by_length(s, means)
    return smooth(a)


def decompose(df: DataFrame, series: str = "series", kernels=(25,)) -> DataFrame:
    """trend = mean of centred moving averages over ``kernels`` (one
    kernel = G4), seasonal = x - trend.  Adds ``trend`` and ``seasonal``."""
    a = F.col(series)
    trends = [moving_average(a, k) for k in kernels]
    if len(trends) == 1:
        trend = trends[0]
    else:
        z = F.arrays_zip(*[t.alias(f"t{i}") for i, t in enumerate(trends)])
        trend = F.transform(z, lambda e: sum((e[f"t{i}"] for i in range(len(trends))), F.lit(0.0)) / len(trends))
    d = df.withColumn("trend", trend)
    return d.withColumn("seasonal", F.transform(F.arrays_zip(a.alias("x"), F.col("trend").alias("t")),
                                                lambda e: e["x"] - e["t"]))


def decompose_series(df: DataFrame, keys, order, value: str = "value", kernel: int = 25,
                     chunk: Column | None = None, bucket: int | None = None) -> DataFrame:
    """G4 on long telemetry: centred moving average over ``kernel`` rows with
    the series ends repeated, per key; adds ``trend`` and ``seasonal``.

    Uses the chunked layout: each position bucket borrows ``h`` rows on both
    sides; the missing terms near the series ends are the first / last value
    times the number of missing rows (from a one-row-per-key table)."""
    from ..plans import chunked as C
    h = (kernel - 1) // 2
    rows, _ = C.index_series(df, keys, order, chunk)
    base = [c for c in C.drop_index(rows).columns if c not in keys]
    ends = (rows.where((F.col(C.POS) == 0) | (F.col(C.POS) == F.col(C.LEN) - 1))
            .groupBy(*keys).agg(F.max_by(F.col(value), -F.col(C.POS)).alias("_first"),
                                F.max_by(F.col(value), F.col(C.POS)).alias("_last")))
    both = C.with_neighbours(rows, None, keys, base, before=h, after=h, bucket=bucket)
    w = Window.partitionBy(*keys, C.CHUNK).orderBy(C.POS).rowsBetween(-h, h)
    x = both.select(*keys, *base, C.POS, C.LEN, C.BORROWED, F.sum(value).over(w).alias("_s"))
    x = x.where(~F.col(C.BORROWED)).join(ends, list(keys))
    miss_lo = F.greatest(F.lit(h) - F.col(C.POS), F.lit(0))
    miss_hi = F.greatest(F.col(C.POS) + h - (F.col(C.LEN) - 1), F.lit(0))
    trend = (F.col("_s") + miss_lo * F.col("_first") + miss_hi * F.col("_last")) / kernel
    return (x.withColumn("trend", trend).withColumn("seasonal", F.col(value) - F.col("trend"))
            .drop("_s", "_first", "_last", C.POS, C.LEN, C.BORROWED))


# ---- G6-G8: DFT-based splits -------------------------------------------------------

def _dft_season(m: np.ndarray, top_k: int) -> np.ndarray:
    xf = np.fft.rfft(m, axis=1)
    amp = np.abs(xf)
    amp[:, 0] = 0.0
    k = min(top_k, amp.shape[1])
    kth = -np.sort(-amp, axis=1)[:, k - 1:k]
    xf[amp <= kth] = 0
    return np.fft.irfft(xf, n=m.shape[1], axis=1)


def dft_decompose(df: DataFrame, series: str = "series", top_k: int = 5) -> DataFrame:
    """seasonal = inverse rfft keeping only bins whose amplitude is above
    the ``top_k``-th largest (DC excluded), trend = x - seasonal.  Per series
    and along time (see SURVEY Q17 for the reference's axis)."""
    @pandas_udf(_ARR)
    def season(s: pd.Series) -> pd.Series:
        return _by_length(s, lambda m: _dft_season(m, top_k))
    d = df.withColumn("seasonal", season(F.col(series)))
    return d.withColumn("trend", F.transform(F.arrays_zip(F.col(series).alias("x"), F.col("seasonal").alias("s")),
                                             lambda e: e["x"] - e["s"]))


def shared_bins(df: DataFrame, series: str = "series", alpha: float = 0.2) -> DataFrame:
    """Bins with the largest mean amplitude over the (training) set, the
    top int(n_bins * alpha): (bin, mean_amp, rank)."""
    m = mean_spectrum(df, series)
    nb = F.count(F.lit(1)).over(Window.partitionBy("n_len"))
    w = Window.partitionBy("n_len").orderBy(F.col("mean_amp").desc(), F.col("bin"))  # one row per bin
    r = m.withColumn("rank", F.row_number().over(w)).withColumn("_nb", nb)
    return r.where(F.col("rank") <= F.floor(F.col("_nb") * alpha)).select("n_len", "bin", "mean_amp", "rank")


def _pairs_by_length(a: pd.Series, b: pd.Series, fn) -> pd.Series:
    """Apply ``fn`` (two matrices -> matrix) to groups of rows with equal lengths in both
    columns; a missing partner counts as empty."""
    out = [None] * len(a)
    lens = np.array([(-1 if x is None else len(x), 0 if y is None else len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for n, k in np.unique(lens, axis=0).tolist():
        idx = np.flatnonzero((lens == (n, k)).all(axis=1))
        if n <= 0:
            for i in idx:
                out[i] = None if n < 0 else np.zeros(0)
            continue
        x = np.stack([np.asarray(a.iloc[i], np.float64) for i in idx])
        y = np.stack([np.asarray(b.iloc[i], np.float64) for i in idx]) if k else np.zeros((len(idx), 0))
        for i, r in zip(idx, fn(x, y), strict=True):
            out[i] = r
    return pd.Series(out)


@pandas_udf(_ARR)
def _mask_bins(s: pd.Series, bins: pd.Series) -> pd.Series:
    def clear(x, b):
        xf = np.fft.rfft(x, axis=1)
        np.put_along_axis(xf, b.astype(np.int64), 0, axis=1)
        return np.fft.irfft(xf, n=x.shape[1], axis=1)
    return _pairs_by_length(s, bins, clear)


def fourier_filter(df: DataFrame, bins: DataFrame, series: str = "series") -> DataFrame:
    """x_var = inverse rfft with the shared bins zeroed, x_inv = x - x_var.
    The bin list of each series length (at most n/2+1 entries) is joined on
    the length, never collected to the driver."""
    lst = bins.groupBy("n_len").agg(F.collect_list("bin").alias("_bins"))
    d = df.join(lst, F.size(df[series]) == lst["n_len"], "left").drop("n_len")
    d = d.withColumn("x_var", _mask_bins(F.col(series), F.col("_bins"))).drop("_bins")
    return d.withColumn("x_inv", F.transform(F.arrays_zip(F.col(series).alias("x"), F.col("x_var").alias("v")),
                                             lambda e: e["x"] - e["v"]))


# ---- G9, G10: auto-correlation ------------------------------------------------------

@pandas_udf(_ARR)
def autocorrelation(s: pd.Series) -> pd.Series:
    """Circular auto-correlation sum_t x[(t+lag) mod n] * x[t] via FFT."""
    def f(m):
        xf = np.fft.rfft(m, axis=1)
        return np.fft.irfft(xf * np.conj(xf), n=m.shape[1], axis=1)
    return _by_length(s, f)


@pandas_udf(_ARR)
def cross_correlation(q: pd.Series, k: pd.Series) -> pd.Series:
    """Circular cross-correlation sum_t q[(t+lag) mod n] * k[t] via FFT, of pairs of one length."""
    return _pairs_by_length(q, k, lambda x, y: np.fft.irfft(
        np.fft.rfft(x, axis=1) * np.conj(np.fft.rfft(y, axis=1)), n=x.shape[1], axis=1))


def time_delay_aggregate(df: DataFrame, series: str = "series", factor: float = 1.0) -> DataFrame:
    """Top int(factor * ln n) lags of the auto-correlation per sample,
    softmax weights over their correlations, and the weighted sum of the
    series rolled by each lag: agg[t] = sum_i w_i x[(t + lag_i) mod n]."""
    d = df.withColumn("_corr", autocorrelation(F.col(series)))
    a = F.col(series)

    def body(c):
        n = F.size(c)
        k = F.greatest(F.floor(F.lit(factor) * F.log(n.cast("double"))).cast("int"), F.lit(1))
        # rank on the correlation rounded to 9 places: the circular
        # auto-correlation is symmetric (lag l and n - l tie exactly), so ties
        # must fall to the smaller lag rather than to float noise
        st = F.array_sort(F.transform(c, lambda v, i: F.struct((-F.round(v, 9)).alias("neg"), i.alias("lag"),
                                                               v.alias("v"))))
        top = F.slice(st, 1, k)
        mx = F.array_max(F.transform(top, lambda e: e["v"]))
        ex = F.transform(top, lambda e: F.struct(e["lag"].alias("lag"), F.exp(e["v"] - mx).alias("w")))
        tot = F.aggregate(ex, F.lit(0.0), lambda acc, e: acc + e["w"])
        return F.struct(F.transform(ex, lambda e: F.struct(e["lag"].alias("lag"), (e["w"] / tot).alias("w"))).alias("lw"))
    d = d.withColumn("_lw", let(F.col("_corr"), body)["lw"])

    def agg(lw):
        n = F.size(a)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.aggregate(
            lw, F.lit(0.0), lambda acc, e: acc + e["w"] * F.element_at(a, ((t + e["lag"]) % n) + 1)))
    d = d.withColumn("delay_agg", let(F.col("_lw"), agg))
    return d.withColumn("lags", F.transform("_lw", lambda e: e["lag"])).drop("_corr", "_lw")


# ---- G11-G14 -------------------------------------------------------------------

def frequency_modes(n_len: Column, modes: int, method: str = "random", seed: int = 0) -> Column:
    """Mode list over bins 0..n//2 - 1: the lowest ``modes`` bins, or
    ``modes`` bins in hash-random order (seeded), sorted; all bins if there
    are fewer."""
    half = F.floor(n_len / 2).cast("int")
    bins = F.when(half > 0, F.sequence(F.lit(0), half - 1)).otherwise(F.array().cast("array<int>"))
    if method == "lowest":
        return F.slice(bins, 1, modes)
    from ..functions.random import uniform
    keyed = F.transform(bins, lambda b: F.struct(uniform(seed, "mode", b).alias("u"), b.alias("b")))
    return F.array_sort(F.transform(F.slice(F.array_sort(keyed), 1, modes), lambda e: e["b"]))


def exponential_smoothing(a: Column, weight: float, v0: float) -> Column:
    """s_t = w * s_{t-1} + (1 - w) * x_t with s_{-1} = v0 (the reference's
    parameterisation: w is the decay)."""
    def scan(m: np.ndarray) -> np.ndarray:
        """Steps s -> w s + x composed pairwise: after the round of reach k a place holds the
        composition of its last 2 k steps, so log2(n) rounds do."""
        out, k = (1.0 - weight) * m, 1
        while k < m.shape[1]:
            out[:, k:] = out[:, k:] + weight ** k * out[:, :-k]
            k *= 2
        return out + v0 * weight ** np.arange(1, m.shape[1] + 1)

    @pandas_udf(_ARR)
    def smooth(s: pd.Series) -> pd.Series:
        return _by_length(s, scan)
    return smooth(a)


def fourier_extrapolate(df: DataFrame, series: str = "series", k: int = 3, horizon: int = 8,
                        low_freq: int = 1) -> DataFrame:
    """Keep the ``k`` strongest rfft bins (from ``low_freq``; the Nyquist
    bin dropped for even n), then evaluate sum 2*|X|/n*cos(2*pi*f*t + phase)
    for t = 0 .. n + horizon - 1: ARRAY<DOUBLE> ``extrapolated``."""
    n = F.size(series)
    d = df.withColumn("_z", rfft_polar(F.col(series))).withColumn("_n", n)

    def body(z):
        nn, half = F.col("_n"), F.floor(F.size(z) / 2).cast("int")
        hi = F.when(nn % 2 == 0, half - 1).otherwise(half)
        bins = F.when(hi > low_freq, F.sequence(F.lit(low_freq), hi - 1)).otherwise(F.array().cast("array<int>"))
        cand = F.transform(bins, lambda i: F.struct((-F.get(z, i)).alias("neg"), i.alias("bin"), F.get(z, i + half).alias("phase")))
        top = F.slice(F.array_sort(cand), 1, k)
        return F.transform(F.sequence(F.lit(0), nn + horizon - 1), lambda t: F.aggregate(
            top, F.lit(0.0), lambda acc, e: acc + 2 * (-e["neg"]) / nn * F.cos(2 * math.pi * (e["bin"] / nn) * t + e["phase"])))
    return d.withColumn("extrapolated", let(F.col("_z"), body)).drop("_z", "_n")


def damped_growth(growth: Column, phi: float, horizon: int) -> Column:
    """Growth * sum_{i=1..h} phi^i for h = 1..horizon (closed form of the
    cumulative damping factor)."""
    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: growth * (
        F.lit(phi) * (F.lit(1.0) - F.pow(F.lit(phi), h)) / F.lit(1.0 - phi)))


# ---- G15, G16: wavelets ---------------------------------------------------------

# fixed values: Daubechies decomposition low-pass filters (db1 = Haar, db2)
_S3 = math.sqrt(3.0)
_DB = {
    "db1": [1 / math.sqrt(2.0), 1 / math.sqrt(2.0)],
    "db2": [(1 - _S3) / (4 * math.sqrt(2.0)), (3 - _S3) / (4 * math.sqrt(2.0)),
            (3 + _S3) / (4 * math.sqrt(2.0)), (1 + _S3) / (4 * math.sqrt(2.0))],
}


def _filters(wave: str):
    lo = np.asarray(_DB[wave])
    hi = np.asarray([(-1) ** (k + 1) * lo[len(lo) - 1 - k] for k in range(len(lo))])
    return lo, hi


def _afb(x: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """One analysis step with zero padding, all rows at once: the outputs, floor((N + L - 1) / 2)
    long, are y[i] = sum_k x[2i + 1 - k] h[k]; tap k meets every second value of a shifted view."""
    n, taps = x.shape[1], len(lo)
    out = (n + taps - 1) // 2
    wide = np.pad(x, ((0, 0), (taps - 1, taps)))
    view = [wide[:, taps - k:taps - k + 2 * out:2] for k in range(taps)]
    return sum(v * h for v, h in zip(view, lo, strict=True)), sum(v * h for v, h in zip(view, hi, strict=True))


def _sfb(lo_c: np.ndarray, hi_c: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int):
    """Synthesis step inverting :func:`_afb` (orthogonal filters): coefficient i adds its tap k to
    place 2i + 1 - k, so each tap is one strided addition for all rows."""
    taps = len(lo)
    rec = np.zeros((lo_c.shape[0], 2 * lo_c.shape[1] + taps))
    for k in range(taps):
        at = taps - 1 - k
        rec[:, at:at + 2 * lo_c.shape[1]:2] += lo_c * lo[k] + hi_c * hi[k]
    return rec[:, taps - 2:taps - 2 + n]


def wavelet_bands(wave: str = "db1", levels: int = 2):
    """Pandas UDF series -> ARRAY<ARRAY<DOUBLE>>: [detail_1, ..., detail_J,
    approximation_J] of a J-level decimated wavelet transform."""
    lo, hi = _filters(wave)

    @pandas_udf(_ARR2)
    def dwt(s: pd.Series) -> pd.Series:
        def f(m):
            bands = []
            a = m
            for _ in range(levels):
                a, d = _afb(a, lo, hi)
                bands.append(d)
            bands.append(a)
            return [[b[i] for b in bands] for i in range(m.shape[0])]
        return _by_length(s, f)
    return dwt.asNondeterministic()  # else exploded bands are computed a second time for their size


def wavelet_inverse(wave: str = "db1", levels: int = 2):
    """Pandas UDF (bands, n) -> series, the inverse of :func:`wavelet_bands`."""
    lo, hi = _filters(wave)

    @pandas_udf(_ARR)
    def idwt(bands: pd.Series, n: pd.Series) -> pd.Series:
        out = [None] * len(bands)
        sizes = n.to_numpy()
        for size in np.unique(sizes):
            idx = np.flatnonzero(sizes == size)
            lens = [int(size)]
            for _ in range(levels):
                lens.append((lens[-1] + len(lo) - 1) // 2)
            level = [np.stack([np.asarray(bands.iloc[i][j], np.float64) for i in idx]) for j in range(levels + 1)]
            a = level[-1]
            for j in range(levels - 1, -1, -1):
                a = _sfb(a, level[j], lo, hi, lens[j])
            for i, r in zip(idx, a, strict=True):
                out[i] = r
        return pd.Series(out)
    return idwt.asNondeterministic()  # else an exploded series is computed a second time for its size


def histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Equal-width histogram over [min, max]: (bucket 1..bins, lo, hi,
    count).  min / max come from one scalar subquery."""
    r = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    lo, hi = r.getField("lo"), r.getField("hi")
    width = (hi - lo) / bins
    b = F.when(F.col(value) == hi, F.lit(bins)).otherwise(F.floor((F.col(value) - lo) / width) + 1)
    c = df.where(F.col(value).isNotNull()).groupBy(b.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    return c.select("bucket", (lo + (F.col("bucket") - 1) * width).alias("lo"),
                    (lo + F.col("bucket") * width).alias("hi"), "count")
