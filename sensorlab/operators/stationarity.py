"""Augmented Dickey-Fuller statistic per series.

Regression per series (constant term):
dy_t = a + g * y_{t-1} + d_1 * dy_{t-1} + ... + d_p * dy_{t-p}.
The lag order p is chosen by AIC among 0 .. max_lag on the sample common to
all, then refitted on its own sample, as the usual ``adfuller`` does; without
``max_lag`` the bound is Schwert's, 12 (n / 100)^(1/4) rounded up.

One aggregate per series holds all lags: the Gram matrix of (1, y_{t-1},
dy_{t-1}, ..., dy_{t-P}, dy_t) over the common sample.  It is summed in
position buckets (with P + 1 rows borrowed from the bucket before), so a
dominant series spreads over many tasks and no series is collected anywhere.
One Cholesky factor then gives the residual sums of all nested regressions:
each further lag takes the square of one entry of the last row off the one
before.  A shorter lag's own sample has a few rows more than the common one;
they come from the first P + 2 values of the series.  Only the statistic is
computed (no p-value table).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import chunked as C
from ..plans.stored import stored
from .quantiles import present


_CELLS = 4_000_000  # products of regressors held at once


def lag_bound(n: Column, max_lag: int | None) -> Column:
    """Largest lag tried for a series of ``n`` values: Schwert's rule or ``max_lag``, and no more
    than leaves as many rows as coefficients."""
    most = F.greatest(F.floor((n - 1) / 2) - 2, F.lit(0))
    want = F.ceil(12 * F.pow(n / 100.0, F.lit(0.25))) if max_lag is None else F.lit(max_lag)
    return F.least(want, most).cast("int")


def _design(y: np.ndarray, lags: int) -> np.ndarray:
    """Rows (1, y_{t-1}, dy_{t-1}, ..., dy_{t-lags}, dy_t) for t = lags + 1 .. len(y) - 1."""
    d = np.diff(y)
    n = len(y) - lags - 1
    if n <= 0:
        return np.zeros((0, lags + 3))
    return np.column_stack([np.ones(n), y[lags:-1], *[d[lags - k:len(d) - k] for k in range(1, lags + 1)], d[lags:]])


def _grams(n_keys: int):
    """Gram matrices of sorted rows (keys, bucket, pos, y, mean, lags, borrowed): per batch and bucket
    one partial sum over the bucket's own rows of the common sample.  Rows of all buckets with one
    number of lags are worked on together; a bucket that goes on in the next batch takes its last
    values along."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if tail is None else [tail, b]).combine_chunks()
            old = 0 if tail is None else tail.num_rows
            t = t.to_batches()[0]
            pos, y = t.column(n_keys + 1).to_numpy(), t.column(n_keys + 2).to_numpy() - t.column(n_keys + 3).to_numpy()
            lags, borrowed = t.column(n_keys + 4).to_numpy(), t.column(n_keys + 5).to_numpy(zero_copy_only=False)
            # buckets are runs of consecutive positions of one series
            new = np.ones(len(pos), bool)
            new[1:] = pos[1:] != pos[:-1] + 1
            for k in range(n_keys + 1):
                c = t.column(k)
                same = pc.equal(c[1:], c[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
                same |= (pc.is_null(c[1:]).to_numpy(zero_copy_only=False) & pc.is_null(c[:-1]).to_numpy(zero_copy_only=False))
                new[1:] |= ~same
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            age = np.arange(len(pos)) - first[group]
            mine = ~borrowed & (np.arange(len(pos)) >= old) & (age >= lags + 1)
            heads, sums, counts = [], [], []
            for lag in np.unique(lags[mine]).tolist():
                rows = np.flatnonzero(mine & (lags == lag))
                step = max(1, _CELLS // (lag + 3) ** 2)
                for part in np.array_split(rows, -(-len(rows) // step)):
                    d = [y[part - k] - y[part - k - 1] for k in range(lag + 1)]
                    z = np.column_stack([np.ones(len(part)), y[part - 1], *d[1:], d[0]])
                    start = np.flatnonzero(np.diff(group[part], prepend=-1))
                    heads += first[group[part[start]]].tolist()
                    counts += np.diff(start, append=len(part)).tolist()
                    sums += list(np.add.reduceat((z[:, :, None] * z[:, None, :]).reshape(len(part), -1), start, axis=0))
            keep = min(len(pos), int(lags.max()) + 1)
            tail = t.slice(len(pos) - keep)
            if heads:
                at = pa.array(heads)
                yield pa.RecordBatch.from_arrays(
                    [*[t.column(k).take(at) for k in range(n_keys)], t.column(n_keys + 4).take(at), pa.array(counts, pa.int64()),
                     pa.array(sums, pa.list_(pa.float64()))], names=[*t.schema.names[:n_keys], "_lags", "_n", "_g"])
    return run


def _cholesky(g: np.ndarray) -> np.ndarray | None:
    """Lower factor; none where a column depends on the ones before (to rounding).  The last
    diagonal entry may vanish (a perfect fit)."""
    m = len(g)
    scale = np.sqrt(np.maximum(np.diag(g), 0))
    if (scale[:-1] <= 0).any():
        return None
    scale[-1] = scale[-1] or 1.0
    a, out = g / np.outer(scale, scale), np.zeros((m, m))
    for j in range(m):
        v = a[j:, j] - out[j:, :j] @ out[j, :j]
        if v[0] <= 1e-13:
            if j < m - 1:
                return None
            v[0] = max(v[0], 0.0)
        out[j:, j] = v / math.sqrt(v[0]) if v[0] > 0 else 0.0
    return out * scale[:, None]


def _statistic(g: np.ndarray, n: int) -> float | None:
    """t statistic of y_{t-1} from a Gram matrix with the response last."""
    k = len(g) - 1
    low = _cholesky(g)
    if low is None or n <= k:
        return None
    x, r = low[:-1, :-1], low[-1, :-1]
    ssr = max(float(g[-1, -1] - r @ r), 0.0)
    coefficients = np.linalg.solve(x.T, r)
    inverse = np.linalg.solve(x, np.eye(k))
    variance = ssr / (n - k) * float((inverse[:, 1] ** 2).sum())
    return float(coefficients[1]) / math.sqrt(variance) if variance > 0 else None


def choose(g: np.ndarray, n: int, head: np.ndarray, fixed: bool = False) -> tuple[float | None, int, int]:
    """(statistic, lag, rows) of the lag with the least AIC, or of the largest one if ``fixed``;
    ``g`` over the common sample of ``n`` rows, ``head`` the first values of the series."""
    lags = len(g) - 3
    low = None if fixed else _cholesky(g)
    best = lags if fixed else 0
    if low is not None and n > 0:
        # residual sums of the leading regressions
        ssr = g[-1, -1] - np.cumsum(low[-1, :-1] ** 2)[1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            aic = n * np.log(np.maximum(ssr, 0) / n) + 2 * np.arange(2, lags + 3)
        if np.isfinite(aic).any():
            best = int(np.nanargmin(np.where(np.isfinite(aic), aic, np.inf)))
    keep = [*range(best + 2), lags + 2]
    own, rows = g[np.ix_(keep, keep)], n
    if best < lags:  # rows of its own sample before the common one
        z = _design(head[:lags + 1], best)
        own, rows = own + z.T @ z, n + len(z)
    return _statistic(own, rows), best, rows


def adf(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str = "value",
        chunk: Column | None = None, max_lag: int | None = 1, bucket: int | None = None,
        fixed: bool = False) -> DataFrame:
    """Per series ADF statistic with the lag chosen by AIC from 0 .. ``max_lag`` (None: Schwert's
    bound) on the common sample, or equal to ``max_lag`` if ``fixed``: (keys, adf_stat, used_lag, nobs).  Missing values are left out;
    series too short or without variation have no statistic."""
    keys = list(keys)
    y = df.where(present(F.col(value)).isNotNull())
    rows, chunks = C.index_series(y, keys, order, chunk)
    rows = rows.withColumn("_lags", lag_bound(F.col(C.LEN), max_lag)).withColumn("_y", F.col(value).cast("double"))
    longest = chunks.agg(F.max(lag_bound(F.col(C.LEN), max_lag))).first()[0]
    if longest is None:
        longest = 0
    means = stored(rows.groupBy(*keys).agg(F.avg("_y").alias("_mean")), "means")  # one row per series, used three times
    on = [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys]
    level = rows.join(means.select(*[F.col(k).alias(f"_m_{k}") for k in keys], "_mean"), on).drop(*[f"_m_{k}" for k in keys])
    head = (level.where(F.col(C.POS) <= F.col("_lags") + 1).groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(C.POS).alias("p"), (F.col("_y") - F.col("_mean")).alias("v")))).alias("_head")))
    both = C.with_neighbours(level, None, keys, ["_y", "_mean", "_lags"], before=int(longest) + 1, bucket=bucket)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    rows_of = (both.select(*keys, C.CHUNK, F.col(C.POS), "_y", "_mean", "_lags", C.BORROWED)
               .sortWithinPartitions(*keys, C.CHUNK, C.POS))  # already partitioned by series and bucket
    parts = rows_of.mapInArrow(_grams(len(keys)), f"{schema}, _lags int, _n bigint, _g array<double>")
    # sums of the matrices entry by entry, so that a long series' buckets never meet in one task
    entry = (parts.select(*keys, "_lags", "_n", F.posexplode("_g").alias("_i", "_v"))
             .groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"), F.sum("_n").alias("_n"), F.first("_lags").alias("_lags")))
    whole = entry.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_v").alias("v")))).alias("_g"),
                                     F.max("_n").alias("_n"), F.max("_lags").alias("_lags"))
    whole = whole.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.transform("_g", lambda e: e.v).alias("_g"), "_n", "_lags")
    # every series has first values; one without a row of the common sample has no matrix
    whole = head.withColumn("_head", F.transform("_head", lambda e: e.v)).join(
        whole, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys], "left").drop(*[f"_h_{k}" for k in keys])

    @F.pandas_udf("struct<stat: double, lag: int, n: bigint>")
    def solve(g: pd.Series, n: pd.Series, lags: pd.Series, head: pd.Series) -> pd.DataFrame:
        out = [(None, 0, 0) if a is None else
               choose(np.asarray(a, np.float64).reshape(int(p) + 3, int(p) + 3), int(c), np.asarray(h, np.float64), fixed)
               for a, c, p, h in zip(g, n, lags, head, strict=True)]
        return pd.DataFrame({"stat": pd.array([o[0] for o in out], "Float64"), "lag": [o[1] for o in out], "n": [o[2] for o in out]})
    found = whole.withColumn("_s", solve("_g", "_n", "_lags", "_head"))
    return found.select(*keys, F.col("_s.stat").alias("adf_stat"), F.col("_s.lag").alias("used_lag"), F.col("_s.n").alias("nobs"))


def mean_adf(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str = "value",
             lag: int | None = None, chunk: Column | None = None) -> DataFrame:
    """Mean over series of the ADF statistic, each with its own lag (Schwert's bound, AIC),
    or all with exactly ``lag`` lags: (mean_adf, n_series)."""
    st = adf(df, keys, order, value, chunk, max_lag=lag, fixed=lag is not None)
    return st.agg(F.avg("adf_stat").alias("mean_adf"), F.count(F.lit(1)).alias("n_series"))
