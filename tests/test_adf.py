"""ADF with automatic lags against plain least squares."""

import math

import numpy as np
import pytest

from sensorlab.operators import stationarity as ST


def plain(y, max_lag):
    """adfuller's rule with numpy's least squares: AIC on the common sample, refit on the lag's own."""
    n = len(y)
    bound = math.ceil(12 * (n / 100) ** 0.25) if max_lag is None else max_lag
    bound = min(bound, max((n - 1) // 2 - 2, 0))

    def fit(p, first):
        d = np.diff(y)
        t = np.arange(first, n)
        x = np.column_stack([np.ones(len(t)), y[t - 1], *[d[t - 1 - k] for k in range(1, p + 1)]])
        b = np.linalg.lstsq(x, d[t - 1], rcond=None)[0]
        ssr = float(((d[t - 1] - x @ b) ** 2).sum())
        return x, b, ssr, len(t)
    aic = []
    for p in range(bound + 1):
        _, _, ssr, m = fit(p, bound + 1)
        aic.append(m * math.log(ssr / m) + 2 * (p + 2))
    p = int(np.argmin(aic))
    x, b, ssr, m = fit(p, p + 1)
    se = math.sqrt(ssr / (m - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    return b[1] / se, p, m


def series(seed=0):
    rng = np.random.default_rng(seed)
    out = {}
    for k, n in enumerate((7, 12, 30, 90, 400, 1500)):
        e = rng.normal(size=n)
        y = np.zeros(n)
        for t in range(n):
            y[t] = 1000 * (k % 2) + (0.9 * (y[t - 1] - 1000 * (k % 2)) if t else 0) + e[t] + (0.7 * e[t - 5] if t >= 5 else 0)
        out[k] = y
    return out


@pytest.mark.parametrize("max_lag", [None, 0, 1, 3, 6])
@pytest.mark.parametrize("bucket", [None, 40])
def test_statistic_lag_and_rows(spark, max_lag, bucket):
    data = series()
    df = spark.createDataFrame([(k, t, float(v)) for k, y in data.items() for t, v in enumerate(y)], "machine long, ts long, value double")
    got = {r.machine: r for r in ST.adf(df, ["machine"], ["ts"], max_lag=max_lag, bucket=bucket).collect()}
    assert set(got) == set(data)
    for k, y in data.items():
        stat, lag, rows = plain(y, max_lag)
        assert (got[k].used_lag, got[k].nobs) == (lag, rows), k
        assert abs(got[k].adf_stat - stat) < 1e-6 * max(1, abs(stat)), k


def test_mean_and_degenerate_series(spark):
    data = series(3)
    rows = [(k, t, float(v)) for k, y in data.items() for t, v in enumerate(y)]
    rows += [(90, t, 5.0) for t in range(50)] + [(91, 0, 1.0), (92, 0, 1.0), (92, 1, 2.0)]  # flat, one value, two
    rows += [(93, t, None) for t in range(5)]
    df = spark.createDataFrame(rows, "machine long, ts long, value double")
    by = {r.machine: r.adf_stat for r in ST.adf(df, ["machine"], ["ts"], max_lag=None).collect()}
    assert by[90] is None and by[91] is None and by[92] is None and 93 not in by
    got = ST.mean_adf(df, ["machine"], ["ts"]).first()
    assert abs(got.mean_adf - np.mean([plain(y, None)[0] for y in data.values()])) < 1e-6 and got.n_series == len(by)
    assert ST.adf(df.where("false"), ["machine"], ["ts"]).count() == 0
