"""Distributed exact quantiles equal pandas, also with heavy ties and forced
narrowing passes."""

import numpy as np
import pandas as pd

from sensorlab.operators.quantiles import exact_quantiles


def test_exact_quantiles_match_pandas(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000), np.full(2500, 3.25), rng.exponential(size=800) * 1e6])
    pdf = pd.DataFrame({"a": x, "b": np.where(np.arange(len(x)) % 3 == 0, np.nan, x * 2)})
    df = spark.createDataFrame(pdf)
    qs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["a", "b"], qs)
    for c in ("a", "b"):
        assert got[c] == pdf[c].dropna().quantile(qs).tolist()


def test_many_rows_and_ties(spark, monkeypatch):
    """Several rounds (a coarse approximation) and columns of few values."""
    monkeypatch.setattr("sensorlab.operators.quantiles.ACCURACY", 20)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"wide": np.exp(rng.normal(size=40_000) * 50), "nine": rng.integers(0, 9, 40_000) / 8.0,
                        "one": np.full(40_000, -1.5), "two": np.repeat([1e-300, 1e300], 20_000)})
    qs = [0.01, 0.25, 0.5, 0.75, 0.999]
    got = exact_quantiles(spark.createDataFrame(pdf), list(pdf), qs)
    for c in pdf:
        assert np.allclose(got[c], pdf[c].quantile(qs).tolist(), rtol=1e-9)


def test_nan_null_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (float("nan"), None), (10.0, None), (None, None)],
                               "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.5], "b": [None]}
