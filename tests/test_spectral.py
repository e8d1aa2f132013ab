"""Wavelet round trip and FFT helpers."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sensorlab.operators import spectral as G


def test_wavelet_reconstruction_numpy():
    rng = np.random.default_rng(0)
    for wave in ("db1", "db2"):
        lo, hi = G._filters(wave)
        for n in (10, 63, 64):
            x = rng.normal(size=(2, n))
            a, d = G._afb(x, lo, hi)
            assert np.abs(G._sfb(a, d, lo, hi, n) - x).max() < 1e-12


def test_dft_season_keeps_strong_bins():
    t = np.arange(64)
    x = np.sin(2 * np.pi * 3 * t / 64) + 0.5 * np.sin(2 * np.pi * 7 * t / 64)
    s = G._dft_season(x[None, :], 5)[0]
    assert np.abs(s - x).max() < 1e-9


def test_histogram_edges(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [0.0, 0.5, 1.0, 1.0, None]}))
    h = {r["bucket"]: r["count"] for r in G.histogram(df, "v", 2).collect()}
    assert h == {1: 1, 2: 3}


def test_cross_correlation_of_a_series_with_itself_is_its_autocorrelation(spark):
    from sensorlab.sources.tables import samples
    from tests.conftest import SF_SMALL
    s = samples(spark, SF_SMALL).limit(20)
    rows = s.select(G.cross_correlation(F.col("series"), F.col("series")).alias("c"),
                    G.autocorrelation(F.col("series")).alias("a"), "series").collect()
    for r in rows:
        x = np.asarray(r["series"])
        brute = [float(np.dot(np.roll(x, -lag), x)) for lag in range(len(x))]
        assert np.allclose(r["c"], r["a"]) and np.allclose(r["a"], brute)


def test_smoothing_and_averages_on_long_series(spark):
    """Equal to the plain recursion and sums, and in proportion to the length."""
    import time

    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    took = {}
    for n in (1_000, 10_000):
        x = rng.normal(size=(20, n)) + 50
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id int, series array<double>").cache()
        df.count()
        q = df.select("sample_id", G.exponential_smoothing(F.col("series"), 0.7, 2.0).alias("s"), G.moving_average(F.col("series"), 25).alias("m"))
        q.collect()
        t = time.perf_counter()
        got = {r.sample_id: r for r in q.collect()}
        took[n] = time.perf_counter() - t
        s, want = np.full(20, 2.0), []
        for k in range(n):
            s = 0.7 * s + 0.3 * x[:, k]
            want.append(s)
        assert np.allclose([got[i].s for i in range(20)], np.array(want).T, rtol=1e-10)
        wide = np.pad(x, ((0, 0), (12, 12)), mode="edge")
        assert np.allclose([got[i].m for i in range(20)], [[r[k:k + 25].mean() for k in range(n)] for r in wide], rtol=1e-10)
    assert took[10_000] < 40 * took[1_000]  # a quadratic form takes a hundred times as long


def test_flat_tops(spark):
    """Peaks with flat tops of even and odd width: the middle, the lower of two; none at the ends."""
    from pyspark.sql import functions as F
    cases = {(1, 3, 3, 1, 0): [1], (0, 2, 2, 2, 1): [2], (5, 5, 1, 2, 2): [], (0, 4, 4, 4, 4, 1, 3, 0): [2, 6], (1,): [], (): [], (2, 2, 2): [],
             (0, 1, 0, 9, 0, 0.5, 0): [3, 1], (0, 3, 1, 1, 2, 2, 5, 5, 4): [6, 1]}
    df = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(cases)], "i int, a array<double>")
    got = {r.i: [e.bin for e in r.p] for r in df.select("i", G.peaks(F.col("a")).alias("p")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_exploded_wavelets_are_computed_once(spark):
    """One Python stage for the bands and one for the inverse; a filter on the size of an exploded array adds none."""
    df = spark.createDataFrame([(1, [float(i % 5) for i in range(16)])], "sample_id int, series array<double>")
    bands = df.select("sample_id", F.size("series").alias("n"), G.wavelet_bands("db2", 2)("series").alias("b"))
    back = bands.select("sample_id", F.posexplode(G.wavelet_inverse("db2", 2)("b", "n")).alias("k", "value"))
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
    assert all(abs(r.value - r.k % 5) < 1e-9 for r in back.collect())
