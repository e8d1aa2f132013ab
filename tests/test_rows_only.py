"""Rows-only operators (no SQL oracle) checked against brute force on small
fixtures drawn from the test tables, and by their defining properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlab.operators import augment as A
from sensorlab.operators import dtw as D
from sensorlab.sources.tables import samples
from tests.conftest import SF_SMALL


def _dp(x, y, w, slope):
    """Plain-Python DTW with the reference's step rules (independent check)."""
    p, s = len(x), len(y)
    inf = math.inf
    M = [[inf] * (s + 1) for _ in range(p + 1)]
    M[0][0] = 0.0
    c = lambda i, j: abs(x[i] - y[j]) if abs(i - j) <= w else inf
    for i in range(1, p + 1):
        if slope == "symmetric":
            for j in range(max(1, i - w), min(s, i + w) + 1):
                M[i][j] = c(i - 1, j - 1) + min(M[i - 1][j - 1], M[i][j - 1], M[i - 1][j])
        else:
            if i <= w + 1:
                M[i][1] = c(i - 1, 0) + min(M[i - 1][0], M[i - 1][1])
            for j in range(max(2, i - w), min(s, i + w) + 1):
                M[i][j] = c(i - 1, j - 1) + min(M[i - 1][j - 2], M[i - 1][j - 1], M[i - 1][j])
    return M[p][s]


@pytest.fixture(scope="module")
def pairs(spark):
    return D.class_partners(samples(spark, SF_SMALL), seed=0, offsets=(1,)).limit(25).cache()


@pytest.mark.parametrize("slope", ["symmetric", "asymmetric"])
def test_dtw_udf_equals_plain_dp(pairs, slope):
    got = pairs.select("series", "partner_series",
                       D.dtw_distance(slope, 7)(F.col("series"), F.col("partner_series")).alias("d")).collect()
    assert got
    for r in got:
        exp = _dp(r["series"], r["partner_series"], 7, slope)
        assert (math.isinf(exp) and math.isinf(r["d"])) or abs(r["d"] - exp) < 1e-9


def test_path_cost_equals_distance(pairs):
    rows = pairs.select("series", "partner_series",
                        D.dtw_distance("symmetric", 7)(F.col("series"), F.col("partner_series")).alias("d"),
                        D.dtw_path("symmetric", 7)(F.col("series"), F.col("partner_series")).alias("p")).collect()
    for r in rows:
        i, j = r["p"]
        assert i[0] == 0 and j[0] == 0 and i[-1] == len(r["series"]) - 1 and j[-1] == len(r["partner_series"]) - 1
        assert all(b - a in (0, 1) for a, b in zip(i, i[1:])) and all(b - a in (0, 1) for a, b in zip(j, j[1:]))
        cost = sum(abs(r["series"][a] - r["partner_series"][b]) for a, b in zip(i, j))
        assert abs(cost - r["d"]) < 1e-9


def test_metric_dtw_unbanded_equals_plain_dp(pairs):
    rows = pairs.select("series", "partner_series",
                        D.metric_dtw("cityblock", 1, math.inf, 1.0)(F.col("series"), F.col("partner_series"))
                        .alias("d")).collect()
    for r in rows:
        n = len(r["series"])
        assert abs(r["d"] - _dp(r["series"], r["partner_series"], n, "symmetric")) < 1e-9


def test_group_medoid_minimises_distance_sum(spark):
    s = samples(spark, SF_SMALL)
    med = D.group_medoids(s, seed=0, size=4, window=7).orderBy("label", "group").limit(5).collect()
    series = {r["sample_id"]: r["series"] for r in s.collect()}
    rows, _ = D.hash_positions(s.select("sample_id", "label", "series"), "label", "sample_id", 0)
    groups = {}
    for r in rows.select("sample_id", "label", (F.col("_pos") / 4).cast("long").alias("g")).collect():
        groups.setdefault((r["label"], r["g"]), []).append(r["sample_id"])
    for m in med:
        members = groups[(m["label"], m["group"])]
        sums = {a: sum(_dp(series[a], series[b], 7, "symmetric") for b in members if b != a) for a in members}
        best = min(sums.values())
        assert abs(sums[m["medoid_id"]] - best) < 1e-9


def test_spline_warps_are_identity_without_noise(spark):
    s = samples(spark, SF_SMALL).withColumn("round", F.lit(1)).limit(20)
    for op in (A.magnitude_warp, A.time_warp):
        out = op(s, 0, sigma=0.0).select("sample_id", F.col("series").alias("w")).join(s, "sample_id").collect()
        for r in out:
            assert np.allclose(r["w"], r["series"], atol=1e-9)


def test_augmentations_keep_length_and_labels(spark):
    s = samples(spark, SF_SMALL).withColumn("round", F.lit(1))
    n = s.count()
    for op in (A.window_warp, A.spawner, A.wdba, A.random_guided_warp,
               lambda d, seed: A.discriminative_guided_warp(d, seed)):
        out = op(s, 0)
        bad = out.where(F.size("series") != 64).count()
        assert out.count() == n and bad == 0
