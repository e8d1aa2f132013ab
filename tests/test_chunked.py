"""The chunked layout equals plain per-key windows, across chunk and bucket
edges, with hot keys, gaps at edges and all-NULL series."""

import datetime as dt
import math

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorlab.operators import features as FE
from sensorlab.operators import metrics as M
from sensorlab.operators import norm as N
from sensorlab.plans import chunked as C


def _series(spark):
    rows = []
    t0 = dt.datetime(2024, 1, 1)
    # key 1: hot (many rows, several hours), key 2: short, key 3: all NULL, key 4: one row
    for i in range(400):
        v = None if i % 7 == 0 or i < 3 or i > 395 else float((i * 37) % 101)
        rows.append((1, t0 + dt.timedelta(minutes=i), i, v))
    for i in range(5):
        rows.append((2, t0 + dt.timedelta(hours=i * 3), 1000 + i, None if i == 2 else float(i)))
    for i in range(4):
        rows.append((3, t0 + dt.timedelta(hours=i), 2000 + i, None))
    rows.append((4, t0, 3000, 5.0))
    return spark.createDataFrame(rows, "machine long, ts timestamp_ntz, event_id long, value double")


def _pandas_interp(pdf):
    out = []
    for _, g in pdf.sort_values(["machine", "ts", "event_id"]).groupby("machine"):
        g = g.copy()
        g["filled"] = g["value"].interpolate(method="linear", limit_direction="both")
        out.append(g)
    return pd.concat(out)


def test_gap_fill_matches_pandas(spark):
    df = _series(spark)
    got = N.interpolate_gaps(df, ["machine"], ["ts", "event_id"], out="filled").toPandas()
    exp = _pandas_interp(df.toPandas())
    g = got.set_index("event_id")["filled"]
    for eid, v in exp.set_index("event_id")["filled"].items():
        a = g[eid]
        assert (math.isnan(v) and (a is None or math.isnan(a))) or abs(a - v) < 1e-9, eid


def test_rolling_matches_plain_window_with_tiny_buckets(spark):
    df = _series(spark)
    w = Window.partitionBy("machine").orderBy("ts", "event_id").rowsBetween(-23, 0)
    plain = df.select("event_id", F.avg("value").over(w).alias("m"),
                      F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0)).alias("s"))
    for bucket in (30, 1000):
        got = FE.rolling_features(df, ["machine"], ["ts", "event_id"], ["value"], 24,
                                  stats=("mean", "std"), bucket=bucket)
        j = got.join(plain, "event_id").select(
            F.max(F.abs(F.coalesce("value_rolling_mean", F.lit(0.0)) - F.coalesce("m", F.lit(0.0)))).alias("dm"),
            F.max(F.abs(F.col("value_rolling_std") - F.col("s"))).alias("ds"),
            F.count(F.lit(1)).alias("n")).first()
        assert j["n"] == df.count()
        assert j["dm"] < 1e-9 and j["ds"] < 1e-9


def test_positions_are_dense_per_key(spark):
    df = _series(spark)
    rows, chunks = C.index_series(df, ["machine"], ["ts", "event_id"], C.default_chunk("ts", "minute"))
    w = Window.partitionBy("machine").orderBy("ts", "event_id")
    chk = rows.select("event_id", C.POS, (F.row_number().over(w) - 1).alias("exp"))
    assert chk.where(F.col(C.POS) != F.col("exp")).count() == 0
    # chunk table has one row per (key, minute), far fewer than... but never more than rows
    assert chunks.count() <= df.count()


def test_segment_adjust_across_chunks(spark):
    t0 = dt.datetime(2024, 1, 1)
    truth = [0, 1, 1, 1, 0, 1, 1, 0, 1]
    pred = [0, 0, 0, 1, 0, 0, 0, 1, 0]
    rows = [(7, t0 + dt.timedelta(hours=i), i, truth[i], pred[i]) for i in range(len(truth))]
    df = spark.createDataFrame(rows, "machine long, ts timestamp_ntz, event_id long, truth int, pred int")
    got = {r["event_id"]: r["pred_adjusted"] for r in
           M.adjust_segments(df, ["machine"], ["ts", "event_id"]).collect()}
    assert [got[i] for i in range(len(truth))] == [0, 1, 1, 1, 0, 0, 0, 1, 0]


def test_centred_average_across_buckets_matches_array_form(spark):
    from sensorlab.operators import spectral as G
    df = _series(spark).where(F.col("value").isNotNull())
    arr = (df.groupBy("machine").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))),
                                                 lambda e: e["value"]).alias("series"))
           .where(F.size("series") > 0))
    exp = G.decompose(arr, kernels=(5,)).select("machine", F.posexplode("trend").alias("k", "t"))
    for bucket in (7, 1 << 16):
        got = G.decompose_series(df, ["machine"], ["ts", "event_id"], "value", 5, bucket=bucket)
        w = Window.partitionBy("machine").orderBy("ts", "event_id")
        got = got.withColumn("k", F.row_number().over(w) - 1)
        d = got.join(exp, ["machine", "k"]).select(F.max(F.abs(F.col("trend") - F.col("t"))).alias("d"),
                                                   F.count(F.lit(1)).alias("n")).first()
        assert d["n"] == df.count() and d["d"] < 1e-9


def test_hot_key_spreads_over_tasks(spark):
    """All events under one machine (a key holding every row, computed so the
    optimizer cannot fold it away): gap fill and rolling windows still run in
    many partitions and equal the plain per-key window."""
    from sensorlab.sources.tables import machine_series
    from tests.conftest import SF_MID
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = machine_series(spark, SF_MID, gaps=True).withColumn(
            "machine", (F.col("event_id") * 0 + 7).cast("long"))
        got = FE.rolling_features(hot, ["machine"], ["ts", "event_id"], ["value"], 24, stats=("mean",),
                                  bucket=500)
        sizes = got.rdd.glom().map(len).collect()
        assert max(sizes) < 0.5 * sum(sizes)
        filled = N.interpolate_gaps(hot, ["machine"], ["ts", "event_id"])
        sizes = filled.rdd.glom().map(len).collect()
        assert max(sizes) < 0.5 * sum(sizes)
        w = Window.partitionBy("machine").orderBy("ts", "event_id").rowsBetween(-23, 0)
        plain = hot.select("event_id", F.avg("value").over(w).alias("m"))
        d = got.join(plain, "event_id").select(
            F.max(F.abs(F.coalesce("value_rolling_mean", F.lit(0.0)) - F.coalesce("m", F.lit(0.0))))).first()[0]
        assert d < 1e-9
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_auto_chunk_adapts_to_density(spark):
    from sensorlab.sources.tables import machine_series
    from tests.conftest import SF_MID
    s = machine_series(spark, SF_MID)
    coarse = C.auto_chunk(s, ["machine"], "ts", target_rows=10_000)
    fine = C.auto_chunk(s, ["machine"], "ts", target_rows=1)
    n_coarse = s.select(coarse.alias("c"), "machine").distinct().count()
    n_fine = s.select(fine.alias("c"), "machine").distinct().count()
    assert n_coarse < n_fine
    got = N.interpolate_gaps(machine_series(spark, SF_MID, gaps=True), ["machine"], ["ts", "event_id"],
                             chunk=coarse, out="f")
    ref = N.interpolate_gaps(machine_series(spark, SF_MID, gaps=True), ["machine"], ["ts", "event_id"],
                             chunk=fine, out="g")
    d = got.join(ref, "event_id").select(F.max(F.abs(F.col("f") - F.col("g")))).first()[0]
    assert d < 1e-9


def test_burst_within_one_second_spreads(spark):
    """90 % of all rows in one machine and one second: runs stay about equal, results are those of a plain window."""
    n = 5000
    burst = spark.range(n).select((F.col("id") % 10 == 0).cast("long").alias("machine"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
                                  F.col("id").alias("event_id"), F.when(F.col("id") % 7 > 0, F.col("id") * 37 % 101).cast("double").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = C.sorted_runs(burst, ["machine"], ["ts", "event_id"])
        sizes = [r["count"] for r in runs.groupBy(C.CHUNK).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * n / 8
        got = FE.rolling_features(burst, ["machine"], ["ts", "event_id"], ["value"], 24, stats=("mean",), bucket=300)
        w = Window.partitionBy("machine").orderBy("event_id")
        plain = burst.select("event_id", F.avg("value").over(w.rowsBetween(-23, 0)).alias("m"))
        assert got.join(plain, "event_id").where(F.abs(F.col("value_rolling_mean") - F.col("m")) < 1e-9).count() == got.where(
            "value_rolling_mean IS NOT NULL").count()
        pos, _ = C.index_series(burst, ["machine"], ["ts", "event_id"])
        assert pos.join(burst.select("event_id", (F.row_number().over(w) - 1).alias("p")), "event_id").where("p = _pos").count() == n
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_null_keys_are_a_series(spark):
    df = spark.createDataFrame([(None, i, float(i)) for i in range(6)] + [(1, i, 2.0) for i in range(3)], "k long, t long, value double")
    rows, _ = C.index_series(df, ["k"], ["t"])
    assert sorted((r.k is None, r.t, r._pos, r._len) for r in rows.collect()) == [(False, i, i, 3) for i in range(3)] + [
        (True, i, i, 6) for i in range(6)]
