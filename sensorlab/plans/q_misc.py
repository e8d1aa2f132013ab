"""Stationarity (D7, D8), tree models (B1-B4, S17), sample and forecast
sources (S2-S4, S8-S10) and the streaming form of the time features."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions.random import sql_uniform
from ..operators import models as MD
from ..operators import norm as N
from ..operators import stationarity as ST
from ..operators.features import split_column
from ..sources import forecast as FC
from ..sources import samples as SM
from ..sources.results import scratch_path
from ..sources.tables import machine_series, read_table, samples
from ..streaming import stateless as SS
from .registry import register

_LAGS = """
WITH s AS (SELECT user_id AS machine, value AS y, lag(value) OVER w AS yl, lag(value, 2) OVER w AS yl2
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT machine, y, yl, y - yl AS dy, yl - yl2 AS dyl FROM s),
c AS (SELECT * FROM x WHERE dyl IS NOT NULL),
f0 AS (SELECT machine, count(*) AS n, var_pop(yl) AS vx, covar_pop(yl, dy) AS cxy, var_pop(dy) AS vy
       FROM x WHERE yl IS NOT NULL GROUP BY machine),
g0 AS (SELECT machine, count(*) AS n, var_pop(yl) AS vx, covar_pop(yl, dy) AS cxy, var_pop(dy) AS vy FROM c GROUP BY machine),
g1 AS (SELECT machine, count(*) AS n, var_pop(yl) AS vx, var_pop(dyl) AS vz, covar_pop(yl, dyl) AS cxz,
         covar_pop(yl, dy) AS cxy, covar_pop(dyl, dy) AS czy, var_pop(dy) AS vy FROM c GROUP BY machine),
s0 AS (SELECT machine, n, (cxy / vx) / sqrt((n * vy - n * cxy * cxy / vx) / (n - 2) / (n * vx)) AS stat FROM f0),
a0 AS (SELECT machine, n * (ln(2 * pi()) + ln((n * vy - n * cxy * cxy / vx) / n) + 1) + 4 AS aic0 FROM g0),
h1 AS (SELECT *, vx * vz - cxz * cxz AS det FROM g1),
h2 AS (SELECT *, (vz * cxy - cxz * czy) / det AS b1, (vx * czy - cxz * cxy) / det AS b2 FROM h1),
h3 AS (SELECT *, n * (vy - b1 * cxy - b2 * czy) AS ssr FROM h2),
s1 AS (SELECT machine, n, b1 / sqrt(ssr / (n - 3) * vz / (n * det)) AS stat,
         n * (ln(2 * pi()) + ln(ssr / n) + 1) + 6 AS aic1 FROM h3)"""


@register("d7_adf", _LAGS + """
SELECT s0.machine, CASE WHEN s1.aic1 < a0.aic0 THEN s1.stat ELSE s0.stat END AS adf_stat,
  (CASE WHEN s1.aic1 < a0.aic0 THEN 1 ELSE 0 END)::INTEGER AS used_lag,
  CASE WHEN s1.aic1 < a0.aic0 THEN s1.n ELSE s0.n END AS nobs
FROM s0 JOIN a0 USING (machine) JOIN s1 USING (machine)""", dbl=["adf_stat"])
def q_d7(spark, sf_dir):
    """D7 ADF statistic per machine, lag 0/1 by AIC."""
    s = machine_series(spark, sf_dir)
    return ST.adf(s, ["machine"], ["ts", "event_id"], "value")


@register("d8_mean_adf", _LAGS + " SELECT avg(stat) AS mean_adf, count(*) AS n_series FROM s1", dbl=["mean_adf"])
def q_d8(spark, sf_dir):
    """D8 mean ADF statistic over machines at lag 1."""
    s = machine_series(spark, sf_dir)
    return ST.mean_adf(s, ["machine"], ["ts", "event_id"], "value", lag=1)


@register("d8_mean_adf_auto")
def q_d8a(spark, sf_dir):
    """D8 mean ADF statistic over machines, every lag by AIC under Schwert's bound."""
    return ST.mean_adf(machine_series(spark, sf_dir), ["machine"], ["ts", "event_id"], "value")


def _default(name):
    return MD.build(MD.DEFAULT_MODELS[name])


def _train_test(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("split", split_column(["sample_id"], 0.2, 42))
    s = MD.features_column(s, "series")
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


@register("b1_random_forest")
def q_b1(spark, sf_dir):
    """B1 random forest of the default set on the 64-step series; test predictions."""
    tr, te = _train_test(spark, sf_dir)
    m = MD.fit(tr, _default("RandomForest-Default"))
    return MD.predictions(m, te)


@register("b2_gradient_boosting")
def q_b2(spark, sf_dir):
    """B2 gradient boosting of the default set over all ten labels; test predictions."""
    tr, te = _train_test(spark, sf_dir)
    m = MD.fit(tr, _default("GradientBoosting-Default"))
    return MD.predictions(m, te)


@register("b3_benchmark_models")
def q_b3(spark, sf_dir):
    """B3 benchmark of the default set (two random forests, two boosted ensembles) scored on the test split."""
    tr, te = _train_test(spark, sf_dir)
    return MD.benchmark_models(tr, te, MD.DEFAULT_MODELS, n_classes=10)


@register("b4_feature_importance")
def q_b4(spark, sf_dir):
    """B4 top-10 feature importances of the default random forest."""
    tr, _ = _train_test(spark, sf_dir)
    m = MD.fit(tr, _default("RandomForest-Default"))
    names = [f"step_{i}" for i in range(64)]
    return spark.createDataFrame(MD.feature_importance(m, names, 10), "feature string, importance double")


@register("s17_save_load_model")
def q_s17(spark, sf_dir):
    """S17 fit, save, load a model pipeline and predict with the loaded copy."""
    tr, te = _train_test(spark, sf_dir)
    m = MD.fit(tr, _default("RandomForest-Default"))
    path = MD.save_model(m, scratch_path(spark, "model"))
    return MD.predictions(MD.load_model(path), te)


@register("s17_save_load_scaler", f"""
WITH o AS (SELECT o_orderkey, o_totalprice, CASE WHEN {sql_uniform(42, 'o_orderkey')} < 0.2 THEN 'test' ELSE 'train' END
             AS split FROM orders)
SELECT o_orderkey, (o_totalprice - (SELECT avg(o_totalprice) FROM o WHERE split = 'train'))
  / (SELECT stddev_pop(o_totalprice) FROM o WHERE split = 'train') AS o_totalprice, split FROM o""",
          dbl=["o_totalprice"])
def q_s17b(spark, sf_dir):
    """S17 fitted scaler saved as a one-row-per-column parquet table, loaded, applied."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice",
                                                   split_column(["o_orderkey"], 0.2, 42).alias("split"))
    sc = N.fit_scaler(o, ["o_totalprice"], F.col("split") == "train")
    path = scratch_path(spark, "scaler")
    sc.write.mode("overwrite").parquet(path)
    return N.apply_scaler(o, spark.read.parquet(path), ["o_totalprice"])


@register("s2_s3_read_sample_files", f"""
SELECT vec_id AS sample_id, CAST(label AS VARCHAR) AS label, embedding::DOUBLE[] AS series,
  CASE WHEN {sql_uniform(42, 'vec_id')} < 0.2 THEN 'TEST' ELSE 'TRAIN' END AS split FROM embeddings""")
def q_s2(spark, sf_dir):
    """S2 / S3 samples written as .npz files per split, listed by split pattern
    and suffix, and decoded back."""
    s = samples(spark, sf_dir).withColumn("split", split_column(["sample_id"], 0.2, 42))
    root = scratch_path(spark, "npz")
    for sp in ("train", "test"):
        SM.write_npz(s.where(F.col("split") == sp), root, sp.upper())
    return SM.read_npz(spark, root, split_regex=r"_(TRAIN|TEST)\.npz$")


@register("s4_limit_samples", "SELECT vec_id AS sample_id, label FROM embeddings ORDER BY vec_id LIMIT 100")
def q_s4(spark, sf_dir):
    """S4 first 100 samples by id."""
    return SM.limit_samples(samples(spark, sf_dir).select("sample_id", "label"), 100)


@register("s4_limit_fraction", """
SELECT vec_id AS sample_id, label FROM embeddings ORDER BY vec_id
LIMIT (SELECT floor(0.25 * count(*)) FROM embeddings)""")
def q_s4b(spark, sf_dir):
    """S4 first quarter of the samples by id (fraction form)."""
    return SM.limit_samples(samples(spark, sf_dir).select("sample_id", "label"), 0.25)


_GROUP_SQL = ("CASE user_id % 6 WHEN 0 THEN 'Yearly' WHEN 1 THEN 'Quarterly' WHEN 2 THEN 'Monthly' "
              "WHEN 3 THEN 'Weekly' WHEN 4 THEN 'Daily' ELSE 'Hourly' END")
_META_SQL = ("(VALUES ('Yearly', 6, 1, 1.5), ('Quarterly', 8, 4, 1.5), ('Monthly', 18, 12, 1.5), "
             "('Weekly', 13, 1, 10.0), ('Daily', 14, 1, 10.0), ('Hourly', 48, 24, 10.0)) AS m(grp, horizon, frequency, history_size)")


def _groups(df, col="id"):
    return F.element_at(F.array(*[F.lit(g[0]) for g in FC.META]), (F.col(col) % 6 + 1).cast("int"))


@register("s8_load_collection", f"""
SELECT user_id AS id, event_id AS step, value, {_GROUP_SQL} AS "group", m.frequency, m.horizon
FROM events JOIN {_META_SQL} ON m.grp = {_GROUP_SQL}""")
def q_s8(spark, sf_dir):
    """S8 forecast collection: info CSV and long values written, loaded, joined by id."""
    ev = read_table(spark, sf_dir, "events")
    info = (ev.select(F.col("user_id").alias("id")).distinct().withColumn("group", _groups(None))
            .join(F.broadcast(FC.meta(spark)), "group").select("id", "group", "frequency", "horizon"))
    root = scratch_path(spark, "m4")
    info.write.mode("overwrite").option("header", True).csv(f"{root}/info")
    ev.select(F.col("user_id").alias("id"), F.col("event_id").alias("step"), "value") \
        .write.mode("overwrite").parquet(f"{root}/values")
    return FC.load_collection(spark, f"{root}/info", f"{root}/values")


@register("s9_group_meta", f"""
SELECT user_id AS machine, event_id, {_GROUP_SQL} AS "group", m.horizon, m.frequency, m.history_size
FROM events LEFT JOIN {_META_SQL} ON m.grp = {_GROUP_SQL}""", dbl=["history_size"])
def q_s9(spark, sf_dir):
    """S9 per-group horizon / frequency / history size attached to each row."""
    ev = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("machine"), "event_id")
    return FC.with_meta(ev.withColumn("group", _groups(None, "machine")))


@register("s10_forecast_csv", """
WITH s AS (SELECT user_id AS machine, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
           FROM events)
SELECT machine * 1000000 + pos // 16 AS id, list(value ORDER BY pos) AS "values" FROM s GROUP BY machine, pos // 16""")
def q_s10(spark, sf_dir):
    """S10 16-step forecast rows written as CSV with NaN tails, read back with
    the tails stripped."""
    from ..operators import shapes as S
    w = S.windows(machine_series(spark, sf_dir), ["machine"], ["ts", "event_id"], 16)
    wide = (w.groupBy((F.col("machine") * 1000000 + F.col("win")).alias("id"))
            .pivot("step", list(range(16))).agg(F.first("value")))
    wide = wide.select("id", *[F.coalesce(F.col(str(i)), F.lit(float("nan"))).alias(f"V{i + 1}") for i in range(16)])
    root = scratch_path(spark, "fcsv")
    wide.write.mode("overwrite").option("header", True).csv(root)
    back = FC.read_forecast_csv(spark, root)
    return back.select(F.col("id").cast("long").alias("id"), "values")


_N11 = {"second_of_minute": "second(ts) / 59.0 - 0.5", "minute_of_hour": "minute(ts) / 59.0 - 0.5",
        "hour_of_day": "hour(ts) / 23.0 - 0.5", "day_of_week": "(isodow(ts) - 1) / 6.0 - 0.5",
        "day_of_month": "(day(ts) - 1) / 30.0 - 0.5", "day_of_year": "(dayofyear(ts) - 1) / 365.0 - 0.5"}


@register("st_time_features_stream", "SELECT event_id, " + ", ".join(f"{v} AS {k}" for k, v in _N11.items())
          + " FROM events", dbl=list(_N11))
def q_stream(spark, sf_dir):
    """N11 / N12 time features computed by a Structured Streaming query over the
    events file source (available-now trigger, parquet sink with checkpoint)."""
    return SS.run_to_table(SS.time_feature_stream(SS.event_stream(spark, sf_dir), "ts", "s"), "timefeat")


@register("st_calendar_scaled_stream", """
SELECT event_id, ts, (value - 25.0) / 10.0 AS value, hour(ts)::INTEGER AS hour,
  (isodow(ts) - 1)::INTEGER AS day_of_week, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day,
  year(ts)::INTEGER AS year, CASE WHEN isodow(ts) IN (6, 7) THEN 1 ELSE 0 END::INTEGER AS is_weekend
FROM events""", dbl=["value"])
def q_stream2(spark, sf_dir):
    """F4 calendar parts and N6 scaling (mean 25, std 10) computed by a
    Structured Streaming query over the events file source."""
    return SS.run_to_table(SS.calendar_scaled_stream(SS.event_stream(spark, sf_dir), "ts", "value", 25.0, 10.0),
                           "calendar")
