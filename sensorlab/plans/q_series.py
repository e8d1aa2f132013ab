"""Series repair, rolling features and norms on machine telemetry (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import norm as N
from ..sources.tables import machine_series, samples
from .registry import register
from .stored import stored

KEYS, ORDER = ["machine"], ["ts", "event_id"]

# DuckDB text of the stand-in shapes (same rules as sources.tables)
SERIES_SQL = ("SELECT user_id AS machine, ts, event_id, event_type AS channel, "
              "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")
SERIES_FULL_SQL = ("SELECT user_id AS machine, ts, event_id, event_type AS channel, value FROM events")

FILLED_SQL = f"""
WITH s AS ({SERIES_SQL}),
p AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY ts, event_id) - 1 AS pos FROM s),
q AS (
  SELECT *,
    last_value(value IGNORE NULLS) OVER (PARTITION BY machine ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vp,
    last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY machine
        ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
    first_value(value IGNORE NULLS) OVER (PARTITION BY machine ORDER BY pos
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vn,
    first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY machine
        ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pn
  FROM p)
SELECT machine, ts, event_id, channel,
  CASE WHEN value IS NOT NULL THEN value
       WHEN vp IS NOT NULL AND vn IS NOT NULL THEN vp + (vn - vp) * (pos - pp)::DOUBLE / (pn - pp)::DOUBLE
       ELSE coalesce(vp, vn) END AS value
FROM q"""

ROLL_SQL = """
SELECT *,
  avg(value) OVER w AS value_rolling_mean,
  coalesce(stddev_samp(value) OVER w, 0.0) AS value_rolling_std,
  min(value) OVER w AS value_rolling_min,
  max(value) OVER w AS value_rolling_max
FROM ({src}) AS r
WINDOW w AS (PARTITION BY machine ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""


def flagship(spark, sf_dir):
    """Gap fill (N7) -> 24-row rolling mean/std/min/max (F5-F8) -> per-machine
    standardization (N3) -> per-channel count and means (B14 style)."""
    s = machine_series(spark, sf_dir, gaps=True)
    s = stored(N.interpolate_gaps(s, KEYS, ORDER, keep_index=True), "filled")  # read by the windows and by the statistics
    s = N.standardize_per_sample(s, "machine", "value", out="value_z")
    s = FE.rolling_features(s, KEYS, ORDER, ["value"], window=24)
    return (s.groupBy("channel")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.avg("value").alias("mean_value"),
                 F.avg("value_rolling_mean").alias("mean_rolling_mean"),
                 F.avg("value_rolling_std").alias("mean_rolling_std"),
                 F.max("value_rolling_max").alias("max_rolling_max"),
                 F.avg("value_z").alias("mean_z")))


FLAGSHIP_SQL = f"""
WITH f AS ({FILLED_SQL}),
r AS ({ROLL_SQL.format(src="SELECT * FROM f")}),
z AS (SELECT r.*, (value - avg(value) OVER (PARTITION BY machine))
          / stddev_samp(value) OVER (PARTITION BY machine) AS value_z FROM r)
SELECT channel, count(*) AS n_rows, avg(value) AS mean_value,
  avg(value_rolling_mean) AS mean_rolling_mean, avg(value_rolling_std) AS mean_rolling_std,
  max(value_rolling_max) AS max_rolling_max, avg(value_z) AS mean_z
FROM z GROUP BY channel"""

register("flagship_series_summary", FLAGSHIP_SQL,
         dbl=["mean_value", "mean_rolling_mean", "mean_rolling_std", "max_rolling_max", "mean_z"])(flagship)


@register("n7_interpolate", FILLED_SQL, dbl=["value"])
def q_n7(spark, sf_dir):
    """N7 linear gap fill per machine over made gaps."""
    return N.interpolate_gaps(machine_series(spark, sf_dir, gaps=True), KEYS, ORDER)


def _roll_q(stat):
    cols = {"mean": "value_rolling_mean", "std": "value_rolling_std",
            "min": "value_rolling_min", "max": "value_rolling_max"}

    def q(spark, sf_dir):
        s = machine_series(spark, sf_dir, gaps=True)
        return FE.rolling_features(s, KEYS, ORDER, ["value"], window=24, stats=[stat])
    q.__doc__ = f"F5-F8 trailing 24-row rolling {stat} per machine (min_periods 1) over made gaps."
    sql = (f"SELECT machine, ts, event_id, channel, value, {cols[stat]} FROM ("
           + ROLL_SQL.format(src=SERIES_SQL) + ") AS x")
    return q, sql, [cols[stat]]


for _id, _stat in (("f5_rolling_mean", "mean"), ("f6_rolling_std", "std"),
                   ("f7_rolling_min", "min"), ("f8_rolling_max", "max")):
    _q, _sql, _d = _roll_q(_stat)
    register(_id, _sql, dbl=_d)(_q)


@register("n1_standardize", """
SELECT machine, ts, event_id, channel,
  (value - avg(value) OVER (PARTITION BY channel))
    / (stddev_samp(value) OVER (PARTITION BY channel) + 2.220446049250313e-16) AS value
FROM (""" + SERIES_FULL_SQL + ") AS s", dbl=["value"])
def q_n1(spark, sf_dir):
    """N1 standardize per channel (event type) over all rows, ddof 1 + eps."""
    return N.standardize(machine_series(spark, sf_dir), "value", by="channel")


@register("n1_standardize_samples", """
WITH x AS (SELECT vec_id AS sample_id, label, unnest(embedding)::DOUBLE AS v,
                  unnest(range(len(embedding))) AS step FROM embeddings)
SELECT sample_id, label, step::INTEGER AS step,
  (v - avg(v) OVER ()) / (stddev_samp(v) OVER () + 1e-8) AS value FROM x""", dbl=["value"])
def q_n1s(spark, sf_dir):
    """N1 (loader form, eps 1e-8) over all values of the sample table."""
    s = samples(spark, sf_dir).select("sample_id", "label", F.posexplode("series").alias("step", "value"))
    return N.standardize(s, "value", by=None, eps=1e-8).select("sample_id", "label", "step", "value")


@register("n2_minmax", """
SELECT machine, ts, event_id, channel,
  (value - min(value) OVER (PARTITION BY channel))
    / (max(value) OVER (PARTITION BY channel) - min(value) OVER (PARTITION BY channel)
       + 2.220446049250313e-16) AS value
FROM (""" + SERIES_FULL_SQL + ") AS s", dbl=["value"])
def q_n2(spark, sf_dir):
    """N2 min-max per channel over all rows."""
    return N.minmax(machine_series(spark, sf_dir), "value", by="channel")


@register("n3_standardize_per_sample", """
SELECT machine, ts, event_id, channel,
  (value - avg(value) OVER (PARTITION BY machine)) / stddev_samp(value) OVER (PARTITION BY machine) AS value
FROM (""" + SERIES_FULL_SQL + ") AS s", dbl=["value"])
def q_n3(spark, sf_dir):
    """N3 standardize within each machine (sample), ddof 1."""
    return N.standardize_per_sample(machine_series(spark, sf_dir), "machine", "value")


@register("n4_minmax_per_sample", """
SELECT machine, ts, event_id, channel,
  (value - min(value) OVER (PARTITION BY machine))
    / (max(value) OVER (PARTITION BY machine) - min(value) OVER (PARTITION BY machine)
       + 2.220446049250313e-16) AS value
FROM (""" + SERIES_FULL_SQL + ") AS s", dbl=["value"])
def q_n4(spark, sf_dir):
    """N4 min-max within each machine."""
    return N.minmax_per_sample(machine_series(spark, sf_dir), "machine", "value")
