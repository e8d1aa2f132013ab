"""Tabular cleaning and features (F1-F15, N5, N6) on the wide sensor table."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions.random import sql_uniform
from ..operators import clean as CL
from ..operators import features as FE
from ..operators import norm as N
from ..sources.tables import machine_series, read_table, sensor_table
from . import tabular as T
from .registry import register

SENSORS = ["sensor_1", "sensor_2", "sensor_3", "sensor_4"]

SENSOR_SQL = ("SELECT l_orderkey, l_linenumber, l_partkey, "
              "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END AS sensor_1, "
              "l_extendedprice AS sensor_2, l_discount AS sensor_3, l_tax AS sensor_4, "
              "l_returnflag, l_linestatus, l_shipdate AS timestamp FROM lineitem")
SENSOR_FULL_SQL = SENSOR_SQL.replace(
    "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END", "l_quantity")


@register("s1_read_table", """
SELECT l_returnflag, l_linestatus, count(*) AS n_rows, sum(l_quantity) AS sum_qty,
       avg(l_extendedprice) AS avg_price FROM lineitem GROUP BY l_returnflag, l_linestatus""",
          dbl=["sum_qty", "avg_price"])
def q_s1(spark, sf_dir):
    """S1 read by extension (parquet) and summarise."""
    from ..sources.tables import read_by_extension
    li = read_by_extension(spark, f"{sf_dir}/lineitem.parquet")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_qty"),
        F.avg("l_extendedprice").alias("avg_price"))


@register("f1_fill_missing", f"""
WITH s AS ({SENSOR_SQL})
SELECT l_orderkey, l_linenumber, l_partkey,
  coalesce(sensor_1, (SELECT quantile_cont(sensor_1, 0.5) FROM s)) AS sensor_1,
  sensor_2, sensor_3, sensor_4, coalesce(l_returnflag, 'unknown') AS l_returnflag,
  coalesce(l_linestatus, 'unknown') AS l_linestatus, timestamp FROM s""",
          dbl=SENSORS)
def q_f1(spark, sf_dir):
    """F1 median / 'unknown' fill of sensor and text columns."""
    return CL.fill_missing(sensor_table(spark, sf_dir, nulls=True),
                           cols=SENSORS + ["l_returnflag", "l_linestatus"])


_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_STAT = ["F", "O", "P"]
_F2_COLS = ([f"CASE WHEN o_orderstatus = '{v}' THEN 1 ELSE 0 END::INTEGER AS \"o_orderstatus_{v}\""
             for v in _STAT[1:]]
            + [f"CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END::INTEGER AS \"o_orderpriority_{v}\""
               for v in _PRIO[1:]])


@register("f2_one_hot", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, "
          + ", ".join(_F2_COLS) + " FROM orders", dbl=["o_totalprice"])
def q_f2(spark, sf_dir):
    """F2 one-hot of order status and priority, first category dropped."""
    o = read_table(spark, sf_dir, "orders")
    return CL.one_hot(o, ["o_orderstatus", "o_orderpriority"])


def _cap_sql(c):
    q = f"(SELECT quantile_cont({c}, [0.25, 0.75]) FROM s)"
    lo = f"({q}[1] - 1.5 * ({q}[2] - {q}[1]))"
    hi = f"({q}[2] + 1.5 * ({q}[2] - {q}[1]))"
    return f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END AS {c}"


@register("f3_iqr_cap", f"WITH s AS ({SENSOR_FULL_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, "
          + ", ".join(_cap_sql(c) for c in SENSORS)
          + ", l_returnflag, l_linestatus, timestamp FROM s", dbl=SENSORS)
def q_f3(spark, sf_dir):
    """F3 IQR outlier capping of the four sensor columns."""
    return CL.cap_outliers(sensor_table(spark, sf_dir), SENSORS)


@register("f4_calendar", """
SELECT user_id, ts, event_id, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS day_of_week,
  month(ts)::INTEGER AS month, day(ts)::INTEGER AS day, year(ts)::INTEGER AS year,
  CASE WHEN isodow(ts) IN (6, 7) THEN 1 ELSE 0 END::INTEGER AS is_weekend FROM events""")
def q_f4(spark, sf_dir):
    """F4 calendar parts of the event time stamp."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return FE.calendar_features(ev, "ts")


def _pair_sql(ratio, diff):
    out = []
    for a, b in itertools.combinations(SENSORS, 2):
        if ratio:
            out.append(f"coalesce({a} / nullif({b}, 0), 0.0) AS {a}_{b}_ratio")
        if diff:
            out.append(f"{a} - {b} AS {a}_{b}_diff")
    return out


_RATIO = [f"{a}_{b}_ratio" for a, b in itertools.combinations(SENSORS, 2)]
_DIFF = [f"{a}_{b}_diff" for a, b in itertools.combinations(SENSORS, 2)]


@register("f9_sensor_ratio", f"SELECT l_orderkey, l_linenumber, {', '.join(_pair_sql(True, False))} "
          f"FROM ({SENSOR_SQL}) AS s", dbl=_RATIO)
def q_f9(spark, sf_dir):
    """F9 pairwise sensor ratios, 0 for a zero or missing denominator."""
    s = sensor_table(spark, sf_dir, nulls=True).select("l_orderkey", "l_linenumber", *SENSORS)
    return FE.sensor_pairs(s, SENSORS, ratio=True, diff=False).drop(*SENSORS)


@register("f10_sensor_diff", f"SELECT l_orderkey, l_linenumber, {', '.join(_pair_sql(False, True))} "
          f"FROM ({SENSOR_SQL}) AS s", dbl=_DIFF)
def q_f10(spark, sf_dir):
    """F10 pairwise sensor differences."""
    s = sensor_table(spark, sf_dir, nulls=True).select("l_orderkey", "l_linenumber", *SENSORS)
    return FE.sensor_pairs(s, SENSORS, ratio=False, diff=True).drop(*SENSORS)


_F11_CANDIDATES = ["l_orderkey", "l_partkey", "sensor_2", "sensor_3", "sensor_4"] + _RATIO + _DIFF


def _f11_sql():
    sel = ", ".join(f"abs(corr({c}, sensor_1)) AS {c}" for c in _F11_CANDIDATES)
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS abs_corr, {i} AS i FROM a"
                              for i, c in enumerate(_F11_CANDIDATES))
    return (f"WITH s AS (SELECT *, {', '.join(_pair_sql(True, True))} FROM ({SENSOR_FULL_SQL}) AS b), "
            f"a AS (SELECT {sel} FROM s), u AS ({rows}) "
            "SELECT feature, abs_corr FROM u ORDER BY abs_corr DESC NULLS LAST, i LIMIT 5")


@register("f11_top_correlated", _f11_sql(), dbl=["abs_corr"])
def q_f11(spark, sf_dir):
    """F11 top-5 columns by |corr| with the target sensor_1."""
    s = FE.sensor_pairs(sensor_table(spark, sf_dir), SENSORS)
    return FE.top_correlated(s, "sensor_1", _F11_CANDIDATES, k=5).withColumnRenamed("column", "feature")


_POLY = ([f"{c}::DOUBLE" for c in SENSORS]
         + [f"{SENSORS[i]} * {SENSORS[j]}" for i, j in
            itertools.combinations_with_replacement(range(4), 2)])


@register("f12_polynomial", "SELECT l_orderkey, l_linenumber, "
          + ", ".join(f"{t} AS poly_{n}" for n, t in enumerate(_POLY))
          + f" FROM ({SENSOR_FULL_SQL}) AS s")
def q_f12(spark, sf_dir):
    """F12 degree-2 polynomial expansion of the four sensors."""
    s = sensor_table(spark, sf_dir).select("l_orderkey", "l_linenumber", *SENSORS)
    return FE.polynomial_features(s, SENSORS).drop(*SENSORS)


_SPLIT_SQL = f"CASE WHEN {sql_uniform(42, 'o_orderkey')} < 0.2 THEN 'test' ELSE 'train' END"


@register("f13_train_test_split", f"SELECT o_orderkey, {_SPLIT_SQL} AS split FROM orders")
def q_f13(spark, sf_dir):
    """F13 reproducible 80/20 split by hash of (seed, key)."""
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", FE.split_column(["o_orderkey"], 0.2, 42).alias("split"))


@register("f13_exact_split", f"""
WITH o AS (SELECT o_orderkey, {sql_uniform(42, 'o_orderkey')} AS u, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY u) <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM o""")
def q_f13e(spark, sf_dir):
    """F13 split with exactly ceil(n * 0.2) test rows."""
    return FE.exact_split(read_table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 0.2, 42)


@register("f14_features_target", f"SELECT * EXCLUDE (sensor_4) FROM ({SENSOR_FULL_SQL}) AS s")
def q_f14(spark, sf_dir):
    """F14 features without the target column."""
    feats, _ = FE.features_target(sensor_table(spark, sf_dir), "sensor_4")
    return feats


_N5_SCALED = ["o_totalprice", "o_custkey"]


def _n5_sql():
    base = f"SELECT o_orderkey, o_custkey, o_totalprice, {_SPLIT_SQL} AS split FROM orders"
    cols = []
    for c in _N5_SCALED:
        m = f"(SELECT avg({c}) FROM b WHERE split = 'train')"
        sd = f"(SELECT stddev_pop({c}) FROM b WHERE split = 'train')"
        k = f"(CASE WHEN {sd} = 0 OR {sd} IS NULL THEN 1.0 ELSE {sd} END)"
        cols.append(f"({c} - {m}) / {k} AS {c}")
    return f"WITH b AS ({base}) SELECT o_orderkey, {', '.join(cols)}, split FROM b"


@register("n5_fit_scale", _n5_sql(), dbl=_N5_SCALED)
def q_n5(spark, sf_dir):
    """N5 scaler fitted on the train split (ddof 0) and applied to both."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", FE.split_column(["o_orderkey"], 0.2, 42).alias("split"))
    sc = N.fit_scaler(o, _N5_SCALED, F.col("split") == "train")
    return N.apply_scaler(o, sc, _N5_SCALED)


@register("n6_scale_given", """
SELECT user_id, event_id, (value - 25.0) / 10.0 AS scaled,
       ((value - 25.0) / 10.0) * 10.0 + 25.0 AS restored FROM events""", dbl=["scaled", "restored"])
def q_n6(spark, sf_dir):
    """N6 scale with given mean / std and the inverse transform."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("scaled"))
    sc = N.scale_with(ev, ["scaled"], 25.0, 10.0)
    back = N.scale_with(sc.withColumn("restored", F.col("scaled")), ["restored"], 25.0, 10.0, inverse=True)
    return back


@register("f15_tabular_flow", T.FLOW_SQL, dbl=T.FLOW_DBL)
def q_f15(spark, sf_dir):
    """F15 load -> fill -> one-hot -> cap -> calendar -> pairs -> polynomial
    -> split -> train-fitted scaling, on the wide sensor table."""
    return T.tabular_flow(sensor_table(spark, sf_dir, nulls=True).drop("l_partkey"), target="sensor_4")
