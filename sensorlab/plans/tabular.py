"""the tabular preparation flow as one lazy plan with three fit passes.

load -> fill missing (F1) -> one-hot (F2) -> IQR caps (F3) -> calendar (F4)
-> sensor pairs (F9, F10) -> polynomial terms of the top-5 correlated
columns (F11, F12) -> hash split (F13) -> scaler fitted on train (N5).

Fit passes (each one aggregate, results tiny): medians, category lists,
quartiles, correlations (5 names reach the driver), train mean / std.
Rolling features (F5-F8) need a series order, which a wide table without
one does not have; they are off here as in the reference's default config.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import sql_uniform
from ..operators import clean as CL
from ..operators import features as FE
from ..operators import norm as N


def tabular_flow(df: DataFrame, target: str, id_cols: Sequence[str] = ("l_orderkey", "l_linenumber"),
                 ts_col: str = "timestamp", test_size: float = 0.2, seed: int = 42,
                 poly_k: int = 5) -> DataFrame:
    ids = list(id_cols)
    work = [c for c in df.columns if c not in ids]
    d = df.select(*ids, *work)
    d = CL.fill_missing(d, cols=[c for c in work if c != ts_col])
    d = CL.one_hot(d, [c for c, t in d.dtypes if t == "string" and c not in ids])
    num = [c for c in FE.numeric_columns(d) if c not in ids]
    d = CL.cap_outliers(d, num)
    if ts_col in d.columns:
        d = FE.calendar_features(d, ts_col).drop(ts_col)
    sensors = [c for c in d.columns if c.startswith("sensor_")]
    d = FE.sensor_pairs(d, sensors)
    num = [c for c in FE.numeric_columns(d) if c not in ids and c != target]
    if len(num) > poly_k:
        top = [r["column"] for r in FE.top_correlated(d, target, num, k=poly_k).collect()]
    else:
        top = num
    d = FE.polynomial_features(d, top)
    d = d.withColumn("split", FE.split_column(ids, test_size, seed))
    scale_cols = [c for c in FE.numeric_columns(d) if c not in ids and c != target]
    sc = N.fit_scaler(d, scale_cols, F.col("split") == "train")
    return N.apply_scaler(d, sc, scale_cols)


# ---- DuckDB oracle of the flow on the sensor stand-in (target sensor_4) ----

def _flow_sql() -> tuple[str, list[str]]:
    sensors = ["sensor_1", "sensor_2", "sensor_3", "sensor_4"]
    src = ("SELECT l_orderkey, l_linenumber, "
           "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END AS sensor_1, "
           "l_extendedprice AS sensor_2, l_discount AS sensor_3, l_tax AS sensor_4, "
           "l_returnflag, l_linestatus, l_shipdate AS timestamp FROM lineitem")
    fill = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM s0)) AS {c}" for c in sensors)
    s1 = (f"SELECT l_orderkey, l_linenumber, {fill}, timestamp, "
          "CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS l_returnflag_N, "
          "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS l_returnflag_R, "
          "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS l_linestatus_O FROM s0")

    def cap(c):
        q = f"(SELECT quantile_cont({c}, [0.25, 0.75]) FROM s1)"
        lo, hi = f"({q}[1] - 1.5 * ({q}[2] - {q}[1]))", f"({q}[2] + 1.5 * ({q}[2] - {q}[1]))"
        return f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END AS {c}"
    s2 = (f"SELECT l_orderkey, l_linenumber, {', '.join(cap(c) for c in sensors)}, "
          "l_returnflag_N, l_returnflag_R, l_linestatus_O, hour(timestamp) AS hour, "
          "isodow(timestamp) - 1 AS day_of_week, month(timestamp) AS month, day(timestamp) AS day, "
          "year(timestamp) AS year, CASE WHEN isodow(timestamp) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend FROM s1")
    pairs, names = [], []
    for a, b in itertools.combinations(sensors, 2):
        pairs += [f"coalesce({a} / nullif({b}, 0), 0.0) AS {a}_{b}_ratio", f"{a} - {b} AS {a}_{b}_diff"]
        names += [f"{a}_{b}_ratio", f"{a}_{b}_diff"]
    s3 = f"SELECT *, {', '.join(pairs)} FROM s2"
    cand = [c for c in sensors + names if c != "sensor_4"]
    corr = " UNION ALL ".join(f"SELECT '{c}' AS col, abs(corr({c}, sensor_4)) AS r, {i} AS i FROM s3"
                              for i, c in enumerate(cand))
    top = f"SELECT col, row_number() OVER (ORDER BY r DESC NULLS LAST, i) AS k FROM ({corr}) AS u"

    def pick(k):
        cases = " ".join(f"WHEN '{c}' THEN {c}" for c in cand)
        return f"(CASE (SELECT col FROM top WHERE k = {k}) {cases} END)"
    xs = [pick(k) for k in range(1, 6)]
    terms = xs + [f"{xs[i]} * {xs[j]}" for i, j in itertools.combinations_with_replacement(range(5), 2)]
    poly_names = [f"poly_{n}" for n in range(len(terms))]
    s4 = (f"SELECT *, {', '.join(f'{t} AS {p}' for t, p in zip(terms, poly_names))}, "
          f"CASE WHEN {sql_uniform(42, 'l_orderkey', 'l_linenumber')} < 0.2 THEN 'test' ELSE 'train' END AS split "
          "FROM s3")
    scale = [c for c in sensors if c != "sensor_4"] + names + poly_names
    scaled = []
    for c in scale:
        m = f"(SELECT avg({c}) FROM s4 WHERE split = 'train')"
        sd = f"(SELECT stddev_pop({c}) FROM s4 WHERE split = 'train')"
        scaled.append(f"({c} - {m}) / (CASE WHEN {sd} = 0 OR {sd} IS NULL THEN 1.0 ELSE {sd} END) AS {c}")
    sql = (f"WITH s0 AS ({src}), s1 AS ({s1}), s2 AS ({s2}), s3 AS ({s3}), top AS ({top}), s4 AS ({s4}) "
           f"SELECT l_orderkey, l_linenumber, sensor_4, l_returnflag_N::INTEGER AS l_returnflag_N, "
           "l_returnflag_R::INTEGER AS l_returnflag_R, l_linestatus_O::INTEGER AS l_linestatus_O, "
           "hour::INTEGER AS hour, day_of_week::INTEGER AS day_of_week, month::INTEGER AS month, "
           "day::INTEGER AS day, year::INTEGER AS year, is_weekend::INTEGER AS is_weekend, split, "
           f"{', '.join(scaled)} FROM s4")
    return sql, ["sensor_4"] + scale


FLOW_SQL, FLOW_DBL = _flow_sql()
