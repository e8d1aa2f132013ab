"""Shape queries (P1-P16) and array-form norms / time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import random as R
from ..functions import timefeat as TF
from ..operators import norm as N
from ..operators import shapes as S
from ..sources.tables import machine_series, read_table, samples
from .registry import register

EMB_LONG = ("SELECT vec_id AS sample_id, label, unnest(embedding)::DOUBLE AS v, "
            "unnest(range(len(embedding))) AS i, len(embedding) AS n FROM embeddings")


def _long(df, arr, key="sample_id", extra=()):
    """Explode an array column into (key..., k, value)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys, *extra, F.posexplode(arr).alias("k", "value"))


@register("p1_label_codes", """
SELECT event_id, event_type, (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS label_code FROM events""")
def q_p1(spark, sf_dir):
    """P1 dense codes of event types over their sorted values."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    return S.label_codes(ev, "event_type")


@register("p2_to_long", "SELECT sample_id, i::INTEGER AS step, v AS value FROM (" + EMB_LONG + ") AS e")
def q_p2(spark, sf_dir):
    """P2 sample arrays to one row per step."""
    return S.to_long(samples(spark, sf_dir), "sample_id", ["series"]).withColumnRenamed("series", "value")


WIN_SQL = """
WITH s AS (SELECT user_id AS machine, ts, event_id, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT machine, pos // 16 AS win, (pos % 16)::INTEGER AS step, value FROM s"""


@register("p3_to_array", f"""
SELECT machine, win, list(value ORDER BY step) AS series FROM ({WIN_SQL}) AS w GROUP BY machine, win""")
def q_p3(spark, sf_dir):
    """P3 16-event windows per machine collected into ordered arrays."""
    w = S.windows(machine_series(spark, sf_dir), ["machine"], ["ts", "event_id"], 16)
    return S.to_array(w, ["machine", "win"], "step", "value")


@register("p4_length_profile", """
SELECT count(*) AS n_samples, min(len(string_split(text, ' '))) AS min_len,
  max(len(string_split(text, ' '))) AS max_len,
  min(len(string_split(text, ' '))) <> max(len(string_split(text, ' '))) AS unequal FROM documents""")
def q_p4(spark, sf_dir):
    """P4 length profile of whole documents split into word series."""
    d = read_table(spark, sf_dir, "documents").select(F.split("text", " ").alias("series"))
    return S.length_profile(d, "series").select(
        "n_samples", F.col("min_len").cast("bigint").alias("min_len"),
        F.col("max_len").cast("bigint").alias("max_len"), "unequal")


@register("p4_channel_lengths", """
WITH d AS (SELECT len(string_split(text, ' ')) AS a, len(string_split(text, chr(10))) AS b,
  len(string_split(text, ',')) AS c FROM documents)
SELECT count(*) AS n_samples, count(*) FILTER (b <> a OR c <> a) AS n_uneven,
  min(a) <> max(a) OR min(b) <> max(b) OR min(c) <> max(c) AS varies, max(a) AS max_len FROM d""")
def q_p4c(spark, sf_dir):
    """P4 lengths across channels: documents as series of words, lines and clauses."""
    t = read_table(spark, sf_dir, "documents").select(
        F.split("text", " ").alias("words"), F.split("text", "\n").alias("lines"), F.split("text", ",").alias("clauses"))
    return S.channel_lengths(t, ["words", "lines", "clauses"]).withColumn("max_len", F.col("max_len").cast("bigint"))


@register("p5_thin", """
SELECT sample_id, CASE WHEN n > 32 THEN i // 2 ELSE i END AS k, v AS value FROM (""" + EMB_LONG + """) AS e
WHERE n <= 32 OR i % 2 = 0""")
def q_p5(spark, sf_dir):
    """P5 every 2nd step of series longer than 32."""
    s = samples(spark, sf_dir)
    return _long(s, S.thin(F.col("series"), limit=32, factor=2)).withColumn("k", F.col("k").cast("bigint"))


@register("p6_cut", "SELECT sample_id, i AS k, v AS value FROM (" + EMB_LONG + ") AS e WHERE i < 48")
def q_p6(spark, sf_dir):
    """P6 cut series to 48 steps."""
    return _long(samples(spark, sf_dir), S.cut(F.col("series"), 48)).withColumn("k", F.col("k").cast("bigint"))


@register("p7_pad_mask", f"""
WITH w AS ({WIN_SQL}), a AS (SELECT machine, win, list(value ORDER BY step) AS arr FROM w GROUP BY machine, win)
SELECT machine, win, unnest(range(16)) AS k,
  unnest(list_transform(range(16), lambda x: CASE WHEN x < len(arr) THEN arr[x + 1] ELSE 0.0 END)) AS value,
  unnest(list_transform(range(16), lambda x: x < len(arr))) AS keep FROM a""")
def q_p7(spark, sf_dir):
    """P7 zero padding of ragged 16-event windows with a padding mask."""
    w = S.windows(machine_series(spark, sf_dir), ["machine"], ["ts", "event_id"], 16)
    a = S.to_array(w, ["machine", "win"], "step", "value")
    padded, mask = S.pad_clip(F.col("series"), 16)
    z = a.select("machine", "win", F.posexplode(F.arrays_zip(padded.alias("v"), mask.alias("m"))).alias("k", "z"))
    return z.select("machine", "win", F.col("k").cast("bigint").alias("k"),
                    F.col("z.v").alias("value"), F.col("z.m").alias("keep"))


@register("p8_filter_choices", """
SELECT o_orderkey, o_orderstatus AS dataset, o_orderpriority AS model, o_totalprice AS metric FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def q_p8(spark, sf_dir):
    """P8 filter result rows to chosen data sets and models."""
    o = read_table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")) \
        .select("o_orderkey", F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("model"),
                F.col("o_totalprice").alias("metric"))


@register("p8_option_lists", """
SELECT 'dataset' AS kind, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS options FROM orders
UNION ALL SELECT 'model', list(DISTINCT o_orderpriority ORDER BY o_orderpriority) FROM orders""")
def q_p8b(spark, sf_dir):
    """P8 sorted distinct option lists (data sets, models)."""
    o = read_table(spark, sf_dir, "orders")
    return (o.select(F.lit("dataset").alias("kind"), F.col("o_orderstatus").alias("v"))
            .unionByName(o.select(F.lit("model").alias("kind"), F.col("o_orderpriority").alias("v")))
            .groupBy("kind").agg(F.array_sort(F.collect_set("v")).alias("options")))


@register("p9_nth_of_class", """
WITH r AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)
SELECT vec_id AS sample_id, label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS value
FROM r WHERE rn = 3""")
def q_p9(spark, sf_dir):
    """P9 full series of the 3rd sample of every class."""
    s = samples(spark, sf_dir)
    pick = S.nth_of_class(s, "label", "sample_id", 3)
    return _long(pick, F.col("series"), "sample_id", ["label"]).withColumn("k", F.col("k").cast("bigint"))


@register("p10_even_odd", """
SELECT sample_id, (i % 2)::INTEGER AS part, i // 2 AS k, v AS value FROM (""" + EMB_LONG + ") AS e")
def q_p10(spark, sf_dir):
    """P10 even / odd split of each series."""
    s = samples(spark, sf_dir)
    ev, od = S.even_odd(F.col("series"))
    a = _long(s, ev).withColumn("part", F.lit(0))
    b = _long(s, od).withColumn("part", F.lit(1))
    return a.unionByName(b).select("sample_id", "part", F.col("k").cast("bigint").alias("k"), "value")


@register("p11_patches", """
WITH e AS (SELECT vec_id AS sample_id, embedding::DOUBLE[] AS a FROM embeddings),
p AS (SELECT sample_id, a || list_transform(range(8), lambda x: a[len(a)]) AS padded,
        (len(a) + 8 - 16) // 8 + 1 AS n FROM e),
q AS (SELECT sample_id, padded, unnest(range(n)) AS patch FROM p)
SELECT sample_id, patch, unnest(range(16)) AS k, unnest(padded[patch * 8 + 1 : patch * 8 + 16]) AS value FROM q""")
def q_p11(spark, sf_dir):
    """P11 patches of 16 steps every 8 after padding with the last value."""
    s = samples(spark, sf_dir).select("sample_id", S.patches(F.col("series"), 16, 8).alias("p"))
    x = s.select("sample_id", F.posexplode("p").alias("patch", "arr"))
    return x.select("sample_id", F.col("patch").cast("bigint").alias("patch"),
                    F.posexplode("arr").alias("k", "value")).withColumn("k", F.col("k").cast("bigint"))


@register("p12_chunk_views", """
WITH e AS (SELECT vec_id AS sample_id, embedding::DOUBLE[] AS a, (len(embedding) + 9) // 10 AS n FROM embeddings),
p AS (SELECT sample_id, n, a || list_transform(range(n * 10 - len(a)), lambda x: 0.0) AS padded FROM e),
t AS (SELECT sample_id, n, unnest(padded) AS value, unnest(range(n * 10)) AS i FROM p)
SELECT sample_id, 'continuous' AS mode, i // 10 AS chunk, i % 10 AS k, value FROM t
UNION ALL SELECT sample_id, 'interval', i % n, i // n, value FROM t""")
def q_p12(spark, sf_dir):
    """P12 continuous and interval chunks of 10 steps (zero padded)."""
    s = samples(spark, sf_dir)
    cont, inter = S.chunk_views(F.col("series"), 10)
    out = None
    for mode, col in (("continuous", cont), ("interval", inter)):
        x = s.select("sample_id", F.posexplode(col).alias("chunk", "arr"))
        x = x.select("sample_id", F.lit(mode).alias("mode"), F.col("chunk").cast("bigint").alias("chunk"),
                     F.posexplode("arr").alias("k", "value")).withColumn("k", F.col("k").cast("bigint"))
        out = x if out is None else out.unionByName(x)
    return out


@register("p13_merge_segments", """
WITH e AS (SELECT vec_id AS sample_id, embedding::DOUBLE[] AS a, len(embedding) // 8 AS nseg FROM embeddings),
g AS (SELECT sample_id, nseg, (3 - nseg % 3) % 3 AS pad, a FROM e),
s AS (SELECT sample_id, a[1 : nseg * 8] || a[(nseg - pad) * 8 + 1 : nseg * 8] AS flat, (nseg + pad) // 3 AS m FROM g),
t AS (SELECT sample_id, unnest(flat) AS value, unnest(range(len(flat))) AS i FROM s)
SELECT sample_id, i // 24 AS merged, i % 24 AS k, value FROM t""")
def q_p13(spark, sf_dir):
    """P13 merge 3 neighbouring 8-step segments (last ones repeated)."""
    s = samples(spark, sf_dir).select("sample_id", S.merge_segments(F.col("series"), 8, 3).alias("m"))
    x = s.select("sample_id", F.posexplode("m").alias("merged", "arr"))
    return x.select("sample_id", F.col("merged").cast("bigint").alias("merged"),
                    F.posexplode("arr").alias("k", "value")).withColumn("k", F.col("k").cast("bigint"))


def _pyr_sql(how):
    agg = "avg(v)" if how == "avg" else "max(v)"
    parts = []
    for lv in range(4):
        b = 2 ** lv
        parts.append(f"SELECT sample_id, '{how}' AS how, {lv} AS level, i // {b} AS idx, {agg} AS value "
                     f"FROM e WHERE (i // {b} + 1) * {b} <= n GROUP BY sample_id, i // {b}")
    return " UNION ALL ".join(parts)


@register("p14_pyramid", f"WITH e AS ({EMB_LONG}) " + _pyr_sql("avg") + " UNION ALL " + _pyr_sql("max"),
          dbl=["value"])
def q_p14(spark, sf_dir):
    """P14 avg and max pyramids, window 2, 3 levels above the input."""
    s = samples(spark, sf_dir)
    out = None
    for how in ("avg", "max"):
        x = s.select("sample_id", F.lit(how).alias("how"),
                     F.explode(S.pyramid(F.col("series"), 2, 3, how)).alias("p"))
        x = x.select("sample_id", "how", F.col("p.level").alias("level"),
                     F.col("p.idx").cast("bigint").alias("idx"), F.col("p.value").alias("value"))
        out = x if out is None else out.unionByName(x)
    return out


@register("p14_time_marks", """
WITH m AS (SELECT vec_id AS sample_id, unnest(embedding)::DOUBLE AS mark, unnest(range(len(embedding))) AS i FROM embeddings),
l AS (SELECT unnest(range(4)) AS level)
SELECT sample_id, level::INTEGER AS level, (i // power(3, level)::BIGINT) AS idx, mark FROM m, l
WHERE i % power(3, level)::BIGINT = 0""")
def q_p14m(spark, sf_dir):
    """P14 strided marks of a pyramid of window 3, 3 levels above the input."""
    s = samples(spark, sf_dir).select("sample_id", F.explode(S.strided_marks(F.col("series"), 3, 3)).alias("m"))
    return s.select("sample_id", F.col("m.level").alias("level"), F.col("m.idx").cast("bigint").alias("idx"), F.col("m.mark").alias("mark"))


@register("p15_fold_period", """
WITH e AS (SELECT vec_id AS sample_id, embedding::DOUBLE[] AS a, ((len(embedding) + 9) // 10) * 10 AS n FROM embeddings),
p AS (SELECT sample_id, a || list_transform(range(n - len(a)), lambda x: 0.0) AS padded FROM e),
t AS (SELECT sample_id, unnest(padded) AS value, unnest(range(len(padded))) AS i FROM p)
SELECT sample_id, (i // 10)::INTEGER AS cycle, (i % 10)::INTEGER AS phase, value FROM t""")
def q_p15(spark, sf_dir):
    """P15 fold each series by period 10 (zero padded)."""
    s = samples(spark, sf_dir).select("sample_id", F.explode(S.fold_period(F.col("series"), 10)).alias("f"))
    return s.select("sample_id", "f.cycle", "f.phase", "f.value")


@register("p16_imputation_mask", f"""
SELECT user_id AS machine, event_id,
  CASE WHEN {R.sql_uniform(7, 'user_id', 'event_id')} < 0.15 THEN 0 ELSE 1 END AS mask FROM events""")
def q_p16(spark, sf_dir):
    """P16 reproducible imputation mask at rate 0.15."""
    m = machine_series(spark, sf_dir)
    return m.select("machine", "event_id", S.imputation_mask(7, 0.15, F.col("machine"), F.col("event_id")).alias("mask"))


# ---- array-form norms --------------------------------------------------------

_N8_SQL = f"""
WITH e AS ({EMB_LONG}),
st AS (SELECT sample_id, avg(v) AS m, avg(v * v) - avg(v) * avg(v) AS vp0 FROM e GROUP BY sample_id),
st2 AS (SELECT e.sample_id, st.m, avg((e.v - st.m) * (e.v - st.m)) AS vp FROM e JOIN st USING (sample_id)
        GROUP BY e.sample_id, st.m)"""


@register("n8_instance_norm", _N8_SQL + """
SELECT e.sample_id, e.i AS k, (e.v - st2.m) / sqrt(st2.vp + 1e-5) AS value FROM e JOIN st2 USING (sample_id)""",
          dbl=["value"])
def q_n8(spark, sf_dir):
    """N8 per-sample instance normalization (population variance + 1e-5)."""
    s = N.instance_norm(samples(spark, sf_dir))
    return _long(s, F.col("series")).withColumn("k", F.col("k").cast("bigint"))


@register("n9_instance_denorm", """
WITH e AS (SELECT vec_id AS sample_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS k
           FROM embeddings)
SELECT sample_id, k, v AS value FROM e""", dbl=["value"])
def q_n9(spark, sf_dir):
    """N9 denormalization with kept statistics restores the input (round trip)."""
    s = N.instance_denorm(N.instance_norm(samples(spark, sf_dir)))
    return _long(s, F.col("series")).withColumn("k", F.col("k").cast("bigint"))


@register("n9_subtract_last", f"""
WITH e AS ({EMB_LONG}),
st AS (SELECT sample_id, avg(v) AS m FROM e GROUP BY sample_id),
sd AS (SELECT e.sample_id, sqrt(avg((e.v - st.m) * (e.v - st.m)) + 1e-5) AS s FROM e JOIN st USING (sample_id)
       GROUP BY e.sample_id),
la AS (SELECT sample_id, v AS last FROM e WHERE i = n - 1)
SELECT e.sample_id, e.i AS k, (e.v - la.last) / sd.s AS value FROM e JOIN sd USING (sample_id) JOIN la USING (sample_id)""",
          dbl=["value"])
def q_n9b(spark, sf_dir):
    """N9 'subtract last value' normalization form."""
    s = N.instance_norm(samples(spark, sf_dir), subtract_last=True)
    return _long(s, F.col("series")).withColumn("k", F.col("k").cast("bigint"))


_MASK_SQL = R.sql_uniform(7, "sample_id", "i")


@register("n10_masked_norm", f"""
WITH e AS (SELECT *, CASE WHEN {_MASK_SQL} < 0.25 THEN 0 ELSE 1 END AS mask FROM ({EMB_LONG}) AS x),
st AS (SELECT sample_id, sum(CASE WHEN mask = 1 THEN v ELSE 0.0 END) / sum(mask) AS m, sum(mask) AS c
       FROM e GROUP BY sample_id),
sd AS (SELECT e.sample_id, sqrt(sum(CASE WHEN mask = 1 THEN (v - m) * (v - m) ELSE 0.0 END) / any_value(c) + 1e-5) AS s
       FROM e JOIN st USING (sample_id) GROUP BY e.sample_id)
SELECT e.sample_id, e.i AS k, CASE WHEN mask = 1 THEN (v - m) / s ELSE 0.0 END AS value
FROM e JOIN st USING (sample_id) JOIN sd USING (sample_id)""", dbl=["value"])
def q_n10(spark, sf_dir):
    """N10 masked normalization with a 25 % hash mask per step."""
    s = samples(spark, sf_dir)
    s = s.withColumn("mask", F.transform(F.col("series"),
                                         lambda x, i: S.imputation_mask(7, 0.25, F.col("sample_id"), i)))
    out = N.masked_norm(s)
    return _long(out, F.col("series")).withColumn("k", F.col("k").cast("bigint"))


# ---- time features (N11-N13) ---------------------------------------------------

_N11 = {"second_of_minute": "second(ts) / 59.0 - 0.5", "minute_of_hour": "minute(ts) / 59.0 - 0.5",
        "hour_of_day": "hour(ts) / 23.0 - 0.5", "day_of_week": "(isodow(ts) - 1) / 6.0 - 0.5",
        "day_of_month": "(day(ts) - 1) / 30.0 - 0.5", "day_of_year": "(dayofyear(ts) - 1) / 365.0 - 0.5",
        "month_of_year": "(month(ts) - 1) / 11.0 - 0.5", "week_of_year": "(weekofyear(ts) - 1) / 52.0 - 0.5"}


@register("n11_time_features", "SELECT event_id, " + ", ".join(f"{v} AS {k}" for k, v in _N11.items())
          + " FROM events", dbl=list(_N11))
def q_n11(spark, sf_dir):
    """N11 all eight scaled time features of the event time."""
    ev = read_table(spark, sf_dir, "events")
    ts = F.col("ts")
    return ev.select("event_id", *[getattr(TF, k)(ts).alias(k) for k in _N11])


_T = TF.features_for_frequency("15min")


@register("n12_features_by_frequency", "SELECT event_id, " + ", ".join(f"{_N11[k]} AS {k}" for k in _T)
          + " FROM events", dbl=_T)
def q_n12(spark, sf_dir):
    """N12 features chosen by the frequency string '15min'."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", *[c.alias(n) for n, c in TF.time_features(F.col("ts"), "15min").items()])


@register("n13_time_marks", """
SELECT event_id, month(ts)::INTEGER AS mark_month, day(ts)::INTEGER AS mark_day,
  (isodow(ts) - 1)::INTEGER AS mark_weekday, hour(ts)::INTEGER AS mark_hour,
  (minute(ts) // 15)::INTEGER AS mark_minute FROM events""")
def q_n13(spark, sf_dir):
    """N13 integer time marks (minute in 15-minute slots)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", *[c.alias(n) for n, c in TF.time_marks(F.col("ts")).items()])


@register("n14_scale_shift_jitter", f"""
WITH e AS ({EMB_LONG})
SELECT sample_id, i AS k,
  (v * {R.sql_normal(3, 'sample_id', "'scale'", mean=1.0, sigma=0.1)} + {R.sql_normal(3, 'sample_id', "'shift'", sigma=0.1)})
   + {R.sql_normal(3, 'sample_id', 'i', "'jitter'", sigma=0.1)} AS value FROM e""", dbl=["value"])
def q_n14(spark, sf_dir):
    """N14 scale, shift and jitter with one sigma (0.1), hash-random."""
    s = samples(spark, sf_dir)
    x = N.scale_shift_jitter(s, seed=3, sigma=0.1).select("sample_id", F.posexplode("series").alias("k", "value"))
    return x.withColumn("k", F.col("k").cast("bigint"))
