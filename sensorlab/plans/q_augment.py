"""Augmentation queries (A1-A17) on the sample table, round 1, seed 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.random import sql_normal, sql_uniform
from ..operators import augment as A
from .q_dtw import PATH_SQL, cells_sql, symmetric_sql
from ..sources.tables import samples
from .registry import register

EMB = ("SELECT vec_id AS sample_id, label, unnest(embedding)::DOUBLE AS v, "
       "unnest(range(len(embedding))) AS i, len(embedding) AS n FROM embeddings")


def _src(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("round", F.lit(1))


def _long(df):
    x = df.select("sample_id", F.posexplode("series").alias("k", "value"))
    return x.select("sample_id", F.col("k").cast("bigint").alias("k"), "value")


NJ = sql_normal(0, "1", "'jitter'", "sample_id", "i", sigma=0.03)
NS = sql_normal(0, "1", "'scaling'", "sample_id", mean=1.0, sigma=0.1)
SIGN = f"(CASE WHEN {sql_uniform(0, '1', chr(39) + 'rotation' + chr(39), 'sample_id')} < 0.5 THEN -1.0 ELSE 1.0 END)"


@register("a1_jitter", f"WITH e AS ({EMB}) SELECT sample_id, i AS k, v + {NJ} AS value FROM e", dbl=["value"])
def q_a1(spark, sf_dir):
    """A1 jitter N(0, 0.03)."""
    return _long(A.jitter(_src(spark, sf_dir)))


@register("a2_scaling", f"WITH e AS ({EMB}) SELECT sample_id, i AS k, v * {NS} AS value FROM e", dbl=["value"])
def q_a2(spark, sf_dir):
    """A2 scaling by N(1, 0.1) per sample."""
    return _long(A.scaling(_src(spark, sf_dir)))


@register("a3_rotation", f"WITH e AS ({EMB}) SELECT sample_id, i AS k, v * {SIGN} AS value FROM e", dbl=["value"])
def q_a3(spark, sf_dir):
    """A3 random sign flip per sample."""
    return _long(A.rotation(_src(spark, sf_dir)))


def _perm_sql(mode):
    op = "perm" if mode == "equal" else "rperm"
    k = f"(1 + floor({sql_uniform(0, '1', repr(op), 'sample_id', repr('k'))} * 4))::INTEGER"
    if mode == "equal":
        seg = f"""
s AS (SELECT DISTINCT sample_id, n, {k} AS kk FROM e),
g AS (SELECT sample_id, n, kk, unnest(range(kk)) AS j FROM s),
g2 AS (SELECT *, j * (n // kk) + least(j, n % kk) AS st, n // kk + CASE WHEN j < n % kk THEN 1 ELSE 0 END AS sz FROM g),"""
    else:
        seg = f"""
s AS (SELECT DISTINCT sample_id, n, {k} AS kk FROM e),
c0 AS (SELECT sample_id, kk, unnest(range(n - 2)) AS p FROM s),
c1 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {sql_uniform(0, '1', repr(op), 'sample_id', repr('cut'), 'p')}) AS r FROM c0),
cuts AS (SELECT sample_id, p FROM c1 WHERE r <= kk - 1),
b AS (SELECT sample_id, 0 AS p FROM s UNION ALL SELECT sample_id, p FROM cuts UNION ALL SELECT sample_id, n FROM s),
b2 AS (SELECT sample_id, p, row_number() OVER (PARTITION BY sample_id ORDER BY p) - 1 AS j,
          lead(p) OVER (PARTITION BY sample_id ORDER BY p) AS p2 FROM b),
g2 AS (SELECT b2.sample_id, s.n, s.kk, b2.j, b2.p AS st, b2.p2 - b2.p AS sz FROM b2 JOIN s USING (sample_id)
       WHERE b2.p2 IS NOT NULL),"""
    return f"""WITH e AS ({EMB}),{seg}
o AS (SELECT *, sum(sz) OVER (PARTITION BY sample_id ORDER BY {sql_uniform(0, '1', repr(op), 'sample_id', repr('seg'), 'j')}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off FROM g2)
SELECT e.sample_id, (CASE WHEN o.kk > 1 THEN coalesce(o.off, 0) + (e.i - o.st) ELSE e.i END)::BIGINT AS k, e.v AS value
FROM e JOIN o ON o.sample_id = e.sample_id AND e.i >= o.st AND e.i < o.st + o.sz"""


@register("a4_permutation", _perm_sql("equal"))
def q_a4(spark, sf_dir):
    """A4 permutation of 1-4 equal segments."""
    return _long(A.permutation(_src(spark, sf_dir), mode="equal"))


@register("a5_random_permutation", _perm_sql("random"))
def q_a5(spark, sf_dir):
    """A5 permutation of segments cut at random points."""
    return _long(A.permutation(_src(spark, sf_dir), mode="random"))


def _channels(spark, sf_dir):
    """The series cut into 32 steps of two channels."""
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.size("series") / 2).cast("int") - 1), lambda i: F.slice("series", 2 * i + 1, 2))
    return _src(spark, sf_dir).withColumn("series", steps)


def _long_channels(df):
    x = df.select("sample_id", F.posexplode("series").alias("k", "v")).select("sample_id", "k", F.posexplode("v").alias("ch", "value"))
    return x.select("sample_id", F.col("k").cast("bigint").alias("k"), F.col("ch").cast("bigint").alias("ch"), "value")


CHAN = ("SELECT vec_id AS sample_id, label, v, p // 2 AS i, p % 2 AS ch, n // 2 AS n FROM (SELECT vec_id, label, "
        "unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS p, len(embedding) AS n FROM embeddings) AS u")


def _spline_sql(op: str, steps: int, channels: bool, times: str = "") -> str:
    """Spline values f (sample_id, i[, ch]) through 6 drawn knots, by the basis matrix of ``steps`` steps."""
    basis = ", ".join(f"({i}, {k}, {b!r}::DOUBLE)" for i, r in enumerate(A.spline_basis(steps, 6).tolist()) for k, b in enumerate(r))
    draw = sql_normal(0, "1", f"'{op}'", "sample_id", "k", *(["ch"] if channels else []), mean=1.0, sigma=0.2)
    ch = ", ch" if channels else ""
    return f"""basis AS (SELECT * FROM (VALUES {basis}) AS t(i, k, b)),
ids AS (SELECT DISTINCT sample_id{ch} FROM e),
kn AS (SELECT sample_id{ch}, k, {draw}{times} AS y FROM ids, (SELECT unnest(range(6)) AS k) AS q),
f AS (SELECT sample_id{ch}, i, sum(b * y) AS f FROM kn JOIN basis USING (k) GROUP BY ALL)"""


def _magnitude_sql(src: str, steps: int, channels: bool) -> str:
    ch = ", ch" if channels else ""
    return f"WITH e AS ({src}), {_spline_sql('magwarp', steps, channels)} SELECT sample_id, i AS k{ch}, v * f AS value FROM e JOIN f USING (sample_id{ch}, i)"


def _time_sql(src: str, steps: int, channels: bool) -> str:
    """The warped axis, its running maximum, and the two places of it around every step."""
    ch, last = ", ch" if channels else "", steps - 1
    return f"""WITH e AS ({src}), {_spline_sql('timewarp', steps, channels, f" * (k * {last} / 5.0)")},
g AS (SELECT *, {last} / last_value(f) OVER (PARTITION BY sample_id{ch} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sc FROM f),
h AS (SELECT sample_id{ch}, i, max(least(greatest(sc * f, 0.0), {last}.0)) OVER (PARTITION BY sample_id{ch} ORDER BY i) AS pl FROM g),
w AS (SELECT h.*, v, lead(h.pl) OVER q AS npl, lead(v) OVER q AS nv FROM h JOIN e USING (sample_id{ch}, i) WINDOW q AS (PARTITION BY sample_id{ch} ORDER BY i)),
j AS (SELECT sample_id{ch}, t.t, coalesce(max(i) FILTER (WHERE h.pl <= t.t), 0) AS i FROM h, (SELECT unnest(range({steps})) AS t) AS t GROUP BY ALL)
SELECT j.sample_id, j.t AS k{ch.replace("ch", "j.ch")}, CASE WHEN npl IS NULL OR npl <= pl THEN v ELSE v + (t - pl) / (npl - pl) * (nv - v) END AS value
FROM j JOIN w USING (sample_id{ch}, i)"""


def _window_warp_sql(src: str, channels: bool) -> str:
    ch = ", ch" if channels else ""
    op, id_ = "'wwarp'", "sample_id"
    return f"""WITH e AS ({src}),
s AS (SELECT DISTINCT sample_id{ch}, n, ceil(n / 10.0)::BIGINT AS size, CASE WHEN {sql_uniform(0, "1", op, id_, "'scale'")} < 0.5 THEN 0.5 ELSE 2.0 END AS rate,
  {sql_uniform(0, "1", op, id_, "'start'")} AS u FROM e),
s2 AS (SELECT *, 1 + floor(u * (n - size - 2))::BIGINT AS b, floor(size * rate)::BIGINT AS m FROM s),
t AS (SELECT *, unnest(range(n)) AS k, n - size + m AS total FROM s2),
t2 AS (SELECT *, k * ((total - 1) / (n - 1.0)) AS spot, least(floor(k * ((total - 1) / (n - 1.0)))::BIGINT, greatest(total - 2, 0)) AS low FROM t),
x AS (SELECT *, low + side AS kk FROM t2, (VALUES (0), (1)) AS q(side)),
y AS (SELECT *, CASE WHEN kk < b THEN kk WHEN kk < b + m THEN b + (kk - b) * ((size - 1)::DOUBLE / greatest(m - 1, 1)) ELSE kk - m + size END::DOUBLE AS pl FROM x),
y2 AS (SELECT *, least(floor(pl), n - 1)::BIGINT AS li, least(floor(pl) + 1, n - 1)::BIGINT AS ri FROM y),
z AS (SELECT y2.*, l.v AS lv, r.v AS rv FROM y2 JOIN e AS l ON l.sample_id = y2.sample_id AND l.i = y2.li {"AND l.ch = y2.ch" if channels else ""}
  JOIN e AS r ON r.sample_id = y2.sample_id AND r.i = y2.ri {"AND r.ch = y2.ch" if channels else ""}),
o AS (SELECT *, lv * (1 - (pl - li)) + rv * (pl - li) AS val FROM z)
SELECT sample_id, k{ch}, sum(CASE WHEN side = 0 THEN val * (1 - (spot - low)) ELSE val * (spot - low) END) AS value FROM o GROUP BY sample_id, k{ch}"""


@register("a6_magnitude_warp", _magnitude_sql(EMB, 64, False), dbl=["value"])
def q_a6(spark, sf_dir):
    """A6 magnitude warp by a not-a-knot cubic spline of 6 N(1, 0.2) knots."""
    return _long(A.magnitude_warp(_src(spark, sf_dir)))


@register("a6_magnitude_warp_channels", _magnitude_sql(CHAN, 32, True), dbl=["value"])
def q_a6c(spark, sf_dir):
    """A6 with two channels, each with a spline of its own."""
    return _long_channels(A.magnitude_warp(_channels(spark, sf_dir)))


@register("a7_time_warp", _time_sql(EMB, 64, False), dbl=["value"])
def q_a7(spark, sf_dir):
    """A7 time warp along a spline-distorted time axis."""
    return _long(A.time_warp(_src(spark, sf_dir)))


@register("a7_time_warp_channels", _time_sql(CHAN, 32, True), dbl=["value"])
def q_a7c(spark, sf_dir):
    """A7 with two channels, each along an axis of its own."""
    return _long_channels(A.time_warp(_channels(spark, sf_dir)))


_WS = f"""WITH e AS ({EMB}),
s AS (SELECT DISTINCT sample_id, n, ceil(0.9::DOUBLE * n)::INTEGER AS tl FROM e),
s2 AS (SELECT *, floor({sql_uniform(0, '1', repr('wslice'), 'sample_id')} * (n - tl))::INTEGER AS st FROM s),
q AS (SELECT s2.*, t.i, t.i * tl::DOUBLE / (n - 1) AS q FROM s2, (SELECT DISTINCT i FROM e) t WHERE t.i < s2.n)
SELECT q.sample_id, q.i AS k,
  CASE WHEN q.q >= q.tl - 1 THEN (SELECT v FROM e WHERE e.sample_id = q.sample_id AND e.i = q.st + q.tl - 1)
       ELSE a.v + (q.q - floor(q.q)) * (b.v - a.v) END AS value
FROM q LEFT JOIN e a ON a.sample_id = q.sample_id AND a.i = q.st + floor(q.q)::INTEGER
LEFT JOIN e b ON b.sample_id = q.sample_id AND b.i = q.st + floor(q.q)::INTEGER + 1"""


@register("a8_window_slice", _WS, dbl=["value"])
def q_a8(spark, sf_dir):
    """A8 random 90 % window stretched to full length."""
    return _long(A.window_slice(_src(spark, sf_dir)))


@register("a9_window_warp", _window_warp_sql(EMB, False), dbl=["value"])
def q_a9(spark, sf_dir):
    """A9 window warp (10 % window, x0.5 or x2)."""
    return _long(A.window_warp(_src(spark, sf_dir)))


@register("a9_window_warp_channels", _window_warp_sql(CHAN, True), dbl=["value"])
def q_a9c(spark, sf_dir):
    """A9 with two channels, warped alike."""
    return _long_channels(A.window_warp(_channels(spark, sf_dir)))


@register("a10_spawner")
def q_a10(spark, sf_dir):
    """A10 SPAWNER average with a same-class partner along split DTW paths."""
    return _long(A.spawner(_src(spark, sf_dir)))


@register("a11_wdba")
def q_a11(spark, sf_dir):
    """A11 weighted DBA of 6 same-class samples around their medoid."""
    return _long(A.wdba(_src(spark, sf_dir)))


def _guided_sql(src: str, channels: bool) -> str:
    """The path of every sample to its prototype; then the sample along it, resampled."""
    ch = ", ch" if channels else ""
    cost = "sqrt(list_sum(list_transform(range(1, len(a[i]) + 1), lambda q: power(a[i][q] - b[j][q], 2))))" if channels else "abs(a[i] - b[j])"
    steps = 32 if channels else 64
    values = "list(v ORDER BY i)" if not channels else "list(v ORDER BY i)"
    rows = f"(SELECT sample_id, label, i, list(v ORDER BY ch) AS v FROM ({src}) AS s GROUP BY ALL)" if channels else f"({src})"
    order = sql_uniform(0, "'order'", "pk")
    unpack = "CROSS JOIN (SELECT unnest(range(1, 3)) AS ch) AS c" if channels else ""

    def at(x):
        return f"{x}[c.ch]" if channels else x
    return f"""WITH RECURSIVE e AS (SELECT sample_id, label, '1|' || sample_id::VARCHAR AS pk, {values} AS a FROM {rows} AS r GROUP BY sample_id, label),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {order}, pk) - 1 AS pos, count(*) OVER (PARTITION BY label) AS m FROM e),
pairs AS (SELECT x.sample_id AS pid, y.a AS a, x.a AS b FROM o AS x JOIN o AS y ON y.label = x.label AND y.pos = (x.pos + 1) % x.m WHERE x.m > 1),
{cells_sql(cost, f"abs(i - j) <= ceil({steps} / 10.0)")}, {symmetric_sql()}, {PATH_SQL},
w AS (SELECT path.pid, step, b[j + 1] AS v, max(step) OVER (PARTITION BY path.pid) AS last FROM path JOIN pairs USING (pid)),
t AS (SELECT DISTINCT pid, last, unnest(range({steps})) AS k FROM w),
u AS (SELECT *, k * last / {steps - 1}.0 AS spot FROM t)
SELECT u.pid AS sample_id, k{", c.ch - 1 AS ch" if channels else ""},
  {at("x.v")} + (spot - x.step) * (coalesce({at("y.v")}, {at("x.v")}) - {at("x.v")}) AS value
FROM u JOIN w AS x ON x.pid = u.pid AND x.step = floor(spot) LEFT JOIN w AS y ON y.pid = u.pid AND y.step = floor(spot) + 1 {unpack}
UNION ALL SELECT sample_id, unnest(range({steps})) AS k{", ch" if channels else ""}, {"unnest(list_transform(a, lambda q: q[ch + 1]))" if channels else "unnest(a)"} AS value
FROM o{", (SELECT unnest(range(2)) AS ch) AS c" if channels else ""} WHERE m = 1"""


@register("a12_random_guided_warp_channels", _guided_sql(CHAN, True), dbl=["value"])
def q_a12c(spark, sf_dir):
    """A12 with two channels and one path for both."""
    return _long_channels(A.random_guided_warp(_channels(spark, sf_dir)))


@register("a12_random_guided_warp", _guided_sql(EMB, False), dbl=["value"])
def q_a12(spark, sf_dir):
    """A12 random guided warp (DTW path to a same-class prototype)."""
    return _long(A.random_guided_warp(_src(spark, sf_dir)))


@register("a13_random_guided_warp_shape")
def q_a13(spark, sf_dir):
    """A13 random guided warp with shape-DTW."""
    return _long(A.random_guided_warp(_src(spark, sf_dir), shape=True))


@register("a14_discriminative_guided_warp")
def q_a14(spark, sf_dir):
    """A14 discriminative guided warp with variable window slicing."""
    return _long(A.discriminative_guided_warp(_src(spark, sf_dir)))


@register("a15_discriminative_guided_warp_shape")
def q_a15(spark, sf_dir):
    """A15 discriminative guided warp with shape-DTW."""
    return _long(A.discriminative_guided_warp(_src(spark, sf_dir), shape=True))


def _nj(r):
    return sql_normal(0, str(r), "'jitter'", "sample_id", "i", sigma=0.03)


def _ns(r):
    return sql_normal(0, str(r), "'scaling'", "sample_id", mean=1.0, sigma=0.1)


@register("a16_augmented_set", f"""WITH e AS ({EMB})
SELECT sample_id, label, 0 AS round, i AS k, v AS value FROM e
UNION ALL SELECT sample_id, label, 1, i, (v + {_nj(1)}) * {_ns(1)} FROM e
UNION ALL SELECT sample_id, label, 2, i, (v + {_nj(2)}) * {_ns(2)} FROM e""", dbl=["value"])
def q_a16(spark, sf_dir):
    """A16 originals plus 2 rounds of jitter + scaling."""
    d, _ = A.augmented_set(samples(spark, sf_dir), ["jitter", "scaling"], ratio=2, seed=0)
    x = d.select("sample_id", "label", "round", F.posexplode("series").alias("k", "value"))
    return x.select("sample_id", "label", "round", F.col("k").cast("bigint").alias("k"), "value")


@register("a17_chain", f"""WITH e AS ({EMB})
SELECT sample_id, i AS k, ((v + {NJ}) * {NS}) * {SIGN} AS value, '_jitter_scaling_rotation' AS tag FROM e""",
          dbl=["value"])
def q_a17(spark, sf_dir):
    """A17 chain rotation, jitter, scaling given in any order, applied in the
    fixed order with its tag."""
    d, tag = A.augment(_src(spark, sf_dir), ["rotation", "jitter", "scaling"], seed=0)
    return _long(d).withColumn("tag", F.lit(tag))
