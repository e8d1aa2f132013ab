"""Spectral and decomposition queries (G1-G18) on the sample arrays."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.random import sql_uniform
from ..operators import shapes as S
from ..operators import spectral as G
from ..sources.tables import machine_series, read_table, samples
from .registry import register

FS = 64000.0  # sampling rate used for frequency axes (catalog entry 01)

EMB = ("SELECT vec_id AS sample_id, label, unnest(embedding)::DOUBLE AS v, "
       "unnest(range(len(embedding))) AS i, len(embedding) AS n FROM embeddings")
# relational DFT: one row per (sample, rfft bin)
DFT = f"""e AS ({EMB}),
bins AS (SELECT DISTINCT i AS bin FROM e),
dft AS (SELECT e.sample_id, b.bin, any_value(e.n) AS n,
          sum(e.v * cos(2 * pi() * b.bin * e.i / e.n)) AS re,
          -sum(e.v * sin(2 * pi() * b.bin * e.i / e.n)) AS im
        FROM e JOIN bins b ON b.bin <= e.n // 2 GROUP BY e.sample_id, b.bin),
amp AS (SELECT *, sqrt(re * re + im * im) AS amp FROM dft)"""


def _long(df, arr, key="sample_id", k="k"):
    return df.select(key, F.posexplode(arr).alias(k, "value")).withColumn(k, F.col(k).cast("bigint"))


@register("g1_amplitude_spectrum", f"""WITH {DFT}
SELECT sample_id, bin::INTEGER AS bin, bin * {FS} / n AS freq, amp FROM amp WHERE bin < n // 2""",
          dbl=["freq", "amp"])
def q_g1(spark, sf_dir):
    """G1 amplitude spectrum (positive half) with a frequency axis."""
    return G.amplitude_spectrum(samples(spark, sf_dir), fs=FS)


@register("g2_dominant_frequencies", f"""WITH {DFT},
h AS (SELECT *, lag(amp) OVER w AS pa, lead(amp) OVER w AS na, max(amp) OVER (PARTITION BY sample_id) AS mx
      FROM amp WHERE bin < n // 2 WINDOW w AS (PARTITION BY sample_id ORDER BY bin)),
p AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY amp DESC, bin) AS rank FROM h
      WHERE pa IS NOT NULL AND na IS NOT NULL AND amp > pa AND amp > na AND amp >= mx * 0.1)
SELECT sample_id, rank::INTEGER AS rank, bin::INTEGER AS bin, bin * {FS} / n AS freq, amp FROM p WHERE rank <= 5""",
          dbl=["freq", "amp"])
def q_g2(spark, sf_dir):
    """G2 top-5 spectral peaks above a tenth of the maximum."""
    return G.dominant_frequencies(samples(spark, sf_dir), fs=FS)


@register("g2_plateau_peaks", """
WITH a AS (SELECT vec_id AS sample_id, unnest(range(len(embedding))) AS i, floor(unnest(embedding)::DOUBLE * 6) + 9 AS v FROM embeddings),
c AS (SELECT *, v IS DISTINCT FROM lag(v) OVER w AS new FROM a WINDOW w AS (PARTITION BY sample_id ORDER BY i)),
r AS (SELECT *, sum(new::INT) OVER (PARTITION BY sample_id ORDER BY i) AS run FROM c),
g AS (SELECT sample_id, run, min(i) AS lo, max(i) AS hi, any_value(v) AS v FROM r GROUP BY sample_id, run),
n AS (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv, max(v) OVER (PARTITION BY sample_id) AS mx FROM g
      WINDOW w AS (PARTITION BY sample_id ORDER BY run)),
p AS (SELECT *, (lo + hi) // 2 AS bin FROM n WHERE v > pv AND v > nv AND v >= mx * 0.1)
SELECT sample_id, rank::INTEGER AS rank, bin::INTEGER AS bin, v AS amp
FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY v DESC, bin) AS rank FROM p) AS q WHERE rank <= 5""")
def q_g2p(spark, sf_dir):
    """G2 peaks of coarsely quantised series, which have flat tops of odd and even width."""
    s = samples(spark, sf_dir).select("sample_id", F.transform("series", lambda x: (F.floor(x * 6) + 9).cast("double")).alias("a"))
    x = s.select("sample_id", F.posexplode(G.peaks(F.col("a"))).alias("r", "e"))
    return x.select("sample_id", (F.col("r") + 1).alias("rank"), F.col("e.bin").alias("bin"), F.col("e.amp").alias("amp"))


@register("g3_main_periods", f"""WITH {DFT},
m AS (SELECT bin, any_value(n) AS n, avg(amp) AS mean_amp FROM amp GROUP BY bin),
r AS (SELECT *, row_number() OVER (ORDER BY mean_amp DESC, bin) AS rank FROM m WHERE bin > 0)
SELECT rank::INTEGER AS rank, bin::INTEGER AS bin, (n // bin)::INTEGER AS period, mean_amp FROM r WHERE rank <= 3""",
          dbl=["mean_amp"])
def q_g3(spark, sf_dir):
    """G3 three main periods of the sample set by mean amplitude."""
    return G.main_periods(samples(spark, sf_dir), k=3).drop("n_len")


@register("g3_period_weights", f"""WITH {DFT},
m AS (SELECT bin, any_value(n) AS n, avg(amp) AS mean_amp FROM amp GROUP BY bin),
r AS (SELECT *, row_number() OVER (ORDER BY mean_amp DESC, bin) AS rank FROM m WHERE bin > 0)
SELECT a.sample_id, r.rank::INTEGER AS rank, (r.n // r.bin)::INTEGER AS period, a.amp FROM amp a JOIN r USING (bin)
WHERE r.rank <= 3""", dbl=["amp"])
def q_g3w(spark, sf_dir):
    """G3 per-sample amplitude weights of the chosen periods."""
    s = samples(spark, sf_dir)
    return G.period_weights(s, G.main_periods(s, k=3))


def _ma_sql(kernels):
    parts = []
    for kk in kernels:
        h = (kk - 1) // 2
        parts.append(f"""SELECT e.sample_id, e.i, {kk} AS kern, sum(x.v) / {kk} AS t FROM e
  JOIN range(-{h}, {h + 1}) AS o(j) ON TRUE
  JOIN e x ON x.sample_id = e.sample_id AND x.i = least(greatest(e.i + o.j, 0), e.n - 1)
  GROUP BY e.sample_id, e.i""")
    return " UNION ALL ".join(parts)


def _decomp_sql(kernels):
    return f"""WITH e AS ({EMB}), ma AS ({_ma_sql(kernels)}),
tr AS (SELECT sample_id, i, avg(t) AS trend FROM ma GROUP BY sample_id, i)
SELECT e.sample_id, e.i AS k, tr.trend, e.v - tr.trend AS seasonal FROM e JOIN tr USING (sample_id, i)"""


def _decomp_q(kernels):
    def q(spark, sf_dir):
        d = G.decompose(samples(spark, sf_dir), kernels=kernels)
        z = d.select("sample_id", F.posexplode(F.arrays_zip("trend", "seasonal")).alias("k", "z"))
        return z.select("sample_id", F.col("k").cast("bigint").alias("k"), "z.trend", "z.seasonal")
    q.__doc__ = (f"G4 / G5 trend = centred moving average(s) {list(kernels)} with edge repeat, "
                 "seasonal = series - trend.")
    return q


register("g4_moving_average_decomposition", _decomp_sql([25]), dbl=["trend", "seasonal"])(_decomp_q((25,)))
register("g5_multi_kernel_decomposition", _decomp_sql([13, 17]), dbl=["trend", "seasonal"])(_decomp_q((13, 17)))


def _irfft_sql(keep_pred):
    """seasonal[t] from kept bins (keep_pred is a SQL predicate on table a)."""
    return f"""SELECT e.sample_id, e.i AS k,
  sum(CASE WHEN {keep_pred} THEN (CASE WHEN a.bin = 0 OR 2 * a.bin = e.n THEN 1.0 ELSE 2.0 END)
        * (a.re * cos(2 * pi() * a.bin * e.i / e.n) - a.im * sin(2 * pi() * a.bin * e.i / e.n)) ELSE 0.0 END) / any_value(e.n)
  AS part FROM e JOIN a ON a.sample_id = e.sample_id GROUP BY e.sample_id, e.i"""


@register("g6_dft_decomposition", f"""WITH {DFT},
a0 AS (SELECT *, CASE WHEN bin = 0 THEN 0.0 ELSE amp END AS amp0 FROM amp),
a AS (SELECT *, amp0 > (SELECT amp0 FROM a0 x WHERE x.sample_id = a0.sample_id ORDER BY amp0 DESC LIMIT 1 OFFSET 4) AS keep
      FROM a0),
s AS ({_irfft_sql("a.keep")})
SELECT s.sample_id, s.k, s.part AS seasonal, e.v - s.part AS trend FROM s JOIN e ON e.sample_id = s.sample_id AND e.i = s.k""",
          dbl=["seasonal", "trend"])
def q_g6(spark, sf_dir):
    """G6 DFT split: strongest bins (above the 5th largest) vs rest."""
    d = G.dft_decompose(samples(spark, sf_dir), top_k=5)
    z = d.select("sample_id", F.posexplode(F.arrays_zip("seasonal", "trend")).alias("k", "z"))
    return z.select("sample_id", F.col("k").cast("bigint").alias("k"), "z.seasonal", "z.trend")


_G7 = f"""WITH {DFT},
m AS (SELECT bin, avg(amp) AS mean_amp, count(*) OVER () AS nb FROM amp GROUP BY bin),
r AS (SELECT *, row_number() OVER (ORDER BY mean_amp DESC, bin) AS rank FROM m)"""


@register("g7_shared_bins", _G7 + " SELECT bin::INTEGER AS bin, mean_amp, rank::INTEGER AS rank FROM r "
          "WHERE rank <= floor(nb * 0.2)", dbl=["mean_amp"])
def q_g7(spark, sf_dir):
    """G7 shared spectrum: top 20 % bins by mean amplitude."""
    return G.shared_bins(samples(spark, sf_dir), alpha=0.2).select("bin", "mean_amp", "rank")


@register("g8_fourier_filter", _G7 + f""",
sel AS (SELECT bin FROM r WHERE rank <= floor(nb * 0.2)),
a AS (SELECT amp.*, amp.bin NOT IN (SELECT bin FROM sel) AS keep FROM amp),
s AS ({_irfft_sql("a.keep")})
SELECT s.sample_id, s.k, s.part AS x_var, e.v - s.part AS x_inv FROM s JOIN e ON e.sample_id = s.sample_id AND e.i = s.k""",
          dbl=["x_var", "x_inv"])
def q_g8(spark, sf_dir):
    """G8 split each series into the shared-bin part and the rest."""
    s = samples(spark, sf_dir)
    d = G.fourier_filter(s, G.shared_bins(s, alpha=0.2))
    z = d.select("sample_id", F.posexplode(F.arrays_zip("x_var", "x_inv")).alias("k", "z"))
    return z.select("sample_id", F.col("k").cast("bigint").alias("k"), "z.x_var", "z.x_inv")


_ACF = f"""e AS ({EMB}),
acf AS (SELECT a.sample_id, l.i AS lag, sum(b.v * a.v) AS corr FROM e a
        JOIN (SELECT DISTINCT i FROM e) l ON l.i < a.n
        JOIN e b ON b.sample_id = a.sample_id AND b.i = (a.i + l.i) % a.n GROUP BY a.sample_id, l.i)"""


@register("g9_autocorrelation", f"WITH {_ACF} SELECT sample_id, lag, corr FROM acf", dbl=["corr"])
def q_g9(spark, sf_dir):
    """G9 circular auto-correlation by FFT (oracle: relational self-join)."""
    s = samples(spark, sf_dir).select("sample_id", G.autocorrelation(F.col("series")).alias("c"))
    return s.select("sample_id", F.posexplode("c").alias("lag", "corr")).withColumn("lag", F.col("lag").cast("bigint"))


@register("g9_cross_correlation", f"""WITH e AS ({EMB}), z AS (SELECT sample_id, max(i) + 1 AS n FROM e GROUP BY sample_id)
SELECT q.sample_id, ((q.i - (z.n - 1 - k.i) + z.n) % z.n)::BIGINT AS lag, sum(q.v * k.v) AS corr
FROM e q JOIN e k ON q.sample_id = k.sample_id JOIN z ON z.sample_id = q.sample_id GROUP BY 1, 2""", dbl=["corr"])
def q_g9c(spark, sf_dir):
    """G9 circular cross-correlation of every series with its reverse (oracle: relational self-join)."""
    s = samples(spark, sf_dir).select("sample_id", G.cross_correlation(F.col("series"), F.reverse("series")).alias("c"))
    return s.select("sample_id", F.posexplode("c").alias("lag", "corr")).withColumn("lag", F.col("lag").cast("bigint"))


@register("g10_time_delay_aggregation", f"""WITH {_ACF},
top AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(corr, 9) DESC, lag) AS r FROM acf),
k AS (SELECT * FROM top WHERE r <= 4),
k2 AS (SELECT *, max(corr) OVER (PARTITION BY sample_id) AS mx FROM k),
w AS (SELECT sample_id, lag, exp(corr - mx) / sum(exp(corr - mx)) OVER (PARTITION BY sample_id) AS w FROM k2)
SELECT e.sample_id, e.i AS k, sum(w.w * x.v) AS value FROM e JOIN w ON w.sample_id = e.sample_id
JOIN e x ON x.sample_id = e.sample_id AND x.i = (e.i + w.lag) % e.n GROUP BY e.sample_id, e.i""", dbl=["value"])
def q_g10(spark, sf_dir):
    """G10 top-ln(n) lags, softmax weights, weighted sum of rolled series."""
    d = G.time_delay_aggregate(samples(spark, sf_dir), factor=1.0)
    return _long(d, F.col("delay_agg"))


@register("g11_frequency_modes", f"""
WITH l AS (SELECT DISTINCT len(embedding) AS n_len FROM embeddings),
b AS (SELECT n_len, unnest(range(n_len // 2)) AS bin FROM l),
lo AS (SELECT n_len, 'lowest' AS method, bin FROM b WHERE bin < 8),
rn AS (SELECT n_len, 'random' AS method, bin, row_number() OVER (PARTITION BY n_len
         ORDER BY {sql_uniform(0, "'mode'", 'bin')}, bin) AS r FROM b)
SELECT n_len::INTEGER AS n_len, method, bin::INTEGER AS bin FROM lo
UNION ALL SELECT n_len::INTEGER, method, bin::INTEGER FROM rn WHERE r <= 8""")
def q_g11(spark, sf_dir):
    """G11 mode selection: lowest 8 bins and 8 hash-random bins per length."""
    ln = samples(spark, sf_dir).select(F.size("series").alias("n_len")).distinct()
    out = None
    for m in ("lowest", "random"):
        x = ln.select("n_len", F.lit(m).alias("method"),
                      F.explode(G.frequency_modes(F.col("n_len"), 8, m, seed=0)).alias("bin"))
        out = x if out is None else out.unionByName(x)
    return out


@register("g12_exponential_smoothing", f"""
WITH e AS ({EMB})
SELECT a.sample_id, a.i AS k, sum(0.3 * power(0.7, a.i - b.i) * b.v) + power(0.7, a.i + 1) * 0.5 AS value
FROM e a JOIN e b ON b.sample_id = a.sample_id AND b.i <= a.i GROUP BY a.sample_id, a.i""", dbl=["value"])
def q_g12(spark, sf_dir):
    """G12 exponential smoothing, decay 0.7, start value 0.5."""
    s = samples(spark, sf_dir)
    return _long(s, G.exponential_smoothing(F.col("series"), 0.7, 0.5))


@register("g13_fourier_extrapolation", f"""WITH {DFT},
c AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY amp DESC, bin) AS r FROM amp
      WHERE bin >= 1 AND bin < (CASE WHEN n % 2 = 0 THEN n // 2 ELSE n // 2 + 1 END)),
t AS (SELECT DISTINCT sample_id, n, unnest(range(n + 8)) AS t FROM c)
SELECT t.sample_id, t.t AS k, sum(2 * c.amp / t.n * cos(2 * pi() * (c.bin / t.n) * t.t + atan2(c.im, c.re))) AS value
FROM t JOIN c ON c.sample_id = t.sample_id AND c.r <= 3 GROUP BY t.sample_id, t.t""", dbl=["value"])
def q_g13(spark, sf_dir):
    """G13 Fourier extrapolation with the 3 strongest bins, 8 steps ahead."""
    d = G.fourier_extrapolate(samples(spark, sf_dir), k=3, horizon=8)
    return _long(d, F.col("extrapolated"))


@register("g14_damped_growth", """
WITH g AS (SELECT vec_id AS sample_id, embedding[-1]::DOUBLE - embedding[-2]::DOUBLE AS growth FROM embeddings)
SELECT sample_id, h, growth * (0.9 * (1.0 - power(0.9, h)) / (1.0 - 0.9)) AS value
FROM g, range(1, 7) AS r(h)""", dbl=["value"])
def q_g14(spark, sf_dir):
    """G14 damped growth forecast over 6 steps, damping 0.9; growth = last step change."""
    s = samples(spark, sf_dir).select("sample_id", (F.element_at("series", -1) - F.element_at("series", -2)).alias("growth"))
    d = s.select("sample_id", G.damped_growth(F.col("growth"), 0.9, 6).alias("f"))
    x = d.select("sample_id", F.posexplode("f").alias("h", "value"))
    return x.select("sample_id", (F.col("h") + 1).cast("bigint").alias("h"), "value")


_R2 = 1 / math.sqrt(2.0)


@register("g15_wavelet_db1", f"""
WITH e AS ({EMB}),
a1 AS (SELECT sample_id, i // 2 AS i, sum(v * {_R2!r}) AS v, sum(CASE WHEN i % 2 = 0 THEN v * {_R2!r} ELSE -v * {_R2!r} END) AS d
       FROM e GROUP BY sample_id, i // 2),
a2 AS (SELECT sample_id, i // 2 AS i, sum(v * {_R2!r}) AS v, sum(CASE WHEN i % 2 = 0 THEN v * {_R2!r} ELSE -v * {_R2!r} END) AS d
       FROM a1 GROUP BY sample_id, i // 2)
SELECT sample_id, 0 AS band, i AS k, d AS value FROM a1
UNION ALL SELECT sample_id, 1, i, d FROM a2 UNION ALL SELECT sample_id, 2, i, v FROM a2""", dbl=["value"])
def q_g15(spark, sf_dir):
    """G15 two-level Haar (db1) decomposition: detail 1, detail 2, approximation."""
    s = samples(spark, sf_dir).select("sample_id", G.wavelet_bands("db1", 2)(F.col("series")).alias("b"))
    x = s.select("sample_id", F.posexplode("b").alias("band", "arr"))
    return x.select("sample_id", "band", F.posexplode("arr").alias("k", "value")).withColumn(
        "k", F.col("k").cast("bigint"))


# the four taps of db2, low pass and high pass; a tap k meets input 2i + 1 - k, zero outside
_LO, _HI = (x.tolist() for x in G._filters("db2"))


def _taps_sql(src: str) -> str:
    def tot(h):
        return " + ".join(f"coalesce(x{k}.v, 0) * {h[k]!r}::DOUBLE" for k in range(4))
    joins = " ".join(f"LEFT JOIN {src} AS x{k} ON x{k}.sample_id = p.sample_id AND x{k}.i = 2 * p.i + 1 - {k}" for k in range(4))
    return (f"SELECT p.sample_id, p.i, {tot(_LO)} AS v, {tot(_HI)} AS d FROM (SELECT sample_id, unnest(range((count(*) + 3) // 2)) AS i "
            f"FROM {src} GROUP BY sample_id) AS p {joins}")


@register("g15_wavelet_db2", f"""
WITH e AS ({EMB}), a1 AS ({_taps_sql("e")}), a2 AS ({_taps_sql("a1")})
SELECT sample_id, 0 AS band, i AS k, d AS value FROM a1
UNION ALL SELECT sample_id, 1, i, d FROM a2 UNION ALL SELECT sample_id, 2, i, v FROM a2""", dbl=["value"])
def q_g15b(spark, sf_dir):
    """G15 two-level db2 decomposition: detail 1, detail 2, approximation."""
    s = samples(spark, sf_dir).select("sample_id", G.wavelet_bands("db2", 2)(F.col("series")).alias("b"))
    x = s.select("sample_id", F.posexplode("b").alias("band", "arr"))
    return x.select("sample_id", "band", F.posexplode("arr").alias("k", "value")).withColumn(
        "k", F.col("k").cast("bigint"))


@register("g16_wavelet_inverse", f"WITH e AS ({EMB}) SELECT sample_id, i AS k, v AS value FROM e", dbl=["value"])
def q_g16(spark, sf_dir):
    """G16 db2 decomposition followed by the inverse transform (reconstruction)."""
    s = samples(spark, sf_dir)
    b = s.select("sample_id", F.size("series").alias("n"), G.wavelet_bands("db2", 2)(F.col("series")).alias("b"))
    r = b.select("sample_id", G.wavelet_inverse("db2", 2)(F.col("b"), F.col("n")).alias("x"))
    return _long(r, F.col("x"))


@register("g17_histogram", """
WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT CASE WHEN value = r.hi THEN 100 ELSE floor((value - r.lo) / ((r.hi - r.lo) / 100)) + 1 END::INTEGER AS bucket
      FROM events, r WHERE value IS NOT NULL)
SELECT bucket, (SELECT lo FROM r) + (bucket - 1) * ((SELECT hi - lo FROM r) / 100) AS lo,
  (SELECT lo FROM r) + bucket * ((SELECT hi - lo FROM r) / 100) AS hi, count(*) AS count FROM b GROUP BY bucket""",
          dbl=["lo", "hi"])
def q_g17(spark, sf_dir):
    """G17 100-bin histogram of event values."""
    return G.histogram(read_table(spark, sf_dir, "events"), "value", 100)


@register("g18_sample_view", """
WITH r AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)
SELECT vec_id AS sample_id, label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS value
FROM r WHERE rn = 1""")
def q_g18(spark, sf_dir):
    """G18 time-domain view of the first sample of every class (P9 + P2)."""
    pick = S.nth_of_class(samples(spark, sf_dir), "label", "sample_id", 1)
    z = S.to_long(pick.select("sample_id", "label", "series"), ["sample_id", "label"], ["series"], step="k")
    return z.select("sample_id", "label", F.col("k").cast("bigint").alias("k"), F.col("series").alias("value"))


@register("g4_moving_average_events", """
WITH s AS (SELECT user_id AS machine, ts, event_id, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
             count(*) OVER (PARTITION BY user_id) AS len FROM events),
t AS (SELECT a.machine, a.event_id, sum(b.value) / 25 AS trend FROM s a
      JOIN range(-12, 13) AS o(j) ON TRUE
      JOIN s b ON b.machine = a.machine AND b.pos = least(greatest(a.pos + o.j, 0), a.len - 1)
      GROUP BY a.machine, a.event_id)
SELECT s.machine, s.ts, s.event_id, s.value, t.trend, s.value - t.trend AS seasonal
FROM s JOIN t USING (machine, event_id)""", dbl=["trend", "seasonal"])
def q_g4e(spark, sf_dir):
    """G4 centred 25-row moving average with edge repeat per machine on telemetry."""
    s = machine_series(spark, sf_dir).select("machine", "ts", "event_id", "value")
    return G.decompose_series(s, ["machine"], ["ts", "event_id"], "value", 25)
