"""Normalization and repair of series.

Long form: one row per (key, step[, channel]) with a ``value`` column.
Array form: one row per sample with a ``series ARRAY<DOUBLE>`` column.

Statistics are computed with one partial (map-side combined) aggregate and
joined back on their key.  The statistics tables have one row per group; no
broadcast hint is given, so AQE broadcasts them when their measured size is
small and otherwise plans a shuffle join whose skewed partitions it splits.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import random as R
from ..functions.arrays import fit_row, let
from ..plans import chunked as C

EPS = sys.float_info.epsilon  # numpy float64 machine epsilon


def _by(by: Sequence[str] | str | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _with_stats(df: DataFrame, by: list[str], stats: dict[str, Column]) -> DataFrame:
    if by:
        st = df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()])
        return df.join(st, by, "left")
    # one global row: fitted once, applied as literals
    row = fit_row(df, stats)
    return df.select("*", *[F.lit(row[n]).cast("double").alias(n) for n in stats])


# ---- N1-N4 -----------------------------------------------------------------

def standardize(df: DataFrame, value: str = "value", by=None, eps: float = EPS,
                out: str | None = None) -> DataFrame:
    """(v - mean) / (std_ddof1 + eps) with statistics over all rows of each
    ``by`` group (per channel); ``by=None`` uses the whole column.
    Use ``eps=1e-8`` for the loader variant."""
    out = out or value
    d = _with_stats(df, _by(by), {"_m": F.avg(value), "_s": F.stddev_samp(value)})
    return (d.withColumn(out, (F.col(value) - F.col("_m")) / (F.col("_s") + F.lit(eps)))
            .drop("_m", "_s"))


def minmax(df: DataFrame, value: str = "value", by=None, eps: float = EPS,
           out: str | None = None) -> DataFrame:
    """(v - min) / (max - min + eps) per channel over all rows."""
    out = out or value
    d = _with_stats(df, _by(by), {"_lo": F.min(value), "_hi": F.max(value)})
    return (d.withColumn(out, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(eps)))
            .drop("_lo", "_hi"))


def standardize_per_sample(df: DataFrame, sample: Sequence[str] | str, value: str = "value",
                           out: str | None = None) -> DataFrame:
    """(v - mean) / std_ddof1 within each sample (no epsilon, as in the
    reference; a constant sample gives NULL where the reference gives NaN)."""
    out = out or value
    d = _with_stats(df, _by(sample), {"_m": F.avg(value), "_s": F.stddev_samp(value)})
    return d.withColumn(out, F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def minmax_per_sample(df: DataFrame, sample: Sequence[str] | str, value: str = "value",
                      eps: float = EPS, out: str | None = None) -> DataFrame:
    """(v - min) / (max - min + eps) within each sample."""
    out = out or value
    d = _with_stats(df, _by(sample), {"_lo": F.min(value), "_hi": F.max(value)})
    return (d.withColumn(out, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(eps)))
            .drop("_lo", "_hi"))


# ---- N5, N6 ----------------------------------------------------------------

def fit_scaler(df: DataFrame, cols: Sequence[str], fit_where: Column | None = None) -> DataFrame:
    """N5 fit: one row (column, mean, scale) per column, population std (ddof 0),
    scale 1 for constant columns.  Kept as a DataFrame (see S17 for saving)."""
    src = df.where(fit_where) if fit_where is not None else df
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m__{c}"), F.stddev_pop(c).alias(f"s__{c}")]
    row = src.agg(*aggs)
    pairs = ", ".join(f"'{c}', `m__{c}`, `s__{c}`" for c in cols)
    long = row.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, mean, std)")
    return long.select("column", "mean",
                       F.when((F.col("std") == 0) | F.col("std").isNull(), F.lit(1.0))
                       .otherwise(F.col("std")).alias("scale"))


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str],
                 inverse: bool = False) -> DataFrame:
    """N5 / N6 transform: (x - mean) / scale, or x * scale + mean when ``inverse``.

    The scaler has one row per column; it is read once (a few numbers per
    column) and applied as literals, so the transform is a plain projection."""
    rows = {r["column"]: (r["mean"], r["scale"]) for r in scaler.where(F.col("column").isin(list(cols))).collect()}
    proj = []
    for c in df.columns:
        if c in cols:
            m, k = (F.lit(rows[c][0]).cast("double"), F.lit(rows[c][1]).cast("double"))
            proj.append(((F.col(c) * k + m) if inverse else ((F.col(c) - m) / k)).alias(c))
        else:
            proj.append(F.col(c))
    return df.select(*proj)


def scale_with(df: DataFrame, cols: Sequence[str], mean: float, std: float,
               inverse: bool = False) -> DataFrame:
    """Scale with given mean / std (or invert)."""
    proj = [((F.col(c) * std + mean) if inverse else ((F.col(c) - mean) / std)).alias(c)
            if c in cols else F.col(c) for c in df.columns]
    return df.select(*proj)


# ---- N7 --------------------------------------------------------------------

def interpolate_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                     value: str = "value", chunk: Column | None = None,
                     out: str | None = None, keep_index: bool = False) -> DataFrame:
    """Linear gap fill inside each series, steps equally spaced; leading and
    trailing gaps take the nearest observed value; all-NULL series stay NULL.

    Skew-safe: one window pass per (key, chunk) plus a chunk table that
    carries the last / next observed value across chunk boundaries (see
    ``plans.chunked``).  ``keep_index`` keeps the position columns so a
    following order-dependent operator can reuse them.
    """
    out = out or value
    df = df.withColumn(value, F.when(~F.isnan(F.col(value).cast("double")), F.col(value)))  # NaN is a gap
    rows, _ = C.index_series(df, keys, order, chunk, carry=[value])
    vp, pp = F.col(f"_prev_{value}"), F.col(f"_prevpos_{value}")
    vn, pn = F.col(f"_next_{value}"), F.col(f"_nextpos_{value}")
    p = F.col(C.POS)
    filled = (F.when(F.col(value).isNotNull(), F.col(value))
              .when(vp.isNotNull() & vn.isNotNull(),
                    vp + (vn - vp) * (p - pp).cast("double") / (pn - pp).cast("double"))
              .otherwise(F.coalesce(vp, vn)))
    rows = rows.withColumn(out, filled).drop(f"_prev_{value}", f"_prevpos_{value}", f"_next_{value}",
                                             f"_nextpos_{value}")
    return rows if keep_index else C.drop_index(rows)


# ---- N8-N10 (array form) ---------------------------------------------------

def _two_pass(a: Column, finish) -> Column:
    """Evaluate ``finish(mean, var_pop)`` of array ``a`` with each statistic
    computed once per row: the statistics are lambda variables of
    ``aggregate``'s finish functions, so they are not re-inlined into the
    per-element lambdas (which would make the work quadratic in length)."""
    n = F.size(a)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x,
                       lambda s: F.aggregate(a, F.lit(0.0), lambda v, x: v + (x - s / n) * (x - s / n),
                                             lambda v: finish(s / n, v / n)))


def instance_norm(df: DataFrame, series: str = "series", eps: float = 1e-5,
                  subtract_last: bool = False, keep_stats: bool = True) -> DataFrame:
    """Per sample (and channel) zero mean and unit population variance:
    (x - mean) / sqrt(var_pop + eps).  With ``subtract_last`` the last value
    is subtracted instead of the mean (the std is still the population std).
    Keeps ``_center`` and ``_stdev`` columns for :func:`instance_denorm`."""
    a = F.col(series)

    def finish(mean, var):
        sd = F.sqrt(var + F.lit(eps))
        center = F.element_at(a, -1) if subtract_last else mean
        return F.struct(F.transform(a, lambda x: (x - center) / sd).alias("x"),
                        center.alias("c"), sd.alias("s"))
    d = df.withColumn("_r", _two_pass(a, finish))
    d = (d.withColumn(series, F.col("_r.x")).withColumn("_center", F.col("_r.c"))
         .withColumn("_stdev", F.col("_r.s")).drop("_r"))
    return d if keep_stats else d.drop("_center", "_stdev")


def instance_denorm(df: DataFrame, series: str = "series") -> DataFrame:
    """Inverse of :func:`instance_norm` using the kept statistics."""
    st = F.struct(F.col("_stdev").alias("s"), F.col("_center").alias("c"))
    return (df.withColumn(series, let(st, lambda k: F.transform(F.col(series), lambda x: x * k["s"] + k["c"])))
            .drop("_center", "_stdev"))


def masked_norm(df: DataFrame, series: str = "series", mask: str = "mask",
                eps: float = 1e-5) -> DataFrame:
    """Mean and std over observed steps only (mask = 1); masked steps 0.
    Adds ``obs_mean`` and ``obs_std``."""
    z = F.arrays_zip(F.col(series).alias("x"), F.col(mask).alias("m"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("c"))

    def first(acc):
        mean = F.try_divide(acc["s"], acc["c"])

        def second(v):
            sd = F.sqrt(F.try_divide(v, acc["c"]) + F.lit(eps))
            return F.struct(F.transform(z, lambda e: F.when(e["m"] == 1, (e["x"] - mean) / sd)
                                        .otherwise(F.lit(0.0))).alias("x"),
                            mean.alias("mean"), sd.alias("std"))
        return F.aggregate(z, F.lit(0.0), lambda v, e: v + F.when(e["m"] == 1, (e["x"] - mean) * (e["x"] - mean))
                           .otherwise(F.lit(0.0)), second)
    r = F.aggregate(z, zero, lambda acc, e: F.struct(
        (acc["s"] + F.when(e["m"] == 1, e["x"]).otherwise(F.lit(0.0))).alias("s"),
        (acc["c"] + F.when(e["m"] == 1, F.lit(1)).otherwise(F.lit(0))).alias("c")), first)
    d = df.withColumn("_r", r)
    return (d.withColumn(series, F.col("_r.x")).withColumn("obs_mean", F.col("_r.mean"))
            .withColumn("obs_std", F.col("_r.std")).drop("_r"))


# ---- N14 -------------------------------------------------------------------

def scale_shift_jitter(df: DataFrame, seed: int = 0, sigma: float = 0.1, series: str = "series",
                       key: str = "sample_id") -> DataFrame:
    """Every series times N(1, sigma), plus N(0, sigma) for the whole series,
    plus N(0, sigma) for each step; the draws are hashes of the seed and the sample."""
    def draw(*what, mean=0.0):
        return R.normal(seed, F.col(key), *what, mean=mean, sigma=sigma)
    return df.withColumn(series, let(draw("scale", mean=1.0), lambda scale: let(draw("shift"), lambda shift: F.transform(
        series, lambda x, i: (x * scale + shift) + draw(i, "jitter")))))
