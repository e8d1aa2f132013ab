"""Tabular feature engineering (F4-F14) and trailing rolling statistics.

Rolling statistics are order dependent: they need a series key and a total
order.  Windows run per (key, chunk) with the preceding ``w - 1`` rows
borrowed across the chunk boundary, so a hot key is spread over many tasks
and results equal a plain per-key window.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import random as R
from ..functions import timefeat
from ..plans import chunked as C


def calendar_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """hour, day_of_week (Mon = 0), month, day, year, is_weekend."""
    t = F.col(ts).cast("timestamp_ntz") if dict(df.dtypes)[ts] == "string" else F.col(ts)
    return df.select("*", *[c.alias(n) for n, c in timefeat.calendar_parts(t).items()])


def rolling_features(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                     cols: Sequence[str], window: int = 24, chunk: Column | None = None,
                     stats: Sequence[str] = ("mean", "std", "min", "max"), bucket: int | None = None) -> DataFrame:
    """Trailing rolling mean / std (ddof 1, 0 where undefined) / min /
    max over ``window`` rows with min_periods 1, per series ``keys``.

    Output: the input columns plus ``{col}_rolling_{stat}``.  If ``df``
    already carries the chunked index (``_pos``, ``_len``) it is reused.
    """
    if C.POS not in df.columns:
        df, _ = C.index_series(df, keys, order, chunk)
    base = [c for c in C.drop_index(df).columns if c not in keys]
    both = C.with_neighbours(df, None, keys, base, before=window - 1, bucket=bucket)
    w = (Window.partitionBy(*keys, C.CHUNK).orderBy(C.POS)
         .rowsBetween(-(window - 1), Window.currentRow))
    fns = {"mean": lambda c: F.avg(c).over(w),
           "std": lambda c: F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0)),
           "min": lambda c: F.min(c).over(w),
           "max": lambda c: F.max(c).over(w)}
    feats = [fns[s](c).alias(f"{c}_rolling_{s}") for c in cols for s in stats]
    out = both.select(*keys, *base, C.BORROWED, *feats)
    return out.where(~F.col(C.BORROWED)).drop(C.BORROWED)


def sensor_pairs(df: DataFrame, cols: Sequence[str] | None = None, ratio: bool = True,
                 diff: bool = True) -> DataFrame:
    """For each pair i < j of sensor columns, ratio (0 when the
    denominator is 0 or either side missing) and difference."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c.startswith("sensor_")]
    extra = []
    for a, b in itertools.combinations(cols, 2):
        if ratio:
            extra.append(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
                         .alias(f"{a}_{b}_ratio"))
        if diff:
            extra.append((F.col(a) - F.col(b)).alias(f"{a}_{b}_diff"))
    return df.select("*", *extra)


def numeric_columns(df: DataFrame, types=("double", "bigint")) -> list[str]:
    """Numeric selection of the reference: float64 and int64 columns only."""
    return [c for c, t in df.dtypes if t in types]


def top_correlated(df: DataFrame, target: str, cols: Sequence[str] | None = None,
                   k: int = 5) -> DataFrame:
    """the ``k`` numeric columns with the largest |corr| with ``target``
    (target excluded), as rows (column, abs_corr, rank).  One aggregate pass."""
    cols = [c for c in (cols or numeric_columns(df)) if c != target]
    def corr(a, b):
        # over pairwise-complete rows (like pandas ``corrwith``); NULL rather
        # than an ANSI error for a constant column
        both = a.isNotNull() & b.isNotNull()
        a2, b2 = F.when(both, a), F.when(both, b)
        return F.try_divide(F.covar_samp(a2, b2), F.stddev_samp(a2) * F.stddev_samp(b2))
    row = df.agg(*[F.abs(corr(F.col(c).cast("double"), F.col(target).cast("double"))).alias(c)
                   for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = row.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, abs_corr)")
    pos = {c: i for i, c in enumerate(cols)}
    idx = F.create_map(*itertools.chain.from_iterable((F.lit(c), F.lit(i)) for c, i in pos.items()))
    # NaN correlations (constant columns) sort last, ties keep column order
    return (long.withColumn("_i", idx[F.col("column")])
            .orderBy(F.col("abs_corr").desc_nulls_last(), F.col("_i"))
            .limit(k).drop("_i"))


def polynomial_features(df: DataFrame, cols: Sequence[str], prefix: str = "poly_") -> DataFrame:
    """degree-2 expansion without bias in the usual order: x1..xn, then
    x1^2, x1*x2, ..., x2^2, ... named ``poly_0``..``poly_{m-1}``."""
    terms: list[Column] = [F.col(c).cast("double") for c in cols]
    for i, j in itertools.combinations_with_replacement(range(len(cols)), 2):
        terms.append(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double"))
    return df.select("*", *[t.alias(f"{prefix}{n}") for n, t in enumerate(terms)])


def split_column(key: Sequence[str | Column], test_size: float = 0.2, seed: int = 42) -> Column:
    """reproducible train / test assignment: 'test' where the hash-uniform
    of (seed, key) is below ``test_size``.  Independent of partitioning and
    re-runnable after executor loss (no ``rand``)."""
    u = R.uniform(seed, *[F.col(k) if isinstance(k, str) else k for k in key])
    return F.when(u < F.lit(test_size), F.lit("test")).otherwise(F.lit("train"))


def exact_split(df: DataFrame, key: Sequence[str | Column], test_size: float = 0.2, seed: int = 42,
                out: str = "split") -> DataFrame:
    """``out`` is 'test' for exactly ceil(n * test_size) rows, those whose
    hash-uniform of (seed, key) is smallest, else 'train'.  The cut-off is an
    order statistic found in a few aggregates, so nothing is sorted.  Rows with
    equal keys share a side, which may make the test part larger by them."""
    from .quantiles import order_statistics
    u = R.uniform(seed, *[F.col(k) if isinstance(k, str) else k for k in key])
    n = df.count()
    k = min(n, math.ceil(n * test_size))
    if not k:
        return df.withColumn(out, F.lit("train"))
    cut = order_statistics(df, [u], [(0, k - 1)], [n])[0, k - 1]
    return df.withColumn(out, F.when(u <= F.lit(cut), F.lit("test")).otherwise(F.lit("train")))


def features_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(features, target) projections of the same rows."""
    return df.drop(target), df.select(target)
