"""Shape operators: codes, long <-> array forms, resampling of sample arrays
(P1-P16).

Sample arrays are bounded per row (one sample window), so the array work is
row-local: higher-order functions inside one projection, no shuffle.  Where
a result is naturally long (patches, folds, pyramids) it is exploded at the
end of the same stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import random as R
from ..functions.arrays import let
from ..plans import chunked as C


def label_codes(df: DataFrame, label: str, out: str = "label_code") -> DataFrame:
    """Dense code of ``label`` over its sorted distinct values (0-based);
    NULL labels get -1.  The distinct-label table is joined back by value;
    AQE broadcasts it when its measured size is small."""
    cats = df.select(label).where(F.col(label).isNotNull()).distinct()
    # one row per category: the ordering window runs over the category list only
    codes = cats.select(label, (F.dense_rank().over(Window.orderBy(label)) - 1).alias(out))
    return df.join(codes, label, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def to_long(df: DataFrame, key: Sequence[str] | str, arrays: Sequence[str],
            step: str = "step") -> DataFrame:
    """One row per (sample, step) with all channel arrays aligned."""
    key = [key] if isinstance(key, str) else list(key)
    z = F.arrays_zip(*[F.col(a) for a in arrays])
    return (df.select(*key, F.posexplode(z).alias(step, "_z"))
            .select(*key, step, *[F.col("_z")[a].alias(a) for a in arrays]))


def to_array(df: DataFrame, key: Sequence[str] | str, step: str, value: str,
             out: str = "series") -> DataFrame:
    """Long rows back to one ordered array per sample (sorted by step;
    ``collect_list`` alone has no order).  Use on bounded sample windows."""
    key = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(value).alias("v")))),
                    lambda x: x["v"]).alias(out))


def windows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], length: int,
            value: str = "value", chunk: Column | None = None) -> DataFrame:
    """Cut each long series into consecutive sample windows of ``length`` rows
    (the last one may be shorter): (keys, win, step, value).  Positions come
    from the skew-safe chunked index."""
    rows, _ = C.index_series(df, keys, order, chunk)
    return rows.select(*keys, (F.col(C.POS) / length).cast("long").alias("win"),
                       (F.col(C.POS) % length).cast("int").alias("step"), value)


def length_profile(df: DataFrame, series: str) -> DataFrame:
    """Number of samples, min and max length, and whether lengths differ."""
    n = F.size(series)
    return df.agg(F.count(F.lit(1)).alias("n_samples"), F.min(n).alias("min_len"),
                  F.max(n).alias("max_len"), (F.min(n) != F.max(n)).alias("unequal"))


def channel_lengths(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """P4 over several channels (one array column each): samples, samples whose
    channels differ in length, whether any channel's length differs between
    samples, and the longest series of the first channel.  A missing array has
    length 0."""
    n = [F.coalesce(F.size(F.col(c)), F.lit(0)) for c in channels]
    n = [F.greatest(x, F.lit(0)) for x in n]  # size of NULL is -1 in legacy mode
    uneven = F.lit(False)
    for x in n[1:]:
        uneven = uneven | (x != n[0])
    varies = F.lit(False)
    for x in n:
        varies = varies | (F.min(x) != F.max(x))
    return df.agg(F.count(F.lit(1)).alias("n_samples"), F.count(F.when(uneven, 1)).alias("n_uneven"),
                  F.coalesce(varies, F.lit(False)).alias("varies"), F.max(n[0]).alias("max_len"))


def thin(a: Column, limit: int = 256, factor: int = 2) -> Column:
    """P5: every ``factor``-th step when longer than ``limit``."""
    return F.when(F.size(a) > limit, F.filter(a, lambda x, i: i % factor == 0)).otherwise(a)


def cut(a: Column, seq_len: int) -> Column:
    """First ``seq_len`` steps."""
    return F.slice(a, 1, seq_len)


def pad_clip(a: Column, max_len: int) -> tuple[Column, Column]:
    """(array padded with 0 / clipped to ``max_len``, padding mask)."""
    padded = F.slice(F.concat(a, F.array_repeat(F.lit(0.0), F.lit(max_len))), 1, max_len)
    mask = F.transform(F.sequence(F.lit(0), F.lit(max_len - 1)), lambda i: i < F.size(a))
    return padded, mask


def nth_of_class(df: DataFrame, label: str, sample: str, n: int) -> DataFrame:
    """The ``n``-th sample (1-based, by sample id) of every class.

    Only labels and ids are put in order (over ranges, so one dominant class is
    spread over many tasks); the chosen ids, one per class, then pick their rows."""
    ids, _ = C.index_series(df.select(label, sample), [label], [sample])
    chosen = ids.where(F.col(C.POS) == n - 1).select(F.col(label).alias("_label"), F.col(sample).alias("_sample"))
    on = F.col(label).eqNullSafe(F.col("_label")) & F.col(sample).eqNullSafe(F.col("_sample"))
    return df.join(chosen, on).dropDuplicates([label, sample]).select(*df.columns)


def even_odd(a: Column) -> tuple[Column, Column]:
    """P10: (even steps, odd steps)."""
    return F.filter(a, lambda x, i: i % 2 == 0), F.filter(a, lambda x, i: i % 2 == 1)


def patches(a: Column, patch_len: int, stride: int, pad: int | None = None) -> Column:
    """Pad right with ``pad`` (default ``stride``) copies of the last value,
    then windows of ``patch_len`` every ``stride`` steps: ARRAY<ARRAY<DOUBLE>>."""
    pad = stride if pad is None else pad
    n = F.floor((F.size(a) + pad - patch_len) / stride) + 1
    return let(F.concat(a, F.array_repeat(F.element_at(a, -1), F.lit(pad))), lambda padded: F.transform(
        F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.slice(padded, i * stride + 1, patch_len)))


def chunk_views(a: Column, chunk_size: int) -> tuple[Column, Column]:
    """Zero-pad to whole chunks; (continuous chunks, interval chunks) as
    arrays of arrays.  Continuous chunk j holds steps j*c .. j*c+c-1; interval
    chunk j holds steps j, j+n, j+2n, ... (n = number of chunks)."""
    c = chunk_size
    n = F.ceil(F.size(a) / F.lit(c)).cast("int")
    padded = F.concat(a, F.array_repeat(F.lit(0.0), n * c - F.size(a)))
    cont = let(padded, lambda p: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.slice(p, j * c + 1, c)))
    inter = let(padded, lambda p: F.transform(F.sequence(F.lit(0), n - 1),
                                              lambda j: F.transform(F.sequence(F.lit(0), F.lit(c - 1)),
                                                                    lambda k: F.element_at(p, k * n + j + 1))))
    return cont, inter


def merge_segments(a: Column, seg_len: int, win: int) -> Column:
    """View the series as segments of ``seg_len`` steps; pad by repeating
    the last segments to a multiple of ``win``; merged segment j is the
    concatenation of segments j*win .. j*win+win-1."""
    nseg = (F.size(a) / seg_len).cast("int")
    pad = (F.lit(win) - nseg % win) % win
    segs = F.transform(F.sequence(F.lit(0), nseg - 1), lambda j: F.slice(a, j * seg_len + 1, seg_len))
    m = ((nseg + pad) / win).cast("int")
    whole = let(segs, lambda x: F.concat(x, F.slice(x, -pad, pad)))
    return let(whole, lambda x: F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.flatten(F.slice(x, j * win + 1, win))))


def pyramid(a: Column, window: int, levels: int, how: str = "avg") -> Column:
    """Non-overlapping avg (or max) pools applied ``levels`` times; level
    l has floor(n / window^l) values, each the pool of a complete block of
    window^l steps (pooling equal-size pools equals pooling the block).
    Returns ARRAY<STRUCT<level, idx, value>> including level 0."""
    def level(lv: int) -> Column:
        b = window ** lv
        cnt = (F.size(a) / b).cast("int")

        def pool(i):
            blk = F.slice(a, i * b + 1, b)
            if how == "max":
                return F.array_max(blk)
            return F.aggregate(blk, F.lit(0.0), lambda acc, x: acc + x) / b
        return F.transform(F.sequence(F.lit(0), cnt - 1),
                           lambda i: F.struct(F.lit(lv).alias("level"), i.alias("idx"), pool(i).alias("value")))
    out = [level(lv) for lv in range(levels + 1)]
    return F.flatten(F.array(*out))


def strided_marks(marks: Column, window: int, levels: int) -> Column:
    """Time marks of every pyramid level: at level l each ``window``-th mark of
    the level below, so the marks of steps 0, window^l, 2 window^l, ...:
    ARRAY<STRUCT<level, idx, mark>> including level 0."""
    def level(lv: int) -> Column:
        b = window ** lv
        return F.transform(F.filter(marks, lambda x, i: i % b == 0),
                           lambda x, i: F.struct(F.lit(lv).alias("level"), i.alias("idx"), x.alias("mark")))
    return F.flatten(F.array(*[level(lv) for lv in range(levels + 1)]))


def fold_period(a: Column, period: int) -> Column:
    """Zero-pad to a multiple of ``period``; ARRAY<STRUCT<cycle, phase,
    value>> with cycle = step div period, phase = step mod period."""
    n = F.ceil(F.size(a) / F.lit(period)).cast("int") * period
    padded = F.concat(a, F.array_repeat(F.lit(0.0), n - F.size(a)))
    return F.transform(padded, lambda x, i: F.struct((i / period).cast("int").alias("cycle"),
                                                     (i % period).alias("phase"), x.alias("value")))


def imputation_mask(seed: int, rate: float, *parts) -> Column:
    """0 (masked, to impute) with probability ``rate``, else 1, from the
    hash-uniform of (seed, parts) - reproducible on any partitioning."""
    return F.when(R.uniform(seed, *parts) < F.lit(rate), F.lit(0)).otherwise(F.lit(1))
