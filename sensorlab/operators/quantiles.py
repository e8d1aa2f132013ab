"""Exact quantiles of whole columns by radix selection.

Spark's exact ``percentile`` merges every distinct value of a column into one
buffer for a global aggregate.  Here a double is read as a 64-bit integer of the
same order, and the value of a rank is found digit by digit from the top: one
pass counts, for all columns and ranks together, how often each next digit
follows the digits known so far.  With 16-bit digits that makes four scans,
whatever the number of rows, their spread and their ties; the counts of a pass
are an aggregate of ``ACCURACY`` cells at most, shared among the open prefixes
(many of them make the digits shorter and the passes more).

Between the two ranks around (n - 1) * q the value is interpolated linearly,
as in pandas.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a pass's histograms, for all columns and ranks together.
ACCURACY = 1 << 20
_DIGIT = (4, 16)  # bits of a digit, least and most


def present(c: Column) -> Column:
    """A numeric column as double with NaN as NULL."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def _keys(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles (-0.0 counts as 0.0)."""
    bits = (x + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits >= top, ~bits, bits | top)


def _value(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _digit_counts(df: DataFrame, open_: list[tuple[int, int]], left: int, bits: int) -> list[np.ndarray]:
    """For every (column, prefix) in ``open_`` the counts of the next ``bits`` bits among
    the values that begin with the prefix; ``left`` bits are not known yet."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(open_), 1 << bits), np.int64)
        for b in batches:
            held: dict[int, np.ndarray] = {}
            for g, (i, prefix) in enumerate(open_):
                if i not in held:
                    held[i] = _keys(b.column(i).drop_null().to_numpy(zero_copy_only=False).astype(np.float64))
                k = held[i]
                if left < 64:
                    k = k[(k >> np.uint64(left)) == np.uint64(prefix)]
                digit = (k >> np.uint64(left - bits)) & np.uint64((1 << bits) - 1)
                total[g] += np.bincount(digit.astype(np.int64), minlength=1 << bits)
        g, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(d, pa.int32()), pa.array(total[g, d])], names=["g", "d", "n"])
    got = df.mapInArrow(count, "g int, d int, n bigint").groupBy("g", "d").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(open_), 1 << bits), np.int64)
    out[got["g"].to_numpy(), got["d"].to_numpy()] = got["n"].to_numpy()
    return list(out)


def order_statistics(df: DataFrame, xs: Sequence[Column], wanted: Sequence[tuple[int, int]],
                     counts: Sequence[int]) -> dict[tuple[int, int], float]:
    """{(i, r): value of rank r (from 0) of xs[i]} for the ``wanted`` pairs, 0 <= r < counts[i];
    NaN counts as missing, like NULL."""
    # (column, rank) -> bits known so far, and the rank among the values that begin with them
    found = {t: (0, t[1]) for t in wanted if 0 <= t[1] < counts[t[0]]}
    table = df.select(*[present(x).alias(f"x{i}") for i, x in enumerate(xs)])
    left = 64
    while left and found:
        open_ = sorted({(i, prefix) for (i, _), (prefix, _) in found.items()})
        bits = min(left, max(_DIGIT[0], min(_DIGIT[1], int(math.log2(max(2, ACCURACY // len(open_)))))))
        below = {p: np.concatenate([[0], np.cumsum(c)]) for p, c in zip(open_, _digit_counts(table, open_, left, bits), strict=True)}
        for (i, r), (prefix, rank) in found.items():
            c = below[i, prefix]
            d = int(np.searchsorted(c, rank, side="right")) - 1
            found[i, r] = prefix << bits | d, rank - int(c[d])
        left -= bits
    return {t: _value(key) for t, (key, _) in found.items()}


def exact_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> dict[str, list[float | None]]:
    """{column: [quantile value for each q]} over the values that are neither NULL nor NaN."""
    cols = list(cols)
    if not cols:
        return {}
    xs = [present(F.col(c)) for c in cols]
    counts = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(xs)]).first()
    ranks = order_statistics(df, xs, [(i, r) for i in range(len(cols)) if counts[i] for q in qs
                                      for h in [(counts[i] - 1) * q] for r in (math.floor(h), math.ceil(h))], counts)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = []
        for q in qs:
            h = (counts[i] - 1) * q
            if not counts[i]:
                out[c].append(None)
                continue
            a, b = ranks[i, math.floor(h)], ranks[i, math.ceil(h)]
            out[c].append(a + (b - a) * (h - math.floor(h)))
    return out
