"""Byte-level views of text columns inside Arrow tasks.

The operators here read text as UTF-8 bytes straight from Arrow buffers: words
are located with byte-class masks and identified by a rolling 64-bit hash, all
as NumPy array work over chunks of a few hundred kilobytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches sent to Python hold at most so many bytes (one longer row alone).
BATCH_BYTES = 2 << 20
_SPARK_BATCH_BYTES = "67108864b"  # Spark's own default
#: Texts are worked on together up to so many bytes (one longer text alone).
CHUNK_BYTES = 1 << 19

#: Lower-cases the bytes A-Z and leaves all others.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_PRIME = (1 << 31) - 1
_BASES = (1_103_515_245, 747_796_405)
_BLOCK = 1 << 18
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def limit_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session has set a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == _SPARK_BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def append_columns(df: DataFrame, fields: Sequence[tuple[str, str]],
                   make: Callable[[], Callable[[pa.RecordBatch], Sequence[pa.Array]]],
                   inputs: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Append columns computed per Arrow batch.

    ``make`` runs once per task and returns the batch function, which gives one
    array per entry of ``fields`` (name, DDL type).  Columns of ``df`` that
    carry one of the new names, or are listed in ``drop``, are left out of the
    result; ``inputs`` names the columns the function reads.
    """
    limit_batches(df.sparkSession)
    new = {n for n, _ in fields}
    keep = [c for c in df.columns if c not in new and c not in drop]
    hidden = [f"__in_{i}" for i in range(len(inputs))]
    src = df.select(*[F.col(f"`{c}`") for c in keep],
                    *[F.col(f"`{c}`").alias(h) for c, h in zip(inputs, hidden, strict=True)])
    schema = T.StructType([src.schema[c] for c in keep]
                          + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    n_keep = len(keep)
    names = keep + [n for n, _ in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            if b.num_rows:
                out = fn(pa.RecordBatch.from_arrays(b.columns[n_keep:], names=list(inputs)))
                yield pa.RecordBatch.from_arrays(list(b.columns[:n_keep]) + list(out), names=names)

    return src.mapInArrow(run, schema)


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (first offset 0) of a string or binary array; a null is empty."""
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], (off - off[0]).astype(np.int64)


def chunks(data: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES,
           rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut rows into runs of at most ``limit`` bytes (at least one row) and
    ``rows`` rows: (first row, row after the last, bytes, offsets from 0)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, lo + rows)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes, and the row of each; a run
    never crosses a row border given by ``off``."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    border = off[:-1][off[:-1] < n]
    begin[border] = mask[border]
    last = off[1:][off[1:] > 0] - 1
    end[last] = mask[last]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(end) + 1, np.searchsorted(off, s, side="right") - 1


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo the prime."""
    if base not in _tables:
        def table(b: int) -> np.ndarray:
            out, size = np.ones(1, np.uint64), 1
            while size < _BLOCK:  # doubling: the next half is the first times b ** size
                out = np.concatenate([out, out * np.uint64(pow(b, size, _PRIME)) % np.uint64(_PRIME)])
                size *= 2
            return out
        _tables[base] = table(base), table(pow(base, -1, _PRIME))
    return _tables[base]


def _fold(x: np.ndarray) -> np.ndarray:
    """Congruent modulo the prime, and below 2^32 for x below 2^62."""
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(31))


def _polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Sum of (byte + 1) * base ** place over every slice, modulo the prime, from prefix sums; for each base."""
    tables = [_powers(b) for b in _BASES]
    outs = [np.empty(len(starts), np.uint64) for _ in _BASES]
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + _BLOCK, side="right")))
        b = int(ends[j - 1])
        if b - a > _BLOCK:  # one slice longer than a block
            for base, (up, _), out in zip(_BASES, tables, outs, strict=True):
                h = 0
                for k in range(a, b, _BLOCK):
                    part = data[k:min(b, k + _BLOCK)].astype(np.uint64) + np.uint64(1)
                    h += int(_fold(part * up[:len(part)]).sum()) * pow(base, k - a, _PRIME)
                out[i] = h % _PRIME
        else:
            v = data[a:b].astype(np.uint64) + np.uint64(1)
            s, e = starts[i:j] - a, ends[i:j] - a
            c = np.zeros(b - a + 1, np.uint64)
            for (up, inv), out in zip(tables, outs, strict=True):
                np.cumsum(v * up[:b - a], out=c[1:])  # below 2^57: no sum needs folding before
                out[i:j] = _fold(_fold(c[e] - c[s]) * inv[s]) % np.uint64(_PRIME)
        i = j
    return outs


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every slice data[starts[i]:ends[i]] (slices in
    ascending order, not overlapping): two polynomials in the bytes modulo a
    prime, mixed at the end.  Equal bytes give equal hashes everywhere."""
    one, two = _polynomials(data, starts, ends)
    return mix64(one << np.uint64(32) | two)


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a finalizer of multiplications and shifts)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def crc_id(col: str):
    """crc32 of an id as text (null: of the empty text), for label splits."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))
