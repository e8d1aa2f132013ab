"""Skew-safe layout for order-dependent work on long series.

A window partitioned by the series key alone sends every row of a key to one
task; one machine holding a third of all rows would then run in one task.
Instead rows are range-partitioned by the key *and* the order columns
(``sorted_runs``), and windows are partitioned by ``(key, chunk)``, the chunk
being the number of the range:

* ``index_series`` stores the sorted runs once (each row knows its place in its
  run) and builds a chunk table (one row per key and chunk it touches) whose
  per-key windows give each chunk its global row offset and, for ``carry``
  columns, the values to carry over from earlier / later chunks.  One join of
  the rows with the chunk table gives the global position ``_pos`` of every row
  and, for each carry column, the last (``_prev_*``) and next (``_next_*``)
  non-null value at any distance with their positions.
* ``with_neighbours`` prepares exact bounded frames (rolling statistics,
  centred averages, lags): rows are re-bucketed by position (``_pos`` div
  ``bucket``, so buckets are equally full even for a hot key) and the few
  rows within ``before`` / ``after`` of a bucket edge are duplicated into the
  neighbouring bucket by one ``explode``, flagged ``_borrowed``.  Window over
  ``partitionBy(keys, _chunk).orderBy(_pos)`` and drop borrowed rows.

The chunk table has one row per key and one more per range border inside a key;
its windows are per key over chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

CHUNK, RN, CNT, OFF, POS, LEN, BORROWED = "_chunk", "_rn", "_cnt", "_off", "_pos", "_len", "_borrowed"
INDEX_COLS = [CHUNK, RN, CNT, OFF, LEN, POS]
BUCKET = 1 << 16   # rows per position bucket, at least; it grows with the frame


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def default_chunk(ts_col: str = "ts", unit: str = "hour") -> Column:
    """Chunk by time bucket; must be monotone in the series order."""
    return F.date_trunc(unit, F.col(ts_col))


# fixed ladder of chunk units, coarse to fine, with their length in seconds
_UNITS = [("week", 604800.0), ("day", 86400.0), ("hour", 3600.0), ("minute", 60.0), ("second", 1.0)]


def auto_chunk(df: DataFrame, keys: Sequence[str], ts_col: str = "ts", target_rows: int = 1_000_000) -> Column:
    """Chunk column sized to the densest series: one aggregate (rows and time
    span per key, then the maximum rate) picks the coarsest unit whose average
    chunk of the densest key holds at most ``target_rows`` rows.  A key with a
    third of all rows gets many small chunks; sparse data gets few chunk-table
    rows."""
    span = F.unix_micros(F.max(F.col(ts_col)).cast("timestamp")) - F.unix_micros(
        F.min(F.col(ts_col)).cast("timestamp"))
    per_key = df.groupBy(*keys).agg((F.count(F.lit(1)) / F.greatest(span / 1e6, F.lit(1.0))).alias("rate"))
    rate = per_key.agg(F.max("rate")).first()[0] or 0.0      # rows per second of the densest key
    for unit, secs in _UNITS:
        if rate * secs <= target_rows:
            return default_chunk(ts_col, unit)
    return default_chunk(ts_col, "second")


def sorted_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys`` and ``order``, stored once, with
    ``_chunk`` (number of the run) and ``_rn`` (place in the run, from 1).

    Spark cuts the ranges from a sample of the order columns themselves, so runs are
    about equally long whatever the density in time: a burst within one second, or one
    key with most rows, is cut like anything else.  The table is written before it is
    used, because every evaluation of the plan would draw other borders."""
    by = [*_cols(keys), *_cols(order)]
    place = F.monotonically_increasing_id()
    return stored(df.repartitionByRange(*by).sortWithinPartitions(*by)
                  .select("*", F.shiftright(place, 33).cast("int").alias(CHUNK),
                          (place.bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(RN)), "runs")


def _fill_frames(v: str, w) -> list[Column]:
    """Last / next observed value of ``v`` with its place, inside the chunk."""
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    nn = F.col(v).isNotNull()
    return [F.last(F.when(nn, F.col(v)), True).over(up).alias(f"_lv_{v}"),
            F.last(F.when(nn, F.col(RN)), True).over(up).alias(f"_lr_{v}"),
            F.first(F.when(nn, F.col(v)), True).over(down).alias(f"_nv_{v}"),
            F.first(F.when(nn, F.col(RN)), True).over(down).alias(f"_nr_{v}")]


def index_series(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chunk: Column | None = None,
                 carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Add ``_chunk, _rn, _cnt, _off, _len, _pos`` (0-based position in the
    series) and, per column ``v`` in ``carry``: ``_prev_v``/``_prevpos_v`` (last
    non-null at or before the row) and ``_next_v``/``_nextpos_v`` (first
    non-null at or after it).  Returns (rows, chunk_table).

    Without ``chunk`` the chunks are the ranges of :func:`sorted_runs`; a given
    ``chunk`` must be monotone in the order.  Null keys form a series of their own."""
    keys = list(keys)
    w = Window.partitionBy(*keys, CHUNK).orderBy(RN)
    if chunk is None:
        d = sorted_runs(df, keys, order)
    else:
        # the explicit repartition on exactly (keys, chunk) matters: a window accepts any input
        # already hash-partitioned on a *subset* of its keys (e.g. by key alone after a per-key
        # aggregate), which would put a hot key back in one task
        first = Window.partitionBy(*keys, CHUNK).orderBy(*_cols(order))
        d = stored(df.withColumn(CHUNK, chunk).repartition(*keys, CHUNK)
                   .select("*", F.row_number().over(first).cast("long").alias(RN)), "runs")
    # one row per (key, chunk): rows, first place, and the first / last observed value with its place
    seen = []
    for v in carry:
        vr = F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("v"), F.col(RN).alias("r")))
        at = F.when(F.col(v).isNotNull(), F.col(RN))
        seen += [F.max_by(vr, at).alias(f"_cl_{v}"), F.min_by(vr, at).alias(f"_cf_{v}")]
    ct = d.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias(CNT), F.min(RN).alias("_from"), *seen)
    wk = Window.partitionBy(*keys).orderBy(CHUNK)
    before = F.coalesce(F.sum(CNT).over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    ct = ct.select("*", (before - F.col("_from") + 1).alias(OFF),
                   F.sum(CNT).over(Window.partitionBy(*keys)).cast("long").alias(LEN))
    carried = []
    for v in carry:
        gl = F.struct(F.col(f"_cl_{v}.v").alias("v"), (F.col(OFF) + F.col(f"_cl_{v}.r") - 1).alias("p"))
        gf = F.struct(F.col(f"_cf_{v}.v").alias("v"), (F.col(OFF) + F.col(f"_cf_{v}.r") - 1).alias("p"))
        ct = (ct.withColumn(f"_gl_{v}", F.when(F.col(f"_cl_{v}").isNotNull(), gl))
              .withColumn(f"_gf_{v}", F.when(F.col(f"_cf_{v}").isNotNull(), gf)))
        ct = (ct.withColumn(f"_cp_{v}", F.last(f"_gl_{v}", True).over(wk.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn(f"_cn_{v}", F.first(f"_gf_{v}", True).over(wk.rowsBetween(1, Window.unboundedFollowing))))
        carried += [f"_cp_{v}", f"_cn_{v}"]
    chunks = stored(ct.select(*keys, CHUNK, CNT, OFF, LEN, *carried), "chunks")
    if carry:
        d = d.repartition(*keys, CHUNK).select("*", *[e for v in carry for e in _fill_frames(v, w)])
    rows = _with_chunks(d, chunks, keys)
    rows = rows.withColumn(POS, (F.col(OFF) + F.col(RN) - 1).cast("long"))
    for v in carry:
        loc_p = F.col(OFF) + F.col(f"_lr_{v}") - 1
        nxt_p = F.col(OFF) + F.col(f"_nr_{v}") - 1
        rows = (rows.withColumn(f"_prev_{v}", F.coalesce(F.col(f"_lv_{v}"), F.col(f"_cp_{v}.v")))
                .withColumn(f"_prevpos_{v}", F.when(F.col(f"_lv_{v}").isNotNull(), loc_p)
                            .otherwise(F.col(f"_cp_{v}.p")))
                .withColumn(f"_next_{v}", F.coalesce(F.col(f"_nv_{v}"), F.col(f"_cn_{v}.v")))
                .withColumn(f"_nextpos_{v}", F.when(F.col(f"_nv_{v}").isNotNull(), nxt_p)
                            .otherwise(F.col(f"_cn_{v}.p")))
                .drop(f"_lv_{v}", f"_lr_{v}", f"_nv_{v}", f"_nr_{v}", f"_cp_{v}", f"_cn_{v}"))
    return rows, chunks


def _with_chunks(rows: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on (keys, chunk), null keys included."""
    right = chunks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(CHUNK).alias("_k_chunk"),
                          *[c for c in chunks.columns if c not in keys and c != CHUNK])
    on = F.col(CHUNK) == F.col("_k_chunk")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(right, on).drop("_k_chunk", *[f"_k_{k}" for k in keys])


def drop_index(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in INDEX_COLS or c.startswith(("_prev_", "_prevpos_",
                                                                                 "_next_", "_nextpos_"))])


def with_neighbours(rows: DataFrame, chunks: DataFrame | None, keys: Sequence[str], cols: Sequence[str],
                    before: int = 0, after: int = 0, bucket: int | None = None) -> DataFrame:
    """Rows re-bucketed by position with up to ``before`` preceding and
    ``after`` following rows copied into each bucket (``_borrowed``).

    Output: keys, _chunk (= position bucket), _pos, _len, cols, _borrowed.
    ``rows`` must carry ``_pos`` and ``_len`` (see :func:`index_series`)."""
    b = max(int(bucket or BUCKET), 2 * max(before, after))  # a bucket is wider than the frame reaches
    own = F.floor(F.col(POS) / b)
    off = F.col(POS) % b
    copies = [F.struct(own.alias("c"), F.lit(False).alias("f"))]
    if before:
        copies.append(F.when(off >= b - before, F.struct((own + 1).alias("c"), F.lit(True).alias("f"))))
    if after:
        copies.append(F.when((off < after) & (own > 0), F.struct((own - 1).alias("c"), F.lit(True).alias("f"))))
    x = rows.select(*keys, POS, LEN, *cols, F.explode(F.filter(F.array(*copies), lambda e: e.isNotNull())).alias("_e"))
    x = x.select(*keys, F.col("_e.c").alias(CHUNK), POS, LEN, *cols, F.col("_e.f").alias(BORROWED))
    # hash on exactly (keys, bucket): see index_series on subset partitioning
    return x.repartition(*keys, CHUNK)
