"""Which rows may belong to a set of keys, decided without moving the rows.

The set's hashes are marked in a bitmap of fixed size, the same for every size
of the data.  Rows whose bit is not set are not in the set; the few others go
through an exact join.  A set that fills the bitmap lets more rows through, and
the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: 64-bit words of the bitmap: 256 KB, 2^21 bits, sent to every task and held by the driver in its plans.
WORDS = 1 << 15


def _word(h: Column) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int")


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def bitmap(hashes: DataFrame, col: str = "h") -> DataFrame:
    """Stored table of one row: ``bits``, array of the bitmap's words, of the longs in ``col``."""
    h = F.col(col)
    marked = hashes.groupBy(_word(h).alias("w")).agg(F.bit_or(_bit(h)).alias("b"))
    every = hashes.sparkSession.range(WORDS).select(F.col("id").cast("int").alias("w")).join(marked, "w", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("x"))
    return stored(row.select(F.transform("x", lambda x: x.b).alias("bits")), "bitmap")


def may_contain(bits: DataFrame, h: Column) -> Column:
    """Whether a hash's bit is set in a bitmap of :func:`bitmap`; null: no."""
    return F.coalesce(F.get(bits.select("bits").scalar(), _word(h)).bitwiseAND(_bit(h)) != 0, F.lit(False))
