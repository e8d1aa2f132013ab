"""Join many rows to one row per key when some keys hold a large share of them.

A key with more than a thousandth of the rows is hot.  There are fewer than a
thousand such keys whatever the data, so their rows of the small side are
broadcast and the large side never shuffles them; all other keys go through an
ordinary shuffled join in which no key exceeds a thousandth of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than 1 / HOT_SHARE of all rows.
HOT_SHARE = 1000


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int,
                 how: str = "inner") -> DataFrame:
    """``rows`` joined to ``per_key`` on ``key`` (``how``: inner or left).

    ``per_key`` holds a key at most once, with its number of rows of ``rows``
    in ``count``; ``total`` is the number of rows.  Rows with a null key match
    nothing.
    """
    hot = F.broadcast(per_key.where(F.col(count) * HOT_SHARE > F.lit(total)).withColumn("__hot", F.lit(True)))
    cold = per_key.where(F.col(count) * HOT_SHARE <= F.lit(total))
    new = [c for c in per_key.columns if c != key]
    a = rows.join(hot, key, "left")
    near = a.where(F.col("__hot")).select(*rows.columns, *new)
    far = a.where(F.col("__hot").isNull()).select(*rows.columns)
    return near.unionByName(far.join(cold, key, how).select(*rows.columns, *new))
