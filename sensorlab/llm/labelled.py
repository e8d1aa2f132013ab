"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textbytes import crc_id


#: Groups drawn by a branch of the plan each; more are ranked together.
BRANCHES = 100


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text (null:
    empty) leaves ``part`` when divided by ``parts``."""
    return crc_id(id_col) % parts == part


def take_by_hash(rows: DataFrame, group: str, id_col: str, per_group: int) -> DataFrame:
    """At most ``per_group`` rows of every value of ``group``: those whose id
    hashes lowest.  A first cut at a hash level that keeps a little more than
    enough is taken in place, so only about that many rows are ranked."""
    turn = F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col(id_col).cast("string")), 11).cast("double") / float(1 << 53)
    sizes = rows.groupBy(group).count()
    counts = sizes.limit(BRANCHES + 1).collect()
    if len(counts) > BRANCHES:
        level = F.least(F.lit(1.0), F.lit(1.2 * per_group + 50) / F.col("__n"))
        n = sizes.select(F.col(group).alias("__group"), F.col("count").alias("__n"))
        near = rows.join(n, F.col(group).eqNullSafe(F.col("__group"))).where(turn <= level)
        rank = F.row_number().over(Window.partitionBy("__group").orderBy(turn, id_col))
        return near.withColumn("__rank", rank).where(F.col("__rank") <= per_group).select(*rows.columns)
    picked = []
    for value, n in counts:
        level = min(1.0, (1.2 * per_group + 50) / n)
        part = rows.where(F.col(group).eqNullSafe(F.lit(value)) & (turn <= level))
        picked.append(part.orderBy(turn, id_col).limit(per_group))
    return reduce(DataFrame.unionByName, picked) if picked else rows.limit(0)


def training_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, y (0 or 1) and w (labelled rows that a row stands for) of at
    most 2 * ``per_class`` labelled documents that ``learn`` admits.  An id
    with several label rows counts as 1 if any of them is 1; of several
    documents with one id the smallest text is taken; null ids and labels
    teach nothing."""
    known = (labels.select(F.col("doc_id").alias(id_col), F.col(label).cast("int").alias("y"))
             .where(F.col(id_col).isNotNull() & F.col("y").isin(0, 1) & learn).groupBy(id_col).agg(F.max("y").alias("y")))
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    sample = take_by_hash(known, "y", id_col, per_class)  # at most 2 * per_class rows
    weight = F.lit(1.0)
    for y, n in sizes.items():
        weight = F.when(F.col("y") == y, F.lit(n / min(n, per_class))).otherwise(weight)
    found = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(sample), id_col)
    return (found.groupBy(id_col).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))
            .withColumn("w", weight))
