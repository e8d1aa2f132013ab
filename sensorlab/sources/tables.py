"""Readers for the test tables and the stand-in shapes built from them.

The stand-in builders only rename and reshape columns into the schema an
operator expects (FIXTURES.md part B); they do none of the operator's work.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_by_extension(spark: SparkSession, path: str) -> DataFrame:
    """Read a table by file extension (csv with header, parquet, json, xlsx)."""
    low = path.lower()
    if low.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith(".json"):
        return spark.read.json(path)
    if low.endswith(".xlsx"):
        from .workbook import read_workbooks
        return read_workbooks(spark, path, infer=True)
    raise ValueError(f"Unsupported file format: {path}")


# ---- stand-in shapes (FIXTURES.md part B) ---------------------------------

def machine_series(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """events as machine telemetry: machine, ts, event_id, channel, value.

    With ``gaps`` the value is NULL where ``event_id % 7 = 0`` (the fixture
    rule for made gaps; the source columns hold no NULL).
    """
    ev = read_table(spark, sf_dir, "events")
    v = F.col("value")
    if gaps:
        v = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(v)
    return ev.select(F.col("user_id").alias("machine"), "ts", "event_id",
                     F.col("event_type").alias("channel"), v.alias("value"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as labelled samples: sample_id, label, series ARRAY<DOUBLE>."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.col("label"),
                    F.col("embedding").cast("array<double>").alias("series"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as a prediction table: sample_id, y_true, y_pred."""
    lb = read_table(spark, sf_dir, "labels")
    return lb.select(F.col("doc_id").alias("sample_id"), F.col("quality").alias("y_true"),
                     F.col("toxic").alias("y_pred"))


def logits_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as logits (every entry one class), label as truth."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.col("label").alias("y_true"),
                    F.col("embedding").cast("array<double>").alias("logits"))


def sensor_table(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """lineitem as a wide sensor table (sensor_1..4, two text columns, timestamp)."""
    li = read_table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    if nulls:
        q = F.when(F.col("l_partkey") % 11 == 0, F.lit(None).cast("double")).otherwise(q)
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     q.alias("sensor_1"), F.col("l_extendedprice").alias("sensor_2"),
                     F.col("l_discount").alias("sensor_3"), F.col("l_tax").alias("sensor_4"),
                     "l_returnflag", "l_linestatus", F.col("l_shipdate").alias("timestamp"))
