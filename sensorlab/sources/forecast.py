"""Forecast collections (S8-S10): info table, values, per-group meta."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values (reference meta table): group, horizon, frequency, history size
META = [("Yearly", 6, 1, 1.5), ("Quarterly", 8, 4, 1.5), ("Monthly", 18, 12, 1.5),
        ("Weekly", 13, 1, 10.0), ("Daily", 14, 1, 10.0), ("Hourly", 48, 24, 10.0)]


def meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(META, "group string, horizon int, frequency int, history_size double")


def with_meta(series: DataFrame, group: str = "group") -> DataFrame:
    """Attach horizon, frequency and history size by group (6-row table,
    broadcast)."""
    m = F.broadcast(meta(series.sparkSession).withColumnRenamed("group", group))
    return series.join(m, group, "left")


def load_collection(spark: SparkSession, info_path: str, values_path: str) -> DataFrame:
    """Info CSV (id, group, frequency, horizon) joined by id to long values
    (id, step, value) stored as parquet.  Long values keep every series
    splittable; arrays per series are built only for bounded windows."""
    info = spark.read.option("header", True).csv(info_path).select(
        F.col("id").cast("long").alias("id"), "group", F.col("frequency").cast("int").alias("frequency"),
        F.col("horizon").cast("int").alias("horizon"))
    vals = spark.read.parquet(values_path)
    return vals.join(info, "id", "left")


def read_forecast_csv(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """Forecast CSV (id, V1..Vk) -> (id, values ARRAY<DOUBLE>) with the
    trailing missing values of each row removed (inner gaps kept)."""
    r = spark.read.option("header", True).csv(path)
    vcols = [c for c in r.columns if c != id_col]
    arr = F.array(*[F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in vcols])
    # index of the last present value; everything after it is the NaN tail
    last = F.array_max(F.transform(arr, lambda x, i: F.when(x.isNotNull() & ~F.isnan(x), i)))
    return r.select(F.col(id_col), F.when(last.isNull(), F.array().cast("array<double>"))
                    .otherwise(F.slice(arr, 1, last + 1)).alias("values"))
