"""Result files: run records, result tables, leaderboard store (S5-S7,
S12-S18).  Writers put files under a run folder inside the shared
``spark.checkpoint.dir``; readers take any path or glob.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .workbook import read_workbooks


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def write_records(records: DataFrame, root: str, settings: Sequence[str] = ()) -> str:
    """Write one result record per (dataset, model) as ``key:value``
    lines: the settings, two blank lines, then the metrics.  ``records`` is
    long (dataset, model, metric, value); ``settings`` columns, if present,
    are written first.  Layout: root/dataset=<d>/model=<m>/part-*.txt."""
    lines = records.select("dataset", "model", F.lit(2).alias("sec"), F.col("metric").alias("k"),
                           F.col("value").cast("string").alias("v"))
    if settings:
        s = records.select("dataset", "model", *settings).distinct()
        st = s.select("dataset", "model", F.explode(F.array(*[
            F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in settings])).alias("e"))
        lines = lines.unionByName(st.select("dataset", "model", F.lit(0).alias("sec"), "e.k", "e.v"))
    blank = records.select("dataset", "model").distinct().select(
        "dataset", "model", F.lit(1).alias("sec"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("k"),
        F.lit(None).cast("string").alias("v"))
    lines = lines.unionByName(blank)
    text = F.when(F.col("sec") == 1, F.lit("")).otherwise(F.concat_ws(":", "k", "v"))
    # a record is one value of several lines: a writer that sorts rows by their folder keeps no order of lines
    whole = F.array_sort(F.collect_list(F.struct("sec", "k", text.alias("line"))))
    (lines.groupBy("dataset", "model").agg(F.array_join(F.transform(whole, lambda x: x.line), "\n").alias("value"))
     .repartition("dataset", "model").write.mode("overwrite").partitionBy("dataset", "model").text(root))
    return root


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Read result records: split each line at the first ':', key trimmed
    and lower-cased, keep values that parse as numbers; the last line of a
    key in a file wins.  Data set and model come from the path
    (``.../<dataset>/<model>/<file>`` or ``dataset=<d>/model=<m>``)."""
    raw = (spark.read.option("recursiveFileLookup", "true").text(path)
           .select("value", F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_modification_time").alias("modified"),
                   # place in the file: start of its split, then the order within the split
                   F.struct(F.col("_metadata.file_block_start").alias("split"),
                            F.monotonically_increasing_id().alias("n")).alias("line")))
    kv = raw.where(F.instr("value", ":") > 0).select(
        "file", "modified", "line",
        F.lower(F.trim(F.split("value", ":", 2)[0])).alias("metric"),
        F.expr("try_cast(trim(split(value, ':', 2)[1]) AS DOUBLE)").alias("value"))
    kv = kv.where(F.col("value").isNotNull())
    last = kv.groupBy("file", "metric").agg(F.max_by(F.struct("value", "modified"), F.col("line")).alias("v"))
    parts = F.split(F.col("file"), "/")
    d = F.url_decode(F.element_at(parts, -3))
    m = F.url_decode(F.element_at(parts, -2))
    strip = lambda c, p: F.regexp_replace(c, f"^{p}=", "")
    return last.select(strip(d, "dataset").alias("dataset"), strip(m, "model").alias("model"), "metric",
                       F.col("v.value").alias("value"), F.col("v.modified").alias("modified"), "file")


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Trim column names; listed columns become DOUBLE, bad text -> NULL."""
    d = df.toDF(*[c.strip() for c in df.columns])
    proj = [F.expr(f"try_cast(trim(cast(`{c}` AS STRING)) AS DOUBLE)").alias(c) if c in cols else F.col(f"`{c}`")
            for c in d.columns]
    return d.select(*proj)


def read_result_tables(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read many result tables named ``<code>_*.<ext>``, tag each row with
    the zero-padded data set code parsed from the file name (the catalog name
    is joined by :func:`catalog.tag_with_catalog`).  Workbooks (``fmt='xlsx'``)
    give the same rows as their CSV exports, all columns as texts."""
    if fmt == "xlsx":
        r = read_workbooks(spark, path, file_col="_file")
    elif fmt == "csv":
        r = spark.read.option("header", "true").csv(path).withColumn("_file", F.col("_metadata.file_path"))
    else:
        r = spark.read.format(fmt).load(path).withColumn("_file", F.col("_metadata.file_path"))
    code = F.regexp_extract(F.col("_file"), r".*/([0-9]+)_[^/]*", 1)
    return r.withColumn("dataset_code", F.lpad(code, 2, "0")).drop("_file")


LEADERBOARD_SCHEMA = "map<string, map<string, struct<timestamp: string, results: map<string, double>>>>"


def read_leaderboard(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read the nested leaderboard JSON {dataset: {model: {timestamp,
    results}}} into flat rows (dataset, model, timestamp, metric, value).

    ``multi_line=True`` reads pretty-printed single-document files (the
    reference's store: one JSON file, parsed by one task per file); the
    default reads JSON lines as written by :func:`write_leaderboard`, split
    across tasks like any text input."""
    txt = spark.read.text(path, wholetext=multi_line)
    nested = txt.select(F.from_json("value", LEADERBOARD_SCHEMA).alias("m")).where(F.col("m").isNotNull())
    n = (nested.select(F.explode("m").alias("dataset", "models"))
         .select("dataset", F.explode("models").alias("model", "entry"))
         .select("dataset", "model", F.col("entry.timestamp").alias("timestamp"),
                 F.explode("entry.results").alias("metric", "value")))
    return n


def write_leaderboard(board: DataFrame, root: str) -> str:
    """Write the board as JSON lines, one {dataset: {model: entry}} object
    per (dataset, model), into a new folder (callers swap the path once the
    write succeeded; plain files give no transaction)."""
    entry = board.groupBy("dataset", "model", "timestamp").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("results"))
    obj = entry.select(F.to_json(F.create_map(F.col("dataset"), F.create_map(
        F.col("model"), F.struct("timestamp", "results")))).alias("value"))
    obj.write.mode("overwrite").text(root)
    return root


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Run history JSON {dataset, model, <metric>: [v per epoch], ...} ->
    rows (dataset, model, metric, epoch, value) via posexplode."""
    h = spark.read.json(path)
    arrays = [c for c, t in h.dtypes if t.startswith("array")]
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("array<double>").alias("vals"))
                             for c in arrays])).alias("e")
    return (h.select("dataset", "model", st)
            .select("dataset", "model", "e.metric", F.posexplode("e.vals").alias("epoch", "value")))
