"""Model comparison and leaderboards.

Result tables are (dataset, model, metric, value) rows, or one wide row per
model.  Everything is an aggregate, a pivot over a known value list, or a
window ranking inside a (dataset, metric) group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# lower is better for these metric names; everything else: higher is better
LOWER_IS_BETTER = {"ece", "nll", "brier", "loss", "time cost", "time_cost", "parameters",
                   "mae", "mse", "rmse", "mape", "mspe", "rse", "smape", "mase", "owa", "avg_rank"}


def descending(metric: str) -> bool:
    return metric.lower() not in LOWER_IS_BETTER


def metrics_wide(long: DataFrame, metrics: Sequence[str], index: str = "model", column: str = "metric",
                 value: str = "value") -> DataFrame:
    """Long (index, metric, value) -> one row per index with a column per
    metric (mean where a pair repeats).  The metric list is given, so the
    pivot needs no extra pass to discover values."""
    return long.groupBy(index).pivot(column, list(metrics)).agg(F.avg(value))


def rank_models(wide: DataFrame, metrics: Sequence[str], index: str = "model") -> DataFrame:
    """Per metric, average-tie rank (1 = best, higher is better) truncated to
    an integer, then the mean of the ranks; ordered by it.  The ranking
    windows run over the model table (one row per model)."""
    out = wide
    for m in metrics:
        w = Window.orderBy(F.col(m).desc())
        ties = F.count(F.lit(1)).over(Window.partitionBy(m))
        out = out.withColumn(f"{m}_rank", F.floor(F.rank().over(w) + (ties - 1) / 2).cast("int"))
    avg = sum((F.col(f"{m}_rank") for m in metrics), F.lit(0)) / len(metrics)
    return out.withColumn("avg_rank", avg.cast("double")).orderBy("avg_rank", index)


def best_model(wide: DataFrame, metric: str, index: str = "model") -> DataFrame:
    """The model with the highest ``metric``; ties go to the smallest model
    name (the reference keeps the first inserted)."""
    f = wide.where(F.col(metric).isNotNull())
    return f.agg(F.min_by(F.col(index), F.struct(-F.col(metric), F.col(index))).alias(index),
                 F.max(metric).alias(metric))


def sorted_by(wide: DataFrame, metric: str, index: str = "model") -> DataFrame:
    """Models sorted by ``metric`` in its better-first direction."""
    c = F.col(metric).desc() if descending(metric) else F.col(metric).asc()
    return wide.orderBy(c, F.col(index))


def benchmark_summary(wide: DataFrame, metrics: Sequence[str] = ("accuracy", "precision", "recall", "f1"),
                      index: str = "model", by: str = "f1") -> DataFrame:
    """Report rows: the best model by ``by`` with its metrics, then one
    table row per model ordered by ``by`` descending, numbers as %.4f.
    Returns (section, pos, line)."""
    best = wide.orderBy(F.col(by).desc(), F.col(index)).limit(1)
    head = best.select(F.lit("best").alias("section"), F.lit(0).alias("pos"),
                       F.concat(F.lit("**Model:** "), F.col(index)).alias("line"))
    mlines = best.select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("pos"),
                 F.format_string(f"- {m.capitalize()}: %.4f", F.col(m)).alias("line"))
        for i, m in enumerate(metrics)])).alias("e")).select(F.lit("best").alias("section"), "e.pos", "e.line")
    w = Window.orderBy(F.col(by).desc(), F.col(index))
    fmt = "| %s | " + " | ".join(["%.4f"] * len(metrics)) + " |"
    rows = wide.select(F.lit("table").alias("section"), F.row_number().over(w).alias("pos"),
                       F.format_string(fmt, F.col(index), *[F.col(m) for m in metrics]).alias("line"))
    return head.unionByName(mlines).unionByName(rows)


def pivot_mean(results: DataFrame, metric: str, datasets: Sequence[str], index: str = "model",
               column: str = "dataset", digits: int = 4) -> DataFrame:
    """Mean of ``metric`` per model x data set, rounded half-even."""
    return (results.where(F.col("metric") == metric).groupBy(index).pivot(column, list(datasets))
            .agg(F.bround(F.avg("value"), digits)))


def metric_leaderboard(results: DataFrame, metric: str, index: str = "model", digits: int = 4) -> DataFrame:
    """Per model mean, std (ddof 1) and count of ``metric``, rounded,
    sorted best first (direction per metric, not always descending)."""
    agg = (results.where((F.col("metric") == metric) & F.col("value").isNotNull()).groupBy(index)
           .agg(F.bround(F.avg("value"), digits).alias("mean"),
                F.bround(F.stddev_samp("value"), digits).alias("std"),
                F.count("value").alias("n_datasets")))
    return agg.orderBy(F.col("mean").desc() if descending(metric) else F.col("mean").asc(), F.col(index))


def dataset_leaderboard(board: DataFrame, metric: str, index: str = "model") -> DataFrame:
    """Per data set, models that report ``metric``, ranked 1..n best
    first (direction per metric), with a best flag."""
    f = board.where(F.col("metric") == metric)
    order = F.col("value").desc() if descending(metric) else F.col("value").asc()
    w = Window.partitionBy("dataset").orderBy(order, F.col(index))
    r = f.withColumn("rank", F.row_number().over(w))
    return r.withColumn("is_best", F.col("rank") == 1)


def upsert(board: DataFrame, new: DataFrame, keys: Sequence[str] = ("dataset", "model"),
           ts: str = "timestamp") -> DataFrame:
    """Union of the stored and new entries.  An entry is all metric
    rows of one key and time stamp; per key the newest entry replaces the
    others as a whole (the new one on equal time stamps)."""
    u = (board.withColumn("_age", F.struct(F.col(ts).alias("ts"), F.lit(0).alias("new")))
         .unionByName(new.withColumn("_age", F.struct(F.col(ts).alias("ts"), F.lit(1).alias("new"))),
                      allowMissingColumns=True))
    newest = u.groupBy(*keys).agg(F.max("_age").alias("_top"))
    return u.join(newest, list(keys)).where(F.col("_age").eqNullSafe(F.col("_top"))).drop("_age", "_top")


def class_distribution(samples: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """Samples per class, zero for classes in the class list without
    samples (class list right-joined)."""
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return (classes.join(counts, label, "left")
            .select(label, F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def dataset_profile(samples: DataFrame, split: str = "split", label: str = "label",
                    series: str = "series") -> DataFrame:
    """Per split counts, max length and classes; then the maximum
    length over all splits.  Where a step holds an array of channel values,
    ``n_channels`` is the largest number of them."""
    nested = samples.schema[series].dataType.elementType.simpleString().startswith("array")
    wide = [F.max(F.array_max(F.transform(series, lambda step: F.size(step)))).alias("n_channels")] if nested else []
    per = samples.groupBy(split).agg(F.count(F.lit(1)).alias("n_samples"),
                                     F.max(F.size(series)).alias("max_len"),
                                     F.countDistinct(label).alias("n_classes"), *wide)
    return per.withColumn("max_len_all", per.agg(F.max("max_len")).scalar())


def latest_records(records: DataFrame, keys: Sequence[str] = ("dataset", "model"),
                   ts: str = "modified") -> DataFrame:
    """For each (data set, model) keep the metrics of the most recently
    modified result file (of files with one time stamp, the last by name)."""
    latest = records.groupBy(*keys).agg(F.max(F.struct(ts, "file")).alias("_top"))
    return records.join(latest, list(keys)).where(F.struct(ts, "file") == F.col("_top")).drop("_top")
