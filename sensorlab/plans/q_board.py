"""Leaderboards, result files and the catalog.

Stand-in (FIXTURES.md B): orders rows are run results with
dataset = o_orderstatus, model = o_orderpriority and metric values taken
from numeric order columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.random import sql_uniform
from ..operators import leaderboard as L
from ..operators.features import split_column
from ..sources import catalog as CAT
from ..sources.workbook import write_workbooks
from ..sources import results as RS
from ..sources.tables import read_table, samples
from .registry import register

METRICS4 = ["accuracy", "precision", "recall", "f1"]

# long results: one row per (order, metric)
LONG_SQL = """
SELECT o_orderstatus AS dataset, o_orderpriority AS model, 'accuracy' AS metric, o_totalprice AS value FROM orders
UNION ALL SELECT o_orderstatus, o_orderpriority, 'precision', o_custkey::DOUBLE FROM orders
UNION ALL SELECT o_orderstatus, o_orderpriority, 'recall', (o_orderkey % 97)::DOUBLE FROM orders
UNION ALL SELECT o_orderstatus, o_orderpriority, 'f1', day(o_orderdate)::DOUBLE FROM orders
UNION ALL SELECT o_orderstatus, o_orderpriority, 'ece', (o_custkey % 13)::DOUBLE FROM orders"""


def results_long(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    vals = {"accuracy": F.col("o_totalprice"), "precision": F.col("o_custkey").cast("double"),
            "recall": (F.col("o_orderkey") % 97).cast("double"),
            "f1": F.dayofmonth("o_orderdate").cast("double"), "ece": (F.col("o_custkey") % 13).cast("double")}
    return o.select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("model"),
                    F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value"))
                                        for k, v in vals.items()])).alias("e")).select("dataset", "model", "e.*")


WIDE_SQL = f"""
SELECT model, avg(value) FILTER (WHERE metric = 'accuracy') AS accuracy,
  avg(value) FILTER (WHERE metric = 'precision') AS precision,
  avg(value) FILTER (WHERE metric = 'recall') AS recall,
  avg(value) FILTER (WHERE metric = 'f1') AS f1 FROM ({LONG_SQL}) AS l GROUP BY model"""

RANK_SQL = f"""
WITH w AS ({WIDE_SQL}) SELECT *, """ + ", ".join(
    f"floor(rank() OVER (ORDER BY {m} DESC) + (count(*) OVER (PARTITION BY {m}) - 1) / 2)::INTEGER AS {m}_rank"
    for m in METRICS4) + " FROM w"
RANK_FULL_SQL = f"WITH r AS ({RANK_SQL}) SELECT *, (" + " + ".join(f"{m}_rank" for m in METRICS4) + \
    ") / 4.0 AS avg_rank FROM r"


def wide(spark, sf_dir):
    return L.metrics_wide(results_long(spark, sf_dir), METRICS4)


@register("b5_metrics_wide", WIDE_SQL, dbl=METRICS4)
def q_b5(spark, sf_dir):
    """B5 long results pivoted to one row per model."""
    return wide(spark, sf_dir)


@register("b6_rank_models", RANK_FULL_SQL, dbl=METRICS4 + ["avg_rank"])
def q_b6(spark, sf_dir):
    """B6 average-tie ranks per metric and mean rank."""
    return L.rank_models(wide(spark, sf_dir), METRICS4)


@register("b7_best_model", f"""
SELECT arg_min(model, (-f1, model)) AS model, max(f1) AS f1 FROM ({WIDE_SQL}) AS w""", dbl=["f1"])
def q_b7(spark, sf_dir):
    """B7 best model by f1."""
    return L.best_model(wide(spark, sf_dir), "f1")


@register("b8_sorted_by_metric", WIDE_SQL, dbl=METRICS4)
def q_b8(spark, sf_dir):
    """B8 models sorted by accuracy, best first."""
    return L.sorted_by(wide(spark, sf_dir), "accuracy")


@register("b9_benchmark_summary", f"""
WITH w AS ({WIDE_SQL}), b AS (SELECT * FROM w ORDER BY f1 DESC, model LIMIT 1)
SELECT 'best' AS section, 0 AS pos, '**Model:** ' || model AS line FROM b
UNION ALL SELECT 'best', 1, printf('- Accuracy: %.4f', accuracy) FROM b
UNION ALL SELECT 'best', 2, printf('- Precision: %.4f', precision) FROM b
UNION ALL SELECT 'best', 3, printf('- Recall: %.4f', recall) FROM b
UNION ALL SELECT 'best', 4, printf('- F1: %.4f', f1) FROM b
UNION ALL SELECT 'table', row_number() OVER (ORDER BY f1 DESC, model),
  printf('| %s | %.4f | %.4f | %.4f | %.4f |', model, accuracy, precision, recall, f1) FROM w""")
def q_b9(spark, sf_dir):
    """B9 benchmark summary lines (best model block, table by f1)."""
    return L.benchmark_summary(wide(spark, sf_dir)).select(
        "section", F.col("pos").cast("bigint").alias("pos"), "line")


@register("b10_pivot_mean", f"""
SELECT model, round_even(avg(value) FILTER (WHERE dataset = 'F'), 4) AS "F",
  round_even(avg(value) FILTER (WHERE dataset = 'O'), 4) AS "O",
  round_even(avg(value) FILTER (WHERE dataset = 'P'), 4) AS "P"
FROM ({LONG_SQL}) AS l WHERE metric = 'accuracy' GROUP BY model""", dbl=["F", "O", "P"], digits=4)
def q_b10(spark, sf_dir):
    """B10 mean accuracy per model x data set, rounded to 4."""
    return L.pivot_mean(results_long(spark, sf_dir), "accuracy", ["F", "O", "P"])


for _m in ("accuracy", "ece"):
    def _mk(metric):
        def q(spark, sf_dir):
            return L.metric_leaderboard(results_long(spark, sf_dir), metric)
        q.__doc__ = f"B11 leaderboard of {metric}: mean, std, count per model."
        return q
    register(f"b11_leaderboard_{_m}", f"""
SELECT model, round_even(avg(value), 4) AS mean, round_even(stddev_samp(value), 4) AS std,
  count(value) AS n_datasets FROM ({LONG_SQL}) AS l WHERE metric = '{_m}' AND value IS NOT NULL GROUP BY model""",
             dbl=["mean", "std"], digits=4)(_mk(_m))

BOARD_SQL = f"""SELECT dataset, model, metric, avg(value) AS value, '2024-01-01 00:00:00' AS timestamp
FROM ({LONG_SQL}) AS l GROUP BY dataset, model, metric"""


def board(spark, sf_dir):
    return (results_long(spark, sf_dir).groupBy("dataset", "model", "metric")
            .agg(F.avg("value").alias("value")).withColumn("timestamp", F.lit("2024-01-01 00:00:00")))


@register("b12_dataset_leaderboard", f"""
WITH b AS ({BOARD_SQL})
SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY value DESC, model) AS rank,
  row_number() OVER (PARTITION BY dataset ORDER BY value DESC, model) = 1 AS is_best FROM b WHERE metric = 'accuracy'""",
          dbl=["value"])
def q_b12(spark, sf_dir):
    """B12 per data set ranking of models by accuracy."""
    return L.dataset_leaderboard(board(spark, sf_dir), "accuracy").withColumn("rank", F.col("rank").cast("bigint"))


NEW_SQL = f"""SELECT dataset, model, metric, value * 2 AS value, '2024-06-01 00:00:00' AS timestamp
FROM ({BOARD_SQL}) AS b WHERE model = '1-URGENT'"""


@register("b13_upsert_result", f"""
WITH b AS ({BOARD_SQL}), n AS ({NEW_SQL})
SELECT * FROM n WHERE metric <> 'f1' UNION ALL SELECT * FROM b WHERE model <> '1-URGENT'""", dbl=["value"])
def q_b13(spark, sf_dir):
    """B13 add newer results, without f1, for one model; its newest entry wins as a whole."""
    b = board(spark, sf_dir)
    new = (b.where(F.col("model") == "1-URGENT").withColumn("value", F.col("value") * 2)
           .withColumn("timestamp", F.lit("2024-06-01 00:00:00")).where("metric <> 'f1'"))
    return L.upsert(b, new)


@register("b14_class_distribution", """
SELECT c.label, count(e.vec_id) AS count FROM range(12) AS c(label)
LEFT JOIN embeddings e ON e.label = c.label GROUP BY c.label""")
def q_b14(spark, sf_dir):
    """B14 samples per class over a 12-class list (absent classes count 0)."""
    classes = spark.range(12).select(F.col("id").cast("int").alias("label"))
    return L.class_distribution(samples(spark, sf_dir), classes).select(
        F.col("label").cast("bigint").alias("label"), "count")


_SPLIT_E = f"CASE WHEN {sql_uniform(42, 'vec_id')} < 0.2 THEN 'test' ELSE 'train' END"


@register("b15_dataset_profile", f"""
WITH s AS (SELECT {_SPLIT_E} AS split, label, len(embedding) AS n FROM embeddings),
p AS (SELECT split, count(*) AS n_samples, max(n)::INTEGER AS max_len, count(DISTINCT label) AS n_classes FROM s GROUP BY split)
SELECT *, (SELECT max(max_len) FROM p) AS max_len_all FROM p""")
def q_b15(spark, sf_dir):
    """B15 per split sample count, max length, classes."""
    s = samples(spark, sf_dir).withColumn("split", split_column(["sample_id"], 0.2, 42))
    return L.dataset_profile(s)


@register("b15_channel_profile", f"""
WITH s AS (SELECT {_SPLIT_E} AS split, label, len(embedding) // 2 AS n FROM embeddings),
p AS (SELECT split, count(*) AS n_samples, max(n)::INTEGER AS max_len, count(DISTINCT label) AS n_classes, 2 AS n_channels
  FROM s GROUP BY split)
SELECT *, (SELECT max(max_len) FROM p) AS max_len_all FROM p""")
def q_b15c(spark, sf_dir):
    """B15 of samples with two channels per step (the series cut into steps of two values)."""
    s = samples(spark, sf_dir).withColumn("split", split_column(["sample_id"], 0.2, 42))
    steps = F.sequence(F.lit(0), F.floor(F.size("series") / 2).cast("int") - 1)
    return L.dataset_profile(s.withColumn("series", F.transform(steps, lambda i: F.slice("series", 2 * i + 1, 2))))


# ---- result files ---------------------------------------------------------------

REC_SQL = f"""SELECT dataset, model, metric, avg(value) AS value FROM ({LONG_SQL}) AS l GROUP BY dataset, model, metric"""


def _records(spark, sf_dir):
    return (results_long(spark, sf_dir).groupBy("dataset", "model", "metric").agg(F.avg("value").alias("value"))
            .withColumn("seq_len", F.lit(64)).withColumn("model_name", F.col("model")))


@register("s5_read_result_records", f"""
SELECT dataset, model, metric, value FROM ({REC_SQL}) AS r
UNION ALL SELECT DISTINCT o_orderstatus, o_orderpriority, 'seq_len', 64.0 FROM orders""", dbl=["value"])
def q_s5(spark, sf_dir):
    """S15 write key:value result records per (data set, model), then S5 read
    them back (numeric values, last one wins)."""
    root = RS.write_records(_records(spark, sf_dir), RS.scratch_path(spark, "records"), ["seq_len", "model_name"])
    return RS.read_records(spark, root).select("dataset", "model", "metric", "value")


@register("b16_latest_records", f"""
SELECT dataset, model, metric, value * 2 AS value FROM ({REC_SQL}) AS r""", dbl=["value"])
def q_b16(spark, sf_dir):
    """B16 two runs written at different times; the newer file wins per
    (data set, model)."""
    base = RS.scratch_path(spark, "runs")
    rec = _records(spark, sf_dir).drop("seq_len", "model_name")
    RS.write_records(rec, f"{base}/run1")
    RS.write_records(rec.withColumn("value", F.col("value") * 2), f"{base}/run2")
    r = RS.read_records(spark, base)
    return L.latest_records(r).select("dataset", "model", "metric", "value")


_CODE_MAP = {"F": "1", "O": "16", "P": "99"}


_S6_SQL = f"""
WITH w AS ({WIDE_SQL.replace('GROUP BY model', 'GROUP BY dataset, model').replace('SELECT model,', 'SELECT dataset, model,')}),
c AS (SELECT * FROM (VALUES ('F', '01', 'Paderborn'), ('O', '16', 'CQU Gearbox'), ('P', '99', 'Unknown (99)'))
      AS t(dataset, dataset_code, dataset_name))
SELECT c.dataset_code, c.dataset_name, w.model, w.accuracy, w.precision, w.recall, w.f1 FROM w JOIN c USING (dataset)"""


@register("s6_read_result_tables", _S6_SQL,
          dbl=METRICS4)
def q_s6(spark, sf_dir):
    """S6 per data set result tables written as <code>_results CSV, read back,
    tagged with the padded code and catalog name, numbers coerced (S7)."""
    long = results_long(spark, sf_dir)
    w = long.groupBy("dataset", "model").pivot("metric", METRICS4).agg(F.avg("value"))
    base = RS.scratch_path(spark, "tables")
    for ds, code in _CODE_MAP.items():
        w.where(F.col("dataset") == ds).drop("dataset").write.mode("overwrite").option("header", True) \
            .csv(f"{base}/{code}_results")
    r = RS.read_result_tables(spark, f"{base}/*_results", fmt="csv")
    r = RS.coerce_numeric(r, METRICS4)
    return CAT.tag_with_catalog(r).select("dataset_code", "dataset_name", "model", *METRICS4)


@register("s6_read_workbooks", _S6_SQL, dbl=METRICS4)
def q_s6x(spark, sf_dir):
    """S6 the same tables written as workbooks, one per data set, and read from their XML."""
    w = results_long(spark, sf_dir).groupBy("dataset", "model").pivot("metric", METRICS4).agg(F.avg("value"))
    code = F.element_at(F.create_map(*[F.lit(x) for kv in _CODE_MAP.items() for x in kv]), F.col("dataset"))
    w = w.where(code.isNotNull()).withColumn("file", F.concat(code.cast("string"), F.lit("_results"))).drop("dataset")
    root = write_workbooks(w, "file", RS.scratch_path(spark, "workbooks"))
    r = RS.coerce_numeric(RS.read_result_tables(spark, root, fmt="xlsx"), METRICS4)
    return CAT.tag_with_catalog(r).select("dataset_code", "dataset_name", "model", *METRICS4)


@register("s7_coerce_numeric", """
SELECT event_id, TRY_CAST(trim(value::VARCHAR) AS DOUBLE) AS value, TRY_CAST(trim(props) AS DOUBLE) AS props,
  TRY_CAST(trim(CAST(user_id AS VARCHAR)) AS DOUBLE) AS user_id FROM events""")
def q_s7(spark, sf_dir):
    """S7 trim column names, coerce metric-like columns (bad text -> NULL)."""
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", F.col("value").cast("string").alias(" value "), F.col("props").alias("props "),
        F.col("user_id").alias(" user_id"))
    return RS.coerce_numeric(ev, ["value", "props", "user_id"])


_CAT_VALUES = ", ".join(f"('{c[0]}', '{c[1]}')" for c in CAT.CATALOG)
_FEATURE_VALUES = ", ".join(f"('{k}', '{x}')" for k, v in CAT.FEATURES.items() for x in v)


@register("s11_catalog_lookup", f"""
WITH r AS (SELECT lpad(CAST(o_custkey % 20 AS VARCHAR), 2, '0') AS dataset_code FROM orders),
c AS (SELECT * FROM (VALUES {_CAT_VALUES}) AS t(code, name))
SELECT dataset_code, coalesce(c.name, 'Unknown (' || dataset_code || ')') AS dataset_name, count(*) AS n_rows
FROM r LEFT JOIN c ON c.code = r.dataset_code GROUP BY dataset_code, c.name""")
def q_s11(spark, sf_dir):
    """S11 catalog names joined onto result rows by zero-padded code."""
    o = read_table(spark, sf_dir, "orders")
    r = o.select(CAT.dataset_code((F.col("o_custkey") % 20).cast("string")).alias("dataset_code"))
    return CAT.tag_with_catalog(r).groupBy("dataset_code", "dataset_name").agg(F.count(F.lit(1)).alias("n_rows"))


@register("s11_catalog_features", f"""
WITH r AS (SELECT lpad(CAST(o_custkey % 20 AS VARCHAR), 2, '0') AS code FROM orders),
c AS (SELECT * FROM (VALUES {_FEATURE_VALUES}) AS t(code, feature))
SELECT feature, count(*) AS n_rows, count(DISTINCT code) AS n_sets FROM r JOIN c USING (code) GROUP BY feature""")
def q_s11f(spark, sf_dir):
    """S11 measured features of the data sets that result rows belong to."""
    o = read_table(spark, sf_dir, "orders")
    r = o.select(CAT.dataset_code((F.col("o_custkey") % 20).cast("string")).alias("code"))
    c = F.broadcast(CAT.catalog(spark).select("code", F.explode("features").alias("feature")))  # 15 data sets
    return r.join(c, "code").groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("code").alias("n_sets"))


@register("s12_s13_leaderboard_store", f"""
WITH b AS ({BOARD_SQL}), n AS ({NEW_SQL}),
u AS (SELECT * FROM n UNION ALL SELECT * FROM b WHERE model <> '1-URGENT')
SELECT dataset, model, timestamp, metric, value FROM u""", dbl=["value"])
def q_s12(spark, sf_dir):
    """S13 save the board as JSON, S12 load it back, upsert newer entries,
    save and load again."""
    b = board(spark, sf_dir)
    p1 = RS.write_leaderboard(b, RS.scratch_path(spark, "board"))
    loaded = RS.read_leaderboard(spark, p1)
    new = (loaded.where(F.col("model") == "1-URGENT").withColumn("value", F.col("value") * 2)
           .withColumn("timestamp", F.lit("2024-06-01 00:00:00")))
    p2 = RS.write_leaderboard(L.upsert(loaded, new),
                              RS.scratch_path(spark, "board"))
    return RS.read_leaderboard(spark, p2).select("dataset", "model", "timestamp", "metric", "value")


@register("s14_write_processed", f"""
WITH s AS (SELECT CASE WHEN {sql_uniform(42, 'l_orderkey', 'l_linenumber')} < 0.2 THEN 'test' ELSE 'train' END AS split,
  l_quantity FROM lineitem)
SELECT split, count(*) AS n_rows, sum(l_quantity) AS sum_qty FROM s GROUP BY split""", dbl=["sum_qty"])
def q_s14(spark, sf_dir):
    """S14 write train / test tables (parquet, partitioned by split) and read
    them back."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", split_column(["l_orderkey", "l_linenumber"], 0.2, 42).alias("split"))
    root = RS.scratch_path(spark, "processed")
    li.write.mode("overwrite").partitionBy("split").parquet(root)
    back = spark.read.parquet(root)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_qty"))


@register("s16_write_benchmark_table", RANK_FULL_SQL, dbl=METRICS4 + ["avg_rank"])
def q_s16(spark, sf_dir):
    """S16 write the ranked benchmark table as CSV and read it back."""
    r = L.rank_models(wide(spark, sf_dir), METRICS4)
    root = RS.scratch_path(spark, "bench")
    r.write.mode("overwrite").option("header", True).csv(root)
    back = spark.read.option("header", True).csv(root)
    return back.select("model", *[F.col(m).cast("double").alias(m) for m in METRICS4],
                       *[F.col(f"{m}_rank").cast("int").alias(f"{m}_rank") for m in METRICS4],
                       F.col("avg_rank").cast("double").alias("avg_rank"))


@register("s18_run_history", f"""
WITH h AS (SELECT dataset, model, [avg(value), min(value), max(value)] AS loss FROM ({LONG_SQL}) AS l
           WHERE metric = 'accuracy' GROUP BY dataset, model)
SELECT dataset, model, 'loss' AS metric, unnest(range(3))::INTEGER AS epoch, unnest(loss) AS value FROM h""",
          dbl=["value"])
def q_s18(spark, sf_dir):
    """S18 run histories written as JSON and read back into (epoch, value) rows."""
    h = (results_long(spark, sf_dir).where(F.col("metric") == "accuracy").groupBy("dataset", "model")
         .agg(F.array(F.avg("value"), F.min("value"), F.max("value")).alias("loss")))
    root = RS.scratch_path(spark, "history")
    h.write.mode("overwrite").json(root)
    return RS.read_history(spark, root)


@register("s15_record_lines", f"""
WITH r AS (SELECT dataset, model, metric, round(value * 1024) / 1024 AS value FROM ({REC_SQL}) AS q),
k AS (SELECT DISTINCT dataset, model FROM r),
l AS (SELECT dataset, model, 2 AS sec, metric AS k, metric || ':' || value::VARCHAR AS line FROM r
  UNION ALL SELECT dataset, model, 0, 'model_name', 'model_name:' || model FROM k
  UNION ALL SELECT dataset, model, 0, 'seq_len', 'seq_len:64' FROM k
  UNION ALL SELECT dataset, model, 1, e, '' FROM k, (VALUES ('a'), ('b')) AS t(e))
SELECT dataset, model, row_number() OVER (PARTITION BY dataset, model ORDER BY sec, k) AS n, line FROM l""")
def q_s15l(spark, sf_dir):
    """S15 the lines of every record file in their order (values in 1024ths, so that their text is exact)."""
    rec = _records(spark, sf_dir).withColumn("value", F.round(F.col("value") * 1024) / 1024)
    root = RS.write_records(rec, RS.scratch_path(spark, "records"), ["seq_len", "model_name"])
    file = F.col("_metadata.file_path")
    t = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(
        F.url_decode(F.regexp_extract(file, "dataset=([^/]*)", 1)).alias("dataset"),
        F.url_decode(F.regexp_extract(file, "model=([^/]*)", 1)).alias("model"),
        F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("n", "line"))
    return t.withColumn("n", (F.col("n") + 1).cast("bigint"))


@register("s15_write_result_records")
def q_s15(spark, sf_dir):
    """S15 result records written as key:value text (settings, two blank lines,
    metrics) and read back as raw lines with their file (rows only: the
    number-to-text format is the writer's)."""
    root = RS.write_records(_records(spark, sf_dir), RS.scratch_path(spark, "records"), ["seq_len", "model_name"])
    return spark.read.option("recursiveFileLookup", "true").text(root).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
