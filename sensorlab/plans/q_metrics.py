"""Evaluation metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.random import sql_uniform
from ..operators import metrics as M
from ..sources.tables import logits_table, machine_series, predictions, read_table
from ..operators.features import split_column
from .registry import register

PRED_SQL = "SELECT doc_id AS sample_id, quality AS y_true, toxic AS y_pred FROM labels"
# multi-class predictions: argmax over the entries of each embedding
MC_SQL = ("SELECT vec_id AS sample_id, label AS y_true, "
          "(list_position(embedding, list_max(embedding)) - 1)::INTEGER AS y_pred FROM embeddings")
# long logits: one row per (sample, class)
LONG_SQL = ("SELECT vec_id AS sample_id, label AS y_true, unnest(embedding)::DOUBLE AS x, "
            "unnest(range(len(embedding))) AS k FROM embeddings")
PROBS_SQL = (f"WITH l0 AS ({LONG_SQL}), l AS (SELECT *, max(x) OVER (PARTITION BY sample_id) AS mx FROM l0) "
             "SELECT sample_id, y_true, k, x, exp(x - mx) / sum(exp(x - mx)) OVER (PARTITION BY sample_id) AS p FROM l")
BIN_SQL = ("SELECT vec_id AS sample_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y_true, "
           "1.0 / (1.0 + exp(-list_sum(embedding::DOUBLE[]))) AS score FROM embeddings")


def _mc(spark, sf_dir):
    t = logits_table(spark, sf_dir)
    return t.select("sample_id", "y_true", M.argmax(F.col("logits")).alias("y_pred"))


def _bin(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.when(F.col("label") < 5, 1).otherwise(0).alias("y_true"),
                    (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.aggregate(
                        F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)))).alias("score"))


def _counts_sql(src):
    return f"""
WITH p AS ({src}),
labs AS (SELECT y_true AS label FROM p UNION SELECT y_pred FROM p),
c AS (SELECT l.label,
  sum(CASE WHEN p.y_true = l.label AND p.y_pred = l.label THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN p.y_pred = l.label AND p.y_true <> l.label THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN p.y_true = l.label AND p.y_pred <> l.label THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN p.y_true = l.label THEN 1 ELSE 0 END) AS support
  FROM labs l, p GROUP BY l.label),
m AS (SELECT *, CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2.0*tp/(2*tp+fp+fn) END AS f1,
  CASE WHEN tp+fp = 0 THEN 0.0 ELSE tp::DOUBLE/(tp+fp) END AS prec,
  CASE WHEN tp+fn = 0 THEN 0.0 ELSE tp::DOUBLE/(tp+fn) END AS rec FROM c)"""


@register("e1_accuracy", f"SELECT avg((y_pred = y_true)::DOUBLE) AS accuracy FROM ({PRED_SQL}) AS p",
          dbl=["accuracy"])
def q_e1(spark, sf_dir):
    """E1 accuracy of the prediction table."""
    return M.accuracy(predictions(spark, sf_dir))


_F1_SEL = ("SELECT CASE WHEN 2*sum(tp)+sum(fp)+sum(fn) = 0 THEN 0.0 ELSE 2.0*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)) END"
           " AS f1_micro, avg(f1) AS f1_macro, sum(f1*support)/sum(support) AS f1_weighted FROM m")

for _n, _col in (("e2_f1_micro", "f1_micro"), ("e3_f1_macro", "f1_macro"), ("e4_f1_weighted", "f1_weighted")):
    def _mk(col):
        def q(spark, sf_dir):
            return M.f1_scores(_mc(spark, sf_dir)).select(col)
        q.__doc__ = f"E2-E4 {col} of argmax predictions over all entries."
        return q
    register(_n, _counts_sql(MC_SQL) + f" SELECT {_col} FROM ({_F1_SEL}) AS z", dbl=[_col])(_mk(_col))


_PRF_SQL = """ SELECT
  CASE WHEN (SELECT count(*) FROM c WHERE support > 0) = 2
       THEN coalesce((SELECT prec FROM m WHERE label = 1), 0.0) ELSE (SELECT sum(prec*support)/sum(support) FROM m) END AS precision,
  CASE WHEN (SELECT count(*) FROM c WHERE support > 0) = 2
       THEN coalesce((SELECT rec FROM m WHERE label = 1), 0.0) ELSE (SELECT sum(rec*support)/sum(support) FROM m) END AS recall,
  CASE WHEN (SELECT count(*) FROM c WHERE support > 0) = 2
       THEN coalesce((SELECT f1 FROM m WHERE label = 1), 0.0) ELSE (SELECT sum(f1*support)/sum(support) FROM m) END AS f1"""


@register("e5_precision_recall_f1", _counts_sql(PRED_SQL) + _PRF_SQL, dbl=["precision", "recall", "f1"])
def q_e5(spark, sf_dir):
    """E5 binary precision / recall / F1 of the prediction table."""
    return M.precision_recall_f1(predictions(spark, sf_dir))


@register("e5_precision_recall_f1_weighted", _counts_sql(MC_SQL) + _PRF_SQL, dbl=["precision", "recall", "f1"])
def q_e5w(spark, sf_dir):
    """E5 weighted precision / recall / F1 over all entries."""
    return M.precision_recall_f1(_mc(spark, sf_dir))


@register("e6_confusion_matrix", f"""
WITH p AS ({MC_SQL}), labs AS (SELECT y_true AS l FROM p UNION SELECT y_pred FROM p)
SELECT a.l AS true_label, b.l AS pred_label,
  (SELECT count(*) FROM p WHERE p.y_true = a.l AND p.y_pred = b.l) AS count
FROM labs a, labs b""")
def q_e6(spark, sf_dir):
    """E6 confusion matrix over the label union, zero cells included."""
    return M.confusion_matrix(_mc(spark, sf_dir))


_STEPS_SQL = f"""
WITH s AS ({BIN_SQL}),
g AS (SELECT score, sum(y_true) AS tp, sum(1 - y_true) AS fp FROM s GROUP BY score),
c AS (SELECT score, tp, fp,
   coalesce(sum(tp) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tpb,
   coalesce(sum(fp) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fpb FROM g),
t AS (SELECT sum(y_true) AS P, sum(1 - y_true) AS N FROM s)"""


@register("e7_roc_curve", _STEPS_SQL + """
SELECT 'inf'::DOUBLE AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL SELECT score, (fpb + fp) / N, (tpb + tp) / P FROM c, t""", dbl=["threshold", "fpr", "tpr"])
def q_e7(spark, sf_dir):
    """E7 ROC points of a sigmoid score for a binary truth."""
    return M.roc_curve(_bin(spark, sf_dir))


@register("e7_roc_auc", _STEPS_SQL + " SELECT sum(fp / N * (2 * tpb + tp) / (2 * P)) AS roc_auc FROM c, t",
          dbl=["roc_auc"])
def q_e7a(spark, sf_dir):
    """E7 area under the ROC curve."""
    return M.roc_auc(_bin(spark, sf_dir))


@register("e8_pr_curve", _STEPS_SQL + """
SELECT 'inf'::DOUBLE AS threshold, 1.0 AS precision, 0.0 AS recall
UNION ALL SELECT score, (tpb + tp)::DOUBLE / (tpb + tp + fpb + fp), (tpb + tp) / P FROM c, t""",
          dbl=["threshold", "precision", "recall"])
def q_e8(spark, sf_dir):
    """E8 precision-recall points plus the (0, 1) end point."""
    return M.pr_curve(_bin(spark, sf_dir))


@register("e8_pr_auc", _STEPS_SQL + """
SELECT sum(tp / P * ((tpb + tp)::DOUBLE / (tpb + tp + fpb + fp)
  + CASE WHEN tpb + fpb = 0 THEN 1.0 ELSE tpb::DOUBLE / (tpb + fpb) END) / 2) AS pr_auc FROM c, t""",
          dbl=["pr_auc"])
def q_e8a(spark, sf_dir):
    """E8 trapezoid area under the precision-recall points."""
    return M.pr_auc(_bin(spark, sf_dir))


@register("e9_softmax_argmax", PROBS_SQL.replace("SELECT sample_id, y_true, k, x,", "SELECT sample_id, k,")
          .replace(" AS p FROM l", " AS prob FROM l"), dbl=["prob"])
def q_e9(spark, sf_dir):
    """E9 softmax probabilities per (sample, class)."""
    t = M.probabilities(logits_table(spark, sf_dir))
    return t.select("sample_id", F.posexplode("probs").alias("k", "prob")).select(
        "sample_id", F.col("k").cast("bigint").alias("k"), "prob")


@register("e9_argmax", MC_SQL.replace(", label AS y_true", ""))
def q_e9b(spark, sf_dir):
    """E9 argmax class per sample (first maximum wins)."""
    return M.probabilities(logits_table(spark, sf_dir)).select("sample_id", "y_pred")


_CONF_SQL = f"""
WITH pr AS ({PROBS_SQL}),
s AS (SELECT sample_id, any_value(y_true) AS y_true, max(p) AS conf, arg_max(k, p) AS pred FROM pr GROUP BY sample_id),
b AS (SELECT greatest(ceil(conf * 15), 1) AS bin, avg(conf) AS c, avg((pred = y_true)::DOUBLE) AS a, count(*) AS n
      FROM s GROUP BY bin)"""
_ECE_SEL = "(SELECT sum(abs(c - a) * n) / sum(n) FROM b)"
_NLL_SQL = f"""
WITH pr AS ({LONG_SQL}), mx AS (SELECT sample_id, max(x) AS m FROM pr GROUP BY sample_id),
z AS (SELECT pr.sample_id, mx.m + ln(sum(exp(pr.x - mx.m))) AS lse,
        max(CASE WHEN pr.k = pr.y_true THEN pr.x END) AS xy FROM pr JOIN mx USING (sample_id)
      GROUP BY pr.sample_id, mx.m)"""
_BRIER_SEL = "(SELECT sum(power(p - CASE WHEN k = y_true THEN 1.0 ELSE 0.0 END, 2)) / count(*) FROM pr)"


@register("e10_ece", _CONF_SQL + f" SELECT {_ECE_SEL} AS ece", dbl=["ece"])
def q_e10(spark, sf_dir):
    """E10 expected calibration error, 15 bins, softmax of logits."""
    return M.ece(logits_table(spark, sf_dir))


@register("e10_ece_binary", """
WITH s AS (SELECT CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, 1.0 / (1.0 + exp(-(embedding[1]::DOUBLE))) AS conf
           FROM embeddings),
b AS (SELECT greatest(ceil(conf * 15), 1) AS bin, avg(conf) AS c, avg(y::DOUBLE) AS a, count(*) AS n FROM s GROUP BY bin)
SELECT sum(abs(c - a) * n) / sum(n) AS ece FROM b""", dbl=["ece"])
def q_e10b(spark, sf_dir):
    """E10 one-column form: sigmoid confidence, label as accuracy."""
    e = read_table(spark, sf_dir, "embeddings")
    t = e.select(F.when(F.col("label") < 5, 1).otherwise(0).alias("y_true"),
                 F.col("embedding")[0].cast("double").alias("logit"))
    return M.ece(t, "y_true", "logit")


@register("e10_ece_reference", (_CONF_SQL.replace(
    f"WITH pr AS ({PROBS_SQL}),",
    f"WITH p1 AS ({PROBS_SQL}), p2 AS (SELECT *, max(p) OVER (PARTITION BY sample_id) AS mp FROM p1), "
    "pr AS (SELECT sample_id, y_true, k, p AS x, exp(p - mp) / sum(exp(p - mp)) OVER (PARTITION BY sample_id) AS p "
    "FROM p2),")
    + f" SELECT {_ECE_SEL} AS ece"), dbl=["ece"])
def q_e10r(spark, sf_dir):
    """E10 with the reference's double softmax (inputs='reference')."""
    return M.ece(logits_table(spark, sf_dir), inputs="reference")


@register("e11_nll", _NLL_SQL + " SELECT avg(lse - xy) AS nll FROM z", dbl=["nll"])
def q_e11(spark, sf_dir):
    """E11 mean cross entropy of the logits."""
    return M.nll(logits_table(spark, sf_dir))


@register("e11_nll_binary", """
SELECT avg(greatest(x, 0.0) - x * y + ln(1 + exp(-abs(x)))) AS nll FROM (
  SELECT least(greatest(embedding[1]::DOUBLE, -1e6), 1e6) AS x,
         CASE WHEN label < 5 THEN 1.0 ELSE 0.0 END AS y FROM embeddings) AS s""", dbl=["nll"])
def q_e11b(spark, sf_dir):
    """E11 binary cross entropy with clamped logits."""
    e = read_table(spark, sf_dir, "embeddings")
    t = e.select(F.when(F.col("label") < 5, 1).otherwise(0).alias("y_true"),
                 F.col("embedding")[0].cast("double").alias("logit"))
    return M.nll(t, "y_true", "logit")


@register("e12_brier", f"WITH pr AS ({PROBS_SQL}) SELECT {_BRIER_SEL} AS brier", dbl=["brier"])
def q_e12(spark, sf_dir):
    """E12 Brier score over samples and classes."""
    return M.brier(logits_table(spark, sf_dir))


@register("e13_calibration", _CONF_SQL + f""",
mx AS (SELECT sample_id, max(x) AS m FROM pr GROUP BY sample_id),
z AS (SELECT pr.sample_id, mx.m + ln(sum(exp(pr.x - mx.m))) AS lse,
        max(CASE WHEN pr.k = pr.y_true THEN pr.x END) AS xy FROM pr JOIN mx USING (sample_id)
      GROUP BY pr.sample_id, mx.m)
SELECT (SELECT avg(lse - xy) FROM z) AS nll, {_ECE_SEL} AS ece, {_BRIER_SEL} AS brier""",
          dbl=["nll", "ece", "brier"])
def q_e13(spark, sf_dir):
    """E13 calibration bundle (nll, ece, brier)."""
    return M.calibration(logits_table(spark, sf_dir))


_SPLIT_E = f"CASE WHEN {sql_uniform(42, 'sample_id')} < 0.2 THEN 'test' ELSE 'train' END"


@register("e14_split_loss_accuracy", f"""
WITH pr AS (SELECT *, {_SPLIT_E} AS split FROM ({LONG_SQL}) AS l0),
mx AS (SELECT sample_id, max(x) AS m FROM pr GROUP BY sample_id),
z AS (SELECT pr.sample_id, any_value(pr.split) AS split, mx.m + ln(sum(exp(pr.x - mx.m))) AS lse,
        max(CASE WHEN pr.k = pr.y_true THEN pr.x END) AS xy,
        (arg_max(pr.k, pr.x) = any_value(pr.y_true))::DOUBLE AS hit
      FROM pr JOIN mx USING (sample_id) GROUP BY pr.sample_id, mx.m)
SELECT split, avg(lse - xy) AS loss, avg(hit) AS accuracy, count(*) AS n FROM z GROUP BY split""",
          dbl=["loss", "accuracy"])
def q_e14(spark, sf_dir):
    """E14 mean loss and accuracy per split."""
    t = logits_table(spark, sf_dir).withColumn("split", split_column(["sample_id"], 0.2, 42))
    return M.split_loss_accuracy(t)


REG_SQL = "SELECT l_tax * 100 AS y_hat, l_discount * 100 AS y_obs FROM lineitem"


@register("e15_e21_regression_errors", f"""
WITH s AS ({REG_SQL})
SELECT sqrt(sum(power(y_obs - y_hat, 2))) / sqrt(sum(power(y_obs - (SELECT avg(y_obs) FROM s), 2))) AS rse,
  avg(abs(y_obs - y_hat)) AS mae, avg(power(y_obs - y_hat, 2)) AS mse, sqrt(avg(power(y_obs - y_hat, 2))) AS rmse,
  avg(abs((y_obs - y_hat) / nullif(y_obs, 0))) AS mape, avg(power((y_obs - y_hat) / nullif(y_obs, 0), 2)) AS mspe
FROM s""", dbl=["rse", "mae", "mse", "rmse", "mape", "mspe"])
def q_e15(spark, sf_dir):
    """E15-E21 RSE, MAE, MSE, RMSE, MAPE, MSPE of tax vs discount (percent)."""
    li = read_table(spark, sf_dir, "lineitem")
    return M.regression_errors(li.select((F.col("l_tax") * 100).alias("y_hat"),
                                         (F.col("l_discount") * 100).alias("y_obs")), pred="y_hat", true="y_obs")


_REG_SEL = {"rse": "sqrt(sum(power(y_obs - y_hat, 2))) / sqrt(sum(power(y_obs - (SELECT avg(y_obs) FROM s), 2)))",
            "mae": "avg(abs(y_obs - y_hat))", "mse": "avg(power(y_obs - y_hat, 2))",
            "rmse": "sqrt(avg(power(y_obs - y_hat, 2)))", "mape": "avg(abs((y_obs - y_hat) / nullif(y_obs, 0)))",
            "mspe": "avg(power((y_obs - y_hat) / nullif(y_obs, 0), 2))"}
for _id, _m in (("e15_rse", "rse"), ("e17_mae", "mae"), ("e18_mse", "mse"), ("e19_rmse", "rmse"),
                ("e20_mape", "mape"), ("e21_mspe", "mspe")):
    def _mk(m):
        def q(spark, sf_dir):
            li = read_table(spark, sf_dir, "lineitem")
            t = li.select((F.col("l_tax") * 100).alias("y_hat"), (F.col("l_discount") * 100).alias("y_obs"))
            return M.regression_errors(t, pred="y_hat", true="y_obs").select(m)
        q.__doc__ = f"{m.upper()} of tax vs discount (percent); zero truths skipped for ratios."
        return q
    register(_id, f"WITH s AS ({REG_SQL}) SELECT {_REG_SEL[_m]} AS {_m} FROM s", dbl=[_m])(_mk(_m))


@register("e16_corr_reference", """
WITH s AS (SELECT l_tax AS p1, l_discount AS t1, l_quantity * (1 - l_discount) AS p2, l_quantity AS t2 FROM lineitem),
m AS (SELECT avg(p1) AS mp1, avg(t1) AS mt1, avg(p2) AS mp2, avg(t2) AS mt2 FROM s)
SELECT (sum((t1 - mt1) * (p1 - mp1)) / sqrt(sum(power(t1 - mt1, 2) * power(p1 - mp1, 2)))
      + sum((t2 - mt2) * (p2 - mp2)) / sqrt(sum(power(t2 - mt2, 2) * power(p2 - mp2, 2)))) / 2 AS corr
FROM s, m""", dbl=["corr"])
def q_e16(spark, sf_dir):
    """E16 the reference's CORR over two column pairs."""
    li = read_table(spark, sf_dir, "lineitem")
    t = li.select(F.col("l_tax").alias("p1"), F.col("l_discount").alias("t1"),
                  (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("p2"), F.col("l_quantity").alias("t2"))
    return M.corr_reference(t, [("p1", "t1"), ("p2", "t2")])


# ---- forecast setting on machine series: last H values are the truth ---------
H = 6

FC_BASE_SQL = f"""
WITH s0 AS (SELECT user_id AS machine, ts, event_id, value FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY ts, event_id) - 1 AS pos,
        count(*) OVER (PARTITION BY machine) AS len FROM s0),
sc AS (SELECT machine, avg(abs(d)) AS masep FROM (
        SELECT machine, value - lag(value, 1) OVER (PARTITION BY machine ORDER BY pos) AS d FROM s
        WHERE pos < len - {H}) AS x WHERE d IS NOT NULL GROUP BY machine),
fc AS (SELECT t.machine, t.pos - (t.len - {H}) AS h, t.value AS target, f.value AS forecast,
        (SELECT value FROM s l WHERE l.machine = t.machine AND l.pos = t.len - {H} - 1) AS naive1
       FROM s t JOIN s f ON f.machine = t.machine AND f.pos = t.pos - {H}
       WHERE t.pos >= t.len - {H}),
j AS (SELECT fc.*, sc.masep FROM fc JOIN sc USING (machine))"""


def forecast_frame(spark, sf_dir):
    """Per machine: horizon rows (h, target, forecast = value H steps back,
    naive1 = last in-sample value) and the in-sample seasonal scale."""
    s = machine_series(spark, sf_dir).select("machine", "ts", "event_id", "value")
    return M.forecast_frame(s, ["machine"], ["ts", "event_id"], "value", horizon=H, freq=1)


@register("e22_masked_losses", FC_BASE_SQL + """
SELECT avg(abs((forecast - target) * coalesce(1.0 / nullif(target, 0), 0.0))) AS mape_loss,
  200 * avg(coalesce(abs(forecast - target) / nullif(abs(forecast) + abs(target), 0), 0.0)) AS smape_loss,
  avg(abs(target - forecast) * coalesce(1.0 / nullif(masep, 0), 0.0)) AS mase_loss FROM j""",
          dbl=["mape_loss", "smape_loss", "mase_loss"])
def q_e22(spark, sf_dir):
    """E22 masked MAPE / sMAPE / MASE losses of a seasonal-naive forecast."""
    return M.masked_losses(forecast_frame(spark, sf_dir).withColumn("mask", F.lit(1)))


@register("e23_m4_errors", FC_BASE_SQL + """
SELECT machine, avg(abs(forecast - target)) / any_value(masep) AS mase,
  avg(200 * abs(forecast - target) / CASE WHEN abs(target) + abs(forecast) = 0 THEN 1.0
      ELSE abs(target) + abs(forecast) END) AS smape,
  avg(100 * abs(forecast - target) / CASE WHEN abs(target) = 0 THEN 1.0 ELSE abs(target) END) AS mape
FROM j GROUP BY machine""", dbl=["mase", "smape", "mape"])
def q_e23(spark, sf_dir):
    """E23 per machine MASE / sMAPE / MAPE of the seasonal-naive forecast."""
    return M.m4_errors(forecast_frame(spark, sf_dir), ["machine"])


_GROUP_SQL = ("CASE machine % 6 WHEN 0 THEN 'Yearly' WHEN 1 THEN 'Quarterly' WHEN 2 THEN 'Monthly' "
              "WHEN 3 THEN 'Weekly' WHEN 4 THEN 'Daily' ELSE 'Hourly' END")


def _group_col():
    return F.element_at(F.array(*[F.lit(g) for g in M.M4_GROUPS]), (F.col("machine") % 6 + 1).cast("int"))


_PER_SERIES_SQL = FC_BASE_SQL + f""",
ps AS (SELECT machine, {_GROUP_SQL} AS grp,
  avg(abs(forecast - target)) / any_value(masep) AS mase,
  avg(200 * abs(forecast - target) / CASE WHEN abs(target) + abs(forecast) = 0 THEN 1.0
      ELSE abs(target) + abs(forecast) END) AS smape,
  avg(abs(naive1 - target)) / any_value(masep) AS mase_n,
  avg(200 * abs(naive1 - target) / CASE WHEN abs(target) + abs(naive1) = 0 THEN 1.0
      ELSE abs(target) + abs(naive1) END) AS smape_n
  FROM j GROUP BY machine),
pg AS (SELECT grp, avg(mase) AS mase, avg(smape) AS smape, avg(mase_n) AS mase_n, avg(smape_n) AS smape_n,
       count(*) AS n FROM ps GROUP BY grp),
sg AS (SELECT CASE WHEN grp IN ('Yearly', 'Quarterly', 'Monthly') THEN grp ELSE 'Others' END AS g2,
         sum(mase * n) / sum(n) AS mase, sum(smape * n) / sum(n) AS smape,
         sum(mase_n * n) / sum(n) AS mase_n, sum(smape_n * n) / sum(n) AS smape_n FROM pg GROUP BY g2
       UNION ALL SELECT 'Average', sum(mase * n) / sum(n), sum(smape * n) / sum(n),
         sum(mase_n * n) / sum(n), sum(smape_n * n) / sum(n) FROM pg)"""


def _group_scores(spark, sf_dir, which):
    fr = forecast_frame(spark, sf_dir)
    f = F.col("forecast") if which == "model" else F.col("naive1")
    per = M.m4_errors(fr.withColumn("_f", f), ["machine"], forecast="_f").withColumn("group", _group_col())
    return per.groupBy("group").agg(F.avg("mase").alias("mase"), F.avg("smape").alias("smape"),
                                     F.count(F.lit(1)).alias("n"))


@register("e24_summarize_groups", _PER_SERIES_SQL + " SELECT g2 AS \"group\", smape AS score FROM sg",
          dbl=["score"])
def q_e24(spark, sf_dir):
    """E24 sMAPE by group, regrouped to Yearly/Quarterly/Monthly/Others/Average."""
    g = _group_scores(spark, sf_dir, "model")
    return M.summarize_groups(g, score="smape")


@register("e25_owa", _PER_SERIES_SQL + """
SELECT g2 AS "group", round_even((mase / mase_n + smape / smape_n) / 2, 3) AS owa,
  round_even(smape, 3) AS smape, round_even(mase, 3) AS mase FROM sg""")
def q_e25(spark, sf_dir):
    """E25 OWA of the seasonal-naive forecast against naive1, per regrouped group."""
    m = _group_scores(spark, sf_dir, "model")
    n = _group_scores(spark, sf_dir, "naive")
    sm = M.summarize_groups(m, score="mase").withColumnRenamed("score", "mase").join(
        M.summarize_groups(m, score="smape").withColumnRenamed("score", "smape"), "group")
    sn = M.summarize_groups(n, score="mase").withColumnRenamed("score", "mase").join(
        M.summarize_groups(n, score="smape").withColumnRenamed("score", "smape"), "group")
    return M.owa(sm, sn)


@register("e26_adjust_segments", """
WITH s AS (SELECT user_id AS machine, ts, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS truth,
             CASE WHEN value > 50 THEN 1 ELSE 0 END AS pred FROM events),
a AS (SELECT *, CASE WHEN truth = 1 AND coalesce(lag(truth) OVER (PARTITION BY machine ORDER BY ts, event_id), 0) <> 1
             THEN 1 ELSE 0 END AS st FROM s),
b AS (SELECT *, sum(st) OVER (PARTITION BY machine ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM a),
h AS (SELECT machine, seg, max(pred) AS hit FROM b WHERE truth = 1 GROUP BY machine, seg)
SELECT b.machine, b.ts, b.event_id, b.truth, b.pred,
  (CASE WHEN b.truth = 1 AND h.hit = 1 THEN 1 ELSE b.pred END)::INTEGER AS pred_adjusted
FROM b LEFT JOIN h ON b.machine = h.machine AND b.seg = h.seg""")
def q_e26(spark, sf_dir):
    """E26 anomaly segment adjustment: truth = 'error' events, prediction = value > 50."""
    ev = read_table(spark, sf_dir, "events")
    s = ev.select(F.col("user_id").alias("machine"), "ts", "event_id",
                  F.when(F.col("event_type") == "error", 1).otherwise(0).alias("truth"),
                  F.when(F.col("value") > 50, 1).otherwise(0).alias("pred"))
    return M.adjust_segments(s, ["machine"], ["ts", "event_id"])
