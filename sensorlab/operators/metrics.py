"""Evaluation metrics as aggregations over prediction tables.

Classification input: ``sample_id, y_true, y_pred`` (and ``logits ARRAY<DOUBLE>``
for calibration).  Every metric is a partial (map-side combined) aggregate
over the rows followed by tiny aggregates over per-class counts, so one
dominant class costs no more than any other.

Curves (ROC / PR) need running sums over scores in descending order.  Rows
are first collapsed to one row per distinct score; the running sums are then
computed per score bucket (equal-count buckets from approximate quantiles)
plus a per-bucket offset, never with an unpartitioned window over the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..plans import chunked as C

# ---- class counts ------------------------------------------------------------


def class_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per label in the union of truth and prediction: tp, fp, fn, support."""
    conf = df.groupBy(F.col(y_true).alias("t"), F.col(y_pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    per = conf.select(F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("fp"),
                 F.when(F.col("t") != F.col("p"), F.col("n")).otherwise(0).alias("fn"),
                 F.col("n").alias("support")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"),
                 F.when(F.col("t") != F.col("p"), F.col("n")).otherwise(0).alias("fp"),
                 F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("support")))).alias("e"))
    return per.groupBy("e.label").agg(*[F.sum(f"e.{c}").alias(c) for c in ("tp", "fp", "fn", "support")])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def accuracy(df: DataFrame, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Share of rows with y_pred = y_true."""
    return df.agg(F.avg((F.col(y_pred) == F.col(y_true)).cast("double")).alias("accuracy"))


def f1_scores(df: DataFrame, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Micro, macro and weighted F1 over the label union (0/0 -> 0)."""
    cc = class_counts(df, y_true, y_pred)
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return cc.agg(
        _ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("f1_micro"),
        F.avg(f1).alias("f1_macro"),
        _ratio(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1_weighted"))


def precision_recall_f1(df: DataFrame, y_true="y_true", y_pred="y_pred", positive=1) -> DataFrame:
    """E5: precision, recall, F1: 'binary' (positive label) when the truth has
    exactly two classes, else support-weighted over the label union."""
    cc = class_counts(df, y_true, y_pred)
    prec, rec = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    n_true = F.sum((F.col("support") > 0).cast("int"))
    is_pos = F.col("label") == F.lit(positive)
    w = F.col("support")
    return (cc.agg(n_true.alias("_k"),
                   F.max(F.when(is_pos, prec)).alias("_bp"), F.max(F.when(is_pos, rec)).alias("_br"),
                   F.max(F.when(is_pos, f1)).alias("_bf"),
                   _ratio(F.sum(prec * w), F.sum(w)).alias("_wp"), _ratio(F.sum(rec * w), F.sum(w)).alias("_wr"),
                   _ratio(F.sum(f1 * w), F.sum(w)).alias("_wf"))
            .select(*[F.when(F.col("_k") == 2, F.coalesce(F.col(b), F.lit(0.0))).otherwise(F.col(wc)).alias(n)
                      for n, b, wc in (("precision", "_bp", "_wp"), ("recall", "_br", "_wr"),
                                       ("f1", "_bf", "_wf"))]))


def confusion_matrix(df: DataFrame, y_true="y_true", y_pred="y_pred", zeros: bool = True) -> DataFrame:
    """One row per (true_label, pred_label) over the sorted label union, zeros
    included: k*k rows for k classes, the size of the matrix itself, built from the
    k-row label list.  Without ``zeros`` only the pairs that occur, for many classes."""
    conf = df.groupBy(F.col(y_true).alias("true_label"), F.col(y_pred).alias("pred_label")).agg(
        F.count(F.lit(1)).alias("count"))
    if not zeros:
        return conf
    labels = conf.select(F.explode(F.array("true_label", "pred_label")).alias("l")).distinct()
    all_l = labels.agg(F.sort_array(F.collect_list("l")).alias("a")).scalar()
    grid = labels.select(F.col("l").alias("true_label"), F.explode(all_l).alias("pred_label"))
    return (grid.join(conf, ["true_label", "pred_label"], "left")
            .select("true_label", "pred_label", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


# ---- curves ----------------------------------------------------------------

def _score_steps(df: DataFrame, y_true: str, score: str) -> DataFrame:
    """One row per distinct score (descending thresholds) with tp / fp at that
    score and the exclusive running sums before it (tp_before, fp_before), plus
    totals P and N.

    Distinct scores are sorted into runs cut by Spark's range partitioning, so
    even a model whose scores crowd into a tiny interval spreads over many
    tasks; running sums are per run plus run offsets (one row per run)."""
    known = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))  # a row without a score has no rank
    g = df.where(known).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(y_true) == 1).cast("long")).alias("tp"),
        F.sum((F.col(y_true) != 1).cast("long")).alias("fp"))
    g = C.sorted_runs(g, [], [F.col("score").desc()])
    runs = Window.orderBy(C.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    tot = (g.groupBy(C.CHUNK).agg(F.sum("tp").alias("_rtp"), F.sum("fp").alias("_rfp"))
           .select(C.CHUNK, F.coalesce(F.sum("_rtp").over(runs), F.lit(0)).alias("_otp"),
                   F.coalesce(F.sum("_rfp").over(runs), F.lit(0)).alias("_ofp"),
                   F.sum("_rtp").over(everything).alias("P"), F.sum("_rfp").over(everything).alias("N")))
    inside = Window.partitionBy(C.CHUNK).orderBy(C.RN).rowsBetween(Window.unboundedPreceding, -1)
    return (g.withColumn("_itp", F.coalesce(F.sum("tp").over(inside), F.lit(0)))
            .withColumn("_ifp", F.coalesce(F.sum("fp").over(inside), F.lit(0)))
            .join(tot, C.CHUNK)
            .select("score", "tp", "fp", (F.col("_otp") + F.col("_itp")).alias("tp_before"),
                    (F.col("_ofp") + F.col("_ifp")).alias("fp_before"), "P", "N"))


def roc_curve(df: DataFrame, y_true="y_true", score="score", buckets: int | None = None) -> DataFrame:
    """ROC points (threshold, fpr, tpr), one per distinct score plus the
    start (inf, 0, 0).  All points are kept (sklearn drops collinear ones;
    the area is the same).  ``buckets`` is no longer needed: the runs follow the data."""
    s = _score_steps(df, y_true, score)
    pts = s.select(F.col("score").alias("threshold"),
                   F.try_divide(F.col("fp_before") + F.col("fp"), F.col("N")).alias("fpr"),
                   F.try_divide(F.col("tp_before") + F.col("tp"), F.col("P")).alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def roc_auc(df: DataFrame, y_true="y_true", score="score", buckets: int | None = None) -> DataFrame:
    """Area under the ROC curve by trapezoids; each distinct score adds
    fp/N * (2*tp_before + tp) / (2P), so no lag over the curve is needed."""
    s = _score_steps(df, y_true, score)
    return s.agg(F.sum(F.try_divide(F.col("fp") * (2 * F.col("tp_before") + F.col("tp")),
                                    F.col("N") * 2 * F.col("P"))).alias("roc_auc"))


def pr_curve(df: DataFrame, y_true="y_true", score="score", buckets: int | None = None) -> DataFrame:
    """Precision-recall points per distinct score, plus the end point
    (recall 0, precision 1)."""
    s = _score_steps(df, y_true, score)
    tp, fp = F.col("tp_before") + F.col("tp"), F.col("fp_before") + F.col("fp")
    pts = s.select(F.col("score").alias("threshold"), _ratio(tp, tp + fp).alias("precision"),
                   F.try_divide(tp, F.col("P")).alias("recall"))
    end = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                          F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return end.unionByName(pts)


def pr_auc(df: DataFrame, y_true="y_true", score="score", buckets: int | None = None) -> DataFrame:
    """Trapezoid area under the PR points (recall axis)."""
    s = _score_steps(df, y_true, score)
    tp, fp = F.col("tp_before") + F.col("tp"), F.col("fp_before") + F.col("fp")
    prec = _ratio(tp, tp + fp)
    prev = F.when(F.col("tp_before") + F.col("fp_before") == 0, F.lit(1.0)).otherwise(
        _ratio(F.col("tp_before"), F.col("tp_before") + F.col("fp_before")))
    return s.agg(F.sum(F.try_divide(F.col("tp"), F.col("P")) * (prec + prev) / 2).alias("pr_auc"))


# ---- logits, calibration -------------------------------------------------------

def softmax(a: Column) -> Column:
    """Array softmax, shifted by the max for stability.  Every part is bound once
    per row; left open, the sum would be worked out again for each entry."""
    def shares(e):
        return let(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda tot: F.transform(e, lambda x: x / tot))
    return let(a, lambda v: let(F.array_max(v), lambda m: let(F.transform(v, lambda x: F.exp(x - m)), shares)))


def argmax(a: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def probabilities(df: DataFrame, logits="logits", inputs: str = "logits") -> DataFrame:
    """Add ``probs`` and ``y_pred``.  ``inputs='probs'`` takes the array as
    probabilities already; ``'reference'`` applies softmax twice, reproducing
    the stored results of the reference (calibration there is computed on
    softmax of probabilities)."""
    a = F.col(logits)
    if inputs == "logits":
        p = softmax(a)
    elif inputs == "probs":
        p = a
    elif inputs == "reference":
        p = softmax(softmax(a))
    else:
        raise ValueError(inputs)
    return df.withColumn("probs", p).withColumn("y_pred", argmax(F.col(logits)))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def ece(df: DataFrame, y_true="y_true", logits="logits", n_bins: int = 15,
        inputs: str = "logits") -> DataFrame:
    """Expected calibration error with ``n_bins`` bins (lo, hi]; the first
    bin also takes confidence 0.  A scalar logit column uses the sigmoid and
    the label as accuracy."""
    if dict(df.dtypes)[logits].startswith("array"):
        p = probabilities(df, logits, inputs)
        conf = F.array_max("probs")
        acc = (argmax(F.col("probs")) == F.col(y_true)).cast("double")
    else:
        p = df
        conf = _sigmoid(F.col(logits).cast("double"))
        acc = F.col(y_true).cast("double")
    b = F.greatest(F.ceil(conf * n_bins), F.lit(1))
    per = p.groupBy(b.alias("bin")).agg(F.avg(conf).alias("c"), F.avg(acc).alias("a"),
                                        F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum(F.abs(F.col("c") - F.col("a")) * F.col("n")) / F.sum("n")).alias("ece"))


def _logsumexp(a: Column) -> Column:
    return let(a, lambda v: let(F.array_max(v), lambda m: m + F.log(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))))


def nll(df: DataFrame, y_true="y_true", logits="logits", inputs: str = "logits") -> DataFrame:
    """Mean cross entropy of the logits (of the probabilities with
    ``inputs='probs'``: mean of -log p; multi-class) or mean binary cross
    entropy with logits clamped to +-1e6 (scalar column)."""
    if dict(df.dtypes)[logits].startswith("array"):
        if inputs == "probs":
            return df.agg(F.avg(-F.log(F.try_element_at(F.col(logits), F.col(y_true).cast("int") + 1))).alias("nll"))
        a = F.col(logits) if inputs == "logits" else softmax(F.col(logits))
        ly = F.try_element_at(a, F.col(y_true).cast("int") + 1)
        return df.agg(F.avg(_logsumexp(a) - ly).alias("nll"))
    x = F.least(F.greatest(F.col(logits).cast("double"), F.lit(-1e6)), F.lit(1e6))
    y = F.col(y_true).cast("double")
    # stable BCE with logits: max(x,0) - x*y + log(1 + exp(-|x|))
    return df.agg(F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))).alias("nll"))


def brier(df: DataFrame, y_true="y_true", logits="logits", inputs: str = "logits") -> DataFrame:
    """Mean over samples and classes of (p - onehot)^2 (sigmoid for a
    scalar logit column)."""
    if dict(df.dtypes)[logits].startswith("array"):
        p = probabilities(df, logits, inputs).select(y_true, "probs")
        sq = F.aggregate(F.transform(F.col("probs"), lambda x, i: F.pow(x - F.when(i == F.col(y_true), 1.0)
                                                                           .otherwise(0.0), 2)),
                         F.lit(0.0), lambda acc, x: acc + x)
        return p.agg((F.sum(sq) / F.sum(F.size("probs"))).alias("brier"))
    return df.agg(F.avg(F.pow(_sigmoid(F.col(logits).cast("double")) - F.col(y_true), 2)).alias("brier"))


def calibration(df: DataFrame, y_true="y_true", logits="logits", inputs: str = "logits",
                n_bins: int = 15) -> DataFrame:
    """(nll, ece, brier) as one row, from sums per confidence bin: one scan."""
    x, y = F.col(logits), F.col(y_true)
    if dict(df.dtypes)[logits].startswith("array"):
        p = probabilities(df, logits, inputs)
        conf, acc = F.array_max("probs"), (argmax(F.col("probs")) == y).cast("double")
        if inputs == "probs":
            loss = -F.log(F.try_element_at(x, y.cast("int") + 1))
        else:
            a = x if inputs == "logits" else softmax(x)
            loss = _logsumexp(a) - F.try_element_at(a, y.cast("int") + 1)
        sq = F.aggregate(F.transform(F.col("probs"), lambda v, i: F.pow(v - F.when(i == y, 1.0).otherwise(0.0), 2)),
                         F.lit(0.0), lambda t, v: t + v)
        width = F.size("probs")
    else:
        p, conf, acc = df, _sigmoid(x.cast("double")), y.cast("double")
        z = F.least(F.greatest(x.cast("double"), F.lit(-1e6)), F.lit(1e6))
        loss = F.greatest(z, F.lit(0.0)) - z * acc + F.log1p(F.exp(-F.abs(z)))
        sq, width = F.pow(conf - y, 2), F.when(conf.isNotNull() & y.isNotNull(), 1)
    per = (p.select(conf.alias("c"), acc.alias("a"), loss.alias("l"), sq.alias("s"), width.alias("w"))
           .groupBy(F.greatest(F.ceil(F.col("c") * n_bins), F.lit(1)).alias("bin"))
           .agg(F.avg("c").alias("c"), F.avg("a").alias("a"), F.count(F.lit(1)).alias("n"), F.sum("l").alias("l"),
                F.count("l").alias("ln"), F.sum("s").alias("s"), F.sum("w").alias("w")))
    return per.agg(F.try_divide(F.sum("l"), F.sum("ln")).alias("nll"),
                   (F.sum(F.abs(F.col("c") - F.col("a")) * F.col("n")) / F.sum("n")).alias("ece"),
                   F.try_divide(F.sum("s"), F.sum("w")).alias("brier"))


def split_loss_accuracy(df: DataFrame, split="split", y_true="y_true", logits="logits") -> DataFrame:
    """Per split mean cross entropy and accuracy (sample means)."""
    a = F.col(logits)
    return df.groupBy(split).agg(
        F.avg(_logsumexp(a) - F.try_element_at(a, F.col(y_true).cast("int") + 1)).alias("loss"),
        F.avg((argmax(a) == F.col(y_true)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


# ---- regression errors -----------------------------------------------------------

def regression_errors(df: DataFrame, pred="pred", true="true") -> DataFrame:
    """RSE, MAE, MSE, RMSE, MAPE, MSPE (division by a zero truth is
    NULL and skipped, where the reference yields inf)."""
    e = F.col(true) - F.col(pred)
    t = F.col(true)
    sums = df.agg(F.sum(e * e).alias("sse"), (F.var_pop(t) * F.count(t)).alias("sst"), F.avg(F.abs(e)).alias("mae"),
                  F.avg(e * e).alias("mse"), F.avg(F.abs(e / F.nullif(t, F.lit(0)))).alias("mape"),
                  F.avg(F.pow(e / F.nullif(t, F.lit(0)), 2)).alias("mspe"))
    return sums.select(F.try_divide(F.sqrt("sse"), F.sqrt("sst")).alias("rse"), "mae", "mse",
                       F.sqrt("mse").alias("rmse"), "mape", "mspe")


def corr_reference(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The reference's CORR: per column pair sum((t-mt)(p-mp)) /
    sqrt(sum((t-mt)^2 (p-mp)^2)), then the mean over columns."""
    # moments about a provisional centre, the mean of a few rows, in one scan; then moved to the true means
    near = df.limit(1000).agg(F.struct(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for pr in pairs for c in pr])).scalar()
    sums, parts = [], []
    for i, (p, t) in enumerate(pairs):
        u, v = F.col(t) - near.getField(t), F.col(p) - near.getField(p)
        both = u.isNotNull() & v.isNotNull()
        sums += [F.avg(u).alias(f"mu{i}"), F.avg(v).alias(f"mv{i}")]
        sums += [F.sum(F.when(both, F.pow(u, a) * F.pow(v, b))).alias(f"s{i}_{a}{b}") for a in range(3) for b in range(3)]
    m = df.agg(*sums)
    for i in range(len(pairs)):
        du, dv = F.col(f"mu{i}"), F.col(f"mv{i}")

        def about(a, b, i=i, du=du, dv=dv):
            """Sum of (u - mean)^a (v - mean)^b."""
            tot = F.lit(0.0)
            for j in range(a + 1):
                for k in range(b + 1):
                    tot = tot + math.comb(a, j) * math.comb(b, k) * F.pow(-du, a - j) * F.pow(-dv, b - k) * F.col(f"s{i}_{j}{k}")
            return tot
        parts.append(F.try_divide(about(1, 1), F.sqrt(about(2, 2))))
    tot = parts[0]
    for x in parts[1:]:
        tot = tot + x
    return m.select((tot / len(parts)).alias("corr"))


# ---- forecast losses (E22, E23) -----------------------------------------------

def _div_no_nan(a: Column, b: Column) -> Column:
    r = a / F.nullif(b, F.lit(0))
    return F.coalesce(F.when(F.isnan(r) | (F.abs(r) == F.lit(float("inf"))), F.lit(0.0)).otherwise(r), F.lit(0.0))


def masked_losses(df: DataFrame, forecast="forecast", target="target", mask="mask",
                  masep="masep") -> DataFrame:
    """Masked MAPE, sMAPE and MASE training losses over (series, step)
    rows; divisions giving NaN or inf count as 0.  ``masep`` is the series'
    mean absolute seasonal difference (see :func:`seasonal_scale`)."""
    f, t, m = F.col(forecast), F.col(target), F.col(mask).cast("double")
    return df.agg(
        F.avg(F.abs((f - t) * _div_no_nan(m, t))).alias("mape_loss"),
        (200 * F.avg(_div_no_nan(F.abs(f - t), F.abs(f) + F.abs(t)) * m)).alias("smape_loss"),
        F.avg(F.abs(t - f) * _div_no_nan(m, F.col(masep))).alias("mase_loss"))


def forecast_frame(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str = "value",
                   horizon: int = 6, freq: int = 1, chunk: Column | None = None) -> DataFrame:
    """Forecast setting on long series: the last ``horizon`` values of each
    series are the truth; ``forecast`` is the value ``horizon`` steps earlier
    (seasonal naive), ``naive1`` the last in-sample value, and ``masep`` the
    series' mean |v_t - v_{t-freq}| over the in-sample part.

    One window pass over position buckets (with ``max(horizon, freq)`` rows
    borrowed across bucket edges) gives both lags; the in-sample scale is one
    partial aggregate; the horizon rows and the naive1 rows are a handful per
    series.  Output: keys, h, target, forecast, naive1, masep."""
    rows, _ = C.index_series(df, keys, order, chunk)
    both = C.with_neighbours(rows, None, keys, [value], before=max(horizon, freq))
    w = Window.partitionBy(*keys, C.CHUNK).orderBy(C.POS)
    x = (both.select(*keys, C.POS, C.LEN, C.BORROWED, F.col(value).alias("_v"),
                     F.lag(value, freq).over(w).alias("_lf"), F.lag(value, horizon).over(w).alias("_lh"))
         .where(~F.col(C.BORROWED)))
    insample = F.col(C.POS) < F.col(C.LEN) - horizon
    # the in-sample scale and the last in-sample value: one partial aggregate
    lagged = insample & F.col("_lf").isNotNull()
    at_end = F.col(C.POS) == F.col(C.LEN) - horizon - 1
    per = (x.groupBy(*keys).agg(F.avg(F.when(lagged, F.abs(F.col("_v") - F.col("_lf")))).alias("masep"),
                                F.max(F.when(at_end, F.col("_v"))).alias("naive1"),
                                F.count(F.when(lagged, 1)).alias("_ns"), F.count(F.when(at_end, 1)).alias("_nl"))
           .where("_ns > 0 AND _nl > 0").drop("_ns", "_nl"))
    hz = x.where(~insample & F.col("_lh").isNotNull()).select(
        *keys, (F.col(C.POS) - (F.col(C.LEN) - horizon)).alias("h"), F.col("_v").alias("target"),
        F.col("_lh").alias("forecast"))
    return hz.join(per, list(keys)).select(*keys, "h", "target", "forecast", "naive1", "masep")


def m4_errors(df: DataFrame, keys: Sequence[str], forecast="forecast", target="target",
              masep="masep") -> DataFrame:
    """Per series MASE (mean |f - t| / masep), sMAPE and MAPE (percent,
    zero denominators replaced by 1)."""
    f, t = F.col(forecast), F.col(target)
    den_s = F.abs(t) + F.abs(f)
    den_m = F.abs(t)
    return df.groupBy(*keys).agg(
        F.try_divide(F.avg(F.abs(f - t)), F.first(masep)).alias("mase"),
        F.avg(200 * F.abs(f - t) / F.when(den_s == 0, 1.0).otherwise(den_s)).alias("smape"),
        F.avg(100 * F.abs(f - t) / F.when(den_m == 0, 1.0).otherwise(den_m)).alias("mape"))


# fixed values of the reference: group names and the three kept apart
M4_GROUPS = ["Yearly", "Quarterly", "Monthly", "Weekly", "Daily", "Hourly"]
M4_KEPT = ["Yearly", "Quarterly", "Monthly"]


def summarize_groups(scores: DataFrame, group="group", score="score", count="n") -> DataFrame:
    """Yearly / Quarterly / Monthly as is, Weekly+Daily+Hourly as a
    count-weighted 'Others', and a count-weighted 'Average' of all."""
    g = F.when(F.col(group).isin(*M4_KEPT), F.col(group)).otherwise(F.lit("Others"))
    parts = scores.groupBy(g.alias("group")).agg(
        (F.sum(F.col(score) * F.col(count)) / F.sum(count)).alias("score"))
    avg = scores.agg(F.lit("Average").alias("group"),
                     (F.sum(F.col(score) * F.col(count)) / F.sum(count)).alias("score"))
    return parts.unionByName(avg)


def owa(model: DataFrame, naive: DataFrame, group="group") -> DataFrame:
    """OWA per group = (mase/mase_naive + smape/smape_naive) / 2, with the
    scores of both rounded half-even to 3 places like the reference output."""
    j = model.alias("m").join(naive.alias("n"), group)
    return j.select(group, F.bround((F.try_divide(F.col("m.mase"), F.col("n.mase"))
                                     + F.try_divide(F.col("m.smape"), F.col("n.smape"))) / 2, 3).alias("owa"),
                    F.bround("m.smape", 3).alias("smape"), F.bround("m.mase", 3).alias("mase"))


# ---- anomaly segments (E26) ------------------------------------------------------

def adjust_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                    truth="truth", pred="pred", chunk: Column | None = None) -> DataFrame:
    """Inside every run of truth = 1, one predicted hit marks the whole run
    (the reference's loop without its index-0 off-by-one).  A segmented scan:
    every row knows the last and the next hit and the last and the next truth = 0
    row, at any distance (carried values of the position index); a hit lies in
    the row's run if no such zero is between them."""
    mark = F.when(F.col(truth) != 1, F.lit(1))
    hit = F.when((F.col(truth) == 1) & (F.col(pred) == 1), F.lit(1))
    rows, _ = C.index_series(df.withColumn("_zero", mark).withColumn("_hit", hit), keys, order, chunk, carry=["_zero", "_hit"])
    before = F.col("_prevpos__hit") > F.coalesce(F.col("_prevpos__zero"), F.lit(-1))
    after = F.coalesce(F.col("_nextpos__hit") < F.col("_nextpos__zero"), F.col("_nextpos__hit").isNotNull())
    found = (F.col(truth) == 1) & (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))
    out = rows.withColumn("pred_adjusted", F.when(found, F.lit(1)).otherwise(F.col(pred)).cast("int"))
    return C.drop_index(out).drop("_zero", "_hit")
