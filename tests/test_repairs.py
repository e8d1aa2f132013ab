"""Cases the oracle tables do not hold: NaN, partial entries, mixed lengths, missing scores."""

import math

from sensorlab.operators import clean, leaderboard, metrics, norm, spectral


def test_nan_is_missing(spark):
    rows = [(0, 1.0), (1, 2.0), (2, 3.0), (3, float("nan")), (4, 10.0), (5, None)]
    df = spark.createDataFrame(rows, "i int, x double")
    assert sorted(r.x for r in clean.fill_missing(df, ["x"]).collect()) == [1.0, 2.0, 2.5, 2.5, 3.0, 10.0]
    capped = {r.i: r.x for r in clean.cap_outliers(df, ["x"]).collect()}
    assert capped[3] is None and capped[5] is None and capped[4] == 4.75 + 1.5 * 3.0
    s = spark.createDataFrame([("m", f"2024-01-01 00:0{i}:00", x) for i, x in rows], "k string, t string, value double")
    s = s.selectExpr("k", "to_timestamp(t) AS ts", "value")
    got = [r.value for r in norm.interpolate_gaps(s, ["k"], ["ts"]).orderBy("ts").collect()]
    assert got == [1.0, 2.0, 3.0, 6.5, 10.0, 10.0]


def test_newer_entry_replaces_the_whole_older_one(spark):
    schema = "dataset string, model string, metric string, value double, timestamp string"
    old = spark.createDataFrame([("d", "m", "accuracy", 0.5, "1"), ("d", "m", "f1", 0.4, "1"), ("d", "n", "f1", 0.3, "1")], schema)
    new = spark.createDataFrame([("d", "m", "accuracy", 0.9, "2")], schema)
    got = sorted(tuple(r) for r in leaderboard.upsert(old, new).select("model", "metric", "value").collect())
    assert got == [("m", "accuracy", 0.9), ("n", "f1", 0.3)]
    assert leaderboard.upsert(old, old.where("model = 'm'")).count() == 3


def test_latest_of_two_files_with_one_time_stamp(spark):
    rec = spark.createDataFrame([("d", "m", "a", 1.0, 5, "x"), ("d", "m", "a", 2.0, 5, "y")],
                                "dataset string, model string, metric string, value double, modified int, file string")
    assert [r.value for r in leaderboard.latest_records(rec).collect()] == [2.0]


def test_period_weights_of_mixed_lengths(spark):
    def tone(n, k):
        return [math.sin(2 * math.pi * k * t / n) for t in range(n)]
    df = spark.createDataFrame([(1, tone(16, 2)), (2, tone(32, 5))], "sample_id int, series array<double>")
    got = spectral.period_weights(df, spectral.main_periods(df, k=2)).collect()
    assert sorted((r.sample_id, r["rank"]) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert {(r.sample_id, r.period) for r in got if r["rank"] == 1} == {(1, 8), (2, 6)}


def test_rows_without_a_score_have_no_rank(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, None), (0, float("nan"))], "y_true int, score double")
    assert metrics.roc_auc(df).first().roc_auc == 1.0
    assert metrics.pr_auc(df).first().pr_auc == 1.0


def test_nll_of_probabilities(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.1, 0.9])], "y_true int, logits array<double>")
    assert abs(metrics.nll(df, inputs="probs").first().nll + math.log(0.9)) < 1e-12


def test_one_hot_forms_agree(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", None, "c", "a"])], "i int, t string")
    wide = {r.i: r for r in clean.one_hot(df, ["t"]).collect()}
    assert set(wide[0].asDict()) == {"i", "t_b", "t_c"}
    given = {r.i: r for r in clean.one_hot(df, ["t"], categories={"t": ["a", "b", "c"]}).collect()}
    sparse = {r.i: r.t_index for r in clean.one_hot_sparse(df, "t").collect()}
    for i in range(5):
        assert wide[i] == given[i]
        assert [wide[i].t_b, wide[i].t_c] == [int(sparse[i] == 0), int(sparse[i] == 1)]


def test_frame_wider_than_the_bucket(spark):
    from sensorlab.operators.features import rolling_features
    rows = spark.range(300).selectExpr("'m' AS k", "timestamp_seconds(id) AS ts", "id * 1.0D AS x")
    import sensorlab.plans.chunked as C
    old, C.BUCKET = C.BUCKET, 16
    try:
        got = rolling_features(rows, ["k"], ["ts"], ["x"], window=50).collect()
    finally:
        C.BUCKET = old
    col = next(c for c in got[0].asDict() if "mean" in c)
    by = {r.x: r[col] for r in got}
    assert by[299.0] == sum(range(250, 300)) / 50


def test_exact_split_counts(spark):
    from sensorlab.operators.features import exact_split
    for n, share in ((101, 0.2), (7, 0.5), (5, 0.0), (0, 0.2)):
        got = exact_split(spark.range(n), ["id"], share).groupBy("split").count().collect()
        assert {r.split: r["count"] for r in got}.get("test", 0) == math.ceil(n * share)
