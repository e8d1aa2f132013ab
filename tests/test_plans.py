"""Plan shape: series windows are partitioned (never one task for all rows
of a key or of the table), filters reach the scan, entry() runs."""

import io
import contextlib

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_series_windows_are_chunked(spark):
    q = E.queries()
    for name in ("flagship_series_summary", "n7_interpolate", "f5_rolling_mean"):
        plan = _plan(q[name](spark, SF_SMALL))
        # every window over the data is partitioned by key *and* chunk
        for line in plan.splitlines():
            if line.startswith("Arguments:") and "specifiedwindowframe" in line.lower():
                assert "_chunk" in line or "machine" not in line, line


def test_filter_pushdown(spark):
    plan = _plan(E.queries()["p8_filter_choices"](spark, SF_SMALL))
    assert "PushedFilters: [In(o_orderstatus" in plan or "PushedFilters: [IsNotNull(o_orderstatus)" in plan


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "channel"


def test_split_partition_pruning(spark, tmp_path):
    from pyspark.sql import functions as F
    from sensorlab.operators.features import split_column
    from sensorlab.sources.tables import read_table
    li = read_table(spark, SF_SMALL, "lineitem").select(
        "l_orderkey", "l_quantity", split_column(["l_orderkey"], 0.2, 42).alias("split"))
    root = str(tmp_path / "processed")
    li.write.mode("overwrite").partitionBy("split").parquet(root)
    plan = _plan(spark.read.parquet(root).where(F.col("split") == "test").select("l_quantity"))
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<l_quantity:double>" in plan


def test_column_pruning_through_operators(spark):
    plan = _plan(E.queries()["f9_sensor_ratio"](spark, SF_SMALL))
    # only the four sensor inputs and the keys (plus the gap rule's l_partkey) are read
    line = [x for x in plan.splitlines() if x.startswith("ReadSchema:")][0]
    assert "l_returnflag" not in line and "l_shipdate" not in line


def test_one_scan_per_measure(spark):
    q = E.queries()
    for name in ("e13_calibration", "e15_e21_regression_errors"):
        plan = q[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1, name


def test_limit_and_nth_move_ids_only(spark, monkeypatch):
    """What is put in order for S4 and P9 holds ids, no series."""
    from sensorlab.operators import shapes
    from sensorlab.plans import chunked
    from sensorlab.sources import samples as SM
    from sensorlab.sources.tables import samples
    sorted_columns = []
    real = chunked.sorted_runs

    def spy(df, keys, order):
        sorted_columns.append(set(df.columns))
        return real(df, keys, order)
    monkeypatch.setattr(chunked, "sorted_runs", spy)
    s = samples(spark, SF_SMALL)
    assert SM.limit_samples(s, 10).count() == 10
    assert shapes.nth_of_class(s, "label", "sample_id", 2).count() == s.select("label").distinct().count()
    assert sorted_columns and not any("series" in c for c in sorted_columns)
