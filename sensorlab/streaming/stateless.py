"""Stateless feature operators on a Structured Streaming source.

The reference has no streaming path; its row-local operators (calendar parts
F4, sensor pairs F9/F10, scaling with given statistics N6, scaled time
features N11) need no state and run unchanged on a streaming DataFrame.
Order-dependent and fitted operators need a batch (or a stateful stream) and
are not offered here.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timefeat as TF
from ..session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """Events parquet read as a file stream (schema from the batch reader)."""
    schema = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .option("maxFilesPerTrigger", max_files).parquet(sf_dir))


def time_feature_stream(stream: DataFrame, ts: str = "ts", freq: str = "s") -> DataFrame:
    """N11 / N12 on each micro-batch: scaled time features of ``ts``."""
    return stream.select("event_id", *[c.alias(n) for n, c in TF.time_features(F.col(ts), freq).items()])


def calendar_scaled_stream(stream: DataFrame, ts: str = "ts", value: str = "value", mean: float = 0.0,
                           std: float = 1.0) -> DataFrame:
    """F4 calendar parts and N6 scaling with given statistics on each
    micro-batch (row-local, no state)."""
    from ..operators import features as FE
    from ..operators import norm as N
    d = FE.calendar_features(stream.select("event_id", ts, value), ts)
    return N.scale_with(d, [value], mean, std)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Drain the stream into parquet under the shared checkpoint folder (with
    its own checkpoint, so a restarted query resumes) and return the result
    as a batch DataFrame."""
    base = os.path.join(ensure_checkpoint_dir(stream.sparkSession), f"stream-{name}-{uuid.uuid4().hex[:12]}")
    out, ck = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.parquet(out)
