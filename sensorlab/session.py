"""Session construction and cluster-level settings."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings that matter at scale as much as locally: AQE re-plans joins and
# partition counts from measured shuffle sizes (runtime broadcast of small
# sides, skew-join splitting, partition coalescing).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sensorlab", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    ``master`` and ``shuffle_partitions`` are only meant for local runs; on a
    cluster leave them ``None`` so the submitter's settings win.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system path; it is used as
    is, and its absence is an error, since a folder of one machine would be
    invisible to the others.  Only a local master gets a folder under /tmp.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="sensorlab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers (pandas UDFs unpickle
    functions by module name) whatever the caller's working directory: zip it
    once per SparkContext into the shared checkpoint folder and
    ``addPyFile`` it from there."""
    sc = spark.sparkContext
    if getattr(sc, "_sensorlab_shipped", False):
        return
    from pyarrow import fs as pafs
    package = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for root, _dirs, files in sorted(os.walk(package)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    data = buf.getvalue()
    base = ensure_checkpoint_dir(spark)
    uri = base if "://" in base else "file://" + os.path.abspath(base)
    filesystem, path = pafs.FileSystem.from_uri(uri)
    filesystem.create_dir(path, recursive=True)
    name = f"sensorlab-{hashlib.sha1(data).hexdigest()[:12]}.zip"
    with filesystem.open_output_stream(f"{path}/{name}") as fh:
        fh.write(data)
    sc.addPyFile(f"{base.rstrip('/')}/{name}")
    sc._sensorlab_shipped = True
