"""Labelled sample files (S2, S3) and the sample-count limit."""

from __future__ import annotations

import io
import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import chunked as C

SAMPLE_SCHEMA = "sample_id long, label string, series array<double>"


def write_npz(df: DataFrame, root: str, split: str) -> str:
    """Write (sample_id, label, series) as ``.npz`` files, one per Arrow batch
    of each partition, named ``part-<partition>-<batch>_<split>.npz`` (arrays
    ``sample_id``, ``label``, ``series_<i>``).  Names are deterministic and
    each file is written under a temporary name and renamed, so a retried
    task replaces its own files instead of adding copies, and readers never
    see half-written files.  Nothing passes through the driver."""
    def part(it):
        from pyarrow import fs as pafs
        from pyspark import TaskContext
        filesystem, base = pafs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))
        filesystem.create_dir(base, recursive=True)
        pid = TaskContext.get().partitionId()
        for b, pdf in enumerate(it):
            if len(pdf) == 0:
                continue
            arrays = {"sample_id": pdf["sample_id"].to_numpy(np.int64),
                      "label": pdf["label"].astype(str).to_numpy(dtype="U")}
            for i, s in enumerate(pdf["series"]):
                arrays[f"series_{i}"] = np.asarray(s, dtype=np.float64)
            name = f"{base}/part-{pid:05d}-{b:05d}_{split}.npz"
            tmp = f"{base}/.tmp-{uuid.uuid4().hex}"
            buf = io.BytesIO()
            np.savez(buf, **arrays)
            with filesystem.open_output_stream(tmp) as fh:   # any Arrow file system (local, HDFS, S3)
                fh.write(buf.getvalue())
            filesystem.move(tmp, name)
            yield pd.DataFrame({"file": [name], "n": [len(pdf)]})
    written = df.select("sample_id", F.col("label").cast("string").alias("label"), "series") \
        .mapInPandas(part, "file string, n long")
    written.write.format("noop").mode("overwrite").save()   # runs the writers
    return root


def _decode_npz(content: bytes, allow_pickle: bool) -> pd.DataFrame:
    """Samples of one archive: ``write_npz``'s arrays, or a table of objects
    (arrays ``data`` and ``columns``, with columns ``features`` and ``label``,
    a whole series per cell; samples are numbered in file order)."""
    z = np.load(io.BytesIO(content), allow_pickle=allow_pickle)
    if "sample_id" in z.files:
        ids = z["sample_id"]
        return pd.DataFrame({"sample_id": ids, "label": z["label"].astype(str),
                             "series": [z[f"series_{i}"] for i in range(len(ids))]})
    if not {"data", "columns"} <= set(z.files):
        raise ValueError(f"not a sample archive: it holds {sorted(z.files)}")
    if not allow_pickle:
        raise ValueError("this archive holds Python objects; read it with allow_pickle=True if you trust it")
    table = pd.DataFrame(z["data"], columns=[str(c) for c in z["columns"]])
    return pd.DataFrame({"sample_id": np.arange(len(table)), "label": table["label"].map(str),
                         "series": [np.asarray(x, dtype=np.float64) for x in table["features"]]})


def read_npz(spark: SparkSession, path: str, split_regex: str | None = None,
             allow_pickle: bool = False) -> DataFrame:
    """Read labelled sample files: ``binaryFile`` listing of ``*.npz``,
    filtered by the pattern on the file name (column ``split`` has the name's
    TRAIN, VAL or TEST), decoded per batch with ``numpy.load``
    (``allow_pickle`` stays off unless asked: unpickling runs code)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    if split_regex:
        files = files.where(name.rlike(split_regex))
    files = files.withColumn("split", F.regexp_extract(name, r"_(TRAIN|VAL|TEST)\.npz$", 1))

    def decode(it):
        for pdf in it:
            for content, split in zip(pdf["content"], pdf["split"]):
                yield _decode_npz(content, allow_pickle).assign(split=split)
    return files.select("content", "split").mapInPandas(decode, SAMPLE_SCHEMA + ", split string")


def limit_samples(df: DataFrame, size: float, key: str = "sample_id") -> DataFrame:
    """Keep the first ``size`` samples by id (null ids first), or the first
    int(size * n) when ``size`` <= 1.

    Only the ids are put in order, to find the id at the cut-off; the rows are
    filtered by it where they are.  Of rows that share the last id any are kept,
    as many as are wanted."""
    ids, _ = C.index_series(df.select(key).withColumn("_all", F.lit(0)), ["_all"], [key])
    k = int(size) if size > 1 else int(float(size) * ids.count())
    if k < 1:
        return df.limit(0)
    last = ids.where(F.col(C.POS) == k - 1).select(key).first()
    if last is None:  # fewer rows than wanted
        return df
    cut = F.lit(last[0]).cast(df.schema[key].dataType)
    same = F.col(key).eqNullSafe(cut)
    before = ids.where(same).agg(F.min(C.POS)).first()[0]
    if last[0] is None:
        return df.where(same).limit(k)
    return df.where(F.col(key).isNull() | (F.col(key) < cut)).unionByName(df.where(same).limit(k - before))
