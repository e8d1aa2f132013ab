"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_scopes: list[list[str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex[:12]}")
    for held in _scopes[-1:]:
        held.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was stored within it.  Only for work whose result is
    written elsewhere before the end: a lazy table that reads one of the removed is lost."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, whatever kind of storage it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: it is
    computed once, and a lost executor takes nothing with it."""
    path = path or folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """(file system, path in it) of a path or URI in the shared folder, for tasks
    that write or read binary files there."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def write_file(path: str, data: bytes) -> None:
    store, at = filesystem(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(at) as out:
        out.write(data)
