"""Shared working storage, session preparation and Arrow batch helpers.

Intermediate tables are written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir`` and read again: lineage is cut, a lost executor costs nothing that was
written, and a join that follows has a plain exchange on both sides, which adaptive execution can
split when one key is hot.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


#: Long texts meet in Arrow batches; Spark cuts a batch at this size (a session setting, lowered, never raised).
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, and let Python workers of this machine import this package where it is not installed.

    The bound is a session setting and only ever lowered.  Workers of other machines get the package by
    ``--py-files`` or an installation; a path that they do not have does them no harm.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([p for p in [ROOT, *paths] if p])
    return spark


_CACHED: dict[str, object] = {}


def cached(key: str, make: Callable[[], object]):
    """One object for each worker process, kept from task to task; another key's object is let go first.

    Workers are used again by later stages; without this the tables of all operators would add up in them.
    """
    if key not in _CACHED:
        _CACHED.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _CACHED[key] = make()
    return _CACHED[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a local one for a local master and an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "loomgraph-work")
    return folder.rstrip("/")


class Workspace:
    """Tables of one operator call.  Leaving the block deletes all but the kept ones."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = prepare(spark)
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.temporary: list[str] = []

    def path(self, name: str, keep: bool = False) -> str:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        if not keep:
            self.temporary.append(path)
        return path

    def table(self, df: DataFrame, name: str, keep: bool = False, partition_by: str | None = None) -> DataFrame:
        path = self.path(name, keep)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def free(self) -> None:
        """Delete what was written so far and is not kept."""
        for path in self.temporary:
            self.drop(path)
        self.temporary = []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.free()


_HELD: list[Workspace] = []


def hold(space: Workspace) -> None:
    """Keep the tables that a lazy result still reads until ``release``."""
    _HELD.append(space)


def release() -> None:
    """Delete the tables of results that have been written by now."""
    while _HELD:
        _HELD.pop().free()


def slices(batches: Iterator[pa.RecordBatch], column: str, target_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``target_bytes`` in each piece."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = max(batch.column(batch.schema.get_field_index(column)).nbytes, 1)
        step = max(1, min(n, int(n * target_bytes / size)))
        for k in range(0, n, step):
            yield batch.slice(k, step)
