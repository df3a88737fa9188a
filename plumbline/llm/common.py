"""Shared plumbing: input tables, the shared scratch folder, and byte helpers for Arrow columns."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None

#: Rows and bytes that Spark hands to a Python worker at once; whole texts can be long.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker and the JVM hold of the rows that pass between them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a folder of this machine is set if the session runs in one process (as in tests);
    on a cluster executors would each write to a disk of their own, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_files(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder below ``scratch``, for code that runs on executors."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not among ``columns``, however their letters are cased."""
    taken, name = {c.lower() for c in columns}, f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def free(columns: list[str], name: str) -> str:
    """``name`` itself where ``columns`` have nothing like it."""
    return fresh(columns, name) if name.lower() in {c.lower() for c in columns} else name


#: Has Spark remove an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at durable files, and the shuffle files of the step go."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written, after their last reader has run."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            fs, path = shared_files(folder)
            fs.delete_dir(path)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Bytes (of a text in UTF-8) of each value; null counts as empty."""
    column = column.cast(pa.binary())
    return (column.fill_null(b"") if column.null_count else column).to_pylist()


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """Row ranges of ``batch`` whose ``column`` holds about ``most_bytes`` bytes (one row at least)."""
    index = batch.schema.get_field_index(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(index)), 0), dtype=np.int64)
    if not len(sizes):
        return
    group = (np.cumsum(sizes) - sizes) // most_bytes
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(sizes)]):
        yield batch.slice(int(a), int(b - a))
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers live on and keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
