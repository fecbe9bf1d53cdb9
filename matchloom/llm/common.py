"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators the word-based contracts know.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named parquet table, with only ``columns`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; set here only in local mode, and only where the session has none (tests)."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="matchloom-checkpoint-")
        sc.setCheckpointDir(where)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so that a lost executor costs one stage and not the whole plan."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet below the shared folder and read again (columnar, and read as often as needed), and where it lies."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def split_of(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5: 0 marks the held-out fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(5)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound the Arrow batches of this session by bytes: rows here can be whole blocks of documents."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


_REMEMBERED: dict = {}


def remembered(key, build):
    """A large object that a worker keeps between tasks; the worker keeps one, so an operator's doesn't outlive the next operator's."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = build()
    return _REMEMBERED[key]


def trim() -> None:
    """Give freed memory back to the system: workers wait for their next task between operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``rows.mapInArrow`` with batches bounded by bytes, and a worker trimmed after each task."""
    small_batches(rows.sparkSession)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return rows.mapInArrow(trimmed, schema)
