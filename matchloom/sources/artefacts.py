"""Array artefacts: fixed-shape arrays in Parquet with a manifest, written beside their place, moved into it, and rebuilt when a check fails."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"


def _fs(spark: SparkSession, path: str):
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of, of(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    """Data files of a table and their lengths."""
    of, fs = _fs(spark, path)
    found = fs.listStatus(of(path)) if fs.exists(of(path)) else []
    return {f.getPath().getName(): f.getLen() for f in found if f.isFile() and not f.getPath().getName().startswith(("_", "."))}


def digest(rows: DataFrame, column: str) -> dict:
    """Number of rows, lengths of their arrays, and a checksum that doesn't depend on order."""
    r = rows.agg(F.count("*").alias("rows"), F.min(F.size(column)).alias("least"), F.max(F.size(column)).alias("most"), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0)).alias("checksum")).first()
    return r.asDict()


def write_arrays(rows: DataFrame, path: str, column: str, shape: tuple[int, ...]) -> dict:
    """Write ``rows`` whose ``column`` holds flat arrays of ``shape``; the manifest tells shape, types, files and checksum.  An array of another length is an error, and what was there stays."""
    spark = rows.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    of, fs = _fs(spark, path)
    try:
        rows.write.parquet(beside)
        told = digest(spark.read.schema(rows.schema).parquet(beside), column)
        if told["rows"] and {told["least"], told["most"]} != {math.prod(shape)}:
            raise ValueError(f"arrays of {told['least']} to {told['most']} values for shape {shape}")
        manifest = {"shape": list(shape), "column": column, "schema": rows.schema.jsonValue(), "files": _files(spark, beside), "rows": told["rows"], "checksum": told["checksum"]}
        out = fs.create(of(f"{beside}/{MANIFEST}"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        old = f"{beside}.old"
        if fs.exists(of(path)):
            fs.rename(of(path), of(old))
        fs.rename(of(beside), of(path))
        fs.delete(of(old), True)
    finally:
        fs.delete(of(beside), True)
    return manifest


def manifest_of(spark: SparkSession, path: str) -> dict | None:
    of, fs = _fs(spark, path)
    at = of(f"{path}/{MANIFEST}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    except ValueError:
        return None
    finally:
        stream.close()


def read(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """The artefact's rows, with the schema they were written with."""
    return spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(path)


def fault(spark: SparkSession, path: str, column: str, shape: tuple[int, ...], deep: bool = True) -> str | None:
    """Why an artefact can't be used, or None: no manifest, another shape, files that are missing or of another length, and with ``deep`` content that reads otherwise or not at all."""
    m = manifest_of(spark, path)
    if m is None:
        return "no manifest"
    if m["shape"] != list(shape) or m["column"] != column:
        return "another shape"
    if m["files"] != _files(spark, path):
        return "files changed"
    if deep:
        try:
            told = digest(read(spark, path, m), column)
        except (PySparkException, Py4JJavaError):
            return "unreadable"
        if (told["rows"], told["checksum"]) != (m["rows"], m["checksum"]):
            return "content changed"
    return None


def ensure(spark: SparkSession, path: str, build: Callable[[], DataFrame], column: str, shape: tuple[int, ...], overwrite: bool = False, deep: bool = True) -> tuple[DataFrame, str | None]:
    """The artefact at ``path``, built if it is missing, faulty or to be overwritten; and why it was built (None: it was kept)."""
    why = "overwrite" if overwrite else fault(spark, path, column, shape, deep)
    if why:
        write_arrays(build(), path, column, shape)
    return read(spark, path, manifest_of(spark, path)), why
