"""Sinks: partitioned tables, single-file exports, run records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(rows: DataFrame, path: str, by: str = "match_id", mode: str = "overwrite", skip_existing: bool = False) -> bool:
    """Parquet partitioned by match, one writer per match; an existing table is kept if asked, and only touched matches are replaced."""
    if skip_existing and exists(rows.sparkSession, path):
        return False
    rows.repartition(by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return True


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there completely; any store that Spark knows."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(of(path)) and not fs.exists(of(f"{path}/_temporary"))


def append_results(rows: DataFrame, path: str, run: str) -> None:
    """Results of a run added to those of earlier runs, without reading these."""
    rows.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def write_csv(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Delimited export with a header, one folder per key if asked."""
    w = (rows.repartition(by) if by else rows).write.mode("overwrite").option("header", True)
    (w.partitionBy(by) if by else w).csv(path)


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """A run's record as one JSON line."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def components_long(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Component tables (keys, option, value) as one long table with their name."""
    out = None
    for name, t in tables.items():
        part = t.select(*keys, "option", "value", F.lit(name).alias("component"))
        out = part if out is None else out.unionByName(part)
    return out


def wide_export(rows: DataFrame, keys: list[str], options: list[str], value: str = "value") -> DataFrame:
    """One column per option, for people; the engine's own tables stay long."""
    return rows.groupBy(*keys).pivot("option", options).agg(F.first(value))
