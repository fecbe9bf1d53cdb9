"""Labelled rows: folds, bounded samples, and joins that leave texts where they are while the labels are few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_of

#: Up to so many labelled ids (16 bytes each) are broadcast; beyond, documents and labels meet in a shuffled join.
BROADCAST_ROWS = 1_000_000


def targets(labels: DataFrame, target: str) -> DataFrame:
    """doc_id, y and fold (1 to 4) of the rows that may be learnt from; repeated rows of a document count as their mean."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("int").alias("y"))
    return rows.withColumn("fold", split_of().cast("int")).where("fold <> 0")


def sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those of the smallest hashes of the id."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def with_targets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that have a target, with it."""
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(rows) if few else rows, "doc_id")
