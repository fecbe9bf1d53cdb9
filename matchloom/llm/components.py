"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), all in DataFrames.

Every step is a minimum per node (combined map-side) and a join back, so no neighbour list is ever gathered; joins on
hub nodes are plain shuffled joins that adaptive execution splits.  Each round is cut through the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ROUNDS = 60


def fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first())


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; the component is its smallest node.

    Rows with a null end are ignored; no edges give an empty frame.
    """
    e = cut(edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    state = fingerprint(e)
    for _ in range(ROUNDS if state[0] else 0):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut(small.where("u > v").distinct())
        before, state = state, fingerprint(e)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
