"""Joins that Spark has no operator for: as-of, nearest, interval, overlay.

As-of joins go through one union and one window over the shared partitioning (a sort, no range comparison), so they are linear whatever the
density of either side; interval joins are equi-joins on the keys and a bucket of the position.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the table, to be sorted rather than sent whole to every worker.

    The size of rows unfolded from arrays is guessed as that of the rows that they come from, so that without this the larger side may be broadcast through the driver.
    """
    return side.hint("merge")


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], mode: str = "backward", strict: bool = False, prefix: str = "") -> DataFrame:
    """Left rows with the right row nearest before ("backward") or after ("forward") them within ``by``.

    Equal positions match unless ``strict``.  Where several right rows share a position, the greatest struct of values wins backward and
    the least wins forward.  Unmatched rows get nulls.
    """
    picked = F.struct(F.col(on).alias("_at"), *values)
    row = F.struct(*left.columns)
    a = left.select(*by, F.col(on).alias("_on"), F.lit(None).cast(right.select(picked.alias("p")).schema["p"].dataType).alias("_right"), row.alias("_left"), F.lit(1).alias("_side"))
    b = right.select(*by, F.col(on).alias("_on"), picked.alias("_right"), F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("_left"), F.lit(0).alias("_side"))
    # the side that is to be seen first sorts first: right before left for backward unless strict, and so on
    first = F.col("_side") if (mode == "backward") != strict else -F.col("_side")
    order = [F.col("_on"), first] if mode == "backward" else [F.col("_on").desc(), F.col("_side") if not strict else -F.col("_side")]
    tie = F.col("_right") if mode == "backward" else F.col("_right").desc()
    w = W.partitionBy(*by).orderBy(*order, tie).rowsBetween(W.unboundedPreceding, 0)
    joined = a.union(b).withColumn("_match", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return joined.select("_left.*", F.col("_match._at").alias(f"{prefix}{on}_matched"), *[F.col(f"_match.{v}").alias(f"{prefix}{v}") for v in values])


def nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], tolerance: float | None = None) -> DataFrame:
    """Left rows with the right row of the least absolute distance; a tie goes to the earlier one."""
    back = asof(left, right, by, on, values, "backward", prefix="_b_")
    both = asof(back, right, by, on, values, "forward", prefix="_f_")
    before, after = F.col(on) - F.col(f"_b_{on}_matched"), F.col(f"_f_{on}_matched") - F.col(on)
    take = after.isNull() | (before <= after)
    out = both.select(*left.columns, F.when(take, F.col(f"_b_{on}_matched")).otherwise(F.col(f"_f_{on}_matched")).alias(f"{on}_matched"), *[F.when(take, F.col(f"_b_{v}")).otherwise(F.col(f"_f_{v}")).alias(v) for v in values])
    if tolerance is None:
        return out
    near = F.abs(F.col(on) - F.col(f"{on}_matched")) <= tolerance
    return out.withColumns({c: F.when(near, F.col(c)) for c in [f"{on}_matched", *values]})


def within(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, bucket: int = 500, how: str = "inner") -> DataFrame:
    """Points joined to the spans that contain them, both ends included.

    A span is dealt to every bucket of positions that it touches, so that long matches with many spans don't meet in one
    task and the join stays an equi-join.
    """
    p = points.withColumn("_bucket", F.floor(F.col(at) / bucket))
    s = spans.withColumn("_slot", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    s = s.withColumnsRenamed({k: f"_by_{k}" for k in by})
    condition = (F.col("_bucket") == F.col("_slot")) & (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    for k in by:
        condition = condition & (F.col(k) == F.col(f"_by_{k}"))
    return p.join(s, condition, how).drop("_bucket", "_slot", *[f"_by_{k}" for k in by])


def overlay(base: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``base`` with the value of ``first``, else of ``second``, and where it came from."""
    a = first.select(*keys, F.col(value).alias("_a"))
    b = second.select(*keys, F.col(value).alias("_b"))
    source = F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second").otherwise("none")
    return base.join(a, keys, "left").join(b, keys, "left").withColumns({value: F.coalesce("_a", "_b"), "source": source}).drop("_a", "_b")


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: 8 a column, and the length of strings, binaries and (written out) nested values."""
    sizes = [F.lit(8 * len(df.columns))]
    for f in df.schema.fields:
        name = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(name), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)))
    return reduce(add, (c.cast("long") for c in sizes))


def few(df: DataFrame, most: int, most_bytes: int) -> bool:
    """Whether ``df`` has at most ``most`` rows and they take at most about ``most_bytes``; reads no more than ``most`` + 1 rows."""
    n, size = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return n <= most and size <= most_bytes


def lookup(rows: DataFrame, dimension: DataFrame, keys: list[str], most: int = 1_000_000, most_bytes: int = 64 << 20) -> DataFrame:
    """Left join to a dimension, broadcast if it has at most ``most`` rows of ``most_bytes`` together."""
    return rows.join(F.broadcast(dimension) if few(dimension, most, most_bytes) else dimension, keys, "left")


def right_filled(left: DataFrame, right: DataFrame, keys: list[str], partition: list[str], order: str, values: list[str]) -> DataFrame:
    """Every right row with the left row's values, carried forward over rows that have none."""
    w = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return left.select(*keys, *values).join(right, keys, "right").withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def receiver_end(events: DataFrame) -> DataFrame:
    """Adds end_from_x and end_from_y: where the receiver next acts in the period."""
    spots = events.select("match_id", "period_id", F.col("object_id").alias("receiver_id"), "action_id", F.col("start_x").alias("end_from_x"), F.col("start_y").alias("end_from_y"))
    return asof(events, spots, ["match_id", "period_id", "receiver_id"], "action_id", ["end_from_x", "end_from_y"], "forward", strict=True).drop("action_id_matched")


def semi(rows: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(keys_of.select(*keys).distinct(), keys, "left_semi")


def anti(rows: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(keys_of.select(*keys).distinct(), keys, "left_anti")


def possible(condition: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(condition, F.lit(False))
