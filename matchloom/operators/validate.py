"""Counts of rows that break a table's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import ACTION_TYPES, PITCH_X, PITCH_Y


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n) for every rule in one pass; a rule that is null counts as broken."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n")


def event_rules() -> dict[str, Column]:
    return {
        "period_id": F.col("period_id").isin(1, 2),
        "ts": F.col("ts").isNotNull(),
        "object_id": F.col("object_id").rlike(r"^(home|away)_\d+$"),
        "spadl_type": F.col("spadl_type").isin(*ACTION_TYPES),
        "success": F.col("success").isNotNull(),
        "start_x": F.col("start_x").between(0, PITCH_X),
        "start_y": F.col("start_y").between(0, PITCH_Y),
    }


def baseline_rules() -> dict[str, Column]:
    """The baseline synchroniser's input: events with a start on the pitch."""
    return {k: c for k, c in event_rules().items() if k != "object_id"} | {"player_id": F.col("player_id").isNotNull()}


def synced_rules() -> dict[str, Column]:
    """Synced events: a frame is a whole number from 0 on, or missing."""
    whole = (F.col("frame_id") >= 0) & (F.col("frame_id") == F.floor("frame_id"))
    return {"period_id": F.col("period_id").isin(1, 2), "ts": F.col("ts").isNotNull(), "frame_id": F.col("frame_id").isNull() | whole, "player_id": F.col("player_id").isNotNull(), "spadl_type": F.col("spadl_type").isin(*ACTION_TYPES), "success": F.col("success").isNotNull()}


def tracking_rules() -> dict[str, Column]:
    return {
        "frame_id": (F.col("frame_id") >= 0) & (F.col("frame_id") == F.floor("frame_id")),
        "period_id": F.col("period_id").isin(1, 2),
        "player_id": F.col("player_id").isNotNull() != F.col("ball"),
        "z": F.col("z").isNull() | (F.col("ball") & (F.col("z") >= 0)),
        "x": F.col("x").isNotNull(),
        "y": F.col("y").isNotNull(),
    }


def contiguous(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Keys whose numbers aren't 0 to n - 1."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"), F.count_distinct(number).alias("kinds")).where("low <> 0 OR high <> n - 1 OR kinds <> n")


def same_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys with different numbers of rows in two artifacts."""
    x, y = a.groupBy(key).agg(F.count("*").alias("left_n")), b.groupBy(key).agg(F.count("*").alias("right_n"))
    return x.join(y, key, "full").na.fill(0, ["left_n", "right_n"]).where("left_n <> right_n")
