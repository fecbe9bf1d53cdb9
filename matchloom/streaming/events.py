"""Streaming forms of the operators that look back or a bounded way ahead.

Look-ahead labels stay batch: they need rows that haven't come.  What follows keeps bounded state per match and drops it by
watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_episodes(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Episodes as session windows per match: start, end, rows and value of each run of events closer than ``gap``."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy("match_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("match_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Actions per match, kind and window."""
    return events.withWatermark("ts", late).groupBy("match_id", "spadl_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select("match_id", "spadl_type", F.col("w.start").alias("start"), "n")


def filled_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The last known label of each match carried to its later rows (match_id, ts, event_id, label).

    State is one label per match; it goes when a match has been silent past the watermark.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        label = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples():
            label = r.label if r.label is not None and r.label == r.label else label
            out.append((key[0], r.ts, r.event_id, label))
        if label is not None:
            state.update((label,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 600_000)
        yield pd.DataFrame(out, columns=["match_id", "ts", "event_id", "label"])

    rows = events.withWatermark("ts", late)
    return rows.groupBy("match_id").applyInPandasWithState(run, "match_id long, ts timestamp, event_id long, label string", "label string", "append", GroupStateTimeout.EventTimeTimeout)
