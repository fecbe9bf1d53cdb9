"""Long tracking: kinematics per object, phases, orientation, possession views, freezing, synthetic actions, shot paths.

Kernels that need order run track by track: rows are sorted within partitions by (match, period, object) and frame, and pass through Arrow in batches; a
task holds one batch and one track, some 70,000 rows for a whole half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vocab import FPS, PITCH_X, PITCH_Y
from . import kernels
from .joins import merged, within

KINEMATICS = "match_id long, period_id int, object_id string, frame_id long, x double, y double, vx double, vy double, speed double, accel double, accel_v double"


def with_kinematics(tracking: DataFrame, fps: float = FPS) -> DataFrame:
    """(match_id, period_id, object_id, frame_id, x, y) with velocity, speed, acceleration and change of speed; match_id may be a string."""

    key = "string" if dict(tracking.dtypes)["match_id"] == "string" else "long"
    names = [c.split()[0] for c in KINEMATICS.split(", ")]

    def tracks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole tracks, one after the other in ``rows``."""
        rows = rows.combine_chunks()
        if not rows.num_rows:
            return
        x, y = (rows.column(c).to_numpy().astype(float) for c in ("x", "y"))
        starts = [0, *(np.nonzero(changes(rows))[0] + 1).tolist(), rows.num_rows]
        parts = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            k = kernels.kinematics(x[a:b], y[a:b], fps)
            parts.append((*(k[c] for c in ("vx", "vy", "speed", "accel")), kernels.speed_change(k["speed"], fps)))
        made = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
        yield from pa.Table.from_arrays([*rows.columns, *made], names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            ends = np.nonzero(changes(rows))[0]
            if len(ends):
                # the last track may go on in the next batch
                yield from tracks(rows.slice(0, int(ends[-1]) + 1))
                held = rows.slice(int(ends[-1]) + 1).to_batches()
        if held:
            yield from tracks(pa.Table.from_batches(held))

    keys = ["match_id", "period_id", "object_id"]
    rows = tracking.select(F.col("match_id").cast(key).alias("match_id"), F.col("period_id").cast("int").alias("period_id"), "object_id", F.col("frame_id").cast("long").alias("frame_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "frame_id").mapInArrow(run, KINEMATICS.replace("match_id long", f"match_id {key}"))


MOTION = ("vx", "vy", "speed", "accel")


def nested_kinematics(rows: DataFrame, tracks: str, count: str, into: str, fps: float = FPS) -> DataFrame:
    """Rows with ``into``, the objects (object_id, x, y and MOTION) of each of their frames 0 to ``count`` - 1, in place of ``tracks``: (period_id, object_id, frame_id, x, y) in that order.

    A row holds whole tracks, so that they meet without being dealt out; all other columns stay.
    """
    kept = [c for c in rows.columns if c not in (tracks, count)]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fields = ("object_id", "x", "y", *MOTION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column, n = batch.column(tracks), batch.column(count).to_numpy()
            flat = column.flatten()
            at = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
            row = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            x, y, frame = (at[c].to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "frame_id"))
            new = np.diff(row) != 0
            for c in ("period_id", "object_id"):
                new |= pa.compute.not_equal(at[c].slice(1), at[c].slice(0, max(len(row) - 1, 0))).to_numpy(zero_copy_only=False) if len(new) else new
            starts = [*([0] if len(row) else []), *(np.nonzero(new)[0] + 1).tolist(), len(row)]
            found = [kernels.kinematics(x[a:b], y[a:b], fps) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            moved = {c: np.concatenate([k[c] for k in found]) if found else np.zeros(0) for c in MOTION}
            first = np.concatenate(([0], np.cumsum(n)))
            slot = first[row] + frame.astype(int)
            order = np.argsort(slot, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=first[-1])))).astype(np.int32)
            made = [at["object_id"].take(pa.array(order)), *[pa.array(c[order]) for c in (x, y, *moved.values())]]
            frames = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(made, list(fields)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), frames)], [*kept, into])

    made = f"`{into}` array<array<struct<object_id:string,{','.join(f'{c}:double' for c in fields[1:])}>>>"
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in kept], made]))


SYNC_TRACKS = "match_id long, period_id int, object_id string, frame_id long, x double, y double, z double, speed double, accel_s double, accel_v double"


def synchroniser_tracks(tracking: DataFrame, fps: float = FPS, apart: int | None = None) -> DataFrame:
    """(match_id, period_id, object_id, frame_id, x, y, z, ball_state) as the synchroniser takes it: places to the centimetre, speed, its change and acceleration, alive frames only.

    Motion is taken over all frames of a period in which the object has a place, dead ones too; these are dropped afterwards.  Frames count as neighbours whatever lies between
    them, unless ``apart`` frames or more do: then a new segment begins.  Segments too short for the windows have nulls.  Only the ball has a height.
    """
    names = [c.split()[0] for c in SYNC_TRACKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_tracks(batches):
            x, y, frame = (rows.column(c).to_numpy().astype(float) for c in ("x", "y", "frame_id"))
            new = changes(rows)
            if apart is not None:
                new |= np.diff(frame) >= apart
            starts = [0, *(np.nonzero(new)[0] + 1).tolist(), rows.num_rows]
            parts = [kernels.sync_kinematics(x[a:b], y[a:b], fps) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            made = [pa.array(np.concatenate([p[c] for p in parts]), from_pandas=True) for c in ("speed", "accel_s", "accel_v")]
            alive = pa.compute.equal(rows.column("ball_state"), "alive")
            own = [rows.column(c) for c in names[:7]]
            yield from pa.Table.from_arrays([*own, *made], names).filter(alive).to_batches()

    keys = ["match_id", "period_id", "object_id"]
    z = F.when(F.col("object_id") == "ball", F.round("z", 2))
    rows = tracking.where("x IS NOT NULL AND y IS NOT NULL").select(
        F.col("match_id").cast("long").alias("match_id"), F.col("period_id").cast("int").alias("period_id"), "object_id", F.col("frame_id").cast("long").alias("frame_id"),
        F.round(F.col("x").cast("double"), 2).alias("x"), F.round(F.col("y").cast("double"), 2).alias("y"), z.cast("double").alias("z"), "ball_state",
    )
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "frame_id").mapInArrow(run, SYNC_TRACKS)


def whole_tracks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole tracks: the last track of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        ends = np.nonzero(changes(rows))[0]
        if len(ends):
            yield rows.slice(0, int(ends[-1]) + 1).combine_chunks()
            held = rows.slice(int(ends[-1]) + 1).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def changes(rows: pa.Table) -> np.ndarray:
    """Whether the row after each one but the last is of another track."""
    out = np.zeros(max(rows.num_rows - 1, 0), bool)
    for c in ("match_id", "period_id", "object_id"):
        column = rows.column(c).combine_chunks()
        out |= pa.compute.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False) if len(out) else out
    return out


def playing_spans(tracking: DataFrame) -> DataFrame:
    """First and last frame with a place, per object."""
    return tracking.where("x IS NOT NULL").groupBy("match_id", "object_id").agg(F.min("frame_id").alias("in_frame"), F.max("frame_id").alias("out_frame"))


def phases(spans: DataFrame, frames: DataFrame) -> DataFrame:
    """Intervals with a constant set of players: (match_id, phase_id, period_id, start_frame, end_frame, active_players).

    Boundaries are players' first frames, the frames after their last, and periods' first frames; intervals without a frame in play are dropped.
    """
    ends = frames.groupBy("match_id", "period_id").agg(F.min("frame_id").alias("start"), F.max("frame_id").alias("end"))
    bounds = spans.select("match_id", F.explode(F.array("in_frame", F.col("out_frame") + 1)).alias("at")).union(ends.select("match_id", F.explode(F.array("start", F.col("end") + 1)))).distinct()
    w = W.partitionBy("match_id").orderBy("at")
    cut = bounds.select("match_id", F.col("at").alias("start_frame"), (F.lead("at").over(w) - 1).alias("end_frame")).where("end_frame IS NOT NULL")
    cut = cut.join(ends, "match_id").where("start_frame >= start AND end_frame <= end").select("match_id", "period_id", "start_frame", "end_frame")
    on = cut.join(spans, "match_id").where("in_frame <= start_frame AND out_frame >= end_frame")
    out = on.groupBy("match_id", "period_id", "start_frame", "end_frame").agg(F.sort_array(F.collect_list("object_id")).alias("active_players"))
    return out.withColumn("phase_id", F.row_number().over(W.partitionBy("match_id").orderBy("start_frame")))


def home_is_left(tracking: DataFrame) -> DataFrame:
    """Per period: whether the lowest mean x belongs to the home team."""
    means = tracking.where(F.col("object_id").rlike(r"^(home|away)_\d+$")).groupBy("match_id", "period_id", "object_id").agg(F.avg("x").alias("mx"))
    return means.groupBy("match_id", "period_id").agg((F.substring(F.min_by("object_id", F.struct("mx", "object_id")), 1, 4) == "home").alias("home_left"))


def rotated(tracking: DataFrame, turn: Column) -> DataFrame:
    """Places and velocities reflected through the centre where ``turn`` holds."""
    flip = {"x": F.lit(PITCH_X) - F.col("x"), "y": F.lit(PITCH_Y) - F.col("y")} | {c: -F.col(c) for c in ("vx", "vy") if c in tracking.columns}
    return tracking.withColumns({c: F.when(turn, e).otherwise(F.col(c)) for c, e in flip.items()})


def home_left(tracking: DataFrame) -> DataFrame:
    """Every period with the home team on the left; orientation has one row per period, so it is small."""
    side = home_is_left(tracking)
    return rotated(tracking.join(side, ["match_id", "period_id"], "left"), ~F.coalesce("home_left", F.lit(True))).drop("home_left")


def frozen(tracking: DataFrame, anchors: DataFrame) -> DataFrame:
    """After the receipt, the carrier and the ball keep the places they had then.

    ``anchors`` has one row per situation: (situation_id, anchor_frame, carrier_id); situations with more rows are refused by ``anchor_faults``.
    """
    at = tracking.join(anchors, "situation_id")
    held = at.where("frame_id = anchor_frame AND (object_id = carrier_id OR object_id = 'ball')").select("situation_id", "object_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    out = tracking.join(anchors.select("situation_id", "anchor_frame"), "situation_id", "left").join(held, ["situation_id", "object_id"], "left")
    after = (F.col("frame_id") > F.col("anchor_frame")) & F.col("_x").isNotNull()
    return out.withColumns({"x": F.when(after, F.col("_x")).otherwise(F.col("x")), "y": F.when(after, F.col("_y")).otherwise(F.col("y"))}).drop("_x", "_y", "anchor_frame")


def anchor_faults(receipts: DataFrame) -> DataFrame:
    """Situations without exactly one receipt row."""
    return receipts.groupBy("situation_id").agg(F.count("*").alias("n")).where("n <> 1")


def possession_view(frames: DataFrame, possessions: DataFrame, bucket: int = 500) -> DataFrame:
    """Frames of each possession with one frame of context before it, turned so that the possession attacks to the right and calls itself home.

    A possession is dealt to every ``bucket`` of frames that it touches; with buckets about as long as possessions are, these are two or three.
    """
    spans = possessions.select("match_id", "possession_id", F.col("team").alias("_team"), "right_to_left", (F.col("frame_start") - 1).alias("_a"), F.col("frame_end").alias("_b"))
    rows = within(frames, spans, ["match_id"], "frame_id", "_a", "_b", bucket)
    name = F.when(F.col("object_id").rlike("^(home|away)"), F.concat(F.when(F.substring("object_id", 1, 4) == F.col("_team"), "home").otherwise("away"), F.expr("substring(object_id, 5)"))).otherwise(F.col("object_id"))
    return rotated(rows.withColumn("object_id", name), F.col("right_to_left")).withColumn("has_ball", F.col("frame_id") > F.col("_a")).drop("_a", "_b", "_team", "right_to_left")


def overlapping(possessions: DataFrame) -> DataFrame:
    """Possessions that begin before the previous one of their match has ended."""
    w = W.partitionBy("match_id").orderBy("frame_start", "frame_end")
    return possessions.withColumn("_end", F.lag("frame_end").over(w)).where("frame_start <= _end").drop("_end")


def goals(frames: DataFrame) -> DataFrame:
    """Two goal objects per frame."""
    spots = F.array(F.struct(F.lit("home_goal").alias("object_id"), F.lit(PITCH_X).alias("x"), F.lit(PITCH_Y / 2).alias("y")), F.struct(F.lit("away_goal").alias("object_id"), F.lit(0.0).alias("x"), F.lit(PITCH_Y / 2).alias("y")))
    return frames.select("match_id", "frame_id", F.inline(spots))


def frame_actions(frames: DataFrame, possessors: DataFrame) -> DataFrame:
    """Each frame as a pass to oneself, with the reason why a frame can't be one."""
    rows = frames.join(possessors, ["match_id", "frame_id"], "left")
    reason = F.when(F.col("ball_x").isNull(), "no_ball").when(F.col("possessor").isNull(), "no_possessor").when(F.col("poss_x").isNull(), "no_snapshot").otherwise("kept")
    w = W.partitionBy("match_id").orderBy("frame_id")
    rows = rows.withColumn("reason", reason)
    kept = F.sum(F.when(F.col("reason") == "kept", 1).otherwise(0)).over(w) - 1
    return rows.withColumns({"action_id": F.when(F.col("reason") == "kept", kept), "spadl_type": F.lit("pass"), "receiver_id": F.col("possessor"), "success": F.lit(True)})


def shot_anomalies(shots: DataFrame, ball: DataFrame) -> DataFrame:
    """(match_id, action_id, anomaly, woodwork) of shots (frame_id, receive_frame_id) from ball places (match_id, frame_id, x, y).

    The join is bounded by each shot's own frames; a shot's path is gathered to one row, so that shots go through the kernel in batches.
    """
    path = shots.select("match_id", "action_id", F.col("frame_id").alias("_a"), F.col("receive_frame_id").alias("_b"))
    path = within(merged(ball.select("match_id", "frame_id", "x", "y")), merged(path), ["match_id"], "frame_id", "_a", "_b")
    places = F.struct("frame_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    path = path.groupBy("match_id", "action_id").agg(F.sort_array(F.collect_list(places)).alias("_p"), F.first(F.col("_b") - F.col("_a")).alias("frames"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            ends = (x.offsets.to_numpy() - x.offsets[0].as_py()).tolist()
            at = np.stack([c.flatten().to_numpy(zero_copy_only=False) for c in (x, y)], -1)
            found = [kernels.shot_anomaly(at[i:j], n) for i, j, n in zip(ends[:-1], ends[1:], batch.column("frames").to_pylist(), strict=True)]
            odd, wood = (pa.array([f[i] for f in found], pa.bool_()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("match_id"), batch.column("action_id"), odd, wood], ["match_id", "action_id", "anomaly", "woodwork"])

    paths = path.select("match_id", "action_id", "frames", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    found = paths.mapInArrow(run, "match_id long, action_id long, anomaly boolean, woodwork boolean")
    out = merged(shots.select("match_id", "action_id")).join(merged(found), ["match_id", "action_id"], "left")
    return out.na.fill(False, ["anomaly", "woodwork"])


def delaunay(snapshots: DataFrame, key: str = "event_id") -> DataFrame:
    """Edges (source, target) of the triangulation of each snapshot's players, in batches of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordinals, x, y = (batch.column(c) for c in ("ordinal", "x", "y"))
            ends = (ordinals.offsets.to_numpy() - ordinals.offsets[0].as_py()).tolist()
            names, at = ordinals.flatten().to_numpy(zero_copy_only=False), np.stack([c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (x, y)], -1)
            for first in range(0, batch.num_rows, 1000):
                edges, rows = [], []
                for i in range(first, min(first + 1000, batch.num_rows)):
                    found = kernels.delaunay_edges(at[ends[i] : ends[i + 1]])
                    edges.append(np.array(found, int).reshape(-1, 2) + ends[i])
                    rows.append(np.full(len(found), i))
                ij = names[np.concatenate(edges)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.concatenate(rows))), pa.array(ij[:, 0]), pa.array(ij[:, 1])], [key, "source", "target"])

    nodes = [F.col(f"players.{c}").alias(c) for c in ("ordinal", "x", "y")]
    return snapshots.select(key, *nodes).mapInArrow(run, f"{key} long, source int, target int")
