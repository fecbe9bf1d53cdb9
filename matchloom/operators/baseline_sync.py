"""The baseline synchroniser as joins, masks and one fold per period.

Windows are interval joins of events to their own player's frames, masks are filters and the three-distance score is a column; only the rule that no event
lies before the one matched last needs order, and that is a fold over a period's events within the row.
"""

from __future__ import annotations

from math import hypot

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..sources.scratch import dealt_once
from . import joins as J
from .sync import score_column

PERIOD = ["match_id", "period_id"]
FAR = hypot(V.PITCH_X, V.PITCH_Y)


def gap(ax: str, ay: str, bx: str, by: str) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return F.sqrt(dx * dx + dy * dy)


def kind_of(types: Column) -> Column:
    """The kind of an event type; null for take-ons and lost balls, which the baseline doesn't match."""
    out = F.lit(None).cast("string")
    for kind, rule in V.BASELINE_KINDS.items():
        out = F.when(types.isin(*rule[0]), kind).otherwise(out)
    return out


def seconds_of(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rule in V.BASELINE_KINDS.items():
        out = F.when(kind == name, F.lit(rule[1])).otherwise(out)
    return out


def mask(kind: Column) -> Column:
    """Whether a frame (player_ball, ball_z, ball_accel) can be an event of that kind; unknown heights and accelerations can't where they are asked for."""
    out = F.lit(False)
    for name, (_, _, near, height, least, most) in V.BASELINE_KINDS.items():
        ok = (F.col("player_ball") <= near) & (F.col("ball_z") <= height)
        ok = ok if least is None else ok & (F.col("ball_accel") >= least)
        ok = ok if most is None else ok & (F.col("ball_accel") <= most)
        out = F.when(kind == name, J.possible(ok)).otherwise(out)
    return out


def plain_score() -> Column:
    """Score of a frame by three distances (player_ball, player_event, ball_event)."""
    return score_column([(F.col(c), 0, FAR, False) for c in ("player_ball", "player_event", "ball_event")])


def known(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def balls(tracking: DataFrame) -> DataFrame:
    return tracking.where("object_id = 'ball'").select(*PERIOD, "frame_id", F.col("x").alias("ball_x"), F.col("y").alias("ball_y"), known("z").alias("ball_z"), known("accel").alias("ball_accel"))


def kickoffs(events: DataFrame, tracking: DataFrame, fps: int) -> DataFrame:
    """Per period with tracking: its first event, first frame and, where one is seen, kickoff frame.

    In the first seconds, while the ball stays near the centre without a break, the sharpest ball with the kicker near it, else the kicker's
    closest frame; ties go to the earlier frame.  None if the first event is no pass or several players of the team stand in the middle at the first frame.
    """
    first = events.groupBy(*PERIOD).agg(F.min_by(F.struct("action_id", "spadl_type", "object_id"), "action_id").alias("_e")).select(*PERIOD, F.col("_e.action_id").alias("first_action"), F.col("_e.spadl_type").alias("_type"), F.col("_e.object_id").alias("_kicker"))
    start = tracking.groupBy(*PERIOD).agg(F.min("frame_id").alias("start_frame"))
    first = J.merged(first).join(J.merged(start), PERIOD)
    middle = (F.abs(F.col("x") - V.PITCH_X / 2) <= 5) & (F.abs(F.col("y") - V.PITCH_Y / 2) <= 5)
    opening = J.merged(tracking).join(J.merged(first), PERIOD).where((F.col("frame_id") - F.col("start_frame")).between(0, fps * V.WINDOW_KICKOFF - 1))
    own = F.substring_index("object_id", "_", 1) == F.substring_index("_kicker", "_", 1)
    crowd = opening.where((F.col("frame_id") == F.col("start_frame")) & own & middle).groupBy(*PERIOD).agg(F.count("*").alias("_crowd"))
    central = (F.abs(F.col("x") - V.PITCH_X / 2) <= 3) & (F.abs(F.col("y") - V.PITCH_Y / 2) <= 3)
    in_order = W.partitionBy(*PERIOD).orderBy("frame_id")
    run = opening.where((F.col("object_id") == "ball") & central).withColumn("_run", F.col("frame_id") - F.row_number().over(in_order))
    run = run.withColumn("_first", F.min("_run").over(W.partitionBy(*PERIOD))).where("_run = _first")
    run = run.select(*PERIOD, "frame_id", F.col("x").alias("ball_x"), F.col("y").alias("ball_y"), known("accel").alias("ball_accel"))
    kicker = opening.where("object_id = _kicker AND _type = 'pass'").select(*PERIOD, "frame_id", "x", "y", "utc")
    both = J.merged(run).join(J.merged(kicker), [*PERIOD, "frame_id"]).withColumn("_gap", gap("x", "y", "ball_x", "ball_y"))
    rank = F.struct(F.col("_gap") >= 2, F.when(F.col("_gap") < 2, -F.coalesce("ball_accel", F.lit(float("-inf")))).otherwise(F.col("_gap")), F.col("frame_id"))
    kick = both.groupBy(*PERIOD).agg(F.min_by(F.struct("frame_id", "utc"), rank).alias("_kick"))
    seen = F.coalesce("_crowd", F.lit(0)) <= 1
    return J.merged(J.merged(first).join(J.merged(crowd), PERIOD, "left")).join(J.merged(kick), PERIOD, "left").select(*PERIOD, "first_action", "start_frame", F.when(seen, F.col("_kick.frame_id")).alias("kick_frame"), F.when(seen, F.col("_kick.utc")).alias("kick_utc"))


def considered(events: DataFrame, frames: DataFrame, tracking: DataFrame, fps: int) -> DataFrame:
    """Frames that may be those of events (with kind and seconds), scored: the event's own player and the ball are tracked there, the mask holds.

    An event without a place scores 0 everywhere, so that its first frame wins.
    """
    at = J.nearest(events, frames, ["match_id"], "utc", ["frame_id"]).where("frame_id IS NOT NULL")
    spans = at.select(*PERIOD, "action_id", "kind", "object_id", "start_x", "start_y", (F.col("frame_id") - fps * F.col("seconds") + 1).alias("_low"), (F.col("frame_id") + fps * F.col("seconds") - 1).alias("_high"))
    points = tracking.select("match_id", "object_id", "frame_id", "x", "y")
    met = J.within(J.merged(points), J.merged(spans), ["match_id", "object_id"], "frame_id", "_low", "_high")
    met = J.merged(met).join(J.merged(balls(tracking).drop("period_id")), ["match_id", "frame_id"])
    met = met.withColumns({"player_ball": gap("x", "y", "ball_x", "ball_y"), "player_event": gap("x", "y", "start_x", "start_y"), "ball_event": gap("ball_x", "ball_y", "start_x", "start_y")})
    return met.where(mask(F.col("kind"))).select(*PERIOD, "action_id", "frame_id", F.coalesce(plain_score(), F.lit(0.0)).alias("score"))


def in_turn(options: Column, last: Column) -> Column:
    """Array of (action_id, frame_id): for each event in turn the best frame that isn't before the one matched last; ties go to the earlier frame."""

    def step(state: Column, event: Column) -> Column:
        left = F.filter(event["options"], lambda o: o["frame_id"] >= state["last"])
        best = F.array_max(F.transform(left, lambda o: F.struct(o["score"].alias("score"), (-o["frame_id"]).alias("back"))))
        return F.transform(
            F.array(-best["back"]), lambda f: F.struct(F.coalesce(f, state["last"]).alias("last"), F.concat(state["found"], F.array(F.struct(event["action_id"].alias("action_id"), f.alias("frame_id")))).alias("found"))
        )[0]

    none = F.array().cast("array<struct<action_id:bigint,frame_id:bigint>>")
    return F.aggregate(options, F.struct(last.alias("last"), none.alias("found")), step, lambda state: state["found"])


def synced(events: DataFrame, tracking: DataFrame, fps: int = V.FPS) -> DataFrame:
    """Every event's frame, or null.

    ``events``: match_id, period_id, action_id (long, once a match), spadl_type, object_id, start_x, start_y, utc (seconds); ``tracking``: match_id, period_id, frame_id (long), object_id or
    ``ball``, utc, x, y, z, accel (scalar).  The clock of a period is set by its kickoff; without one its first event takes the first frame and the clock is set by the second event, or left as it is
    if that has no frame either.  A period without tracking gets nulls.

    Everything is joined within matches, so tracking that is dealt out by match stays there; for that the job runs here and its result is a checkpoint.
    """
    events = events.select(*PERIOD, "action_id", "spadl_type", "object_id", "start_x", "start_y", "utc")
    frames = tracking.groupBy("match_id", "frame_id").agg(F.min("utc").alias("utc"))
    kicks = kickoffs(events, tracking, fps)
    place = F.row_number().over(W.partitionBy(*PERIOD).orderBy("action_id"))
    marked = J.merged(events.withColumn("_place", place)).join(J.merged(kicks), PERIOD, "left")
    second = marked.where("_place = 2 AND kick_frame IS NULL AND start_frame IS NOT NULL").withColumns({"kind": F.lit("pass_like"), "seconds": F.lit(V.WINDOW_KICKOFF)})
    best = considered(second.select(*events.columns, "kind", "seconds"), frames, tracking, fps).groupBy(*PERIOD).agg(F.min_by("frame_id", F.struct(-F.col("score"), "frame_id")).alias("frame_id"))
    guess = J.merged(best).join(J.merged(frames.select("match_id", "frame_id", F.col("utc").alias("_guess"))), ["match_id", "frame_id"]).drop("frame_id")
    setter = F.when(F.col("kick_frame").isNotNull() & (F.col("_place") == 1), F.col("utc") - F.col("kick_utc")).when(F.col("kick_frame").isNull() & (F.col("_place") == 2), F.col("utc") - F.col("_guess"))
    offset = F.coalesce(F.max(setter).over(W.partitionBy(*PERIOD)), F.lit(0.0))
    moved = J.merged(marked).join(J.merged(guess), PERIOD, "left").withColumn("utc", F.col("utc") - offset)
    kind = kind_of(F.col("spadl_type"))
    asked = moved.where("_place > 1").withColumns({"kind": kind, "seconds": seconds_of(kind)}).where("kind IS NOT NULL")
    options = considered(asked.select(*events.columns, "kind", "seconds"), frames, tracking, fps)
    option = F.struct("frame_id", "score")
    every = options.select(*PERIOD, "action_id", option.alias("o")).unionByName(events.select(*PERIOD, "action_id", F.lit(None).cast("struct<frame_id:bigint,score:double>").alias("o")))
    per_event = every.groupBy(*PERIOD, "action_id").agg(F.collect_list("o").alias("options"))
    per_period = per_event.groupBy(*PERIOD).agg(F.sort_array(F.collect_list(F.struct("action_id", "options"))).alias("_events"))
    per_period = J.merged(per_period).join(J.merged(kicks), PERIOD, "left")
    first_frame = F.coalesce("kick_frame", "start_frame")
    found = per_period.select(*PERIOD, "first_action", first_frame.alias("_first"), F.inline(in_turn(F.col("_events"), first_frame)))
    return dealt_once(found.select(*PERIOD, "action_id", F.when(F.col("action_id") == F.col("first_action"), F.col("_first")).otherwise(F.col("frame_id")).alias("frame_id")))
