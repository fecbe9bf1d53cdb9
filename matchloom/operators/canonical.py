"""From provider tables to the canonical event table: period starts, typing of a second provider, frame tables, synced output and its audit, value actions.

Frames are long tables; every lookup is a keyed left join, never a join by row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vocab import ACTION_TYPES, FPS, PITCH_X, PITCH_Y, RECEIVE_TYPES, VALUE_GRID_TYPES
from .joins import asof

# Places of the action types and results of the value grid in their public lists.
TYPE_IDS = {"pass": 0, "cross": 1, "shot": 11}
FAIL, SUCCESS, OFFSIDE = 0, 1, 2

# Column order of the exported event table.
PREFERRED = (
    "event_id", "event_type", "period_id", "seconds", "end_seconds", "timestamp", "end_timestamp", "ball_state", "ball_owning_team", "team_id", "player_id", "receiver_player_id", "coordinates_x", "coordinates_y",
    "end_coordinates_x", "end_coordinates_y", "set_piece_type", "result", "success", "body_part_type", "card_type",
)


def period_starts(events: DataFrame, is_kickoff: Column, order: str = "action_id", kickoffs: DataFrame | None = None) -> DataFrame:
    """Start of each period: its first kickoff, else its first event; the announced kickoff (match_id, kickoff) where a first period has no event at all."""
    e = events.where("period_id > 0")
    starts = e.groupBy("match_id", "period_id").agg(F.coalesce(F.min_by(F.when(is_kickoff, F.col("ts")), F.when(is_kickoff, F.col(order))), F.min_by("ts", order)).alias("start"))
    if kickoffs is None:
        return starts
    silent = kickoffs.join(starts.where("period_id = 1"), "match_id", "left_anti").select("match_id", F.lit(1).alias("period_id"), F.col("kickoff").alias("start"))
    return starts.unionByName(silent)


def canonical_events(actions: DataFrame, lineup: DataFrame, raw: DataFrame, starts: DataFrame) -> DataFrame:
    """Canonical events: xG of the raw event, time on the clock of day, the player's object, name and position; unknown types and players without an object go."""
    xg = raw.select("match_id", F.col("event_id").cast("string").alias("original_event_id"), F.col("expected_goal").cast("double").alias("expected_goal"))
    who = lineup.select("match_id", "player_id", "object_id", F.col("match_name").alias("player_name"), "advanced_position")
    a = actions.where(F.col("type_name").isin(*ACTION_TYPES)).withColumn("original_event_id", F.col("original_event_id").cast("string"))
    a = a.join(xg, ["match_id", "original_event_id"], "left").join(who, ["match_id", "player_id"]).where("object_id IS NOT NULL").join(starts, ["match_id", "period_id"])
    return a.select(
        F.col("match_id").alias("stats_perform_match_id"), "action_id", "original_event_id", "period_id", F.col("time_seconds").alias("seconds"),
        F.timestamp_micros(F.unix_micros(F.col("start").cast("timestamp")) + F.round(F.col("time_seconds") * 1_000_000).cast("long")).cast("timestamp_ntz").alias("utc_timestamp"),
        "player_id", "object_id", "player_name", "advanced_position", "team_id", F.col("type_name").alias("spadl_type"), (F.col("result_name") == "success").alias("success"), (F.col("result_name") == "offside").alias("offside"), "expected_goal",
        "start_x", "start_y", "end_x", "end_y",
    )


def exported(events: DataFrame, zero: str = "start") -> DataFrame:
    """The event table for export: seconds since ``zero`` beside the times, known columns first and in their usual order."""
    since = lambda c: ((F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.col(zero).cast("timestamp"))) / F.lit(1e6)).alias("_")
    more = {to: since(c) for c, to in (("timestamp", "seconds"), ("end_timestamp", "end_seconds")) if c in events.columns}
    out = events.withColumns(more).drop(zero)
    return out.select(*[c for c in PREFERRED if c in out.columns], *[c for c in out.columns if c not in PREFERRED])


def frame_table(frames: DataFrame, zone: str = "Europe/Berlin") -> DataFrame:
    """One row per frame: (match_id, period_id, frame_id, timestamp, utc_timestamp), with the match clock as text and local time."""
    one = frames.groupBy("match_id", "frame_id").agg(*[F.min_by(c, F.struct("period_id", "timestamp")).alias(c) for c in ("period_id", "timestamp", "utc_timestamp")])
    return one.select("match_id", "frame_id", "period_id", "timestamp", "utc_timestamp", G.clock(F.col("timestamp")).alias("synced_ts"), F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("utc_timestamp")).alias("local_tracking_time"))


def finalized(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Synced events with clock texts, cut after the last synced one of the match, and with what follows in the period; a match without any stays whole."""
    clock = frames.select("match_id", "frame_id", "synced_ts")
    e = events.join(clock, ["match_id", "frame_id"], "left")
    e = e.join(clock.select("match_id", F.col("frame_id").alias("receive_frame_id"), F.col("synced_ts").alias("receive_ts")), ["match_id", "receive_frame_id"], "left")
    order = F.struct("period_id", "seconds", "action_id")
    e = e.withColumn("_last", F.max(F.when(F.col("frame_id").isNotNull(), order)).over(W.partitionBy("match_id"))).where(F.col("_last").isNull() | (order <= F.col("_last"))).drop("_last")
    w = W.partitionBy("match_id", "period_id").orderBy("seconds", "action_id")
    return e.withColumns({"next_player_id": F.lead("object_id").over(w), "next_type": F.lead("spadl_type").over(w)})


def provider_synced(events: DataFrame, provider: DataFrame, frames: DataFrame, lineup: DataFrame, fallback: DataFrame) -> DataFrame:
    """Frames and receivers by the provider's file, gaps filled by the synchroniser's table ``fallback`` (match_id, action_id, frame_id, receive_frame_id, receiver_id).

    Needs match_id, action_id, original_event_id, spadl_type on events and EVENT_ID, FRAME_NUMBER, RECFRM, PUID2, NORECEIVER on ``provider``; frames that the
    tracking doesn't have count as missing.  ``_by_provider``, ``_frame_filled`` and ``_receive_filled`` are for the audit.
    """
    known = frames.select("match_id", "frame_id").distinct()
    k = provider.groupBy("match_id", "EVENT_ID").agg(F.first(F.struct("FRAME_NUMBER", "RECFRM", "PUID2", "NORECEIVER")).alias("_k"))
    e = events.join(k.withColumnRenamed("EVENT_ID", "original_event_id"), ["match_id", "original_event_id"], "left")
    for c, name in (("FRAME_NUMBER", "_frame"), ("RECFRM", "_receive")):
        valid = known.select("match_id", F.col("frame_id").alias(name), F.lit(True).alias("_valid"))
        e = e.withColumn(name, F.col(f"_k.{c}")).join(valid, ["match_id", name], "left").withColumn(name, F.when(F.col("_valid"), F.col(name))).drop("_valid")
    e = e.withColumn("_puid", F.col("_k.PUID2")).join(lineup.select("match_id", F.col("player_id").alias("_puid"), F.col("object_id").alias("_receiver")), ["match_id", "_puid"], "left")
    e = e.join(fallback.select("match_id", "action_id", F.lit(True).alias("_has"), F.col("frame_id").alias("_f0"), F.col("receive_frame_id").alias("_r0"), F.col("receiver_id").alias("_w0")), ["match_id", "action_id"], "left")
    passes = F.col("spadl_type").isin(*RECEIVE_TYPES)
    receiver = F.when(passes, F.coalesce("_receiver", F.when(F.coalesce("_k.NORECEIVER", F.lit(False)), F.lit("out"))))
    has = F.coalesce("_has", F.lit(False))
    e = e.withColumns({"_receive": F.when(passes, F.col("_receive")), "_who": receiver})
    needs_frame, needs_receive = F.col("_frame").isNull(), passes & (F.col("_receive").isNull() | F.col("_who").isNull())
    return e.select(
        *events.columns, F.coalesce("_frame", F.when(has, F.col("_f0"))).alias("frame_id"), F.when(needs_receive & has, F.col("_r0")).otherwise(F.col("_receive")).alias("receive_frame_id"),
        F.coalesce("_who", F.when(passes & has, F.col("_w0"))).alias("receiver_id"), F.col("_k").isNotNull().alias("_by_provider"), F.col("_frame").isNotNull().alias("_by_frame"), F.col("_receive").isNotNull().alias("_by_receive"),
        (needs_frame & has).alias("_frame_filled"), (needs_receive & has).alias("_receive_filled"),
    )


def sync_audit(synced: DataFrame) -> DataFrame:
    """Per match, how many events and frames the provider matched, how many the synchroniser filled, and how many rows have a frame in the end."""
    return synced.groupBy("match_id").agg(
        F.count_if("_by_provider").alias("event_matches"), F.count_if("_by_frame").alias("frame_matches"), F.count_if("_by_receive").alias("receive_matches"), F.count_if("_frame_filled").alias("frame_fallbacks"),
        F.count_if("_receive_filled").alias("receive_fallbacks"), F.count_if(F.col("frame_id").isNotNull()).alias("synced_rows"), F.count_if(F.col("receive_frame_id").isNotNull()).alias("receive_rows"),
    )


def time_comparison(synced: DataFrame, frames: DataFrame, provider: DataFrame) -> DataFrame:
    """Local time of each event's frame against the provider's, and the difference in seconds."""
    local = frames.select("match_id", "frame_id", F.col("local_tracking_time").alias("time_synced"))
    theirs = provider.select("match_id", F.col("EVENT_ID").alias("original_event_id"), F.col("TRACKING_TIME").alias("time_provider"))
    e = synced.select("match_id", "original_event_id", "period_id", "frame_id").join(local, ["match_id", "frame_id"], "left").join(theirs, ["match_id", "original_event_id"], "left")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return e.select("match_id", F.col("original_event_id").alias("event_id"), F.col("period_id").alias("period"), "time_synced", "time_provider", ((micros("time_synced") - micros("time_provider")) / F.lit(1e6)).alias("time_dif"))


def backfilled_places(events: DataFrame, tracking: DataFrame) -> DataFrame:
    """Missing places from tracking: start by the player and the ball's height at the event's frame, end by the ball at the receipt's."""
    t = tracking.select("match_id", "frame_id", F.col("object_id").alias("_o"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"))
    ball = t.where("_o = 'ball'")
    e = events.join(t.select("match_id", "frame_id", F.col("_o").alias("object_id"), F.col("_x").alias("start_x"), F.col("_y").alias("start_y")), ["match_id", "frame_id", "object_id"], "left")
    e = e.join(ball.select("match_id", "frame_id", F.col("_z").alias("start_z")), ["match_id", "frame_id"], "left")
    return e.join(ball.select("match_id", F.col("frame_id").alias("receive_frame_id"), F.col("_x").alias("end_x"), F.col("_y").alias("end_y")), ["match_id", "receive_frame_id"], "left")


def prior_frames(actions: DataFrame, tracking: DataFrame, offsets: tuple[int, ...] = (0, 12, 25)) -> DataFrame:
    """For each action and offset the last frame of the phase, at least that many frames back, that has the possessor; offset 0 is the frame itself, and the others need one.

    ``tracking`` is (match_id, phase_id, object_id, frame_id) of placed objects; actions carry the phase of their frame.
    """
    at = actions.select("*", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset"))
    now, back = at.where("offset <= 0").withColumn("prior_frame", F.col("frame_id")), at.where("offset > 0 AND phase_id IS NOT NULL")
    back = back.withColumn("_at", F.col("frame_id") - F.col("offset"))
    placed = tracking.select("match_id", "phase_id", "object_id", F.col("frame_id").alias("_at"), F.col("frame_id").alias("prior_frame"))
    found = asof(back, placed, ["match_id", "phase_id", "object_id"], "_at", ["prior_frame"]).where("prior_frame IS NOT NULL")
    return now.unionByName(found.select(*now.columns))


def merged_tracking(tracking: DataFrame, events: DataFrame, values: list[str], fps: float = FPS, fill: bool = False) -> DataFrame:
    """Tracking with the events at each frame's time, one row per event where there are several; ``fill`` repeats the last event."""
    at = F.round(F.rint(F.col("timestamp") * F.lit(float(fps))) / F.lit(float(fps)), 2)
    e = events.withColumn("timestamp", at).select("match_id", "period_id", "timestamp", "action_id", *values)
    out = tracking.join(e, ["match_id", "period_id", "timestamp"], "left")
    if not fill:
        return out
    w = W.partitionBy("match_id", "period_id").orderBy("timestamp", "action_id").rowsBetween(W.unboundedPreceding, 0)
    return out.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in values})


def value_actions(events: DataFrame) -> DataFrame:
    """The value grid's view of events: ids of type, result and body part, and xG."""
    kinds = F.create_map(*[F.lit(x) for pair in TYPE_IDS.items() for x in pair])
    lost = ~F.col("success")
    result = F.when(F.coalesce("offside", F.lit(False)), OFFSIDE).when(lost, FAIL).otherwise(SUCCESS)
    return events.where(F.col("spadl_type").isin(*VALUE_GRID_TYPES)).withColumns({"type_id": kinds[F.col("spadl_type")], "result_id": result, "bodypart_id": F.lit(0), "xG": F.col("expected_goal").cast("double")})


def with_sidecar(events: DataFrame, sidecar: DataFrame, values: tuple[str, ...] = ("xT", "scores_xT", "concedes_xT")) -> DataFrame:
    """Value columns of the sidecar in place of the events' own; matches without a sidecar keep theirs."""
    s = sidecar.select("match_id", "action_id", F.lit(True).alias("_found"), *[F.col(v).alias(f"_{v}") for v in values])
    there = sidecar.select("match_id", F.lit(True).alias("_there")).distinct()
    e = events.join(s, ["match_id", "action_id"], "left").join(there, "match_id", "left")
    own = {v: (F.col(v) if v in events.columns else F.lit(None).cast("double")) for v in values}
    return e.withColumns({v: F.when(F.col("_there"), F.col(f"_{v}")).otherwise(own[v]) for v in values}).drop("_there", "_found", *[f"_{v}" for v in values])


def object_ids(tracked: DataFrame) -> DataFrame:
    """The object of each player, by the first player id that each object's tracking shows; of two objects with one player the later name counts."""
    first = tracked.where("player_id IS NOT NULL").groupBy("match_id", "object_id").agg(F.min_by("player_id", "frame_id").alias("player_id"))
    return first.groupBy("match_id", "player_id").agg(F.max("object_id").alias("object_id"))


def keeper_objects(players: DataFrame, possessor: DataFrame) -> DataFrame:
    """Object ids of keepers relative to the possession: ``home_`` for the possessor's team."""
    side = players.join(possessor, ["match_id", "player_id"]).select("match_id", "possession_id", F.col("team_id").alias("_with"))
    keepers = players.where("is_goalkeeper").join(side, "match_id")
    return keepers.select("match_id", "possession_id", F.concat(F.when(F.col("team_id") == F.col("_with"), "home_").otherwise("away_"), F.col("player_id").cast("string")).alias("object_id"))


def home_team(events: DataFrame, prefix: str = "home_") -> DataFrame:
    """The team of the home objects in each match; null unless there is exactly one."""
    homes = events.groupBy("match_id").agg(F.min(F.when(F.col("object_id").startswith(prefix), F.col("team_id"))).alias("_a"), F.max(F.when(F.col("object_id").startswith(prefix), F.col("team_id"))).alias("_b"))
    return homes.select("match_id", F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias("home_team_id"))


def requested(rows: DataFrame, key: str, ids: list | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the requested ids, or all; of these the first ``limit`` in order of the key."""
    out = rows.where(F.col(key).isin(ids)) if ids else rows
    if limit is None:
        return out
    first = out.select(key).distinct().orderBy(key).limit(limit)
    return out.join(first, key, "left_semi")


def resolved(requests: DataFrame, events: DataFrame, modelled: DataFrame, id_column: str) -> DataFrame:
    """What each requested id stands for: found with its action_id, missing, ambiguous, or not modelled."""
    hits = events.groupBy("match_id", id_column).agg(F.count("*").alias("n_found"), F.min("action_id").alias("action_id"))
    r = requests.join(hits, ["match_id", id_column], "left").join(modelled.select("match_id", "action_id", F.lit(True).alias("_m")).distinct(), ["match_id", "action_id"], "left")
    n = F.coalesce("n_found", F.lit(0))
    status = F.when(n == 0, "missing").when(n > 1, "ambiguous").when(F.col("_m"), "found").otherwise("not modelled")
    return r.select(*requests.columns, n.alias("n_found"), status.alias("status"), F.when(status == "found", F.col("action_id")).alias("action_id"))


def second_provider_types(events: DataFrame) -> DataFrame:
    """Action types, success and offside of a provider whose events are typed by name, with flags ``cross`` and ``penalty``.

    Neighbours are those of the same match by time and number.  Needs match_id, ts, action_id, period_id, action_type, free_kick_type, cross, penalty, outcome, expected_goal, start_x, start_y, player_id, advanced_position.
    """
    w = W.partitionBy("match_id").orderBy("ts", "action_id")
    kind, yes = F.col("action_type"), lambda c: F.coalesce(c, F.lit(False))
    cross, penalty = yes(F.col("cross")), yes(F.col("penalty"))
    centre = (F.abs(F.col("start_x") - PITCH_X / 2) <= 3) & (F.abs(F.col("start_y") - PITCH_Y / 2) <= 3)
    free = (kind == "free_kick") & F.col("free_kick_type").isNotNull()
    aimed = F.col("expected_goal").isNotNull()
    keeper = lambda c: yes(c == "goal_keeper")
    # a later rule beats an earlier one, so the last comes first here
    spadl = (
        F.when(kind.isin("throw_in", "take_on", "tackle", "interception", "clearance", "bad_touch", "ball_recovery", "dispossessed", "foul"), kind)
        .when(kind == "keeper_sweeper", F.when(keeper(F.lead("advanced_position").over(w)), "keeper_sweeper").otherwise("clearance"))
        .when(kind == "keeper_pick-up", "keeper_pick_up").when(kind == "punch", "keeper_punch").when(kind == "claim", "keeper_claim")
        .when(kind == "save", F.when(keeper(F.col("advanced_position")), "keeper_save").otherwise("shot_block"))
        .when(kind == "ball_touch", "bad_touch").when(kind == "attempted_tackle", "tackle")
        .when(free & aimed, "shot_freekick").when(kind == "goal_attempt", F.when(penalty, "shot_penalty").otherwise("shot"))
        .when(kind == "goal_kick", "goalkick").when(kind == "corner", F.when(cross, "corner_crossed").otherwise("corner_short"))
        .when(free, F.when(cross, "freekick_crossed").otherwise("freekick_short"))
        .when(kind == "free_kick", "foul").when(kind.contains("pass"), F.when(cross, "cross").otherwise("pass"))
    )
    e = events.withColumns({"spadl_type": spadl, "_centre": yes(centre)})
    shot, set_shot = yes(F.col("spadl_type").isin("shot", "shot_freekick", "shot_penalty")), yes(F.col("spadl_type").isin("shot", "shot_freekick"))
    goal = shot & yes(F.lead("period_id", 1).over(w) == F.col("period_id")) & yes(F.lead("_centre", 1).over(w))
    goal = goal | (set_shot & yes(F.lead("action_type", 1).over(w) == "attempted_tackle") & yes(F.lead("period_id", 2).over(w) == F.col("period_id")) & yes(F.lead("_centre", 2).over(w)))
    success = F.when(kind == "attempted_tackle", False).when(shot, goal).when(kind.contains("_pass"), False).otherwise(F.col("outcome"))
    aerial = yes(F.lag("action_type").over(w) == "aerial") & yes(F.lag("player_id").over(w) == F.col("player_id"))
    return e.withColumns({"success": success, "offside": yes(kind == "offside_pass"), "aerial": aerial}).drop("_centre")


def sync_input(events: DataFrame) -> DataFrame:
    """The seven columns that the synchroniser reads, in order of time."""
    return events.select("match_id", "period_id", F.col("ts").alias("utc_timestamp"), F.col("object_id").alias("player_id"), "spadl_type", "success", "action_id")


def fit_input(actions: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions of available training matches, and why the other training matches are left out."""
    there = actions.groupBy("match_id").agg(F.count("*").alias("n"))
    m = matches.join(there, "match_id", "left")
    reason = F.when(F.col("split") != "train", "not in the split").when(F.col("n").isNull(), "no actions").otherwise("used")
    m = m.select("match_id", "split", reason.alias("reason"))
    return actions.join(m.where("reason = 'used'").select("match_id"), "match_id", "left_semi"), m
