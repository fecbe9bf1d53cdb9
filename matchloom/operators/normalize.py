"""Normalising raw events: clocks, playing time, orientation, types, ends, splits."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vocab import PITCH_X, PITCH_Y, SHOTS


def period_bounds(events: DataFrame, kickoff: str = "KickOff", whistle: str = "FinalWhistle") -> DataFrame:
    """Start and length of each period: first kickoff (else first event) and last final whistle (else last event)."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.coalesce(F.min(F.when(F.col("event_type") == kickoff, micros)), F.min(micros))
    end = F.coalesce(F.max(F.when(F.col("event_type") == whistle, micros)), F.max(micros))
    return events.groupBy("match_id", "period_id").agg(start.alias("start"), end.alias("end")).withColumn("length", (F.col("end") - F.col("start")) / F.lit(1e6))


def match_clock(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds clock: seconds of the earlier periods and of this one so far, never before its start."""
    w = W.partitionBy("match_id").orderBy("period_id").rowsBetween(W.unboundedPreceding, -1)
    before = bounds.withColumn("_before", F.coalesce(F.sum("length").over(w), F.lit(0.0))).select("match_id", "period_id", F.col("start").alias("_start"), "_before")
    gone = (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("_start")) / F.lit(1e6)
    return events.join(before, ["match_id", "period_id"]).withColumn("clock", F.col("_before") + F.greatest(gone, F.lit(0.0))).drop("_start", "_before")


def minutes_played(lineup: DataFrame, substitutions: DataFrame, reds: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds start_time, end_time and mins_played: starters from 0, substitutes from when they came on, to going off, a red card or the end.

    ``substitutions``: match_id, clock, player_in, player_out; ``reds``: match_id, clock, player_id; ``ends``: match_id, end_clock.
    """
    moves = substitutions.select("match_id", F.explode(F.array(F.struct(F.col("player_in").alias("player_id"), F.col("clock").alias("i"), F.lit(None).cast("double").alias("o")), F.struct(F.col("player_out").alias("player_id"), F.lit(None).cast("double").alias("i"), F.col("clock").alias("o")))).alias("m"))
    moves = moves.select("match_id", "m.*").groupBy("match_id", "player_id").agg(F.max("i").alias("_in"), F.max("o").alias("_out"))
    off = reds.groupBy("match_id", "player_id").agg(F.min("clock").alias("_red"))
    rows = lineup.join(moves, ["match_id", "player_id"], "left").join(off, ["match_id", "player_id"], "left").join(ends, "match_id", "left")
    start = F.coalesce("_in", F.when(F.col("starting"), F.lit(0.0)))
    end = F.when(start.isNotNull(), F.greatest(start, F.least(F.coalesce("_out", "end_clock"), F.coalesce("_red", "end_clock"))))
    rows = rows.withColumns({"start_time": start, "end_time": end})
    return rows.withColumn("mins_played", F.coalesce(F.floor((F.col("end_time") - F.col("start_time")) / 60 * 100 + 0.5) / 100, F.lit(0.0))).drop("_in", "_out", "_red", "end_clock")


def keeper_oriented(events: DataFrame, keepers: DataFrame) -> DataFrame:
    """Periods in which the home keeper acts to the right of the away keeper on average are reflected; without both, nothing is.

    ``keepers``: match_id, object_id.
    """
    acts = events.join(keepers, ["match_id", "object_id"], "left_semi")
    means = acts.groupBy("match_id", "period_id").agg(F.avg(F.when(F.col("team") == "home", F.col("start_x"))).alias("_h"), F.avg(F.when(F.col("team") == "away", F.col("start_x"))).alias("_a"))
    turn = F.coalesce(F.col("_h") > F.col("_a"), F.lit(False))
    half_up = lambda c: F.floor(c * 100 + 0.5) / 100
    out = events.join(means, ["match_id", "period_id"], "left")
    return out.withColumns({"start_x": F.when(turn, half_up(PITCH_X - F.col("start_x"))).otherwise(F.col("start_x")), "start_y": F.when(turn, half_up(PITCH_Y - F.col("start_y"))).otherwise(F.col("start_y"))}).drop("_h", "_a")


def strict_type(kind: Column, set_piece: Column) -> Column:
    """Action type of a raw type (Pass, Cross, Shot, Foul) and set piece; what is none of them has none."""
    return (
        F.when(kind == "Pass", F.when(set_piece == "ThrowIn", "throw_in").when(set_piece == "GoalKick", "goalkick").when(set_piece == "CornerKick", "corner_short").when(set_piece == "FreeKick", "freekick_short").otherwise("pass"))
        .when(kind == "Cross", F.when(set_piece == "CornerKick", "corner_crossed").when(set_piece == "FreeKick", "freekick_crossed").otherwise("cross"))
        .when(kind == "Shot", F.when(set_piece == "FreeKick", "shot_freekick").when(set_piece == "Penalty", "shot_penalty").otherwise("shot"))
        .when(kind == "Foul", "foul")
    )


# Result and body-part ids of the action format.
RESULTS = {"fail": 0, "success": 1, "offside": 2, "owngoal": 3, "yellow_card": 4, "red_card": 5}
BODY_PARTS = {"foot": 0, "head": 1, "other": 2, "head/other": 3, "foot_left": 4, "foot_right": 5}
PASS_LIKE = ("pass", "cross", "throw_in", "freekick_crossed", "freekick_short", "corner_crossed", "corner_short", "goalkick")


def result_id(kind: Column, result: Column, success: Column) -> Column:
    """Result id: a pass that was offside, else success of passes and shots, else failure (fouls always fail)."""
    pass_like, shot = kind.isin(*PASS_LIKE), kind.isin(*SHOTS)
    return F.when((F.lower(result) == "offside") & pass_like, RESULTS["offside"]).when((pass_like | shot) & success, RESULTS["success"]).otherwise(RESULTS["fail"])


def body_part_id(kind: Column, part: Column) -> Column:
    """Body-part id: feet for passes, hands (other) for throw-ins, what is told for shots, other for the rest."""
    shot = F.when(part == "Head", BODY_PARTS["head"]).when(part == "LeftFoot", BODY_PARTS["foot_left"]).when(part == "RightFoot", BODY_PARTS["foot_right"]).otherwise(BODY_PARTS["foot"])
    return F.when(kind == "throw_in", BODY_PARTS["other"]).when(kind.isin(*SHOTS), shot).when(kind.isin(*PASS_LIKE), BODY_PARTS["foot"]).otherwise(BODY_PARTS["other"])


def contextual_type(events: DataFrame) -> DataFrame:
    """Types that depend on neighbours: a tackle won against a take-on loses the ball for the other (dispossessed), a second duel row of the same take-on is a second take-on,
    and a recovery right after an opponent's failed pass is an interception."""
    w = W.partitionBy("match_id", "period_id").orderBy("action_id")
    before, after = F.lag("spadl_type").over(w), F.lead("spadl_type").over(w)
    other = F.lag("team").over(w) != F.col("team")
    lost = ~F.coalesce(F.lag("success").over(w), F.lit(True))
    kind = (
        F.when((F.col("spadl_type") == "take_on") & ~F.col("success") & (after == "tackle"), "dispossessed")
        .when((F.col("spadl_type") == "take_on") & (before == "take_on"), "second_take_on")
        .when((F.col("spadl_type") == "ball_recovery") & before.isin("pass", "cross") & other & lost, "interception")
    )
    return events.withColumn("_kind", kind).withColumn("spadl_type", F.coalesce("_kind", "spadl_type")).drop("_kind")


def to_actions(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions of raw events, and counts of what was dropped and why.

    Events without a type or before their period go; places are clipped to the pitch; a foul without a place takes the last known one; ends fall back from the
    receiver's next place to the next action's to the start; clearances end where the next action starts; rows are numbered per match.
    """
    from .joins import receiver_end
    from .relational import reasons
    from .sequence import by_period, previous_known

    marked = reasons(events, [("no_type", F.col("spadl_type").isNull()), ("negative_time", F.col("seconds") < 0), ("no_player", F.col("object_id").isNull())])
    kept = marked.where("reason = 'kept'").drop("reason")
    order = W.partitionBy("match_id").orderBy("period_id", "seconds", "event_id")
    kept = kept.withColumn("action_id", F.row_number().over(order).cast("long") - 1)
    for c, top in (("start_x", PITCH_X), ("start_y", PITCH_Y)):
        kept = kept.withColumn(c, F.greatest(F.lit(0.0), F.least(F.lit(top), F.coalesce(F.col(c), F.when(F.col("spadl_type") == "foul", previous_known(c))))))
    ends = receiver_end(kept)
    nx, ny = F.lead("start_x").over(by_period()), F.lead("start_y").over(by_period())
    clear = F.col("spadl_type") == "clearance"
    ends = ends.withColumns({"_nx": nx, "_ny": ny})
    ends = ends.withColumns({"end_x": F.when(clear, F.coalesce("_nx", "start_x")).otherwise(F.coalesce("end_x", "end_from_x", "_nx", "start_x")), "end_y": F.when(clear, F.coalesce("_ny", "start_y")).otherwise(F.coalesce("end_y", "end_from_y", "_ny", "start_y"))})
    return ends.drop("_nx", "_ny", "end_from_x", "end_from_y"), marked.groupBy("reason").agg(F.count("*").alias("n"))


def chronological_split(matches: DataFrame, train: int) -> DataFrame:
    """(match_id, split): the first ``train`` matches by kickoff and id train, the others test; one row per match, so the order is a small sort."""
    place = F.row_number().over(W.orderBy("kickoff", "match_id"))
    return matches.select("match_id", "kickoff").distinct().withColumn("split", F.when(place <= train, "train").otherwise("test")).select("match_id", "split")


def train_valid(ids: list[str], train: int, seed: int = 100) -> tuple[list[str], list[str]]:
    """A seeded choice of ``train`` of the ids, in their order, and the rest."""
    picked = set(random.Random(seed).sample(range(len(ids)), min(train, len(ids))))
    return [x for i, x in enumerate(ids) if i in picked], [x for i, x in enumerate(ids) if i not in picked]


def stable_teams(rows: DataFrame, key: str = "game_id", team: str = "team") -> DataFrame:
    """home for the first and away for the second of each match's two team names in order; matches with another number are an error row (null)."""
    t = rows.groupBy(key).agg(F.sort_array(F.collect_set(team)).alias("_t"))
    two = F.size("_t") == 2
    return t.select(key, F.when(two, F.col("_t")[0]).alias("home_team"), F.when(two, F.col("_t")[1]).alias("away_team"))


TOUCH, DUEL = "OtherBallAction", "GroundDuel"
# Types that always succeed, that never do, and that do if the next typed event of the period is the own team's.
ALWAYS_GOOD, NEVER_GOOD, GOOD_IF_KEPT = ("interception", "tackle", "dispossessed", "ball_recovery", "shot_block"), ("foul",), ("clearance", "bad_touch")


def touch_types(events: DataFrame, key: str = "match_id", order: str = "action_id") -> DataFrame:
    """Events with ``spadl_type`` and ``success`` of touches found from the rows around, and the ``rule`` that decided.

    Needs event_type, team_id, player_id and receiver_player_id (of a duel: winner and loser), success, period_id and the ``spadl_type`` of all other events.  A touch is an event
    of type OtherBallAction; the recent event is the last one before it that is no duel.  Rules, the first that holds decides:

    * received: the recent event is a failed pass to the player: an interception, or a clearance if the row before or after is an aerial duel of the player;
    * blocked: the recent event is a failed shot at the player;
    * won_from_touch: the player wins the ground duel that follows from the one who touched just before, who is dispossessed by it: a tackle;
    * won_from_team: the player wins the ground duel that follows, and the recent event is the other team's;
    * lost: the player loses the ground duel that follows; if the winner touched just before, that touch is a tackle;
    * after_duel: the row before is a ground duel of the player;
    * no_duel: neither the row before nor the two after are a ground duel of the player, and the next row is another's: a bad touch;
    * recovery: the recent event is a clearance.

    Rules won_from_team and after_duel give an interception if the recent event is an interception or clearance and else a tackle.  As the recent event may be a touch that
    follows one of these rules itself, what they look at is the last event before, duels and such touches aside: a running last value in place of a loop.
    A touch that no rule takes keeps its type.  Where there is no row before or after, rules that look at it don't hold.
    """
    w = W.partitionBy(key).orderBy(order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    typed = F.col("event_type")
    touch, me, team = F.coalesce(typed == TOUCH, F.lit(False)), F.col("player_id"), F.col("team_id")
    duel = F.coalesce(typed.contains("Duel"), F.lit(False))
    row = F.struct(typed.alias("kind"), team.alias("team"), me.alias("player"), F.col("receiver_player_id").alias("other"), F.col("success").alias("good"))
    e = events.withColumns({"_row": row, "_duel": duel, "_touch": touch})
    e = e.withColumns({"_prev": F.lag("_row").over(w), "_next": F.lead("_row").over(w), "_then": F.lead("_row", 2).over(w), "_recent": F.last(F.when(~F.col("_duel"), F.col("_row")), ignorenulls=True).over(before)})
    prev, after, then, recent = (F.col(c) for c in ("_prev", "_next", "_then", "_recent"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    is_kind = lambda r, *kinds: yes(r["kind"].isin(*kinds))
    mine = lambda r: yes(r["player"] == me) | yes(r["other"] == me)
    aerial = (is_kind(after, "AerialDuel") & yes(after["player"] == me)) | (is_kind(prev, "AerialDuel") & yes(prev["player"] == me))
    to_me = yes(recent["other"] == me) & ~yes(recent["good"])
    ground = is_kind(after, DUEL)
    won, lost = ground & yes(after["player"] == me), ground & yes(after["other"] == me)
    from_touch = is_kind(prev, TOUCH)
    around = (is_kind(prev, DUEL) & mine(prev)) | (ground & mine(after)) | (is_kind(then, DUEL) & mine(then))
    rule = (
        F.when(to_me & is_kind(recent, "Pass", "Cross"), "received")
        .when(to_me & is_kind(recent, "Shot"), "blocked")
        .when(won & from_touch & yes(after["other"] == prev["player"]), "won_from_touch")
        .when(won & recent.isNotNull() & ~recent["team"].eqNullSafe(team), "won_from_team")
        .when(lost, "lost")
        .when(is_kind(prev, DUEL) & mine(prev), "after_duel")
        .when(after.isNotNull() & ~around & ~after["player"].eqNullSafe(me), "no_duel")
        .when(is_kind(recent, "Clearance"), "recovery")
    )
    e = e.withColumn("rule", F.when(F.col("_touch"), rule)).withColumn("_aerial", aerial)
    plain = (
        F.when(F.col("rule") == "received", F.when(F.col("_aerial"), "clearance").otherwise("interception"))
        .when(F.col("rule") == "blocked", "shot_block")
        .when(F.col("rule") == "won_from_touch", "tackle")
        .when(F.col("rule") == "lost", "dispossessed")
        .when(F.col("rule") == "no_duel", "bad_touch")
        .when(F.col("rule") == "recovery", "ball_recovery")
    )
    carried = F.coalesce(F.col("rule").isin("won_from_team", "after_duel"), F.lit(False))
    e = e.withColumn("_type", F.coalesce(plain, "spadl_type")).withColumn("_carried", carried)
    cleared = F.when(~F.col("_duel") & ~F.col("_carried"), F.coalesce(F.col("_type").isin("interception", "clearance"), F.lit(False)))
    e = e.withColumn("_type", F.when(F.col("_carried"), F.when(F.last(cleared, ignorenulls=True).over(before), "interception").otherwise("tackle")).otherwise(F.col("_type")))
    # what a touch says about the touch just before it
    said = F.when(F.col("rule") == "won_from_touch", "dispossessed").when((F.col("rule") == "lost") & from_touch & yes(after["player"] == prev["player"]), "tackle")
    e = e.withColumn("_said", said).withColumn("_told", F.lead("_said").over(w))
    e = e.withColumns({"spadl_type": F.coalesce("_told", "_type"), "rule": F.when(F.col("_told").isNotNull(), "told").otherwise(F.col("rule"))})
    back = W.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("_event", F.when(F.col("spadl_type").isNotNull(), F.struct("period_id", "team_id"))).withColumn("_following", F.last("_event", ignorenulls=True).over(back))
    kept = yes((F.col("_following.period_id") == F.col("period_id")) & (F.col("_following.team_id") == team))
    kind = F.col("spadl_type")
    good = F.when(kind.isin(*ALWAYS_GOOD), F.lit(True)).when(kind.isin(*NEVER_GOOD), F.lit(False)).when(kind.isin(*GOOD_IF_KEPT), kept).otherwise(F.col("success"))
    return e.withColumn("success", good).drop(*[c for c in e.columns if c.startswith("_")])
