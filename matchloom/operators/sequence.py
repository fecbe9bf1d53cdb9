"""Operators on ordered events: next and previous rows, episodes, look-ahead returns, synthetic dribbles, outcomes.

All take a long event table keyed by (match_id, period_id, action_id).  Windows are partitioned by match, so their shuffle is
shared by every operator applied in a row; nothing needs rows of more than one match together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.vocab import DEFENSIVE_TOUCH, PASSES, RESTART_FOUL, RESTART_OUT, SHOTS, VALUE_GRID_TYPES


def by_match() -> WindowSpec:
    """Rows of a match in order."""
    return W.partitionBy("match_id").orderBy("action_id")


def by_period() -> WindowSpec:
    """Rows of a period in order."""
    return W.partitionBy("match_id", "period_id").orderBy("action_id")


def next_action(events: DataFrame) -> DataFrame:
    """Adds next_player_id and next_type within the period."""
    return events.withColumns({"next_player_id": F.lead("object_id").over(by_period()), "next_type": F.lead("spadl_type").over(by_period())})


def previous_known(value: str | Column) -> Column:
    """The last value before this row in the period that is not null."""
    return F.last(value, ignorenulls=True).over(by_period().rowsBetween(W.unboundedPreceding, -1))


def filled(value: str | Column, window: WindowSpec | None = None) -> Column:
    """The last value up to this row that is not null, in its period unless another window is given."""
    return F.last(value, ignorenulls=True).over((window or by_period()).rowsBetween(W.unboundedPreceding, 0))


def event_seconds(ts: str = "ts") -> Column:
    """Seconds since the period's first event."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return (micros - F.first(micros).over(by_period())) / F.lit(1e6)


def frame_number(seconds: Column, fps: int = 25) -> Column:
    """Frame of a time, halves to even."""
    return F.bround(seconds * F.lit(float(fps)), 0).cast("long")


def episodes(frames: DataFrame, gap: int = 5, alive: Column | None = None) -> DataFrame:
    """Adds episode_id to frames (match_id, period_id, frame_id): a gap of ``gap`` frames or a new period begins one; dead frames get 0."""
    alive = F.lit(True) if alive is None else F.coalesce(alive, F.lit(False))
    within = W.partitionBy("match_id", "period_id", "_alive").orderBy("frame_id")
    whole = W.partitionBy("match_id", "_alive").orderBy("period_id", "frame_id")
    before = F.lag("frame_id").over(within)
    marked = frames.withColumn("_alive", alive)
    starts = F.when(before.isNull() | (F.col("frame_id") - before >= gap), 1).otherwise(0)
    marked = marked.withColumn("_start", starts)
    number = F.sum("_start").over(whole.rangeBetween(W.unboundedPreceding, 0))
    return marked.withColumn("episode_id", F.when(F.col("_alive"), number).otherwise(F.lit(0)).cast("long")).drop("_alive", "_start")


def future_returns(events: DataFrame, ahead: int = 10) -> DataFrame:
    """Adds scores, concedes, scores_xg and concedes_xg over the next ``ahead`` rows of the period, this one included.

    A goal is a successful row with an expected goal.  Each team's outlook is one window aggregate; a row then picks its own.
    """
    w = by_period().rowsBetween(0, ahead - 1)
    goal = F.col("expected_goal").isNotNull() & F.coalesce("success", F.lit(False))
    xg = F.coalesce("expected_goal", F.lit(0.0))

    def outlook(team: str) -> tuple[Column, Column]:
        mine = F.col("team") == team
        return F.max(F.when(mine & goal, 1).otherwise(0)).over(w), F.lit(1.0) - F.product(F.when(mine, F.lit(1.0) - xg).otherwise(F.lit(1.0))).over(w)

    (home_goal, home_xg), (away_goal, away_xg) = outlook("home"), outlook("away")
    out = events.withColumns({"_hg": home_goal, "_hx": home_xg, "_ag": away_goal, "_ax": away_xg})
    own = F.col("team") == "home"
    return out.withColumns(
        {
            "scores": F.when(own, F.col("_hg")).otherwise(F.col("_ag")),
            "concedes": F.when(own, F.col("_ag")).otherwise(F.col("_hg")),
            "scores_xg": F.when(own, F.col("_hx")).otherwise(F.col("_ax")),
            "concedes_xg": F.when(own, F.col("_ax")).otherwise(F.col("_hx")),
        }
    ).drop("_hg", "_hx", "_ag", "_ax")


def discounted_returns(events: DataFrame, gamma: float = 0.95) -> DataFrame:
    """Adds scores_xg_disc and concedes_xg_disc: 1 - prod(1 - gamma^(j-i) xG_j) per team, from i on.

    The look-ahead ends with a goal (xG above 0 and success), before a new period, and before a goal kick.  Rows up to such an end form a segment;
    only shots matter in it, so rows meet the shots of their own segment (few) and nothing is quadratic in the match.
    """
    xg = F.coalesce("expected_goal", F.lit(0.0))
    goal = (xg > 0) & F.coalesce("success", F.lit(False))
    ends = goal | (F.lead("period_id").over(by_match()) != F.col("period_id")) | (F.lead("spadl_type").over(by_match()) == "goalkick")
    segment = F.coalesce(F.sum(F.when(F.coalesce(ends, F.lit(False)), 1).otherwise(0)).over(by_match().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = events.withColumn("_segment", segment)
    by = W.partitionBy("match_id", "_segment").orderBy("action_id")
    shot = F.when(xg > 0, F.struct(F.col("action_id").alias("at"), F.col("team").alias("team"), xg.alias("xg")))
    ahead = F.collect_list(shot).over(by.rowsBetween(0, W.unboundedFollowing))

    def outlook(own: bool) -> Column:
        def step(acc, s):
            return F.when((s["team"] == F.col("team")) == F.lit(own), acc * (F.lit(1.0) - F.pow(F.lit(gamma), (s["at"] - F.col("action_id")).cast("double")) * s["xg"])).otherwise(acc)

        return F.lit(1.0) - F.aggregate("_ahead", F.lit(1.0), step)

    return rows.withColumn("_ahead", ahead).withColumns({"scores_xg_disc": outlook(True), "concedes_xg_disc": outlook(False)}).drop("_ahead", "_segment")


def value_returns(events: DataFrame, ahead: int = 5, kinds=VALUE_GRID_TYPES, each_period: bool = False) -> DataFrame:
    """Adds scores_xt and concedes_xt: the largest grid value (column xt) among the next ``ahead`` eligible rows, per team; 0 without any.

    Eligible rows are numbered; a row looks at numbers n+1 to n+ahead, a range frame on the running number.  Periods aren't
    separated unless asked for.
    """
    keys = ["match_id", "period_id"] if each_period else ["match_id"]
    ordered = W.partitionBy(*keys).orderBy("action_id")
    eligible = F.col("spadl_type").isin(*kinds) & F.col("xt").isNotNull() & F.col("team").isin("home", "away")
    numbered = events.withColumns({"_eligible": eligible, "_n": F.sum(F.when(eligible, 1).otherwise(0)).over(ordered)})
    span = W.partitionBy(*keys).orderBy("_n").rangeBetween(1, ahead)
    best = {t: F.max(F.when(F.col("_eligible") & (F.col("team") == t), F.col("xt"))).over(span) for t in ("home", "away")}
    out = numbered.withColumns({"_h": best["home"], "_a": best["away"]})
    own = F.col("team") == "home"
    return out.withColumns(
        {
            "scores_xt": F.coalesce(F.when(own, F.col("_h")).otherwise(F.col("_a")), F.lit(0.0)),
            "concedes_xt": F.coalesce(F.when(own, F.col("_a")).otherwise(F.col("_h")), F.lit(0.0)),
        }
    ).drop("_eligible", "_n", "_h", "_a")


def pass_actions(events: DataFrame) -> DataFrame:
    """Passes with known frames and a settled receiver; success is a receiver of the same team without offside."""
    e = next_action(events)
    settled = (F.col("receiver_id") == F.col("next_player_id")) | (F.col("receiver_id") == "out") | F.col("next_type").isin("foul", "freekick_short")
    known = F.col("frame_id").isNotNull() & F.col("receive_frame_id").isNotNull()
    own = F.substring("receiver_id", 1, 4) == F.col("team")
    return e.where(F.col("spadl_type").isin(*PASSES) & known & F.coalesce(settled, F.lit(False))).withColumns({"action_type": F.lit("pass"), "success": F.coalesce(own & ~F.col("offside"), F.lit(False))})


def dribble_actions(events: DataFrame, kinds=("take_on", "dispossessed")) -> DataFrame:
    """Dribbles but for the last row of a period; the receipt is the next row."""
    e = next_action(events).withColumn("_frame", F.lead("frame_id").over(by_match())).withColumn("_last", F.lead("action_id").over(by_period()).isNull())
    out = e.where(F.col("spadl_type").isin(*kinds) & F.col("frame_id").isNotNull() & ~F.col("_last"))
    lost = F.col("spadl_type") == "dispossessed"
    return out.withColumns({"action_type": F.lit("dribble"), "success": F.when(lost, F.lit(False)).otherwise(F.col("success")), "receiver_id": F.col("next_player_id"), "receive_frame_id": F.col("_frame")}).drop("_frame", "_last")


def shot_actions(events: DataFrame) -> DataFrame:
    """Shots with a frame; blocked if a block comes next."""
    e = next_action(events)
    return e.where(F.col("spadl_type").isin(*SHOTS) & F.col("frame_id").isNotNull()).withColumns({"action_type": F.lit("shot"), "blocked": F.coalesce(F.col("next_type") == "shot_block", F.lit(False))})


def first_after(condition: Column, value: Column, offset: int = 1, within: int | None = None) -> Column:
    """Value of the first row from ``offset`` rows on (``within`` rows at most) that meets the condition, in the period."""
    last = W.unboundedFollowing if within is None else within
    return F.first(F.when(condition, value), ignorenulls=True).over(by_period().rowsBetween(offset, last))


def post_actions(events: DataFrame) -> DataFrame:
    """Adds end_player_id, end_frame_id and end_type: who has the ball after the action and when.

    After a restart from out of play, the restart; after a defensive touch, the first row from two on that is none (and has a frame); after a foul, the
    next set piece within four rows if it has a frame; else the receipt.  A take-on before a foul that leads to a set piece
    succeeds if its own team takes that, and otherwise goes to who won the foul.  The last row of a period is left as it is.
    """
    e = next_action(events)
    here = F.struct(F.col("object_id").alias("player"), F.col("frame_id").alias("frame"), F.col("spadl_type").alias("kind"), F.col("action_id").alias("at"))
    touch = F.col("spadl_type").isin(*DEFENSIVE_TOUCH)
    e = e.withColumns(
        {
            "_next": F.lead(here).over(by_period()),
            "_clear": first_after(~touch & F.col("frame_id").isNotNull(), here, 2),
            "_set": first_after(F.col("spadl_type").isin(*RESTART_FOUL), here, 1),
            "_won": F.first(F.when((F.col("spadl_type") == "foul") & F.col("success"), here), ignorenulls=True).over(by_period().rowsBetween(0, 4)),
        }
    )
    usable_set = F.col("_set.frame").isNotNull() & (F.col("_set.at") < F.col("action_id") + 5)
    found = (
        F.when(F.col("next_type").isin(*RESTART_OUT), F.col("_next"))
        .when(F.col("next_type").isin(*DEFENSIVE_TOUCH), F.col("_clear"))
        .when((F.col("next_type") == "foul") & usable_set, F.col("_set"))
    )
    receipt = F.struct(F.col("receiver_id").alias("player"), F.col("receive_frame_id").alias("frame"), F.col("next_type").alias("kind"), F.lit(None).cast("long").alias("at"))
    take_on = (F.col("next_type") == "foul") & usable_set & (F.col("spadl_type") == "take_on")
    kept = F.substring("_set.player", 1, 4) == F.col("team")
    won = F.when(F.col("_won.at") <= F.col("_set.at"), F.col("_won.player"))
    e = e.withColumn("_end", F.coalesce(found, receipt))
    out = F.col("_end.player") == "out"
    return e.withColumns(
        {
            "end_player_id": F.when(out, F.lit(None)).otherwise(F.col("_end.player")),
            "end_frame_id": F.when(out, F.lit(None)).otherwise(F.col("_end.frame")),
            "end_type": F.when(out, F.lit(None)).otherwise(F.col("_end.kind")),
            "success": F.when(take_on, kept).otherwise(F.col("success")),
            "receiver_id": F.when(take_on & kept, F.col("object_id")).when(take_on, F.coalesce(won, "receiver_id")).otherwise(F.col("receiver_id")),
        }
    ).drop("_next", "_clear", "_set", "_won", "_end")


def inserted_dribbles(events: DataFrame, gap: int = 5) -> DataFrame:
    """Dribbles between a receipt and the same player's next action at least ``gap`` frames later, as rows of their own."""
    nxt = F.struct("object_id", "spadl_type", "frame_id", "start_x", "start_y")
    e = events.withColumn("_n", F.lead(nxt).over(by_period()))
    fits = ~F.col("offside") & ~F.col("_n.spadl_type").isin(*RESTART_OUT) & (F.col("_n.frame_id") - F.col("receive_frame_id") >= gap) & (F.col("_n.object_id") == F.col("receiver_id"))
    return e.where(fits).select(
        "match_id",
        "period_id",
        "action_id",
        F.greatest("receive_frame_id", F.col("frame_id") + 1).alias("frame_id"),
        F.lit("dribble").alias("spadl_type"),
        F.col("_n.object_id").alias("object_id"),
        F.lit(True).alias("success"),
        F.col("_n.object_id").alias("receiver_id"),
        F.col("_n.frame_id").alias("receive_frame_id"),
        F.col("_n.spadl_type").alias("next_type"),
        F.col("end_x").alias("start_x"),
        F.col("end_y").alias("start_y"),
        F.col("_n.start_x").alias("end_x"),
        F.col("_n.start_y").alias("end_y"),
    )


def one_touch(frames: int = 3) -> Column:
    """Whether the action comes within ``frames`` frames of the previous receipt."""
    return F.coalesce(F.col("frame_id") < F.lag("receive_frame_id").over(by_match()) + frames, F.lit(False))


def until_last_synced(events: DataFrame, synced: Column) -> DataFrame:
    """Rows up to the last synced one of the match."""
    last = F.max(F.when(synced, F.col("action_id"))).over(W.partitionBy("match_id"))
    return events.withColumn("_last", last).where(F.col("action_id") <= F.col("_last")).drop("_last")


def jump_free_prefix(frames: DataFrame, order: str = "frame_id") -> DataFrame:
    """Rows of each (match_id, period_id) before its first gap of more than one frame."""
    w = W.partitionBy("match_id", "period_id").orderBy(order)
    jump = F.when(F.col(order) - F.lag(order).over(w) > 1, 1).otherwise(0)
    return frames.withColumn("_jump", jump).withColumn("_jumps", F.sum("_jump").over(w)).where("_jumps = 0").drop("_jump", "_jumps")


def without_self_passes(events: DataFrame, seconds: float = 5.0, ts: str = "ts") -> DataFrame:
    """Drops a row that the same player follows within ``seconds`` by an action of the same kind in the period."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    soon = (F.lead("object_id").over(by_period()) == F.col("object_id")) & (F.lead(micros).over(by_period()) - micros <= F.lit(int(seconds * 1e6))) & (F.col("spadl_type") == "pass")
    return events.withColumn("_self", F.coalesce(soon, F.lit(False))).where(~F.col("_self")).drop("_self")
