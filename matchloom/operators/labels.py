"""Labels of actions: intents, destinations, blocked augmentations, value grids, label rows and task filters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vocab import GRID_COLUMNS, GRID_ROWS, PITCH_X, PITCH_Y, RESTART_OUT, SHOTS, VALUE_GRID_TYPES


def intended_receiver(actions: DataFrame, limit: float = 45.0) -> DataFrame:
    """Adds intent_id.  Needs action_type, players (array), poss (the possessor's place), receiver_id, success, next_type, end_x and end_y.

    Dribbles and clearances intend themselves, shots the goal attacked, successful passes their receiver.  A failed pass intends the teammate with the best
    product of closeness to where it ended, small angle, and a weight of 0.5 to 1 for those nearer to the passer than the ball came, within the limit.
    The candidates are an array inside the row; the best is a minimum over it.
    """
    p = F.col("poss")
    length = G.distance(p["x"], p["y"], F.col("end_x"), F.col("end_y"))

    def measured(q: Column) -> Column:
        gap = G.distance(q["x"], q["y"], p["x"], p["y"]) - length
        weight = F.when(gap < -10, 0.5).when(gap < 0, gap / 20 + 1).otherwise(1.0)
        return F.struct(
            q["ordinal"].alias("ordinal"), q["object_id"].alias("object_id"), weight.alias("w"), F.greatest(G.distance(q["x"], q["y"], F.col("end_x"), F.col("end_y")), F.lit(1.0)).alias("d"),
            F.greatest(G.line_angle(p["x"], p["y"], F.col("end_x"), F.col("end_y"), q["x"], q["y"]), F.lit(0.01)).alias("a"),
        )

    mates = F.transform(F.filter("players", lambda q: (q["team"] == F.col("team")) & ~q["goal"] & (q["object_id"] != F.col("object_id"))), measured)
    rows = G.held(G.held(actions, _m=mates), _d=F.array_min(F.transform("_m", lambda m: m["d"])), _a=F.array_min(F.transform("_m", lambda m: m["a"])))
    radians = limit / 180 * math.pi
    ranked = F.transform("_m", lambda m: F.struct((-F.when(m["a"] < radians, m["w"] * (F.col("_d") / m["d"]) * (F.col("_a") / m["a"])).otherwise(0.0)).alias("s"), m["ordinal"].alias("ordinal"), m["object_id"].alias("object_id")))
    best = F.when(F.col("_a") < radians, F.array_min(ranked)["object_id"])
    own_goal = (F.col("action_type") == "shot") & F.col("success") & F.when(F.col("team") == "home", F.col("end_x") < 10).otherwise(F.col("end_x") > PITCH_X - 10)
    intent = (
        F.when(~F.col("action_type").isin("pass", "shot") | own_goal, F.col("object_id"))
        .when(F.col("action_type") == "shot", F.concat(F.col("team"), F.lit("_goal")))
        .when(F.col("success"), F.col("receiver_id"))
        .when(F.col("receiver_id").isNotNull(), best)
    )
    return G.held(rows, intent_id=intent).drop("_m", "_d", "_a")


def shot_receiver() -> Column:
    """Receiver of a shot: the goal (the other one for an own goal), out on a restart, else who comes next."""
    other = F.when(F.col("team") == "home", "away").otherwise("home")
    own_goal = F.when(F.col("team") == "home", F.col("end_x") < 10).otherwise(F.col("end_x") > PITCH_X - 10)
    return (
        F.when(F.col("success") & own_goal, F.concat(other, F.lit("_goal")))
        .when(F.col("success"), F.concat(F.col("team"), F.lit("_goal")))
        .when(F.col("next_type").isin(*RESTART_OUT), F.lit("out"))
        .otherwise(F.col("next_player_id"))
    )


def adjusted_destination(rows: DataFrame) -> DataFrame:
    """Adds dest_x and dest_y: a failed pass is stretched to its intended length, everything is kept on the pitch."""
    failed = (F.col("action_type") == "pass") & ~F.col("success") & F.col("intent_x").isNotNull() & F.col("intent_y").isNotNull() & (F.least("start_x", "start_y", "end_x", "end_y", "intent_x", "intent_y") >= 0)
    meant = G.distance(F.col("start_x"), F.col("start_y"), F.col("intent_x"), F.col("intent_y"))
    made = F.greatest(G.distance(F.col("start_x"), F.col("start_y"), F.col("end_x"), F.col("end_y")), F.lit(1e-6))
    stretch = meant / made
    move = lambda a, b: F.when(failed, F.col(a) + stretch * (F.col(b) - F.col(a))).otherwise(F.col(b))
    return rows.withColumns({"dest_x": G.clamp(move("start_x", "end_x"), 0, PITCH_X), "dest_y": G.clamp(move("start_y", "end_y"), 0, PITCH_Y)})


def blocked_augmentations(actions: DataFrame, reach: float = 5.0, cone: float = 15.0) -> DataFrame:
    """Clones of actions as if blocked: one row per action, blocker and intent that the blocker stood before.

    Needs players, poss, team, intent_id.  Blockers are the first three opponents (by ordinal) nearer than ``reach``; an intent is a teammate within the cone behind
    the blocker, nearer than the furthest other opponent in the cone less ten metres, or the goal within 40 metres.
    """
    p = F.col("poss")
    radians = cone / 180 * math.pi
    far = lambda q: G.distance(q["x"], q["y"], p["x"], p["y"])
    rivals = F.filter("players", lambda q: q["team"] != F.col("team"))
    rows = G.held(actions, _r=rivals)
    rows = rows.select("*", F.explode(F.slice(F.filter("_r", lambda q: far(q) < reach), 1, 3)).alias("_b"))
    b = F.col("_b")
    in_cone = lambda q: G.line_angle(p["x"], p["y"], b["x"], b["y"], q["x"], q["y"]) < radians
    others = F.filter("_r", lambda q: (q["ordinal"] != b["ordinal"]) & in_cone(q))
    rows = G.held(rows, _limit=F.array_max(F.transform(others, far)) - 10).where(F.col("_limit").isNotNull())
    near = lambda q: (far(q) < F.col("_limit")) | (q["goal"] & (far(q) < 40))
    intents = F.filter("players", lambda q: (q["team"] == F.col("team")) & in_cone(q) & near(q) & ~q["object_id"].eqNullSafe(F.col("intent_id")))
    return rows.withColumn("_i", F.explode(intents)).withColumns(
        {"blocker_id": F.col("_b.object_id"), "blocked_intent": F.col("_i.object_id"), "blocked_type": F.when(F.col("_i.goal"), "shot").otherwise("pass")}
    ).drop("_r", "_b", "_limit", "_i")


def rotated_for_xg(events: DataFrame) -> DataFrame:
    """Teams whose shots of a period lie in the right half on average are reflected (both by x)."""
    shots = events.where(F.col("spadl_type").isin(*SHOTS)).groupBy("match_id", "period_id", "team").agg((F.avg("start_x") > PITCH_X / 2).alias("_turn"))
    turn = F.coalesce("_turn", F.lit(False))
    return events.join(shots, ["match_id", "period_id", "team"], "left").withColumns({"start_x": G.reflect_x(F.col("start_x"), turn), "start_y": G.reflect_y(F.col("start_y"), turn)}).drop("_turn")


def left_to_right(events: DataFrame) -> DataFrame:
    """Away rows reflected, so that both teams attack to the right."""
    away = F.col("team") == "away"
    out = events.withColumns({c: G.reflect_x(F.col(c), away) for c in ("start_x", "end_x") if c in events.columns})
    return out.withColumns({c: G.reflect_y(F.col(c), away) for c in ("start_y", "end_y") if c in events.columns})


def grid_counts(actions: DataFrame) -> DataFrame:
    """Counts that a value grid is fitted on: per cell shots, goals and moves, and moves by cell reached (at most 96 x 96 rows)."""
    cell = lambda x, y: G.grid_row(F.col(y)) * GRID_COLUMNS + G.grid_column(F.col(x))
    a = left_to_right(actions.where(F.col("spadl_type").isin(*VALUE_GRID_TYPES))).withColumns({"cell": cell("start_x", "start_y"), "to_cell": cell("end_x", "end_y")})
    shot = F.col("spadl_type") == "shot"
    moved = ~shot & F.col("success")
    return a.groupBy("cell", F.when(moved, F.col("to_cell")).alias("to_cell")).agg(F.count_if(shot).alias("shots"), F.count_if(shot & F.col("success")).alias("goals"), F.count_if(~shot).alias("moves"))


def fit_grid(counts: DataFrame, rounds: int = 200, tolerance: float = 1e-5) -> np.ndarray:
    """Expected-threat values of the 8 x 12 grid by value iteration on at most 96 x 97 counts, averaged over mirrored rows."""
    n = GRID_COLUMNS * GRID_ROWS
    shots, goals, moves, to = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, n))
    for r in counts.collect():
        shots[r.cell] += r.shots
        goals[r.cell] += r.goals
        moves[r.cell] += r.moves
        if r.to_cell is not None:
            to[r.cell, r.to_cell] += r.moves
    every = np.maximum(shots + moves, 1)
    shoot, score = shots / every, goals / np.maximum(shots, 1)
    carry = moves / every
    chance = to / np.maximum(moves, 1)[:, None]
    value = np.zeros(n)
    for _ in range(rounds):
        new = shoot * score + carry * (chance @ value)
        done = np.abs(new - value).max() < tolerance
        value = new
        if done:
            break
    grid = value.reshape(GRID_ROWS, GRID_COLUMNS)
    return (grid + grid[::-1]) / 2


def grid_frame(spark: SparkSession, grid: np.ndarray) -> DataFrame:
    """The grid as 96 rows (cell, xt)."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(grid.ravel())], "cell int, xt double")


def with_zone_value(actions: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds xt for eligible rows: the cell's value after reflection; a shot has at least its expected goal.  The grid has 96 rows."""
    cell = lambda x, y: G.grid_row(y) * GRID_COLUMNS + G.grid_column(x)
    away = F.col("team") == "away"
    eligible = F.col("spadl_type").isin(*VALUE_GRID_TYPES)
    a = actions.withColumn("cell", F.when(eligible, cell(G.reflect_x(F.col("start_x"), away), G.reflect_y(F.col("start_y"), away))))
    shot = F.col("spadl_type") == "shot"
    return a.join(F.broadcast(grid), "cell", "left").withColumn("xt", F.when(shot & F.col("xt").isNotNull(), F.greatest("xt", F.coalesce("expected_goal", F.lit(0.0)))).otherwise(F.col("xt"))).drop("cell")


def sanitized_xg(events: DataFrame, column: str = "expected_goal") -> DataFrame:
    """Expected goals as numbers, and only of shots."""
    return events.withColumn(column, F.when(F.col("spadl_type").isin(*SHOTS), F.expr(f"try_cast({column} AS double)")))


# Tasks as (kind, passes, dribbles, shots, intent needed, goals as nodes, condition, output filter, outputs).
TASKS = {
    "overall_scoring": ("graph_binary", True, True, True, False, False, None, None, 1),
    "overall_conceding": ("graph_binary", True, True, True, False, False, None, None, 1),
    "overall_return": ("graph_regression", True, True, True, False, False, None, None, 1),
    "action_intent": ("node_selection", True, True, True, True, True, None, "teammates", 1),
    "pass_intent": ("node_selection", True, False, False, True, False, None, "teammates", 1),
    "pass_intent_oppo_agn": ("node_selection", True, False, False, True, False, None, "teammates", 1),
    "action_success": ("node_binary", True, True, True, True, True, "intent", "teammates", 1),
    "pass_success": ("node_binary", True, True, False, True, False, "intent", "teammates", 1),
    "shot_blocking": ("graph_binary", True, False, True, False, True, None, None, 1),
    "intent_return": ("node_binary", True, True, False, True, False, "intent", "teammates", 2),
    "intent_return_oppo_agn": ("node_binary", True, True, False, True, False, "intent", "teammates", 2),
    "outcome_scoring": ("node_binary", True, True, False, True, False, "success", "teammates", 2),
    "outcome_conceding": ("node_binary", True, True, False, True, False, "success", "teammates", 2),
    "outcome_return": ("node_regression", True, True, False, True, False, "success", "teammates", 2),
    "success_receiver": ("node_selection", True, False, False, True, False, "direction", "teammates", 1),
    "failure_receiver": ("node_selection", True, True, True, True, True, "intent", "opponents", 1),
    "pass_dest": ("graph_multiclass", True, False, False, True, False, None, None, 1),
    "pass_dest_oppo_agn": ("graph_multiclass", True, False, False, True, False, None, None, 1),
    "dest_receiver": ("node_selection", True, False, False, True, False, "destination", None, 1),
    "dest_scoring": ("graph_binary", True, False, False, True, False, "success", None, 2),
    "dest_conceding": ("graph_binary", True, False, False, True, False, "success", None, 2),
}


def task_rows(rows: DataFrame, task: str, in_play: bool = False, shortest_pass: float = 0.0, shots_only: bool = False) -> DataFrame:
    """Rows that a task learns from (action_type, success, blocked, intent_id, receiver_id, duration).

    Tasks whose name begins with success or failure take those actions only; shots count as such by being blocked or not.
    """
    _, passes, dribbles, shots, intent, *_ = TASKS[task]
    kinds = [k for k, on in (("pass", passes), ("dribble", dribbles), ("shot", shots)) if on]
    shot = F.col("action_type") == "shot"
    keep = F.col("action_type").isin(*kinds)
    if task == "shot_blocking" and shots_only:
        keep = keep & shot
    if task.startswith("success"):
        keep = keep & F.when(shot, ~F.col("blocked")).otherwise(F.col("success"))
    if task.startswith("failure"):
        keep = keep & F.when(shot, F.col("blocked")).otherwise(~F.col("success"))
    if intent:
        keep = keep & F.col("intent_id").isNotNull()
    if in_play:
        keep = keep & (F.col("receiver_id") != "out")
    if shortest_pass > 0:
        keep = keep & ((F.col("action_type") != "pass") | (F.col("duration") >= shortest_pass))
    return rows.where(F.coalesce(keep, F.lit(False)))


def outcome_targets(family: str) -> tuple[Column, Column]:
    """Columns scored and conceded of a target family: goals, xg or xt."""
    return {"goals": (F.col("scores"), F.col("concedes")), "xg": (F.col("scores_xg"), F.col("concedes_xg")), "xt": (F.col("scores_xt"), F.col("concedes_xt"))}[family]


def label_rows(actions: DataFrame, fps: float = 25.0) -> DataFrame:
    """The exported label row of each action: sentinels -105 and -68 stand for unknown places, -1 for unknown ordinals.

    Needs action_type, players, intent_id, receiver_id, intent_x, intent_y and the returns.  Ordinals count within the possessor's team for the intent, and
    within own team first, then the other, for the receiver.
    """
    away = F.col("team") == "away"
    own = F.transform(F.filter("players", lambda q: q["team"] == F.col("team")), lambda q: q["object_id"])
    other = F.transform(F.filter("players", lambda q: q["team"] != F.col("team")), lambda q: q["object_id"])
    is_pass = F.col("action_type") == "pass"
    place = lambda names, who: (F.coalesce(F.array_position(names, F.col(who)), F.lit(0)) - 1).cast("int")
    x = lambda c: F.coalesce(F.when(is_pass, G.reflect_x(F.col(c), away)), F.lit(-PITCH_X))
    y = lambda c: F.coalesce(F.when(is_pass, G.reflect_y(F.col(c), away)), F.lit(-PITCH_Y))
    known = F.col("receiver_id").isNotNull() | ~is_pass
    return actions.where(known).select(
        "match_id", "action_id", is_pass.cast("int").alias("is_pass"), (F.col("action_type") == "dribble").cast("int").alias("is_dribble"), (F.col("action_type") == "shot").cast("int").alias("is_shot"),
        F.size("players").alias("n_players"), place(own, "intent_id").alias("intent_index"),
        F.when((F.col("receiver_id") == "out") | F.col("receiver_id").endswith("goal") | (F.col("action_type") == "dribble"), F.lit(-1)).otherwise(place(F.concat(own, other), "receiver_id")).alias("receiver_index"),
        F.when(is_pass, F.coalesce(F.floor((F.col("receive_frame_id") - F.col("frame_id")) / F.lit(fps) * 100 + 0.5) / 100, F.lit(0.0))).otherwise(0.0).alias("duration"),
        x("start_x").alias("start_x"), y("start_y").alias("start_y"), x("end_x").alias("end_x"), y("end_y").alias("end_y"), x("intent_x").alias("intent_x"), y("intent_y").alias("intent_y"),
        F.lit(1).alias("is_real"), F.col("blocked").cast("int").alias("blocked"), F.col("success").cast("int").alias("success"), "scores", "scores_xg", "concedes", "concedes_xg", "scores_xt", "concedes_xt",
    )
