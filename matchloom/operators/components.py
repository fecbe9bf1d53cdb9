"""Components of option values before credits: goal options, shot values, dispatch to credit rules, snapshot values, graph and table sets.

Component tables are long: (key, option, ...), one row per option; the goal is an option like the players.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vocab import RESTARTS, SHOT_OUT_SHARE
from .joins import merged

#: A shot's chance of being blocked is estimated only above this expected goal.  Fixed value.
LEAST_CHANCE = 0.01


def with_goal_success(passes: DataFrame, shots: DataFrame, key: str) -> DataFrame:
    """(key, option, success_p): pass options, and each side's goal with the success of a shot from there (key, shot_p), 0 without one.

    The goal belongs to the team of the options: their name's first four letters.
    """
    team = passes.groupBy(key).agg(F.substring(F.min("option"), 1, 4).alias("_t"))
    goals = team.join(shots, key, "left").select(key, F.concat("_t", F.lit("_goal")).alias("option"), F.coalesce("shot_p", F.lit(0.0)).alias("success_p"))
    return passes.select(key, "option", "success_p").unionByName(goals)


def with_goal_values(passes: DataFrame, key: str, xg: DataFrame | None = None) -> DataFrame:
    """(key, option, s_score, f_score, s_concede, f_concede): pass options, and the goal, worth its unblocked xG (key, xg) or 1."""
    names = ["s_score", "f_score", "s_concede", "f_concede"]
    team = passes.groupBy(key).agg(F.substring(F.min("option"), 1, 4).alias("_t"))
    value = team.join(xg, key, "left").withColumn("_v", F.col("xg")) if xg is not None else team.withColumn("_v", F.lit(1.0))
    goals = value.select(key, F.concat("_t", F.lit("_goal")).alias("option"), F.col("_v").alias("s_score"), *[F.lit(0.0).alias(n) for n in names[1:]])
    return passes.select(key, "option", *names).unionByName(goals)


def shot_components(actions: DataFrame, use_vendor: bool = True) -> DataFrame:
    """block_p and xg of a shot before (0) and after (1) every action; needs match_id, action_id, spadl_type, expected_goal, block_0, xg_0, block_1, xg_1.

    Below ``LEAST_CHANCE`` nothing is estimated to be blocked.  A provider's xG replaces the model's where there is one (of the action before, of the next one
    after), divided by the share that isn't blocked and at most 1; a corner can't be shot.
    """
    w = W.partitionBy("match_id").orderBy("action_id")
    out = actions
    for at, vendor in (("0", F.col("expected_goal")), ("1", F.lead("expected_goal").over(w))):
        block = F.when(F.col(f"xg_{at}") > LEAST_CHANCE, F.col(f"block_{at}"))
        xg = F.when(vendor.isNotNull(), F.least(vendor / (1 - F.coalesce(block, F.lit(0.0))), F.lit(1.0))).otherwise(F.col(f"xg_{at}")) if use_vendor else F.col(f"xg_{at}")
        if at == "0":
            xg = F.when(F.col("spadl_type").startswith("corner"), 0.0).otherwise(xg)
        out = out.withColumns({f"_x{at}": xg, f"shot_p_{at}": 1 - block})
    return out.withColumns({f"xg_{at}": F.col(f"_x{at}") for at in "01"}).drop("_x0", "_x1")


def on_target(options: DataFrame, actions: DataFrame, posteriors: DataFrame, key: str, team: str = "team", keeper: str = "keeper_id") -> DataFrame:
    """The goal option as on target instead of in: its success is xG plus the share of misses that the keeper has to save, its value xG over that."""
    who = actions.select(key, F.concat(F.col(team), F.lit("_goal")).alias("option"), F.col(keeper).alias("defender"))
    saves = who.join(posteriors.select(key, "option", "defender", "posterior"), [key, "option", "defender"], "left").select(key, "option", F.col("posterior").alias("_save"), F.lit(True).alias("_goal"))
    o = options.join(saves, [key, "option"], "left")
    xg = F.col("success_p")
    shot = xg + (1 - xg) * (1 - SHOT_OUT_SHARE) * F.col("_save")
    mine = F.coalesce("_goal", F.lit(False))
    return o.withColumns({"_p": F.when(mine, shot).otherwise(xg), "s_score": F.when(mine, F.try_divide(xg, shot)).otherwise(F.col("s_score"))}).withColumn("success_p", F.col("_p")).drop("_p", "_save", "_goal")


def credit_rule() -> Column:
    """Which rule gives credits for an action: none for anomalies and own goals, then fouls, shots, passes."""
    skip = F.coalesce("anomaly", F.lit(False)) | (F.col("spadl_type") == "own_goal")
    return F.when(skip, "none").when(F.coalesce(F.col("next_type") == "foul", F.lit(False)), "foul").when(F.col("action_type") == "shot", "shot").otherwise("pass")


def snapshot_values(components: DataFrame, key: str, options: DataFrame) -> DataFrame:
    """Values of the attacking side's options at a snapshot: both outcomes, their mean by success, and what success gains.

    Options are gathered to one row a key, so that both sides meet by the key alone: where they are partitioned by it already, nothing is shuffled.
    """
    there = options.groupBy(key).agg(F.collect_set("option").alias("_there"))
    c = merged(components).join(merged(there), key).where(F.array_contains("_there", F.col("option")))
    good, bad = F.col("s_score") - F.col("s_concede"), F.col("f_score") - F.col("f_concede")
    return c.select(key, "option", "select_p", "success_p", good.alias("s_value"), bad.alias("f_value"), (F.col("success_p") * good + (1 - F.col("success_p")) * bad).alias("option_value"), (good - bad).alias("advantage"))


def active_players(snapshots: DataFrame, key: str, owner: str, goals: bool = True) -> DataFrame:
    """Objects with a place at a snapshot, the owner's team first: (key, side 0 or 1, place in the side, object_id)."""
    rows = snapshots.select(key, F.col(owner).alias("_own"), F.explode("players").alias("p")).where(F.col("p.x").isNotNull() & (F.lit(goals) | ~F.col("p.goal")))
    side = F.when(F.col("p.team") == F.col("_own"), 0).otherwise(1)
    w = W.partitionBy(key, side).orderBy("p.ordinal")
    return rows.select(key, side.alias("side"), (F.row_number().over(w) - 1).alias("place"), F.col("p.object_id").alias("object_id"))


def graph_table(actions: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """One row per action: its graph's number of nodes and edges; nulls where the possessor isn't in the snapshot or there is none."""
    s = snapshots.select(key, "players", "object_id").withColumn("_ok", F.exists("players", lambda p: p["object_id"] == F.col("object_id")))
    n = F.size(F.filter("players", lambda p: p["x"].isNotNull()))
    valid = s.where("_ok").select(key, n.alias("n_nodes"), (n * n).alias("n_edges"))
    return actions.select(key).join(valid, key, "left")


def tabular_set(features: DataFrame, actions: DataFrame, key: str, touch: Column) -> DataFrame:
    """A table row per action: its features, and whether it was one touch and a set piece."""
    flags = actions.select(key, touch.cast("double").alias("one_touch"), F.col("spadl_type").isin(*RESTARTS).cast("double").alias("set_piece"))
    return flags.join(features, key, "left")


def graph_to_table(nodes: DataFrame | str, labels: DataFrame, key: str, names: list[str], padding: float = -1.0) -> DataFrame:
    """Possessor node and intent node side by side, ``padding`` where either is missing; ``labels`` has the key and intent_index, counted from 0.

    ``nodes`` is a long table, or the name of a column of ``labels`` that holds them as an array; then nothing is joined or shuffled.
    """
    pad = lambda c, to: F.coalesce(F.col(c).cast("double"), F.lit(padding)).alias(to)
    if isinstance(nodes, str):
        first = lambda keep: F.array_min(F.transform(F.filter(nodes, keep), lambda n: F.struct(n["ordinal"], *[n[c].alias(c) for c in names])))
        out = G.held(labels, _p=first(lambda n: n["possessor"] == 1), _i=first(lambda n: n["ordinal"] - 1 == F.col("intent_index")))
        return out.select(key, *[pad(f"_p.{n}", f"poss_{n}") for n in names], *[pad(f"_i.{n}", f"intent_{n}") for n in names])
    poss = nodes.where("possessor = 1").groupBy(key).agg(F.min_by(F.struct(*names), "ordinal").alias("_p"))
    intent = nodes.select(F.col(key), (F.col("ordinal") - 1).alias("intent_index"), F.struct(*names).alias("_i"))
    out = merged(merged(labels).join(merged(poss), key, "left")).join(merged(intent), [key, "intent_index"], "left")
    return out.select(key, *[pad(f"_p.{n}", f"poss_{n}") for n in names], *[pad(f"_i.{n}", f"intent_{n}") for n in names])


def sorted_options(wide: DataFrame, keys: list[str], options: list[str]) -> DataFrame:
    """A wide row's option probabilities as rows, best first; nulls are no options."""
    long = wide.unpivot(keys, options, "option", "p").where("p IS NOT NULL")
    return long.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("p"), "option")))


def position_error(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean distance between predicted and true places."""
    return rows.groupBy(*by).agg(F.avg(F.hypot(F.col("x") - F.col("true_x"), F.col("y") - F.col("true_y"))).alias("error"), F.count("*").alias("n"))


def one_hot(column: str, kinds: list) -> dict[str, Column]:
    return {f"{column}_{k}": (F.col(column) == F.lit(k)).cast("double") for k in kinds}


def gated(x: list[Column], gate: list[Column]) -> list[Column]:
    """Gated linear units: each value times the logistic function of its gate."""
    return [a / (1 + F.exp(-g)) for a, g in zip(x, gate, strict=True)]
