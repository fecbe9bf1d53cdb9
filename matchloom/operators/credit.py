"""Values and credits: option values, expected possession value, defence types, credits to defenders, player scores.

Component tables are long: (key, option, select_p, success_p, s_score, s_concede, f_score, f_concede), one row per option of an action; posteriors are
(key, option, defender, posterior).  Everything is sums per key and equi-joins on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vocab import CORNER_VALUE, PENALTY_VALUE, SHOT_OUT_SHARE
from .joins import merged


def option_value() -> Column:
    """Value of an option: p * (score - concede) if it comes off, the other pair if it doesn't."""
    good, bad = F.col("s_score") - F.col("s_concede"), F.col("f_score") - F.col("f_concede")
    return F.col("success_p") * good + (1 - F.col("success_p")) * bad


def adjusted_set_pieces(options: DataFrame, actions: DataFrame, key: str, player: str = "end_player_id", kind: str = "end_type", penalty_as_success: bool = False) -> DataFrame:
    """Options of set pieces: a penalty can only be shot (worth its fixed value), the taker isn't an option, nor is the goal from a throw-in; the rest is renormalised."""
    from ..functions.vocab import RESTARTS

    info = actions.where(F.col(kind).isin(*RESTARTS)).select(key, F.col(player).alias("_taker"), F.col(kind).alias("_kind"))
    o = merged(options).join(merged(info), key, "left")
    goal = F.col("option") == F.concat(F.substring("_taker", 1, 4), F.lit("_goal"))
    penalty, throw = F.col("_kind") == "shot_penalty", F.col("_kind") == "throw_in"
    gone = (F.col("option") == F.col("_taker")) | (throw & goal)
    select = F.when(F.col("_kind").isNull(), F.col("select_p")).when(penalty, F.when(goal, 1.0).otherwise(0.0)).when(gone, 0.0).otherwise(F.col("select_p"))
    o = o.withColumn("select_p", select)
    total = F.sum("select_p").over(W.partitionBy(key))
    first, second = (PENALTY_VALUE, 1.0) if penalty_as_success else (1.0, PENALTY_VALUE)
    return o.withColumns(
        {
            "select_p": F.when(F.col("_kind").isNull() | penalty, F.col("select_p")).otherwise(F.try_divide(F.col("select_p"), total)),
            "success_p": F.when(penalty & goal, F.lit(first)).when(F.col("_kind").isNotNull() & ~penalty & gone, F.lit(0.0)).otherwise(F.col("success_p")),
            "s_score": F.when(penalty & goal, F.lit(second)).otherwise(F.col("s_score")),
        }
    ).drop("_taker", "_kind")


def total_value(options: Column) -> Column:
    """Value of a row's array of options, weighted by their selection."""

    def value(o: Column) -> Column:
        good, bad = o["s_score"] - o["s_concede"], o["f_score"] - o["f_concede"]
        return o["select_p"] * (o["success_p"] * good + (1 - o["success_p"]) * bad)

    return F.aggregate(options, F.lit(0.0), lambda acc, o: acc + value(o))


def possession_values(actions: DataFrame, before: DataFrame | str, after: DataFrame | str, key: str) -> DataFrame:
    """Adds start, end, diff and defense_type to actions (team, action_type, spadl_type, success, offside, receiver_id, next_type, end_player_id, end_type).

    Options before and after are long tables, or names of columns of ``actions`` that hold them as arrays; then nothing is joined or shuffled.
    """
    if isinstance(before, str) and isinstance(after, str):
        return _defended(actions.withColumns({"_v0": total_value(F.col(before)), "_v1": total_value(F.col(after))}).drop(before, after))
    total = lambda o, name: o.groupBy(key).agg(F.sum(F.col("select_p") * option_value()).alias(name))
    return _defended(actions.join(merged(total(before, "_v0")), key, "left").join(merged(total(after, "_v1")), key, "left"))


def _defended(a: DataFrame) -> DataFrame:
    """start, end, diff and defense_type of actions with the value before (_v0) and after (_v1)."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    start = F.when(yes(F.col("spadl_type").startswith("corner")), F.lit(CORNER_VALUE)).otherwise(F.col("_v0"))
    a = a.withColumn("start", start)
    end_team = F.substring("end_player_id", 1, 4)
    same = yes(end_team == F.col("team"))
    end = F.when(F.col("offside"), F.col("start")).when(yes(F.col("end_type").startswith("corner")), F.lit(CORNER_VALUE)).otherwise(F.col("_v1"))
    end = F.when(same, end).otherwise(-end)
    end = F.when(F.col("spadl_type") == "own_goal", -1.0).when((F.col("action_type") == "shot") & F.col("success"), 1.0).otherwise(end)
    a = a.withColumn("end", end).withColumn("diff", F.col("end") - F.col("start"))
    other = F.substring("receiver_id", 1, 4)
    taken = yes((other != F.col("team")) & (F.substring("receiver_id", 1, 4) != "out"))
    touch = yes(F.col("next_type") == "bad_touch")
    done = F.col("success")
    base = (
        F.when(done & yes(F.col("diff") >= 0), "concede")
        .when(done & yes(F.col("diff") < 0) & ~(touch & ~same), "deter")
        .when(~done & ~taken, "disturb")
        .when(~done & taken & touch & same, "concede")
        .when(~done & taken, "intercept")
    )
    kind = F.concat(base, F.when(F.col("action_type") == "shot", "_shot").otherwise("_pass"))
    return a.withColumn("defense_type", F.when(yes(F.col("next_type") == "foul") & same, "foul").otherwise(kind)).drop("_v0", "_v1")


def pass_credits(values: DataFrame, options: DataFrame | str, posteriors: DataFrame | Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Credits of passes and dribbles, one row per action, option and defender that gets any.

    Interception: the receiver gets the success share and everybody the rest by posterior; disturbing and conceding: by posterior of the intended option;
    deterring: over the options that were worth more than the start, by how unlikely and valuable they were.

    Options and posteriors are long tables; or ``options`` names a column of ``values`` that holds them as an array, and ``posteriors`` unfolds rows of one option each into one row per
    defender.  Then nothing is joined or shuffled, and only options that bring a credit are unfolded.
    """
    kind, start = F.col("defense_type").alias("_kind"), F.col("start").alias("_start")
    if isinstance(options, str):
        rows = values.where("action_type <> 'shot' AND defense_type IN ('intercept_pass', 'disturb_pass', 'concede_pass', 'deter_pass')")
        scores = lambda o: (o["s_score"] - o["s_concede"], o["f_score"] - o["f_concede"])

        def deterred(o: Column) -> Column:
            good, bad = scores(o)
            return F.when(good >= F.col("start"), (1 - o["success_p"]) * (good - bad)).otherwise(0.0)

        rows = G.held(rows, _den=F.aggregate(options, F.lit(0.0), lambda acc, o: acc + deterred(o)))
        rows = rows.select("*", F.explode(options).alias("_o")).where(F.coalesce(F.col("_o.option") == F.col("intent_id"), F.lit(False)) & (F.col("defense_type") != "deter_pass") | (F.col("defense_type") == "deter_pass") & (F.col("_den") > 0))
        rows = rows.withColumns({"option": F.col("_o.option"), "success_p": F.col("_o.success_p"), "_det": deterred(F.col("_o")), "team_credit": -F.col("diff")})
        c = posteriors(rows).select(key, "intent_id", "receiver_id", "team_credit", kind, "option", "defender", "posterior", "success_p", "_det", "_den")
    else:
        v = values.where("action_type <> 'shot'").select(key, "intent_id", "receiver_id", start, (-F.col("diff")).alias("team_credit"), kind)
        o = options.select(key, "option", "success_p", (F.col("s_score") - F.col("s_concede")).alias("_s"), (F.col("f_score") - F.col("f_concede")).alias("_f"))
        o = merged(o).join(merged(v.select(key, "_start")), key)
        o = o.withColumn("_det", F.when(F.col("_s") >= F.col("_start"), (1 - F.col("success_p")) * (F.col("_s") - F.col("_f"))).otherwise(0.0))
        o = o.withColumn("_den", F.sum("_det").over(W.partitionBy(key))).drop("_start")
        c = merged(merged(posteriors).join(merged(v), key)).join(merged(o), [key, "option"], "left")
    target = F.coalesce(F.col("option") == F.col("intent_id"), F.lit(False))
    catcher = F.coalesce(F.col("defender") == F.col("receiver_id"), F.lit(False))
    cut, mid, det = F.col("_kind") == "intercept_pass", F.col("_kind").isin("disturb_pass", "concede_pass"), (F.col("_kind") == "deter_pass") & (F.col("_den") > 0)
    share = F.coalesce(F.col("_det"), F.lit(0.0)) / F.col("_den")
    c = c.withColumns(
        {
            "defense_type": F.when(cut & target & catcher, "intercept_pass").when(cut & target, "disturb_pass").when(mid & target, F.col("_kind")).when(det, "deter_pass"),
            "option_resp": F.when((cut | mid) & target, 1.0).when(det, share).otherwise(0.0),
            "weight": F.when(cut & target, (1 - F.col("success_p")) * F.col("posterior") + F.when(catcher, F.col("success_p")).otherwise(0.0)).when(mid & target, F.col("posterior")).when(det, share * F.col("posterior")).otherwise(0.0),
        }
    )
    return c.where(F.col("defense_type").isNotNull()).select(key, "option", "defender", "defense_type", "team_credit", "option_resp", "weight", (F.col("team_credit") * F.col("weight")).alias("player_credit"))


def shot_credits(values: DataFrame, options: DataFrame | str, posteriors: DataFrame | Callable[[DataFrame], DataFrame], key: str, keeper: str = "keeper_id", on: str = "unblocked") -> DataFrame:
    """Credits of shots: goals, saves, blocks, woodwork and misses; ``keeper`` names the other side's keeper at the shot.  Options and posteriors as in ``pass_credits``."""
    v0, v1 = F.col("start").alias("_v0"), F.when(F.col("success"), 1.0).otherwise(F.col("end")).alias("_v1")
    known = [key, "intent_id", "receiver_id", "success", "next_type", "woodwork", keeper]
    if isinstance(options, str):
        intended = F.explode(F.filter(options, lambda o: o["option"] == F.col("intent_id")))
        rows = values.where("action_type = 'shot'").select("*", intended.alias("_o")).withColumn("option", F.col("_o.option"))
        c = posteriors(rows).where("defender <> 'out'").select(*known, v0, v1, "option", "defender", "posterior", F.col("_o.success_p").alias("_p"), F.col("_o.s_score").alias("_xg"))
    else:
        v = values.where("action_type = 'shot'").select(*known, v0, v1)
        o = options.select(key, F.col("option").alias("intent_id"), F.col("success_p").alias("_p"), F.col("s_score").alias("_xg"))
        c = merged(merged(posteriors.where("defender <> 'out'")).join(merged(v), key).where("option = intent_id")).join(merged(o), [key, "intent_id"], "left")
    is_keeper = F.coalesce(F.col("defender") == F.col(keeper), F.lit(False))
    field = F.when(is_keeper, 0.0).otherwise(F.col("posterior"))
    c = c.withColumn("_q", F.try_divide(field, F.sum(field).over(W.partitionBy(key))))
    goal, save, block = F.col("success"), F.col("next_type") == "keeper_save", F.col("next_type") == "shot_block"
    wood = F.col("woodwork")
    missed = (F.col("receiver_id") == "out") | (F.substring("receiver_id", 1, 4) == F.substring("intent_id", 1, 4))
    xg = F.col("_xg") * F.col("_p")
    unblocked = {"on_target": xg / F.least(F.col("_p") + (1 - xg) * SHOT_OUT_SHARE, F.lit(1.0)), "unblocked": F.col("_xg")}.get(on, F.col("_v0"))
    catcher = F.coalesce(F.col("defender") == F.col("receiver_id"), F.lit(False))
    team = F.when(goal, F.col("_v0") - 1).when(save | block, F.col("_v0") - F.col("_v1")).when(wood, F.least(F.col("_v0") - 0.5, F.lit(0.0))).when(missed, F.col("_v0") - unblocked).otherwise(0.0)
    kind = F.when(goal, "concede_shot").when(save, F.when(is_keeper, "intercept_shot").otherwise("concede_shot")).when(block, F.when(catcher, "intercept_shot").otherwise("disturb_shot")).when(wood | missed, "concede_shot")
    player = (
        F.when(goal, (F.col("_v0") - 1) * F.col("posterior"))
        .when(save, F.when(is_keeper, F.col("_xg") - F.col("_v1")).otherwise((F.col("_v0") - F.col("_xg")) * F.col("_q")))
        .when(block, (F.col("_v0") - F.col("_v1")) * ((1 - F.col("_p")) * F.col("_q") + F.when(catcher, F.col("_p")).otherwise(0.0)))
        .when(wood, F.least(F.col("_v0") - 0.5, F.lit(0.0)) * F.col("posterior"))
        .when(missed, F.when(is_keeper, 0.0).otherwise((F.col("_v0") - unblocked) * F.col("_q")))
        .otherwise(0.0)
    )
    return c.select(key, "option", "defender", kind.alias("defense_type"), team.alias("team_credit"), player.alias("player_credit"))


def foul_credits(values: DataFrame, events: DataFrame) -> DataFrame:
    """Credit to the one opponent who fouls within the two rows after an action that a foul follows; needs match_id, period_id, action_id on both."""
    w = W.partitionBy("match_id").orderBy("action_id")
    rival = lambda n: F.struct(F.lead("object_id", n).over(w).alias("who"), F.lead("success", n).over(w).alias("won"), ((F.lead("spadl_type", n).over(w) == "foul") & (F.lead("team", n).over(w) != F.col("team"))).alias("foul"))
    nxt = events.select("match_id", "action_id", rival(1).alias("_a"), rival(2).alias("_b"))
    c = values.where("next_type = 'foul'").join(nxt, ["match_id", "action_id"])
    a, b = F.coalesce("_a.foul", F.lit(False)), F.coalesce("_b.foul", F.lit(False))
    one = F.when(a & ~b, F.col("_a")).when(b & ~a, F.col("_b"))
    c = c.withColumn("_f", one).where("_f IS NOT NULL")
    kind = F.when(~F.col("_f.won"), "foul").when(F.col("action_type") == "shot", "disturb_shot").otherwise("disturb_pass")
    return c.select("match_id", "action_id", F.col("intent_id").alias("option"), F.col("_f.who").alias("defender"), kind.alias("defense_type"), (-F.col("diff")).alias("player_credit"))


CREDIT_TYPES = ("intercept_pass", "disturb_pass", "deter_pass", "concede_pass", "intercept_shot", "disturb_shot", "concede_shot", "foul")


def player_scores(credits: DataFrame, lineup: DataFrame, times: DataFrame) -> DataFrame:
    """One row per player: credit by type, their total, line-up data and playing times."""
    from .relational import pivot_sum

    scores = pivot_sum(credits, "defender", "defense_type", list(CREDIT_TYPES), "player_credit").withColumnRenamed("defender", "object_id")
    return lineup.join(scores, "object_id").join(times, "object_id").na.fill(0.0)


def propensity_weights(rows: DataFrame, p: str, floor: float = 0.01) -> DataFrame:
    """Adds weight: inverse probabilities, floored and divided by their mean over all rows (one number, so no window over everything)."""
    inverse = 1 / F.greatest(F.col(p), F.lit(floor))
    mean = rows.agg(F.avg(inverse)).first()[0]
    return rows.withColumn("weight", inverse / F.lit(float(mean or 1.0)))
