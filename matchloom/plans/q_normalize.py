"""Queries of clocks, orientation, splits, validation, tracking kernels and page tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import external as E
from ..operators import normalize as N
from ..operators import relational as R
from ..operators import sync as Y
from ..operators import tracking as T
from ..operators import validate as V
from ..sources import readers
from . import lens
from .lens import table, with_actions
from .q_sequence import R6

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


BOUNDS = ", b AS (SELECT match_id, period_id, min(epoch_us(ts)) AS st, coalesce(max(CASE WHEN spadl_type = 'goalkick' THEN epoch_us(ts) END), max(epoch_us(ts))) AS en FROM a GROUP BY ALL), c AS (SELECT *, (en - st) / 1e6 AS len FROM b)"


def raw(spark, d):
    return lens.raw_actions(spark, d).withColumn("event_type", F.when(F.col("spadl_type") == "goalkick", "FinalWhistle").otherwise("Play"))


@query("n02_period_bounds", with_actions(BOUNDS + "SELECT match_id, period_id, len AS length FROM c"))
def period_bounds(spark, d):
    """Length of each period, to its last goal kick here."""
    return N.period_bounds(raw(spark, d)).select("match_id", "period_id", "length")


@query("n04_match_clock", with_actions(BOUNDS + f", e AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY match_id ORDER BY period_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS be FROM c) SELECT a.event_id, {R6.format('be + greatest((epoch_us(ts) - st) / 1e6, 0.0)')} AS clock FROM a JOIN e ON a.match_id = e.match_id AND a.period_id = e.period_id"))
def match_clock(spark, d):
    """Seconds of play up to each event."""
    r = raw(spark, d)
    return N.match_clock(r, N.period_bounds(r)).select("event_id", G.at_6(F.col("clock")).alias("clock"))


@query(
    "n05_minutes_played",
    """WITH l AS (SELECT DISTINCT user_id AS match_id, (event_id % 14)::VARCHAR AS player_id, event_id % 14 < 11 AS starting FROM events), s AS (SELECT user_id AS match_id, max(CASE WHEN event_type = 'view' THEN value * 60 END) AS ck FROM events GROUP BY 1)
, r AS (SELECT user_id AS match_id, (event_id % 14)::VARCHAR AS player_id, min(value * 90) AS red FROM events WHERE event_type = 'error' AND value > 80 GROUP BY 1, 2)
, x AS (SELECT l.*, CASE WHEN player_id = '12' THEN ck END AS i, CASE WHEN player_id = '3' THEN ck END AS o, red FROM l LEFT JOIN s USING (match_id) LEFT JOIN r USING (match_id, player_id))
, y AS (SELECT *, coalesce(i, CASE WHEN starting THEN 0.0::DOUBLE END) AS st FROM x), z AS (SELECT *, CASE WHEN st IS NOT NULL THEN greatest(st, least(coalesce(o, 5400.0::DOUBLE), coalesce(red, 5400.0::DOUBLE))) END AS en FROM y)
SELECT match_id, player_id, coalesce(floor((en - st) / 60 * 100 + 0.5) / 100, 0.0) AS mins_played FROM z""",
)
def minutes_played(spark, d):
    """Minutes on the pitch after substitutions and red cards."""
    e = table(spark, d, "events")
    lineup = e.select(F.col("user_id").alias("match_id"), (F.col("event_id") % 14).cast("string").alias("player_id"), (F.col("event_id") % 14 < 11).alias("starting")).distinct()
    subs = e.groupBy(F.col("user_id").alias("match_id")).agg(F.max(F.when(F.col("event_type") == "view", F.col("value") * 60)).alias("clock")).select("match_id", "clock", F.lit("12").alias("player_in"), F.lit("3").alias("player_out"))
    reds = e.where("event_type = 'error' AND value > 80").select(F.col("user_id").alias("match_id"), (F.col("event_id") % 14).cast("string").alias("player_id"), (F.col("value") * 90).alias("clock"))
    ends = e.select(F.col("user_id").alias("match_id"), F.lit(5400.0).alias("end_clock")).distinct()
    return N.minutes_played(lineup, subs, reds, ends).select("match_id", "player_id", "mins_played")


@query("n06_keeper_oriented", with_actions(", m AS (SELECT match_id, period_id, avg(CASE WHEN team = 'home' THEN start_x END) > avg(CASE WHEN team = 'away' THEN start_x END) AS t FROM a WHERE object_id IN ('home_1', 'away_1') GROUP BY ALL) SELECT a.event_id, CASE WHEN coalesce(t, false) THEN floor((105.0::DOUBLE - start_x) * 100 + 0.5) / 100 ELSE start_x END AS start_x FROM a LEFT JOIN m ON a.match_id = m.match_id AND a.period_id = m.period_id"))
def keeper_oriented(spark, d):
    """Periods turned so that the home keeper is on the left."""
    a = lens.raw_actions(spark, d)
    keepers = a.where("object_id IN ('home_1', 'away_1')").select("match_id", "object_id").distinct()
    return N.keeper_oriented(a, keepers).select("event_id", "start_x")


RAW = "CASE event_type WHEN 'view' THEN 'Pass' WHEN 'click' THEN 'Cross' WHEN 'purchase' THEN 'Shot' WHEN 'error' THEN 'Foul' ELSE 'Recovery' END"
PIECE = "CASE event_id % 9 WHEN 0 THEN 'Penalty' WHEN 1 THEN 'FreeKick' WHEN 2 THEN 'CornerKick' WHEN 3 THEN 'ThrowIn' WHEN 4 THEN 'GoalKick' END"
STRICT = f"""WITH e AS (SELECT event_id, value, {RAW} AS k, {PIECE} AS p FROM events), t AS (SELECT *, CASE k WHEN 'Pass' THEN CASE p WHEN 'ThrowIn' THEN 'throw_in' WHEN 'GoalKick' THEN 'goalkick' WHEN 'CornerKick' THEN 'corner_short' WHEN 'FreeKick' THEN 'freekick_short' ELSE 'pass' END
  WHEN 'Cross' THEN CASE p WHEN 'CornerKick' THEN 'corner_crossed' WHEN 'FreeKick' THEN 'freekick_crossed' ELSE 'cross' END WHEN 'Shot' THEN CASE p WHEN 'FreeKick' THEN 'shot_freekick' WHEN 'Penalty' THEN 'shot_penalty' ELSE 'shot' END WHEN 'Foul' THEN 'foul' END AS spadl_type FROM e)"""


def strictly_typed(spark, d):
    m = F.col("event_id") % 9
    piece = F.when(m == 0, "Penalty").when(m == 1, "FreeKick").when(m == 2, "CornerKick").when(m == 3, "ThrowIn").when(m == 4, "GoalKick")
    kind = F.when(F.col("event_type") == "view", "Pass").when(F.col("event_type") == "click", "Cross").when(F.col("event_type") == "purchase", "Shot").when(F.col("event_type") == "error", "Foul").otherwise("Recovery")
    return table(spark, d, "events").withColumn("spadl_type", N.strict_type(kind, piece))


@query("n09_strict_types", STRICT + " SELECT event_id, spadl_type FROM t")
def strict_types(spark, d):
    """Action types from raw types and set pieces."""
    return strictly_typed(spark, d).select("event_id", "spadl_type")


@query(
    "n12_result_ids",
    STRICT
    + """ SELECT event_id, CASE WHEN event_id % 29 = 0 AND spadl_type IN ('pass', 'cross', 'throw_in', 'freekick_crossed', 'freekick_short', 'corner_crossed', 'corner_short', 'goalkick') THEN 2 WHEN spadl_type IS NOT NULL AND spadl_type <> 'foul' AND value < 60 THEN 1 ELSE 0 END AS result_id,
CASE WHEN spadl_type = 'throw_in' THEN 2 WHEN spadl_type LIKE 'shot%' THEN CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 0 END WHEN spadl_type IS NULL OR spadl_type = 'foul' THEN 2 ELSE 0 END AS bodypart_id FROM t""",
)
def result_ids(spark, d):
    """Result and body-part ids."""
    m = F.col("event_id") % 4
    part = F.when(m == 0, "Head").when(m == 1, "LeftFoot").when(m == 2, "RightFoot")
    result = F.when(F.col("event_id") % 29 == 0, "Offside")
    k = F.col("spadl_type")
    return strictly_typed(spark, d).select("event_id", N.result_id(k, result, F.col("value") < 60).alias("result_id"), N.body_part_id(k, part).alias("bodypart_id"))


def typed(a):
    return a.withColumn("spadl_type", F.when(F.col("k") % 4 == 0, "take_on").when(F.col("k") % 4 == 1, "tackle").when(F.col("k") % 4 == 2, "ball_recovery").otherwise("pass"))


@query(
    "n10_contextual_types",
    with_actions(
        """, v AS (SELECT * REPLACE (CASE k % 4 WHEN 0 THEN 'take_on' WHEN 1 THEN 'tackle' WHEN 2 THEN 'ball_recovery' ELSE 'pass' END AS spadl_type) FROM a)
, e AS (SELECT *, lag(spadl_type) OVER w AS b, lead(spadl_type) OVER w AS n, lag(team) OVER w AS bt, lag(success) OVER w AS bs FROM v WINDOW w AS (PARTITION BY match_id, period_id ORDER BY action_id))
SELECT match_id, action_id, CASE WHEN spadl_type = 'take_on' AND NOT success AND n = 'tackle' THEN 'dispossessed' WHEN spadl_type = 'take_on' AND b = 'take_on' THEN 'second_take_on' WHEN spadl_type = 'ball_recovery' AND b IN ('pass', 'cross') AND bt <> team AND NOT bs THEN 'interception' ELSE spadl_type END AS spadl_type FROM e"""
    ),
)
def contextual_types(spark, d):
    """Types that depend on the rows around."""
    return N.contextual_type(typed(lens.actions(spark, d))).select("match_id", "action_id", "spadl_type")


#: Raw rows of a provider: mostly touches among five players, with duels, passes, shots and clearances between them.
RAW_KINDS = ("OtherBallAction",) * 7 + ("AerialDuel", "GroundDuel", "GroundDuel", "GroundDuel", "Pass", "Cross", "Shot", "Clearance", "Interception", "Foul")
RAW_TYPES = {"Pass": "pass", "Cross": "cross", "Shot": "shot", "Clearance": "clearance", "Interception": "interception", "Foul": "foul"}


def raw_rows(a):
    """Actions read as raw rows: kind, players and teams by fixed formulas."""
    n, k = F.col("event_id"), F.col("k")
    kind = F.element_at(F.array(*map(F.lit, RAW_KINDS)), ((n * 31 + k * 7) % len(RAW_KINDS)).cast("int") + 1)
    who, other = (n * 13 + k * 3) % 5, (n * 7 + k) % 5
    base = F.coalesce(*[F.when(F.col("event_type") == x, y) for x, y in RAW_TYPES.items()])
    return a.withColumns({"event_type": kind, "player_id": F.concat(F.lit("P"), who), "receiver_player_id": F.concat(F.lit("P"), other), "team_id": F.concat(F.lit("T"), who % 2)}).withColumns({"spadl_type": base, "success": F.when(base.isin("pass", "cross", "shot"), k % 3 == 0)})


_KINDS = "[" + ", ".join(f"'{x}'" for x in RAW_KINDS) + "]"
_RAW = f"""
, v AS (SELECT match_id, period_id, action_id, {_KINDS}[(event_id * 31 + k * 7) % {len(RAW_KINDS)} + 1] AS kind, 'P' || (event_id * 13 + k * 3) % 5 AS me, 'P' || (event_id * 7 + k) % 5 AS other, 'T' || (event_id * 13 + k * 3) % 5 % 2 AS team, k FROM a)
, u AS (SELECT *, CASE kind {' '.join(f"WHEN '{x}' THEN '{y}'" for x, y in RAW_TYPES.items())} END AS base, CASE WHEN kind IN ('Pass', 'Cross', 'Shot') THEN k % 3 = 0 END AS good, contains(kind, 'Duel') AS duel FROM v)
, w AS (SELECT *, lag(kind) OVER o AS pk, lag(me) OVER o AS pm, lag(other) OVER o AS po, lead(kind) OVER o AS nk, lead(me) OVER o AS nm, lead(other) OVER o AS no, lead(kind, 2) OVER o AS tk, lead(me, 2) OVER o AS tm, lead(other, 2) OVER o AS tt,
   last_value(CASE WHEN NOT duel THEN {{'kind': kind, 'team': team, 'other': other, 'good': good}} END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM u WINDOW o AS (PARTITION BY match_id ORDER BY action_id))
, x AS (SELECT *, CASE WHEN kind <> 'OtherBallAction' THEN NULL
   WHEN r.kind IN ('Pass', 'Cross') AND r.other = me AND NOT r.good THEN 'received' WHEN r.kind = 'Shot' AND r.other = me AND NOT r.good THEN 'blocked'
   WHEN nk = 'GroundDuel' AND nm = me AND pk = 'OtherBallAction' AND no = pm THEN 'won_from_touch' WHEN nk = 'GroundDuel' AND nm = me AND r.team <> team THEN 'won_from_team'
   WHEN nk = 'GroundDuel' AND no = me THEN 'lost' WHEN pk = 'GroundDuel' AND me IN (pm, po) THEN 'after_duel'
   WHEN nk IS NOT NULL AND NOT coalesce(pk = 'GroundDuel' AND me IN (pm, po), false) AND NOT (nk = 'GroundDuel' AND me IN (nm, no)) AND NOT coalesce(tk = 'GroundDuel' AND me IN (tm, tt), false) AND nm <> me THEN 'no_duel'
   WHEN r.kind = 'Clearance' THEN 'recovery' END AS rule FROM w)
, y AS (SELECT *, coalesce(CASE rule WHEN 'received' THEN CASE WHEN (nk = 'AerialDuel' AND nm = me) OR coalesce(pk = 'AerialDuel' AND pm = me, false) THEN 'clearance' ELSE 'interception' END WHEN 'blocked' THEN 'shot_block' WHEN 'won_from_touch' THEN 'tackle'
   WHEN 'lost' THEN 'dispossessed' WHEN 'no_duel' THEN 'bad_touch' WHEN 'recovery' THEN 'ball_recovery' END, base) AS t0, coalesce(rule IN ('won_from_team', 'after_duel'), false) AS carried FROM x)
, z AS (SELECT *, CASE WHEN carried THEN CASE WHEN last_value(CASE WHEN NOT duel AND NOT carried THEN coalesce(t0 IN ('interception', 'clearance'), false) END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'interception' ELSE 'tackle' END ELSE t0 END AS t1,
   CASE WHEN rule = 'won_from_touch' THEN 'dispossessed' WHEN rule = 'lost' AND pk = 'OtherBallAction' AND nm = pm THEN 'tackle' END AS said FROM y)
, q AS (SELECT *, lead(said) OVER (PARTITION BY match_id ORDER BY action_id) AS told FROM z)
, s AS (SELECT match_id, period_id, action_id, team, good, coalesce(told, t1) AS spadl_type, CASE WHEN told IS NOT NULL THEN 'told' ELSE rule END AS rule FROM q)
, n AS (SELECT match_id, action_id, lead(period_id) OVER o AS np, lead(team) OVER o AS nt FROM s WHERE spadl_type IS NOT NULL WINDOW o AS (PARTITION BY match_id ORDER BY action_id))
SELECT s.match_id, s.action_id, s.spadl_type, s.rule, CASE WHEN spadl_type IN ('interception', 'tackle', 'dispossessed', 'ball_recovery', 'shot_block') THEN true WHEN spadl_type = 'foul' THEN false
  WHEN spadl_type IN ('clearance', 'bad_touch') THEN coalesce(np = period_id AND nt = team, false) ELSE good END AS success FROM s LEFT JOIN n USING (match_id, action_id)"""


@query("n10_touch_types", with_actions(_RAW))
def touch_types(spark, d):
    """Every touch of raw rows typed by the rows around it; each rule occurs."""
    return N.touch_types(raw_rows(lens.actions(spark, d))).select("match_id", "action_id", "spadl_type", "rule", "success")


@query(
    "n15_to_actions",
    with_actions(
        """, q AS (SELECT match_id, period_id, event_id, CASE WHEN k % 10 = 0 THEN NULL ELSE spadl_type END AS spadl_type, object_id, receiver_id, (k - 3)::DOUBLE AS seconds, CASE WHEN spadl_type = 'foul' THEN NULL ELSE start_x END AS start_x FROM a)
, kept AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY period_id, seconds, event_id) - 1 AS action_id FROM q WHERE spadl_type IS NOT NULL AND seconds >= 0)
, p AS (SELECT *, greatest(0.0::DOUBLE, least(105.0::DOUBLE, coalesce(start_x, CASE WHEN spadl_type = 'foul' THEN last_value(start_x IGNORE NULLS) OVER (PARTITION BY match_id, period_id ORDER BY action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END))) AS sx FROM kept)
, r AS (SELECT x.match_id, x.action_id, arg_min(y.sx, y.action_id) AS ex FROM p x JOIN p y ON x.match_id = y.match_id AND x.period_id = y.period_id AND y.object_id = x.receiver_id AND y.action_id > x.action_id WHERE y.sx IS NOT NULL OR true GROUP BY ALL)
, s AS (SELECT p.*, lead(sx) OVER (PARTITION BY p.match_id, p.period_id ORDER BY p.action_id) AS nx FROM p)
SELECT s.match_id, s.action_id, s.event_id, sx AS start_x FROM s"""
    ),
)
def to_actions(spark, d):
    """Actions from raw events: filtered, repaired, numbered (starts are compared; ends have their own query)."""
    a = lens.raw_actions(spark, d).withColumns({"spadl_type": F.when(F.col("k") % 10 == 0, None).otherwise(F.col("spadl_type")), "seconds": (F.col("k") - 3).cast("double"), "start_x": F.when(F.col("spadl_type") != "foul", F.col("start_x")), "end_x": F.lit(None).cast("double"), "end_y": F.lit(None).cast("double")})
    return N.to_actions(a)[0].select("match_id", "action_id", "event_id", "start_x")


@query("n37_chronological_split", "WITH m AS (SELECT user_id AS match_id, min(ts) AS k FROM events GROUP BY 1) SELECT match_id, CASE WHEN row_number() OVER (ORDER BY k, match_id) <= 100 THEN 'train' ELSE 'test' END AS split FROM m")
def chronological_split(spark, d):
    """The first hundred matches train, the others test."""
    m = table(spark, d, "events").groupBy(F.col("user_id").alias("match_id")).agg(F.min("ts").alias("kickoff"))
    return N.chronological_split(m, 100)


@query("n28_stable_teams", "SELECT o_custkey AS game_id, CASE WHEN count(DISTINCT o_orderstatus) = 2 THEN min(o_orderstatus) END AS home_team, CASE WHEN count(DISTINCT o_orderstatus) = 2 THEN max(o_orderstatus) END AS away_team FROM orders GROUP BY 1")
def stable_teams(spark, d):
    """Two names in order become home and away."""
    return N.stable_teams(table(spark, d, "orders").select(F.col("o_custkey").alias("game_id"), F.col("o_orderstatus").alias("team")))


@query("n42_clock_strings", "SELECT event_id, printf('%02d:%02d.%02d', floor(floor(value * 37) / 60)::INT, (floor(value * 37) % 60)::INT, (round_even((value * 37 - floor(value * 37)) * 100, 0) % 100)::INT) AS clock FROM events")
def clock_strings(spark, d):
    return table(spark, d, "events").select("event_id", G.clock(F.col("value") * 37).alias("clock"))


@query("v01_event_violations", with_actions("SELECT 'period_id' AS rule, 0::BIGINT AS n UNION ALL SELECT 'ts', 0 UNION ALL SELECT 'object_id', 0 UNION ALL SELECT 'spadl_type', 0 UNION ALL SELECT 'success', 0 UNION ALL SELECT 'start_x', count(*) FILTER (WHERE start_x + 20 > 105) FROM a UNION ALL SELECT 'start_y', 0"))
def event_violations(spark, d):
    """Rows that break each rule of the event table (x is shifted to have some)."""
    return V.violations(lens.raw_actions(spark, d).withColumn("start_x", F.col("start_x") + 20), V.event_rules())


@query("v05_not_contiguous", with_actions(", f AS (SELECT * FROM a WHERE k <> 7) SELECT match_id, count(*) AS n, min(action_id) AS low, max(action_id) AS high FROM f GROUP BY match_id HAVING min(action_id) <> 0 OR max(action_id) <> count(*) - 1"))
def not_contiguous(spark, d):
    """Matches whose action numbers have holes."""
    return V.contiguous(lens.actions(spark, d).where("k <> 7"), "match_id", "action_id").select("match_id", "n", "low", "high")


@query("s14_overlapping", "WITH p AS (SELECT user_id AS match_id, event_id, floor(epoch(ts) / 60)::BIGINT AS frame_start, floor(epoch(ts) / 60)::BIGINT + CAST(value * 20 AS BIGINT) AS frame_end FROM events), q AS (SELECT *, lag(frame_end) OVER (PARTITION BY match_id ORDER BY frame_start, frame_end) AS e FROM p) SELECT match_id, event_id FROM q WHERE frame_start <= e")
def overlapping(spark, d):
    """Possessions that begin before the last one ends."""
    start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    p = table(spark, d, "events").select(F.col("user_id").alias("match_id"), "event_id", start.alias("frame_start"), (start + F.round(F.col("value") * 20).cast("long")).alias("frame_end"))
    return T.overlapping(p).select("match_id", "event_id")


@query("n30_frozen", with_actions(", n AS (SELECT match_id, min(frame_id) FILTER (WHERE k > 50) AS af, arg_min(object_id, frame_id) FILTER (WHERE k > 50) AS ca FROM a GROUP BY match_id), u AS (SELECT DISTINCT ON (match_id, frame_id, object_id) match_id, frame_id, object_id, start_x AS x FROM a ORDER BY match_id, frame_id, object_id, event_id), h AS (SELECT u.match_id, u.object_id, u.x AS hx FROM u JOIN n ON u.match_id = n.match_id AND u.frame_id = af AND u.object_id = ca) SELECT u.match_id, u.frame_id, u.object_id, CASE WHEN u.frame_id > af AND hx IS NOT NULL THEN hx ELSE x END AS x FROM u LEFT JOIN n ON u.match_id = n.match_id LEFT JOIN h ON u.match_id = h.match_id AND u.object_id = h.object_id"))
def frozen(spark, d):
    """After the anchor, the carrier keeps its place."""
    a = lens.actions(spark, d)
    anchors = a.where("k > 50").groupBy(F.col("match_id").alias("situation_id")).agg(F.min("frame_id").alias("anchor_frame"), F.min_by("object_id", "frame_id").alias("carrier_id"))
    first = R.first_per_key(a, ["match_id", "frame_id", "object_id"], [F.col("event_id")])
    t = first.select(F.col("match_id").alias("situation_id"), "frame_id", "object_id", F.col("start_x").alias("x"), F.col("start_y").alias("y"))
    return T.frozen(t, anchors).select(F.col("situation_id").alias("match_id"), "frame_id", "object_id", "x")


@query("y18_linear_scores", with_actions(f"SELECT event_id, {R6.format('(greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 20.0::DOUBLE)) + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (3 - k / 10.0::DOUBLE) / 3.0::DOUBLE))) * 50')} AS score FROM a"))
def linear_scores(spark, d):
    """Two clamped linear scores, averaged."""
    s = Y.score_column([(F.col("value"), 0, 20, True), (F.col("k") / F.lit(10.0), 0, 3, False)])
    return lens.raw_actions(spark, d).select("event_id", G.at_6(s).alias("score"))


@query("s20_page_tables")
def page_tables(spark, d):
    """Table rows of pages."""
    return readers.squad_rows(table(spark, d, "pages"))


def dense(spark, d, frames: int = 150):
    """Dense tracking in closed form: a ball that home_2 kicks off and passes to home_3 across the centre, four players and a rival."""
    m = table(spark, d, "events").select(F.col("user_id").alias("match_id")).distinct()
    t = m.select("match_id", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame_id"))
    s = F.col("frame_id")
    kicked = F.greatest(s - 20 - F.col("match_id") % 5, F.lit(0)).cast("double")
    ball = F.least(F.lit(52.5) + kicked * 0.5, F.lit(75.0))
    spots = {"ball": (ball, F.lit(34.0)), "home_2": (F.lit(52.0), F.lit(34.0)), "home_3": (F.lit(75.5), F.lit(34.2)), "home_4": (F.lit(30.0), F.lit(20.0)), "away_2": (F.lit(62.0), F.lit(44.0) - s * 0.02)}
    arr = F.array(*[F.struct(F.lit(n).alias("object_id"), x.cast("double").alias("x"), y.cast("double").alias("y")) for n, (x, y) in spots.items()])
    return t.select("match_id", F.lit(1).alias("period_id"), s.cast("long").alias("frame_id"), F.inline(arr))


@query("w15_kinematics")
def kinematics(spark, d):
    """Velocity, speed and acceleration of every object (a kernel: held against plain loops in tests)."""
    return T.with_kinematics(dense(spark, d))


@query("y16_synced_matches")
def synced_matches(spark, d):
    """Frames and receipts of a kickoff pass and its reception in every match (order-dependent: held against a known kick in tests)."""
    k = T.with_kinematics(dense(spark, d))
    tracking = k.select("match_id", "period_id", "frame_id", "object_id", (F.col("frame_id") / F.lit(25.0)).alias("utc"), "x", "y", F.lit(0.0).alias("z"), "speed", F.when(F.col("object_id") == "ball", F.col("accel")).otherwise(F.col("accel_v")).alias("accel_v"))
    m = tracking.select("match_id").distinct()
    rows = F.array(
        *[F.struct(F.lit(1).alias("period_id"), F.lit(i).cast("long").alias("action_id"), F.lit(t).alias("spadl_type"), F.lit(o).alias("object_id"), F.lit(True).alias("success"), F.lit(u).alias("utc")) for i, (t, o, u) in enumerate((("pass", "home_2", 1.0), ("pass", "home_3", 3.0)))]
    )
    return Y.synced(m.select("match_id", F.inline(rows)), tracking)


@query("l04_shot_anomalies")
def shot_anomalies(spark, d):
    """Every shot, and whether its ball path turns, and turns at a post (a kernel: held against drawn paths in tests).

    The ball goes from the shot's start to its end between the shot's frames at 25 a second; every fifth shot goes by way of another spot.
    """
    a = lens.actions(spark, d).where("spadl_type = 'shot'")
    shots = a.select("match_id", "action_id", "event_id", (F.col("action_id") * 1000).alias("frame_id"), (F.col("action_id") * 1000 + (F.col("receive_frame_id") - F.col("frame_id")) * 25).alias("receive_frame_id"), "start_x", "start_y", "end_x", "end_y")
    f = F.explode(F.sequence("frame_id", "receive_frame_id"))
    ball = shots.select("*", f.alias("_f"))
    share = (F.col("_f") - F.col("frame_id")) / (F.col("receive_frame_id") - F.col("frame_id"))
    bend = F.when(F.col("event_id") % 5 == 0, F.lit(1.0) - F.abs(share * 2 - 1)).otherwise(F.lit(0.0))

    def at(axis: str, other: int):
        straight = F.col(f"start_{axis}") + share * (F.col(f"end_{axis}") - F.col(f"start_{axis}"))
        return (straight + bend * (F.lit(float(other)) - straight)).alias(axis)

    ball = ball.select("match_id", F.col("_f").alias("frame_id"), at("x", 105), at("y", 30))
    return T.shot_anomalies(shots, ball)


@query("g11_delaunay_edges")
def delaunay_edges(spark, d):
    """Triangulated neighbours of all nodes around every action (a kernel: held against known figures in tests)."""
    return T.delaunay(G.held(lens.spread(lens.raw_actions(spark, d)), players=lens.players()))


@query("w05_phases", with_actions("""
, sp AS (SELECT match_id, object_id, min(frame_id) AS i, max(frame_id) AS o FROM a WHERE period_id = 1 GROUP BY ALL), en AS (SELECT match_id, min(frame_id) AS s, max(frame_id) AS e FROM a WHERE period_id = 1 GROUP BY ALL)
, bd AS (SELECT match_id, i AS pt FROM sp UNION SELECT match_id, o + 1 FROM sp UNION SELECT match_id, s FROM en UNION SELECT match_id, e + 1 FROM en)
, iv AS (SELECT match_id, pt AS sf, lead(pt) OVER (PARTITION BY match_id ORDER BY pt) - 1 AS ef FROM bd), iw AS (SELECT iv.* FROM iv JOIN en ON iv.match_id = en.match_id AND sf >= s AND ef <= e WHERE ef IS NOT NULL)
SELECT iw.match_id, sf AS start_frame, ef AS end_frame, count(*) AS n_players FROM iw JOIN sp ON sp.match_id = iw.match_id AND i <= sf AND o >= ef GROUP BY ALL"""))
def phases(spark, d):
    """Intervals with a constant set of players in first periods: the part of ``w05_phases_of_periods`` that has an SQL twin."""
    return phases_of_periods(spark, d, "period_id = 1").select("match_id", "start_frame", "end_frame", "n_players")


@query("w05_phases_of_periods")
def phases_of_periods(spark, d, where: str = "true"):
    """Intervals of every period with a constant set of players."""
    a = lens.actions(spark, d).where(where)
    spans = T.playing_spans(a.select("match_id", "object_id", "frame_id", F.col("start_x").alias("x")))
    out = T.phases(spans, a.select("match_id", "period_id", "frame_id"))
    return out.select("match_id", "period_id", "start_frame", "end_frame", F.size("active_players").cast("long").alias("n_players"))


@query("n29_frame_numbers", "SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) - 1 AS frame_id FROM orders")
def frame_numbers(spark, d):
    """Place of each date among a customer's distinct dates."""
    return E.frame_numbers(table(spark, d, "orders"), ["o_custkey"], "o_orderdate").select("o_orderkey", "frame_id")


@query(
    "n08_right_team_reflected",
    with_actions(
        """, m AS (SELECT match_id, period_id, team, object_id, avg(start_x) AS m FROM a GROUP BY ALL), n AS (SELECT match_id, period_id, avg(CASE WHEN team = 'home' THEN m END) AS h, avg(CASE WHEN team = 'away' THEN m END) AS w FROM m GROUP BY ALL)
SELECT a.event_id, CASE WHEN coalesce(team = CASE WHEN h > w THEN 'home' WHEN w > h THEN 'away' END, false) THEN 105.0::DOUBLE - start_x ELSE start_x END AS start_x FROM a JOIN n ON a.match_id = n.match_id AND a.period_id = n.period_id"""
    ),
)
def right_team_reflected(spark, d):
    """The team on the right of each period turned."""
    return E.right_team_reflected(lens.raw_actions(spark, d)).select("event_id", "start_x")
