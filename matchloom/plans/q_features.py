"""Queries of snapshot features and labels, each with its DuckDB twin.

The twins unfold pairs in SQL.  ``r`` is the snapshot with the attack from left to right, ``p`` the possessor.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import features as X
from ..operators import labels as L
from ..operators import sequence as S
from . import lens
from .lens import with_actions
from .q_sequence import R6, RETURNS

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


ROTATED = """
, r AS (SELECT a.event_id, a.object_id AS me, a.ball_z, s.ordinal, s.object_id, s.team = a.team AS tm, s.keeper, s.goal, s.accel,
  CASE WHEN a.team = 'away' THEN 105.0::DOUBLE - s.x ELSE s.x END AS x, CASE WHEN a.team = 'away' THEN 68.0::DOUBLE - s.y ELSE s.y END AS y,
  CASE WHEN a.team = 'away' THEN -s.vx ELSE s.vx END AS vx, CASE WHEN a.team = 'away' THEN -s.vy ELSE s.vy END AS vy FROM a JOIN s ON a.event_id = s.event_id)
, p AS (SELECT event_id, x AS px, y AS py, vx AS pvx, vy AS pvy FROM r WHERE object_id = me)
, pr AS (SELECT n.*, px, py, pvx, pvy, o.ordinal AS oo, o.object_id AS oid, o.tm AS otm, o.keeper AS okeeper, o.goal AS ogoal, o.x AS ox, o.y AS oy FROM r n JOIN r o ON n.event_id = o.event_id JOIN p ON p.event_id = n.event_id)
"""


def dist(ax, ay, bx, by):
    return f"sqrt((({ax}) - ({bx})) * (({ax}) - ({bx})) + (({ay}) - ({by})) * (({ay}) - ({by})))"


def seg(ax, ay, bx, by, ox, oy):
    """Distance to a segment."""
    dx, dy = f"(({bx}) - ({ax}))", f"(({by}) - ({ay}))"
    sq = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(CASE WHEN {sq} > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((({ox}) - ({ax})) * {dx} + (({oy}) - ({ay})) * {dy}) / {sq})) ELSE 0.0::DOUBLE END)"
    return dist(ox, oy, f"({ax}) + {t} * {dx}", f"({ay}) + {t} * {dy}")


def lane(ax, ay, bx, by, ox, oy):
    dx, dy = f"(({bx}) - ({ax}))", f"(({by}) - ({ay}))"
    ln = f"(sqrt({dx} * {dx} + {dy} * {dy}) + 1e-6::DOUBLE)"
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((({ox}) - ({ax})) * {dx} + (({oy}) - ({ay})) * {dy}) / ({ln} * {ln})))"
    return dist(ox, oy, f"({ax}) + {t} * {dx}", f"({ay}) + {t} * {dy}")


def corridor(ax, ay, bx, by, ox, oy):
    dx, dy = f"(({bx}) - ({ax}))", f"(({by}) - ({ay}))"
    ln = f"sqrt({dx} * {dx} + {dy} * {dy})"
    along = f"((({ox}) - ({ax})) * {dx} + (({oy}) - ({ay})) * {dy}) / {ln}"
    across = f"((({ox}) - ({ax})) * {dy} - (({oy}) - ({ay})) * {dx}) / {ln}"
    return f"(CASE WHEN {ln} < 1e-6 THEN false ELSE {along} > 0 AND {along} < {ln} AND abs({across}) < 5 END)"


def side(ax, ay, bx, by, ox, oy):
    return f"((({bx}) - ({ax})) * (({oy}) - ({ay})) - (({by}) - ({ay})) * (({ox}) - ({ax})))"


def triangle(ax, ay, bx, by, cx, cy, ox, oy):
    s = [side(ax, ay, bx, by, ox, oy), side(bx, by, cx, cy, ox, oy), side(cx, cy, ax, ay, ox, oy)]
    near = f"least({seg(ax, ay, bx, by, ox, oy)}, {seg(bx, by, cx, cy, ox, oy)}, {seg(cx, cy, ax, ay, ox, oy)}) < 1"
    return f"(({s[0]} >= 0 AND {s[1]} >= 0 AND {s[2]} >= 0) OR ({s[0]} <= 0 AND {s[1]} <= 0 AND {s[2]} <= 0) OR {near})"


LOW, HIGH = "31.34::DOUBLE", "36.66::DOUBLE"


def shot_triangle(x, y, ox, oy, low=LOW, high=HIGH):
    area = f"abs({side('105.0::DOUBLE', low, '105.0::DOUBLE', high, x, y)}) / 2 >= 1e-3"
    return f"({area} AND {triangle('105.0::DOUBLE', low, '105.0::DOUBLE', high, x, y, ox, oy)})"


def vangle(ax, ay, bx, by):
    return f"acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (({ax}) * ({bx}) + ({ay}) * ({by})) / ((sqrt(({ax}) * ({ax}) + ({ay}) * ({ay})) + 1e-6::DOUBLE) * (sqrt(({bx}) * ({bx}) + ({by}) * ({by})) + 1e-6::DOUBLE)))))"


GOAL = lambda x, y: dist(x, y, "105.0::DOUBLE", "34.0::DOUBLE")


def snapshots(spark, d, actions=None):
    """Every action with its players and its possessor, attacking to the right."""
    return X.oriented(G.held(lens.spread(lens.raw_actions(spark, d) if actions is None else actions), players=lens.players()))


MORE = f"""
, m AS (SELECT event_id, ordinal, count(*) FILTER (WHERE tm <> otm AND {dist('x', 'y', 'ox', 'oy')} < 3)::DOUBLE AS near_opponents, min(CASE WHEN tm <> otm THEN {dist('x', 'y', 'ox', 'oy')} END) AS nearest_opponent,
  count(*) FILTER (WHERE tm <> otm AND {GOAL('ox', 'oy')} < {GOAL('x', 'y')})::DOUBLE AS closer_opponents, coalesce(min(CASE WHEN tm AND NOT otm THEN {lane('px', 'py', 'x', 'y', 'ox', 'oy')} END), 0) AS lane_distance,
  count(*) FILTER (WHERE tm AND NOT otm AND {corridor('px', 'py', 'x', 'y', 'ox', 'oy')})::DOUBLE AS interceptors, count(*) FILTER (WHERE tm AND NOT otm AND {shot_triangle('x', 'y', 'ox', 'oy')})::DOUBLE AS blockers
  FROM pr GROUP BY event_id, ordinal)
"""
BASE = {
    "teammate": "r.tm::INT::DOUBLE", "keeper": "r.keeper::INT::DOUBLE", "goal": "r.goal::INT::DOUBLE", "x": "r.x", "y": "r.y", "vx": "r.vx", "vy": "r.vy", "speed": "sqrt(r.vx * r.vx + r.vy * r.vy)", "accel": "r.accel",
    "goal_dist": GOAL("r.x", "r.y"), "goal_cos": f"(r.x - 105.0::DOUBLE) / ({GOAL('r.x', 'r.y')} + 1e-6::DOUBLE)", "goal_sin": f"(r.y - 34.0::DOUBLE) / ({GOAL('r.x', 'r.y')} + 1e-6::DOUBLE)", "ball_z": "r.ball_z",
    "possessor": "(r.object_id = r.me)::INT::DOUBLE", "poss_dist": dist("r.x", "r.y", "px", "py"), "poss_cos": f"(r.x - px) / ({dist('r.x', 'r.y', 'px', 'py')} + 1e-6::DOUBLE)", "poss_sin": f"(r.y - py) / ({dist('r.x', 'r.y', 'px', 'py')} + 1e-6::DOUBLE)",
    "vel_cos": f"cos({vangle('r.vx', 'r.vy', 'pvx', 'pvy')})", "vel_sin": f"sin({vangle('r.vx', 'r.vy', 'pvx', 'pvy')})",
}


def six(df, keep):
    """Every other column at six places."""
    return df.select(*keep, *[G.at_6(F.col(c)).alias(c) for c in df.columns if c not in keep])


@query(
    "g07_node_features",
    with_actions(ROTATED + MORE + "SELECT r.event_id, r.ordinal, " + ", ".join(f"{R6.format(e)} AS {n}" for n, e in BASE.items()) + ", " + ", ".join(f"{R6.format('m.' + n)} AS {n}" for n in X.NODE_MORE) + " FROM r JOIN p USING (event_id) JOIN m ON m.event_id = r.event_id AND m.ordinal = r.ordinal", True),
)
def node_features(spark, d):
    """25 features of every player and goal around every action."""
    return six(X.node_features(snapshots(spark, d)), ["event_id", "ordinal"])


@query("j12_pair_distances", with_actions(ROTATED + f"SELECT event_id, ordinal, {R6.format('avg(' + dist('x', 'y', 'ox', 'oy') + ')')} AS mean_distance, {R6.format('max(' + dist('x', 'y', 'ox', 'oy') + ')')} AS max_distance FROM pr WHERE oo <> ordinal GROUP BY event_id, ordinal", True))
def pair_distances(spark, d):
    """Distances of each player to all others."""
    n, o = F.col("n"), F.col("o")
    gap = G.distance(n["x"], n["y"], o["x"], o["y"])
    return X.pairs(snapshots(spark, d)).where(n["ordinal"] != o["ordinal"]).groupBy("event_id", n["ordinal"].alias("ordinal")).agg(G.at_6(F.avg(gap)).alias("mean_distance"), G.at_6(F.max(gap)).alias("max_distance"))


@query("g03_corridor_interceptors", with_actions(ROTATED + f"SELECT event_id, ordinal, count(*) FILTER (WHERE {corridor('px', 'py', 'x', 'y', 'ox', 'oy')}) AS n FROM pr WHERE tm AND NOT otm GROUP BY event_id, ordinal", True))
def corridor_interceptors(spark, d):
    """Opponents in the ten-metre corridor to each teammate."""
    n, o, p = F.col("n"), F.col("o"), F.col("poss")
    inside = G.in_corridor(p["x"], p["y"], n["x"], n["y"], o["x"], o["y"])
    return X.pairs(snapshots(spark, d)).where(n["teammate"] & ~o["teammate"]).groupBy("event_id", n["ordinal"].alias("ordinal")).agg(F.count_if(inside).alias("n"))


@query("g04_lane_nearest", with_actions(ROTATED + f"SELECT event_id, ordinal, {R6.format('min(' + lane('px', 'py', 'x', 'y', 'ox', 'oy') + ')')} AS lane_distance FROM pr WHERE tm AND NOT otm GROUP BY event_id, ordinal", True))
def lane_nearest(spark, d):
    """The opponent nearest to the pass to each teammate."""
    n, o, p = F.col("n"), F.col("o"), F.col("poss")
    gap = G.lane_distance(p["x"], p["y"], n["x"], n["y"], o["x"], o["y"])
    return X.pairs(snapshots(spark, d)).where(n["teammate"] & ~o["teammate"]).groupBy("event_id", n["ordinal"].alias("ordinal")).agg(G.at_6(F.min(gap)).alias("lane_distance"))


@query("g05_shot_blockers", with_actions(ROTATED + f"SELECT event_id, ordinal, count(*) FILTER (WHERE {shot_triangle('x', 'y', 'ox', 'oy')}) AS n FROM pr WHERE tm AND NOT otm GROUP BY event_id, ordinal", True))
def shot_blockers(spark, d):
    """Opponents in the shot triangle of each teammate, grown by a metre."""
    n, o = F.col("n"), F.col("o")
    return X.pairs(snapshots(spark, d)).where(n["teammate"] & ~o["teammate"]).groupBy("event_id", n["ordinal"].alias("ordinal")).agg(F.count_if(G.goal_side(n["x"], n["y"], o["x"], o["y"])).alias("n"))


@query(
    "g06_nearest_blocker",
    with_actions(ROTATED + f", c AS (SELECT event_id, arg_min(oid, ({dist('ox', 'oy', 'px', 'py')}, oo)) AS blocker_id FROM pr WHERE object_id = me AND NOT otm AND NOT okeeper AND NOT ogoal AND {triangle('px', 'py', '105.0::DOUBLE', '30.0::DOUBLE', '105.0::DOUBLE', '38.0::DOUBLE', 'ox', 'oy')} GROUP BY event_id) SELECT a.event_id, blocker_id FROM a LEFT JOIN c USING (event_id)", True),
)
def nearest_blocker(spark, d):
    """The nearest opponent between each action and the goal."""
    s = snapshots(spark, d)
    return s.select("event_id", X.blockers(s).alias("blocker_id"))


SHOTS_ONLY = "(SELECT * FROM a WHERE spadl_type = 'shot')"


@query(
    "g08_shot_graph_edges",
    with_actions(
        ROTATED.replace("ON a.event_id = s.event_id)", "ON a.event_id = s.event_id WHERE a.spadl_type = 'shot')").replace(", pr AS (", ", pr AS MATERIALIZED (")
        + f"SELECT event_id, ordinal AS source, oo AS target, {R6.format(dist('x', 'y', 'ox', 'oy'))} AS distance, (tm = otm)::INT::DOUBLE AS same_team FROM pr",
        True,
    ),
)
def shot_graph_edges(spark, d):
    """The complete graph around every shot: the part of ``g08_graph_edges`` that has an SQL twin."""
    return graph_edges(spark, d, "spadl_type = 'shot'")


@query("g08_graph_edges")
def graph_edges(spark, d, where: str = "true"):
    """The complete graph around every action."""
    s = snapshots(spark, d).where(where)
    return X.edges(s).select("event_id", "source", "target", G.at_6(F.col("distance")).alias("distance"), "same_team")


@query("g11_sparse_edges", with_actions(ROTATED + f"SELECT event_id, ordinal AS source, count(*) AS n FROM pr WHERE {dist('x', 'y', 'ox', 'oy')} <= 10 OR object_id = me OR oid = me GROUP BY event_id, ordinal", True))
def sparse_edges(spark, d):
    """Edges of at most ten metres or at the possessor, counted per node."""
    return X.sparse_edges(X.edges(snapshots(spark, d))).groupBy("event_id", "source").agg(F.count("*").alias("n"))


@query("g10_kept_nodes", with_actions(ROTATED + "SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY ordinal) - 1)::INTEGER AS new_ordinal, ordinal FROM r WHERE tm", True))
def kept_nodes(spark, d):
    """Nodes without opponents, with new ordinals."""
    n = X.nodes(snapshots(spark, d)).select("event_id", F.col("n.ordinal").alias("ordinal"), F.col("n.teammate").alias("keep"))
    return X.kept_nodes(n, F.col("keep"))


@query(
    "g13_target_features",
    with_actions(
        ROTATED
        + f""", t AS (SELECT r.event_id, r.x AS tx, r.y AS ty, r.vx AS tvx, r.vy AS tvy FROM r JOIN a ON a.event_id = r.event_id AND a.receiver_id = r.object_id)
, k AS (SELECT event_id, arg_min(x, ordinal) AS kx, arg_min(y, ordinal) AS ky FROM r WHERE keeper AND NOT tm GROUP BY event_id)
, g AS (SELECT r.event_id, any_value(px) AS px, any_value(py) AS py, any_value(pvx) AS pvx, any_value(pvy) AS pvy, any_value(tx) AS tx, any_value(ty) AS ty, any_value(tvx) AS tvx, any_value(tvy) AS tvy, any_value(kx) AS kx, any_value(ky) AS ky, any_value(r.ball_z) AS bz,
  count(*) FILTER (WHERE {dist('px', 'py', 'r.x', 'r.y')} <= 3)::DOUBLE AS p_near, min({dist('px', 'py', 'r.x', 'r.y')}) AS p_nearest, count(*) FILTER (WHERE {GOAL('r.x', 'r.y')} < {GOAL('px', 'py')})::DOUBLE AS p_closer, count(*) FILTER (WHERE {shot_triangle('px', 'py', 'r.x', 'r.y')})::DOUBLE AS p_blockers,
  count(*) FILTER (WHERE {dist('tx', 'ty', 'r.x', 'r.y')} <= 3)::DOUBLE AS t_near, min({dist('tx', 'ty', 'r.x', 'r.y')}) AS t_nearest, count(*) FILTER (WHERE {GOAL('r.x', 'r.y')} < {GOAL('tx', 'ty')})::DOUBLE AS t_closer, count(*) FILTER (WHERE {shot_triangle('tx', 'ty', 'r.x', 'r.y')})::DOUBLE AS t_blockers,
  count(*) FILTER (WHERE {corridor('px', 'py', 'tx', 'ty', 'r.x', 'r.y')})::DOUBLE AS interceptors, min({lane('px', 'py', 'tx', 'ty', 'r.x', 'r.y')}) AS lane_opponent
  FROM r JOIN p ON p.event_id = r.event_id JOIN k ON k.event_id = r.event_id LEFT JOIN t ON t.event_id = r.event_id WHERE NOT r.tm GROUP BY r.event_id)
SELECT event_id, {R6.format('px')} AS p_x, {R6.format('py')} AS p_y, {R6.format('sqrt(pvx * pvx + pvy * pvy)')} AS p_speed, {R6.format(GOAL('px', 'py'))} AS p_goal_dist, p_near, {R6.format('p_nearest')} AS p_nearest, p_closer, p_blockers, {R6.format('bz')} AS ball_z,
  {R6.format(f"cos({vangle('kx - px', 'ky - py', '105.0::DOUBLE - px', '34.0::DOUBLE - py')})")} AS keeper_cos,
  CASE WHEN tx IS NULL THEN -100 ELSE {R6.format('tx')} END AS t_x, CASE WHEN tx IS NULL THEN -100 ELSE t_near END AS t_near, CASE WHEN tx IS NULL THEN -100 ELSE {R6.format('t_nearest')} END AS t_nearest, CASE WHEN tx IS NULL THEN -100 ELSE t_closer END AS t_closer, CASE WHEN tx IS NULL THEN -100 ELSE t_blockers END AS t_blockers,
  CASE WHEN tx IS NULL THEN -100 ELSE {R6.format(dist('px', 'py', 'tx', 'ty'))} END AS pass_dist, CASE WHEN tx IS NULL THEN -100 ELSE interceptors END AS interceptors, CASE WHEN tx IS NULL THEN -100 ELSE {R6.format('lane_opponent')} END AS lane_opponent,
  CASE WHEN tx IS NULL THEN -100 ELSE {R6.format(f"cos({vangle('tvx', 'tvy', 'pvx', 'pvy')})")} END AS turn_cos FROM g""",
        True,
    ),
)
def target_features(spark, d):
    """Features of the possessor and its target (19 of the 41 are compared)."""
    out = X.target_features(snapshots(spark, d))
    names = ["p_x", "p_y", "p_speed", "p_goal_dist", "p_near", "p_nearest", "p_closer", "p_blockers", "ball_z", "keeper_cos", "t_x", "t_near", "t_nearest", "t_closer", "t_blockers", "pass_dist", "interceptors", "lane_opponent", "turn_cos"]
    return six(out.select("event_id", *names), ["event_id"])


@query(
    "g16_xg_features",
    with_actions(
        f"""
, b AS (SELECT event_id, floor((CASE WHEN team = 'home' THEN 105.0::DOUBLE - start_x ELSE start_x END) / 105.0::DOUBLE * 104 * 100 + 0.5) / 100 AS x, abs((CASE WHEN team = 'home' THEN 68.0::DOUBLE - start_y ELSE start_y END) / 68.0::DOUBLE * 68 - 34) AS y FROM a WHERE spadl_type = 'shot')
, c AS (SELECT *, sqrt(x * x + y * y) AS distance, atan(7.32::DOUBLE * x / (x * x + y * y - 3.66::DOUBLE * 3.66::DOUBLE)) * (180.0::DOUBLE / pi()) AS an FROM b), e AS (SELECT *, CASE WHEN an >= 0 THEN an ELSE an + 180 END AS angle FROM c)
SELECT event_id, {R6.format('x')} AS x, {R6.format('y')} AS y, {R6.format('distance')} AS distance, {R6.format('angle')} AS angle, {R6.format('1 / (1 + exp(-(-1.2::DOUBLE - 0.09::DOUBLE * distance + 0.02::DOUBLE * angle)))')} AS xg FROM e"""
    ),
)
def xg_features(spark, d):
    """Shot features and a logistic score of them."""
    s = X.shot_features(lens.raw_actions(spark, d).where("spadl_type = 'shot'"))
    return six(s.withColumn("xg", X.logistic({"distance": -0.09, "angle": 0.02}, -1.2)).select("event_id", "x", "y", "distance", "angle", "xg"), ["event_id"])


@query(
    "g18_destination_features",
    with_actions(
        ROTATED
        + f""", c AS (SELECT i::INTEGER AS cell, (i % 12)::DOUBLE * 8.75::DOUBLE + 4.375::DOUBLE AS cx, (i // 12)::DOUBLE * 8.5::DOUBLE + 4.25::DOUBLE AS cy FROM range(0, 96) t(i))
SELECT r.event_id, cell, {R6.format('any_value(cx) - any_value(px)')} AS dx, {R6.format('any_value(cy) - any_value(py)')} AS dy, {R6.format('min(CASE WHEN r.tm THEN ' + dist('cx', 'cy', 'r.x', 'r.y') + ' END)')} AS nearest_teammate,
  {R6.format('min(CASE WHEN NOT r.tm THEN ' + dist('cx', 'cy', 'r.x', 'r.y') + ' END)')} AS nearest_opponent, {R6.format('min(CASE WHEN NOT r.tm THEN ' + seg('px', 'py', 'cx', 'cy', 'r.x', 'r.y') + ' END)')} AS lane_opponent
FROM r JOIN {SHOTS_ONLY} q ON q.event_id = r.event_id JOIN p ON p.event_id = r.event_id, c WHERE NOT r.goal GROUP BY r.event_id, cell""",
        True,
    ),
)
def destination_features(spark, d):
    """Features of 96 destination cells for every shot: a part of ``g18_destination_grid`` that SQL can follow."""
    s = snapshots(spark, d).where("spadl_type = 'shot'")
    return six(X.destination_features(s, 12, 8).select("event_id", "cell", "dx", "dy", "nearest_teammate", "nearest_opponent", "lane_opponent"), ["event_id", "cell"])


@query("g18_destination_grid")
def destination_grid(spark, d):
    """Features of all 7140 destination cells for every action, a row each (held against the operator of the 96 cells in tests)."""
    return X.destination_grid(snapshots(spark, d))


@query("g19_cell_index", with_actions(f"SELECT event_id, CAST((67 - floor(least(end_y, 68 - 1e-9) / 68 * 68)) * 105 + floor(least(end_x, 105 - 1e-9) / 105 * 105) AS INTEGER) AS cell, {R6.format('sqrt((105 - end_x) * (105 - end_x) + (end_y - 34) * (end_y - 34))')} AS goal_distance, {R6.format('atan2(end_y - 34, 105 - end_x)')} AS goal_angle FROM a"))
def cell_index(spark, d):
    """Destination cell and polar place of the end of each action."""
    a = lens.raw_actions(spark, d)
    cell = G.grid_row(F.col("end_y"), 68) * 105 + G.grid_column(F.col("end_x"), 105)
    dx, dy = F.lit(105.0) - F.col("end_x"), F.col("end_y") - F.lit(34.0)
    return a.select("event_id", cell.alias("cell"), G.at_6(F.sqrt(dx * dx + dy * dy)).alias("goal_distance"), G.at_6(F.atan2(dy, dx)).alias("goal_angle"))


PLAIN = ", p AS (SELECT s.event_id, s.x AS px, s.y AS py FROM a JOIN s ON s.event_id = a.event_id AND s.object_id = a.object_id)"
INTENT = (
    PLAIN
    + f"""
, m AS (SELECT a.event_id, s.ordinal, s.object_id AS oid, {dist('s.x', 's.y', 'px', 'py')} - {dist('px', 'py', 'a.end_x', 'a.end_y')} AS gap, greatest({dist('s.x', 's.y', 'a.end_x', 'a.end_y')}, 1.0::DOUBLE) AS d,
  greatest({vangle('a.end_x - px', 'a.end_y - py', 's.x - px', 's.y - py')}, 0.01::DOUBLE) AS an FROM a JOIN s ON s.event_id = a.event_id AND s.team = a.team AND NOT s.goal AND s.object_id <> a.object_id JOIN p ON p.event_id = a.event_id)
, n AS (SELECT *, min(d) OVER (PARTITION BY event_id) AS md, min(an) OVER (PARTITION BY event_id) AS ma FROM m)
, b AS (SELECT event_id, arg_min(oid, (-(CASE WHEN an < radians(45) THEN (CASE WHEN gap < -10 THEN 0.5::DOUBLE WHEN gap < 0 THEN gap / 20 + 1 ELSE 1.0::DOUBLE END) * (md / d) * (ma / an) ELSE 0.0::DOUBLE END), ordinal)) AS best FROM n WHERE ma < radians(45) GROUP BY event_id)
, i AS (SELECT a.*, CASE WHEN spadl_type NOT IN ('pass', 'cross', 'shot') OR (spadl_type = 'shot' AND success AND (CASE WHEN team = 'home' THEN end_x < 10 ELSE end_x > 95 END)) THEN object_id WHEN spadl_type = 'shot' THEN team || '_goal' WHEN success THEN receiver_id ELSE best END AS intent_id
  FROM a LEFT JOIN b ON b.event_id = a.event_id)
"""
)


def with_intent(spark, d, base=None):
    a = G.held(lens.spread(base if base is not None else lens.raw_actions(spark, d)), players=lens.players())
    a = G.held(a, poss=F.get(F.filter("players", lambda q: q["object_id"] == F.col("object_id")), 0))
    kind = F.when(F.col("spadl_type").isin("pass", "cross"), "pass").when(F.col("spadl_type") == "shot", "shot").otherwise("dribble")
    return L.intended_receiver(a.withColumn("action_type", kind))


@query("l01_intended_receiver", with_actions(INTENT + "SELECT event_id, intent_id FROM i", True))
def intended_receiver(spark, d):
    """Whom each action was meant for."""
    return with_intent(spark, d).select("event_id", "intent_id")


@query(
    "l05_adjusted_destination",
    with_actions(
        INTENT
        + f""", j AS MATERIALIZED (SELECT i.*, s.x AS intent_x, s.y AS intent_y FROM i LEFT JOIN s ON s.event_id = i.event_id AND s.object_id = i.intent_id)
, f AS (SELECT *, spadl_type IN ('pass', 'cross') AND NOT success AND intent_x IS NOT NULL AS failed, {dist('start_x', 'start_y', 'intent_x', 'intent_y')} / greatest({dist('start_x', 'start_y', 'end_x', 'end_y')}, 1e-6::DOUBLE) AS st FROM j)
SELECT event_id, {R6.format('greatest(0.0::DOUBLE, least(105.0::DOUBLE, CASE WHEN failed THEN start_x + st * (end_x - start_x) ELSE end_x END))')} AS dest_x, {R6.format('greatest(0.0::DOUBLE, least(68.0::DOUBLE, CASE WHEN failed THEN start_y + st * (end_y - start_y) ELSE end_y END))')} AS dest_y FROM f""",
        True,
    ),
)
def adjusted_destination(spark, d):
    """Where failed passes would have gone at their intended length."""
    i = with_intent(spark, d)
    spot = F.get(F.filter("players", lambda q: q["object_id"] == F.col("intent_id")), 0)
    i = G.held(i, _s=spot).withColumns({"intent_x": F.col("_s.x"), "intent_y": F.col("_s.y")})
    return six(L.adjusted_destination(i).select("event_id", "dest_x", "dest_y"), ["event_id"])


@query(
    "l07_blocked_augmentations",
    with_actions(
        INTENT
        + f""", q AS (SELECT i.event_id, i.team AS mine, i.intent_id, s.ordinal, s.object_id AS oid, s.team, s.goal, s.x, s.y, px, py, {dist('s.x', 's.y', 'px', 'py')} AS far FROM i JOIN s ON s.event_id = i.event_id JOIN p ON p.event_id = i.event_id)
, bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ordinal) AS nth FROM q WHERE team <> mine AND far < 5) WHERE nth <= 3)
, cone AS (SELECT bl.event_id, bl.oid AS blocker_id, bl.ordinal AS bo, q.ordinal, q.oid, q.team, q.goal, q.far, q.mine, q.intent_id FROM bl JOIN q ON q.event_id = bl.event_id WHERE {vangle('bl.x - q.px', 'bl.y - q.py', 'q.x - q.px', 'q.y - q.py')} < radians(15))
, lim AS (SELECT event_id, bo, max(far) - 10 AS lim FROM cone WHERE team <> mine AND ordinal <> bo GROUP BY event_id, bo)
SELECT cone.event_id, blocker_id, oid AS blocked_intent, CASE WHEN goal THEN 'shot' ELSE 'pass' END AS blocked_type FROM cone JOIN lim ON lim.event_id = cone.event_id AND lim.bo = cone.bo
WHERE team = mine AND (far < lim OR (goal AND far < 40)) AND oid IS DISTINCT FROM intent_id""",
        True,
    ),
)
def blocked_augmentations(spark, d):
    """Actions as if a near opponent had blocked them."""
    return L.blocked_augmentations(with_intent(spark, d)).select("event_id", "blocker_id", "blocked_intent", "blocked_type")


@query(
    "l02_label_rows",
    with_actions(
        INTENT
        + f""", rt AS (WITH x0 AS (SELECT 1) {RETURNS} SELECT match_id, action_id, scores, scores_xg, concedes, concedes_xg FROM r)
, vt AS (WITH e AS (SELECT *, CASE WHEN k % 5 <> 0 THEN k / 100.0::DOUBLE END AS xt FROM a), f AS (SELECT *, spadl_type IN ('pass', 'cross', 'shot') AND xt IS NOT NULL AS el FROM e)
   , n AS (SELECT *, sum(CASE WHEN el THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY action_id) AS nth FROM f)
   SELECT x.match_id, x.action_id, coalesce(max(CASE WHEN y.team = x.team THEN y.xt END), 0) AS scores_xt, coalesce(max(CASE WHEN y.team <> x.team THEN y.xt END), 0) AS concedes_xt
   FROM n x LEFT JOIN n y ON x.match_id = y.match_id AND y.el AND y.nth BETWEEN x.nth + 1 AND x.nth + 5 AND y.action_id > x.action_id GROUP BY x.match_id, x.action_id)
, j AS (SELECT i.*, s.ordinal AS io, s.team AS iteam, s.x AS ix, s.y AS iy, t.ordinal AS ro, t.team AS rteam FROM i LEFT JOIN s ON s.event_id = i.event_id AND s.object_id = i.intent_id LEFT JOIN s t ON t.event_id = i.event_id AND t.object_id = i.receiver_id)
, f AS MATERIALIZED (SELECT *, spadl_type IN ('pass', 'cross') AS ps, team = 'away' AS aw FROM j)
SELECT f.match_id, f.action_id, ps::INT AS is_pass, (spadl_type NOT IN ('pass', 'cross', 'shot'))::INT AS is_dribble, (spadl_type = 'shot')::INT AS is_shot, 24 AS n_players,
 (CASE WHEN io IS NULL OR iteam <> team THEN -1 WHEN io >= 23 THEN 11 ELSE (io - 1) % 11 END)::INTEGER AS intent_index,
 (CASE WHEN receiver_id = 'out' OR spadl_type NOT IN ('pass', 'cross', 'shot') THEN -1 WHEN rteam = team THEN (ro - 1) % 11 ELSE 12 + (ro - 1) % 11 END)::INTEGER AS receiver_index,
 CASE WHEN ps THEN floor((receive_frame_id - frame_id) / 25.0::DOUBLE * 100 + 0.5) / 100 ELSE 0.0::DOUBLE END AS duration,
 {', '.join(f"{R6.format(f'coalesce(CASE WHEN ps THEN CASE WHEN aw THEN {w}.0::DOUBLE - {c} ELSE {c} END END, -{w}.0::DOUBLE)')} AS {n}" for c, n, w in (('start_x', 'start_x', 105), ('start_y', 'start_y', 68), ('end_x', 'end_x', 105), ('end_y', 'end_y', 68), ('ix', 'intent_x', 105), ('iy', 'intent_y', 68)))},
 1 AS is_real, (event_id % 7 = 3 AND spadl_type = 'shot')::INT AS blocked, success::INT AS success, scores, {R6.format('scores_xg')} AS scores_xg, concedes, {R6.format('concedes_xg')} AS concedes_xg, {R6.format('scores_xt')} AS scores_xt, {R6.format('concedes_xt')} AS concedes_xt
 FROM f JOIN rt ON rt.match_id = f.match_id AND rt.action_id = f.action_id JOIN vt ON vt.match_id = f.match_id AND vt.action_id = f.action_id""",
        True,
    ),
)
def label_rows(spark, d):
    """The exported label row of every action, all 23 columns (and the match)."""
    a = with_intent(spark, d, lens.actions(spark, d))
    spot = F.get(F.filter("players", lambda q: q["object_id"] == F.col("intent_id")), 0)
    a = G.held(a, _s=spot).withColumns({"intent_x": F.col("_s.x"), "intent_y": F.col("_s.y"), "blocked": (F.col("event_id") % 7 == 3) & (F.col("spadl_type") == "shot"), "xt": F.when(F.col("k") % 5 != 0, F.col("k") / F.lit(100.0))})
    out = L.label_rows(S.value_returns(S.future_returns(a)))
    return six(out, [c for c in out.columns if not (c.endswith(("_xg", "_xt")) or c.startswith(("start_", "end_")) or c in ("intent_x", "intent_y"))])


@query("l06_task_filter", with_actions(INTENT + "SELECT event_id FROM i WHERE spadl_type IN ('pass', 'cross') AND intent_id IS NOT NULL AND receiver_id <> 'out' AND (receive_frame_id - frame_id) / 25.0 >= 0.2", True))
def task_filter(spark, d):
    """Rows of the destination task."""
    a = with_intent(spark, d, lens.actions(spark, d)).withColumn("duration", (F.col("receive_frame_id") - F.col("frame_id")) / F.lit(25.0))
    return L.task_rows(a, "pass_dest", in_play=True, shortest_pass=0.2).select("event_id")


@query("l08_rotated_for_xg", with_actions(", t AS (SELECT match_id, period_id, team, avg(start_x) > 52.5 AS turn FROM a WHERE spadl_type = 'shot' GROUP BY ALL) SELECT a.event_id, CASE WHEN coalesce(turn, false) THEN 105.0::DOUBLE - start_x ELSE start_x END AS start_x, CASE WHEN coalesce(turn, false) THEN 68.0::DOUBLE - start_y ELSE start_y END AS start_y FROM a LEFT JOIN t ON a.match_id = t.match_id AND a.period_id = t.period_id AND a.team = t.team"))
def rotated_for_xg(spark, d):
    return L.rotated_for_xg(lens.raw_actions(spark, d)).select("event_id", "start_x", "start_y")


@query("l10_left_to_right", with_actions("SELECT event_id, CASE WHEN team = 'away' THEN 105.0::DOUBLE - start_x ELSE start_x END AS start_x, CASE WHEN team = 'away' THEN 68.0::DOUBLE - start_y ELSE start_y END AS start_y, CASE WHEN team = 'away' THEN 105.0::DOUBLE - end_x ELSE end_x END AS end_x, CASE WHEN team = 'away' THEN 68.0::DOUBLE - end_y ELSE end_y END AS end_y FROM a"))
def left_to_right(spark, d):
    return L.left_to_right(lens.raw_actions(spark, d)).select("event_id", "start_x", "start_y", "end_x", "end_y")


CELL = lambda x, y: f"CAST((7 - floor(least({y}, 68 - 1e-9) / 68 * 8)) * 12 + floor(least({x}, 105 - 1e-9) / 105 * 12) AS INTEGER)"
TURNED = ", w AS (SELECT * REPLACE (CASE WHEN team = 'away' THEN 105.0::DOUBLE - start_x ELSE start_x END AS start_x, CASE WHEN team = 'away' THEN 68.0::DOUBLE - start_y ELSE start_y END AS start_y, CASE WHEN team = 'away' THEN 105.0::DOUBLE - end_x ELSE end_x END AS end_x, CASE WHEN team = 'away' THEN 68.0::DOUBLE - end_y ELSE end_y END AS end_y) FROM a WHERE spadl_type IN ('pass', 'cross', 'shot'))"


@query("l11_grid_counts", with_actions(TURNED + f"SELECT {CELL('start_x', 'start_y')} AS cell, CASE WHEN spadl_type <> 'shot' AND success THEN {CELL('end_x', 'end_y')} END AS to_cell, count(*) FILTER (WHERE spadl_type = 'shot') AS shots, count(*) FILTER (WHERE spadl_type = 'shot' AND success) AS goals, count(*) FILTER (WHERE spadl_type <> 'shot') AS moves FROM w GROUP BY 1, 2"))
def grid_counts(spark, d):
    """Shots, goals and moves per cell of the value grid."""
    return L.grid_counts(lens.raw_actions(spark, d))


@query("l11_fitted_grid")
def fitted_grid(spark, d):
    """Values of the 96 cells by value iteration (iterative: held against a plain loop in tests)."""
    return L.grid_frame(spark, L.fit_grid(L.grid_counts(lens.raw_actions(spark, d))))


@query(
    "l12_zone_values",
    with_actions(TURNED + f"SELECT event_id, CASE WHEN spadl_type = 'shot' THEN greatest({CELL('start_x', 'start_y')} / 1000.0::DOUBLE, expected_goal) ELSE {CELL('start_x', 'start_y')} / 1000.0::DOUBLE END AS xt FROM w"),
)
def zone_values(spark, d):
    """Grid values of actions; shots have at least their expected goal."""
    grid = spark.range(96).select(F.col("id").cast("int").alias("cell"), (F.col("id") / F.lit(1000.0)).alias("xt"))
    return L.with_zone_value(lens.raw_actions(spark, d), grid).where("spadl_type IN ('pass', 'cross', 'shot')").select("event_id", "xt")


@query(
    "l13_annotated_values",
    with_actions(
        TURNED
        + f""", v AS (SELECT event_id, CASE WHEN spadl_type = 'shot' THEN greatest({CELL('start_x', 'start_y')} / 1000.0::DOUBLE, expected_goal) ELSE {CELL('start_x', 'start_y')} / 1000.0::DOUBLE END AS xt FROM w)
, n AS (SELECT a.*, xt, sum(CASE WHEN xt IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY action_id) AS nth FROM a LEFT JOIN v ON v.event_id = a.event_id)
SELECT x.match_id, x.action_id, any_value(x.xt) AS xt, coalesce(max(CASE WHEN y.team = x.team THEN y.xt END), 0) AS scores_xt, coalesce(max(CASE WHEN y.team <> x.team THEN y.xt END), 0) AS concedes_xt
FROM n x LEFT JOIN n y ON x.match_id = y.match_id AND y.xt IS NOT NULL AND y.nth BETWEEN x.nth + 1 AND x.nth + 5 AND y.action_id > x.action_id WHERE x.xt IS NOT NULL GROUP BY x.match_id, x.action_id"""
    ),
)
def annotated_values(spark, d):
    """Value and look-ahead of every eligible action."""
    grid = spark.range(96).select(F.col("id").cast("int").alias("cell"), (F.col("id") / F.lit(1000.0)).alias("xt"))
    out = S.value_returns(L.with_zone_value(lens.actions(spark, d), grid))
    return out.where(F.col("xt").isNotNull()).select("match_id", "action_id", "xt", "scores_xt", "concedes_xt")


@query("n21_sanitized_xg", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(event_id % 100 AS VARCHAR) END AS DOUBLE) END AS expected_goal FROM events")
def sanitized_xg(spark, d):
    """Expected goals as numbers, of shots only."""
    a = lens.raw_actions(spark, d).withColumn("expected_goal", F.when(F.col("event_id") % 7 == 0, "n/a").otherwise((F.col("event_id") % 100).cast("string")))
    return L.sanitized_xg(a).select("event_id", "expected_goal")
