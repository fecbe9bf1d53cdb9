"""Queries over ordered events, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import sequence as S
from . import lens
from .lens import with_actions

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


R6 = "floor(({}) * 1e6 + 0.5) / 1e6"


@query("lens_actions", with_actions("SELECT match_id, period_id, action_id, event_id, spadl_type, team, k, object_id, start_x, start_y, expected_goal, success FROM a"))
def lens_actions(spark, d):
    """The action table itself."""
    return lens.actions(spark, d).select("match_id", "period_id", "action_id", "event_id", "spadl_type", "team", "k", "object_id", "start_x", "start_y", "expected_goal", "success")


RETURNS = """
, r AS (SELECT x.match_id, x.period_id, x.action_id, x.team, x.spadl_type,
  max(CASE WHEN y.team = x.team AND y.expected_goal IS NOT NULL AND y.success THEN 1 ELSE 0 END) AS scores,
  max(CASE WHEN y.team <> x.team AND y.expected_goal IS NOT NULL AND y.success THEN 1 ELSE 0 END) AS concedes,
  1 - product(CASE WHEN y.team = x.team THEN 1 - coalesce(y.expected_goal, 0) ELSE 1 END) AS scores_xg,
  1 - product(CASE WHEN y.team <> x.team THEN 1 - coalesce(y.expected_goal, 0) ELSE 1 END) AS concedes_xg
  FROM a x JOIN a y ON x.match_id = y.match_id AND x.period_id = y.period_id AND y.action_id BETWEEN x.action_id AND x.action_id + 9 GROUP BY ALL)
"""


@query("w06_future_returns", with_actions(RETURNS + f"SELECT match_id, action_id, scores, concedes, {R6.format('scores_xg')} AS scores_xg, {R6.format('concedes_xg')} AS concedes_xg FROM r"))
def future_returns(spark, d):
    """Goals and expected goals of both teams in the next ten rows."""
    out = S.future_returns(lens.actions(spark, d))
    return out.select("match_id", "action_id", "scores", "concedes", G.at_6(F.col("scores_xg")).alias("scores_xg"), G.at_6(F.col("concedes_xg")).alias("concedes_xg"))


@query(
    "returns_by_type",
    with_actions(RETURNS + f"SELECT team, spadl_type, count(*) AS n, CAST(sum(scores) AS BIGINT) AS goals_ahead, {R6.format('avg(scores_xg - concedes_xg)')} AS mean_net_xg FROM r GROUP BY team, spadl_type"),
)
def returns_by_type(spark, d):
    """Expected return per team and action type."""
    out = S.future_returns(lens.actions(spark, d))
    return out.groupBy("team", "spadl_type").agg(F.count("*").alias("n"), F.sum("scores").alias("goals_ahead"), G.at_6(F.avg(F.col("scores_xg") - F.col("concedes_xg"))).alias("mean_net_xg"))


@query(
    "w07_discounted_returns",
    with_actions(
        f"""
, e AS (SELECT *, coalesce(expected_goal, 0) AS xg, (coalesce(expected_goal, 0) > 0 AND success) OR lead(period_id) OVER w <> period_id OR lead(spadl_type) OVER w = 'goalkick' AS ends
        FROM a WINDOW w AS (PARTITION BY match_id ORDER BY action_id))
, g AS (SELECT *, coalesce(sum(CASE WHEN coalesce(ends, false) THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM e)
, r AS (SELECT x.match_id, x.action_id,
  1 - product(CASE WHEN y.team = x.team THEN 1 - pow(0.95::DOUBLE, y.action_id - x.action_id) * y.xg ELSE 1 END) AS s,
  1 - product(CASE WHEN y.team <> x.team THEN 1 - pow(0.95::DOUBLE, y.action_id - x.action_id) * y.xg ELSE 1 END) AS c
  FROM g x JOIN g y ON x.match_id = y.match_id AND x.seg = y.seg AND y.action_id >= x.action_id GROUP BY x.match_id, x.action_id)
SELECT match_id, action_id, {R6.format('s')} AS scores_xg_disc, {R6.format('c')} AS concedes_xg_disc FROM r"""
    ),
)
def discounted_returns(spark, d):
    """Discounted expected goals of both teams until play ends."""
    out = S.discounted_returns(lens.actions(spark, d))
    return out.select("match_id", "action_id", G.at_6(F.col("scores_xg_disc")).alias("scores_xg_disc"), G.at_6(F.col("concedes_xg_disc")).alias("concedes_xg_disc"))


@query(
    "w08_value_returns",
    with_actions(
        """
, e AS (SELECT *, CASE WHEN k % 5 <> 0 THEN k / 100.0::DOUBLE END AS xt FROM a)
, f AS (SELECT *, spadl_type IN ('pass', 'cross', 'shot') AND xt IS NOT NULL AS el FROM e)
, n AS (SELECT *, sum(CASE WHEN el THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY action_id) AS nth FROM f)
SELECT x.match_id, x.action_id, coalesce(max(CASE WHEN y.team = x.team THEN y.xt END), 0) AS scores_xt, coalesce(max(CASE WHEN y.team <> x.team THEN y.xt END), 0) AS concedes_xt
FROM n x LEFT JOIN n y ON x.match_id = y.match_id AND y.el AND y.nth BETWEEN x.nth + 1 AND x.nth + 5 AND y.action_id > x.action_id GROUP BY x.match_id, x.action_id"""
    ),
)
def value_returns(spark, d):
    """Largest grid value of both teams among the next five eligible rows."""
    a = lens.actions(spark, d).withColumn("xt", F.when(F.col("k") % 5 != 0, F.col("k") / F.lit(100.0)))
    return S.value_returns(a).select("match_id", "action_id", "scores_xt", "concedes_xt")


@query(
    "w02_episodes",
    with_actions(
        """
, f AS (SELECT match_id, period_id, frame_id // 3600 AS frame_id, action_id, k % 10 <> 0 AS alive FROM a)
, g AS (SELECT *, lag(frame_id) OVER (PARTITION BY match_id, period_id, alive ORDER BY frame_id) AS p FROM f)
, h AS (SELECT *, CASE WHEN p IS NULL OR frame_id - p >= 5 THEN 1 ELSE 0 END AS st FROM g)
SELECT match_id, period_id, frame_id, alive, CASE WHEN alive THEN sum(st) OVER (PARTITION BY match_id, alive ORDER BY period_id, frame_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END::BIGINT AS episode_id FROM h"""
    ),
)
def episodes(spark, d):
    """Episodes of hours in which something happened: a gap of five begins a new one."""
    f = lens.actions(spark, d).select("match_id", "period_id", F.floor(F.col("frame_id") / 3600).alias("frame_id"), (F.col("k") % 10 != 0).alias("alive"))
    return S.episodes(f, 5, F.col("alive")).select("match_id", "period_id", "frame_id", "alive", "episode_id")


@query(
    "n19_next_action",
    with_actions("SELECT match_id, action_id, lead(object_id) OVER w AS next_player_id, lead(spadl_type) OVER w AS next_type FROM a WINDOW w AS (PARTITION BY match_id, period_id ORDER BY action_id)"),
)
def next_action(spark, d):
    return S.next_action(lens.actions(spark, d)).select("match_id", "action_id", "next_player_id", "next_type")


@query(
    "n16_previous_location",
    with_actions(
        """SELECT match_id, action_id, last_value(CASE WHEN spadl_type <> 'foul' THEN start_x END IGNORE NULLS) OVER w AS prev_x, last_value(CASE WHEN spadl_type <> 'foul' THEN start_y END IGNORE NULLS) OVER w AS prev_y
FROM a WINDOW w AS (PARTITION BY match_id, period_id ORDER BY action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
    ),
)
def previous_location(spark, d):
    """The last known start before each row; fouls have none."""
    seen = F.col("spadl_type") != "foul"
    return lens.actions(spark, d).select("match_id", "action_id", S.previous_known(F.when(seen, F.col("start_x"))).alias("prev_x"), S.previous_known(F.when(seen, F.col("start_y"))).alias("prev_y"))


@query(
    "w18_filled_labels",
    with_actions("SELECT match_id, action_id, last_value(CASE WHEN k % 4 = 0 THEN spadl_type END IGNORE NULLS) OVER (PARTITION BY match_id, period_id ORDER BY action_id) AS label FROM a"),
)
def filled_labels(spark, d):
    """Labels carried forward to rows without one."""
    return lens.actions(spark, d).select("match_id", "action_id", S.filled(F.when(F.col("k") % 4 == 0, F.col("spadl_type"))).alias("label"))


@query(
    "w03_frame_numbers",
    with_actions(
        """SELECT match_id, action_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY match_id, period_id)) / 1e6 AS seconds,
CAST(round_even(((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY match_id, period_id)) / 1e6) * 25.0, 0) AS BIGINT) AS frame FROM a"""
    ),
)
def frame_numbers(spark, d):
    """Seconds since the period's first event, and their frame at 25 a second."""
    return lens.actions(spark, d).withColumn("seconds", S.event_seconds()).select("match_id", "action_id", "seconds", S.frame_number(F.col("seconds")).alias("frame"))


@query(
    "w09_pass_actions",
    with_actions(
        """
, e AS (SELECT *, lead(object_id) OVER w AS np, lead(spadl_type) OVER w AS nt FROM a WINDOW w AS (PARTITION BY match_id, period_id ORDER BY action_id))
SELECT match_id, action_id, receiver_id, coalesce(receiver_id[1:4] = team AND NOT offside, false) AS success FROM e WHERE spadl_type IN ('pass', 'cross') AND (receiver_id = np OR receiver_id = 'out' OR nt IN ('foul', 'freekick_short'))"""
    ),
)
def pass_actions(spark, d):
    return S.pass_actions(lens.actions(spark, d)).select("match_id", "action_id", "receiver_id", "success")


@query(
    "w09_dribble_actions",
    with_actions(
        """
, e AS (SELECT *, lead(object_id) OVER w AS np, lead(frame_id) OVER w AS nf FROM a WINDOW w AS (PARTITION BY match_id, period_id ORDER BY action_id))
SELECT match_id, action_id, np AS receiver_id, nf AS receive_frame_id, success FROM e WHERE spadl_type IN ('foul', 'goalkick') AND np IS NOT NULL"""
    ),
)
def dribble_actions(spark, d):
    """Dribbles; the lens has fouls and goal kicks in their place."""
    return S.dribble_actions(lens.actions(spark, d), ("foul", "goalkick")).select("match_id", "action_id", "receiver_id", "receive_frame_id", "success")


@query(
    "w09_shot_actions",
    with_actions(
        """
, e AS (SELECT *, lead(spadl_type) OVER (PARTITION BY match_id, period_id ORDER BY action_id) AS nt FROM a)
SELECT match_id, action_id, expected_goal, success, coalesce(nt = 'shot_block', false) AS blocked FROM e WHERE spadl_type IN ('shot', 'shot_freekick', 'shot_penalty')"""
    ),
)
def shot_actions(spark, d):
    return S.shot_actions(lens.actions(spark, d)).select("match_id", "action_id", "expected_goal", "success", "blocked")


def varied(a):
    """Rows with types of defensive touches, set pieces and take-ons in place of some."""
    return a.withColumn("spadl_type", F.when(F.col("k") % 6 == 1, "interception").when(F.col("k") % 6 == 2, "freekick_short").when(F.col("k") % 6 == 3, "take_on").otherwise(F.col("spadl_type")))


VARIED = "v AS (SELECT * REPLACE (CASE k % 6 WHEN 1 THEN 'interception' WHEN 2 THEN 'freekick_short' WHEN 3 THEN 'take_on' ELSE spadl_type END AS spadl_type) FROM a)"


@query(
    "w10_post_actions",
    with_actions(
        f"""
, {VARIED}
, e AS (SELECT *, lead(object_id) OVER w AS np, lead(spadl_type) OVER w AS nt, lead(frame_id) OVER w AS nf FROM v WINDOW w AS (PARTITION BY match_id, period_id ORDER BY action_id))
, j AS (SELECT e.*,
   (SELECT min(y.action_id) FROM v y WHERE y.match_id = e.match_id AND y.period_id = e.period_id AND y.action_id >= e.action_id + 2 AND y.spadl_type NOT IN ('interception', 'bad_touch', 'shot_block', 'keeper_save', 'keeper_punch')) AS cl,
   (SELECT min(y.action_id) FROM v y WHERE y.match_id = e.match_id AND y.period_id = e.period_id AND y.action_id >= e.action_id + 1 AND y.spadl_type IN ('freekick_short', 'freekick_crossed', 'shot_freekick', 'shot_penalty')) AS sp FROM e)
, p AS (SELECT *, CASE WHEN nt IN ('throw_in', 'goalkick', 'corner_short', 'corner_crossed') THEN action_id + 1 WHEN nt IN ('interception', 'bad_touch', 'shot_block', 'keeper_save', 'keeper_punch') THEN cl
        WHEN nt = 'foul' AND sp < action_id + 5 THEN sp END AS at FROM j)
, o AS (SELECT p.match_id, p.action_id, coalesce(y.object_id, p.receiver_id) AS pl, CASE WHEN y.object_id IS NULL THEN p.receive_frame_id ELSE y.frame_id END AS fr, CASE WHEN y.object_id IS NULL THEN p.nt ELSE y.spadl_type END AS ki,
        p.nt = 'foul' AND p.sp < p.action_id + 5 AND p.spadl_type = 'take_on' AS tk, y.object_id AS yo, p.team, p.success, p.receiver_id, p.object_id, p.period_id, p.sp
        FROM p LEFT JOIN v y ON y.match_id = p.match_id AND y.action_id = p.at)
, q AS (SELECT o.*, (SELECT arg_min(y.object_id, y.action_id) FROM v y WHERE y.match_id = o.match_id AND y.period_id = o.period_id AND y.action_id BETWEEN o.action_id AND o.sp AND y.spadl_type = 'foul' AND y.success) AS won FROM o)
SELECT match_id, action_id, CASE WHEN pl = 'out' THEN NULL ELSE pl END AS end_player_id, CASE WHEN pl = 'out' THEN NULL ELSE fr END AS end_frame_id, CASE WHEN pl = 'out' THEN NULL ELSE ki END AS end_type,
  CASE WHEN coalesce(tk, false) THEN yo[1:4] = team ELSE success END AS success,
  CASE WHEN coalesce(tk, false) AND yo[1:4] = team THEN object_id WHEN coalesce(tk, false) THEN coalesce(won, receiver_id) ELSE receiver_id END AS receiver_id FROM q"""
    ),
)
def post_actions(spark, d):
    """Who has the ball after each action, when, and by what."""
    return S.post_actions(varied(lens.actions(spark, d))).select("match_id", "action_id", "end_player_id", "end_frame_id", "end_type", "success", "receiver_id")


@query(
    "w11_inserted_dribbles",
    with_actions(
        """
, e AS (SELECT *, lead(object_id) OVER w AS no, lead(spadl_type) OVER w AS nt, lead(frame_id) OVER w AS nf, lead(start_x) OVER w AS nx, lead(start_y) OVER w AS ny FROM a WINDOW w AS (PARTITION BY match_id, period_id ORDER BY action_id))
SELECT match_id, action_id, greatest(receive_frame_id, frame_id + 1) AS frame_id, no AS object_id, nf AS receive_frame_id, end_x AS start_x, end_y AS start_y, nx AS end_x, ny AS end_y
FROM e WHERE NOT offside AND nt NOT IN ('throw_in', 'goalkick', 'corner_short', 'corner_crossed') AND nf - receive_frame_id >= 5 AND no = receiver_id"""
    ),
)
def inserted_dribbles(spark, d):
    return S.inserted_dribbles(lens.actions(spark, d)).select("match_id", "action_id", "frame_id", "object_id", "receive_frame_id", "start_x", "start_y", "end_x", "end_y")


@query(
    "w13_one_touch",
    with_actions("SELECT match_id, action_id, coalesce(frame_id < lag(receive_frame_id) OVER (PARTITION BY match_id ORDER BY action_id) + 3, false) AS one_touch FROM a"),
)
def one_touch(spark, d):
    return lens.actions(spark, d).select("match_id", "action_id", S.one_touch().alias("one_touch"))


@query(
    "n20_until_last_synced",
    with_actions(", l AS (SELECT *, max(CASE WHEN k % 9 = 0 THEN action_id END) OVER (PARTITION BY match_id) AS m FROM a) SELECT match_id, action_id, spadl_type FROM l WHERE action_id <= m"),
)
def until_last_synced(spark, d):
    return S.until_last_synced(lens.actions(spark, d), F.col("k") % 9 == 0).select("match_id", "action_id", "spadl_type")


@query(
    "w17_jump_free_prefix",
    with_actions(
        """
, f AS (SELECT DISTINCT match_id, period_id, frame_id // 36000 AS frame_id FROM a)
, g AS (SELECT *, CASE WHEN frame_id - lag(frame_id) OVER (PARTITION BY match_id, period_id ORDER BY frame_id) > 1 THEN 1 ELSE 0 END AS j FROM f)
, h AS (SELECT *, sum(j) OVER (PARTITION BY match_id, period_id ORDER BY frame_id) AS js FROM g)
SELECT match_id, period_id, frame_id FROM h WHERE js = 0"""
    ),
)
def jump_free_prefix(spark, d):
    f = lens.actions(spark, d).select("match_id", "period_id", F.floor(F.col("frame_id") / 36000).alias("frame_id")).distinct()
    return S.jump_free_prefix(f)


@query(
    "n23_without_self_passes",
    with_actions(
        """
, e AS (SELECT *, lead(team) OVER w = team AND lead(k % 3) OVER w = k % 3 AND (lead(epoch_us(ts)) OVER w - epoch_us(ts)) <= 36000000000 AND spadl_type = 'pass' AS sp FROM a WINDOW w AS (PARTITION BY match_id, period_id ORDER BY action_id))
SELECT match_id, action_id FROM e WHERE NOT coalesce(sp, false)"""
    ),
)
def without_self_passes(spark, d):
    """Passes without those that the same player follows within ten hours (three players a team here)."""
    a = lens.actions(spark, d).withColumn("object_id", F.concat_ws("_", "team", (F.col("k") % 3).cast("string")))
    return S.without_self_passes(a, 36000.0).select("match_id", "action_id")


@query(
    "n22_sorted_events",
    with_actions("SELECT match_id, action_id, row_number() OVER (PARTITION BY match_id ORDER BY period_id, floor(epoch(ts) / 3600), event_id) - 1 AS position FROM a"),
)
def sorted_events(spark, d):
    """Place of each action when ordered by period, hour and id."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    w = W.partitionBy("match_id").orderBy("period_id", hour, "event_id")
    return lens.actions(spark, d).select("match_id", "action_id", (F.row_number().over(w) - 1).cast("long").alias("position"))
