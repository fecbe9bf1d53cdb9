"""Queries of the canonical tables and of components, each with its DuckDB twin; inputs are views of the lens's actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vocab import SHOT_OUT_SHARE
from ..operators import canonical as N
from ..operators import components as C

from ..operators import sequence as S
from ..operators import validate as V
from . import lens
from .lens import with_actions
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


def micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


STARTS = """
, ps AS (SELECT match_id, period_id, coalesce(arg_min(ts, action_id) FILTER (WHERE k % 50 = 0), arg_min(ts, action_id)) AS start FROM a GROUP BY ALL)
"""


def starts(a):
    return N.period_starts(a, F.col("k") % 50 == 0)


@query("n03_period_starts", with_actions(STARTS + "SELECT match_id, period_id, epoch_us(start) AS start_us FROM ps"))
def period_starts(spark, d):
    """Kickoff, or first event, of each period."""
    return starts(lens.actions(spark, d)).select("match_id", "period_id", micros("start").alias("start_us"))


CANONICAL = (
    STARTS
    + """
, li AS (SELECT DISTINCT match_id, 'p_' || object_id AS player_id, object_id, upper(object_id) AS match_name, CASE WHEN object_id LIKE '%\\_1' ESCAPE '\\' THEN 'goal_keeper' ELSE 'other' END AS advanced_position FROM a WHERE object_id NOT LIKE '%\\_7' ESCAPE '\\')
, ce AS (SELECT a.match_id AS stats_perform_match_id, action_id, a.event_id::VARCHAR AS original_event_id, a.period_id, value AS seconds, epoch_us(start) + round(value * 1000000)::BIGINT AS utc_us, 'p_' || a.object_id AS player_id, li.object_id, match_name AS player_name,
   advanced_position, team AS team_id, spadl_type, event_id % 29 <> 0 AND success AS success, event_id % 29 = 0 AS offside, expected_goal, start_x, start_y, end_x, end_y
   FROM a JOIN li ON li.match_id = a.match_id AND li.player_id = 'p_' || a.object_id JOIN ps ON ps.match_id = a.match_id AND ps.period_id = a.period_id WHERE event_id % 31 <> 0)
"""
)


def lineup(a):
    o = F.col("object_id")
    return a.where(~o.endswith("_7")).select("match_id", F.concat(F.lit("p_"), o).alias("player_id"), "object_id", F.upper(o).alias("match_name"), F.when(o.endswith("_1"), "goal_keeper").otherwise("other").alias("advanced_position")).distinct()


def canonical(spark, d):
    a = lens.actions(spark, d)
    spadl = a.select(
        "match_id", "action_id", F.col("event_id").alias("original_event_id"), "period_id", F.col("value").alias("time_seconds"), F.concat(F.lit("p_"), "object_id").alias("player_id"), F.col("team").alias("team_id"),
        F.when(F.col("event_id") % 31 == 0, "non_action").otherwise(F.col("spadl_type")).alias("type_name"), F.when(F.col("event_id") % 29 == 0, "offside").when(F.col("success"), "success").otherwise("fail").alias("result_name"),
        "start_x", "start_y", "end_x", "end_y",
    )
    return N.canonical_events(spadl, lineup(a), a.select("match_id", "event_id", "expected_goal"), starts(a))


@query("n17_canonical_events", with_actions(CANONICAL + "SELECT * FROM ce"))
def canonical_events(spark, d):
    """The canonical event table."""
    out = canonical(spark, d)
    return out.withColumn("utc_us", micros("utc_timestamp")).drop("utc_timestamp")


@query("n18_event_export", with_actions(STARTS + f"SELECT event_id, a.period_id, {R6.format('(epoch_us(ts) - epoch_us(start)) / 1e6::DOUBLE')} AS seconds, team AS team_id, success, k FROM a JOIN ps ON ps.match_id = a.match_id AND ps.period_id = a.period_id"))
def event_export(spark, d):
    """The exported event table: times as seconds of the period."""
    a = lens.actions(spark, d)
    e = a.join(starts(a), ["match_id", "period_id"]).select("k", F.col("ts").alias("timestamp"), F.col("team").alias("team_id"), "event_id", "period_id", "success", "start")
    return N.exported(e).withColumn("seconds", G.at_6(F.col("seconds"))).drop("timestamp")


FRAMES = """
, fr AS (SELECT match_id, frame_id, arg_min(period_id, (period_id, timestamp)) AS period_id, arg_min(timestamp, (period_id, timestamp)) AS timestamp, arg_min(utc, (period_id, timestamp)) AS utc FROM
   (SELECT match_id, period_id, frame_id, frame_id % 7200 + 0.25::DOUBLE AS timestamp, to_timestamp(0)::TIMESTAMP + to_microseconds(1704067200000000 + frame_id * 1000000) AS utc FROM a UNION ALL SELECT match_id, period_id, receive_frame_id, receive_frame_id % 7200 + 0.25::DOUBLE, to_timestamp(0)::TIMESTAMP + to_microseconds(1704067200000000 + receive_frame_id * 1000000) FROM a WHERE k % 2 = 0) GROUP BY ALL)
, ft AS (SELECT match_id, frame_id, period_id, timestamp, utc, printf('%02d:%02d.%02d', floor(timestamp / 60)::INT, (floor(timestamp) % 60)::INT, 25) AS synced_ts, utc + INTERVAL 1 HOUR AS local_tracking_time FROM fr)
"""


def frames(a):
    one = lambda c: F.struct("match_id", "period_id", F.col(c).alias("frame_id"))
    f = a.select(F.explode(F.array_compact(F.array(one("frame_id"), F.when(F.col("k") % 2 == 0, one("receive_frame_id"))))).alias("f")).select("f.*")
    utc = F.timestamp_micros(F.lit(1704067200000000) + F.col("frame_id") * 1_000_000).cast("timestamp_ntz")
    return N.frame_table(f.withColumns({"timestamp": F.col("frame_id") % 7200 + F.lit(0.25), "utc_timestamp": utc}))


@query("y21_frame_table", with_actions(FRAMES + "SELECT match_id, frame_id, period_id, timestamp, synced_ts, epoch_us(local_tracking_time) AS local_us FROM ft"))
def frame_table(spark, d):
    """One row per frame with clock text and Berlin time (all of it in winter)."""
    return frames(lens.actions(spark, d)).select("match_id", "frame_id", "period_id", "timestamp", "synced_ts", micros("local_tracking_time").alias("local_us"))


SYNCED = (
    FRAMES
    + """
, pk AS (SELECT match_id, event_id::VARCHAR AS eid, CASE WHEN event_id % 5 <> 0 THEN frame_id ELSE -1 END AS fno, CASE WHEN k % 2 = 0 THEN receive_frame_id ELSE -5 END AS rec, CASE WHEN event_id % 4 <> 0 THEN 'p_' || receiver_id END AS puid, event_id % 13 = 0 AS nor, epoch_us(ts) AS tus FROM a WHERE event_id % 3 <> 0)
, fb AS (SELECT match_id, action_id, frame_id AS f0, receive_frame_id AS r0, receiver_id AS w0 FROM a WHERE event_id % 7 <> 0)
, lu AS (SELECT DISTINCT match_id, 'p_' || object_id AS player_id, object_id FROM a WHERE object_id NOT LIKE '%\\_7' ESCAPE '\\')
, s0 AS (SELECT a.match_id, a.action_id, a.event_id::VARCHAR AS original_event_id, a.period_id, a.value AS seconds, a.object_id, a.spadl_type, a.spadl_type IN ('pass', 'cross', 'goalkick') AS ps, pk.eid IS NOT NULL AS by_provider, x.frame_id AS fp,
   CASE WHEN a.spadl_type IN ('pass', 'cross', 'goalkick') THEN y.frame_id END AS rp, CASE WHEN a.spadl_type IN ('pass', 'cross', 'goalkick') THEN coalesce(lu.object_id, CASE WHEN nor THEN 'out' END) END AS wp, f0, r0, w0, fb.action_id IS NOT NULL AS has
   FROM a LEFT JOIN pk ON pk.match_id = a.match_id AND pk.eid = a.event_id::VARCHAR LEFT JOIN ft x ON x.match_id = a.match_id AND x.frame_id = pk.fno LEFT JOIN ft y ON y.match_id = a.match_id AND y.frame_id = pk.rec
   LEFT JOIN lu ON lu.match_id = a.match_id AND lu.player_id = pk.puid LEFT JOIN fb ON fb.match_id = a.match_id AND fb.action_id = a.action_id)
, sy AS (SELECT match_id, action_id, original_event_id, period_id, seconds, object_id, spadl_type, coalesce(fp, CASE WHEN has THEN f0 END) AS frame_id, CASE WHEN ps AND (rp IS NULL OR wp IS NULL) AND has THEN r0 ELSE rp END AS receive_frame_id,
   coalesce(wp, CASE WHEN ps AND has THEN w0 END) AS receiver_id, by_provider, fp IS NOT NULL AS by_frame, rp IS NOT NULL AS by_receive, fp IS NULL AND has AS frame_filled, ps AND (rp IS NULL OR wp IS NULL) AND has AS receive_filled FROM s0)
"""
)


def provider(a):
    n = F.col("event_id")
    return a.where(n % 3 != 0).select(
        "match_id", n.cast("string").alias("EVENT_ID"), F.when(n % 5 != 0, F.col("frame_id")).otherwise(F.lit(-1)).cast("long").alias("FRAME_NUMBER"), F.when(F.col("k") % 2 == 0, F.col("receive_frame_id")).otherwise(F.lit(-5)).cast("long").alias("RECFRM"),
        F.when(n % 4 != 0, F.concat(F.lit("p_"), "receiver_id")).alias("PUID2"), (n % 13 == 0).alias("NORECEIVER"), F.col("ts").alias("TRACKING_TIME"),
    )


def synced(a):
    events = a.select("match_id", "action_id", F.col("event_id").cast("string").alias("original_event_id"), "period_id", F.col("value").alias("seconds"), "object_id", "spadl_type")
    fallback = a.where(F.col("event_id") % 7 != 0).select("match_id", "action_id", "frame_id", "receive_frame_id", "receiver_id")
    return N.provider_synced(events, provider(a), frames(a), lineup(a), fallback)


@query("y19_provider_sync", with_actions(SYNCED + "SELECT match_id, action_id, frame_id, receive_frame_id, receiver_id FROM sy"))
def provider_sync(spark, d):
    """Frames and receivers by the provider's file, with the synchroniser's table in the gaps."""
    return synced(lens.actions(spark, d)).select("match_id", "action_id", "frame_id", "receive_frame_id", "receiver_id")


@query(
    "y19_sync_audit",
    with_actions(
        SYNCED
        + """SELECT match_id, count(*) FILTER (WHERE by_provider) AS event_matches, count(*) FILTER (WHERE by_frame) AS frame_matches, count(*) FILTER (WHERE by_receive) AS receive_matches, count(*) FILTER (WHERE frame_filled) AS frame_fallbacks,
  count(*) FILTER (WHERE receive_filled) AS receive_fallbacks, count(frame_id) AS synced_rows, count(receive_frame_id) AS receive_rows FROM sy GROUP BY match_id"""
    ),
)
def sync_audit(spark, d):
    """How many rows the provider matched and the synchroniser filled."""
    return N.sync_audit(synced(lens.actions(spark, d)))


@query("y20_time_comparison", with_actions(SYNCED + f"SELECT sy.match_id, sy.original_event_id AS event_id, sy.period_id AS period, {R6.format('(epoch_us(local_tracking_time) - tus) / 1e6::DOUBLE')} AS time_dif FROM sy LEFT JOIN ft ON ft.match_id = sy.match_id AND ft.frame_id = sy.frame_id LEFT JOIN pk ON pk.match_id = sy.match_id AND pk.eid = sy.original_event_id"))
def time_comparison(spark, d):
    """Synced local time against the provider's."""
    a = lens.actions(spark, d)
    out = N.time_comparison(synced(a), frames(a), provider(a))
    return out.select("match_id", "event_id", "period", G.at_6(F.col("time_dif")).alias("time_dif"))


@query(
    "n20_finalized_output",
    with_actions(
        SYNCED
        + """, la AS (SELECT match_id AS mid, max((period_id, seconds, action_id)) FILTER (WHERE frame_id IS NOT NULL) AS last FROM sy GROUP BY match_id)
, ku AS (SELECT sy.*, x.synced_ts, y.synced_ts AS receive_ts FROM sy JOIN la ON la.mid = sy.match_id LEFT JOIN ft x ON x.match_id = sy.match_id AND x.frame_id = sy.frame_id LEFT JOIN ft y ON y.match_id = sy.match_id AND y.frame_id = sy.receive_frame_id
   WHERE last IS NULL OR (sy.period_id, sy.seconds, sy.action_id) <= last)
SELECT match_id, action_id, synced_ts, receive_ts, lead(object_id) OVER w AS next_player_id, lead(spadl_type) OVER w AS next_type FROM ku WINDOW w AS (PARTITION BY match_id, ku.period_id ORDER BY seconds, action_id)"""
    ),
)
def finalized_output(spark, d):
    """Synced rows with clock texts up to the last synced one, and what follows."""
    a = lens.actions(spark, d)
    return N.finalized(synced(a), frames(a)).select("match_id", "action_id", "synced_ts", "receive_ts", "next_player_id", "next_type")


@query(
    "n43_backfilled_places",
    with_actions(
        """, tr AS (SELECT match_id, frame_id, object_id, arg_min(start_x, event_id) AS x, arg_min(start_y, event_id) AS y FROM a GROUP BY ALL), ba AS (SELECT match_id, frame_id, arg_min(end_x, event_id) AS x, arg_min(end_y, event_id) AS y, arg_min(k / 10.0::DOUBLE, event_id) AS z FROM a GROUP BY ALL)
SELECT a.event_id, tr.x AS start_x, tr.y AS start_y, ba.z AS start_z, bb.x AS end_x, bb.y AS end_y FROM a LEFT JOIN tr ON tr.match_id = a.match_id AND tr.frame_id = a.frame_id AND tr.object_id = a.object_id LEFT JOIN ba ON ba.match_id = a.match_id AND ba.frame_id = a.frame_id
  LEFT JOIN ba bb ON bb.match_id = a.match_id AND bb.frame_id = a.receive_frame_id"""
    ),
)
def backfilled_places(spark, d):
    """Start and end places taken from tracking."""
    a = lens.actions(spark, d)
    at = lambda x, y, z, o: a.groupBy("match_id", "frame_id", o.alias("object_id")).agg(*[F.min_by(c, "event_id").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))])
    tracking = at(F.col("start_x"), F.col("start_y"), F.lit(None).cast("double"), F.col("object_id")).unionByName(at(F.col("end_x"), F.col("end_y"), F.col("k") / F.lit(10.0), F.lit("ball")))
    out = N.backfilled_places(a.select("match_id", "event_id", "object_id", "frame_id", "receive_frame_id"), tracking)
    return out.select("event_id", "start_x", "start_y", "start_z", "end_x", "end_y")


@query(
    "w12_prior_frames",
    with_actions(
        """SELECT a.event_id, o::INTEGER AS "offset", CASE WHEN o = 0 THEN a.frame_id ELSE max(b.frame_id) END AS prior_frame FROM a, (VALUES (0), (12), (25)) t(o) LEFT JOIN a b ON o > 0 AND b.match_id = a.match_id AND b.period_id = a.period_id AND b.object_id = a.object_id AND b.frame_id <= a.frame_id - o
GROUP BY a.event_id, a.frame_id, o HAVING o = 0 OR max(b.frame_id) IS NOT NULL"""
    ),
)
def prior_frames(spark, d):
    """Frames 12 and 25 back, or the last before, that have the possessor."""
    a = lens.actions(spark, d).withColumn("phase_id", F.col("period_id"))
    out = N.prior_frames(a.select("event_id", "match_id", "phase_id", "object_id", "frame_id"), a.select("match_id", "phase_id", "object_id", "frame_id"))
    return out.select("event_id", "offset", "prior_frame")


@query(
    "j17_merged_tracking",
    with_actions(
        """, h AS (SELECT DISTINCT match_id, period_id, (round_even(frame_id / 3600.0::DOUBLE, 0) * 3600)::DOUBLE AS timestamp FROM a UNION SELECT DISTINCT match_id, period_id, 1.0::DOUBLE FROM a)
, e AS (SELECT match_id, period_id, (round_even(frame_id / 3600.0::DOUBLE, 0) * 3600)::DOUBLE AS timestamp, action_id, object_id, spadl_type FROM a WHERE event_id % 4 <> 0)
SELECT h.match_id, h.period_id, h.timestamp, action_id, last_value(object_id IGNORE NULLS) OVER w AS object_id, last_value(spadl_type IGNORE NULLS) OVER w AS spadl_type FROM h LEFT JOIN e ON e.match_id = h.match_id AND e.period_id = h.period_id AND e.timestamp = h.timestamp
WINDOW w AS (PARTITION BY h.match_id, h.period_id ORDER BY h.timestamp, action_id NULLS FIRST ROWS UNBOUNDED PRECEDING)"""
    ),
)
def merged_tracking(spark, d):
    """Events on the tracking's times (hours here), the last one repeated."""
    a = lens.actions(spark, d)
    hour = F.rint(F.col("frame_id") / F.lit(3600.0)) * 3600
    times = a.select("match_id", "period_id", hour.alias("timestamp")).union(a.select("match_id", "period_id", F.lit(1.0))).distinct()
    events = a.where(F.col("event_id") % 4 != 0).select("match_id", "period_id", F.col("frame_id").cast("double").alias("timestamp"), "action_id", "object_id", "spadl_type")
    return N.merged_tracking(times, events, ["object_id", "spadl_type"], 1 / 3600, fill=True).select("match_id", "period_id", "timestamp", "action_id", "object_id", "spadl_type")


@query("l09_value_actions", with_actions("SELECT event_id, (CASE spadl_type WHEN 'pass' THEN 0 WHEN 'cross' THEN 1 ELSE 11 END)::INTEGER AS type_id, (CASE WHEN offside THEN 2 WHEN success THEN 1 ELSE 0 END)::INTEGER AS result_id, 0::INTEGER AS bodypart_id, expected_goal AS \"xG\" FROM a WHERE spadl_type IN ('pass', 'cross', 'shot')"))
def value_actions(spark, d):
    """The value grid's view of actions."""
    return N.value_actions(lens.raw_actions(spark, d)).select("event_id", "type_id", "result_id", "bodypart_id", "xG")


@query("l14_value_sidecar", with_actions("SELECT event_id, CASE WHEN match_id % 2 = 0 THEN (CASE WHEN event_id % 3 = 0 THEN value END) ELSE k / 2.0::DOUBLE END AS \"xT\", CASE WHEN match_id % 2 = 0 AND event_id % 3 = 0 THEN k / 4.0::DOUBLE END AS \"scores_xT\" FROM a"))
def value_sidecar(spark, d):
    """Values of the sidecar in place of the events' own, where the match has one."""
    a = lens.actions(spark, d)
    side = a.where("match_id % 2 = 0 AND event_id % 3 = 0").select("match_id", "action_id", F.col("value").alias("xT"), (F.col("k") / F.lit(4.0)).alias("scores_xT"), F.lit(0.0).alias("concedes_xT"))
    return N.with_sidecar(a.withColumn("xT", F.col("k") / F.lit(2.0)), side).select("event_id", "xT", "scores_xT")


@query("n24_object_ids", with_actions(", f AS (SELECT match_id, object_id, arg_min(k % 9, frame_id * 1000000 + event_id) AS player_id FROM a WHERE k % 4 <> 0 GROUP BY ALL) SELECT match_id, player_id, max(object_id) AS object_id FROM f GROUP BY ALL"))
def object_ids(spark, d):
    """Objects of players by the first id that tracking shows."""
    a = lens.actions(spark, d)
    t = a.select("match_id", "object_id", (F.col("frame_id") * 1000000 + F.col("event_id")).alias("frame_id"), F.when(F.col("k") % 4 != 0, F.col("k") % 9).alias("player_id"))
    return N.object_ids(t)


@query("n33_keeper_objects", with_actions(", p AS (SELECT DISTINCT match_id, k AS player_id, k % 2 AS team_id, k % 10 = 0 AS g FROM a), o AS (SELECT match_id, min(event_id) AS possession_id, arg_min(k, event_id) AS player_id FROM a GROUP BY match_id) SELECT o.match_id, possession_id, (CASE WHEN q.team_id = p.team_id THEN 'home_' ELSE 'away_' END) || q.player_id AS object_id FROM o JOIN p ON p.match_id = o.match_id AND p.player_id = o.player_id JOIN p q ON q.match_id = o.match_id AND q.g"))
def keeper_objects(spark, d):
    """Keepers, named by the possession's side."""
    a = lens.raw_actions(spark, d)
    p = a.select("match_id", F.col("k").alias("player_id"), (F.col("k") % 2).alias("team_id"), (F.col("k") % 10 == 0).alias("is_goalkeeper")).distinct()
    return N.keeper_objects(p, a.groupBy("match_id").agg(F.min("event_id").alias("possession_id"), F.min_by("k", "event_id").alias("player_id")))


@query("n35_matches_by_kickoff", with_actions(", m AS (SELECT match_id, min(ts) AS kickoff FROM a GROUP BY match_id) SELECT match_id, row_number() OVER (ORDER BY kickoff, match_id) AS place FROM m"))
def matches_by_kickoff(spark, d):
    """Matches in order of kickoff (one row a match, so one small task numbers them)."""
    m = lens.raw_actions(spark, d).groupBy("match_id").agg(F.min("ts").alias("kickoff"))
    return m.select("match_id", F.row_number().over(S.W.orderBy("kickoff", "match_id")).cast("long").alias("place"))


@query("n36_requested_matches", with_actions("SELECT match_id, count(*) AS n FROM a WHERE match_id IN (SELECT DISTINCT match_id FROM a WHERE match_id IN (1, 2, 3, 5, 8, 13, 21) ORDER BY match_id LIMIT 4) GROUP BY match_id"))
def requested_matches(spark, d):
    """The first four of the requested matches."""
    return N.requested(lens.raw_actions(spark, d), "match_id", [1, 2, 3, 5, 8, 13, 21], 4).groupBy("match_id").agg(F.count("*").alias("n"))


@query("n39_home_team", with_actions(", t AS (SELECT match_id, min(tid) AS lo, max(tid) AS hi FROM (SELECT match_id, CASE WHEN object_id LIKE 'home\\_%' ESCAPE '\\' THEN (CASE WHEN match_id % 5 = 0 THEN 't' || (k % 2) ELSE 't' END) END AS tid FROM a) GROUP BY match_id) SELECT match_id, CASE WHEN lo = hi THEN lo END AS home_team_id FROM t"))
def home_team(spark, d):
    """The home team's id, if there is exactly one."""
    a = lens.raw_actions(spark, d)
    return N.home_team(a.withColumn("team_id", F.when(F.col("match_id") % 5 == 0, F.concat(F.lit("t"), (F.col("k") % 2).cast("string"))).otherwise("t")))


@query("r03_resolved_actions", with_actions(", h AS (SELECT match_id, k AS original_id, count(*) AS n, min(action_id) AS action_id FROM a GROUP BY ALL), r AS (SELECT DISTINCT match_id, (event_id % 100)::INTEGER AS original_id FROM a), q AS (SELECT r.*, coalesce(n, 0) AS n_found, h.action_id AS act FROM r LEFT JOIN h ON h.match_id = r.match_id AND h.original_id = r.original_id), s AS (SELECT q.*, CASE WHEN n_found = 0 THEN 'missing' WHEN n_found > 1 THEN 'ambiguous' WHEN act % 3 <> 0 THEN 'found' ELSE 'not modelled' END AS status FROM q) SELECT match_id, original_id, n_found, status, CASE WHEN status = 'found' THEN act END AS action_id FROM s"))
def resolved_actions(spark, d):
    """What requested ids stand for."""
    a = lens.actions(spark, d).withColumn("original_id", F.col("k"))
    wanted = a.select("match_id", (F.col("event_id") % 100).cast("int").alias("original_id")).distinct()
    return N.resolved(wanted, a, a.where(F.col("action_id") % 3 != 0), "original_id")


KINDS = ("pass", "offside_pass", "free_kick", "corner", "goal_kick", "goal_attempt", "attempted_tackle", "ball_touch", "save", "claim", "punch", "keeper_pick-up", "keeper_sweeper", "take_on", "aerial", "throw_in", "other")


@query(
    "n11_second_provider_types",
    with_actions(
        f""", v AS (SELECT *, (['{"', '".join(KINDS)}'])[k % 17 + 1] AS kind, CASE WHEN k % 3 <> 0 THEN 'x' END AS fkt, k % 5 = 0 AS crs, k % 7 = 0 AS pen, CASE WHEN event_id % 4 = 0 THEN 0.1::DOUBLE END AS xg, CASE WHEN event_id % 6 = 0 THEN 'goal_keeper' ELSE 'x' END AS pos,
   CASE WHEN event_id % 3 = 0 THEN 52.0::DOUBLE ELSE start_x END AS sx, CASE WHEN event_id % 3 = 0 THEN 34.0::DOUBLE ELSE start_y END AS sy FROM a)
, t AS (SELECT *, abs(sx - 52.5) <= 3 AND abs(sy - 34) <= 3 AS mid, CASE WHEN kind IN ('throw_in', 'take_on') THEN kind WHEN kind = 'keeper_sweeper' THEN (CASE WHEN coalesce(lead(pos) OVER w = 'goal_keeper', false) THEN 'keeper_sweeper' ELSE 'clearance' END)
   WHEN kind = 'keeper_pick-up' THEN 'keeper_pick_up' WHEN kind = 'punch' THEN 'keeper_punch' WHEN kind = 'claim' THEN 'keeper_claim' WHEN kind = 'save' THEN (CASE WHEN pos = 'goal_keeper' THEN 'keeper_save' ELSE 'shot_block' END) WHEN kind = 'ball_touch' THEN 'bad_touch'
   WHEN kind = 'attempted_tackle' THEN 'tackle' WHEN kind = 'free_kick' AND fkt IS NOT NULL AND xg IS NOT NULL THEN 'shot_freekick' WHEN kind = 'goal_attempt' THEN (CASE WHEN pen THEN 'shot_penalty' ELSE 'shot' END) WHEN kind = 'goal_kick' THEN 'goalkick'
   WHEN kind = 'corner' THEN (CASE WHEN crs THEN 'corner_crossed' ELSE 'corner_short' END) WHEN kind = 'free_kick' AND fkt IS NOT NULL THEN (CASE WHEN crs THEN 'freekick_crossed' ELSE 'freekick_short' END) WHEN kind = 'free_kick' THEN 'foul' WHEN kind LIKE '%pass%' THEN (CASE WHEN crs THEN 'cross' ELSE 'pass' END) END AS st
   FROM v WINDOW w AS (PARTITION BY match_id ORDER BY ts, action_id))
SELECT event_id, st AS spadl_type, CASE WHEN kind = 'attempted_tackle' THEN false WHEN st IN ('shot', 'shot_freekick', 'shot_penalty') THEN (coalesce(lead(period_id) OVER w = period_id AND lead(mid) OVER w, false)
   OR (st <> 'shot_penalty' AND coalesce(lead(kind) OVER w = 'attempted_tackle' AND lead(period_id, 2) OVER w = period_id AND lead(mid, 2) OVER w, false))) WHEN kind = 'offside_pass' THEN false ELSE success END AS success, kind = 'offside_pass' AS "offside",
   coalesce(lag(kind) OVER w = 'aerial' AND lag(object_id) OVER w = object_id, false) AS aerial FROM t WINDOW w AS (PARTITION BY match_id ORDER BY ts, action_id)"""
    ),
)
def second_provider_types(spark, d):
    """Types of a second provider's events."""
    a = lens.actions(spark, d)
    n, k, near = F.col("event_id"), F.col("k"), F.col("event_id") % 3 == 0
    e = a.select(
        "match_id", "event_id", "ts", "action_id", "period_id", F.get(F.array(*map(F.lit, KINDS)), k % 17).alias("action_type"), F.when(k % 3 != 0, "x").alias("free_kick_type"), (k % 5 == 0).alias("cross"), (k % 7 == 0).alias("penalty"), F.col("success").alias("outcome"),
        F.when(n % 4 == 0, 0.1).alias("expected_goal"), F.when(near, 52.0).otherwise(F.col("start_x")).alias("start_x"), F.when(near, 34.0).otherwise(F.col("start_y")).alias("start_y"), F.col("object_id").alias("player_id"), F.when(n % 6 == 0, "goal_keeper").otherwise("x").alias("advanced_position"),
    )
    return N.second_provider_types(e).select("event_id", "spadl_type", "success", "offside", "aerial")


@query("n49_sync_input", with_actions("SELECT match_id, period_id, epoch_us(ts) AS utc_us, object_id AS player_id, spadl_type, success, action_id FROM a"))
def sync_input(spark, d):
    """What the synchroniser reads of events."""
    return N.sync_input(lens.actions(spark, d)).withColumn("utc_us", micros("utc_timestamp")).drop("utc_timestamp")


SPLIT = ", m AS (SELECT DISTINCT match_id, CASE WHEN match_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM a)"


@query("n51_fit_input", with_actions(SPLIT + " SELECT m.match_id, CASE WHEN split <> 'train' THEN 'not in the split' WHEN n IS NULL THEN 'no actions' ELSE 'used' END AS reason, CASE WHEN split = 'train' THEN n END AS n FROM m LEFT JOIN (SELECT match_id, count(*) AS n FROM a WHERE match_id % 7 <> 0 GROUP BY match_id) c ON c.match_id = m.match_id"))
def fit_input(spark, d):
    """Which training matches the value grid is fitted on, and with how many actions."""
    a = lens.raw_actions(spark, d)
    m = a.select("match_id", F.when(F.col("match_id") % 3 == 0, "test").otherwise("train").alias("split")).distinct()
    used, why = N.fit_input(a.where("match_id % 7 <> 0"), m)
    return why.join(used.groupBy("match_id").agg(F.count("*").alias("n")), "match_id", "left").select("match_id", "reason", "n")


RULES = ("frame_id", "period_id", "player_id", "z", "x", "y")


@query("v04_tracking_rules", with_actions("SELECT 'frame_id' AS rule, count(*) FILTER (WHERE action_id % 9 = 0) AS n FROM a UNION ALL SELECT 'period_id', count(*) FILTER (WHERE period_id = 2 AND k % 10 = 0) FROM a UNION ALL SELECT 'player_id', count(*) FILTER (WHERE event_id % 4 = 0) FROM a UNION ALL SELECT 'z', count(*) FILTER (WHERE event_id % 8 <> 1) FROM a UNION ALL SELECT 'x', 0 FROM a WHERE false UNION ALL SELECT 'x', count(*) FILTER (WHERE k = 3) FROM a UNION ALL SELECT 'y', 0"))
def tracking_rules(spark, d):
    """Rows that break the tracking table's rules, by rule."""
    a, n = lens.actions(spark, d), F.col("event_id")
    ball = n % 2 == 1
    t = a.select(
        F.when(F.col("action_id") % 9 == 0, F.lit(-1.0)).otherwise(F.col("frame_id").cast("double")).alias("frame_id"), F.when((F.col("period_id") == 2) & (F.col("k") % 10 == 0), 3).otherwise(F.col("period_id")).alias("period_id"),
        F.when(~ball & (n % 4 != 0), "p").alias("player_id"), ball.alias("ball"), F.when(n % 8 == 1, 1.0).otherwise(-1.0).alias("z"), F.when(F.col("k") != 3, 1.0).alias("x"), F.lit(1.0).alias("y"),
    )
    return V.violations(t, V.tracking_rules())


@query("v06_artifact_counts", with_actions("SELECT match_id, count(*) AS left_n, count(*) FILTER (WHERE event_id % 50 <> 0) AS right_n FROM a GROUP BY match_id HAVING count(*) <> count(*) FILTER (WHERE event_id % 50 <> 0)"))
def artifact_counts(spark, d):
    """Matches whose two artifacts have different numbers of rows."""
    a = lens.raw_actions(spark, d)
    return V.same_counts(a, a.where("event_id % 50 <> 0"), "match_id")


# components

PASSES = ", po AS (SELECT event_id, team || '_' || j AS option, ((event_id * 17 + j * 31) % 97 + 1) / 100.0::DOUBLE AS success_p, ((event_id * 13 + j * 7) % 89) / 1000.0::DOUBLE AS s_score, ((event_id * 11 + j * 5) % 83) / 1000.0::DOUBLE AS f_score, ((event_id * 7 + j * 3) % 79) / 1000.0::DOUBLE AS s_concede, ((event_id * 5 + j * 2) % 73) / 1000.0::DOUBLE AS f_concede FROM a, range(2, 12) t(j))"


def passes(a):
    n, j = F.col("event_id"), F.col("_j")
    share = lambda p, q, m, by, more=0: (((n * p + j * q) % m + more) / F.lit(float(by)))
    rows = a.select("event_id", "team", F.explode(F.sequence(F.lit(2), F.lit(11))).alias("_j"))
    return rows.select("event_id", F.concat_ws("_", "team", F.col("_j").cast("string")).alias("option"), share(17, 31, 97, 100, 1).alias("success_p"), share(13, 7, 89, 1000).alias("s_score"), share(11, 5, 83, 1000).alias("f_score"), share(7, 3, 79, 1000).alias("s_concede"), share(5, 2, 73, 1000).alias("f_concede"))


@query("c01_goal_success", with_actions(PASSES + "SELECT event_id, option, success_p FROM po UNION ALL SELECT event_id, team || '_goal', CASE WHEN k % 3 = 0 THEN k / 100.0::DOUBLE ELSE 0.0::DOUBLE END FROM a"))
def goal_success(spark, d):
    """Success of pass options and of the goal."""
    a = lens.raw_actions(spark, d)
    return C.with_goal_success(passes(a), a.where("k % 3 = 0").select("event_id", (F.col("k") / F.lit(100.0)).alias("shot_p")), "event_id")


@query("c02_goal_values", with_actions(PASSES + "SELECT event_id, option, s_score, f_score, s_concede, f_concede FROM po UNION ALL SELECT event_id, team || '_goal', k / 200.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM a"))
def goal_values(spark, d):
    """Values of pass options and of the goal."""
    a = lens.raw_actions(spark, d)
    return C.with_goal_values(passes(a), "event_id", a.select("event_id", (F.col("k") / F.lit(200.0)).alias("xg")))


SHOTS = ", b AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN 'corner_short' ELSE spadl_type END AS st, (event_id % 40) / 100.0::DOUBLE AS xg_0, (k % 30) / 100.0::DOUBLE AS xg_1, (event_id % 9) / 10.0::DOUBLE AS block_0, (k % 8) / 10.0::DOUBLE AS block_1, lead(expected_goal) OVER (PARTITION BY match_id ORDER BY action_id) AS nx FROM a)"


@query(
    "c03_shot_components",
    with_actions(
        SHOTS
        + f""", c AS (SELECT *, CASE WHEN xg_0 > 0.01 THEN block_0 END AS b0, CASE WHEN xg_1 > 0.01 THEN block_1 END AS b1 FROM b)
SELECT event_id, {R6.format('1 - b0')} AS shot_p_0, {R6.format("CASE WHEN st LIKE 'corner%' THEN 0.0::DOUBLE WHEN expected_goal IS NOT NULL THEN (least(expected_goal / (1 - coalesce(b0, 0)), 1.0::DOUBLE)) ELSE xg_0 END")} AS xg_0,
  {R6.format('1 - b1')} AS shot_p_1, {R6.format('CASE WHEN nx IS NOT NULL THEN least(nx / (1 - coalesce(b1, 0)), 1.0::DOUBLE) ELSE xg_1 END')} AS xg_1 FROM c"""
    ),
)
def shot_components(spark, d):
    """Blocks and expected goals of a shot before and after every action (c03 and c04)."""
    n, k = F.col("event_id"), F.col("k")
    a = lens.actions(spark, d).withColumns({"spadl_type": F.when(n % 10 == 0, "corner_short").otherwise(F.col("spadl_type")), "xg_0": (n % 40) / F.lit(100.0), "xg_1": (k % 30) / F.lit(100.0), "block_0": (n % 9) / F.lit(10.0), "block_1": (k % 8) / F.lit(10.0)})
    return C.shot_components(a).select("event_id", *[G.at_6(F.col(c)).alias(c) for c in ("shot_p_0", "xg_0", "shot_p_1", "xg_1")])


@query("c05_on_target", with_actions(f", o AS (SELECT event_id, team || '_goal' AS option, (event_id % 50) / 100.0::DOUBLE AS xg, (k % 10) / 10.0::DOUBLE AS save FROM a), q AS (SELECT *, xg + (1 - xg) * (1 - {SHOT_OUT_SHARE!r}::DOUBLE) * save AS sot FROM o) SELECT event_id, option, {R6.format('sot')} AS success_p, {R6.format('CASE WHEN sot <> 0 THEN xg / sot END')} AS s_score FROM q UNION ALL SELECT event_id, team || '_2', 0.5::DOUBLE, 0.25::DOUBLE FROM a"))
def on_target(spark, d):
    """The goal option as on target."""
    a = lens.raw_actions(spark, d).withColumn("keeper_id", F.concat(F.when(F.col("team") == "home", "away").otherwise("home"), F.lit("_1")))
    goal = F.concat("team", F.lit("_goal"))
    options = a.select("event_id", goal.alias("option"), ((F.col("event_id") % 50) / F.lit(100.0)).alias("success_p"), F.lit(1.0).alias("s_score")).union(a.select("event_id", F.concat("team", F.lit("_2")), F.lit(0.5), F.lit(0.25)))
    posteriors = a.select("event_id", goal.alias("option"), F.col("keeper_id").alias("defender"), ((F.col("k") % 10) / F.lit(10.0)).alias("posterior"))
    return C.on_target(options, a, posteriors, "event_id").select("event_id", "option", G.at_6(F.col("success_p")).alias("success_p"), G.at_6(F.col("s_score")).alias("s_score"))


@query("c11_credit_rules", with_actions(", n AS (SELECT *, lead(spadl_type) OVER (PARTITION BY match_id, period_id ORDER BY action_id) AS nt FROM a) SELECT event_id, CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN 'none' WHEN coalesce(nt = 'foul', false) THEN 'foul' WHEN spadl_type = 'shot' THEN 'shot' ELSE 'pass' END AS rule FROM n"))
def credit_rules(spark, d):
    """Which rule gives credits for each action."""
    a = S.next_action(lens.actions(spark, d))
    a = a.withColumns({"anomaly": F.when(F.col("event_id") % 17 == 0, True), "action_type": F.when(F.col("spadl_type") == "shot", "shot").otherwise("pass"), "spadl_type": F.when(F.col("event_id") % 19 == 0, "own_goal").otherwise(F.col("spadl_type"))})
    return a.select("event_id", C.credit_rule().alias("rule"))


@query("c13_snapshot_values", with_actions(PASSES + f"SELECT event_id, option, {R6.format('s_score - s_concede')} AS s_value, {R6.format('f_score - f_concede')} AS f_value, {R6.format('success_p * (s_score - s_concede) + (1 - success_p) * (f_score - f_concede)')} AS option_value, {R6.format('(s_score - s_concede) - (f_score - f_concede)')} AS advantage FROM po WHERE option NOT LIKE '%\\_5' ESCAPE '\\'"))
def snapshot_values(spark, d):
    """Values of every option at a snapshot."""
    a = lens.spread(lens.raw_actions(spark, d))
    p = passes(a).withColumn("select_p", F.lit(0.1))
    there = a.select("event_id", F.explode(F.sequence(F.lit(2), F.lit(11))).alias("_j"), "team").where("_j <> 5").select("event_id", F.concat_ws("_", "team", F.col("_j").cast("string")).alias("option"))
    out = C.snapshot_values(p, "event_id", there)
    return out.select("event_id", "option", *[G.at_6(F.col(c)).alias(c) for c in ("s_value", "f_value", "option_value", "advantage")])


def arrays(spark, d):
    return G.held(lens.spread(lens.raw_actions(spark, d)), players=lens.players())


@query("g20_active_players", with_actions("SELECT s.event_id, (s.team <> a.team)::INTEGER AS side, (row_number() OVER (PARTITION BY s.event_id, s.team <> a.team ORDER BY ordinal) - 1)::INTEGER AS place, s.object_id FROM s JOIN a ON a.event_id = s.event_id", True))
def active_players(spark, d):
    """Objects of every snapshot, the owner's team first."""
    return C.active_players(arrays(spark, d), "event_id", "team")


@query("g09_graph_table", with_actions("SELECT event_id, CASE WHEN event_id % 23 <> 0 THEN 24 END::INTEGER AS n_nodes, CASE WHEN event_id % 23 <> 0 THEN 576 END::INTEGER AS n_edges FROM a"))
def graph_table(spark, d):
    """One graph per action, nothing where the possessor isn't there."""
    s = arrays(spark, d)
    s = s.withColumn("object_id", F.when(F.col("event_id") % 23 == 0, "nobody").otherwise(F.col("object_id")))
    return C.graph_table(lens.raw_actions(spark, d), s, "event_id")


@query("g14_tabular_flags", with_actions(", t AS (SELECT *, coalesce(frame_id < lag(receive_frame_id) OVER (PARTITION BY match_id ORDER BY action_id) + 3, false)::INT::DOUBLE AS one_touch FROM a) SELECT event_id, one_touch, (spadl_type = 'goalkick')::INT::DOUBLE AS set_piece, start_x AS f FROM t"))
def tabular_flags(spark, d):
    """A table row per action with its flags."""
    a = lens.actions(spark, d)
    return C.tabular_set(a.select("event_id", F.col("start_x").alias("f")), a.withColumn("_touch", S.one_touch()), "event_id", F.col("_touch"))


@query("g15_graph_rows", with_actions(", r AS (SELECT a.event_id, s.ordinal, s.object_id = a.object_id AS me, s.x, s.y, (a.k % 30)::INTEGER AS want FROM s JOIN a ON a.event_id = s.event_id) SELECT event_id, coalesce(max(x) FILTER (WHERE me), -1) AS poss_x, coalesce(max(y) FILTER (WHERE me), -1) AS poss_y, coalesce(max(x) FILTER (WHERE ordinal = want + 1), -1) AS intent_x, coalesce(max(y) FILTER (WHERE ordinal = want + 1), -1) AS intent_y FROM r GROUP BY event_id", True))
def graph_rows(spark, d):
    """Possessor and intent node of each graph in a row."""
    s = arrays(spark, d)
    nodes = F.transform("players", lambda n: F.struct(n["ordinal"].alias("ordinal"), (n["object_id"] == F.col("object_id")).cast("double").alias("possessor"), n["x"].alias("x"), n["y"].alias("y")))
    s = G.held(s.withColumn("intent_index", (F.col("k") % 30).cast("int")), nodes=nodes)
    return C.graph_to_table("nodes", s, "event_id", ["x", "y"])


@query("m17_position_error", with_actions(f"SELECT spadl_type, {R6.format('avg(sqrt((start_x - end_x) * (start_x - end_x) + (start_y - end_y) * (start_y - end_y)))')} AS error, count(*) AS n FROM a GROUP BY spadl_type"))
def position_error(spark, d):
    """Mean distance of predicted from true places."""
    a = lens.raw_actions(spark, d).select("spadl_type", F.col("start_x").alias("x"), F.col("start_y").alias("y"), F.col("end_x").alias("true_x"), F.col("end_y").alias("true_y"))
    return C.position_error(a, ["spadl_type"]).withColumn("error", G.at_6(F.col("error")))


@query("m18_sorted_options", with_actions(", l AS (SELECT event_id, 'o' || j AS option, ((event_id * 7 + j * 13) % 101) / 100.0::DOUBLE AS p FROM a, range(1, 6) t(j) WHERE (event_id + j) % 4 <> 0) SELECT event_id, option, p, row_number() OVER (PARTITION BY event_id ORDER BY p DESC, option)::INTEGER AS place FROM l"))
def sorted_options(spark, d):
    """A wide row's probabilities, best first."""
    n = F.col("event_id")
    wide = lens.raw_actions(spark, d).select("event_id", *[F.when((n + j) % 4 != 0, ((n * 7 + j * 13) % 101) / F.lit(100.0)).alias(f"o{j}") for j in range(1, 6)])
    return C.sorted_options(wide, ["event_id"], [f"o{j}" for j in range(1, 6)])
