"""Queries of tracking views, feature masks, targets, validation and match sets, each with its DuckDB twin; tracking is the lens's actions by frame."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vocab
from ..operators import baseline_sync as B
from ..operators import features as X
from ..operators import labels as L
from ..operators import sequence as S
from ..operators import sync as Y
from ..operators import tracking as T
from ..operators import validate as V
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


def places(a):
    """One place per match, frame and object: that of the first event."""
    return a.groupBy("match_id", "frame_id", "object_id").agg(F.min_by("start_x", "event_id").alias("x"), F.min_by("start_y", "event_id").alias("y"), F.min("period_id").alias("period_id"), F.min("event_id").alias("event_id"))


PLACES = ", tr AS MATERIALIZED (SELECT match_id, frame_id, object_id, arg_min(start_x, event_id) AS x, arg_min(start_y, event_id) AS y, min(period_id) AS period_id, min(event_id) AS event_id FROM a GROUP BY ALL)"


@query(
    "g21_home_left",
    with_actions(
        PLACES
        + """, m AS (SELECT match_id, period_id, object_id, avg(x) AS mx FROM tr GROUP BY ALL), h AS (SELECT match_id, period_id, arg_min(object_id, (mx, object_id)) LIKE 'home%' AS hl FROM m GROUP BY ALL)
SELECT event_id, CASE WHEN hl THEN x ELSE 105.0::DOUBLE - x END AS x, CASE WHEN hl THEN y ELSE 68.0::DOUBLE - y END AS y FROM tr JOIN h ON h.match_id = tr.match_id AND h.period_id = tr.period_id"""
    ),
)
def home_left(spark, d):
    """Every period with the home team on the left (g21 and g22)."""
    return T.home_left(places(lens.actions(spark, d))).select("event_id", "x", "y")


@query(
    "n34_frozen_carrier",
    with_actions(
        PLACES
        + """, an AS (SELECT match_id, arg_min(frame_id, event_id) AS anchor, arg_min(object_id, event_id) AS carrier FROM tr GROUP BY match_id), h AS (SELECT tr.match_id, object_id, x, y FROM tr JOIN an ON an.match_id = tr.match_id AND frame_id = anchor AND object_id = carrier)
SELECT event_id, CASE WHEN frame_id > anchor AND h.x IS NOT NULL THEN h.x ELSE tr.x END AS x, CASE WHEN frame_id > anchor AND h.x IS NOT NULL THEN h.y ELSE tr.y END AS y FROM tr JOIN an ON an.match_id = tr.match_id LEFT JOIN h ON h.match_id = tr.match_id AND h.object_id = tr.object_id"""
    ),
)
def frozen_carrier(spark, d):
    """The carrier stays where it was at the receipt."""
    t = places(lens.actions(spark, d)).withColumnRenamed("match_id", "situation_id")
    anchors = t.groupBy("situation_id").agg(F.min_by("frame_id", "event_id").alias("anchor_frame"), F.min_by("object_id", "event_id").alias("carrier_id"))
    return T.frozen(t, anchors).select("event_id", "x", "y")


@query("n34_anchor_faults", with_actions("SELECT match_id AS situation_id, count(*) AS n FROM a WHERE k = 7 GROUP BY match_id HAVING count(*) <> 1"))
def anchor_faults(spark, d):
    """Situations without exactly one receipt."""
    return T.anchor_faults(lens.raw_actions(spark, d).where("k = 7").withColumnRenamed("match_id", "situation_id"))


@query(
    "n32_possession_view",
    with_actions(
        PLACES
        + """, p AS (SELECT match_id, event_id AS possession_id, team, event_id % 4 = 0 AS rtl, frame_id - 1 AS fa, frame_id + 200000 AS fb FROM a WHERE k % 10 = 0)
SELECT p.possession_id, tr.event_id, (CASE WHEN tr.object_id[1:4] = p.team THEN 'home' ELSE 'away' END) || tr.object_id[5:] AS object_id, CASE WHEN rtl THEN 105.0::DOUBLE - x ELSE x END AS x, CASE WHEN rtl THEN 68.0::DOUBLE - y ELSE y END AS y, frame_id > fa AS has_ball
FROM tr JOIN p ON p.match_id = tr.match_id AND frame_id BETWEEN fa AND fb"""
    ),
)
def possession_view(spark, d):
    """Frames of possessions, turned and renamed to the side that has the ball."""
    a = lens.actions(spark, d)
    p = a.where("k % 10 = 0").select("match_id", F.col("event_id").alias("possession_id"), "team", (F.col("event_id") % 4 == 0).alias("right_to_left"), F.col("frame_id").alias("frame_start"), (F.col("frame_id") + 200000).alias("frame_end"))
    return T.possession_view(places(a), p, 200000).select("possession_id", "event_id", "object_id", "x", "y", "has_ball")


@query("n46_goal_objects", with_actions(", f AS (SELECT DISTINCT match_id, frame_id FROM a) SELECT match_id, frame_id, 'home_goal' AS object_id, 105.0::DOUBLE AS x, 34.0::DOUBLE AS y FROM f UNION ALL SELECT match_id, frame_id, 'away_goal', 0.0::DOUBLE, 34.0::DOUBLE FROM f"))
def goal_objects(spark, d):
    """Two goals in every frame."""
    return T.goals(lens.actions(spark, d).select("match_id", "frame_id").distinct())


@query(
    "n47_frame_actions",
    with_actions(
        """, f AS (SELECT match_id, frame_id, min(event_id) AS n FROM a GROUP BY ALL), p AS (SELECT match_id, frame_id, arg_min(object_id, event_id) AS possessor, arg_min(CASE WHEN k % 4 <> 0 THEN start_x END, CASE WHEN k % 4 <> 0 THEN event_id END) AS poss_x FROM a WHERE k % 5 <> 0 GROUP BY ALL)
, r AS (SELECT f.*, possessor, CASE WHEN n % 6 = 0 THEN 'no_ball' WHEN possessor IS NULL THEN 'no_possessor' WHEN poss_x IS NULL THEN 'no_snapshot' ELSE 'kept' END AS reason FROM f LEFT JOIN p ON p.match_id = f.match_id AND p.frame_id = f.frame_id)
SELECT match_id, frame_id, reason, CASE WHEN reason = 'kept' THEN (sum(CASE WHEN reason = 'kept' THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame_id) - 1)::BIGINT END AS action_id, possessor AS receiver_id FROM r"""
    ),
)
def frame_actions(spark, d):
    """Frames as passes to oneself, and why some can't be."""
    a = lens.actions(spark, d)
    frames = a.groupBy("match_id", "frame_id").agg(F.min("event_id").alias("n")).select("match_id", "frame_id", F.when(F.col("n") % 6 != 0, 1.0).alias("ball_x"))
    seen = F.col("k") % 4 != 0
    p = a.where("k % 5 <> 0").groupBy("match_id", "frame_id").agg(F.min_by("object_id", "event_id").alias("possessor"), F.min_by(F.when(seen, F.col("start_x")), F.when(seen, F.col("event_id"))).alias("poss_x"))
    return T.frame_actions(frames, p).select("match_id", "frame_id", "reason", "action_id", "receiver_id")


@query("g12_masked_features", with_actions("SELECT event_id, 0.0::DOUBLE AS start_x, start_y, 0.0::DOUBLE AS end_x FROM a"))
def masked_features(spark, d):
    """Features that a model without them sees as zeros."""
    return X.masked(lens.raw_actions(spark, d).select("event_id", "start_x", "start_y", "end_x"), ["start_x", "end_x"], True)


@query("l03_outcome_targets", with_actions(RETURNS + f"SELECT match_id, action_id, scores AS scored_goals, concedes AS conceded_goals, {R6.format('scores_xg')} AS scored_xg, {R6.format('concedes_xg')} AS conceded_xg FROM r"))
def outcome_targets(spark, d):
    """Targets of the goal and the xG families."""
    r = S.future_returns(lens.actions(spark, d)).withColumns({"scores_xt": F.lit(0.0), "concedes_xt": F.lit(0.0)})
    (a, b), (x, y) = L.outcome_targets("goals"), L.outcome_targets("xg")
    return r.select("match_id", "action_id", a.alias("scored_goals"), b.alias("conceded_goals"), G.at_6(x).alias("scored_xg"), G.at_6(y).alias("conceded_xg"))


@query("v02_baseline_rules", with_actions("SELECT 'period_id' AS rule, 0 AS n UNION ALL SELECT 'ts', 0 UNION ALL SELECT 'spadl_type', count(*) FILTER (WHERE k = 1) FROM a UNION ALL SELECT 'success', count(*) FILTER (WHERE k = 2) FROM a UNION ALL SELECT 'start_x', count(*) FILTER (WHERE start_x + k > 105) FROM a UNION ALL SELECT 'start_y', count(*) FILTER (WHERE start_y - k < 0) FROM a UNION ALL SELECT 'player_id', count(*) FILTER (WHERE k = 4) FROM a"))
def baseline_rules(spark, d):
    """Rows that break the baseline synchroniser's input rules."""
    k = F.col("k")
    a = lens.raw_actions(spark, d).withColumns({"spadl_type": F.when(k == 1, "x").otherwise(F.col("spadl_type")), "success": F.when(k != 2, F.col("success")), "start_x": F.col("start_x") + k, "start_y": F.col("start_y") - k, "player_id": F.when(k != 4, F.col("object_id"))})
    return V.violations(a, V.baseline_rules())


@query("v03_synced_rules", with_actions("SELECT 'period_id' AS rule, 0 AS n UNION ALL SELECT 'ts', 0 UNION ALL SELECT 'frame_id', count(*) FILTER (WHERE k % 3 = 1) FROM a UNION ALL SELECT 'player_id', count(*) FILTER (WHERE k = 4) FROM a UNION ALL SELECT 'spadl_type', 0 UNION ALL SELECT 'success', 0"))
def synced_rules(spark, d):
    """Rows that break the synced table's rules."""
    k = F.col("k")
    frame = F.when(k % 3 == 0, F.lit(None).cast("double")).when(k % 3 == 1, F.col("frame_id") + 0.5).otherwise(F.col("frame_id").cast("double"))
    return V.violations(lens.actions(spark, d).withColumns({"frame_id": frame, "player_id": F.when(k != 4, F.col("object_id"))}), V.synced_rules())


@query("n53_match_splits", with_actions(", m AS (SELECT match_id, min(ts) AS t, count(*) AS n FROM a GROUP BY match_id) SELECT CASE WHEN match_id % 3 = 0 THEN 'test' WHEN match_id % 3 = 1 THEN 'train' ELSE 'valid' END AS split, count(*) AS matches, epoch_us(min(t)) AS first_us, sum(n)::BIGINT AS actions FROM m GROUP BY ALL"))
def match_splits(spark, d):
    """Metadata of the matches of each split."""
    m = lens.raw_actions(spark, d).groupBy("match_id").agg(F.min("ts").alias("t"), F.count("*").alias("n"))
    split = F.when(F.col("match_id") % 3 == 0, "test").when(F.col("match_id") % 3 == 1, "train").otherwise("valid")
    return m.groupBy(split.alias("split")).agg(F.count("*").alias("matches"), F.unix_micros(F.min("t").cast("timestamp")).alias("first_us"), F.sum("n").alias("actions"))


@query("j09_frame_join", with_actions(PLACES + " SELECT a.event_id, tr.object_id, tr.x FROM a JOIN tr ON tr.match_id = a.match_id AND tr.frame_id = a.frame_id WHERE spadl_type = 'pass' AND tr.x > 50"))
def frame_join(spark, d):
    """Objects beyond the centre at the frame of each pass: filtered before the join."""
    a = lens.actions(spark, d)
    return a.where("spadl_type = 'pass'").select("event_id", "match_id", "frame_id").join(places(a).where("x > 50").select("match_id", "frame_id", "object_id", "x"), ["match_id", "frame_id"]).select("event_id", "object_id", "x")


@query("j15_keyed_assignment", with_actions("SELECT event_id, start_x, CASE WHEN event_id % 3 <> 0 THEN k END AS k2 FROM a"))
def keyed_assignment(spark, d):
    """A column assigned by key where row order would do it elsewhere; rows without a value get none."""
    a = lens.raw_actions(spark, d)
    return a.select("event_id", "start_x").join(a.where("event_id % 3 <> 0").select("event_id", F.col("k").alias("k2")), "event_id", "left")


@query("s08_reoriented_events", with_actions(f"SELECT event_id, {R6.format('(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * (start_x - 52.5::DOUBLE)')} AS x, {R6.format('(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * (start_y - 34.0::DOUBLE)')} AS y FROM a"))
def reoriented_events(spark, d):
    """Places from the centre, each team attacking to the right."""
    a = lens.raw_actions(spark, d)
    side = F.when(F.col("team") == "home", 1.0).otherwise(-1.0)
    return a.select("event_id", G.at_6(side * (F.col("start_x") - 52.5)).alias("x"), G.at_6(side * (F.col("start_y") - 34.0)).alias("y"))


PLAYED = """, ev AS MATERIALIZED (SELECT match_id, period_id, action_id, team || '_' || (k % 2 + 1) AS object_id, CASE k % 6 WHEN 1 THEN 'interception' WHEN 2 THEN 'bad_touch' WHEN 3 THEN 'take_on' ELSE spadl_type END AS spadl_type,
  50.0::DOUBLE + (event_id % 11) * 0.5::DOUBLE AS start_x, 32.0::DOUBLE + (event_id % 7) * 0.5::DOUBLE AS start_y, (action_id * 20 + event_id % 13) / 10.0::DOUBLE AS utc FROM a)
, fr AS MATERIALIZED (SELECT match_id AS m, period_id AS p, action_id * 10 + i AS f, (action_id * 10 + i) / 5.0::DOUBLE AS fu FROM a, range(10) t(i))
, ba AS MATERIALIZED (SELECT m, f, 50.0::DOUBLE + ((f * 7 + m) % 11) * 0.5::DOUBLE AS bx, 32.0::DOUBLE + ((f * 3 + m) % 7) * 0.5::DOUBLE AS b_y, f % 5 AS bz, (f * 3 + m) % 9 - 4 AS ac FROM fr)
, pl AS MATERIALIZED (SELECT m, p, f, fu, (CASE WHEN j < 3 THEN 'home' ELSE 'away' END) || '_' || ((j - 1) % 2 + 1) AS o, 50.0::DOUBLE + ((f * 5 + m + j * 3) % 13) * 0.5::DOUBLE + CASE WHEN j % 2 = 0 AND m % 2 = 0 THEN 8 ELSE 0 END AS px, 31.0::DOUBLE + ((f * 2 + m + j) % 9) * 0.5::DOUBLE AS py FROM fr, range(1, 5) t(j))
"""


def played(spark, d):
    """Events at two seconds' distance, and tracking of a ball and four players at five frames a second, drawn from the lens's actions."""
    a = lens.actions(spark, d)
    k, n, m, f = F.col("k") % 6, F.col("event_id"), F.col("match_id"), F.col("frame_id")
    half = F.lit(0.5)
    kind = F.when(k == 1, "interception").when(k == 2, "bad_touch").when(k == 3, "take_on").otherwise(F.col("spadl_type"))
    events = a.select(
        "match_id", "period_id", "action_id", F.concat_ws("_", "team", (F.col("k") % 2 + 1).cast("string")).alias("object_id"), kind.alias("spadl_type"),
        (F.lit(50.0) + (n % 11) * half).alias("start_x"), (F.lit(32.0) + (n % 7) * half).alias("start_y"), ((F.col("action_id") * 20 + n % 13) / F.lit(10.0)).alias("utc"),
    )
    frames = a.select("match_id", "period_id", F.explode(F.sequence(F.col("action_id") * 10, F.col("action_id") * 10 + 9)).alias("frame_id"))

    def spot(name, x, y, z, accel):
        return F.struct(F.lit(name).alias("object_id"), x.alias("x"), y.alias("y"), z.cast("double").alias("z"), accel.cast("double").alias("accel"))

    ball = spot("ball", F.lit(50.0) + ((f * 7 + m) % 11) * half, F.lit(32.0) + ((f * 3 + m) % 7) * half, f % 5, (f * 3 + m) % 9 - 4)
    away = F.when(m % 2 == 0, 8.0).otherwise(0.0)
    players = [
        spot(f"{'home' if j < 3 else 'away'}_{(j - 1) % 2 + 1}", F.lit(50.0) + ((f * 5 + m + j * 3) % 13) * half + (away if j % 2 == 0 else F.lit(0.0)), F.lit(31.0) + ((f * 2 + m + j) % 9) * half, F.lit(0.0), F.lit(0.0)) for j in range(1, 5)
    ]
    return events, frames.select("match_id", "period_id", "frame_id", (f / F.lit(5.0)).alias("utc"), F.inline(F.array(ball, *players)))


def pairs(events: str, seconds: str, mask: str) -> str:
    """SQL of the frames that may be those of ``events``: the nearest frame by clock, then its window."""
    far = f"{B.FAR!r}::DOUBLE"
    part = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({far} - {c}) / {far}))"
    total = " + ".join(part.format(far=far, c=c) for c in ("pb", "pe", "be"))
    return f"""SELECT match_id, period_id, action_id, f, fu, ({total}) * {100 / 3!r}::DOUBLE AS score FROM (
  SELECT e.*, pl.f, pl.fu, bz, ac, sqrt((px - bx) * (px - bx) + (py - b_y) * (py - b_y)) AS pb, sqrt((px - start_x) * (px - start_x) + (py - start_y) * (py - start_y)) AS pe, sqrt((bx - start_x) * (bx - start_x) + (b_y - start_y) * (b_y - start_y)) AS be
  FROM (SELECT e.match_id, e.period_id, action_id, object_id, spadl_type, start_x, start_y, {seconds} AS sec, arg_min(fr.f, (abs(e.utc - fu), fr.f)) AS near FROM {events} e JOIN fr ON fr.m = e.match_id GROUP BY ALL) e
  JOIN pl ON pl.m = e.match_id AND pl.o = e.object_id AND pl.f BETWEEN near - 5 * sec + 1 AND near + 5 * sec - 1 JOIN ba ON ba.m = pl.m AND ba.f = pl.f) WHERE {mask}"""


SECONDS = "CASE WHEN spadl_type IN ('pass', 'cross', 'shot', 'interception') THEN 10 WHEN spadl_type = 'goalkick' THEN 15 WHEN spadl_type IN ('bad_touch', 'foul') THEN 5 ELSE 0 END"
LOOSE = "CASE WHEN spadl_type IN ('pass', 'cross', 'shot', 'goalkick') THEN pb <= 2.5 AND bz <= 3 AND ac >= -1 WHEN spadl_type = 'interception' THEN pb <= 2 AND bz <= 3 AND ac <= 1 WHEN spadl_type = 'bad_touch' THEN pb <= 3 AND bz <= 3 WHEN spadl_type = 'foul' THEN pb <= 3 AND bz <= 4 ELSE false END"
BASELINE = (
    PLAYED
    + """
, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY match_id, period_id ORDER BY action_id) AS rn FROM ev), e1 AS (SELECT * FROM r WHERE rn = 1), st AS (SELECT m, p, min(f) AS f0 FROM fr GROUP BY ALL)
, cr AS (SELECT pl.m, pl.p, count(*) AS n FROM pl JOIN st ON st.m = pl.m AND st.p = pl.p AND st.f0 = pl.f JOIN e1 ON e1.match_id = pl.m AND e1.period_id = pl.p AND e1.object_id[1:4] = pl.o[1:4] WHERE abs(px - 52.5) <= 5 AND abs(py - 34) <= 5 GROUP BY ALL)
, run AS (SELECT * FROM (SELECT *, min(g) OVER (PARTITION BY m, p) AS g0 FROM (SELECT fr.m, fr.p, fr.f, bx, b_y, ac, fr.f - row_number() OVER (PARTITION BY fr.m, fr.p ORDER BY fr.f) AS g FROM fr JOIN st ON st.m = fr.m AND st.p = fr.p AND fr.f BETWEEN f0 AND f0 + 24 JOIN ba ON ba.m = fr.m AND ba.f = fr.f WHERE abs(bx - 52.5) <= 3 AND abs(b_y - 34) <= 3)) WHERE g = g0)
, kg AS (SELECT run.*, fu, sqrt((px - bx) * (px - bx) + (py - b_y) * (py - b_y)) AS gap FROM run JOIN e1 ON e1.match_id = m AND e1.period_id = p AND spadl_type = 'pass' JOIN pl ON pl.m = run.m AND pl.f = run.f AND pl.p = run.p AND pl.o = e1.object_id)
, kick AS (SELECT kg.m, kg.p, arg_min(f, (gap >= 2, CASE WHEN gap < 2 THEN -ac ELSE gap END, f)) AS kf, arg_min(fu, (gap >= 2, CASE WHEN gap < 2 THEN -ac ELSE gap END, f)) AS ku FROM kg LEFT JOIN cr ON cr.m = kg.m AND cr.p = kg.p WHERE coalesce(n, 0) <= 1 GROUP BY ALL)
, e2 AS (SELECT r.* FROM r LEFT JOIN kick ON kick.m = match_id AND kick.p = period_id WHERE rn = 2 AND kf IS NULL)
, g2 AS (SELECT match_id, period_id, arg_min(fu, (-score, f)) AS gu FROM ("""
    + pairs("e2", "5", "pb <= 2.5 AND bz <= 3 AND ac >= -1")
    + """) GROUP BY ALL)
, off AS (SELECT r.match_id, r.period_id, max(CASE WHEN kf IS NOT NULL AND rn = 1 THEN utc - ku WHEN kf IS NULL AND rn = 2 THEN utc - gu END) AS shift FROM r LEFT JOIN kick ON kick.m = r.match_id AND kick.p = r.period_id LEFT JOIN g2 ON g2.match_id = r.match_id AND g2.period_id = r.period_id GROUP BY ALL)
, em AS MATERIALIZED (SELECT r.* REPLACE (utc - coalesce(shift, 0.0::DOUBLE) AS utc) FROM r JOIN off ON off.match_id = r.match_id AND off.period_id = r.period_id WHERE rn > 1)
, op AS MATERIALIZED (SELECT c.*, rn FROM ("""
    + pairs("em", SECONDS, LOOSE)
    + """) c JOIN r ON r.match_id = c.match_id AND r.action_id = c.action_id)
, turn AS (SELECT e1.match_id, e1.period_id, 1::BIGINT AS rn, coalesce(kf, f0) AS last, coalesce(kf, f0) AS frame_id FROM e1 JOIN st ON st.m = match_id AND st.p = period_id LEFT JOIN kick ON kick.m = match_id AND kick.p = period_id
  UNION ALL SELECT t.match_id, t.period_id, r.rn, coalesce(arg_min(op.f, (-score, op.f)), t.last), arg_min(op.f, (-score, op.f)) FROM turn t JOIN r ON r.match_id = t.match_id AND r.period_id = t.period_id AND r.rn = t.rn + 1
    LEFT JOIN op ON op.match_id = r.match_id AND op.period_id = r.period_id AND op.rn = r.rn AND op.f >= t.last GROUP BY t.match_id, t.period_id, r.rn, t.last)
SELECT turn.match_id, turn.period_id, action_id, frame_id FROM turn JOIN r ON r.match_id = turn.match_id AND r.period_id = turn.period_id AND r.rn = turn.rn"""
)


@query("y17_baseline_frames", with_actions(BASELINE).replace("WITH a AS", "WITH RECURSIVE a AS", 1))
def baseline_frames(spark, d):
    """Frames of all events by the baseline synchroniser."""
    return B.synced(*played(spark, d), fps=5)


#: Frames a second, frames between actions, and players a side of the drawn matches.
RATE, APART, SIDE = 5, 20, 3


def drawn(spark, d):
    """Every action of the table, of all types in turn, and the tracking of its match drawn from it: the ball goes from action to action, whoever acts is at it, with an opponent
    beside duels; play rests before restarts.  The event clock runs three seconds fast and is noisy."""
    a, by = lens.actions(spark, d, dealt=True), W.partitionBy("match_id").orderBy("action_id")
    types = F.array(*map(F.lit, vocab.ACTION_TYPES))
    first = (F.lag("period_id").over(by).isNull()) | (F.lag("period_id").over(by) != F.col("period_id"))
    a = a.withColumn("first", first).withColumns(
        {
            "kind": F.when(F.col("first"), "pass").otherwise(F.element_at(types, ((F.col("k") + F.col("action_id")) % len(vocab.ACTION_TYPES)).cast("int") + 1)),
            "who": F.concat_ws("_", "team", (F.col("k") % SIDE + 1).cast("string")), "px": F.when(F.col("first"), vocab.PITCH_X / 2).otherwise(F.col("start_x")), "py": F.when(F.col("first"), vocab.PITCH_Y / 2).otherwise(F.col("start_y")),
            "at": F.col("action_id") * APART + 10,
        }
    )
    duel = F.col("kind").isin("tackle", "take_on", "second_take_on", "dispossessed")
    before = F.lag("who").over(by)
    other = F.when(F.col("team") == "home", "away").otherwise("home")
    beside = F.when(duel & (F.substring(before, 1, 4) == other), before).when(duel, F.concat_ws("_", other, (F.col("k") % SIDE + 1).cast("string")))
    spot = F.struct("who", "px", "py", beside.alias("beside"), F.col("event_id").alias("n"))
    a = a.withColumn("here", spot).withColumns({"there": F.lead("here").over(by), "next_kind": F.lead("kind").over(by)})
    events = a.select("match_id", "period_id", "action_id", F.col("kind").alias("spadl_type"), F.col("who").alias("object_id"), "success", (F.col("at") / F.lit(float(RATE)) + 1003 + (F.col("event_id") % 5 - 2) * 0.2).alias("utc"))
    # legs are unfolded where their match is, so that the synchroniser finds its tracking there
    leg = a.select("match_id", "period_id", "event_id", "at", "here", F.coalesce("there", "here").alias("there"), F.coalesce(F.col("next_kind").isin(*vocab.RESTARTS), F.lit(False)).alias("rest"))

    def place(who, s, axis):
        j, n = F.element_at(F.split(who, "_"), 2).cast("int") + F.when(who.startswith("home"), 0).otherwise(SIDE), s["n"]
        home = ((n * 3 + j * 29) % 90 + 5) if axis == "x" else ((n * 5 + j * 17) % 58 + 5)
        p = s["px"] if axis == "x" else s["py"]
        return F.when(s["who"] == who, p).when(s["beside"] == who, p + (0.8 if axis == "x" else 0.4)).otherwise(home.cast("double"))

    here, there, w = F.col("here"), F.col("there"), F.col("step") / F.lit(float(APART))
    mix = lambda axis: (F.col(f"{axis}0") + (F.col(f"{axis}1") - F.col(f"{axis}0")) * w).alias(axis)
    seconds = APART / RATE

    def player(name):
        who = F.lit(name)
        x0, x1, y0, y1 = place(who, here, "x"), place(who, there, "x"), place(who, here, "y"), place(who, there, "y")
        return way(who, x0, x1, y0, y1)

    def way(who, x0, x1, y0, y1):
        return F.struct(who.alias("object_id"), x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"), (F.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / seconds).alias("speed"))

    # where each object goes is told once a leg; a frame only goes along
    objects = F.array(way(F.lit("ball"), here["px"], there["px"], here["py"], there["py"]), *[player(f"{t}_{i}") for t in ("home", "away") for i in range(1, SIDE + 1)])
    leg = leg.select("match_id", "period_id", "at", "rest", F.inline(objects)).select("*", F.explode(F.sequence(F.lit(0), F.lit(APART - 1))).alias("step"))
    # no frames for six before a restart but the last
    leg = leg.where(~F.col("rest") | (F.col("step") < APART - 8) | (F.col("step") == APART - 1))
    frame, ball = F.col("at") + F.col("step"), F.col("object_id") == "ball"
    tracking = leg.select(
        "match_id", "period_id", frame.alias("frame_id"), (frame / F.lit(float(RATE)) + 1000).alias("utc"), "object_id", mix("x"), mix("y"), F.when(ball, w * (1 - w) * 4).otherwise(0.0).alias("z"), "speed",
        F.when(ball & (F.col("step") == 0), 15.0).otherwise(0.0).alias("accel_v"),
    )
    return events, tracking


@query("y16_synced_events")
def synced_events(spark, d):
    """Frames and receipts of every action, of all types, on the tracking drawn from them (order-dependent: held against the drawn frames and plain code in tests)."""
    return Y.synced(*drawn(spark, d), fps=RATE)
