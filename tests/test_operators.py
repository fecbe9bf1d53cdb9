"""Domain operators on hand-made tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import geometry as G
from matchloom.operators import baseline_sync, credit, features, joins, kernels, labels, normalize, relational, sequence, sync, tracking, validate


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_episodes_of_the_fixture(spark):
    f = spark.createDataFrame([(1, 1, x) for x in (0, 1, 2, 7, 8, 30)], "match_id long, period_id int, frame_id long")
    assert [r.episode_id for r in sequence.episodes(f).orderBy("frame_id").collect()] == [1, 1, 1, 2, 2, 3]
    dead = sequence.episodes(f, alive=F.col("frame_id") != 7)
    assert [r.episode_id for r in dead.orderBy("frame_id").collect()] == [1, 1, 1, 0, 2, 3]


ACTIONS = "match_id long, period_id int, action_id long, spadl_type string, team string, object_id string, expected_goal double, success boolean"


def three(spark):
    return spark.createDataFrame([(1, 1, 0, "pass", "home", "home_2", None, True), (1, 1, 1, "shot", "away", "away_3", 0.2, False), (1, 1, 2, "shot", "home", "home_9", 0.5, True)], ACTIONS)


def test_returns_of_the_fixture(spark):
    r = sequence.future_returns(three(spark)).orderBy("action_id").first()
    assert (r.scores, r.concedes) == (1, 0) and math.isclose(r.scores_xg, 0.5) and math.isclose(r.concedes_xg, 0.2)
    r = sequence.discounted_returns(three(spark), 0.9).orderBy("action_id").first()
    assert math.isclose(r.scores_xg_disc, 0.405) and math.isclose(r.concedes_xg_disc, 0.18)


def plain_discounted(rows, gamma):
    out = []
    for i, a in enumerate(rows):
        s = c = 1.0
        for j in range(i, len(rows)):
            b = rows[j]
            x = 1 - gamma ** (j - i) * (b[6] or 0)
            s, c = (s * x, c) if b[4] == a[4] else (s, c * x)
            if (b[6] or 0) > 0 and b[7] or j + 1 < len(rows) and (rows[j + 1][1] != a[1] or rows[j + 1][3] == "goalkick"):
                break
        out.append((1 - s, 1 - c))
    return out


def test_discounted_returns_against_a_loop(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(120):
        kind = str(r.choice(["pass", "shot", "goalkick", "foul"]))
        team = str(r.choice(["home", "away"]))
        rows.append((1, 1 if i < 60 else 2, i, kind, team, f"{team}_1", float(r.random() * 0.6) if kind == "shot" else None, bool(r.random() < 0.4)))
    got = sequence.discounted_returns(spark.createDataFrame(rows, ACTIONS), 0.9).orderBy("action_id").collect()
    assert np.allclose([(x.scores_xg_disc, x.concedes_xg_disc) for x in got], plain_discounted(rows, 0.9))


def test_value_returns_of_the_fixture(spark):
    rows = [(1, 1, 0, "pass", "home", "home_2", None, True, 0.1), (1, 1, 1, "foul", "home", "home_2", None, True, None), (1, 1, 2, "pass", "away", "away_2", None, True, 0.3), (1, 2, 3, "pass", "home", "home_2", None, True, 0.2)]
    got = sequence.value_returns(spark.createDataFrame(rows, ACTIONS + ", xt double")).orderBy("action_id").collect()
    assert (got[0].scores_xt, got[0].concedes_xt) == (0.2, 0.3) and (got[3].scores_xt, got[3].concedes_xt) == (0.0, 0.0)
    apart = sequence.value_returns(spark.createDataFrame(rows, ACTIONS + ", xt double"), each_period=True).orderBy("action_id").collect()
    assert apart[0].scores_xt == 0.0


def test_nearest_goes_to_the_earlier_frame(spark):
    frames = spark.createDataFrame([(1, 0.0, "a"), (1, 0.04, "b")], "m long, t double, f string")
    events = spark.createDataFrame([(1, 0.02), (1, 0.03), (1, 9.0), (2, 0.0)], "m long, t double")
    got = {(r.m, r.t): r.f for r in joins.nearest(events, frames, ["m"], "t", ["f"], 1.0).collect()}
    assert got == {(1, 0.02): "a", (1, 0.03): "b", (1, 9.0): None, (2, 0.0): None}


@pytest.mark.parametrize(("mode", "strict", "want"), [("backward", False, 20), ("backward", True, 10), ("forward", False, 20), ("forward", True, 30)])
def test_asof_modes(spark, mode, strict, want):
    right = spark.createDataFrame([(1, t, t * 10) for t in (1, 2, 3)], "m long, t long, v long")
    left = spark.createDataFrame([(1, 2, "x")], "m long, t long, keep string")
    r = joins.asof(left, right, ["m"], "t", ["v"], mode, strict).first()
    assert (r.keep, r.v) == ("x", want)


def test_within_spans_many_buckets(spark):
    points = spark.createDataFrame([(1, f) for f in (0, 5, 600, 1500, 9999)], "m long, f long")
    spans = spark.createDataFrame([(1, 0, 5, "a"), (1, 500, 1600, "b")], "m long, s long, e long, n string")
    got = {r.f: r.n for r in joins.within(points, spans, ["m"], "f", "s", "e", 100, "left").collect()}
    assert got == {0: "a", 5: "a", 600: "b", 1500: "b", 9999: None}


def test_geometry_fixtures(spark):
    inside = [value(spark, G.in_corridor(0, 0, 10, 0, x, y)) for x, y in ((5, 4.9), (5, 5), (11, 0))]
    assert inside == [True, False, False]
    assert math.isclose(value(spark, G.lane_distance(0, 0, 10, 0, 12, 0)), 2, abs_tol=1e-5)
    assert value(spark, F.struct(G.grid_column(F.lit(0.0)).alias("c"), G.grid_row(F.lit(0.0)).alias("r"))) == (0, 7)
    assert value(spark, F.struct(G.grid_column(F.lit(105.0)).alias("c"), G.grid_row(F.lit(68.0)).alias("r"))) == (11, 0)
    assert value(spark, G.near_triangle(0, 0, 10, 0, 0, 10, 2, 2)) and value(spark, G.near_triangle(0, 0, 10, 0, 0, 10, -0.5, 2)) and not value(spark, G.near_triangle(0, 0, 10, 0, 0, 10, -1.5, 2))
    assert value(spark, G.clock(F.lit(75.5))) == "01:15.50" and value(spark, G.clock(F.lit(59.999))) == "00:59.00" and value(spark, G.clock_seconds(F.lit("01:15.50"))) == 75.5


PLAYER = "ordinal int, object_id string, team string, keeper boolean, goal boolean, x double, y double, vx double, vy double"


def snapshot(spark, places, who="home_2", **more):
    players = [(i + 1, o, o[:4], o.endswith("_1"), o.endswith("goal"), float(x), float(y), 0.0, 0.0) for i, (o, (x, y)) in enumerate(places.items())]
    cols = {"event_id": "long", "team": "string", "object_id": "string", "players": f"array<struct<{PLAYER.replace(' ', ':').replace(',:', ',')}>>"} | {k: v[0] for k, v in more.items()}
    return spark.createDataFrame([(1, who[:4], who, players, *(v[1] for v in more.values()))], ", ".join(f"{k} {t}" for k, t in cols.items()))


def test_node_features_against_numpy(spark):
    places = {"home_1": (5, 34), "home_2": (50, 30), "home_3": (60, 40), "away_1": (100, 34), "away_2": (58, 37), "away_3": (61, 41), "home_goal": (105, 34), "away_goal": (0, 34)}
    rows = {r.ordinal: r for r in features.node_features(features.oriented(snapshot(spark, places))).collect()}
    at = {i + 1: np.array(p, float) for i, p in enumerate(places.values())}
    rivals = [4, 5, 6, 8]
    assert rows[3].near_opponents == sum(np.hypot(*(at[3] - at[o])) < 3 for o in rivals)
    assert math.isclose(rows[3].nearest_opponent, min(np.hypot(*(at[3] - at[o])) for o in rivals))
    assert rows[2].possessor == 1 and rows[2].poss_dist == 0 and rows[1].keeper == 1 and rows[7].goal == 1
    assert rows[3].interceptors == 1 and rows[5].lane_distance == 0
    away = {r.ordinal: r for r in features.node_features(features.oriented(snapshot(spark, places, "away_2"))).collect()}
    assert (away[5].x, away[5].y) == (105 - 58, 68 - 37)


def test_intent_prefers_the_teammate_in_the_cone(spark):
    places = {"home_2": (50, 34), "home_3": (70, 36), "home_4": (50, 60), "away_2": (65, 34)}
    extra = {"action_type": ("string", "pass"), "receiver_id": ("string", "away_2"), "success": ("boolean", False), "end_x": ("double", 65.0), "end_y": ("double", 34.0)}
    s = snapshot(spark, places, **extra)
    s = s.withColumn("poss", F.get(F.filter("players", lambda q: q["object_id"] == "home_2"), 0))
    assert labels.intended_receiver(s).first().intent_id == "home_3"
    far = s.withColumns({"end_x": F.lit(30.0), "end_y": F.lit(10.0)})
    assert labels.intended_receiver(far).first().intent_id is None


def test_value_grid_matches_a_plain_loop(spark):
    r = np.random.default_rng(4)
    rows = [(str(r.choice(["pass", "shot"])), "home", bool(r.random() < 0.7), float(r.random() * 105), float(r.random() * 68), float(r.random() * 105), float(r.random() * 68)) for _ in range(600)]
    d = spark.createDataFrame(rows, "spadl_type string, team string, success boolean, start_x double, start_y double, end_x double, end_y double")
    grid = labels.fit_grid(labels.grid_counts(d), 2000, 1e-12)
    cell = lambda x, y: (7 - int(y / 68 * 8)) * 12 + int(x / 105 * 12)
    n, value_of = np.zeros((96, 3)), np.zeros(96)
    to = np.zeros((96, 96))
    for kind, _, ok, x, y, ex, ey in rows:
        n[cell(x, y)] += (kind == "shot", kind == "shot" and ok, kind == "pass")
        if kind == "pass" and ok:
            to[cell(x, y), cell(ex, ey)] += 1
    for _ in range(2000):
        value_of = np.array([0.0 if not n[c, 0] + n[c, 2] else (n[c, 1] + to[c] @ value_of) / (n[c, 0] + n[c, 2]) for c in range(96)])
    g = value_of.reshape(8, 12)
    assert np.allclose(grid, (g + g[::-1]) / 2, atol=1e-8) and np.allclose(grid, grid[::-1])


def test_smoothing_keeps_quadratics():
    t = np.arange(40.0)
    q = 0.3 * t * t - 2 * t + 5
    assert np.allclose(kernels.smooth(q), q) and np.allclose(kernels.smooth(q[:9]), q[:9])
    assert np.allclose(kernels.smoothing_matrix(15)[7], [(167 - 5 * i * i) / 1105 for i in range(-7, 8)])
    assert (kernels.smooth(q[:2]) == q[:2]).all()
    k = kernels.kinematics(t * 2, t * 0)
    assert np.allclose(k["vx"], 50) and np.allclose(k["accel"], 0)


def test_peaks_by_definition():
    x = np.array([0, 2, 0, 3, 3, 3, 1, 5, 0, 1, 0.5, 4, 0], float)
    assert kernels.peaks(x).tolist() == [1, 4, 7, 9, 11]
    assert kernels.peaks(x, prominence=1.5).tolist() == [1, 4, 7, 11]
    assert kernels.peaks(x, spacing=4).tolist() == [1, 7, 11]
    assert kernels.valleys(-x).tolist() == kernels.peaks(x).tolist() and kernels.peaks(np.zeros(3)).tolist() == []


def test_simplified_path_and_woodwork():
    line = np.stack((np.arange(20.0), np.zeros(20)), 1)
    assert kernels.simplify(line, 0.5).tolist() == [[0, 0], [19, 0]]
    post = np.array([[90, 30.34], [98, 30.34], [104.8, 30.34], [98, 24], [90, 18]])
    assert kernels.shot_anomaly(post, 10) == (False, True)
    odd = np.array([[50, 34], [60, 34], [50, 34.5], [60, 36]], float)
    assert kernels.shot_anomaly(odd, 40) == (True, False) and kernels.shot_anomaly(odd, 10) == (False, False) and kernels.shot_anomaly(odd[:1], 40) == (False, False)


def test_triangulation_of_a_square():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1.1], [0.5, 0.4]])
    e = kernels.delaunay_edges(square)
    assert {(4, i) for i in range(4)} <= set(e) and all((b, a) in e for a, b in e) and (0, 2) not in e


def synthetic_match():
    n, rows = 150, []
    for f in range(n):
        k = max(f - 20, 0)
        places = {"ball": (min(52.5 + 0.5 * k, 75), 34), "home_2": (52, 34), "home_3": (75.5, 34.2), "away_2": (62, 44)}
        rows += [(o, f, x, y) for o, (x, y) in places.items()]
    import pandas as pd

    t = pd.DataFrame(rows, columns=["object_id", "frame_id", "x", "y"])
    out = []
    for o, g in t.groupby("object_id"):
        k = kernels.kinematics(g["x"].to_numpy(), g["y"].to_numpy())
        out.append(g.assign(period_id=1, utc=g["frame_id"] / 25 + 100, z=0.0, speed=k["speed"], accel_v=k["accel"]))
    return pd.concat(out)


def test_synchroniser_finds_a_known_kick():
    m = sync.Match.of(synthetic_match())
    events = [{"match_id": 1, "period_id": 1, "action_id": i, "spadl_type": t, "object_id": o, "success": True, "utc": u} for i, (t, o, u) in enumerate((("pass", "home_2", 107.0), ("pass", "home_3", 109.0)))]
    got = sync.synchronise(events, m)
    assert abs(got[0]["frame_id"] - 20) <= 4 and got[0]["receiver_id"] == "home_3" and 55 <= got[0]["receive_frame_id"] <= 75
    assert got[1]["frame_id"] >= got[0]["frame_id"]


def test_synchroniser_without_tracking(spark):
    e = spark.createDataFrame([(1, 1, 0, "pass", "home_2", True, 1.0)], "match_id long, period_id int, action_id long, spadl_type string, object_id string, success boolean, utc double")
    t = spark.createDataFrame([], "match_id long, period_id int, frame_id long, object_id string, utc double, x double, y double, z double, speed double, accel_v double")
    assert [tuple(r) for r in sync.synced(e, t).collect()] == [(1, 0, None, None, None)]


def test_phases_of_a_substitution(spark):
    spans = spark.createDataFrame([(1, "home_1", 0, 99), (1, "home_2", 0, 49), (1, "home_3", 50, 99)], "match_id long, object_id string, in_frame long, out_frame long")
    frames = spark.createDataFrame([(1, 1, f) for f in range(100)], "match_id long, period_id int, frame_id long")
    got = [(r.start_frame, r.end_frame, r.active_players) for r in tracking.phases(spans, frames).orderBy("start_frame").collect()]
    assert got == [(0, 49, ["home_1", "home_2"]), (50, 99, ["home_1", "home_3"])]


def test_possession_view_turns_and_renames(spark):
    f = spark.createDataFrame([(1, t, o, 30.0, 20.0) for t in (4, 5, 6) for o in ("away_7", "home_2", "ball")], "match_id long, frame_id long, object_id string, x double, y double")
    p = spark.createDataFrame([(1, 9, "away", True, 5, 6)], "match_id long, possession_id long, team string, right_to_left boolean, frame_start long, frame_end long")
    rows = tracking.possession_view(f, p).collect()
    assert len(rows) == 9 and {r.object_id for r in rows} == {"home_7", "away_2", "ball"} and {(r.x, r.y) for r in rows} == {(75.0, 48.0)}
    assert {r.frame_id for r in rows if not r.has_ball} == {4}


def test_minutes_played(spark):
    lineup = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False), (1, "d", False), (1, "e", True)], "match_id long, player_id string, starting boolean")
    subs = spark.createDataFrame([(1, 3600.0, "c", "a")], "match_id long, clock double, player_in string, player_out string")
    reds = spark.createDataFrame([(1, 1800.0, "b")], "match_id long, clock double, player_id string")
    ends = spark.createDataFrame([(1, 5400.0)], "match_id long, end_clock double")
    got = {r.player_id: r.mins_played for r in normalize.minutes_played(lineup, subs, reds, ends).collect()}
    assert got == {"a": 60.0, "b": 30.0, "c": 30.0, "d": 0.0, "e": 90.0}


def test_credits_are_conserved(spark):
    keys = "event_id long"
    v = spark.createDataFrame([(1, "pass", "home_3", "away_2", 0.05, -0.1, "intercept_pass"), (2, "pass", "home_3", "home_3", 0.05, 0.1, "concede_pass")], keys + ", action_type string, intent_id string, receiver_id string, start double, diff double, defense_type string")
    o = spark.createDataFrame([(e, x, 0.6, 0.1, 0.02, 0.0, 0.05) for e in (1, 2) for x in ("home_3", "home_4")], keys + ", option string, success_p double, s_score double, s_concede double, f_score double, f_concede double")
    p = spark.createDataFrame([(e, x, f"away_{i}", q) for e in (1, 2) for x in ("home_3", "home_4") for i, q in ((1, 0.3), (2, 0.7))], keys + ", option string, defender string, posterior double")
    got = credit.pass_credits(v, o, p, "event_id").groupBy("event_id").agg(F.sum("player_credit").alias("c"), F.sum("weight").alias("w")).collect()
    assert {r.event_id: (round(r.c, 9), round(r.w, 9)) for r in got} == {1: (0.1, 1.0), 2: (-0.1, 1.0)}


def test_set_piece_options(spark):
    o = spark.createDataFrame([(e, x, 0.25, 0.5, 0.1) for e in (1, 2, 3) for x in ("home_2", "home_3", "home_4", "home_goal")], "event_id long, option string, select_p double, success_p double, s_score double")
    a = spark.createDataFrame([(1, "home_2", "shot_penalty"), (2, "home_2", "throw_in"), (3, "home_2", "pass")], "event_id long, end_player_id string, end_type string")
    got = {(r.event_id, r.option): (r.select_p, r.success_p, r.s_score) for r in credit.adjusted_set_pieces(o, a, "event_id").collect()}
    assert got[1, "home_goal"] == (1.0, 1.0, 0.7884) and got[1, "home_3"][0] == 0 and got[2, "home_3"] == (0.5, 0.5, 0.1) and got[2, "home_goal"][0] == 0 and got[3, "home_2"][0] == 0.25


def test_auc_and_cumulative(spark):
    r = np.random.default_rng(1)
    rows = [(float(np.round(r.random(), 2)), int(r.random() < 0.4)) for _ in range(300)]
    m = relational.binary_metrics(spark.createDataFrame(rows, "p double, y int"), "p", "y").first()
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    assert math.isclose(m.auc, sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))


def test_violations_count_nulls(spark):
    d = spark.createDataFrame([(1, 2.0), (3, None), (None, -1.0)], "period_id int, x double")
    got = {r.rule: r.n for r in validate.violations(d, {"period_id": F.col("period_id").isin(1, 2), "x": F.col("x") >= 0}).collect()}
    assert got == {"period_id": 2, "x": 2}
    seq = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2)], "m long, i long")
    assert [r.m for r in validate.contiguous(seq, "m", "i").collect()] == [2]


def test_self_pass_filter(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, i, "pass", o, t + dt.timedelta(seconds=s)) for i, (o, s) in enumerate((("home_2", 0), ("home_2", 3), ("home_3", 5), ("home_3", 20)))]
    d = spark.createDataFrame(rows, "match_id long, period_id int, action_id long, spadl_type string, object_id string, ts timestamp_ntz")
    assert [r.action_id for r in sequence.without_self_passes(d).orderBy("action_id").collect()] == [1, 2, 3]


def test_logistic_fit_recovers_weights(spark):
    from matchloom.operators import scoring

    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 2))
    y = r.random(4000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0] - x[:, 1])))
    d = spark.createDataFrame([(float(a), float(b), bool(g)) for (a, b), g in zip(x, y)], "distance double, angle double, goal boolean")
    intercept, w = scoring.fit_expected_goals(d, ("distance", "angle"))
    assert abs(intercept - 0.5) < 0.15 and abs(w["distance"] - 1.5) < 0.2 and abs(w["angle"] + 1) < 0.2
    got = spark.createDataFrame([(1.0, 2.0)], "distance double, angle double").select(features.logistic(w, intercept).alias("p")).first().p
    assert math.isclose(got, 1 / (1 + math.exp(-(intercept + w["distance"] + 2 * w["angle"]))))


def test_graph_scores_match_a_loop(spark):
    from matchloom.operators import scoring

    r = np.random.default_rng(1)
    rows = [(e, i, float(r.normal()), float(r.random() * 105), float(r.random() * 68), float(i < 3), float(i == 0), 0.0) for e in (1, 2) for i in range(6)]
    d = spark.createDataFrame(rows, "event_id long, ordinal int, f double, x double, y double, teammate double, possessor double, goal double").repartition(3)
    w = scoring.random_weights(3, 8)
    out = {(q.event_id, q.ordinal): q.output for q in scoring.graph_scores(d, ["f", "x", "y"], w).collect()}
    for e in (1, 2):
        n = [q for q in rows if q[0] == e]
        edges = np.array([[[math.hypot(a[3] - b[3], a[4] - b[4]) / 100, float(a[5] == b[5])] for b in n] for a in n])
        want = scoring.graph_forward(np.array([[q[2], q[3], q[4]] for q in n]), edges, w)[:, 0]
        assert np.allclose([out[e, i] for i in range(6)], want)
    p = scoring.selection(scoring.graph_scores(d, ["f", "x", "y"], w), d).groupBy("event_id").agg(F.sum("p").alias("s"), F.count("*").alias("n")).collect()
    assert all(math.isclose(q.s, 1) and q.n == 2 for q in p)
    post = scoring.posteriors(d, ["f", "x", "y"], scoring.random_weights(4, 8)).groupBy("event_id", "option").agg(F.sum("posterior").alias("s"), F.count("*").alias("n")).collect()
    assert len(post) == 4 and all(math.isclose(q.s, 1) and q.n == 3 for q in post)


def test_external_frames(spark):
    from matchloom.operators import external

    players = [(1, 1, "0.04", 7, 1, "-10", "5", "A", "A", None), (1, 1, "0.04", 7, 1, "-10", "5", "A", "A", None), (1, 1, "0.08", 7, 1, "-9", "5", "A", "A", 1.0), (1, 1, "0.08", 8, 2, "50", "0", "B", "A", None), (1, 1, "0.08", 9, 3, "0", "0", "B", "A", None), (1, 1, "0.12", 8, 2, "x", "0", "B", "A", None)]
    p = external.clean_players(spark.createDataFrame(players, "game_id int, half int, abs_time string, uefa_player_id int, role int, centroid_x string, centroid_y string, team string, possession_team string, BallReceipt double"))
    b = external.clean_ball(spark.createDataFrame([(1, 1, 0.08, 1.0, 2.0, 0.1), (1, 1, 0.08, 0.5, 2.0, 0.1), (1, 1, 0.2, None, 2.0, 0.1)], "game_id int, half int, abs_time double, ball_x double, ball_y double, ball_z double"))
    names = external.object_names(p, normalize.stable_teams(p))
    assert p.count() == 3 and b.count() == 1 and {(r.uefa_player_id, r.object_id) for r in names.collect()} == {(7, "home_1"), (8, "away_1")}
    meta = external.frame_meta(p, b, names).orderBy("frame_id").collect()
    assert [(r.frame_id, r.ball_x, r.possessor) for r in meta] == [(0, None, None), (1, 0.5, "home_1")]
    long = {(r.abs_time, r.object_id): (r.x, r.y) for r in external.long_tracking(p, b, names).collect()}
    assert long == {(0.04, "home_1"): (42.5, 39.0), (0.08, "home_1"): (43.5, 39.0), (0.08, "away_1"): (102.5, 34.0), (0.08, "ball"): (53.0, 36.0)}


def test_lineup_lookup(spark):
    from matchloom.operators import external

    e = spark.createDataFrame([(1, "p", "q"), (1, "q", None), (2, "p", "p")], "match_id long, player_id string, receiver_player_id string")
    lineup = spark.createDataFrame([(1, "p", "home_1"), (1, "q", "home_2")], "match_id long, player_id string, object_id string")
    assert {(r.match_id, r.player_id, r.object_id, r.receiver_id) for r in external.by_lineup(e, lineup).collect()} == {(1, "p", "home_1", "home_2"), (1, "q", "home_2", None), (2, "p", None, None)}
    assert value(spark, external.clock_frame(F.lit("01:02"))) == 1550


def test_tracks_across_arrow_batches(spark):
    from matchloom.operators import kernels, tracking

    r = np.random.default_rng(5)
    rows = [(m, 1, o, f, float(x), float(y)) for m in (1, 2) for o, n in (("ball", 40), ("home_1", 1), ("home_2", 23)) for f, (x, y) in enumerate(r.normal(size=(n, 2)).cumsum(0))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = tracking.with_kinematics(spark.createDataFrame(rows, "match_id long, period_id int, object_id string, frame_id long, x double, y double").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)
    for m in (1, 2):
        for o in ("ball", "home_1", "home_2"):
            mine = sorted((g for g in got if g.match_id == m and g.object_id == o), key=lambda g: g.frame_id)
            k = kernels.kinematics(np.array([g.x for g in mine]), np.array([g.y for g in mine]))
            assert np.allclose([g.speed for g in mine], k["speed"]) and np.allclose([g.accel for g in mine], k["accel"]) and np.allclose([g.accel_v for g in mine], kernels.speed_change(k["speed"]))
    assert tracking.with_kinematics(spark.createDataFrame([], "match_id long, period_id int, object_id string, frame_id long, x double, y double")).count() == 0


def test_graph_layers_and_heads():
    from matchloom.operators import scoring

    r = np.random.default_rng(2)
    n = lambda *s: r.normal(size=s)
    x, edges = n(5, 4), n(5, 5, 2)
    layers = [{"layer": "convolution", "w": n(3, 3), "bias": n(3)}, {"layer": "isomorphism", "eps": 0.5, "w": n(3, 6), "bias": n(6), "w2": n(6, 3), "bias2": n(3)}]
    w = {"input": n(4, 3), "input_bias": n(3), "layers": layers, "head": n(3, 1), "head_bias": n(1)}
    relu = lambda a: np.maximum(a, 0)
    h = relu(x @ w["input"] + w["input_bias"])
    h = relu(np.stack([sum(h[j] @ layers[0]["w"] for j in range(5)) / 5 + layers[0]["bias"] for _ in range(5)]))
    h = relu(np.stack([relu((1.5 * h[i] + sum(h[j] for j in range(5) if j != i)) @ layers[1]["w"] + layers[1]["bias"]) @ layers[1]["w2"] + layers[1]["bias2"] for i in range(5)]))
    assert np.allclose(scoring.graph_forward(x, edges, w), h @ w["head"] + w["head_bias"])
    assert np.allclose(scoring.graph_forward(x, edges, w | {"kind": "graph"}), h.mean(0) @ w["head"] + w["head_bias"])
    gated = {"kind": "gated", "value": n(3, 2), "value_bias": n(2), "gate": n(3, 2), "gate_bias": n(2), "head": n(2, 1)}
    assert np.allclose(scoring.graph_forward(x, edges, w | gated), ((h @ gated["value"] + gated["value_bias"]) / (1 + np.exp(-(h @ gated["gate"] + gated["gate_bias"])))) @ gated["head"] + w["head_bias"])


def test_baseline_frames(spark):
    """A drawn match: kickoff where the ball leaves, its clock moved by that, later events not before earlier ones; gaps, NaN and periods without tracking give nulls."""
    rows = []
    for f in range(300):
        bx = 52.5 if f < 20 else min(52.5 + (f - 20) * 0.5, 75.0)
        rows += [(1, 1, f, "ball", f / 25 + 100, bx, 34.0, float("nan") if f == 70 else 0.0, 9.0 if f == 20 else 0.0)]
        rows += [(1, 1, f, "home_2", f / 25 + 100, 52.0, 34.0, 0.0, 0.0), (1, 1, f, "home_3", f / 25 + 100, 75.0 if f >= 60 else 60.0, 34.0, 0.0, 0.0)]
    t = spark.createDataFrame(rows, "match_id long, period_id int, frame_id long, object_id string, utc double, x double, y double, z double, accel double")
    e = [
        (1, 1, 0, "pass", "home_2", 52.5, 34.0, 103.0),  # 2.2 s late
        (1, 1, 1, "interception", "home_3", 75.0, 34.0, 104.4),
        (1, 1, 2, "take_on", "home_3", 75.0, 34.0, 105.0),
        (1, 1, 3, "bad_touch", "home_3", None, None, 106.0),
        (1, 1, 4, "foul", "home_9", 75.0, 34.0, 107.0),
        (1, 2, 5, "pass", "home_2", 52.5, 34.0, 300.0),
        (2, 1, 0, "pass", "home_2", 52.5, 34.0, 0.0),
    ]
    e = spark.createDataFrame(e, "match_id long, period_id int, action_id long, spadl_type string, object_id string, start_x double, start_y double, utc double")
    got = {(r.match_id, r.action_id): r.frame_id for r in baseline_sync.synced(e, t).collect()}
    # the ball reaches (75, 34) in frame 65; frames 65 and later tie, the earliest wins; the event without a place takes its first frame after that
    assert got == {(1, 0): 20, (1, 1): 65, (1, 2): None, (1, 3): 65, (1, 4): None, (1, 5): None, (2, 0): None}
    crowded = t.unionByName(t.where("object_id = 'home_2'").withColumns({"object_id": F.lit("home_5"), "y": F.lit(36.0)}))
    got = {(r.match_id, r.action_id): r.frame_id for r in baseline_sync.synced(e, crowded).collect()}
    assert got[(1, 0)] == 0 and got[(1, 1)] >= 60 and baseline_sync.synced(e.limit(0), t).count() == 0 and baseline_sync.synced(e, t.limit(0)).where("frame_id IS NOT NULL").count() == 0


def test_lookups_broadcast_few_bytes_only(spark):
    rows = spark.createDataFrame([(i % 5, i) for i in range(20)] + [(None, 99)], "k int, i int")
    wide = spark.createDataFrame([(i, "ä" * 1000, ["x" * 500], {"a": None}, {"a.b": 1}) for i in range(4)], "k int, `na.me` string, list array<string>, `m``p` map<string,string>, s struct<`a.b`:int>")
    size = wide.agg(F.sum(joins.row_bytes(wide))).first()[0]
    assert 4 * 2500 < size < 4 * 2700
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    ways = [joins.lookup(rows, wide, ["k"], most_bytes=b) for b in (size, size - 1)] + [joins.lookup(rows, wide, ["k"], most=m) for m in (4, 3)]
    assert [hinted(w) for w in ways] == [True, False, True, False]
    assert len({tuple(sorted((r.i, r.k is not None and r.k < 4, len(r["na.me"] or "")) for r in w.collect())) for w in ways}) == 1 and ways[0].count() == 21
    none = joins.lookup(rows, wide.limit(0), ["k"])
    assert hinted(none) and none.where("list IS NOT NULL").count() == 0 and none.count() == 21
