"""Joins and folds that have to hold on tables of any size: nothing unfolded is sent through the driver, and the plain forms agree with those within rows."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(df.collect(), key=str)


def alike(got, want):
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert tuple(a)[:-1] == tuple(b)[:-1] and a[-1] == pytest.approx(b[-1], abs=1e-9)


def long_forms(spark):
    """Options and posteriors of the credit queries as long tables."""
    from matchloom.plans import q_credit as Q

    v = Q.judged(spark, DIR).where("event_id % 7 = 0").localCheckpoint()
    o = v.select("event_id", "team", F.explode("options").alias("_o"))
    p = Q.responsible(o.withColumn("option", F.col("_o.option"))).select("event_id", "option", "defender", "posterior")
    return v, o.select("event_id", "_o.*"), p, Q.responsible


def test_f1_shot_credits_join_nothing(spark):
    from matchloom.operators import credit

    assert "Join" not in plan(entry_points.queries()["c09_shot_credits"](spark, DIR))
    v, o, p, responsible = long_forms(spark)
    assert "Broadcast" not in plan(credit.shot_credits(v, o, p, "event_id"))
    alike(rows(credit.shot_credits(v, "options", responsible, "event_id")), rows(credit.shot_credits(v, o, p, "event_id")))


def test_f8_pass_credits_join_nothing(spark):
    from matchloom.operators import credit

    assert "Join" not in plan(entry_points.queries()["c08_pass_credits"](spark, DIR))
    v, o, p, responsible = long_forms(spark)
    assert "Broadcast" not in plan(credit.pass_credits(v, o, p, "event_id"))
    columns = ["event_id", "option", "defender", "defense_type", F.round("weight", 9).alias("weight"), F.round("option_resp", 9).alias("resp"), "team_credit", "player_credit"]
    alike(rows(credit.pass_credits(v, "options", responsible, "event_id").select(columns)), rows(credit.pass_credits(v, o, p, "event_id").select(columns)))


def test_f2_graph_rows_join_nothing(spark):
    from matchloom.operators import components

    assert "Join" not in plan(entry_points.queries()["g15_graph_rows"](spark, DIR))
    names = "array<struct<ordinal:int,possessor:double,x:double,y:double>>"
    labels = spark.createDataFrame([(1, 1, [(1, 0.0, 1.0, 2.0), (2, 1.0, 3.0, 4.0)]), (2, 7, [(1, 0.0, 1.0, 2.0)]), (3, None, [(2, 1.0, 5.0, 6.0), (1, 1.0, 7.0, 8.0)]), (4, 0, [])], f"event_id long, intent_index int, nodes {names}")
    nodes = labels.select("event_id", F.inline("nodes"))
    assert "Broadcast" not in plan(components.graph_to_table(nodes, labels.drop("nodes"), "event_id", ["x", "y"]))
    want = [(1, 3.0, 4.0, 3.0, 4.0), (2, -1.0, -1.0, -1.0, -1.0), (3, 7.0, 8.0, -1.0, -1.0), (4, -1.0, -1.0, -1.0, -1.0)]
    assert rows(components.graph_to_table("nodes", labels, "event_id", ["x", "y"])) == rows(components.graph_to_table(nodes, labels.drop("nodes"), "event_id", ["x", "y"])) == want


@pytest.mark.parametrize("name", ["n48_situation_audit", "n48_situation_labels", "m15_situation_export", "y17_baseline_frames", "m04_graph_selection"])
def test_f4_to_f7_and_f11_nothing_unfolded_is_broadcast(spark, name):
    assert "Broadcast" not in plan(entry_points.queries()[name](spark, DIR))


def graph_nodes(spark):
    from matchloom.plans import q_scoring as Q

    n = Q.nodes(spark, DIR).where("event_id % 50 = 0")
    return Q, n.where("event_id % 100 = 0 OR ordinal % 3 > 0").localCheckpoint()


def test_f11_selection_joins_nothing(spark):
    from matchloom.operators import scoring as M

    assert "Join" not in plan(entry_points.queries()["m04_graph_selection"](spark, DIR))
    Q, n = graph_nodes(spark)
    w = M.random_weights(len(Q.GRAPH))
    joined = M.selection(M.graph_scores(n, Q.GRAPH, w), n)
    assert "Broadcast" not in plan(joined)
    alike(rows(M.selection(M.graph_scores(n, Q.GRAPH, w, marks=True))), rows(joined))


def test_f17_posteriors_gather_each_graph_once(spark):
    import numpy as np

    from matchloom.operators import scoring as M

    assert "Join" not in plan(entry_points.queries()["m05_graph_posteriors"](spark, DIR))
    Q, n = graph_nodes(spark)
    w, graphs, want = M.random_weights(len(Q.GRAPH) + 1, seed=1), {}, []
    for r in n.orderBy("event_id", "ordinal").collect():
        graphs.setdefault(r.event_id, []).append(r)
    for k, g in graphs.items():
        at, side = np.array([[r.x, r.y] for r in g]), np.array([r.teammate for r in g])
        gap = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
        edges = np.stack((gap / 100, side[:, None] == side[None]), 2).astype(float)
        for o in (r for r in g if r.teammate == 1 and r.possessor == 0):
            y = M.graph_forward(np.array([[*(r[c] for c in Q.GRAPH), float(r.ordinal == o.ordinal)] for r in g]), edges, w)[:, 0]
            e = {r.ordinal: np.exp(v) for r, v in zip(g, y, strict=True) if r.teammate == 0 and r.goal == 0}
            want += [(k, o.ordinal, d, float(v / sum(e.values()))) for d, v in e.items()]
    alike(rows(M.posteriors(n, Q.GRAPH, w)), rows(spark.createDataFrame(want, "event_id long, option int, defender int, posterior double")))


def test_f9_most_triples_are_ruled_out():
    import numpy as np

    from matchloom.operators import kernels as K

    r, old = np.random.default_rng(3), K.possible_edges
    cases = [r.random((24, 2)) * 100 for _ in range(40)] + [r.integers(0, 4, (n, 2)).astype(float) for n in range(1, 20)] + [np.concatenate((p, p[:2] + 1e-9)) for p in (r.random((9, 2)), r.integers(0, 3, (9, 2)) * 1.0)]
    cases += [np.stack((np.cos(t), np.sin(t)), 1) * 50 for n in range(3, 12) for t in [np.arange(n) * 2 * np.pi / n]]
    got = [K.delaunay_edges(p) for p in cases]
    assert sum(old(p).sum() for p in cases[:40]) < 40 * 24 * 24 / 2
    try:
        K.possible_edges = lambda p: np.ones((len(p), len(p)), bool)
        assert got == [K.delaunay_edges(p) for p in cases]
    finally:
        K.possible_edges = old


def test_f10_shots_go_through_the_kernel_in_batches(spark):
    import numpy as np

    from matchloom.operators import kernels as K
    from matchloom.operators import tracking as T

    text = plan(entry_points.queries()["l04_shot_anomalies"](spark, DIR))
    assert "FlatMapGroupsInPandas" not in text and "Broadcast" not in text
    r, shots, ball, want = np.random.default_rng(5), [], [], {}
    for i in range(30):
        n = int(r.integers(0, 60))
        at = np.cumsum(r.normal(0, 2 if i % 3 else 0.1, (n, 2)), 0) + (100, 31)
        at[r.random(n) < 0.1] = np.nan
        shots.append((i % 4, i, i * 100, i * 100 + 50))
        ball += [(i % 4, i * 100 + f, *map(float, at[f])) for f in r.permutation(min(n, 51)).tolist()]
        want[i] = tuple(map(bool, K.shot_anomaly(at[:51], 50)))
    got = T.shot_anomalies(spark.createDataFrame(shots, "match_id long, action_id long, frame_id long, receive_frame_id long"), spark.createDataFrame(ball, "match_id long, frame_id long, x double, y double"))
    assert {q.action_id: (q.anomaly, q.woodwork) for q in got.collect()} == want and len(set(want.values())) > 1


def test_f21_snapshots_without_lambdas_over_numbers(spark):
    """Players are written out, and graphs are made as arrays: neither is interpreted value by value."""
    from matchloom.plans import lens, q_networks

    a = lens.raw_actions(spark, DIR)
    assert "lambda" not in plan(a.select(lens.players().alias("players")))
    made = plan(q_networks.graphs(spark, DIR))
    assert "flatten" not in made and "MapInArrow" in made


def test_f27_snapshot_values_are_dealt_out_once(spark):
    """Both sides come from rows dealt out by their key, so nothing unfolded is shuffled."""
    from matchloom.operators import components

    text = plan(entry_points.queries()["c13_snapshot_values"](spark, DIR))
    assert "option#" not in "".join(line for line in text.splitlines() if "Exchange" in line)
    c = spark.createDataFrame([(1, "a", 0.1, 0.5, 0.4, 0.1, 0.2, 0.1), (1, "b", 0.1, 0.5, 0.4, 0.1, 0.2, 0.1), (2, "a", 0.1, 0.5, 0.4, 0.1, 0.2, 0.1)], "k long, option string, select_p double, success_p double, s_score double, s_concede double, f_score double, f_concede double")
    there = spark.createDataFrame([(1, "b"), (1, "b"), (3, "a")], "k long, option string")
    assert [(r.k, r.option) for r in components.snapshot_values(c, "k", there).collect()] == [(1, "b")]


def test_f20_possessions_touch_few_buckets(spark):
    """Long possessions are dealt to buckets as long as they are; the bucket's length changes no result."""
    from matchloom.operators import tracking

    assert "/ 200000" in plan(entry_points.queries()["n32_possession_view"](spark, DIR))
    frames = spark.createDataFrame([(1, f, "home_1" if f % 2 else "ball", float(f), 1.0) for f in range(0, 3000, 7)], "match_id long, frame_id long, object_id string, x double, y double")
    spans = spark.createDataFrame([(1, 1, "home", False, 0, 900), (1, 2, "away", True, 499, 2600)], "match_id long, possession_id long, team string, right_to_left boolean, frame_start long, frame_end long")
    few = rows(tracking.possession_view(frames, spans))
    assert len(few) > 400 and few == rows(tracking.possession_view(frames, spans, 2000)) == rows(tracking.possession_view(frames, spans, 10))


def test_f19_destinations_without_rows_for_players(spark):
    """Cells come out of arrays: no row a cell and player, no shuffle after the rows are dealt out; sides without players and unknown possessors give nulls."""
    from matchloom.functions import geometry as G
    from matchloom.operators import features as X

    text = plan(entry_points.queries()["g18_destination_features"](spark, DIR))
    assert text.count("Exchange") == 1 and "Aggregate" not in text
    player = lambda o, name, team, x, y, goal=False: (o, name, team, False, goal, x, y, 0.0, 0.0, 0.0)
    data = [
        (1, "home", "home_1", [player(1, "home_1", "home", 10.0, 10.0), player(2, "home_2", "home", 50.0, 30.0), player(12, "away_1", "away", 90.0, 60.0), player(13, "away_2", "away", None, 1.0)]),
        (2, "away", "nobody", [player(1, "home_1", "home", 10.0, 10.0), player(24, "away_goal", "away", 0.0, 34.0, True)]),
        (3, "home", "home_1", [player(24, "away_goal", "away", 0.0, 34.0, True)]),
        (4, "home", "home_1", []),
    ]
    kind = "array<struct<ordinal int, object_id string, team string, keeper boolean, goal boolean, x double, y double, vx double, vy double, accel double>>".replace(" ", ":").replace(",:", ",")
    s = X.oriented(spark.createDataFrame(data, f"event_id long, team string, object_id string, players {kind}"))
    got = {(r.event_id, r.cell): r for r in X.destination_features(s, 12, 8).collect()}
    assert {e for e, _ in got} == {1, 2} and len(got) == 192
    flat = s.where("event_id < 3").select("event_id", "poss", F.explode(G.grid_cells(12, 8)).alias("c"), "players").select("event_id", "poss", "c", F.explode(F.filter("players", lambda q: ~q["goal"])).alias("o"))
    c, o, p = F.col("c"), F.col("o"), F.col("poss")
    gap, lane = G.distance(c["x"], c["y"], o["x"], o["y"]), G.segment_distance(p["x"], p["y"], c["x"], c["y"], o["x"], o["y"])
    want = flat.groupBy("event_id", "c", "poss").agg(F.min(F.when(o["teammate"], gap)).alias("m"), F.min(F.when(~o["teammate"], gap)).alias("r"), F.min(F.when(~o["teammate"] & p.isNotNull(), lane)).alias("l")).collect()
    assert len(want) == 192
    for w in want:
        r = got[w.event_id, w.c.cell]
        offset = (None, None) if w.poss is None else (w.c.x - w.poss.x, w.c.y - w.poss.y)
        for a, b in zip((r.x, r.y, r.dx, r.dy, r.nearest_teammate, r.nearest_opponent, r.lane_opponent), (w.c.x, w.c.y, *offset, w.m, w.r, w.l), strict=True):
            assert a == (None if b is None else pytest.approx(b, abs=1e-9))


def test_f14_ways_are_told_once_a_leg(spark):
    """Ways of drawn objects are worked out before their legs are cut into frames, so that a frame only goes along."""
    from matchloom.plans import q_tracking

    _, tracking = q_tracking.drawn(spark, DIR)
    text = plan(tracking)
    assert 0 < text.index("Generate explode") < text.index("Generate inline") < text.index("POWER")
    few = tracking.where("frame_id < 200").groupBy("match_id", "frame_id").agg(F.collect_set("object_id").alias("who"), F.count("*").alias("n"), F.sum(F.when(F.col("object_id") == "ball", F.col("z"))).alias("z"), F.max("accel_v").alias("sharp")).collect()
    assert few and all(r.n == len(r.who) == 1 + 2 * q_tracking.SIDE for r in few)
    step = lambda r: (r.frame_id - 10) % q_tracking.APART
    assert all(r.sharp == (15.0 if step(r) == 0 else 0.0) and r.z == pytest.approx(4 * step(r) / q_tracking.APART * (1 - step(r) / q_tracking.APART)) for r in few)


def test_f2_tracking_of_the_baseline_stays_with_its_match(spark, monkeypatch):
    """Joins within matches leave tracking where it is; the session's setting is as before."""
    from matchloom.operators import baseline_sync as B
    from matchloom.plans import q_tracking as Q

    plans, kind = [], type(spark.range(1))
    plain = kind.checkpoint

    def seen(df, *a):
        out = plain(df, *a)
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1])
        return out

    monkeypatch.setattr(kind, "checkpoint", seen)
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    out = B.synced(*Q.played(spark, "/root/testdata/sf0.001"), fps=5)
    assert out.count() == 1000 and spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    dealt = [line for line in plans[0].splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not [line for line in dealt if "object_id#" in line.split("hashpartitioning")[1] or "_bucket#" in line.split("hashpartitioning")[1]]


def test_f8_drawn_tracking_stays_with_its_match(spark):
    """Only the table's own rows are dealt out, before tracking is drawn from them."""
    from matchloom.plans import q_tracking as Q

    plan = Q.synced_events(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    before, after = plan.split("Union", 1)
    assert "Exchange" not in before and "MapInArrow" in before and after.count("Exchange hashpartitioning(match_id") == after.count("Exchange") == 2
    assert all("Generate" not in branch.split("Exchange", 1)[1] for branch in after.split("FileScan")[:-1])
