"""Every query beside its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return f"[{','.join(map(plain, v))}]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, DIR)
    names = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        return
    got = duck.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(columns) == names
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() >= 0


def test_destination_grid_is_whole(spark):
    from matchloom.operators import features as X
    from matchloom.plans.q_features import snapshots

    s = snapshots(spark, DIR)
    assert spark.read.parquet(f"{DIR}/events.parquet").count() == entry_points.queries()["g18_destination_grid"](spark, DIR).where("size(nearest_teammate) = 7140 AND size(lane_opponent) = 7140 AND size(dx) = 105 AND size(dy) = 68").select("event_id").distinct().count()
    some = s.where("event_id % 97 = 0 AND spadl_type <> 'shot'")
    grid = {r.event_id: r for r in X.destination_grid(some).collect()}
    cells = X.destination_features(some, 105, 68).where("cell % 61 = 0").collect()
    assert len(grid) > 3 and len(cells) == len(grid) * 118
    for r in cells:
        g = grid[r.event_id]
        got = (g.dx[r.cell % 105], g.dy[r.cell // 105], g.nearest_teammate[r.cell], g.nearest_opponent[r.cell], g.lane_opponent[r.cell])
        assert got == pytest.approx((r.dx, r.dy, r.nearest_teammate, r.nearest_opponent, r.lane_opponent), abs=1e-9)


def test_delaunay_edges_of_every_action(spark):
    from matchloom.functions import geometry as G
    from matchloom.plans import lens

    rows = entry_points.queries()["g11_delaunay_edges"](spark, DIR).collect()
    edges = {}
    for r in rows:
        edges.setdefault(r.event_id, set()).add((r.source, r.target))
    a = G.held(lens.raw_actions(spark, DIR), players=lens.players())
    assert len(edges) == a.count() and {x for e in edges.values() for pair in e for x in pair} == set(range(1, 25))

    def half(points):
        out = []
        for x, y in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) < (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out[:-1]

    # a triangulation of n points with h of them on its rim has 3n - 3 - h edges, in both directions here
    for s in a.where("event_id % 7 = 0").select("event_id", "players").collect():
        at = sorted({(round(p["x"] * 100), round(p["y"] * 100)) for p in s.players})
        if len(at) == 24:
            assert len(edges[s.event_id]) == 2 * (3 * 24 - 3 - len(half(at)) - len(half(at[::-1])))


def test_graphs_of_every_action(spark):
    n = spark.read.parquet(f"{DIR}/events.parquet").count()
    q = entry_points.queries()
    for name, key in (("g08_graph_edges", "source"), ("m04_graph_selection", "ordinal"), ("m05_graph_posteriors", "option")):
        assert q[name](spark, DIR).select("event_id").distinct().count() == n, name


def test_phases_of_both_periods(spark, duck):
    whole = entry_points.queries()["w05_phases_of_periods"](spark, DIR)
    assert {r.period_id for r in whole.select("period_id").distinct().collect()} == {1, 2}
    from matchloom.plans.lens import with_actions

    # every frame of the table between a match's period's first and last is in exactly one phase, if a player is on
    a = duck.execute(with_actions("SELECT match_id, period_id, frame_id FROM a")).fetchall()
    spans = {}
    for r in whole.collect():
        spans.setdefault((r.match_id, r.period_id), []).append((r.start_frame, r.end_frame))
    assert all(sum(s <= f <= e for s, e in spans[m, p]) == 1 for m, p, f in a)


def test_every_shot_is_judged(spark):
    out = entry_points.queries()["l04_shot_anomalies"](spark, DIR).collect()
    shots = spark.read.parquet(f"{DIR}/events.parquet").where("event_type = 'purchase'").count()
    assert len(out) == len({(r.match_id, r.action_id) for r in out}) == shots
    assert {r.anomaly for r in out} == {True, False}
