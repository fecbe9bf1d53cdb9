"""Vendor frames in splits, the synchroniser's tracks and checked artefacts, beside plain code."""

import math
import os
import random
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import external, kernels, tracking
from matchloom.sources import artefacts, readers


def positions(folder, frames=400):
    r = random.Random(1)
    text = ['<?xml version="1.0" encoding="utf-8"?>\n<PutDataRequest>\n <MetaData Type="x"/>\n <Positions>\n']
    for section, start in (("firstHalf", 10_000), ("secondHalf", 100_000)):
        for team, person in (("BALL", "BALL"), ("T1", "P1"), ("T1", "P2"), ("T2", "P3"), ("T2", "P9")):
            text.append(f'  <FrameSet GameSection="{section}" MatchId="M1" TeamId="{team}" PersonId="{person}">\n')
            for i in range(frames):
                if person != "BALL" and 100 <= i < 110 or r.random() < 0.05:
                    continue
                left = {"P1": -45, "P2": -10, "P3": 40, "P9": 5, "BALL": 0}[person] * (1 if section == "firstHalf" else -1)
                z = f' Z="{r.uniform(0, 3):.2f}"' if person == "BALL" else ""
                text.append(f'   <Frame N="{start + i}" T="2024-07-01T15:{i // 1500:02d}:{i % 1500 / 25:06.3f}+02:00" X="{left + r.uniform(-5, 5):.2f}" Y="{r.uniform(-30, 30):.2f}"{z} S="{r.uniform(0, 20):.2f}"{r.choice(["/", " /"])}>\n')
            text.append("  </FrameSet>\n")
    path = folder / "positions.xml"
    path.write_text("".join(text) + " </Positions>\n</PutDataRequest>\n")
    return str(path)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_frames_in_splits(spark, tmp_path, small_splits):
    path = positions(tmp_path)
    got = readers.frames_xml(spark, path)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and os.path.getsize(path) > 10 * 20_000
    want = []
    for s in ET.parse(path).getroot().iter("FrameSet"):
        want += [(s.get("MatchId"), 1 if s.get("GameSection") == "firstHalf" else 2, s.get("TeamId"), s.get("PersonId"), int(f.get("N")), float(f.get("X")), float(f.get("Y")), None if f.get("Z") is None else float(f.get("Z")), float(f.get("S"))) for f in s]
    rows = got.select("match_id", "period_id", "team_id", "player_id", "frame_id", "x", "y", "z", "speed").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert str(got.where("frame_id = 10002 AND player_id = 'P1'").first().utc_timestamp) == "2024-07-01 13:00:00.080000"
    # what the reader of whole frame sets gives, from the corner
    old = readers.tracking_xml(spark, path).select("period_id", "player_id", "frame_id", "utc_timestamp", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    new = got.select("period_id", "player_id", "frame_id", "utc_timestamp", F.round(F.col("x") + 52.5, 6).alias("x"), F.round(F.col("y") + 34, 6).alias("y"))
    assert old.exceptAll(new).count() == 0 and new.exceptAll(old).count() == 0


def test_vendor_tracking(spark, tmp_path, small_splits):
    path = positions(tmp_path)
    lineup = spark.createDataFrame([("M1", "P1", "home_1"), ("M1", "P2", "home_9"), ("M1", "P3", "away_4")], "match_id string, player_id string, object_id string")
    frames = readers.frames_xml(spark, path)
    out = external.vendor_tracking(frames, lineup, length=110.0, width=70.0)
    got = {(r.period_id, r.object_id, r.frame_id): r for r in out.collect()}
    names = {"P1": "home_1", "P2": "home_9", "P3": "away_4", "P9": "P9", "BALL": "ball"}
    raw = [(r.period_id, names[r.player_id], r.frame_id, r.x, r.y) for r in frames.collect()]
    seen = {(p, f) for p, o, f, _, _ in raw if o[:4] in ("home", "away")}
    want = {}
    for p, o, f, x, y in raw:
        if (p, f) in seen:
            x, y = (x / 110 + 0.5) * 105, (y / 70 + 0.5) * 68
            want[p, o, f] = (105 - x, 68 - y) if p == 2 else (x, y)
    assert set(got) == set(want) and all((got[k].x, got[k].y) == pytest.approx(v) for k, v in want.items())
    assert not any(f in range(10_100, 10_110) for _, _, f in got)
    assert all(r.timestamp == pytest.approx((r.frame_id - (10_000 if r.period_id == 1 else 100_000)) / 25, abs=2e-3) for r in got.values())
    events = spark.createDataFrame([("M1", 1, "e1", -52.5, 10.0), ("M1", 2, "e2", -52.5, 10.0), ("M2", 1, "e3", 0.0, 0.0)], "match_id string, period_id int, event_id string, x double, y double")
    sides = tracking.home_is_left(external.rescaled(frames, 110.0, 70.0).join(lineup, ["match_id", "player_id"]))
    turned = {r.event_id: (r.x, r.y) for r in external.reoriented_events(events, sides).collect()}
    assert turned == {"e1": (0.0, 44.0), "e2": (105.0, 24.0), "e3": (52.5, 34.0)}


def plain_track(rows, fps=25, apart=None):
    """Frames (frame, x, y) of one object and period, segment by segment."""
    out, segments = {}, [[]]
    for i, r in enumerate(rows):
        if i and apart is not None and r[0] - rows[i - 1][0] >= apart:
            segments.append([])
        segments[-1].append(r)

    def fit(v, window):
        n, m = len(v), window // 2
        return [float(np.polynomial.Polynomial.fit(np.arange(window), v[(a := min(max(i - m, 0), n - window)) : a + window], 2)(i - a)) for i in range(n)]

    for s in segments:
        n = len(s)
        if n < 16:
            out |= {r[0]: (None,) * 3 for r in s}
            continue
        vx, vy = (fit([(s[i + 1][c] - s[i][c]) * fps for i in range(n - 1)], 15) for c in (1, 2))
        speed = [math.hypot(a, b) for a, b in zip(vx, vy)]
        whole = [speed[0], *speed]
        if n < 11:
            continue
        cs, ax, ay = (fit([(v[i + 1] - v[i]) * fps for i in range(n - 2)], 9) for v in (speed, vx, vy))
        av = [math.hypot(a, b) for a, b in zip(ax, ay)]
        out |= {r[0]: (whole[i], [cs[0], *cs, cs[-1]][i], [av[0], *av, av[-1]][i]) for i, r in enumerate(s)}
    return out


@pytest.mark.parametrize("apart", [None, 5])
def test_synchroniser_tracks(spark, apart):
    r = random.Random(2)
    rows, want = [], {}
    for match in (1, 2):
        for o in ("home_1", "away_2", "ball"):
            x, y, own, f = 50.0, 30.0, {1: [], 2: []}, 0
            for _ in range(120):
                f += r.choice([1, 1, 1, 1, 1, 1, 3, 40]) if r.random() < 0.2 else 1
                x, y = x + r.uniform(-0.5, 0.5), y + r.uniform(-0.5, 0.5)
                period, state = 1 + (f > 90), "dead" if r.random() < 0.2 else "alive"
                place = None if r.random() < 0.05 else x
                rows.append((match, period, o, f, place, y, 1.234, state))
                if place is not None:
                    own[period].append((f, float(np.round(place, 2)), float(np.round(y, 2)), state))
            for period, fs in own.items():
                got = plain_track([(a, b, c) for a, b, c, _ in fs], apart=apart)
                want |= {(match, period, o, a): (b, c, got[a]) for a, b, c, state in fs if state == "alive"}
    df = spark.createDataFrame(r.sample(rows, len(rows)), "match_id int, period_id int, object_id string, frame_id int, x double, y double, z double, ball_state string")
    got = {(q.match_id, q.period_id, q.object_id, q.frame_id): q for q in tracking.synchroniser_tracks(df, apart=apart).collect()}
    assert set(got) == set(want)
    for k, (x, y, motion) in want.items():
        q = got[k]
        assert (q.x, q.y, q.z) == pytest.approx((x, y, 1.23 if k[2] == "ball" else None))
        for a, b in zip((q.speed, q.accel_s, q.accel_v), motion):
            assert a is None if b is None else a == pytest.approx(b, abs=1e-6)
    assert any(m[2][0] is None for m in want.values()) == (apart is not None) or apart is None
    assert tracking.synchroniser_tracks(df.limit(0)).count() == 0
    short = kernels.sync_kinematics(np.arange(5.0), np.zeros(5))
    assert all(np.isnan(v).all() for v in short.values())


def test_artefacts_are_rebuilt(spark, tmp_path):
    path, built = str(tmp_path / "features" / "M1"), []
    os.makedirs(tmp_path / "features")

    def build():
        built.append(1)
        return spark.range(300).select("id", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (i + F.col("id")).cast("double")).alias("x")).repartition(3)

    def use(**more):
        rows, why = artefacts.ensure(spark, path, build, "x", (2, 3), **more)
        assert rows.count() == 300 and rows.where("id = 7").first().x == [7.0, 8.0, 9.0, 10.0, 11.0, 12.0]
        return why

    assert use() == "no manifest" and use() is None and use(deep=False) is None and len(built) == 1
    part = next(f for f in sorted(os.listdir(path)) if f.endswith(".parquet"))
    for harm, why in (("cut", "files changed"), ("gone", "files changed"), ("bytes", "unreadable"), ("manifest", "no manifest")):
        file = os.path.join(path, next(f for f in sorted(os.listdir(path)) if f.endswith(".parquet")))
        for crc in [f for f in os.listdir(path) if f.endswith(".crc")]:
            os.remove(os.path.join(path, crc))
        data = open(file, "rb").read()
        if harm == "cut":
            open(file, "wb").write(data[: len(data) // 2])
        elif harm == "gone":
            os.remove(file)
        elif harm == "bytes":
            open(file, "wb").write(b"x" * len(data))
        else:
            open(os.path.join(path, artefacts.MANIFEST), "w").write("{")
        assert use() == why, harm
    assert part and len(built) == 5 and use(overwrite=True) == "overwrite"
    # arrays of another shape leave what is there
    with pytest.raises(ValueError, match="shape"):
        artefacts.write_arrays(spark.range(3).select("id", F.array(F.lit(1.0)).alias("x")), path, "x", (2, 3))
    assert use() is None and sorted(os.listdir(tmp_path / "features")) == ["M1"]
    assert artefacts.fault(spark, path, "x", (6,)) == "another shape"
    empty = str(tmp_path / "none")
    assert artefacts.ensure(spark, empty, lambda: build().limit(0), "x", (2, 3))[0].count() == 0 and artefacts.fault(spark, empty, "x", (2, 3)) is None
