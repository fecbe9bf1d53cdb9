"""Readers, sinks and streams on small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from matchloom.sources import readers, sinks
from matchloom.streaming import events as stream

INFO = """<?xml version="1.0"?><Root><MatchInformation><General MatchId="M1" KickoffTime="2024-01-01T15:00:00+01:00"/><Teams>
<Team TeamId="T1" TeamName="Reds" Role="home"><Players><Player PersonId="P1" ShirtNumber="1" Shortname="A" PlayingPosition="TW" Starting="true"/><Player PersonId="P2" ShirtNumber="9" Shortname="B" PlayingPosition="STZ" Starting="false"/></Players></Team>
<Team TeamId="T2" TeamName="Blues" Role="guest"><Players><Player PersonId="P3" ShirtNumber="4" Shortname="C" PlayingPosition="XX" Starting="true"/></Players></Team></Teams></MatchInformation></Root>"""
EVENTS = """<?xml version="1.0"?><Root><Event EventId="0" EventTime="2024-07-01T14:59:59+02:00" MatchId="M1"><KickOff GameSection="firstHalf"><Play Team="T1" Player="P1" Recipient="P2" Evaluation="successfullyCompleted"><Pass/></Play></KickOff></Event>
<Event EventId="1" EventTime="2024-07-01T15:00:00.500+02:00" MatchId="M1" X-Position="1.5" Y-Position="2.5"><Play Player="P1" Team="T1" Evaluation="unsuccessful" Recipient="P2"><Cross/></Play></Event>
<Event EventId="2" EventTime="2024-07-01T15:00:01+02:00" MatchId="M1" X-Source-Position="9"><ShotAtGoal Player="P2" Team="T1" xG="0.25" TypeOfShot="head"><SavedShot GoalKeeper="P3"/></ShotAtGoal></Event><Event EventId="3" EventTime="2024-07-01T15:00:02+02:00" MatchId="M1"><Delete/></Event>
<Event EventId="5" EventTime="2024-07-01T15:00:02+02:00" MatchId="M1"><FreeKick><ShotAtGoal Player="P2" Team="T1" xG="0.1" TypeOfShot="leftLeg"><SuccessfulShot/></ShotAtGoal></FreeKick></Event>
<Event EventId="6" EventTime="2024-07-01T15:00:02.1+02:00" MatchId="M1"><TacklingGame WinnerTeam="T2" Winner="P3" Loser="P1" Type="ground" PossessionChange="true"/></Event><Event EventId="7" EventTime="2024-07-01T15:00:02.2+02:00" MatchId="M1"><Foul TeamFouler="T2" Fouler="P3" Fouled="P1" FoulType="pull"/></Event>
<Event EventId="8" EventTime="2024-07-01T15:00:02.3+02:00" MatchId="M1"><Caution Team="T2" Player="P3" CardColor="red"/></Event><Event EventId="9" EventTime="2024-07-01T15:00:02.4+02:00" MatchId="M1"><Substitution Team="T1" PlayerOut="P1" PlayerIn="P4"/></Event>
<Event EventId="004" EventTime="2024-07-01T15:00:03+02:00" MatchId="M1"><FinalWhistle GameSection="firstHalf"/></Event><Event EventId="10" EventTime="2024-07-01T15:10:00+02:00" MatchId="M1"><BallClaiming Type="InterceptedBall" Player="P1" Team="T1"/></Event></Root>"""
TRACKS = """<?xml version="1.0"?><Root><FrameSet MatchId="M1" GameSection="firstHalf" TeamId="BALL" PersonId="B"><Frame N="10" T="2024-07-01T15:00:00+02:00" X="-52.5" Y="34" Z="0.1" S="3"/><Frame N="11" T="2024-07-01T15:00:00.040+02:00" X="0" Y="0" Z="0" S="3"/></FrameSet></Root>"""


def put(folder, name, text, encoding="utf-8"):
    p = folder / name
    p.write_text(text, encoding=encoding)
    return str(p)


def test_xml(spark, tmp_path):
    lineup = {r.player_id: r for r in readers.lineup_xml(spark, put(tmp_path, "i.xml", INFO)).collect()}
    assert lineup["P1"].object_id == "home_1" and lineup["P1"].advanced_position == "goal_keeper" and lineup["P3"].object_id == "away_4" and lineup["P3"].advanced_position == "unknown" and not lineup["P2"].starting
    ev = {r.event_id: r for r in readers.with_periods(readers.events_xml(spark, put(tmp_path, "e.xml", EVENTS))).collect()}
    assert {k: r.event_type for k, r in ev.items()} == {"0": "Pass", "1": "Cross", "2": "Shot", "5": "Shot", "6": "GroundDuel", "7": "Foul", "8": "Card", "9": "Substitution", "004": "FinalWhistle", "10": "Interception"}
    assert {k: r.period_id for k, r in ev.items()} == {k: int(k != "10") for k in ev}
    assert ev["2"].expected_goal == 0.25 and (ev["2"].result, ev["2"].receiver_player_id, ev["2"].body_part_type, ev["2"].success, ev["2"].coordinates_x) == ("Saved", "P3", "Head", False, 9.0)
    assert (ev["5"].set_piece_type, ev["5"].result, ev["5"].success, ev["5"].body_part_type) == ("FreeKick", "Goal", True, "LeftFoot") and ev["0"].success and ev["0"].set_piece_type == "KickOff" and ev["1"].success is False
    assert (ev["6"].player_id, ev["6"].receiver_player_id, ev["6"].result) == ("P3", "P1", "PossessionChange") and (ev["7"].team_id, ev["7"].result) == ("T2", "pull") and ev["8"].card_type == "Red" and (ev["9"].player_id, ev["9"].receiver_player_id) == ("P1", "P4")
    assert str(ev["1"].utc_timestamp) == "2024-07-01 13:00:00.500000" and ev["1"].coordinates_x == 1.5
    t = readers.tracking_xml(spark, put(tmp_path, "t.xml", TRACKS)).orderBy("frame_id").collect()
    assert [(r.frame_id, r.period_id, r.x, r.y, r.z) for r in t] == [(10, 1, 0.0, 68.0, 0.1), (11, 1, 52.5, 34.0, 0.0)]


def test_provider_csv(spark, tmp_path):
    text = "EVENT_ID;PUID2;GDCP_EVENT_TIME;TRACKING_TIME;FRAME_NUMBER;RECFRM;NORECEIVER;XG\n1;Müller;2024-01-01 10:00:00;x;12;;TRUE;0,25\n1;later;;;13;;FALSE;0,5\n2;;;;;15;;\n"
    rows = {r.event_id: r for r in readers.provider_csv(spark, put(tmp_path, "k.csv", text, "cp1252")).collect()}
    assert rows["1"].receiver_player_id == "Müller" and rows["1"].frame_id == 12 and rows["1"].no_receiver and rows["1"].expected_goal == 0.25 and rows["1"].tracking_time is None
    assert rows["2"].receive_frame_id == 15 and rows["2"].no_receiver is None


def test_json(spark, tmp_path):
    meta = {"id": 5, "home_team": {"id": 1}, "away_team": {"id": 2}, "players": [{"id": 7, "team_id": 1, "number": 1, "short_name": "A", "player_role": {"acronym": "GK", "name": "Goalkeeper"}}, {"id": 8, "team_id": 2, "number": 10, "short_name": "B", "player_role": {"acronym": "CF", "name": "Forward"}}]}
    got = {r.player_id: (r.object_id, r.keeper) for r in readers.match_json(spark, put(tmp_path, "m.json", json.dumps(meta, indent=1))).collect()}
    assert got == {7: ("home_1", True), 8: ("away_10", False)}
    lines = [{"match_id": 5, "frame": 0, "ball_state": None, "ball_data": {"x": 0.0, "y": 0.0, "z": 0.0}, "player_data": [{"player_id": 7, "x": 1.0, "y": 2.0}]}, {"match_id": 5, "frame": 1, "period": 1, "ball_state": "dead", "ball_data": None}]
    rows = readers.tracking_jsonl(spark, put(tmp_path, "t.jsonl", "\n".join(map(json.dumps, lines)))).orderBy("frame_id", "ball").collect()
    assert [(r.frame_id, r.period_id, r.ball_state, r.ball, r.x) for r in rows] == [(0, 1, "alive", False, 53.5), (0, 1, "alive", True, 52.5), (1, 1, "dead", True, None)]
    m = readers.manifest(spark, put(tmp_path, "s.json", json.dumps({"train": ["a", "b", "a"], "test": ["c"]})))
    assert sorted((r.split, r.match_id, r.position) for r in m.collect()) == [("test", "c", 0), ("train", "a", 0), ("train", "b", 1)]


def test_checked_csv_and_overlaps(spark, tmp_path):
    head = ",".join(readers.POSSESSIONS)
    good = put(tmp_path, "p.csv", f"{head}\n1,0,1,5,1,7,player_possession,left\n1,1,6,9,1,8,player_possession,left\n1,2,x,9,1,8,pass,left\n")
    assert readers.possession_events(spark, good).count() == 2
    bad = put(tmp_path, "q.csv", f"{head}\n1,0,1,5,1,7,player_possession,left\n1,1,4,9,1,8,player_possession,left\n")
    with pytest.raises(ValueError, match="overlap"):
        readers.possession_events(spark, bad)
    with pytest.raises(ValueError, match="frame_end"):
        readers.checked_csv(spark, put(tmp_path, "r.csv", "match_id,index\n1,2\n"), readers.POSSESSIONS)


def test_discovery(spark, tmp_path):
    for folder, names in (("meta", ("a", "b")), ("events", ("a", "c"))):
        os.mkdir(tmp_path / folder)
        for n in names:
            put(tmp_path / folder, f"{n}.xml", "<x/>")
    got = {r.match_id: r.skip_reason for r in readers.discovered(spark, {"meta": str(tmp_path / "meta"), "events": str(tmp_path / "events")}).collect()}
    assert got == {"a": None, "b": "missing events", "c": "missing meta"}


def test_squad_rows_and_money(spark):
    page = "<table><tr><th>Name</th><th>Value</th></tr><tr><td><a href=x>Ann&nbsp;B</a></td><td>&euro;1.50m</td></tr></table>"
    rows = readers.squad_rows(spark.createDataFrame([(1, page), (2, None), (3, "<p>x</p>")], "page_id long, html string")).collect()
    assert [(r.row, r.cells) for r in rows] == [(0, ["Name", "Value"]), (1, ["Ann B", "&euro;1.50m"])]
    amounts = spark.createDataFrame([("EUR 1.50m",), ("300k",), ("-",)], "t string").select(readers.money("t").alias("v")).collect()
    assert [r.v for r in amounts] == [1.5e6, 3e5, None]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "home_2", 0.5), (2, "home_3", 0.25)], "match_id long, option string, value double")
    path = str(tmp_path / "t")
    assert sinks.write_table(d, path) and not sinks.write_table(d, path, skip_existing=True)
    assert sinks.write_table(d.where("match_id = 1").withColumn("value", F.lit(9.0)), path)
    assert {(r.match_id, r.value) for r in spark.read.parquet(path).collect()} == {(1, 9.0), (2, 0.25)}
    sinks.append_results(d, str(tmp_path / "r"), "a")
    sinks.append_results(d, str(tmp_path / "r"), "b")
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4
    sinks.write_record(spark, {"done": 2}, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"done": 2}
    long = sinks.components_long({"select": d, "score": d}, ["match_id"])
    assert long.count() == 4 and sinks.wide_export(d, ["match_id"], ["home_2", "home_3"]).where("match_id = 2").first().home_3 == 0.25
    sinks.write_csv(d, str(tmp_path / "c"), "match_id")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-01 10:{m:02d}:00", m, "pass" if m % 2 else "shot", float(m), "kick" if m == 1 else None) for m in (1, 2, 3, 20, 21)] + [(1, "2024-01-02 10:00:00", 99, "pass", 0.0, None)]
    d = spark.createDataFrame(rows, "match_id long, t string, event_id long, spadl_type string, value double, label string").select("match_id", F.col("t").cast("timestamp").alias("ts"), "event_id", "spadl_type", "value", "label")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(name, make, mode="append"):
        s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
        q = make(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.table(name).collect()

    got = run("episodes", stream.session_episodes)
    assert sorted((r.n, r.total) for r in got) == [(2, 41.0), (3, 6.0)]
    assert sum(r.n for r in run("counts", stream.windowed_counts)) == 5
    filled = {r.event_id: r.label for r in run("filled", stream.filled_stream)}
    assert filled[1] == "kick" and filled[21] == "kick" and len(filled) == 6
