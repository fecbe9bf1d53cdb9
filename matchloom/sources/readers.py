"""Readers: vendor XML, delimited provider files, JSON and JSON lines, and the domain's Parquet tables, with declared schemas.

Paths go to Spark's readers only, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vendor position codes and their names; no code is unknown.
POSITIONS = {
    "TW": "goal_keeper",
    "IVR": "center_back",
    "IVL": "center_back",
    "IVZ": "center_back",
    "RV": "right_back",
    "LV": "left_back",
    "DMR": "defensive_midfielder",
    "DRM": "defensive_midfielder",
    "DML": "defensive_midfielder",
    "DLM": "defensive_midfielder",
    "DMZ": "defensive_midfielder",
    "HR": "central_midfielder",
    "HL": "central_midfielder",
    "MZ": "central_midfielder",
    "RM": "right_midfielder",
    "LM": "left_midfielder",
    "OHR": "attacking_midfielder",
    "OHL": "attacking_midfielder",
    "ORM": "attacking_midfielder",
    "OLM": "attacking_midfielder",
    "ZO": "attacking_midfielder",
    "RA": "right_winger",
    "LA": "left_winger",
    "STR": "striker",
    "STL": "striker",
    "STZ": "striker",
}

LINEUP = T.StructType(
    [T.StructField(n, t) for n, t in (("match_id", T.StringType()), ("contestant_name", T.StringType()), ("player_id", T.StringType()), ("object_id", T.StringType()), ("shirt_number", T.IntegerType()), ("match_name", T.StringType()), ("advanced_position", T.StringType()), ("starting", T.BooleanType()))]
)


def position_name(code):
    """Name of a position code; unknown codes are unknown."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in POSITIONS.items() for x in kv])[code], F.lit("unknown"))


def lineup_xml(spark: SparkSession, path: str) -> DataFrame:
    """Line-up rows of match-information XML: one row per player of both teams, home first by the Role attribute."""
    player = "array<struct<_PersonId:string,_ShirtNumber:int,_Shortname:string,_PlayingPosition:string,_Starting:boolean>>"
    schema = f"General struct<_MatchId:string,_KickoffTime:string>, Teams struct<Team:array<struct<_TeamId:string,_TeamName:string,_Role:string,Players:struct<Player:{player}>>>>"
    rows = spark.read.format("xml").option("rowTag", "MatchInformation").schema(schema).load(path)
    teams = rows.select(F.col("General._MatchId").alias("match_id"), F.explode("Teams.Team").alias("t"))
    side = F.when(F.col("t._Role") == "home", "home").otherwise("away")
    p = teams.select("match_id", F.col("t._TeamName").alias("contestant_name"), side.alias("side"), F.explode("t.Players.Player").alias("p"))
    return p.select(
        "match_id", "contestant_name", F.col("p._PersonId").alias("player_id"), F.concat_ws("_", "side", F.col("p._ShirtNumber").cast("string")).alias("object_id"), F.col("p._ShirtNumber").alias("shirt_number"),
        F.col("p._Shortname").alias("match_name"), position_name(F.col("p._PlayingPosition")).alias("advanced_position"), F.coalesce("p._Starting", F.lit(False)).alias("starting"),
    )


_PLAY = "struct<_Team:string,_Player:string,_Recipient:string,_Evaluation:string,Pass:string,Cross:string>"
_SHOT = "struct<_Team:string,_Player:string,_TypeOfShot:string,_xG:double,ShotWide:string,SavedShot:struct<_GoalKeeper:string>,BlockedShot:struct<_Player:string>,ShotWoodWork:string,SuccessfulShot:string>"
_OTHER = (
    "struct<_Team:string,_Player:string,_WinnerTeam:string,_Winner:string,_Loser:string,_PossessionChange:string,_Type:string,_DefensiveClearance:string,_TeamFouler:string,_Fouler:string,_Fouled:string,_FoulType:string,"
    "_CardColor:string,_PlayerOut:string,_PlayerIn:string,_VALUE:string>"
)
# Element names of event files.
SET_PIECES = ("KickOff", "ThrowIn", "GoalKick", "CornerKick", "FreeKick", "Penalty", "FinalWhistle")
OTHER_KINDS = ("TacklingGame", "BallClaiming", "OtherBallAction", "Foul", "Caution", "Substitution", "Offside", "VideoAssistantAction", "Delete")


def _play(c):
    """(type, team, player, receiver, result, success, body part) of a play or of a shot; null if it has neither."""
    p, s = c["Play"], c["ShotAtGoal"]
    kind = F.when(p["Pass"].isNotNull(), "Pass").when(p["Cross"].isNotNull(), "Cross").otherwise("Play")
    result = F.when(s["ShotWide"].isNotNull(), "OffTarget").when(s["SavedShot"].isNotNull(), "Saved").when(s["BlockedShot"].isNotNull(), "Blocked").when(s["ShotWoodWork"].isNotNull(), "Post").when(s["SuccessfulShot"].isNotNull(), "Goal")
    body = F.when(s["_TypeOfShot"] == "head", "Head").when(s["_TypeOfShot"] == "leftLeg", "LeftFoot").when(s["_TypeOfShot"] == "rightLeg", "RightFoot")
    catcher = F.when(result == "Saved", s["SavedShot"]["_GoalKeeper"]).when(result == "Blocked", s["BlockedShot"]["_Player"])
    pack = lambda *x: F.struct(*[v.cast(t).alias(n) for v, (n, t) in zip(x, (("kind", "string"), ("team", "string"), ("player", "string"), ("receiver", "string"), ("result", "string"), ("success", "boolean"), ("body", "string")), strict=True)])
    none = F.lit(None)
    return F.when(p.isNotNull(), pack(kind, p["_Team"], p["_Player"], p["_Recipient"], p["_Evaluation"], p["_Evaluation"] == "successfullyCompleted", none)).when(
        s.isNotNull(), pack(F.lit("Shot"), s["_Team"], s["_Player"], catcher, result, s["SuccessfulShot"].isNotNull(), body)
    )


def events_xml(spark: SparkSession, path: str) -> DataFrame:
    """Raw events of event XML, one row each, in the sixteen columns and the provider's expected goals; deleted events are dropped, periods come from ``with_periods``.

    An event's kind is its child element; restarts hold a play or a shot of their own.
    """
    piece = f"struct<_GameSection:string,_Team:string,_Player:string,Play:{_PLAY},ShotAtGoal:{_SHOT}>"
    names = "_EventId string, _EventTime string, _MatchId string, `_X-Position` double, `_Y-Position` double, `_X-Source-Position` double, `_Y-Source-Position` double, `_End-X-Position` double, `_End-Y-Position` double"
    schema = f"{names}, Play {_PLAY}, ShotAtGoal {_SHOT}, " + ", ".join(f"{k} {piece}" for k in SET_PIECES) + ", " + ", ".join(f"{k} {_OTHER}" for k in OTHER_KINDS)
    rows = spark.read.format("xml").option("rowTag", "Event").schema(schema).load(path)
    found = F.lit(None).cast("string")
    for k in OTHER_KINDS:
        found = F.when(F.col(k).isNotNull(), F.lit(k)).otherwise(found)
    piece_of, section = F.lit(None).cast("string"), F.lit(None).cast("string")
    plays = _play(F.struct("Play", "ShotAtGoal"))
    for k in SET_PIECES:
        piece_of = F.when(F.col(k).isNotNull(), F.lit(k)).otherwise(piece_of)
        section = F.when(F.col(k).isNotNull(), F.col(k)["_GameSection"]).otherwise(section)
        plays = F.when(F.col(k).isNotNull(), _play(F.col(k))).otherwise(plays)
    r = rows.select(
        F.col("_MatchId").alias("match_id"), F.col("_EventId").alias("event_id"), utc_naive(F.col("_EventTime")).alias("utc_timestamp"), F.coalesce("_X-Position", "_X-Source-Position").alias("coordinates_x"), F.coalesce("_Y-Position", "_Y-Source-Position").alias("coordinates_y"),
        F.col("_End-X-Position").alias("end_coordinates_x"), F.col("_End-Y-Position").alias("end_coordinates_y"), plays.alias("p"), found.alias("o"), piece_of.alias("set_piece_type"), section.alias("section"), F.col("ShotAtGoal._xG").alias("expected_goal"), *OTHER_KINDS,
    ).where("o IS NULL OR o <> 'Delete'")
    t, b, x, f, c, u = (F.col(k) for k in ("TacklingGame", "BallClaiming", "OtherBallAction", "Foul", "Caution", "Substitution"))
    kind = (
        F.when(F.col("p").isNotNull(), F.col("p.kind"))
        .when(F.col("set_piece_type") == "FinalWhistle", "FinalWhistle")
        .when(t["_Type"] == "air", "AerialDuel").when(t["_Type"] == "ground", "GroundDuel")
        .when(b["_Type"] == "InterceptedBall", "Interception").when(b["_Type"] == "BallClaimed", "Recovery")
        .when(x["_DefensiveClearance"] == "true", "Clearance").when(c.isNotNull(), "Card").otherwise(F.col("o"))
    )
    own = lambda a: F.coalesce(*[F.col(k)[a] for k in OTHER_KINDS])
    return r.select(
        "match_id", "event_id", kind.alias("event_type"), F.when(F.col("section") == "firstHalf", 1).when(F.col("section") == "secondHalf", 2).otherwise(0).alias("period_id"), "utc_timestamp",
        F.coalesce("p.team", t["_WinnerTeam"], f["_TeamFouler"], own("_Team")).alias("team_id"), F.coalesce("p.player", t["_Winner"], f["_Fouler"], u["_PlayerOut"], own("_Player")).alias("player_id"), "coordinates_x", "coordinates_y", "end_coordinates_x", "end_coordinates_y",
        F.coalesce("p.receiver", t["_Loser"], f["_Fouled"], u["_PlayerIn"]).alias("receiver_player_id"), "set_piece_type", F.coalesce("p.result", F.when(t["_PossessionChange"] == "true", "PossessionChange"), f["_FoulType"]).alias("result"),
        F.coalesce("p.success", F.when(t.isNotNull(), True)).alias("success"), F.col("p.body").alias("body_part_type"), F.when(c["_CardColor"] == "yellow", "Yellow").when(c["_CardColor"] == "red", "Red").alias("card_type"), "expected_goal",
    )


def with_periods(events: DataFrame) -> DataFrame:
    """Every event between the first kickoff and the last final whistle of a period belongs to it; two rows of bounds per match are joined."""
    bounds = events.where("period_id > 0").groupBy("match_id", F.col("period_id").alias("_p")).agg(F.min(F.when(F.col("set_piece_type") == "KickOff", F.col("utc_timestamp"))).alias("_a"), F.max(F.when(F.col("event_type") == "FinalWhistle", F.col("utc_timestamp"))).alias("_b"))
    spans = bounds.groupBy("match_id").agg(F.collect_list(F.struct("_p", "_a", "_b")).alias("_s"))
    inside = F.filter("_s", lambda q: (F.col("utc_timestamp") >= q["_a"]) & (F.col("utc_timestamp") <= q["_b"]))
    return events.join(spans, "match_id", "left").withColumn("period_id", F.coalesce(F.array_max(F.transform(inside, lambda q: q["_p"])), "period_id")).drop("_s")


def utc_naive(text):
    """A time with its zone as UTC without one."""
    return F.to_utc_timestamp(F.to_timestamp(text), F.expr("current_timezone()")).cast("timestamp_ntz")


def tracking_xml(spark: SparkSession, path: str) -> DataFrame:
    """Long tracking of positions XML: one row per frame and object; centre-origin places become corner-origin."""
    frame = "array<struct<_N:long,_T:string,_X:double,_Y:double,_Z:double,_S:double>>"
    rows = spark.read.format("xml").option("rowTag", "FrameSet").schema(f"_MatchId string, _GameSection string, _TeamId string, _PersonId string, Frame {frame}").load(path)
    f = rows.select(F.col("_MatchId").alias("match_id"), F.when(F.col("_GameSection") == "firstHalf", 1).otherwise(2).alias("period_id"), F.col("_TeamId").alias("team_id"), F.col("_PersonId").alias("player_id"), F.explode("Frame").alias("f"))
    return f.select("match_id", "period_id", "team_id", "player_id", F.col("f._N").alias("frame_id"), utc_naive(F.col("f._T")).alias("utc_timestamp"), (F.col("f._X") + 52.5).alias("x"), (F.col("f._Y") + 34).alias("y"), F.col("f._Z").alias("z"), F.col("f._S").alias("speed"))


def frames_xml(spark: SparkSession, path: str) -> DataFrame:
    """Frames of positions XML as they stand in the file, without holding any frame set: (match_id, period_id, team_id, player_id, frame_id, utc_timestamp, x, y, z, speed), centre origin.

    Records end with a tag's bracket, so one file is read in as many splits as it has, frame by frame.  A frame belongs to the last frame set that opened before it: within a split by
    a running value, and at a split's beginning by the last one of the splits before (a row a split).  Values must not hold brackets, which these files don't.
    """
    own, split = ["_file", "_split"], F.col("_metadata.file_block_start")
    rows = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("_file"), split.alias("_split"), F.monotonically_increasing_id().alias("_n"), F.regexp_extract("value", r"<(/?FrameSet|Frame)\s[^<]*$|<(/FrameSet)\s*$", 0).alias("tag"))
    rows = rows.where("tag <> ''")
    of = lambda c, name: F.nullif(F.regexp_extract(c, rf'\s{name}="([^"]*)"', 1), F.lit(""))
    head = F.when(F.col("tag").startswith("<FrameSet"), F.struct(of("tag", "MatchId").alias("match_id"), of("tag", "GameSection").alias("section"), of("tag", "TeamId").alias("team_id"), of("tag", "PersonId").alias("player_id")))
    rows = rows.withColumn("_head", head)
    w = W.partitionBy(*own).orderBy("_n")
    rows = rows.withColumn("_set", F.last("_head", ignorenulls=True).over(w))
    last = rows.groupBy(*own).agg(F.max_by("_head", F.when(F.col("_head").isNotNull(), F.col("_n"))).alias("_last"))
    before = last.withColumn("_before", F.last("_last", ignorenulls=True).over(W.partitionBy("_file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1))).drop("_last")
    f = rows.where("tag LIKE '<Frame %'").join(F.broadcast(before), own).withColumn("_set", F.coalesce("_set", "_before"))
    s, n = F.col("_set"), lambda name, kind="double": of("tag", name).cast(kind)
    return f.select(s["match_id"].alias("match_id"), F.when(s["section"] == "firstHalf", 1).otherwise(2).alias("period_id"), s["team_id"].alias("team_id"), s["player_id"].alias("player_id"), n("N", "long").alias("frame_id"), utc_naive(of("tag", "T")).alias("utc_timestamp"), n("X").alias("x"), n("Y").alias("y"), n("Z").alias("z"), n("S").alias("speed"))


def provider_csv(spark: SparkSession, path: str) -> DataFrame:
    """Provider file: semicolons, decimal commas, Windows code page; the first row of an event in file order stays.

    The code page is read as ISO-8859-1, which agrees with it on every letter these files hold.
    """
    schema = "EVENT_ID string, PUID2 string, GDCP_EVENT_TIME string, TRACKING_TIME string, FRAME_NUMBER string, RECFRM string, NORECEIVER string, XG decimal(10,6)"
    rows = spark.read.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").option("locale", "de-DE").schema(schema).csv(path)
    rows = rows.withColumn("_n", F.monotonically_increasing_id())
    out = rows.select(
        F.col("EVENT_ID").alias("event_id"), F.col("PUID2").alias("receiver_player_id"), F.expr("try_to_timestamp(GDCP_EVENT_TIME)").alias("event_time"), F.expr("try_to_timestamp(TRACKING_TIME)").alias("tracking_time"), F.expr("try_cast(FRAME_NUMBER AS long)").alias("frame_id"),
        F.expr("try_cast(RECFRM AS long)").alias("receive_frame_id"), F.when(F.upper("NORECEIVER") == "TRUE", True).when(F.upper("NORECEIVER") == "FALSE", False).alias("no_receiver"), F.col("XG").cast("double").alias("expected_goal"), "_n",
    )
    w = W.partitionBy("event_id").orderBy("_n")
    return out.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_n")


FRAME_PLAYERS = ("game_id", "half", "abs_time", "uefa_player_id", "role", "centroid_x", "centroid_y", "team", "possession_team", "BallReceipt")
FRAME_BALL = ("game_id", "half", "abs_time", "ball_x", "ball_y", "ball_z")
POSSESSIONS = ("match_id", "index", "frame_start", "frame_end", "period", "player_id", "event_type", "attacking_side")


def checked_csv(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A delimited file that must have some columns."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return rows


def possession_events(spark: SparkSession, path: str, kind: str = "player_possession") -> DataFrame:
    """Possession rows of one kind with usable frames, in order; overlaps are an error."""
    from ..operators.tracking import overlapping

    rows = checked_csv(spark, path, POSSESSIONS).where(F.col("event_type") == kind)
    rows = rows.withColumns({c: F.expr(f"try_cast({c} AS long)") for c in ("frame_start", "frame_end")}).dropna(subset=["frame_start", "frame_end", "player_id"])
    if overlapping(rows).limit(1).count():
        raise ValueError(f"possessions overlap in {path}")
    return rows.orderBy("match_id", "frame_start")


def match_json(spark: SparkSession, path: str) -> DataFrame:
    """Players of match metadata JSON with team side and whether they keep goal (by role name or acronym)."""
    schema = "id long, home_team struct<id:long>, away_team struct<id:long>, players array<struct<id:long,team_id:long,number:int,short_name:string,player_role:struct<acronym:string,name:string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    p = rows.select(F.col("id").alias("match_id"), F.col("home_team.id").alias("_home"), F.explode("players").alias("p"))
    side = F.when(F.col("p.team_id") == F.col("_home"), "home").otherwise("away")
    keeper = (F.col("p.player_role.acronym") == "GK") | F.lower("p.player_role.name").contains("goalkeeper")
    return p.select("match_id", F.col("p.id").alias("player_id"), side.alias("side"), F.concat_ws("_", side, F.col("p.number").cast("string")).alias("object_id"), F.col("p.short_name").alias("name"), F.coalesce(keeper, F.lit(False)).alias("keeper"))


def tracking_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Long tracking of JSON lines; a missing ball state means in play, a missing period is filled from the frames around."""
    schema = "match_id long, frame long, period int, ball_state string, ball_data struct<x:double,y:double,z:double>, player_data array<struct<player_id:long,x:double,y:double>>"
    rows = spark.read.schema(schema).json(path)
    w = W.partitionBy("match_id").orderBy("frame")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    period = F.coalesce(F.last("period", True).over(back), F.first("period", True).over(ahead))
    rows = rows.withColumns({"period_id": period, "ball_state": F.coalesce("ball_state", F.lit("alive"))})
    ball = F.array(F.struct(F.lit(None).cast("long").alias("player_id"), (F.col("ball_data.x") + 52.5).alias("x"), (F.col("ball_data.y") + 34).alias("y"), F.col("ball_data.z").alias("z")))
    players = F.transform(F.coalesce("player_data", F.expr("array()").cast("array<struct<player_id:bigint,x:double,y:double>>")), lambda q: F.struct(q["player_id"].alias("player_id"), (q["x"] + 52.5).alias("x"), (q["y"] + 34).alias("y"), F.lit(None).cast("double").alias("z")))
    return rows.select("match_id", F.col("frame").alias("frame_id"), "period_id", "ball_state", F.inline(F.concat(ball, players))).withColumn("ball", F.col("player_id").isNull())


def discovered(spark: SparkSession, folders: dict[str, str], pattern: str = r"([^/]+?)(?:_[a-z]+)?\.[A-Za-z]+$") -> DataFrame:
    """Ids of matches with the files of each folder, and why an incomplete one is skipped."""
    out = None
    for name, folder in folders.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", pattern, 1).alias("match_id"), F.col("path").alias(name)).groupBy("match_id").agg(F.min(name).alias(name))
        out = files if out is None else out.join(files, "match_id", "full")
    missing = F.concat_ws(",", *[F.when(F.col(n).isNull(), F.lit(n)) for n in folders])
    return out.withColumn("skip_reason", F.when(missing != "", F.concat(F.lit("missing "), missing)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(split, match_id, position) of a split manifest; an id that repeats keeps its first place."""
    rows = spark.read.option("multiLine", True).schema("train array<string>, test array<string>").json(path)
    long = rows.select(F.explode(F.create_map(F.lit("train"), "train", F.lit("test"), "test")).alias("split", "ids")).select("split", F.posexplode("ids").alias("position", "match_id"))
    return long.groupBy("split", "match_id").agg(F.min("position").alias("position"))


def squad_rows(pages: DataFrame) -> DataFrame:
    """Cells of tables in pages (page_id, html): (page_id, row, cells), tags and references cleaned; all in the JVM."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row", "body"))
    cells = F.regexp_extract_all("body", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1)
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), "&nbsp;| ", " "), r"\s+", " "))
    return rows.select("page_id", "row", F.transform(cells, clean).alias("cells")).where("size(cells) > 0")


def money(text):
    """Amounts such as "EUR 1.50m" or "€300k" as numbers."""
    number = F.expr("try_cast(replace(regexp_extract(%s, '([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS double)" % text)
    return number * F.when(F.lower(text).rlike(r"\d\s*(m|mio)"), 1e6).when(F.lower(text).rlike(r"\d\s*(k|th)"), 1e3).otherwise(1.0)
