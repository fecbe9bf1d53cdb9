"""The domain seen through the generic tables: actions, frames and snapshots as fixed functions of ``events``.

Every frame here is one narrow pass over the parquet scan, or one window over matches.  The DuckDB twins are the constants
``ACTIONS`` and ``SNAPSHOT``; ``with_actions`` puts them before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECOND_HALF = "2024-01-16 00:00:00"
TYPES = {"view": "pass", "click": "cross", "purchase": "shot", "signup": "goalkick", "error": "foul"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows dealt out by their key before they are unfolded hundreds of times: one narrow shuffle, after which sums and joins by the key (and by more) need none.

    The number of partitions is given, since adaptive execution would merge the narrow rows into few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def raw_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions without their number in the match: no shuffle."""
    e = table(spark, sf_dir, "events")
    n, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("event_type")]
    home = n % 2 == 0
    team, other = F.when(home, "home").otherwise("away"), F.when(home, "away").otherwise("home")
    success = F.col("value") < 60
    return e.select(
        F.col("user_id").alias("match_id"),
        F.when(F.col("ts") < F.lit(SECOND_HALF).cast("timestamp_ntz"), 1).otherwise(2).alias("period_id"),
        n.alias("event_id"),
        "ts",
        "value",
        kind.alias("spadl_type"),
        team.alias("team"),
        k.alias("k"),
        F.concat_ws("_", team, (k % 11 + 1).cast("string")).alias("object_id"),
        (((n * 37) % 10501) / F.lit(100.0)).alias("start_x"),
        (((n * 53) % 6801) / F.lit(100.0)).alias("start_y"),
        (((n * 41) % 10501) / F.lit(100.0)).alias("end_x"),
        (((n * 59) % 6801) / F.lit(100.0)).alias("end_y"),
        F.when(F.col("event_type") == "purchase", F.least(F.col("value") / F.lit(500.0), F.lit(0.99))).alias("expected_goal"),
        success.alias("success"),
        (n % 29 == 0).alias("offside"),
        ((n % 23) / F.lit(10.0)).alias("ball_z"),
        F.when(n % 13 == 0, "out").when(success, F.concat_ws("_", team, ((k + 3) % 11 + 1).cast("string"))).otherwise(F.concat_ws("_", other, ((k + 5) % 11 + 1).cast("string"))).alias("receiver_id"),
    )


def actions(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Actions with their number in the match, their frame and their receipt: one shuffle on the match, ``dealt`` to as many partitions as ``spread`` does."""
    by = W.partitionBy("match_id")
    a = raw_actions(spark, sf_dir)
    a = spread(a, "match_id") if dealt else a
    epoch = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = F.floor((epoch - F.min(epoch).over(by)) / F.lit(1_000_000)).cast("long")
    return a.withColumn("action_id", F.row_number().over(by.orderBy("ts", "event_id")).cast("long") - 1).withColumn("frame_id", frame).withColumn("receive_frame_id", F.col("frame_id") + F.col("k") % 7 + 1)


def moves(n, j: int) -> dict:
    """Where player ``j`` (1 to 22) is around action ``n``, and how they move."""
    return {
        "x": ((n * 37 + j * 911) % 10501) / F.lit(100.0),
        "y": ((n * 53 + j * 577) % 6801) / F.lit(100.0),
        "vx": ((n * 7 + j * 131) % 1001) / F.lit(100.0) - F.lit(5.0),
        "vy": ((n * 11 + j * 173) % 1001) / F.lit(100.0) - F.lit(5.0),
        "accel": ((n * 3 + j * 29) % 401) / F.lit(100.0),
    }


#: Name, team, keeper and goal of the 24 of ``players``, in order, and the goals' places.
NAMES = [*(f"{t}_{j}" for t in ("home", "away") for j in range(1, 12)), "home_goal", "away_goal"]
GOALS = {"x": (105.0, 0.0), "y": (34.0, 34.0), "vx": (0.0, 0.0), "vy": (0.0, 0.0), "accel": (0.0, 0.0)}


def player_arrays(n=None) -> dict:
    """The moving fields of ``players`` as an array each, in their order: no structs, of which names and teams would be said anew in every row."""
    n = F.col("event_id") if n is None else n
    of = [moves(n, j) for j in range(1, 23)]
    return {c: F.array(*[m[c] for m in of], *[F.lit(v) for v in GOALS[c]]) for c in GOALS}


def players(n=None):
    """Array of the 22 players and two goals around an action: (ordinal, object, team, keeper, goal, x, y, vx, vy, accel).

    The players are written out, so that their names are constants and their places generated code; a lambda over their numbers is interpreted, value by value.
    """
    n = F.col("event_id") if n is None else n

    def one(j: int):
        team, number = ("home", j) if j <= 11 else ("away", j - 11)
        return F.struct(
            F.lit(j).alias("ordinal"),
            F.lit(f"{team}_{number}").alias("object_id"),
            F.lit(team).alias("team"),
            F.lit(number == 1).alias("keeper"),
            F.lit(False).alias("goal"),
            *[c.alias(name) for name, c in moves(n, j).items()],
        )

    def goal(ordinal: int, team: str, x: float):
        return F.struct(
            F.lit(ordinal).alias("ordinal"), F.lit(f"{team}_goal").alias("object_id"), F.lit(team).alias("team"), F.lit(False).alias("keeper"), F.lit(True).alias("goal"),
            F.lit(x).alias("x"), F.lit(34.0).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("accel"),
        )

    return F.array(*[one(j) for j in range(1, 23)], goal(23, "home", 105.0), goal(24, "away", 0.0))


ACTIONS = """
  SELECT *, frame_id + k % 7 + 1 AS receive_frame_id FROM (
    SELECT user_id AS match_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS period_id, event_id, ts, value,
      CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'cross' WHEN 'purchase' THEN 'shot' WHEN 'signup' THEN 'goalkick' WHEN 'error' THEN 'foul' END AS spadl_type,
      CASE WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END AS team, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
      (CASE WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END) || '_' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 11 + 1) AS object_id,
      ((event_id * 37) % 10501) / 100.0::DOUBLE AS start_x, ((event_id * 53) % 6801) / 100.0::DOUBLE AS start_y,
      ((event_id * 41) % 10501) / 100.0::DOUBLE AS end_x, ((event_id * 59) % 6801) / 100.0::DOUBLE AS end_y,
      CASE WHEN event_type = 'purchase' THEN least(value / 500.0::DOUBLE, 0.99::DOUBLE) END AS expected_goal, value < 60 AS success, event_id % 29 = 0 AS offside, (event_id % 23) / 10.0::DOUBLE AS ball_z,
      CASE WHEN event_id % 13 = 0 THEN 'out'
           WHEN value < 60 THEN (CASE WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END) || '_' || ((CAST(json_extract_string(props, '$.k') AS INTEGER) + 3) % 11 + 1)
           ELSE (CASE WHEN event_id % 2 = 0 THEN 'away' ELSE 'home' END) || '_' || ((CAST(json_extract_string(props, '$.k') AS INTEGER) + 5) % 11 + 1) END AS receiver_id,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS action_id,
      (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000000 AS frame_id
    FROM events)
"""
SNAPSHOT = """
  SELECT a.event_id, j::INTEGER AS ordinal, (CASE WHEN j <= 11 THEN 'home' ELSE 'away' END) || '_' || (CASE WHEN j <= 11 THEN j ELSE j - 11 END) AS object_id,
    CASE WHEN j <= 11 THEN 'home' ELSE 'away' END AS team, j IN (1, 12) AS keeper, false AS goal,
    ((a.event_id * 37 + j * 911) % 10501) / 100.0::DOUBLE AS x, ((a.event_id * 53 + j * 577) % 6801) / 100.0::DOUBLE AS y,
    ((a.event_id * 7 + j * 131) % 1001) / 100.0::DOUBLE - 5.0::DOUBLE AS vx, ((a.event_id * 11 + j * 173) % 1001) / 100.0::DOUBLE - 5.0::DOUBLE AS vy, ((a.event_id * 3 + j * 29) % 401) / 100.0::DOUBLE AS accel
  FROM a, range(1, 23) t(j)
  UNION ALL SELECT event_id, 23, 'home_goal', 'home', false, true, 105.0::DOUBLE, 34.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM a
  UNION ALL SELECT event_id, 24, 'away_goal', 'away', false, true, 0.0::DOUBLE, 34.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM a
"""


def with_actions(body: str, snapshot: bool = False) -> str:
    """A DuckDB query with the CTE ``a`` (and ``s``) before it; ``body`` may begin with further CTEs after a comma."""
    return f"WITH a AS MATERIALIZED ({ACTIONS})" + (f", s AS MATERIALIZED ({SNAPSHOT})" if snapshot else "") + " " + body
