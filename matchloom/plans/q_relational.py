"""Queries of joins, aggregates, sets and metrics, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import joins as J
from ..operators import relational as R
from . import lens
from .lens import table, with_actions
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


@query(
    "n13_receiver_end_location",
    with_actions(
        """SELECT x.match_id, x.action_id, arg_min(y.start_x, y.action_id) AS end_from_x, arg_min(y.start_y, y.action_id) AS end_from_y
FROM a x LEFT JOIN a y ON x.match_id = y.match_id AND x.period_id = y.period_id AND y.object_id = x.receiver_id AND y.action_id > x.action_id GROUP BY x.match_id, x.action_id"""
    ),
)
def receiver_end_location(spark, d):
    """Where the receiver next acts."""
    return J.receiver_end(lens.actions(spark, d)).select("match_id", "action_id", "end_from_x", "end_from_y")


@query(
    "j03_asof_backward",
    """WITH c AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS v_id, ts, user_id FROM events WHERE event_type = 'view')
SELECT c.event_id, v.v_id FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts""",
)
def asof_backward(spark, d):
    """The last view of the same user before each purchase."""
    e = table(spark, d, "events")
    c = e.where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    v = e.where("event_type = 'view'").select(F.col("event_id").alias("v_id"), "ts", "user_id")
    return J.asof(c, v, ["user_id"], "ts", ["v_id"]).select("event_id", "v_id")


@query(
    "j03_asof_forward",
    """WITH c AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS v_id, ts, user_id FROM events WHERE event_type = 'error')
SELECT c.event_id, v.v_id FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts <= v.ts""",
)
def asof_forward(spark, d):
    """The next error of the same user after each purchase."""
    e = table(spark, d, "events")
    c = e.where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    v = e.where("event_type = 'error'").select(F.col("event_id").alias("v_id"), "ts", "user_id")
    return J.asof(c, v, ["user_id"], "ts", ["v_id"], "forward").select("event_id", "v_id")


@query(
    "j04_nearest_frame",
    with_actions(
        """
, p AS (SELECT match_id, action_id, frame_id FROM a WHERE spadl_type = 'pass'), s AS (SELECT match_id, frame_id AS f, min(event_id) AS s_id FROM a WHERE spadl_type = 'shot' GROUP BY ALL)
, b AS (SELECT p.*, s.f AS bf, s.s_id AS bs FROM p ASOF LEFT JOIN s ON p.match_id = s.match_id AND p.frame_id >= s.f)
, c AS (SELECT b.*, s.f AS ff, s.s_id AS fs FROM b ASOF LEFT JOIN s ON b.match_id = s.match_id AND b.frame_id <= s.f)
, n AS (SELECT *, ff IS NULL OR frame_id - bf <= ff - frame_id AS tb FROM c)
, r AS (SELECT match_id, action_id, CASE WHEN tb THEN abs(frame_id - bf) ELSE abs(ff - frame_id) END AS gap, CASE WHEN tb THEN bs ELSE fs END AS sid FROM n)
SELECT match_id, action_id, CASE WHEN gap <= 7200 THEN sid END AS shot_id FROM r"""
    ),
)
def nearest_frame(spark, d):
    """The shot nearest in time to each pass, two hours away at most; the earlier one on a tie."""
    a = lens.actions(spark, d)
    p = a.where("spadl_type = 'pass'").select("match_id", "action_id", "frame_id")
    s = a.where("spadl_type = 'shot'").groupBy("match_id", "frame_id").agg(F.min("event_id").alias("shot_id"))
    return J.nearest(p, s, ["match_id"], "frame_id", ["shot_id"], 7200).select("match_id", "action_id", "shot_id")


PHASES = """
, sp AS (SELECT match_id, action_id AS phase, frame_id AS start_frame, coalesce(lead(frame_id) OVER (PARTITION BY match_id ORDER BY action_id) - 1, frame_id) AS end_frame FROM a WHERE spadl_type = 'goalkick')
"""


@query(
    "j05_actions_in_phase",
    with_actions(PHASES + "SELECT a.match_id, a.action_id, sp.phase FROM a JOIN sp ON a.match_id = sp.match_id AND a.frame_id BETWEEN sp.start_frame AND sp.end_frame"),
)
def actions_in_phase(spark, d):
    """Actions inside the spans between goal kicks: an interval join."""
    a = lens.actions(spark, d)
    w = W.partitionBy("match_id").orderBy("action_id")
    spans = a.where("spadl_type = 'goalkick'").select("match_id", F.col("action_id").alias("phase"), F.col("frame_id").alias("start_frame"), F.coalesce(F.lead("frame_id").over(w) - 1, "frame_id").alias("end_frame"))
    return J.within(a.select("match_id", "action_id", "frame_id"), spans, ["match_id"], "frame_id", "start_frame", "end_frame", 86400).select("match_id", "action_id", "phase")


@query(
    "n45_phase_of_every_action",
    with_actions(PHASES + "SELECT a.match_id, a.action_id, coalesce(sp.phase, -1) AS phase FROM a LEFT JOIN sp ON a.match_id = sp.match_id AND a.frame_id BETWEEN sp.start_frame AND sp.end_frame"),
)
def phase_of_every_action(spark, d):
    """As before, with -1 for actions in no span."""
    a = lens.actions(spark, d)
    w = W.partitionBy("match_id").orderBy("action_id")
    spans = a.where("spadl_type = 'goalkick'").select("match_id", F.col("action_id").alias("phase"), F.col("frame_id").alias("start_frame"), F.coalesce(F.lead("frame_id").over(w) - 1, "frame_id").alias("end_frame"))
    out = J.within(a.select("match_id", "action_id", "frame_id"), spans, ["match_id"], "frame_id", "start_frame", "end_frame", 86400, "left")
    return out.select("match_id", "action_id", F.coalesce("phase", F.lit(-1)).alias("phase"))


@query(
    "j16_overlay_sources",
    """SELECT e.event_id, coalesce(a.v, b.v) AS frame, CASE WHEN a.v IS NOT NULL THEN 'first' WHEN b.v IS NOT NULL THEN 'second' ELSE 'none' END AS source FROM events e
LEFT JOIN (SELECT event_id, event_id * 10 AS v FROM events WHERE value > 80) a ON e.event_id = a.event_id LEFT JOIN (SELECT event_id, event_id * 100 AS v FROM events WHERE value > 40) b ON e.event_id = b.event_id""",
)
def overlay_sources(spark, d):
    """A provider's frame where there is one, else the algorithm's."""
    e = table(spark, d, "events")
    a = e.where("value > 80").select("event_id", (F.col("event_id") * 10).alias("frame"))
    b = e.where("value > 40").select("event_id", (F.col("event_id") * 100).alias("frame"))
    return J.overlay(e.select("event_id"), a, b, ["event_id"], "frame")


@query("j01_lookup_join", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, d):
    """Suppliers with the names of their nation and region; dimensions are broadcast after a count."""
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    r = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return J.lookup(J.lookup(table(spark, d, "supplier"), n, ["s_nationkey"]), r, ["n_regionkey"]).select("s_suppkey", "n_name", "r_name")


@query("j02_two_key_join", "SELECT l_orderkey, l_linenumber, l_quantity, o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND CAST(l_linenumber > 3 AS INTEGER) = CAST(o_totalprice > 50000 AS INTEGER)")
def two_key_join(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_linenumber") > 3).alias("big"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", (F.col("o_totalprice") > 50000).alias("big"))
    return l.join(o, ["l_orderkey", "big"], "left").select("l_orderkey", "l_linenumber", "l_quantity", "o_orderstatus")


@query("j08_right_join_filled", "SELECT user_id, event_id, last_value(m.v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY e.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM (SELECT event_id, value AS v FROM events WHERE event_type = 'error') m RIGHT JOIN events e USING (event_id)")
def right_join_filled(spark, d):
    """Errors' values on every event, carried forward per user."""
    e = table(spark, d, "events")
    m = e.where("event_type = 'error'").select("event_id", F.col("value").alias("v"))
    return J.right_filled(m, e.select("event_id", "user_id"), ["event_id"], ["user_id"], "event_id", ["v"]).select("user_id", "event_id", "v")


@query("j10_semi_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_join(spark, d):
    return J.semi(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("j11_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_join(spark, d):
    return J.anti(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(
    "n40_valid_snapshots",
    with_actions(", t AS (SELECT DISTINCT match_id, frame_id, object_id FROM a WHERE k % 3 <> 0) SELECT match_id, action_id FROM a WHERE (match_id, frame_id, object_id) IN (SELECT (match_id, frame_id, object_id) FROM t)"),
)
def valid_snapshots(spark, d):
    """Actions whose possessor is tracked at their frame."""
    a = lens.actions(spark, d)
    return J.semi(a, a.where(F.col("k") % 3 != 0), ["match_id", "frame_id", "object_id"]).select("match_id", "action_id")


@query(
    "a01_zone_sums",
    with_actions(
        """
, g AS (SELECT team, i::INTEGER AS bin_x, j::INTEGER AS bin_y FROM (SELECT DISTINCT team FROM a), range(0, 4) x(i), range(0, 3) y(j))
, s AS (SELECT team, CASE WHEN start_x < 26.25 THEN 0 WHEN start_x < 52.5 THEN 1 WHEN start_x < 78.75 THEN 2 WHEN start_x < 105 THEN 3 END AS bin_x,
        CASE WHEN start_y < 20 THEN 0 WHEN start_y < 48 THEN 1 WHEN start_y < 68 THEN 2 END AS bin_y, sum(k)::DOUBLE AS total FROM a WHERE spadl_type = 'goalkick' GROUP BY ALL)
SELECT g.team, g.bin_x, g.bin_y, coalesce(total, 0) AS total FROM g LEFT JOIN s ON g.team = s.team AND g.bin_x = s.bin_x AND g.bin_y = s.bin_y"""
    ),
)
def zone_sums(spark, d):
    """Sums over zones of the pitch, empty zones included."""
    a = lens.raw_actions(spark, d).withColumn("v", F.when(F.col("spadl_type") == "goalkick", F.col("k").cast("double")))
    out = R.binned_sum(a, ["team"], F.col("start_x"), F.col("start_y"), [0, 26.25, 52.5, 78.75, 105], [0, 20, 48, 68], "v")
    return out


TYPES = ["pass", "cross", "shot", "goalkick", "foul"]


@query("a02_pivot_scores", with_actions("SELECT object_id, " + ", ".join(f"{R6.format(f'''sum(CASE WHEN spadl_type = '{t}' THEN value ELSE 0 END)''')} AS {t}" for t in TYPES) + f", {R6.format('sum(value)')} AS score FROM a GROUP BY object_id"))
def pivot_scores(spark, d):
    """Value per player and action type, with a total."""
    out = R.pivot_sum(lens.raw_actions(spark, d), "object_id", "spadl_type", TYPES, "value")
    return out.select("object_id", *[G.at_6(F.col(c)).alias(c) for c in [*TYPES, "score"]])


@query("a03_pair_matrix", with_actions("SELECT object_id, " + ", ".join(f"sum(CASE WHEN k % 4 = {i} THEN 1 ELSE 0 END)::DOUBLE AS \"{i}\"" for i in range(4)) + " FROM a GROUP BY object_id"))
def pair_matrix(spark, d):
    """Counts per player and opponent group."""
    a = lens.raw_actions(spark, d).select("object_id", (F.col("k") % 4).alias("other"), F.lit(1.0).alias("one"))
    return R.pair_matrix(a, "object_id", "other", [0, 1, 2, 3], "one")


@query("a04_group_extremes", with_actions("SELECT object_id, max(value) AS top, arg_min(event_id, ts) AS first_event, count(*) AS n FROM a GROUP BY object_id"))
def group_extremes(spark, d):
    return lens.raw_actions(spark, d).groupBy("object_id").agg(F.max("value").alias("top"), F.min_by("event_id", "ts").alias("first_event"), F.count("*").alias("n"))


@query("a05_playing_span", with_actions("SELECT match_id, object_id, min(frame_id) AS in_frame, max(frame_id) AS out_frame FROM a GROUP BY match_id, object_id"))
def playing_span(spark, d):
    """First and last frame of each player."""
    return lens.actions(spark, d).groupBy("match_id", "object_id").agg(F.min("frame_id").alias("in_frame"), F.max("frame_id").alias("out_frame"))


@query("a06_playing_time", with_actions("SELECT match_id, object_id, count(*) FILTER (WHERE k % 2 = 0 AND value > 5) / 25.0::DOUBLE AS attack_time, count(*) FILTER (WHERE k % 2 <> 0 AND value > 5) / 25.0::DOUBLE AS defend_time FROM a GROUP BY match_id, object_id"))
def playing_time(spark, d):
    """Seconds in and out of possession while the ball is in play."""
    own, alive = F.col("k") % 2 == 0, F.col("value") > 5
    return lens.raw_actions(spark, d).groupBy("match_id", "object_id").agg((F.count_if(own & alive) / F.lit(25.0)).alias("attack_time"), (F.count_if(~own & alive) / F.lit(25.0)).alias("defend_time"))


@query("a07_mean_positions", with_actions(f"SELECT object_id, {R6.format('avg(start_x)')} AS x, {R6.format('avg(start_y)')} AS y FROM a GROUP BY object_id"))
def mean_positions(spark, d):
    return lens.raw_actions(spark, d).groupBy("object_id").agg(G.at_6(F.avg("start_x")).alias("x"), G.at_6(F.avg("start_y")).alias("y"))


@query("a08_extreme_rows", with_actions("SELECT match_id, arg_max(event_id, (start_x, event_id)) AS furthest, arg_min(event_id, (start_x, event_id)) AS nearest FROM a GROUP BY match_id"))
def extreme_rows(spark, d):
    """The rows of the greatest and least x in each match, ties by id."""
    key = F.struct("start_x", "event_id")
    return lens.raw_actions(spark, d).groupBy("match_id").agg(F.max_by("event_id", key).alias("furthest"), F.min_by("event_id", key).alias("nearest"))


@query("a09_histogram", with_actions("SELECT CAST(7 - floor(least(start_y, 68 - 1e-9) / 68 * 8) AS INTEGER) AS row, CAST(floor(least(start_x, 105 - 1e-9) / 105 * 12) AS INTEGER) AS col, count(*) AS n FROM a GROUP BY ALL"))
def histogram(spark, d):
    """Counts over a 12 by 8 grid, rows from the top."""
    a = lens.raw_actions(spark, d)
    return a.groupBy(G.grid_row(F.col("start_y")).alias("row"), G.grid_column(F.col("start_x")).alias("col")).agg(F.count("*").alias("n"))


@query("a10_error_quantiles", f"SELECT {R6.format('median(abs(value - 50))')} AS median_error, {R6.format('quantile_cont(abs(value - 50), 0.95)')} AS p95_error FROM events")
def error_quantiles(spark, d):
    """Median and 95th percentile of an absolute error."""
    error = F.abs(F.col("value") - 50)
    return table(spark, d, "events").agg(G.at_6(F.median(error)).alias("median_error"), G.at_6(F.percentile(error, 0.95)).alias("p95_error"))


@query(
    "a11_audit_counts",
    with_actions("SELECT CASE WHEN offside THEN 'offside' WHEN receiver_id = 'out' THEN 'out' WHEN spadl_type = 'foul' THEN 'foul' WHEN NOT success THEN 'failed' ELSE 'kept' END AS reason, count(*) AS n FROM a GROUP BY 1"),
)
def audit_counts(spark, d):
    """Rows by the first reason to drop them."""
    rules = [("offside", F.col("offside")), ("out", F.col("receiver_id") == "out"), ("foul", F.col("spadl_type") == "foul"), ("failed", ~F.col("success"))]
    return R.reasons(lens.raw_actions(spark, d), rules).groupBy("reason").agg(F.count("*").alias("n"))


@query("r02_excluded_reason", with_actions("SELECT event_id, CASE WHEN spadl_type IN ('foul') THEN 'type_not_modelled' WHEN expected_goal IS NULL AND spadl_type = 'shot' THEN 'no_xg' WHEN receiver_id = 'out' THEN 'out_of_play' ELSE 'modelled' END AS reason FROM a"))
def excluded_reason(spark, d):
    """Why each event isn't modelled."""
    rules = [("type_not_modelled", F.col("spadl_type").isin("foul")), ("no_xg", F.col("expected_goal").isNull() & (F.col("spadl_type") == "shot")), ("out_of_play", F.col("receiver_id") == "out")]
    return R.reasons(lens.raw_actions(spark, d), rules, "modelled").select("event_id", "reason")


@query("a12_shares", f"SELECT event_id, {R6.format('value / sum(value) OVER (PARTITION BY user_id)')} AS share FROM events")
def shares(spark, d):
    return table(spark, d, "events").select("event_id", G.at_6(R.share_in_group("value", ["user_id"])).alias("share"))


@query("m04_softmax_options", f"WITH m AS (SELECT *, exp(value / 25 - max(value / 25) OVER (PARTITION BY user_id)) AS e FROM events) SELECT event_id, {R6.format('e / sum(e) OVER (PARTITION BY user_id)')} AS p FROM m")
def softmax_options(spark, d):
    """Softmax of scores over the options of each group."""
    e = table(spark, d, "events").withColumn("z", F.col("value") / 25)
    return e.withColumn("p", R.softmax("z", ["user_id"])).select("event_id", G.at_6(F.col("p")).alias("p"))


@query("a13_product", f"SELECT user_id, {R6.format('1 - product(1 - value / 1000)')} AS p FROM events GROUP BY user_id")
def product(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(G.at_6(1 - F.product(1 - F.col("value") / 1000)).alias("p"))


@query(
    "a14_sync_accuracy",
    with_actions(
        f"""
, t AS (SELECT spadl_type AS category, frame_id AS tr, CASE WHEN k % 11 <> 0 THEN frame_id + k % 60 - 30 END AS fo FROM a), u AS (SELECT * FROM t UNION ALL SELECT 'total', tr, fo FROM t)
SELECT category, count(*) AS n, count(fo) AS matched, {R6.format('avg(abs(fo - tr))')} AS mean_error, {R6.format('avg(CASE WHEN fo = tr THEN 1.0::DOUBLE ELSE 0 END)')} AS exact,
{R6.format('avg(CASE WHEN abs(fo - tr) <= 5 THEN 1.0::DOUBLE ELSE 0 END)')} AS within_5, {R6.format('avg(CASE WHEN abs(fo - tr) <= 25 THEN 1.0::DOUBLE ELSE 0 END)')} AS within_25, {R6.format('avg(CASE WHEN abs(fo - tr) <= 50 THEN 1.0::DOUBLE ELSE 0 END)')} AS within_50 FROM u GROUP BY category"""
    ),
)
def sync_accuracy(spark, d):
    """Frame errors by category and in all."""
    a = lens.actions(spark, d).select(F.col("spadl_type").alias("category"), F.col("frame_id").alias("true"), F.when(F.col("k") % 11 != 0, F.col("frame_id") + F.col("k") % 60 - 30).alias("found"))
    out = R.sync_accuracy(a, "category", "found", "true")
    return out.select("category", "n", "matched", *[G.at_6(F.col(c)).alias(c) for c in ("mean_error", "exact", "within_5", "within_25", "within_50")])


@query(
    "a15_binary_metrics",
    f"""WITH s AS (SELECT floor(value) / 200 AS p, CASE WHEN event_type IN ('purchase', 'click') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM events), g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p)
, c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
, m AS (SELECT sum(CASE WHEN p >= 0.25 THEN y ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.25 THEN 1 - y ELSE 0 END) AS fp, sum(CASE WHEN p < 0.25 THEN y ELSE 0 END) AS fn, avg(CASE WHEN (p >= 0.25) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) AS acc,
 avg((p - y) * (p - y)) AS brier, avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))) AS ll FROM s)
SELECT {R6.format('tp / (tp + fp)')} AS precision, {R6.format('tp / (tp + fn)')} AS recall, {R6.format('2 * tp / (2 * tp + fp + fn)')} AS f1, {R6.format('acc')} AS accuracy, {R6.format('brier')} AS brier, {R6.format('ll')} AS log_loss,
 {R6.format('(SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) FROM c)')} AS auc FROM m""",
)
def binary_metrics(spark, d):
    """Precision, recall, F1, accuracy, Brier score, log loss and ROC-AUC of a score."""
    s = table(spark, d, "events").select((F.floor("value") / 200).alias("p"), F.when(F.col("event_type").isin("purchase", "click"), 1.0).otherwise(0.0).alias("y"))
    out = R.binary_metrics(s, "p", "y", 0.25)
    return out.select(*[G.at_6(F.col(c)).alias(c) for c in out.columns])


@query(
    "a15_rank_metrics",
    f"""WITH r AS (SELECT user_id, event_id, min(event_id) OVER (PARTITION BY user_id) AS truth, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events)
SELECT count(*) AS n, {R6.format('avg(1.0::DOUBLE / r)')} AS mrr, {R6.format('avg(CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END)')} AS top1 FROM r WHERE event_id = truth""",
)
def rank_metrics(spark, d):
    """Mean reciprocal rank of each user's first event among all of theirs by value."""
    e = table(spark, d, "events").select("user_id", "event_id", "value", F.min("event_id").over(W.partitionBy("user_id")).alias("truth"))
    return R.reciprocal_rank(e, "user_id", "value", "event_id", "truth").select("n", G.at_6(F.col("mrr")).alias("mrr"), G.at_6(F.col("top1")).alias("top1"))


@query("a16_mean_of_means", f"WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL) SELECT user_id, {R6.format('avg(v)')} AS v FROM m GROUP BY user_id")
def mean_of_means(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v")).groupBy("user_id").agg(G.at_6(F.avg("v")).alias("v"))


@query("d01_distinct_rows", "SELECT DISTINCT p_brand, p_size FROM part")
def distinct_rows(spark, d):
    return table(spark, d, "part").select("p_brand", "p_size").distinct()


@query("d01_first_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_per_key(spark, d):
    return R.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("d01_last_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_per_key(spark, d):
    return R.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], last=True).select("user_id", "event_id", "event_type")


@query("u01_union_sources", "SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def union_sources(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind")))


@query("u02_intersect_ids", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersect_ids(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "id")
    return o.where("o_orderstatus = 'F'").select("id").intersect(o.where("o_orderstatus = 'O'").select("id"))


@query("u03_except_ids", "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def except_ids(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id")).subtract(table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("id")))


@query("u04_unpivot", "SELECT event_id, 'start_x' AS name, ((event_id * 37) % 10501) / 100.0::DOUBLE AS value FROM events UNION ALL SELECT event_id, 'start_y', ((event_id * 53) % 6801) / 100.0::DOUBLE FROM events")
def unpivot(spark, d):
    return R.wide_to_long(lens.raw_actions(spark, d), ["event_id"], ["start_x", "start_y"], "name", "value")


@query("n31_pivot_wide", with_actions("SELECT match_id, " + ", ".join(f"max(CASE WHEN object_id = '{o}' THEN start_{c} END) AS {o}_start_{c}" for o in ("home_1", "away_1", "home_7") for c in "xy") + " FROM a GROUP BY match_id"))
def pivot_wide(spark, d):
    """A wide view of some objects, for export only."""
    return R.long_to_wide(lens.raw_actions(spark, d), ["match_id"], "object_id", ["home_1", "away_1", "home_7"], ["start_x", "start_y"])


@query("o01_sorted_rank", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC NULLS LAST, c_custkey) AS place FROM customer")
def sorted_rank(spark, d):
    """Place in an order of mixed direction: places inside ranges, plus the sizes of the ranges before."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    inside = F.row_number().over(W.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey"))
    sizes = c.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    before = sizes.select("c_mktsegment", F.coalesce(F.sum("n").over(W.orderBy("c_mktsegment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return c.withColumn("inside", inside).join(before, "c_mktsegment").select("c_custkey", (F.col("inside") + F.col("before")).cast("long").alias("place"))


@query("o02_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def first_rows(spark, d):
    """A top-20 report."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@query("o03_sample", "SELECT event_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR)) LIMIT 200")
def sample(spark, d):
    """200 rows without replacement: a sampling operator."""
    return R.sample(table(spark, d, "events").select("event_id"), F.col("event_id"), 200)


@query("o04_top_per_group", "SELECT user_id, event_id, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def top_per_group(spark, d):
    return R.top_per_group(table(spark, d, "events"), ["user_id"], [F.col("value").desc(), F.col("event_id")], 3).select("user_id", "event_id", "value", "rank")
