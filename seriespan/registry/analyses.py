"""Specified analyses: overlays, summaries, health checks, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formulas import lambda_error
from ..operators.align import role_grid
from ..operators.conditions import Threshold, judge
from ..operators.events import events
from ..operators.ordered import CHANNEL_TIME, LOG_TIME, attach_splits
from ..plans import analyses as an
from ..plans.views import counters, samples, table
from . import query
from .phases import DAY
from .sql import held, hyst, num, runs

E5 = [0.0, 20.0, 50.0, 100.0, 1000.0]


def _bin(c: str) -> str:
    return f"CASE WHEN {c} >= 0 AND {c} <= 1000 THEN ({c} >= 20)::INT + ({c} >= 50)::INT + ({c} >= 100)::INT END"


G3 = "{S}, b AS (SELECT * FROM s WHERE channel_id = 'click'), " + held("b", "b1", "view", "view", 2 * DAY) + ", " + held("b1", "g", "error", "error", 2 * DAY)


def _grid(spark, d):
    return role_grid(samples(spark, d), "click", ["view", "error"], 2 * DAY)


def _mesh_sql(value: str) -> str:
    return f"""SELECT i, j, count(v0) AS n, round(avg(v0), 6) AS mean, round(stddev_pop(v0), 6) AS sd, round(min(v0), 6) AS lo, round(max(v0), 6) AS hi
    FROM (SELECT {_bin('v')} AS i, {_bin('view')} AS j, {value} AS v0 FROM g) WHERE i IS NOT NULL AND j IS NOT NULL AND v0 IS NOT NULL GROUP BY 1, 2"""


def _r(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "lo", "hi")})


@query("advance_map", G3 + " " + _mesh_sql("error"))
def advance_map(spark, d):
    return _r(an.advance_map(_grid(spark, d), "click", "view", "error", E5, E5))


@query("lambda_error_map", G3 + " " + _mesh_sql("v / nullif(error, 0) - 1"))
def lambda_error_map(spark, d):
    return _r(an.error_map(_grid(spark, d), "click", "view", lambda_error(F.col("click"), F.col("error")), E5, E5))


@query(
    "knock_density_map",
    G3.replace(" g AS", " g0 AS") + """, l AS (SELECT *, error - lag(error) OVER (PARTITION BY log_id ORDER BY t_ms, seq) AS step FROM g0),
  g AS (SELECT * FROM l WHERE step > 0) """ + _mesh_sql("step"),
)
def knock_density_map(spark, d):
    return _r(an.knock_density(_grid(spark, d), "click", "view", "error", E5, E5))


RUNS = G3 + f", c AS (SELECT *, {hyst('v', num(40), num(20))} AS hit FROM g), " + runs("c", "coalesce(hit, FALSE)", "r") + """,
  sg AS (SELECT log_id, run, min(t_ms) AS run_start, max(t_ms) AS run_end FROM r WHERE st GROUP BY 1, 2),
  x AS (SELECT r.*, run_start, run_end FROM r JOIN sg USING (log_id, run) WHERE st)
"""


def _in_runs(spark, d):
    g = _grid(spark, d)
    segments = events(judge(g, LOG_TIME, {"hit": Threshold(F.col("click"), 40.0, 20.0)}), LOG_TIME, F.col("hit"))
    return an.samples_in_segments(g, segments, 5 * DAY)


@query("samples_in_segments", RUNS + "SELECT log_id, seq, run_start, run_end FROM x")
def samples_in_segments(spark, d):
    return _in_runs(spark, d).select("log_id", "seq", "run_start", "run_end")


@query(
    "run_overlay",
    RUNS + f"SELECT log_id, run_start, {_bin('v')} AS bin, count(*) AS n, round(avg(view), 6) AS view, round(avg(error), 6) AS error FROM x WHERE {_bin('v')} IS NOT NULL GROUP BY 1, 2, 3",
)
def run_overlay(spark, d):
    out = an.run_overlay(_in_runs(spark, d), "click", ["view", "error"], E5)
    return out.withColumns({c: F.round(c, 6) for c in ("view", "error")})


@query(
    "run_summary",
    RUNS + """SELECT log_id, run_start, run_end, round((run_end - run_start) / 1000.0, 3) AS seconds, arg_min(v, seq) AS rpm_start, arg_max(v, seq) AS rpm_end,
    max(view) AS boost_max, min(error) AS lambda_min, round(coalesce(sum(CASE WHEN error > 50 THEN error END), 0), 6) AS knock FROM x GROUP BY 1, 2, 3""",
)
def run_summary(spark, d):
    rows = _in_runs(spark, d).withColumn("knock_step", F.when(F.col("error") > 50, F.col("error")))
    out = an.run_summary(rows, "click", "view", "error", "knock_step")
    return out.withColumns({"seconds": F.round("seconds", 3), "knock": F.round("knock", 6)})


@query(
    "actuator_saturation",
    """{S}, p AS (SELECT *, lag((v <= 10 OR v >= 80)) OVER w AS pf, t_ms - lag(t_ms) OVER w AS dt FROM s WINDOW w AS (PARTITION BY log_id, channel_id ORDER BY t_ms, seq))
  SELECT log_id, channel_id, round(sum(CASE WHEN pf THEN dt ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN pf IS NOT NULL THEN dt END), 0), 6) AS saturated_share FROM p GROUP BY 1, 2""",
)
def actuator_saturation(spark, d):
    s = attach_splits(samples(spark, d), CHANNEL_TIME)
    out = an.actuator_saturation(s, CHANNEL_TIME, F.col("v"), 10.0, 80.0)
    return out.withColumn("saturated_share", F.round("saturated_share", 6))


@query(
    "idle_metrics",
    """{S}, e AS (SELECT *, v - 50 AS err FROM s WHERE channel_id = 'signup'),
  p AS (SELECT *, (err >= 0) <> lag(err >= 0) OVER (PARTITION BY log_id ORDER BY t_ms, seq) AS x FROM e)
  SELECT log_id, round(sqrt(avg(err * err)), 6) AS rms, round(avg((abs(err) <= 20)::INT), 6) AS settled_share, CAST(count(*) FILTER (x) AS BIGINT) AS crossings FROM p GROUP BY log_id""",
)
def idle_metrics(spark, d):
    s = attach_splits(samples(spark, d).filter("channel_id = 'signup'"), LOG_TIME)
    out = an.idle_metrics(s, LOG_TIME, F.col("v") - 50, 20.0)
    return out.withColumns({c: F.round(c, 6) for c in ("rms", "settled_share")})


@query(
    "idle_recovery",
    "{S}, e AS (SELECT *, abs(v - 50) > 20 AS bad FROM s WHERE channel_id = 'signup'), " + runs("e", "bad", "r")
    + " SELECT log_id, min(t_ms) AS t_start, round((max(t_ms) - min(t_ms)) / 1000.0, 3) AS seconds, count(*) AS n FROM r WHERE st GROUP BY log_id, run",
)
def idle_recovery(spark, d):
    s = attach_splits(samples(spark, d).filter("channel_id = 'signup'"), LOG_TIME)
    return an.recovery_times(s, LOG_TIME, F.col("v") - 50, 20.0).withColumn("seconds", F.round("seconds", 3))


@query("sum_check", G3 + " SELECT log_id, seq, round(v - (view + error), 6) AS difference FROM g WHERE abs(v - (view + error)) > 30")
def sum_check(spark, d):
    out = an.sum_check(_grid(spark, d), F.col("click"), [F.col("view"), F.col("error")], 30.0)
    return out.select("log_id", "seq", F.round("difference", 6).alias("difference"))


@query(
    "sensor_health",
    """WITH k AS (SELECT user_id AS log_id, event_type AS channel_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 AS v, event_id AS seq FROM events),
  d AS (SELECT *, v - lag(v) OVER (PARTITION BY log_id, channel_id ORDER BY seq) AS dv, max(v) OVER (PARTITION BY log_id, channel_id) AS hi, min(v) OVER (PARTITION BY log_id, channel_id) AS lo FROM k)
  SELECT log_id, channel_id, round(avg((v = hi)::INT), 6) AS at_max, round(avg((v = lo)::INT), 6) AS at_min, round(stddev_pop(dv), 6) AS noise FROM d GROUP BY 1, 2""",
)
def sensor_health(spark, d):
    k = attach_splits(counters(spark, d).withColumn("v", F.col("k") % 6), CHANNEL_TIME)
    out = an.sensor_health(k, ["log_id", "channel_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("at_max", "at_min", "noise")})


@query(
    "triage_table",
    """{S} SELECT log_id, max(v) FILTER (channel_id = 'click') AS rpm_max, round(avg(v) FILTER (channel_id = 'view'), 6) AS boost_avg,
    min(v) FILTER (channel_id = 'error' AND v > 150) AS lambda_min, count(v) FILTER (channel_id = 'click') AS samples FROM s GROUP BY log_id""",
)
def triage_table(spark, d):
    low = (F.col("channel_id") == "error") & (F.col("v") <= 150)
    s = samples(spark, d).withColumn("v", F.when(~low, F.col("v")))
    out = an.triage_table(
        s,
        {"rpm_max": ("click", "max"), "boost_avg": ("view", "avg"), "lambda_min": ("error", "min"), "samples": ("click", "count")},
        s.select("log_id").distinct(),
    )
    return out.withColumn("boost_avg", F.round("boost_avg", 6))


@query(
    "declared_span_stats",
    """SELECT l_returnflag AS log_id, u.channel_id, count(*) AS n, round(min(u.v), 4) AS lo, round(max(u.v), 4) AS hi FROM lineitem,
    LATERAL (VALUES ('qty', l_quantity), ('price', l_extendedprice), ('disc', l_discount), ('tax', l_tax)) u(channel_id, v) GROUP BY 1, 2""",
)
def declared_span_stats(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("log_id"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
    )
    long = li.unpivot(["log_id"], ["qty", "price", "disc", "tax"], "channel_id", "v")
    return long.groupBy("log_id", "channel_id").agg(
        F.count("v").alias("n"), F.round(F.min("v"), 4).alias("lo"), F.round(F.max("v"), 4).alias("hi")
    )
