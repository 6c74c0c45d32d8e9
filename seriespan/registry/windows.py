"""Range-frame and row-to-row operators over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as win
from ..operators.ordered import CHANNEL_TIME, LOG_TIME, attach_splits
from ..plans.views import counters
from . import query
from .conditions import DAY, by_log

EDGE = "min(t_ms) OVER (PARTITION BY log_id) AS t_first, max(t_ms) OVER (PARTITION BY log_id) AS t_last"


@query(
    "derivative",
    """{S}, w AS (SELECT *, first_value(struct_pack(t := t_ms, v := v)) OVER
    (PARTITION BY log_id ORDER BY t_ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS b FROM s)
  SELECT log_id, seq, round(CASE WHEN t_ms > b.t THEN (v - b.v) / ((t_ms - b.t) / 1000.0) END, 9) AS slope FROM w""",
)
def derivative(spark, d):
    out = win.derivative(by_log(spark, d), LOG_TIME, F.col("v"), DAY, "slope")
    return out.select("log_id", "seq", F.round("slope", 9).alias("slope"))


K = """WITH k AS (SELECT user_id AS log_id, event_type AS channel_id, event_id AS seq,
    CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS t_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
  l AS (SELECT *, k - lag(k) OVER (PARTITION BY log_id, channel_id ORDER BY t_ms, seq) AS step FROM k)
"""


@query("counter_delta", K + "SELECT log_id, channel_id, seq, CASE WHEN step >= 0 THEN step END AS step FROM l")
def counter_delta(spark, d):
    k = attach_splits(counters(spark, d), CHANNEL_TIME)
    return win.counter_delta(k, CHANNEL_TIME, F.col("k"), "step").select("log_id", "channel_id", "seq", "step")


@query("plain_delta", K + "SELECT log_id, channel_id, seq, step FROM l")
def plain_delta(spark, d):
    k = attach_splits(counters(spark, d), CHANNEL_TIME)
    return win.plain_delta(k, CHANNEL_TIME, F.col("k"), "step").select("log_id", "channel_id", "seq", "step")


def _extreme_sql(lo: int, hi: int, fn: str) -> str:
    a = f"{-lo} PRECEDING" if lo <= 0 else f"{lo} FOLLOWING"
    b = f"{hi} FOLLOWING" if hi >= 0 else f"{-hi} PRECEDING"
    return f"""{{S}}, w AS (SELECT *, {EDGE}, {fn}(v) OVER (PARTITION BY log_id ORDER BY t_ms
    RANGE BETWEEN {a} AND {b}) AS x FROM s)
  SELECT log_id, seq, CASE WHEN t_ms + {lo} >= t_first AND t_ms + {hi} <= t_last THEN x END AS x FROM w"""


@query("window_extreme", _extreme_sql(-43200000, 43200000, "max"))
def window_extreme(spark, d):
    out = win.window_extreme(by_log(spark, d), LOG_TIME, F.col("v"), -DAY // 2, DAY // 2, "max", "x")
    return out.select("log_id", "seq", "x")


@query("window_extreme_ahead", _extreme_sql(3600000, 86400000, "min"))
def window_extreme_ahead(spark, d):
    out = win.window_extreme(by_log(spark, d), LOG_TIME, F.col("v"), 3_600_000, DAY, "min", "x")
    return out.select("log_id", "seq", "x")


@query(
    "local_peak",
    f"""{{S}}, w AS (SELECT *, {EDGE}, max(v) OVER f AS hi, min(v) OVER f AS lo FROM s
    WINDOW f AS (PARTITION BY log_id ORDER BY t_ms RANGE BETWEEN 43200000 PRECEDING AND 43200000 FOLLOWING)),
  c AS (SELECT *, coalesce(v >= hi AND v - lo >= 20, FALSE)::INT AS core FROM w),
  n AS (SELECT *, max(core) OVER (PARTITION BY log_id ORDER BY t_ms RANGE BETWEEN 43200000 PRECEDING AND 43200000 FOLLOWING) AS near FROM c)
  SELECT log_id, seq, CASE WHEN t_ms - 43200000 >= t_first AND t_ms + 43200000 <= t_last THEN v >= hi AND near > 0 END AS peak FROM n""",
)
def local_peak(spark, d):
    return win.local_peak(by_log(spark, d), LOG_TIME, F.col("v"), 20.0, DAY, "peak").select("log_id", "seq", "peak")


@query(
    "hold_after_trigger",
    f"""{{S}}, w AS (SELECT *, {EDGE}, max((v > 100)::INT) OVER (PARTITION BY log_id ORDER BY t_ms
    RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS x FROM s)
  SELECT log_id, seq, CASE WHEN t_ms - 86400000 >= t_first THEN x > 0 END AS held FROM w""",
)
def hold_after_trigger(spark, d):
    return win.hold_after(by_log(spark, d), LOG_TIME, F.col("v") > 100, DAY, "held").select("log_id", "seq", "held")


@query(
    "moving_average",
    """{S} SELECT log_id, seq, round(avg(v) OVER (PARTITION BY log_id ORDER BY t_ms
    RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW), 6) AS mean FROM s""",
)
def moving_average(spark, d):
    out = win.moving_average(by_log(spark, d), LOG_TIME, F.col("v"), DAY, "mean")
    return out.select("log_id", "seq", F.round("mean", 6).alias("mean"))
