"""Data quality queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from ..operators.ordered import LOG_FILE, attach_splits
from ..plans.views import samples, table
from . import query

STEPS = """{S}, d AS (SELECT *, lag(t_ms) OVER (PARTITION BY log_id ORDER BY seq) AS t_prev FROM s),
  p AS (SELECT log_id, quantile_cont(t_ms - t_prev, 0.5) AS period_ms FROM d WHERE t_ms - t_prev > 0 GROUP BY log_id)
"""


def by_file(spark, d):
    return attach_splits(samples(spark, d), LOG_FILE)


@query("typical_period", STEPS + "SELECT log_id, period_ms FROM p")
def typical_period(spark, d):
    return q.typical_period(by_file(spark, d), LOG_FILE)


GAPS = STEPS + """SELECT log_id, t_prev AS t_start, t_ms AS t_end, t_ms - t_prev AS duration_ms,
    round((t_ms - t_prev) / period_ms, 6) AS factor FROM d JOIN p USING (log_id) WHERE t_ms - t_prev > 3 * period_ms"""


@query("sampling_gaps", GAPS)
def sampling_gaps(spark, d):
    return q.gaps(by_file(spark, d), 3.0, LOG_FILE).withColumn("factor", F.round("factor", 6))


SHUFFLED = """{S}, j AS (SELECT *, t_ms - (seq % 7) * 3600000 AS t FROM s),
  d AS (SELECT *, lag(t) OVER (PARTITION BY log_id ORDER BY seq) AS t_prev FROM j)
"""


@query(
    "clock_jumps",
    SHUFFLED + "SELECT log_id, seq, t_prev AS t_start, t AS t_end, t - t_prev AS dt FROM d WHERE t < t_prev",
)
def clock_jumps(spark, d):
    s = by_file(spark, d).withColumn("t", F.col("t_ms") - (F.col("seq") % 7) * 3_600_000)
    return q.clock_jumps(s, LOG_FILE, "t")


@query(
    "midnight_unwrap",
    """{S}, c AS (SELECT *, (t_ms // 1000) % 86400 AS sod FROM s),
  d AS (SELECT *, sod - lag(sod) OVER (PARTITION BY log_id ORDER BY seq) AS step FROM c)
  SELECT log_id, seq, coalesce(step < 0 AND step >= -43200, FALSE) AS anomaly,
    sod + 86400 * CAST(sum(CASE WHEN step < -43200 THEN 1 ELSE 0 END) OVER
      (PARTITION BY log_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS t_abs_s FROM d""",
)
def midnight_unwrap(spark, d):
    s = by_file(spark, d).withColumn("sod", F.floor(F.col("t_ms") / 1000) % 86400)
    return q.unwrap_midnight(s, "sod", LOG_FILE).select("log_id", "seq", "anomaly", "t_abs_s")


@query(
    "channel_stats",
    """{S} SELECT log_id, channel_id, count(v) AS n, min(v) AS v_min, max(v) AS v_max,
    round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.5), 6) AS p50,
    round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, count(v) = 0 AS is_empty,
    min(v) = max(v) AS is_constant, bool_or(v > 300) AS outside_declared,
    (count(v) > 0 AND min(v) <> max(v) AND NOT bool_or(v > 300)) AS is_active FROM s GROUP BY log_id, channel_id""",
)
def channel_stats(spark, d):
    out = q.channel_stats(samples(spark, d), ["log_id", "channel_id"], declared_hi=F.lit(300.0))
    return out.withColumns({c: F.round(c, 6) for c in q.STAT_QUANTILES})


LONG_LINES = """WITH s AS (SELECT l_suppkey AS log_id, l_orderkey * 8 + l_linenumber AS seq, u.channel_id FROM lineitem,
    (VALUES ('discount'), ('tax'), ('qty'), ('price')) u(channel_id)
    WHERE (u.channel_id IN ('discount', 'tax') AND l_linenumber % 2 = 1) OR u.channel_id IN ('qty', 'price')),
  g AS (SELECT log_id, channel_id, list(seq ORDER BY seq) AS rows, count(*) AS n FROM s GROUP BY 1, 2)
  SELECT log_id, min(channel_id) AS lead_channel, string_agg(channel_id, ',' ORDER BY channel_id) AS channels, any_value(n) AS n
  FROM g GROUP BY log_id, rows"""


@query("sampling_groups", LONG_LINES)
def sampling_groups(spark, d):
    li = table(spark, d, "lineitem")
    odd = F.col("l_linenumber") % 2 == 1
    names = F.array_compact(
        F.array(F.when(odd, "discount"), F.when(odd, "tax"), F.lit("qty"), F.lit("price"))
    )
    s = li.select(
        F.col("l_suppkey").alias("log_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.explode(names).alias("channel_id"),
    )
    return q.sampling_groups(s).withColumn("channels", F.array_join("channels", ","))
