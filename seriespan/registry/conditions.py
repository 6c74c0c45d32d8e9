"""Conditions, events and alignment over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas
from ..functions.curves import interpolated
from ..operators import events as ev
from ..operators.align import hold_onto, role_grid
from ..operators.conditions import Band, Threshold, any_bit, first_true, judge, limit, outside
from ..operators.ordered import LOG_TIME, attach_splits
from ..plans.views import counters, samples
from . import query

DAY = 86_400_000


def by_log(spark, d):
    return attach_splits(samples(spark, d), LOG_TIME)


HYST = """{S}, c AS (
  SELECT *, CASE WHEN v >= 60 THEN TRUE WHEN v <= 30 THEN FALSE END AS dec FROM s
), h AS (
  SELECT *, coalesce(last_value(dec IGNORE NULLS) OVER w, FALSE) AS hi FROM c
  WINDOW w AS (PARTITION BY log_id ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), r AS (
  SELECT *, sum(CASE WHEN hi IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER
    (PARTITION BY log_id ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM (SELECT *, lag(hi) OVER (PARTITION BY log_id ORDER BY t_ms, seq) AS prev FROM h)
), e AS (
  SELECT log_id, run, min(t_ms) AS t_start, max(t_ms) AS t_end, count(*) AS n, max(v) AS peak
  FROM r WHERE hi GROUP BY log_id, run
)"""


def _hyst(spark, d):
    return judge(by_log(spark, d), LOG_TIME, {"hi": Threshold(F.col("v"), 60.0, 30.0)})


@query("hysteresis_condition", HYST + " SELECT log_id, seq, hi FROM h")
def hysteresis_condition(spark, d):
    return _hyst(spark, d).select("log_id", "seq", "hi")


@query("hysteresis_runs", HYST + " SELECT log_id, t_start, t_end, n, peak FROM e WHERE n >= 2")
def hysteresis_runs(spark, d):
    found = ev.events(
        _hyst(spark, d), LOG_TIME, F.col("hi"), min_samples=2, aggregates={"peak": ("max", F.col("v"))}
    )
    return found.select("log_id", "t_start", "t_end", "n", "peak")


@query(
    "accumulated_time",
    HYST + " SELECT log_id, round(sum(t_end - t_start) / 1000.0, 3) AS seconds, count(*) AS events FROM e GROUP BY log_id",
)
def accumulated_time(spark, d):
    out = ev.accumulated_time(ev.events(_hyst(spark, d), LOG_TIME, F.col("hi")), ["log_id"])
    return out.withColumn("seconds", F.round("seconds", 3))


@query(
    "crossings",
    HYST + """ SELECT log_id, CAST(coalesce(sum(CASE WHEN hi <> prev THEN 1 ELSE 0 END), 0) AS BIGINT) AS crossings
  FROM r GROUP BY log_id""",
)
def crossings(spark, d):
    return ev.crossings(_hyst(spark, d), LOG_TIME, F.col("hi"))


@query("event_cap", HYST + " SELECT log_id, count(*) AS events FROM e GROUP BY log_id HAVING count(*) > 5")
def event_cap(spark, d):
    found = ev.events(_hyst(spark, d), LOG_TIME, F.col("hi"))
    return ev.over_event_cap(found, ["log_id"], 5)


BAND = """{S}, c AS (
  SELECT *, CASE WHEN v >= 20 THEN TRUE WHEN v <= 16 THEN FALSE END AS d1,
            CASE WHEN v <= 60 THEN TRUE WHEN v >= 64 THEN FALSE END AS d2 FROM s
), h AS (
  SELECT *, coalesce(last_value(d1 IGNORE NULLS) OVER w, FALSE)
        AND coalesce(last_value(d2 IGNORE NULLS) OVER w, FALSE) AS inside FROM c
  WINDOW w AS (PARTITION BY log_id ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), r AS (
  SELECT *, sum(CASE WHEN inside IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER
    (PARTITION BY log_id ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM (SELECT *, lag(inside) OVER (PARTITION BY log_id ORDER BY t_ms, seq) AS prev FROM h)
) SELECT log_id, min(t_ms) AS t_start, max(t_ms) AS t_end, count(*) AS n, min(v) AS low
  FROM r WHERE inside GROUP BY log_id, run HAVING max(t_ms) - min(t_ms) >= 3600000"""


@query("band_runs", BAND)
def band_runs(spark, d):
    j = judge(by_log(spark, d), LOG_TIME, {"inside": Band(F.col("v"), 20.0, 60.0, 0.1)})
    found = ev.events(
        j, LOG_TIME, F.col("inside"), min_ms=3_600_000, aggregates={"low": ("min", F.col("v"))}
    )
    return found.select("log_id", "t_start", "t_end", "n", "low")


@query(
    "state_lanes",
    """{S}, r AS (
  SELECT *, sum(CASE WHEN channel_id IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER
    (PARTITION BY log_id ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM (SELECT *, lag(channel_id) OVER (PARTITION BY log_id ORDER BY t_ms, seq) AS prev FROM s)
) SELECT log_id, channel_id AS state, min(t_ms) AS t_start, max(t_ms) AS t_end, count(*) AS n
  FROM r GROUP BY log_id, run, channel_id""",
)
def state_lanes(spark, d):
    return ev.state_lanes(by_log(spark, d), LOG_TIME, F.col("channel_id")).select(
        "log_id", "state", "t_start", "t_end", "n"
    )


@query(
    "state_transitions",
    """{S}, p AS (SELECT *, lag(channel_id) OVER (PARTITION BY log_id ORDER BY t_ms, seq) AS prev FROM s)
  SELECT log_id, t_ms, seq, prev AS from_state, channel_id AS to_state FROM p WHERE prev <> channel_id""",
)
def state_transitions(spark, d):
    return ev.transitions(by_log(spark, d), LOG_TIME, F.col("channel_id"))


ASOF = """{S}, c AS (SELECT * FROM s WHERE channel_id = 'click'),
  w AS (SELECT * FROM s WHERE channel_id = 'view')
"""


@query(
    "hold_asof",
    ASOF + """SELECT c.log_id, c.seq, c.t_ms, c.v,
    CASE WHEN c.t_ms - w.t_ms <= 86400000 THEN w.v END AS held
  FROM c ASOF LEFT JOIN w ON c.log_id = w.log_id AND c.t_ms >= w.t_ms""",
)
def hold_asof(spark, d):
    out = hold_onto(
        by_log(spark, d), F.col("channel_id") == "click", {"held": F.col("channel_id") == "view"}, DAY
    )
    return out.select("log_id", "seq", "t_ms", "v", "held")


GRID = """{S}, base AS (SELECT * FROM s WHERE channel_id = 'click'),
  g1 AS (SELECT b.*, CASE WHEN b.t_ms - w.t_ms <= 172800000 THEN w.v END AS view
    FROM base b ASOF LEFT JOIN (SELECT * FROM s WHERE channel_id = 'view') w
    ON b.log_id = w.log_id AND b.t_ms >= w.t_ms),
  g2 AS (SELECT b.*, CASE WHEN b.t_ms - w.t_ms <= 172800000 THEN w.v END AS error
    FROM g1 b ASOF LEFT JOIN (SELECT * FROM s WHERE channel_id = 'error') w
    ON b.log_id = w.log_id AND b.t_ms >= w.t_ms)
"""


def _grid(spark, d):
    return role_grid(samples(spark, d), "click", ["view", "error"], 2 * DAY)


@query("role_grid", GRID + "SELECT log_id, seq, t_ms, v AS click, view, error FROM g2")
def roles_on_grid(spark, d):
    return _grid(spark, d).select("log_id", "seq", "t_ms", "click", "view", "error")


@query(
    "kleene_compose",
    GRID + """SELECT log_id, seq, (v > 40 AND view > 40) AS both_high, (v > 40 OR view > 40) AS any_high,
    NOT (view > 40) AS view_low FROM g2""",
)
def kleene_compose(spark, d):
    a, b = F.col("click") > 40, F.col("view") > 40
    return _grid(spark, d).select(
        "log_id", "seq", (a & b).alias("both_high"), (a | b).alias("any_high"), (~b).alias("view_low")
    )


@query(
    "precedence",
    GRID + """SELECT log_id, seq, (view > 60) AS first_c, (error > 60) AND NOT (view > 60) AS second_c,
    (v > 20) AND NOT ((view > 60) OR (error > 60)) AS third_c FROM g2""",
)
def precedence(spark, d):
    exclusive = first_true(
        {"first_c": F.col("view") > 60, "second_c": F.col("error") > 60, "third_c": F.col("click") > 20}
    )
    return _grid(spark, d).select("log_id", "seq", *[c.alias(n) for n, c in exclusive.items()])


@query(
    "derived_channels",
    GRID + """SELECT log_id, seq, round(v / nullif(view, 0) - 1, 6) AS lambda_error, round(v * view, 6) AS afr,
    round(v - error, 6) AS relative_boost, round(v / nullif(error, 0), 6) AS pressure_ratio,
    round(view - error, 6) AS boost_error, round(error - v, 6) AS wheel_slip,
    CASE WHEN view IS NULL OR error IS NULL THEN NULL ELSE least(v, view, error) END AS smallest,
    CASE WHEN view IS NULL OR error IS NULL THEN NULL ELSE greatest(v, view, error) END AS largest FROM g2""",
)
def derived_channels(spark, d):
    c, v, e = F.col("click"), F.col("view"), F.col("error")
    return _grid(spark, d).select(
        "log_id", "seq",
        F.round(formulas.lambda_error(c, v), 6).alias("lambda_error"),
        F.round(formulas.air_fuel_ratio(c, v), 6).alias("afr"),
        F.round(formulas.gauge_boost(c, e), 6).alias("relative_boost"),
        F.round(formulas.pressure_ratio(c, e), 6).alias("pressure_ratio"),
        F.round(formulas.boost_error(v, e), 6).alias("boost_error"),
        F.round(formulas.wheel_slip(e, c), 6).alias("wheel_slip"),
        formulas.smallest(c, v, e).alias("smallest"),
        formulas.largest(c, v, e).alias("largest"),
    )


@query(
    "bit_predicate",
    """SELECT user_id AS log_id, event_id AS seq, k & 5 <> 0 AS low_bits, k <> 0 AS any_bits FROM (
    SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def bit_predicate(spark, d):
    k = F.col("k")
    return counters(spark, d).select(
        "log_id", "seq", any_bit(k, 5).alias("low_bits"), any_bit(k).alias("any_bits")
    )


@query(
    "out_of_range",
    "{S} SELECT log_id, seq, (v < 5 OR v > 150) AS off_both, v > 150 AS off_high FROM s",
)
def out_of_range(spark, d):
    v = F.col("v")
    return samples(spark, d).select(
        "log_id", "seq", outside(v, 5.0, 150.0).alias("off_both"), outside(v, None, 150.0).alias("off_high")
    )


CURVE = """CASE WHEN view <= 10 THEN 20.0 WHEN view <= 50 THEN 20 + (view - 10) * 1.0
    WHEN view <= 150 THEN 60 + (view - 50) * 0.4 ELSE CASE WHEN view > 150 THEN 100.0 END END"""


@query("limit_curve", GRID + f"SELECT log_id, seq, round({CURVE}, 6) AS curve FROM g2")
def limit_curve(spark, d):
    curve = interpolated(F.col("view"), [(10, 20), (50, 60), (150, 100)])
    return _grid(spark, d).select("log_id", "seq", F.round(curve, 6).alias("curve"))


@query(
    "alert_limit",
    GRID + f""", lim AS (SELECT *, {CURVE} AS cap FROM g2),
  dec AS (SELECT *, CASE WHEN cap IS NULL THEN NULL WHEN v >= cap THEN TRUE WHEN v <= cap - abs(cap) * 0.2 THEN FALSE END AS dd FROM lim),
  h AS (SELECT *, CASE WHEN cap IS NOT NULL THEN coalesce(last_value(dd IGNORE NULLS) OVER
    (PARTITION BY log_id ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) END AS alert FROM dec)
  SELECT log_id, seq, alert FROM h""",
)
def alert_limit(spark, d):
    curve = interpolated(F.col("view"), [(10, 20), (50, 60), (150, 100)])
    j = judge(
        _grid(spark, d).withColumn("cap", curve),
        LOG_TIME,
        {"alert": limit(F.col("click"), F.col("cap"), above=True, margin=0.2)},
    )
    return j.select("log_id", "seq", "alert")


@query(
    "alert_band",
    GRID + f""", lim AS (SELECT *, {CURVE} AS cap FROM g2),
  dec AS (SELECT *, CASE WHEN cap IS NULL THEN NULL WHEN v >= 10 THEN TRUE WHEN v <= 10 - (cap - 10) * 0.25 THEN FALSE END AS d1,
    CASE WHEN cap IS NULL THEN NULL WHEN v <= cap THEN TRUE WHEN v >= cap + (cap - 10) * 0.25 THEN FALSE END AS d2 FROM lim),
  h AS (SELECT *, CASE WHEN cap IS NOT NULL THEN coalesce(last_value(d1 IGNORE NULLS) OVER w, FALSE)
     AND coalesce(last_value(d2 IGNORE NULLS) OVER w, FALSE) END AS inside FROM dec
    WINDOW w AS (PARTITION BY log_id ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT log_id, seq, inside FROM h""",
)
def alert_band(spark, d):
    curve = interpolated(F.col("view"), [(10, 20), (50, 60), (150, 100)])
    j = judge(
        _grid(spark, d).withColumn("cap", curve),
        LOG_TIME,
        {"inside": Band(F.when(F.col("cap").isNotNull(), F.col("click")), F.lit(10.0), F.col("cap"), 0.25)},
    )
    return j.select("log_id", "seq", "inside")
