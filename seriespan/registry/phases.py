"""Phases, exclusion, gears and step responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boost, exclusion, gears, phases
from ..operators.align import role_grid
from ..operators.events import events
from ..operators.conditions import judge, limit as alert
from ..operators.mesh import mesh
from ..operators.ordered import LOG_TIME, attach_splits
from ..plans.views import samples, table
from . import query
from .sql import L, W, band, held, hyst, limit, num, runs

DAY = 86_400_000
LIM = phases.PhaseLimits(
    rising_rpm_per_s=-0.001, steady_rpm_per_s=0.02, closed_enter=0.1, closed_leave=0.2, wot_enter=0.5,
    wot_leave=0.4, slope_window_ms=3 * DAY, min_samples=1,
    min_s={"wot": 3600.0, "start": 0.0, "deceleration": 3600.0, "idle": 0.0, "cruise": 0.0},
)


def _grid(spark, d):
    s = samples(spark, d).withColumn(
        "v", F.when(F.col("channel_id") == "click", F.col("v") * 40).otherwise(F.col("v") / 150)
    )
    return role_grid(s, "click", ["view"], 2 * DAY)


def _judged(spark, d):
    return phases.phase_conditions(_grid(spark, d), "click", "view", LIM)


PHASE = (
    """{S}, g0 AS (SELECT log_id, seq, t_ms, v * 40 AS rpm FROM s WHERE channel_id = 'click'),
  sv AS (SELECT log_id, channel_id, t_ms, v / 150 AS v FROM s),
  """
    + held("g0", "g", "view", "tps", 2 * DAY, "sv")
    + f""", dv AS (SELECT *, first_value(struct_pack(t := t_ms, v := rpm)) OVER
    (PARTITION BY log_id ORDER BY t_ms RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW) AS b FROM g),
  sl AS (SELECT *, CASE WHEN t_ms > b.t THEN (rpm - b.v) / ((t_ms - b.t) / 1000.0::DOUBLE) END AS slope FROM dv),
  cn AS (SELECT *, {band('rpm', num(50), num(500), 0.02)} AS c_start,
    {hyst('tps', num(0.1), num(0.2), False)} AS c_closed, {hyst('tps', num(0.5), num(0.4))} AS c_open,
    {hyst('rpm', num(2000), num(1400))} AS c_fast, {band('rpm', num(500), num(1400), 0.02)} AS c_idle,
    {hyst('rpm', num(500), num(50))} AS c_run, {band('slope', num(-0.02), num(0.02), 0.02)} AS c_steady,
    {band('tps', num(0.1), num(0.5), 0.02)} AS c_part FROM sl),
  k AS (SELECT *, c_start AS k1, c_open AS k2, c_closed AND c_fast AS k3, c_closed AND c_idle AS k4, c_part AND c_run AND c_steady AS k5 FROM cn),
  ex AS (SELECT *, k1 AS e1, k2 AND NOT k1 AS e2, k3 AND NOT (k1 OR k2) AS e3, k4 AND NOT (k1 OR k2 OR k3) AS e4,
    k5 AND NOT (k1 OR k2 OR k3 OR k4) AS e5 FROM k),
  """
    + runs("ex", "CASE WHEN e1 THEN 'start' WHEN e2 THEN 'wot' WHEN e3 THEN 'deceleration' WHEN e4 THEN 'idle' WHEN e5 THEN 'cruise' END", "r")
    + """, seg AS (SELECT log_id, st AS phase, min(t_ms) AS t_start, max(t_ms) AS t_end, count(*) AS n,
      (max(t_ms) - min(t_ms)) / 1000.0::DOUBLE AS seconds, arg_min(rpm, seq) AS rpm_start, arg_max(rpm, seq) AS rpm_end,
      max(rpm) AS hi, min(rpm) AS lo FROM r WHERE st IS NOT NULL GROUP BY log_id, run, st),
  vd AS (SELECT *, CASE WHEN seconds > 0 THEN (rpm_end - rpm_start) / seconds ELSE 0 END AS slope FROM seg),
  vv AS (SELECT *, CASE WHEN seconds < CASE WHEN phase IN ('wot', 'deceleration') THEN 3600 ELSE 0 END THEN 'too_short'
      WHEN phase = 'wot' AND slope < -0.001 THEN 'low_slope' ELSE 'accepted' END AS verdict FROM vd)
"""
)


@query(
    "phase_segments",
    PHASE + """SELECT log_id, phase, t_start, t_end, n, round(seconds, 3) AS seconds, round(slope, 6) AS slope,
    round(CASE WHEN phase IN ('deceleration', 'idle') THEN lo ELSE hi END, 4) AS peak FROM vv WHERE verdict = 'accepted'""",
)
def phase_segments(spark, d):
    out = phases.phases(_judged(spark, d), "click", LIM)
    return out.select(
        "log_id", "phase", "t_start", "t_end", "n", F.round("seconds", 3).alias("seconds"),
        F.round("slope", 6).alias("slope"), F.round("peak", 4).alias("peak"),
    )


@query("phase_conditions", PHASE + "SELECT log_id, seq, e1 AS is_start, e2 AS is_wot, e3 AS is_deceleration, e4 AS is_idle, e5 AS is_cruise FROM ex")
def phase_conditions(spark, d):
    return _judged(spark, d).select("log_id", "seq", *[f"is_{p}" for p in phases.PHASES])


@query(
    "phase_coverage",
    PHASE + """, a AS (SELECT log_id, CAST(sum(CASE WHEN verdict = 'accepted' AND phase = 'start' THEN n ELSE 0 END) AS BIGINT) AS start,
      CAST(sum(CASE WHEN verdict = 'accepted' AND phase = 'wot' THEN n ELSE 0 END) AS BIGINT) AS wot,
      CAST(sum(CASE WHEN verdict = 'accepted' AND phase = 'deceleration' THEN n ELSE 0 END) AS BIGINT) AS deceleration,
      CAST(sum(CASE WHEN verdict = 'accepted' AND phase = 'idle' THEN n ELSE 0 END) AS BIGINT) AS idle,
      CAST(sum(CASE WHEN verdict = 'accepted' AND phase = 'cruise' THEN n ELSE 0 END) AS BIGINT) AS cruise,
      CAST(sum(CASE WHEN verdict = 'too_short' THEN n ELSE 0 END) AS BIGINT) AS too_short,
      CAST(sum(CASE WHEN verdict = 'low_slope' THEN n ELSE 0 END) AS BIGINT) AS low_slope FROM vv GROUP BY log_id),
  u AS (SELECT log_id, count(*) AS n, count(*) FILTER (st IS NULL AND coalesce(rpm < 50, FALSE)) AS stopped,
      count(*) FILTER (st IS NULL AND NOT coalesce(rpm < 50, FALSE) AND (e1 IS NULL OR e2 IS NULL OR e3 IS NULL OR e4 IS NULL OR e5 IS NULL)) AS no_data,
      count(*) FILTER (st IS NULL AND NOT coalesce(rpm < 50, FALSE) AND NOT (e1 IS NULL OR e2 IS NULL OR e3 IS NULL OR e4 IS NULL OR e5 IS NULL)) AS no_class
      FROM r GROUP BY log_id)
  SELECT u.log_id, u.n, coalesce(start, 0) AS start, coalesce(wot, 0) AS wot, coalesce(deceleration, 0) AS deceleration,
    coalesce(idle, 0) AS idle, coalesce(cruise, 0) AS cruise, coalesce(too_short, 0) AS too_short, coalesce(low_slope, 0) AS low_slope,
    stopped, no_data, no_class FROM u LEFT JOIN a USING (log_id)""",
)
def phase_coverage(spark, d):
    return phases.coverage(_judged(spark, d), "click", LIM)


@query(
    "phase_seconds",
    PHASE + "SELECT log_id, phase, round(sum(seconds), 3) AS seconds, count(*) AS segments FROM vv WHERE verdict = 'accepted' GROUP BY 1, 2",
)
def phase_seconds(spark, d):
    out = phases.seconds_per_phase(phases.phases(_judged(spark, d), "click", LIM))
    return out.withColumn("seconds", F.round("seconds", 3))


@query(
    "warm_up_phase",
    """{S}, g AS (SELECT * FROM s WHERE channel_id = 'error'), c AS (SELECT *, """
    + limit("v", num(60), False, 0.1) + " AS cold FROM g), " + runs("c", "coalesce(cold, FALSE)", "r")
    + """ SELECT log_id, min(t_ms) AS t_start, max(t_ms) AS t_end, count(*) AS n, min(v) AS t_low FROM r WHERE st GROUP BY log_id, run
    HAVING max(t_ms) - min(t_ms) >= 86400000""",
)
def warm_up_phase(spark, d):
    s = attach_splits(samples(spark, d).filter("channel_id = 'error'"), LOG_TIME)
    return phases.warm_up(s, "v", 60.0, 0.1, DAY).select("log_id", "t_start", "t_end", "n", "t_low")


EXL = exclusion.ExclusionLimits(
    throttle_rate_per_s=0.0008, transient_ms=2 * DAY, rate_window_ms=2 * DAY, cut_min=90.0, protection_min=120.0,
    transport_ms=DAY,
)
EDGE = "min(t_ms) OVER (PARTITION BY log_id) AS tf, max(t_ms) OVER (PARTITION BY log_id) AS tl"
EXCL = (
    "{S}, b AS (SELECT * FROM s WHERE channel_id = 'click'), "
    + held("b", "b1", "view", "tps", 2 * DAY) + ", " + held("b1", "b2", "error", "cut", 2 * DAY) + ", "
    + held("b2", "b3", "signup", "prot", 2 * DAY)
    + f""", f AS (SELECT *, {EDGE}, first_value(struct_pack(t := t_ms, v := tps)) OVER
    (PARTITION BY log_id ORDER BY t_ms RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW) AS z FROM b3),
  h AS (SELECT *, (abs(CASE WHEN t_ms > z.t THEN (tps - z.v) / ((t_ms - z.t) / 1000.0::DOUBLE) END) > {num(0.0008)})::INT AS hit FROM f),
  x AS (SELECT *, max(hit) OVER (PARTITION BY log_id ORDER BY t_ms RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW) AS x1,
     max(hit) OVER (PARTITION BY log_id ORDER BY t_ms RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS x2 FROM h),
  y AS (SELECT *, CASE WHEN hit IS NOT NULL AND t_ms - {2 * DAY} >= tf THEN x1 > 0 END AS ex_transient, cut >= 90 AS ex_cut,
     prot >= 120 AS ex_protection, CASE WHEN hit IS NOT NULL AND t_ms - {DAY} >= tf THEN x2 > 0 END AS ex_transport_delay FROM x),
  e AS (SELECT *, ex_transient OR ex_cut OR ex_protection OR ex_transport_delay AS exclude FROM y)
"""
)


def _excluded(spark, d):
    g = role_grid(samples(spark, d), "click", ["view", "error", "signup"], 2 * DAY)
    return exclusion.exclusion(g, EXL, throttle="view", cut="error", protection="signup")


@query("exclusion_filter", EXCL + "SELECT log_id, seq, ex_transient, ex_cut, ex_protection, ex_transport_delay, exclude FROM e")
def exclusion_filter(spark, d):
    return _excluded(spark, d).select("log_id", "seq", *[f"ex_{r}" for r in exclusion.REASONS], "exclude")


@query("exclusion_kept", EXCL + "SELECT log_id, seq, v AS click FROM e WHERE NOT coalesce(exclude, FALSE)")
def exclusion_kept(spark, d):
    return exclusion.kept(_excluded(spark, d)).select("log_id", "seq", "click")


PER_LOG = EXCL.replace(
    "f AS (SELECT *,",
    "f AS (SELECT * REPLACE (CASE WHEN log_id % 4 <> 1 THEN tps END AS tps, CASE WHEN log_id % 4 <> 2 THEN cut END AS cut, CASE WHEN log_id % 4 <> 3 THEN prot END AS prot),", 1,
).replace("e AS (SELECT *, ex_transient OR ex_cut OR ex_protection OR ex_transport_delay AS exclude FROM y)", """p AS (SELECT log_id, bool_or(tps IS NOT NULL) AS ht, bool_or(cut IS NOT NULL) AS hc, bool_or(prot IS NOT NULL) AS hp FROM y GROUP BY log_id),
  e AS (SELECT y.*, ht, hc, hp, CASE WHEN ht THEN ex_transient ELSE FALSE END OR CASE WHEN hc THEN ex_cut ELSE FALSE END OR CASE WHEN hp THEN ex_protection ELSE FALSE END OR CASE WHEN ht THEN ex_transport_delay ELSE FALSE END AS exclude FROM y JOIN p USING (log_id))""")


def _some_roles(spark, d):
    """Each log lacks one role or none, in turn."""
    g = role_grid(samples(spark, d), "click", ["view", "error", "signup"], 2 * DAY)
    return g.withColumns({c: F.when(F.col("log_id") % 4 != k, F.col(c)) for k, c in ((1, "view"), (2, "error"), (3, "signup"))})


@query("exclusion_per_log", PER_LOG + "SELECT log_id, seq, CASE WHEN ht THEN ex_transient END AS ex_transient, CASE WHEN hc THEN ex_cut END AS ex_cut, CASE WHEN hp THEN ex_protection END AS ex_protection, exclude FROM e")
def exclusion_per_log(spark, d):
    out = exclusion.exclusion(_some_roles(spark, d), EXL, throttle="view", cut="error", protection="signup")
    return out.select("log_id", "seq", "ex_transient", "ex_cut", "ex_protection", "exclude")


@query(
    "exclusion_reasons_per_log",
    PER_LOG + """SELECT log_id, u.reason, u.has AS applied, CASE WHEN NOT u.has THEN 'missing' END AS cause
  FROM (SELECT DISTINCT log_id, ht, hc, hp FROM e), LATERAL (VALUES ('transient', ht), ('cut', hc), ('protection', hp), ('transport_delay', ht)) u(reason, has)""",
)
def exclusion_reasons_per_log(spark, d):
    return exclusion.reasons(_some_roles(spark, d), throttle="view", cut="error", protection="signup")


@query("excluded_share", EXCL + "SELECT log_id, round(avg(coalesce(exclude, FALSE)::INT), 9) AS excluded_share FROM e GROUP BY log_id")
def excluded_share(spark, d):
    out = exclusion.excluded_share(_excluded(spark, d))
    return out.withColumn("excluded_share", F.round("excluded_share", 9))


GL = gears.GearLimits(max_gears=8)
RATIO = "(5 + floor(l_discount * 100 + 0.5) * 0.9 + l_tax)"
GEAR = f"""WITH RECURSIVE g AS (SELECT l_returnflag || l_linestatus AS log_id, l_orderkey * 8 + l_linenumber AS seq, l_quantity * 100 AS rpm,
    CASE WHEN l_linenumber <> 7 THEN l_quantity / 10 * {RATIO} END AS speed FROM lineitem),
  u AS (SELECT *, CASE WHEN rpm >= 1200 AND speed >= 10 THEN speed / rpm * 1000.0::DOUBLE END AS ratio FROM g),
  h AS (SELECT log_id, CAST(greatest(ceil(ratio / {num(0.2)}) - 1, 0) AS BIGINT) AS cell, count(*) AS n FROM u WHERE ratio IS NOT NULL GROUP BY 1, 2),
  t AS (SELECT a.log_id, a.cell, a.n, (a.cell + 0.5::DOUBLE) * {num(0.2)} AS c, row_number() OVER (PARTITION BY a.log_id ORDER BY a.cell) AS i
    FROM h a LEFT JOIN h b ON b.log_id = a.log_id AND b.cell = a.cell - 1 LEFT JOIN h z ON z.log_id = a.log_id AND z.cell = a.cell + 1
    WHERE a.n >= 25 AND a.n >= coalesce(b.n, 0) AND a.n >= coalesce(z.n, 0)),
  m(log_id, i, k, c, w) AS (SELECT log_id, i, 1, c, n::DOUBLE FROM t WHERE i = 1
    UNION ALL SELECT t.log_id, t.i, CASE WHEN t.c / m.c - 1 < {num(0.12)} THEN m.k ELSE m.k + 1 END,
      CASE WHEN t.c / m.c - 1 < {num(0.12)} THEN (m.c * m.w + t.c * t.n) / (m.w + t.n) ELSE t.c END,
      CASE WHEN t.c / m.c - 1 < {num(0.12)} THEN m.w + t.n ELSE t.n END FROM m JOIN t ON t.log_id = m.log_id AND t.i = m.i + 1),
  f AS (SELECT log_id, k, arg_max(c, i) AS c FROM m GROUP BY log_id, k),
  ok AS (SELECT log_id FROM t GROUP BY log_id HAVING count(*) <= 8),
  a AS (SELECT u.log_id, u.seq, f.k FROM u JOIN f ON f.log_id = u.log_id AND u.ratio >= f.c * (1 - {num(0.04)}) AND u.ratio < f.c * (1 + {num(0.04)})
    WHERE u.log_id IN (SELECT log_id FROM ok)),
  cnt AS (SELECT log_id, k, count(*) AS n FROM a GROUP BY 1, 2 HAVING count(*) >= 25),
  num AS (SELECT *, CAST(row_number() OVER (PARTITION BY log_id ORDER BY k) AS INT) AS gear FROM cnt),
  tot AS (SELECT log_id, count(*) AS n, count(*) FILTER (speed IS NULL OR rpm IS NULL) AS no_data, count(ratio) AS useful FROM u GROUP BY log_id)
"""


def _drive(spark, d):
    li = table(spark, d, "lineitem")
    ratio = 5 + F.floor(F.col("l_discount") * 100 + 0.5) * 0.9 + F.col("l_tax")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("log_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_quantity") * 100).alias("rpm"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 10 * ratio).alias("speed"),
    )


WIDE = gears.GearLimits(max_gears=60)


@query("gear_histogram", GEAR + "SELECT log_id, cell, n FROM h")
def gear_histogram(spark, d):
    return gears.histogram(gears.with_ratio(_drive(spark, d), "rpm", "speed", GL), GL)


@query(
    "gear_detection",
    GEAR.replace("count(*) <= 8", "count(*) <= 60")
    + "SELECT num.log_id, gear, round(f.c, 6) AS ratio, num.n, round(num.n / tot.useful::DOUBLE, 9) AS share FROM num JOIN f USING (log_id, k) JOIN tot ON tot.log_id = num.log_id",
)
def gear_detection(spark, d):
    found, _, _ = gears.detect_gears(_drive(spark, d), "rpm", "speed", WIDE)
    return found.select("log_id", "gear", F.round("ratio", 6).alias("ratio"), "n", F.round("share", 9).alias("share"))


@query(
    "gear_summary",
    GEAR.replace("count(*) <= 8", "count(*) <= 60")
    + """, s AS (SELECT log_id, sum(n) AS inside, count(*) AS gears FROM num GROUP BY log_id)
  SELECT tot.log_id, n, no_data, useful, n - no_data - useful AS stopped, CAST(useful - coalesce(inside, 0) AS BIGINT) AS between_gears,
    coalesce(gears, 0) AS gears FROM tot LEFT JOIN s USING (log_id)""",
)
def gear_summary(spark, d):
    _, summary, _ = gears.detect_gears(_drive(spark, d), "rpm", "speed", WIDE)
    return summary.withColumnRenamed("between", "between_gears").drop("status")


@query(
    "gear_samples",
    GEAR.replace("count(*) <= 8", "count(*) <= 60")
    + """SELECT u.log_id, u.seq, coalesce(num.gear, 0) AS gear FROM u LEFT JOIN f ON f.log_id = u.log_id AND u.ratio >= f.c * (1 - 0.04::DOUBLE)
    AND u.ratio < f.c * (1 + 0.04::DOUBLE) AND u.log_id IN (SELECT log_id FROM ok) LEFT JOIN num ON num.log_id = f.log_id AND num.k = f.k""",
)
def gear_samples(spark, d):
    _, _, rows = gears.detect_gears(_drive(spark, d), "rpm", "speed", WIDE)
    return rows.select("log_id", "seq", "gear")


STEPS = boost.StepLimits(min_step=40.0, band=0.9, margin=0.25, settled_s=3600.0, settled_samples=2)
STEP = (
    "{S}, b AS (SELECT log_id, seq, t_ms, v AS act FROM s WHERE channel_id = 'view'), "
    + held("b", "g", "click", "tgt", 4 * DAY)
    + f""", d AS (SELECT *, lag(tgt) OVER {L} AS before FROM g),
  k AS (SELECT *, CASE WHEN tgt - before >= 40 THEN 'rise' WHEN tgt - before <= -40 THEN 'fall' END AS kind FROM d),
  p AS (SELECT *, lag(kind) OVER {L} AS pk FROM k),
  q AS (SELECT *, sum(CASE WHEN kind IS NOT NULL AND kind IS DISTINCT FROM pk THEN 1 ELSE 0 END) OVER {W} AS step FROM p),
  v AS (SELECT * FROM q WHERE step >= 1),
  win AS (SELECT log_id, step, min(t_ms) AS t_start, max(t_ms) AS t_end, max(seq) AS end_seq, count(*) AS n, max(act) AS peak, arg_min(kind, seq) AS kind,
    first(before ORDER BY seq) AS target_before, arg_max(tgt, seq) FILTER (kind IS NOT NULL) AS target_new FROM v GROUP BY 1, 2),
  lo AS (SELECT *, CASE WHEN act IS NOT NULL AND tgt IS NOT NULL THEN act END AS a1, CASE WHEN act IS NOT NULL AND tgt IS NOT NULL THEN tgt * (1 - {num(0.9)}) END AS l1,
    CASE WHEN act IS NOT NULL AND tgt IS NOT NULL THEN tgt * (1 + {num(0.9)}) END AS h1 FROM v),
  bd AS (SELECT *, {band('a1', 'l1', 'h1', 0.25, '(PARTITION BY log_id, step ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS inside FROM lo),
  """
    + runs("bd", "coalesce(inside, FALSE)", "r", "log_id, step")
    + """, c AS (SELECT log_id, step, run, min(t_ms) AS t_in, max(seq) AS last_seq, count(*) AS m, sum(act - tgt) AS err FROM r WHERE st
    GROUP BY 1, 2, 3 HAVING max(t_ms) - min(t_ms) >= 3600000 AND count(*) >= 2),
  o AS (SELECT win.*, c.t_in, c.m, c.err, max(win.step) OVER (PARTITION BY win.log_id) AS last_step FROM win
    LEFT JOIN c ON c.log_id = win.log_id AND c.step = win.step AND c.last_seq = win.end_seq),
  z AS (SELECT *, CASE WHEN kind = 'fall' THEN 'fall' WHEN t_in IS NOT NULL THEN 'measured' WHEN step < last_step THEN 'interrupted' ELSE 'unsettled' END AS verdict FROM o)
"""
)


def _responses(spark, d):
    g = role_grid(samples(spark, d), "view", ["click"], 4 * DAY)
    return boost.step_responses(g, "view", "click", STEPS)


@query(
    "step_response",
    STEP + """SELECT log_id, CAST(step AS BIGINT) AS step, verdict, t_start, t_end, n, target_before, target_new, round(target_new - target_before, 6) AS step_size,
    CASE WHEN verdict = 'measured' THEN peak END AS peak, CASE WHEN verdict = 'measured' THEN round(peak - target_new, 6) END AS overshoot,
    CASE WHEN verdict = 'measured' THEN round((peak - target_new) / target_new, 6) END AS overshoot_rel,
    CASE WHEN verdict = 'measured' THEN round((t_in - t_start) / 1000.0, 3) END AS settling_s,
    CASE WHEN verdict = 'measured' THEN round(err / m, 6) END AS steady_error,
    CASE WHEN verdict = 'measured' THEN round(err / m / target_new, 6) END AS steady_error_rel,
    CASE WHEN verdict = 'measured' THEN m END AS steady_samples FROM z""",
)
def step_response(spark, d):
    out = _responses(spark, d)
    r6 = ["step_size", "overshoot", "overshoot_rel", "steady_error", "steady_error_rel"]
    return out.withColumns({**{c: F.round(c, 6) for c in r6}, "settling_s": F.round("settling_s", 3)})


@query(
    "step_response_summary",
    STEP + """SELECT log_id, count(*) AS steps, count(*) FILTER (verdict = 'measured') AS measured, count(*) FILTER (verdict = 'fall') AS fall,
    count(*) FILTER (verdict = 'interrupted') AS interrupted, count(*) FILTER (verdict = 'unsettled') AS unsettled FROM z GROUP BY log_id""",
)
def step_response_summary(spark, d):
    return boost.response_summary(_responses(spark, d))


@query(
    "filtered_mesh",
    EXCL + """SELECT CAST((v >= 20)::INT + (v >= 50)::INT + (v >= 100)::INT AS INT) AS i,
    CAST((tps >= 20)::INT + (tps >= 50)::INT + (tps >= 100)::INT AS INT) AS j, count(v - tps) AS n, round(avg(v - tps), 6) AS mean,
    round(stddev_pop(v - tps), 6) AS sd, round(min(v - tps), 6) AS lo, round(max(v - tps), 6) AS hi
    FROM e WHERE NOT coalesce(exclude, FALSE) AND v >= 0 AND v <= 1000 AND tps >= 0 AND tps <= 1000 AND v - tps IS NOT NULL GROUP BY 1, 2""",
)
def filtered_mesh(spark, d):
    rows = exclusion.kept(_excluded(spark, d))
    e = [0.0, 20.0, 50.0, 100.0, 1000.0]
    out = mesh(rows, [], F.col("click"), F.col("view"), F.col("click") - F.col("view"), e, e)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "lo", "hi")})


def cold_events(spark, d):
    s = attach_splits(samples(spark, d), LOG_TIME)
    return events(judge(s, LOG_TIME, {"c": alert(F.col("v"), 60.0, above=True, margin=0.1)}), LOG_TIME, F.col("c"))
