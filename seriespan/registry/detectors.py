"""The catalogued detectors, with event types standing in for the roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.boost import StepLimits
from ..plans import detectors as det
from ..plans.views import counters, samples
from . import query
from .phases import DAY, STEP, STEPS
from .quality import GAPS
from .sql import L, held, hyst, limit, num, runs

ROWS = "log_id, t_start, t_end, severity, round(d, 6) AS detail"


def _bench(spark, d, names, limits):
    s = samples(spark, d).withColumnRenamed("channel_id", "role")
    return det.Bench(s, names, {"*": {"hold_ms": 2 * DAY, "min_samples": 1}, **limits})


def _out(found, key):
    return found.select("log_id", "t_start", "t_end", "severity", F.round(F.col("detail")[key], 6).alias("detail"))


def _sql(main, helds, condition, agg, severity="'media'", having="TRUE", extra="", src="s"):
    """Oracle of a detector: grid, condition, runs, one row per run."""
    ctes, base = [f"b0 AS (SELECT * FROM {src} WHERE channel_id = '{main}')"], "b0"
    for i, (label, column) in enumerate(helds):
        ctes.append(held(base, f"b{i + 1}", label, column, 2 * DAY, src))
        base = f"b{i + 1}"
    if extra:
        ctes.append(extra.format(base=base))
        base = "xx"
    ctes.append(f"cd AS (SELECT *, {condition} AS hit FROM {base})")
    ctes.append(runs("cd", "coalesce(hit, FALSE)", "r"))
    ctes.append(
        f"ev AS (SELECT log_id, min(t_ms) AS t_start, max(t_ms) AS t_end, count(*) AS n, {agg} FROM r WHERE st GROUP BY log_id, run HAVING {having})"
    )
    return "{S}, " + ",\n  ".join(ctes) + f" SELECT log_id, t_start, t_end, {severity} AS severity, round(d::DOUBLE, 6) AS detail FROM ev"


STEP_K = f"""xx AS (SELECT *, CASE WHEN v - lag(v) OVER {L} >= 0 THEN v - lag(v) OVER {L} END AS step FROM {{base}})"""


@query(
    "detector_knock_event",
    _sql("click", [("view", "rpm"), ("error", "map")], "step >= 30", "sum(step) AS d, bool_or(coalesce(rpm >= 60 AND map >= 30, FALSE)) AS hard",
         "CASE WHEN hard THEN 'critica' ELSE 'alta' END", extra=STEP_K),
)
def knock_event(spark, d):
    b = _bench(spark, d, {"knock_count": "click", "engine_speed": "view", "manifold_pressure": "error"},
               {"D1": {"min_delta": 30, "critical_rpm": 60.0, "critical_map": 30.0}})
    return _out(det.knock_event(b), "delta")


@query("detector_knock_over_threshold", _sql("click", [("view", "thr")], limit("v", f"thr + {num(0)}", True, 0.02), "max(v) AS d"))
def knock_over_threshold(spark, d):
    return _out(det.knock_over_threshold(_bench(spark, d, {"knock_level": "click", "knock_threshold": "view"}, {"D2": {"min_s": 0.0}})), "peak")


@query("detector_knock_retard", _sql("click", [], limit("v", num(25), False, 0.02), "min(v) AS d", having="max(t_ms) - min(t_ms) >= 100"))
def knock_retard(spark, d):
    return _out(det.knock_retard(_bench(spark, d, {"knock_retard": "click"}, {"D3": {"max_deg": 25.0}})), "peak")


ERR = "xx AS (SELECT *, v / nullif(tgt, 0) - 1 AS e FROM {base})"


@query(
    "detector_lean_under_load",
    _sql("click", [("view", "tgt"), ("error", "tps"), ("signup", "rpm")],
         f"({limit('e', num(0.04), True, 0.02)}) AND ({limit('tps', num(20), True, 0.02)}) AND ({limit('rpm', num(20), True, 0.02)})", "max(e) AS d", "'critica'", extra=ERR),
)
def lean_under_load(spark, d):
    b = _bench(spark, d, {"lambda_measured": "click", "lambda_target": "view", "throttle_position": "error", "engine_speed": "signup"},
               {"D4": {"throttle": 20.0, "rpm": 20.0, "min_s": 0.0}})
    return _out(det.lean_under_load(b), "peak")


@query(
    "detector_rich_sustained",
    _sql("click", [("view", "tgt"), ("error", "tps")], f"({limit('e', num(-0.07), False, 0.02)}) AND ({limit('tps', num(20), True, 0.02)})", "min(e) AS d", "'baja'",
         having="max(t_ms) - min(t_ms) >= 3600000", extra=ERR),
)
def rich_sustained(spark, d):
    b = _bench(spark, d, {"lambda_measured": "click", "lambda_target": "view", "throttle_position": "error"}, {"D5": {"throttle": 20.0, "min_s": 3600.0}})
    return _out(det.rich_sustained(b), "peak")


@query("detector_overboost", _sql("click", [("purchase", "cut")], limit("v", f"coalesce(cut * {num(0.97)}, {num(90)})", True, 0.02), "max(v) AS d", "'alta'"))
def overboost(spark, d):
    b = _bench(spark, d, {"boost_pressure_actual": "click", "overboost_cut_pressure": "purchase"}, {"D6": {"absolute_kpa": 90.0, "min_s": 0.0}})
    return _out(det.overboost(b), "peak")


@query(
    "detector_boost_overshoot",
    STEP.replace("4 * DAY", "4 * DAY") + """SELECT log_id, t_start, t_end, 'media' AS severity, round((peak - target_new) / target_new, 6) AS detail FROM z
    WHERE verdict = 'measured' AND (peak - target_new) / target_new > 0.05""",
)
def boost_overshoot(spark, d):
    b = _bench(spark, d, {"boost_pressure_actual": "view", "boost_pressure_target": "click"}, {"*": {"hold_ms": 4 * DAY}})
    return _out(det.boost_overshoot(b, StepLimits(**STEPS.__dict__)), "overshoot_rel")


@query("detector_high_duty", _sql("error", [], limit("v", num(85), True, 0.02), "max(v) AS d", "CASE WHEN d >= 120 THEN 'critica' ELSE 'alta' END"))
def high_duty(spark, d):
    return _out(det.high_duty(_bench(spark, d, {"injector_duty": "error"}, {"D8": {"warn": 85.0, "critical": 120.0, "min_s": 0.0}})), "peak")


@query("detector_coolant_hot", _sql("error", [], limit("v", num(60), True, 0.02), "max(v) AS d", "'alta'", having="max(t_ms) - min(t_ms) >= 3000"))
def coolant_hot(spark, d):
    return _out(det.coolant_hot(_bench(spark, d, {"coolant_temp": "error"}, {"D9": {"max_k": 60.0}})), "peak")


@query("detector_oil_pressure_low", _sql("view", [("click", "rpm")], limit("v", f"{num(10)} + {num(300)} * (rpm / {num(1000)})", False, 0.02), "min(v) AS d", "'critica'"))
def oil_pressure_low(spark, d):
    b = _bench(spark, d, {"oil_pressure": "view", "engine_speed": "click"}, {"D10": {"base_kpa": 10.0, "slope_kpa": 300.0, "min_s": 0.0}})
    return _out(det.oil_pressure_low(b), "peak")


@query(
    "detector_battery_low",
    _sql("view", [("click", "rpm")], f"({limit('v', num(11.5), False, 0.02)}) AND ({limit('rpm', num(20), True, 0.02)})", "min(v) AS d"),
)
def battery_low(spark, d):
    b = _bench(spark, d, {"battery_voltage": "view", "engine_speed": "click"}, {"D11": {"rpm": 20.0, "min_s": 0.0}})
    return _out(det.battery_low(b), "peak")


KS = """s2 AS (SELECT user_id AS log_id, event_type AS channel_id, event_id AS seq, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS t_ms,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 8 AS v FROM events)"""


@query(
    "detector_trigger_error",
    _sql("click", [], "v <> 0", "max(v) AS d", "'critica'", src="s2").replace("{S}, ", "{S}, " + KS + ", "),
)
def trigger_error(spark, d):
    k = counters(spark, d).select("log_id", F.col("channel_id").alias("role"), "seq", "t_ms", (F.col("k") % 8).cast("double").alias("v"))
    return _out(det.trigger_error(det.Bench(k, {"trigger_errors": "click"})), "bits")


@query(
    "detector_protection_active",
    _sql("click", [], hyst("v", num(1), num(1)), "max(v) AS d", "CASE WHEN d >= 3 THEN 'critica' WHEN d >= 2 THEN 'alta' ELSE 'media' END", src="s2").replace("{S}, ", "{S}, " + KS.replace("% 8", "% 4") + ", "),
)
def protection_active(spark, d):
    k = counters(spark, d).select("log_id", F.col("channel_id").alias("role"), "seq", "t_ms", (F.col("k") % 4).cast("double").alias("v"))
    return _out(det.protection_active(det.Bench(k, {"protection_level": "click"})), "level")


@query("detector_cut_active", _sql("purchase", [], hyst("v", num(50), num(50)), "max(v) AS d", having="max(t_ms) - min(t_ms) >= 100"))
def cut_active(spark, d):
    return _out(det.cut_active(_bench(spark, d, {"cut_percentage": "purchase"}, {"D14": {"min_cut": 50.0}})), "peak")


TIP = (
    "xx0 AS (SELECT *, abs(v / nullif(tgt, 0) - 1) AS dev, max(t_ms) OVER (PARTITION BY log_id) AS tl, first_value(struct_pack(t := t_ms, v := tps)) OVER (PARTITION BY log_id ORDER BY t_ms RANGE BETWEEN 172800000 PRECEDING AND CURRENT ROW) AS z FROM {base}),"
    " xx1 AS (SELECT *, CASE WHEN t_ms > z.t THEN (tps - z.v) / ((t_ms - z.t) / 1000.0::DOUBLE) END AS rate, max(dev) OVER (PARTITION BY log_id ORDER BY t_ms RANGE BETWEEN CURRENT ROW AND 86400000 FOLLOWING) AS w0 FROM xx0),"
    " xx AS (SELECT *, CASE WHEN dev IS NOT NULL AND t_ms + 86400000 <= tl THEN w0 END AS worst FROM xx1)"
)


@query(
    "detector_tip_in",
    _sql("click", [("view", "tgt"), ("error", "tps")], f"rate >= {num(0.0001)} AND worst > {num(0.06)}", "max(worst) AS d", extra=TIP),
)
def tip_in(spark, d):
    b = _bench(spark, d, {"lambda_measured": "click", "lambda_target": "view", "throttle_position": "error"},
               {"D15": {"rate_per_s": 0.0001, "window_s": 86400.0, "rate_window_ms": 2 * DAY}})
    return _out(det.tip_in(b), "peak")


@query(
    "detector_dead_channel",
    "{S}, s3 AS (SELECT log_id, channel_id, seq, t_ms, CASE WHEN channel_id = 'error' AND log_id % 3 = 0 THEN 5.0 ELSE v END AS v FROM s), b0 AS (SELECT * FROM s3 WHERE channel_id <> 'click'), "
    + held("b0", "b1", "click", "rpm", 2 * DAY, "s3")
    + """ SELECT log_id, min(t_ms) AS t_start, max(t_ms) AS t_end, 'informativa' AS severity, round(min(v), 6) AS detail FROM b1
  WHERE rpm >= 20 AND v IS NOT NULL GROUP BY log_id, channel_id HAVING min(v) = max(v) AND count(*) >= 2""",
)
def dead_channel(spark, d):
    s = samples(spark, d).withColumn(
        "v", F.when((F.col("channel_id") == "error") & (F.col("log_id") % 3 == 0), 5.0).otherwise(F.col("v"))
    ).withColumnRenamed("channel_id", "role")
    b = det.Bench(s, {"engine_speed": "click"}, {"*": {"hold_ms": 2 * DAY, "min_samples": 2}, "D16": {"rpm": 20.0}})
    return _out(det.dead_channel(b), "value")


@query(
    "detector_sentinel_value",
    "{S}, rw AS (SELECT log_id, channel_id, seq, t_ms, CASE WHEN v > 80 THEN 2147483647 WHEN v < 3 THEN 8388607 ELSE CAST(floor(v * 100) AS BIGINT) END AS raw FROM s), "
    + runs("rw", "raw IN (2147483647, -2147483648, -2147483645, -2147483628, -2147483639, 8388607)", "r", "log_id, channel_id")
    + " SELECT log_id, min(t_ms) AS t_start, max(t_ms) AS t_end, 'informativa' AS severity, count(*)::DOUBLE AS detail FROM r WHERE st GROUP BY log_id, channel_id, run",
)
def sentinel_value(spark, d):
    v = F.col("v")
    raw = F.when(v > 80, F.lit(2147483647)).when(v < 3, F.lit(8388607)).otherwise(F.floor(v * 100))
    return _out(det.sentinel_value(samples(spark, d).withColumn("raw", raw)), "n")


@query(
    "detector_sampling_gap",
    GAPS.replace("PARTITION BY log_id", "PARTITION BY log_id, channel_id").replace("SELECT log_id, quantile_cont", "SELECT log_id, channel_id, quantile_cont")
    .replace("GROUP BY log_id", "GROUP BY log_id, channel_id").replace("USING (log_id)", "USING (log_id, channel_id)")
    .replace("SELECT log_id, t_prev AS t_start, t_ms AS t_end, t_ms - t_prev AS duration_ms,\n    round((t_ms - t_prev) / period_ms, 6) AS factor",
             "SELECT log_id, t_prev AS t_start, t_ms AS t_end, 'informativa' AS severity, round((t_ms - t_prev) / period_ms, 6) AS detail"),
)
def sampling_gap(spark, d):
    return _out(det.sampling_gap(_bench(spark, d, {}, {})), "factor")
