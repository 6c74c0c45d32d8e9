"""The catalogued detectors as compositions of the operators.

Input is ``samples(log_id, role, seq, t_ms, v)`` with canonical values. ``names``
maps a role to the label it carries in the ``role`` column, ``limits`` overrides
single thresholds; both default to the catalogue.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.detectors import DETECTORS, GENERAL
from ..catalog.units import INT32_SENTINELS
from ..functions.curves import linear_limit
from ..functions.formulas import lambda_error
from ..operators import quality
from ..operators.align import hold_onto
from ..operators.boost import StepLimits, step_responses
from ..operators.conditions import Threshold, any_bit, judge, limit
from ..operators.events import events
from ..operators.incidents import as_incidents, gap_incidents
from ..operators.ordered import CHANNEL_FILE, CHANNEL_TIME, LOG_TIME, attach_splits
from ..operators.windows import counter_delta, derivative, window_extremes

Limits = Mapping[str, float]


class Bench:
    """Samples plus the settings every detector shares."""

    def __init__(self, samples: DataFrame, names: Mapping[str, str] | None = None, limits: Mapping[str, Limits] | None = None):
        self.samples, self.names = samples, dict(names or {})
        self.overrides = {k: dict(v) for k, v in (limits or {}).items()}

    def limits(self, detector: str) -> dict:
        return {**GENERAL, **DETECTORS[detector], **self.overrides.get("*", {}), **self.overrides.get(detector, {})}

    def label(self, role: str) -> str:
        return self.names.get(role, role)

    def grid(self, detector: str, main: str, *others: str) -> DataFrame:
        """The main role's instants with the other roles held onto them."""
        window = int(self.limits(detector)["hold_ms"])
        labels = [self.label(r) for r in (main, *others)]
        wanted = self.samples.filter(F.col("role").isin(labels))
        wanted = attach_splits(wanted, LOG_TIME)
        held = {r: F.col("role") == self.label(r) for r in others}
        out = hold_onto(wanted, F.col("role") == self.label(main), held, window) if others else wanted
        return out.withColumnRenamed("v", main).drop("role")

    def series(self, main: str) -> DataFrame:
        rows = self.samples.filter(F.col("role") == self.label(main)).drop("role")
        return attach_splits(rows, LOG_TIME).withColumnRenamed("v", main)


def _found(df: DataFrame, condition: Column, lim: dict, **aggregates) -> DataFrame:
    """Runs lasting the detector's minimum; an instant one needs a single sample."""
    instant = lim["min_s"] == 0
    return events(
        df, LOG_TIME, condition,
        min_ms=int(lim["min_s"] * 1000),
        min_samples=1 if instant else int(lim["min_samples"]),
        aggregates=aggregates,
    )


def knock_event(b: Bench) -> DataFrame:
    lim = b.limits("D1")
    rows = b.grid("D1", "knock_count", "engine_speed", "manifold_pressure")
    rows = counter_delta(rows, LOG_TIME, F.col("knock_count"), "_step")
    hard = (F.col("engine_speed") >= lim["critical_rpm"]) & (F.col("manifold_pressure") >= lim["critical_map"])
    found = _found(
        rows, F.col("_step") >= lim["min_delta"], lim,
        delta=("sum", F.col("_step")), rpm=("max", F.col("engine_speed")),
        hard=("max", F.coalesce(hard, F.lit(False))),
    )
    return as_incidents(
        found, "D1", F.when(F.col("hard"), "critica").otherwise("alta"), {"delta": F.col("delta"), "rpm": F.col("rpm")}
    )


def knock_over_threshold(b: Bench) -> DataFrame:
    lim = b.limits("D2")
    rows = b.grid("D2", "knock_level", "knock_threshold")
    edge = F.col("knock_threshold") + F.lit(float(lim["margin_db"]))
    rows = judge(rows, LOG_TIME, {"_c": limit(F.col("knock_level"), edge, above=True, margin=lim["margin"])})
    found = _found(rows, F.col("_c"), lim, peak=("max", F.col("knock_level")))
    return as_incidents(found, "D2", "media", {"peak": F.col("peak")})


def _single(b: Bench, detector: str, role: str, at: float, above: bool, severity: str) -> DataFrame:
    lim = b.limits(detector)
    rows = judge(b.series(role), LOG_TIME, {"_c": limit(F.col(role), at, above=above, margin=lim["margin"])})
    found = _found(rows, F.col("_c"), lim, peak=("max" if above else "min", F.col(role)))
    return as_incidents(found, detector, severity, {"peak": F.col("peak")})


def knock_retard(b: Bench) -> DataFrame:
    return _single(b, "D3", "knock_retard", b.limits("D3")["max_deg"], False, "media")


def lean_under_load(b: Bench) -> DataFrame:
    lim = b.limits("D4")
    rows = b.grid("D4", "lambda_measured", "lambda_target", "throttle_position", "engine_speed")
    rows = rows.withColumn("_e", lambda_error(F.col("lambda_measured"), F.col("lambda_target")))
    m = lim["margin"]
    rows = judge(
        rows, LOG_TIME,
        {
            "_lean": limit(F.col("_e"), lim["max_rel"], above=True, margin=m),
            "_load": limit(F.col("throttle_position"), lim["throttle"], above=True, margin=m),
            "_rpm": limit(F.col("engine_speed"), lim["rpm"], above=True, margin=m),
        },
    )
    found = _found(rows, F.col("_lean") & F.col("_load") & F.col("_rpm"), lim, peak=("max", F.col("_e")))
    return as_incidents(found, "D4", "critica", {"peak": F.col("peak")})


def rich_sustained(b: Bench) -> DataFrame:
    lim = b.limits("D5")
    rows = b.grid("D5", "lambda_measured", "lambda_target", "throttle_position")
    rows = rows.withColumn("_e", lambda_error(F.col("lambda_measured"), F.col("lambda_target")))
    rows = judge(
        rows, LOG_TIME,
        {
            "_rich": limit(F.col("_e"), lim["min_rel"], above=False, margin=lim["margin"]),
            "_load": limit(F.col("throttle_position"), lim["throttle"], above=True, margin=lim["margin"]),
        },
    )
    found = _found(rows, F.col("_rich") & F.col("_load"), lim, peak=("min", F.col("_e")))
    return as_incidents(found, "D5", "baja", {"peak": F.col("peak")})


def overboost(b: Bench) -> DataFrame:
    lim = b.limits("D6")
    rows = b.grid("D6", "boost_pressure_actual", "overboost_cut_pressure")
    edge = F.coalesce(F.col("overboost_cut_pressure") * lim["cut_fraction"], F.lit(float(lim["absolute_kpa"])))
    rows = judge(rows, LOG_TIME, {"_c": limit(F.col("boost_pressure_actual"), edge, above=True, margin=lim["margin"])})
    found = _found(rows, F.col("_c"), lim, peak=("max", F.col("boost_pressure_actual")))
    return as_incidents(found, "D6", "alta", {"peak": F.col("peak")})


def boost_overshoot(b: Bench, steps: StepLimits = StepLimits()) -> DataFrame:
    lim = b.limits("D7")
    rows = b.grid("D7", "boost_pressure_actual", "boost_pressure_target")
    found = step_responses(rows, "boost_pressure_actual", "boost_pressure_target", steps)
    found = found.filter((F.col("verdict") == "measured") & (F.col("overshoot_rel") > lim["max_rel"]))
    return as_incidents(found, "D7", "media", {"overshoot_rel": F.col("overshoot_rel"), "peak": F.col("peak")})


def high_duty(b: Bench) -> DataFrame:
    lim = b.limits("D8")
    role = "injector_duty"
    rows = judge(b.series(role), LOG_TIME, {"_c": limit(F.col(role), lim["warn"], above=True, margin=lim["margin"])})
    found = _found(rows, F.col("_c"), lim, peak=("max", F.col(role)))
    severity = F.when(F.col("peak") >= lim["critical"], "critica").otherwise("alta")
    return as_incidents(found, "D8", severity, {"peak": F.col("peak")})


def coolant_hot(b: Bench) -> DataFrame:
    return _single(b, "D9", "coolant_temp", b.limits("D9")["max_k"], True, "alta")


def oil_pressure_low(b: Bench) -> DataFrame:
    lim = b.limits("D10")
    rows = b.grid("D10", "oil_pressure", "engine_speed")
    edge = linear_limit(F.col("engine_speed"), float(lim["base_kpa"]), float(lim["slope_kpa"]), 1000.0)
    rows = judge(rows, LOG_TIME, {"_c": limit(F.col("oil_pressure"), edge, above=False, margin=lim["margin"])})
    found = _found(rows, F.col("_c"), lim, peak=("min", F.col("oil_pressure")))
    return as_incidents(found, "D10", "critica", {"peak": F.col("peak")})


def battery_low(b: Bench) -> DataFrame:
    lim = b.limits("D11")
    rows = b.grid("D11", "battery_voltage", "engine_speed")
    rows = judge(
        rows, LOG_TIME,
        {
            "_low": limit(F.col("battery_voltage"), lim["min_v"], above=False, margin=lim["margin"]),
            "_on": limit(F.col("engine_speed"), lim["rpm"], above=True, margin=lim["margin"]),
        },
    )
    found = _found(rows, F.col("_low") & F.col("_on"), lim, peak=("min", F.col("battery_voltage")))
    return as_incidents(found, "D11", "media", {"peak": F.col("peak")})


def trigger_error(b: Bench) -> DataFrame:
    rows = b.series("trigger_errors").withColumn("_b", F.col("trigger_errors").cast("bigint"))
    found = _found(rows, any_bit(F.col("_b")), b.limits("D12"), peak=("max", F.col("_b")))
    return as_incidents(found, "D12", "critica", {"bits": F.col("peak")})


def protection_active(b: Bench) -> DataFrame:
    lim, role = b.limits("D13"), "protection_level"
    rows = judge(b.series(role), LOG_TIME, {"_c": Threshold(F.col(role), lim["min_level"], lim["min_level"])})
    found = _found(rows, F.col("_c"), lim, peak=("max", F.col(role)))
    severity = F.when(F.col("peak") >= 3, "critica").when(F.col("peak") >= 2, "alta").otherwise("media")
    return as_incidents(found, "D13", severity, {"level": F.col("peak")})


def cut_active(b: Bench) -> DataFrame:
    lim, role = b.limits("D14"), "cut_percentage"
    rows = judge(b.series(role), LOG_TIME, {"_c": Threshold(F.col(role), lim["min_cut"], lim["min_cut"])})
    found = _found(rows, F.col("_c"), lim, peak=("max", F.col(role)))
    return as_incidents(found, "D14", "media", {"peak": F.col("peak")})


def tip_in(b: Bench) -> DataFrame:
    lim = b.limits("D15")
    rows = b.grid("D15", "lambda_measured", "lambda_target", "throttle_position")
    rows = derivative(rows, LOG_TIME, F.col("throttle_position"), int(lim["rate_window_ms"]), "_rate")
    rows = rows.withColumn("_dev", F.abs(lambda_error(F.col("lambda_measured"), F.col("lambda_target"))))
    rows = window_extremes(rows, LOG_TIME, 0, int(lim["window_s"] * 1000), {"_worst": ("max", F.col("_dev"))})
    hit = (F.col("_rate") >= lim["rate_per_s"]) & (F.col("_worst") > lim["max_rel"])
    found = _found(rows, hit, lim, peak=("max", F.col("_worst")))
    return as_incidents(found, "D15", "media", {"peak": F.col("peak")})


def dead_channel(b: Bench) -> DataFrame:
    """Channels that never move while the engine runs; the incident spans those rows."""
    lim = b.limits("D16")
    speed = F.col("role") == b.label("engine_speed")
    rows = attach_splits(b.samples, LOG_TIME)
    rows = hold_onto(rows, ~speed, {"_rpm": speed}, int(lim["hold_ms"]))
    running = rows.filter((F.col("_rpm") >= lim["rpm"]) & F.col("v").isNotNull())
    still = (
        running.groupBy("log_id", "role")
        .agg(
            F.min("t_ms").alias("t_start"), F.max("t_ms").alias("t_end"), F.count(F.lit(1)).alias("n"),
            F.min("v").alias("value"), F.max("v").alias("_hi"),
        )
        .filter((F.col("value") == F.col("_hi")) & (F.col("n") >= lim["min_samples"]))
    )
    return as_incidents(still, "D16", "informativa", {"value": F.col("value"), "n": F.col("n")})


def sentinel_value(raw: DataFrame, value: str = "raw", sentinels=INT32_SENTINELS, channel: str = "channel_id") -> DataFrame:
    """Runs of raw samples equal to a sentinel, before those become NULL."""
    rows = attach_splits(raw.withColumnRenamed(channel, "channel_id"), CHANNEL_TIME)
    found = events(rows, CHANNEL_TIME, F.col(value).isin(list(sentinels)), aggregates={"code": ("first", F.col(value))})
    return as_incidents(found, "D17", "informativa", {"code": F.col("code"), "n": F.col("n")})


def sampling_gap(b: Bench) -> DataFrame:
    lim = b.limits("D18")
    rows = attach_splits(b.samples.withColumnRenamed("role", "channel_id"), CHANNEL_FILE)
    return gap_incidents(quality.gaps(rows, lim["factor"], CHANNEL_FILE))


RUNNERS = {
    "D1": knock_event, "D2": knock_over_threshold, "D3": knock_retard, "D4": lean_under_load,
    "D5": rich_sustained, "D6": overboost, "D7": boost_overshoot, "D8": high_duty, "D9": coolant_hot,
    "D10": oil_pressure_low, "D11": battery_low, "D12": trigger_error, "D13": protection_active,
    "D14": cut_active, "D15": tip_in, "D16": dead_channel, "D18": sampling_gap,
}


def run(b: Bench, detectors: list[str] | None = None, active: DataFrame | None = None) -> DataFrame:
    """Incidents of several detectors; ``active`` drops those gated off per log.

    D17 reads raw samples and has its own entry, ``sentinel_value``.
    """
    out = None
    for d in detectors or list(RUNNERS):
        found = RUNNERS[d](b)
        out = found if out is None else out.unionByName(found)
    if active is not None:
        out = out.join(active.filter("active").select("log_id", "detector"), ["log_id", "detector"], "left_semi")
    return out
