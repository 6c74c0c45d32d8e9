"""Driving-phase segmentation of an engine-speed / throttle grid."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conditions import Band, Threshold, first_true, judge
from .ordered import LOG_TIME, runs
from .windows import derivative

# The classes, in precedence order, and the extreme each one reports.
PHASES = ["start", "wot", "deceleration", "idle", "cruise"]
NEED_THROTTLE = {"wot", "deceleration", "idle", "cruise"}


@dataclass(frozen=True)
class PhaseLimits:
    """Thresholds in canonical units (rpm, fraction, seconds); fixed default values."""

    start_rpm: float = 50.0
    running_rpm: float = 500.0
    idle_max_rpm: float = 1400.0
    decel_min_rpm: float = 2000.0
    rising_rpm_per_s: float = 100.0
    steady_rpm_per_s: float = 300.0
    closed_enter: float = 0.02
    closed_leave: float = 0.05
    wot_enter: float = 0.80
    wot_leave: float = 0.75
    slope_window_ms: int = 250
    margin: float = 0.02
    min_samples: int = 3
    min_s: Mapping[str, float] = field(
        default_factory=lambda: {"wot": 1.5, "start": 0.5, "deceleration": 0.5, "idle": 1.0, "cruise": 2.0}
    )


def phase_conditions(
    grid: DataFrame, rpm: str, throttle: str, lim: PhaseLimits, has_throttle: Column | None = None
) -> DataFrame:
    """Append one exclusive nullable condition per class, prefixed ``is_``.

    ``has_throttle`` is FALSE for logs without the channel: their throttle classes
    cannot be computed and do not count as unknown.
    """
    r, p = F.col(rpm), F.col(throttle)
    work = derivative(grid, LOG_TIME, r, lim.slope_window_ms, "_slope")
    work = judge(
        work,
        LOG_TIME,
        {
            "_start": Band(r, lim.start_rpm, lim.running_rpm, lim.margin),
            "_closed": Threshold(p, lim.closed_enter, lim.closed_leave, rising=False),
            "_open": Threshold(p, lim.wot_enter, lim.wot_leave),
            "_fast": Threshold(r, lim.decel_min_rpm, lim.idle_max_rpm),
            "_idle_rpm": Band(r, lim.running_rpm, lim.idle_max_rpm, lim.margin),
            "_running": Threshold(r, lim.running_rpm, lim.start_rpm),
            "_steady": Band(F.col("_slope"), -lim.steady_rpm_per_s, lim.steady_rpm_per_s, lim.margin),
            "_part": Band(p, lim.closed_enter, lim.wot_enter, lim.margin),
        },
    )
    c = {
        "start": F.col("_start"),
        "wot": F.col("_open"),
        "deceleration": F.col("_closed") & F.col("_fast"),
        "idle": F.col("_closed") & F.col("_idle_rpm"),
        "cruise": F.col("_part") & F.col("_running") & F.col("_steady"),
    }
    if has_throttle is not None:
        c = {k: F.when(has_throttle, v).otherwise(F.lit(False)) if k in NEED_THROTTLE else v for k, v in c.items()}
    out = work.withColumns({f"is_{k}": v for k, v in first_true(c).items()})
    return out.drop("_slope", "_start", "_closed", "_open", "_fast", "_idle_rpm", "_running", "_steady", "_part")


def _label() -> Column:
    label = F.when(F.col("is_start"), "start")
    for name in PHASES[1:]:
        label = label.when(F.col(f"is_{name}"), name)
    return label


def phase_runs(judged: DataFrame, rpm: str, lim: PhaseLimits) -> DataFrame:
    """Every run of a class with its verdict: accepted, too_short or low_slope.

    The classes are exclusive, so runs of the label are the runs of each class and
    one ordered scan finds them all.
    """
    r = F.col(rpm)
    found = runs(
        judged,
        LOG_TIME,
        _label(),
        {
            "rpm_start": ("first", r), "rpm_end": ("last", r),
            "rpm_max": ("max", r), "rpm_min": ("min", r),
        },
        only_true=False,
    ).withColumnRenamed("state", "phase")
    need = F.create_map(*[F.lit(x) for p in PHASES for x in (p, float(lim.min_s[p]))])[F.col("phase")]
    seconds = (F.col("t_end") - F.col("t_start")) / 1000.0
    slope = F.when(seconds > 0, (F.col("rpm_end") - F.col("rpm_start")) / seconds).otherwise(0.0)
    long_enough = (seconds >= need) & (F.col("n") >= lim.min_samples)
    flat = (F.col("phase") == "wot") & (slope < lim.rising_rpm_per_s)
    return found.withColumns(
        {
            "seconds": seconds,
            "slope": slope,
            "verdict": F.when(~long_enough, "too_short").when(flat, "low_slope").otherwise("accepted"),
        }
    )


def phases(judged: DataFrame, rpm: str, lim: PhaseLimits) -> DataFrame:
    """Accepted segments with the rpm extreme their class reports."""
    out = phase_runs(judged, rpm, lim).filter("verdict = 'accepted'")
    lowest = F.col("phase").isin("deceleration", "idle")
    return out.select(
        "log_id", "phase", "t_start", "t_end", "n", "seconds", "slope",
        F.when(lowest, F.col("rpm_min")).otherwise(F.col("rpm_max")).alias("peak"),
        "rpm_start", "rpm_end",
    )


def coverage(judged: DataFrame, rpm: str, lim: PhaseLimits) -> DataFrame:
    """Every sample counted exactly once per log: in a class or in a reason."""
    verdicts = phase_runs(judged, rpm, lim).groupBy("log_id").agg(
        *[F.sum(F.when((F.col("verdict") == "accepted") & (F.col("phase") == p), F.col("n")).otherwise(0)).alias(p) for p in PHASES],
        F.sum(F.when(F.col("verdict") == "too_short", F.col("n")).otherwise(0)).alias("too_short"),
        F.sum(F.when(F.col("verdict") == "low_slope", F.col("n")).otherwise(0)).alias("low_slope"),
    )
    unknown = F.lit(False)
    for p in PHASES:
        unknown = unknown | F.col(f"is_{p}").isNull()
    free = _label().isNull()
    stopped = free & F.coalesce(F.col(rpm) < lim.start_rpm, F.lit(False))
    rest = judged.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(stopped).alias("stopped"),
        F.count_if(free & ~stopped & unknown).alias("no_data"),
        F.count_if(free & ~stopped & ~unknown).alias("no_class"),
    )
    counted = [*PHASES, "too_short", "low_slope"]
    return rest.join(verdicts, "log_id", "left").select(
        "log_id", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in counted], "stopped", "no_data", "no_class"
    )


def seconds_per_phase(segments: DataFrame) -> DataFrame:
    return segments.groupBy("log_id", "phase").agg(
        F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("segments")
    )


def warm_up(grid: DataFrame, coolant: str, target_k: float, margin: float, min_ms: int) -> DataFrame:
    """Runs with the coolant under its target."""
    from .conditions import limit
    from .events import events

    judged = judge(grid, LOG_TIME, {"_cold": limit(F.col(coolant), target_k, above=False, margin=margin)})
    return events(judged, LOG_TIME, F.col("_cold"), min_ms=min_ms, aggregates={"t_low": ("min", F.col(coolant))})
