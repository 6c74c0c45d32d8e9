"""Incidents: one schema for every detector, order, counts, gating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import with_each
from .plausibility import SEVERITIES, severity_rank

COLUMNS = ["log_id", "detector", "t_start", "t_end", "severity", "detail"]


def as_incidents(found: DataFrame, detector: str, severity: Column | str, detail: dict[str, Column]) -> DataFrame:
    """Project events to the incident schema; the detail maps names to numbers."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    entries = [x for k, c in detail.items() for x in (F.lit(k), c.cast("double"))]
    body = F.create_map(*entries) if entries else F.create_map().cast("map<string,double>")
    return found.select(
        "log_id", F.lit(detector).alias("detector"),
        F.col("t_start").cast("bigint").alias("t_start"), F.col("t_end").cast("bigint").alias("t_end"),
        sev.alias("severity"), body.alias("detail"),
    )


def gap_incidents(gaps: DataFrame, detector: str = "D18", severity: str = "informativa") -> DataFrame:
    return as_incidents(gaps, detector, severity, {"duration_ms": F.col("duration_ms"), "factor": F.col("factor")})


def jump_incidents(jumps: DataFrame, detector: str, severity: str) -> DataFrame:
    """Clock jumps: the interval goes from the later to the earlier stamp."""
    return as_incidents(jumps, detector, severity, {"back_ms": -F.col("dt")})


def ordered(incidents: DataFrame) -> DataFrame:
    """Most severe first, then in the order they happened."""
    return incidents.withColumn("rank", severity_rank(F.col("severity"))).orderBy("rank", "t_start")


def by_detector(incidents: DataFrame, detectors: DataFrame) -> DataFrame:
    """Count, total seconds and open flag per detector; silent detectors stay."""
    open_ = F.col("t_end").isNull()
    sums = incidents.groupBy("detector").agg(
        F.count(F.lit(1)).alias("incidents"),
        (F.sum(F.when(~open_, F.col("t_end") - F.col("t_start"))) / 1000.0).alias("seconds"),
        F.max(open_).alias("has_open"),
    )
    return detectors.join(sums, "detector", "left").select(
        *detectors.columns,
        F.coalesce("incidents", F.lit(0)).alias("incidents"),
        F.coalesce("seconds", F.lit(0.0)).alias("seconds"),
        F.coalesce("has_open", F.lit(False)).alias("has_open"),
    )


def by_severity(incidents: DataFrame, severities: Sequence[str] = SEVERITIES) -> DataFrame:
    """Count per severity in fixed order, zeros included."""
    table = incidents.sparkSession.createDataFrame(list(enumerate(severities)), "rank int, severity string")
    counts = incidents.groupBy("severity").agg(F.count(F.lit(1)).alias("incidents"))
    return table.join(counts, "severity", "left").select(
        "rank", "severity", F.coalesce("incidents", F.lit(0)).alias("incidents")
    )


# Notices that are only informational; any other code is a warning.
INFORMATIONAL = [
    "clock_without_metadata", "clock_metadata_unreadable", "factory_epoch", "clock_without_first_row",
    "header_before_midnight", "download_before_log", "duplicate_name", "invalid_display_range",
]


def notice_severity(code: Column) -> Column:
    return F.when(code.isin(INFORMATIONAL), "informational").otherwise("warning")


def notice_groups(notices: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Notices by code with their count and severity, most frequent first."""
    return (
        notices.groupBy(*keys, "code")
        .agg(F.count(F.lit(1)).alias("notices"))
        .withColumn("severity", notice_severity(F.col("code")))
        .orderBy(*keys, F.col("notices").desc(), "code")
    )


def detector_states(
    detectors: DataFrame,
    log_roles: DataFrame,
    affected: Sequence[str] = ("critica",),
) -> DataFrame:
    """Which detectors run on each log, and why the others do not.

    ``detectors(detector, roles, severities)`` is configuration; ``log_roles(log_id,
    role, confirmed)``. A detector is off when a role is missing, or when it can
    emit an affected severity and a role is unconfirmed.
    """
    needed = detectors.select("detector", F.explode_outer("roles").alias("role"))
    grid = with_each(log_roles.select("log_id").distinct(), needed)
    have = log_roles.groupBy("log_id", "role").agg(F.max("confirmed").alias("_c"))
    met = grid.join(have, ["log_id", "role"], "left")
    lists = met.groupBy("log_id", "detector").agg(
        F.sort_array(F.collect_list(F.when(F.col("role").isNotNull() & F.col("_c").isNull(), F.col("role")))).alias("missing"),
        F.sort_array(F.collect_list(F.when(~F.col("_c"), F.col("role")))).alias("unconfirmed"),
    )
    sensitive = F.arrays_overlap("severities", F.array(*[F.lit(a) for a in affected]))
    out = lists.join(detectors.select("detector", "severities"), "detector")
    reason = F.when(F.size("missing") > 0, "role_missing").when(
        sensitive & (F.size("unconfirmed") > 0), "role_unconfirmed"
    )
    return out.select("log_id", "detector", reason.isNull().alias("active"), reason.alias("reason"), "missing", "unconfirmed")
