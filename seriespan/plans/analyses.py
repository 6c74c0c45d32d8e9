"""Specified analyses built from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import mesh as meshes
from ..operators.events import crossings
from ..operators.lookup import measured
from ..operators.ordered import CHANNEL_TIME, LOG_TIME, Axis, scan
from ..operators.windows import counter_delta, plain_delta


def advance_map(grid: DataFrame, x: str, y: str, advance: str, x_edges, y_edges) -> DataFrame:
    """Mean ignition advance per cell."""
    return meshes.mesh(grid, [], F.col(x), F.col(y), F.col(advance), x_edges, y_edges)


def knock_density(grid: DataFrame, x: str, y: str, counter: str, x_edges, y_edges) -> DataFrame:
    """Samples with a rising knock counter per cell."""
    work = counter_delta(grid, LOG_TIME, F.col(counter), "_step").filter(F.col("_step") > 0)
    return meshes.mesh(work, [], F.col(x), F.col(y), F.col("_step"), x_edges, y_edges)


def error_map(grid: DataFrame, x: str, y: str, error: Column, x_edges, y_edges) -> DataFrame:
    """Lambda error per cell; an interval, so its unit takes no offset."""
    return meshes.mesh(grid, [], F.col(x), F.col(y), error, x_edges, y_edges)


def samples_in_segments(grid: DataFrame, segments: DataFrame, cell_ms: int) -> DataFrame:
    """Range join of samples to disjoint segments of their log.

    Segments are cut into fixed time cells, so the join is on (log, cell) and a log
    with very many samples spreads over its cells.
    """
    seg = segments.select("log_id", F.col("t_start").alias("_a"), F.col("t_end").alias("_b"))
    cells = seg.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_a") / cell_ms), F.floor(F.col("_b") / cell_ms)))
    )
    rows = grid.withColumn("_cell", F.floor(F.col("t_ms") / cell_ms))
    return (
        rows.join(cells, ["log_id", "_cell"])
        .filter((F.col("t_ms") >= F.col("_a")) & (F.col("t_ms") <= F.col("_b")))
        .withColumnRenamed("_a", "run_start")
        .withColumnRenamed("_b", "run_end")
        .drop("_cell")
    )


def run_overlay(in_runs: DataFrame, x: str, values: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """Mean of the channels per run and bin of ``x``, so runs compare by rpm."""
    return (
        in_runs.withColumn("bin", meshes.bin_index(F.col(x), edges))
        .filter(F.col("bin").isNotNull())
        .groupBy("log_id", "run_start", "bin")
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])
    )


def run_summary(in_runs: DataFrame, rpm: str, boost: str, mixture: str, knock_step: str) -> DataFrame:
    """Duration, rpm at both ends, highest boost, leanest reading, knock per run."""
    pos = F.struct("t_ms", "seq")
    return in_runs.groupBy("log_id", "run_start", "run_end").agg(
        ((F.first("run_end") - F.first("run_start")) / 1000.0).alias("seconds"),
        F.min_by(rpm, pos).alias("rpm_start"),
        F.max_by(rpm, pos).alias("rpm_end"),
        F.max(boost).alias("boost_max"),
        F.min(mixture).alias("lambda_min"),
        F.coalesce(F.sum(F.when(F.col(knock_step) > 0, F.col(knock_step))), F.lit(0)).alias("knock"),
    )


def actuator_saturation(df: DataFrame, axis: Axis, value: Column, lo: float, hi: float) -> DataFrame:
    """Share of the time spent at either end; each sample lasts until the next."""
    flag = (value <= lo) | (value >= hi)
    work = scan(df.withColumn("_f", flag), axis, prev={"_pf": F.col("_f"), "_pt": F.col(axis.order)})
    dt = F.col(axis.order) - F.col("_pt")
    return work.groupBy(*axis.keys).agg(
        F.try_divide(F.sum(F.when(F.col("_pf"), dt).otherwise(0)).cast("double"), F.sum(F.when(F.col("_pf").isNotNull(), dt))).alias("saturated_share")
    )


def idle_metrics(df: DataFrame, axis: Axis, error: Column, tolerance: float) -> DataFrame:
    """RMS error, share of rows settled and crossings of the zero error."""
    work = df.withColumn("_e", error)
    base = work.groupBy(*axis.keys).agg(
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rms"),
        F.avg((F.abs("_e") <= tolerance).cast("int")).alias("settled_share"),
    )
    return base.join(crossings(work, axis, F.col("_e") >= 0), list(axis.keys))


def recovery_times(df: DataFrame, axis: Axis, error: Column, tolerance: float) -> DataFrame:
    """Length of each excursion of the error beyond the tolerance, in seconds."""
    from ..operators.events import events

    found = events(df, axis, F.abs(error) > tolerance)
    return found.select(*axis.keys, "t_start", ((F.col("t_end") - F.col("t_start")) / 1000.0).alias("seconds"), "n")


def sum_check(df: DataFrame, total: Column, parts: Sequence[Column], tolerance: float) -> DataFrame:
    """Rows whose total differs from the sum of its parts."""
    expected = parts[0]
    for p in parts[1:]:
        expected = expected + p
    return df.withColumn("difference", total - expected).filter(F.abs("difference") > tolerance)


def sensor_health(df: DataFrame, keys: Sequence[str], value: str = "v", axis: Axis = CHANNEL_TIME) -> DataFrame:
    """Time share at the extremes and sample-to-sample noise per channel."""
    ends = df.groupBy(*keys).agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    work = plain_delta(df, axis, F.col(value), "_d").join(measured(ends), list(keys))
    return work.groupBy(*keys).agg(
        F.avg((F.col(value) == F.col("_hi")).cast("int")).alias("at_max"),
        F.avg((F.col(value) == F.col("_lo")).cast("int")).alias("at_min"),
        F.stddev_pop("_d").alias("noise"),
    )


def triage_table(
    samples: DataFrame, metrics: Mapping[str, tuple[str, str]], logs: DataFrame | None = None
) -> DataFrame:
    """One row per log with role metrics, exact, from the needed channels only.

    ``metrics`` maps a column to ``(role, aggregate)``; a log without the role has
    NULL there. Sorting happens on the canonical value by the caller.
    """
    fn = {"min": F.min, "max": F.max, "avg": F.avg, "sum": F.sum, "count": F.count}
    roles = sorted({r for r, _ in metrics.values()})
    wide = (
        samples.filter(F.col("channel_id").isin(roles))
        .groupBy("log_id")
        .agg(*[fn[a](F.when(F.col("channel_id") == r, F.col("v"))).alias(n) for n, (r, a) in metrics.items()])
    )
    return wide if logs is None else logs.join(wide, "log_id", "left")
