"""Data quality of series: gaps, clock jumps, statistics, sampling groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import measured
from .ordered import CHANNEL_FILE, LOG_FILE, Axis, has_splits, scan
from .quantiles import quantiles

STAT_QUANTILES = {"p1": 0.01, "p5": 0.05, "p50": 0.50, "p95": 0.95, "p99": 0.99}


def steps(samples: DataFrame, axis: Axis = CHANNEL_FILE, t: str = "t_ms") -> DataFrame:
    """Append the previous time and the step to it, in file order."""
    return scan(samples, axis, prev={"t_prev": F.col(t)}).withColumn("dt", F.col(t) - F.col("t_prev"))


def typical_period(samples: DataFrame, axis: Axis = CHANNEL_FILE, t: str = "t_ms") -> DataFrame:
    """Median of the positive time steps per series; series without one are absent.

    Samples without splits have no oversized series, so neither have their steps.
    """
    d = steps(samples, axis, t).filter(F.col("dt") > 0)
    return quantiles(d, list(axis.keys), "dt", {"period_ms": 0.5}, check=has_splits(samples))


def gaps(samples: DataFrame, factor: float = 3.0, axis: Axis = CHANNEL_FILE, t: str = "t_ms") -> DataFrame:
    """Steps longer than ``factor`` typical periods."""
    d = steps(samples, axis, t)
    period = typical_period(samples, axis, t)
    return (
        d.filter(F.col("dt") > 0)
        .join(measured(period), list(axis.keys))
        .filter(F.col("dt") > F.lit(float(factor)) * F.col("period_ms"))
        .select(
            *axis.keys,
            F.col("t_prev").alias("t_start"),
            F.col(t).alias("t_end"),
            F.col("dt").alias("duration_ms"),
            (F.col("dt") / F.col("period_ms")).alias("factor"),
        )
    )


def clock_jumps(samples: DataFrame, axis: Axis = LOG_FILE, t: str = "t_ms") -> DataFrame:
    """Rows whose time lies before the preceding row's, in file order."""
    d = steps(samples, axis, t).filter(F.col("dt") < 0)
    return d.select(*axis.keys, axis.order, F.col("t_prev").alias("t_start"), F.col(t).alias("t_end"), "dt")


def unwrap_midnight(rows: DataFrame, seconds: str, axis: Axis = LOG_FILE) -> DataFrame:
    """Add a day at each drop of more than 12 h; flag the other backward steps."""
    work = scan(rows, axis, prev={"_prev": F.col(seconds)})
    step = F.col(seconds) - F.col("_prev")
    work = work.withColumn("_wrap", F.coalesce((step < -43200).cast("bigint"), F.lit(0)))
    work = work.withColumn("anomaly", F.coalesce((step < 0) & (step >= -43200), F.lit(False)))
    work = scan(work, axis, total={"_days": F.col("_wrap")})
    return work.withColumn("t_abs_s", F.col(seconds) + F.col("_days") * 86400).drop("_prev", "_wrap", "_days")


def channel_stats(
    samples: DataFrame,
    keys: list[str],
    value: str = "v",
    declared_lo: Column | None = None,
    declared_hi: Column | None = None,
) -> DataFrame:
    """Counts, extremes, percentiles and flags per series."""
    v = F.col(value)
    below = F.lit(False) if declared_lo is None else F.coalesce(v < declared_lo, F.lit(False))
    above = F.lit(False) if declared_hi is None else F.coalesce(v > declared_hi, F.lit(False))
    basic = samples.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.min(v).alias("v_min"),
        F.max(v).alias("v_max"),
        F.max(below | above).alias("outside_declared"),
    )
    q = quantiles(samples, keys, value, STAT_QUANTILES)
    return basic.join(q, keys, "left").select(
        *keys, "n", "v_min", "v_max", *STAT_QUANTILES,
        (F.col("n") == 0).alias("is_empty"),
        F.coalesce(F.col("v_min") == F.col("v_max"), F.lit(False)).alias("is_constant"),
        "outside_declared",
        (
            (F.col("n") > 0)
            & F.coalesce(F.col("v_min") != F.col("v_max"), F.lit(False))
            & ~F.coalesce("outside_declared", F.lit(False))
        ).alias("is_active"),
    )


def sampling_groups(samples: DataFrame, position: str = "seq") -> DataFrame:
    """Group the channels of a log that were sampled at exactly the same rows.

    The set of positions is summarised by its count, extremes and two independent
    64-bit hash sums, which merge map-side; nothing is collected.
    """
    h = F.xxhash64(position)
    g = F.xxhash64(F.lit(17), F.col(position))
    signature = samples.groupBy("log_id", "channel_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(position).alias("first"),
        F.max(position).alias("last"),
        F.bit_xor(h).alias("hx"),
        F.sum(g.cast("decimal(38,0)")).alias("hs"),
    )
    return (
        signature.groupBy("log_id", "n", "first", "last", "hx", "hs")
        .agg(F.sort_array(F.collect_list("channel_id")).alias("channels"))
        .select("log_id", F.col("channels")[0].alias("lead_channel"), "channels", "n")
    )
