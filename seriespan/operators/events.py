"""Events from conditions: runs, accumulated time, crossings, state lanes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Axis, runs, scan


def events(
    df: DataFrame,
    axis: Axis,
    condition: Column,
    *,
    min_ms: int = 0,
    min_samples: int = 1,
    aggregates: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """One row per maximal run of TRUE that lasts long enough."""
    found = runs(df, axis, condition, aggregates)
    return found.filter(
        (F.col("t_end") - F.col("t_start") >= min_ms) & (F.col("n") >= min_samples)
    ).drop("state")


def over_event_cap(found: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Logs with more than ``cap`` events and how many: widen their hysteresis or duration.

    Nothing is cut and no other log fails with them; the caller decides.
    """
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("events")).filter(F.col("events") > cap)


def accumulated_time(found: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds covered by events per key."""
    return found.groupBy(*keys).agg(
        (F.sum(F.col("t_end") - F.col("t_start")) / 1000.0).alias("seconds"),
        F.count(F.lit(1)).alias("events"),
    )


def crossings(df: DataFrame, axis: Axis, condition: Column) -> DataFrame:
    """State changes between adjacent samples that are both valid, per key."""
    work = scan(df.withColumn("_c", condition), axis, prev={"_pc": F.col("_c")})
    return work.groupBy(*axis.keys).agg(
        F.coalesce(F.sum((F.col("_c") != F.col("_pc")).cast("bigint")), F.lit(0)).alias("crossings")
    )


def state_lanes(df: DataFrame, axis: Axis, state: Column) -> DataFrame:
    """Bands of equal state, with the state before each band (NULL for the first)."""
    lanes = runs(df, axis, state, only_true=False)
    keep = [*axis.keys, "state", "t_start", "t_end", "i_start", "i_end", "n"]
    return lanes.select(*keep)


def transitions(df: DataFrame, axis: Axis, state: Column) -> DataFrame:
    """Rows where the state differs from the preceding sample's."""
    work = scan(df.withColumn("_s", state), axis, prev={"_ps": F.col("_s")})
    return work.filter(F.col("_s") != F.col("_ps")).select(
        *axis.keys, *dict.fromkeys([axis.order, *axis.ties]),
        F.col("_ps").alias("from_state"), F.col("_s").alias("to_state"),
    )
