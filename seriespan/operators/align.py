"""Hold-last alignment of channels onto a reference grid."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import LOG_TIME, SPLIT, Axis, attach_splits, has_splits, scan


def hold_onto(
    samples: DataFrame,
    reference: Column,
    sources: Mapping[str, Column],
    window_ms: int,
    *,
    value: str = "v",
    axis: Axis = LOG_TIME,
    ages: bool = False,
) -> DataFrame:
    """As-of join of any number of channels onto the rows where ``reference`` holds.

    One ordered scan per log instead of a join per channel: each source keeps its
    last sample (missing or not), and it counts while not older than ``window_ms``.
    A source sample at the very instant of a reference row is seen by it. Output:
    the reference rows' columns plus one column per source.
    """
    t = F.col(axis.order)
    held = {f"_hold_{n}": F.when(is_source, F.struct(t.alias("t"), F.col(value).alias("v"))) for n, is_source in sources.items()}
    wanted = reference
    for is_source in sources.values():
        wanted = wanted | is_source
    work = samples.filter(wanted).withColumn("_ref", F.coalesce(reference, F.lit(False)).cast("int"))
    inner = Axis(axis.keys, axis.order, ("_ref", *axis.ties))
    out = scan(work, inner, hold=held).filter(F.col("_ref") == 1)
    columns = {}
    for n in sources:
        h = F.col(f"_hold_{n}")
        columns[n] = F.when(t - h["t"] <= window_ms, h["v"])
        if ages:
            columns[f"{n}_age_ms"] = t - h["t"]
    return out.withColumns(columns).drop("_ref", *held)


def role_grid(
    samples: DataFrame,
    grid: str,
    roles: list[str],
    window_ms: int,
    *,
    role: str = "channel_id",
    target_rows: int | None = None,
) -> DataFrame:
    """Wide frame on one role's instants: ``log_id, seq, t_ms, <grid>, <role>...``."""
    wanted = samples.filter(F.col(role).isin([grid, *roles]))
    if not has_splits(wanted):
        wanted = attach_splits(wanted, LOG_TIME, **({"target_rows": target_rows} if target_rows else {}))
    out = hold_onto(
        wanted,
        F.col(role) == grid,
        {r: F.col(role) == r for r in roles if r != grid},
        window_ms,
    )
    return out.select(
        "log_id",
        "seq",
        "t_ms",
        F.col("v").alias(grid),
        *[r for r in roles if r != grid],
        *([SPLIT] if has_splits(out) else []),
    )
