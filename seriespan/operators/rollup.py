"""Multi-resolution roll-ups: level k summarises 4**k consecutive samples.

Only complete blocks exist at a level. Blocks follow the sample rank inside each
(log, channel); the rank is a chunked running count, and every later aggregate
groups by block, so no channel ever sits in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import CHANNEL_TIME, Axis, scan

BASE = 4


def ranked(samples: DataFrame, axis: Axis = CHANNEL_TIME) -> DataFrame:
    """Append the 0-based sample rank ``rn`` of each row in its series."""
    return scan(samples, axis, total={"_n": F.lit(1).cast("bigint")}).withColumn(
        "rn", F.col("_n") - 1
    ).drop("_n")


def _levels(
    first: DataFrame, keys: list[str], levels: int, aggs: dict[str, Column], tail: bool = False
) -> DataFrame:
    """Levels 1..n from level-1 blocks in a single aggregate."""
    level = F.col("level")
    blocks = first.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    size = F.pow(F.lit(BASE), level - 1).cast("bigint")
    out = (
        blocks.groupBy(*keys, "level", F.floor(F.col("bucket") / size).alias("bucket"))
        .agg(F.sum(F.col("_full").cast("bigint")).alias("_blocks"), *[c.alias(n) for n, c in aggs.items()])
        .withColumn("complete", F.col("_blocks") == size)
        .drop("_blocks")
    )
    return out if tail else out.filter("complete").drop("complete")


def _first_level(rows: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys, F.floor(F.col("rn") / BASE).alias("bucket")).agg(
        (F.count(F.lit(1)) == BASE).alias("_full"), *[c.alias(n) for n, c in aggs.items()]
    )


def continuous(
    samples: DataFrame,
    levels: int,
    axis: Axis = CHANNEL_TIME,
    value: str = "v",
    *,
    tail: bool = False,
) -> DataFrame:
    """min, max, first and last value and the time span of every block.

    With ``tail`` the unfinished last block stays, marked ``complete = false``:
    slices need to know where the covered range ends.
    """
    keys, t = list(axis.keys), axis.order
    one = _first_level(
        ranked(samples, axis),
        keys,
        {
            "t_start": F.min(t), "t_end": F.max(t),
            "v_min": F.min(value), "v_max": F.max(value),
            "v_first": F.min_by(value, "rn"), "v_last": F.max_by(value, "rn"),
        },
    )
    aggs = {
        "t_start": F.min("t_start"), "t_end": F.max("t_end"),
        "v_min": F.min("v_min"), "v_max": F.max("v_max"),
        "v_first": F.min_by("v_first", F.col("bucket")), "v_last": F.max_by("v_last", F.col("bucket")),
    }
    return _levels(one, keys, levels, aggs, tail)


def counter(samples: DataFrame, levels: int, axis: Axis = CHANNEL_TIME, value: str = "v") -> DataFrame:
    """Sum of increments (resets count negative), first and last value."""
    keys = list(axis.keys)
    v = F.col(value)
    rows = scan(samples, axis, total={"_n": F.lit(1).cast("bigint")}, prev={"_prev": v}).withColumn(
        "rn", F.col("_n") - 1
    )
    rows = rows.withColumn("_step", v - F.coalesce("_prev", v))
    one = _first_level(
        rows,
        keys,
        {"increase": F.sum("_step"), "v_first": F.min_by(value, "rn"), "v_last": F.max_by(value, "rn")},
    )
    return _levels(
        one,
        keys,
        levels,
        {
            "increase": F.sum("increase"),
            "v_first": F.min_by("v_first", "bucket"),
            "v_last": F.max_by("v_last", "bucket"),
        },
    )


def bitmask(samples: DataFrame, levels: int, axis: Axis = CHANNEL_TIME, value: str = "v") -> DataFrame:
    """Bitwise OR of every block."""
    keys = list(axis.keys)
    one = _first_level(ranked(samples, axis), keys, {"bits": F.bit_or(value)})
    return _levels(one, keys, levels, {"bits": F.bit_or("bits")})


def enum_next(level: DataFrame, keys: list[str]) -> DataFrame:
    """The next level of an enum roll-up from the one below.

    Input columns ``bucket, mode, changed``; the mode of four child modes, ties to
    the earliest, and whether anything changed inside the block.
    """
    children = F.sort_array(F.collect_list(F.struct("bucket", "mode", "changed")))
    blocks = (
        level.groupBy(*keys, F.floor(F.col("bucket") / BASE).alias("_up"))
        .agg(children.alias("c"))
        .filter(F.size("c") == BASE)
    )
    votes = F.transform(
        "c",
        lambda x: F.struct(
            F.size(F.filter(F.col("c"), lambda y: y["mode"] == x["mode"])).alias("n"),
            (-x["bucket"]).alias("early"),
            x["mode"].alias("mode"),
        ),
    )
    changed = F.exists("c", lambda x: x["changed"] | (x["mode"] != F.col("c")[0]["mode"]))
    return blocks.select(
        *keys,
        F.col("_up").alias("bucket"),
        F.array_max(votes)["mode"].alias("mode"),
        changed.alias("changed"),
    )


def enum(samples: DataFrame, levels: int, axis: Axis = CHANNEL_TIME, value: str = "v") -> DataFrame:
    """Hierarchical mode and transition flag, levels 1..n.

    Each level is built from the one below (a fourth of its size); a materialising
    job writes a level and feeds the written table to ``enum_next``.
    """
    keys = list(axis.keys)
    below = ranked(samples, axis).select(
        *keys, F.col("rn").alias("bucket"), F.col(value).alias("mode"), F.lit(False).alias("changed")
    )
    out = None
    for k in range(1, levels + 1):
        below = enum_next(below, keys)
        this = below.select(*keys, F.lit(k).alias("level"), "bucket", "mode", "changed")
        out = this if out is None else out.unionByName(this)
    return out


def choose_level(rollup: DataFrame, keys: list[str], target: int) -> DataFrame:
    """Level whose bucket count is nearest ``target``; ties to the finer level."""
    counts = rollup.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("buckets"))
    return counts.groupBy(*keys).agg(
        F.min_by(F.struct("level", "buckets"), F.struct(F.abs(F.col("buckets") - target), F.col("level"))).alias("_c")
    ).select(*keys, "_c.level", "_c.buckets")


def slice_level(rollup: DataFrame, keys: list[str], level: int, t0: int, t1: int) -> DataFrame:
    """Complete buckets of one level overlapping ``[t0, t1]``, time from the first.

    A bucket lasts until the next one starts, so the one open at ``t0`` counts. A
    range that begins past the covered part is empty. ``rollup`` carries its tail.
    """
    lane = rollup.filter(F.col("level") == level)
    started = F.col("t_start") <= t0
    info = F.struct("bucket", "complete", "t_end")
    at = lane.groupBy(*keys).agg(
        F.max("bucket").alias("_last"),
        F.max(F.when(started, info)).alias("_open"),
    )
    past = F.col("_open").isNotNull() & (
        ~F.col("_open.complete") | ((F.col("_open.bucket") == F.col("_last")) & (F.col("_open.t_end") < t0))
    )
    at = at.filter(~past).select(*keys, F.coalesce("_open.bucket", F.lit(0)).alias("_from"))
    kept = lane.filter(F.col("complete") & (F.col("t_start") <= t1)).join(at, keys).filter(
        F.col("bucket") >= F.col("_from")
    )
    base = kept.groupBy(*keys).agg(F.min("t_start").alias("_base"))
    return kept.join(base, keys).withColumn("t_rel", F.col("t_start") - F.col("_base")).drop(
        "_from", "_base", "complete"
    )
