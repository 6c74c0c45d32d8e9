"""Range-frame and row-to-row operators over ordered samples. Times in ms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Axis, has_splits, scan, span_of_key

#: Rows in a frame's length of one key up to which a plain RANGE frame is cheaper than two running halves.
NARROW = 256
AGGREGATES = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def most_in_a_block(df: DataFrame, axis: Axis, width: int) -> int:
    """The largest number of rows of one key in one block of the order axis."""
    block = F.floor(F.col(axis.order) / width).alias("_block")
    counts = df.select(*axis.keys, block).groupBy(*axis.keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def sliding(df: DataFrame, axis: Axis, lo: int, hi: int, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """Append aggregates over ``[t + lo, t + hi]`` in time linear in the rows, however long the frame.

    The order axis is cut into blocks as long as the frame, so a frame ends in the block after
    the one it begins in: its aggregate is that of the first block from the frame's start and of
    the second block up to its end. Both are running aggregates inside one block, one in each
    direction, read off where the row stands as a probe at its frame's end and start. Work is
    dealt by key and block, so no key and no frame has to pass through one task.

    Where no key is oversized and no block of any key has more than ``NARROW`` rows (a count that is
    taken first, of keys and times only), the frame is a plain one: it looks at ``2 * NARROW`` rows at
    most and shares the exchange of the other windows over the axis.
    """
    if hi < lo:
        raise ValueError("the window ends before it starts")
    width = max(hi - lo, 1)
    names = list(df.columns)
    if not has_splits(df) and most_in_a_block(df, axis, width) <= NARROW:
        frame = Window.partitionBy(*axis.keys).orderBy(axis.order).rangeBetween(lo, hi)
        return df.select(*[c for c in names if c not in wanted], *[AGGREGATES[how](c).over(frame).alias(n) for n, (how, c) in wanted.items()])
    inputs = {f"_i_{n}": c for n, (_, c) in wanted.items()}
    base = df.withColumns(inputs)
    t = F.col(axis.order)

    def running(rows: DataFrame, at: Column, up: bool, out: str) -> DataFrame:
        """Aggregate of the samples from the block's edge to each probe, the probe's place included."""
        samples = base.select(*axis.keys, t.alias("_at"), *inputs, F.lit(0).alias("_probe"))
        probes = rows.drop(*inputs).withColumns({"_at": at, "_probe": F.lit(1)})
        both = probes.unionByName(samples, allowMissingColumns=True).withColumn("_block", F.floor(F.col("_at") / width))
        place = F.col("_at") if up else F.col("_at").desc()
        w = Window.partitionBy(*axis.keys, "_block").orderBy(place, "_probe").rowsBetween(Window.unboundedPreceding, 0)
        found = {f"{out}{n}": AGGREGATES[how](F.col(f"_i_{n}")).over(w) for n, (how, _) in wanted.items()}
        return both.withColumns(found).filter("_probe = 1").drop("_at", "_probe", "_block", *inputs)

    work = running(base, t + F.lit(hi), True, "_a_")
    work = running(work, t + F.lit(lo), False, "_b_")
    joined = {}
    for n, (how, _) in wanted.items():
        x, y = F.col(f"_a_{n}"), F.col(f"_b_{n}")
        if hi == lo:  # one instant: one block, and both directions see all of it
            joined[n] = x
        elif how in ("min", "max"):
            first = x < y if how == "min" else x > y
            joined[n] = F.when(y.isNull() | first, x).otherwise(y)
        elif how == "count":
            joined[n] = x + y
        else:
            joined[n] = F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x + y)
    return work.withColumns(joined).select(*[c for c in names if c not in wanted], *wanted)


def derivative(df: DataFrame, axis: Axis, value: Column, window_ms: int, out: str) -> DataFrame:
    """Slope per second against the earliest sample not older than the window.

    NULL without a time span or when either end is missing.
    """
    if window_ms <= 0:
        raise ValueError("the derivative window must be positive")
    tie = F.col(axis.ties[-1] if axis.ties else axis.order)
    first = F.struct(F.col(axis.order).alias("t"), tie.alias("tie"), value.alias("x"))
    work = sliding(df.withColumn("_x", value), axis, -window_ms, 0, {"_b": ("min", first)})
    dt = (F.col(axis.order) - F.col("_b.t")) / 1000.0
    return work.withColumn(out, F.when(dt > 0, F.try_divide(F.col("_x") - F.col("_b.x"), dt))).drop("_x", "_b")


def counter_delta(df: DataFrame, axis: Axis, value: Column, out: str) -> DataFrame:
    """Increment of a counter; the first row and resets are NULL."""
    d = scan(df, axis, prev={"_prev": value})
    step = value - F.col("_prev")
    return d.withColumn(out, F.when(step >= 0, step)).drop("_prev")


def plain_delta(df: DataFrame, axis: Axis, value: Column, out: str) -> DataFrame:
    """Difference with the preceding sample, negatives kept."""
    return scan(df, axis, prev={"_prev": value}).withColumn(out, value - F.col("_prev")).drop("_prev")


def window_extreme(
    df: DataFrame, axis: Axis, value: Column, lo_ms: int, hi_ms: int, how: str, out: str
) -> DataFrame:
    """Extreme over ``[t + lo, t + hi]``; NULL where that window leaves the log."""
    return window_extremes(df, axis, lo_ms, hi_ms, {out: (how, value)})


def window_extremes(
    df: DataFrame,
    axis: Axis,
    lo_ms: int,
    hi_ms: int,
    wanted: dict[str, tuple[str, Column]],
    *,
    need_current: bool = True,
) -> DataFrame:
    """Several extremes over one frame. ``how`` is ``min`` or ``max``."""
    inputs = {f"_x_{n}": c for n, (_, c) in wanted.items()}
    work = span_of_key(df.withColumns(inputs), axis)
    work = sliding(work, axis, lo_ms, hi_ms, {f"_y_{n}": (how, F.col(f"_x_{n}")) for n, (how, _) in wanted.items()})
    t = F.col(axis.order)
    inside = (t + F.lit(lo_ms) >= F.col("_t_first")) & (t + F.lit(hi_ms) <= F.col("_t_last"))
    return work.withColumns(
        {
            n: F.when(inside & (F.col(f"_x_{n}").isNotNull() if need_current else F.lit(True)), F.col(f"_y_{n}"))
            for n in wanted
        }
    ).drop("_t_first", "_t_last", *inputs, *[f"_y_{n}" for n in wanted])


def local_peak(
    df: DataFrame, axis: Axis, value: Column, prominence: float, window_ms: int, out: str
) -> DataFrame:
    """TRUE on window maxima standing out by ``prominence``, plateaus included."""
    if window_ms <= 0 or prominence < 0:
        raise ValueError("the peak window must be positive and the prominence not negative")
    half = window_ms // 2
    work = span_of_key(df.withColumn("_v", value), axis)
    work = sliding(work, axis, -half, half, {"_max": ("max", F.col("_v")), "_min": ("min", F.col("_v"))})
    t = F.col(axis.order)
    judged = (t - half >= F.col("_t_first")) & (t + half <= F.col("_t_last")) & F.col("_v").isNotNull()
    top = F.col("_v") >= F.col("_max")
    core = F.coalesce(top & (F.col("_v") - F.col("_min") >= prominence), F.lit(False)).cast("int")
    near = sliding(work.withColumn("_core", core), axis, -half, half, {"_near": ("max", F.col("_core"))})
    return near.withColumn(out, F.when(judged, top & (F.col("_near") > 0))).drop(
        "_v", "_max", "_min", "_core", "_near", "_t_first", "_t_last"
    )


def hold_after(df: DataFrame, axis: Axis, trigger: Column, window_ms: int, out: str) -> DataFrame:
    """TRUE while any trigger lies in ``[t - window, t]``; NULL in the first window."""
    work = window_extremes(df, axis, -window_ms, 0, {out: ("max", trigger.cast("int"))})
    return work.withColumn(out, F.col(out) > 0)


def moving_average(df: DataFrame, axis: Axis, value: Column, window_ms: int, out: str) -> DataFrame:
    """Mean over ``[t - window, t]``."""
    work = sliding(df, axis, -window_ms, 0, {"_sum": ("sum", value), "_n": ("count", value)})
    return work.withColumn(out, F.try_divide(F.col("_sum"), F.col("_n"))).drop("_sum", "_n")
