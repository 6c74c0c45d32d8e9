"""Gear detection from the speed / engine-speed ratio."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import measured


@dataclass(frozen=True)
class GearLimits:
    """Fixed default values."""

    min_rpm: float = 1200.0
    min_speed: float = 10.0
    cell: float = 0.2
    min_samples: int = 25
    tolerance: float = 0.04
    separation: float = 0.12
    max_gears: int | None = None


def _useful(rpm: Column, speed: Column, lim: GearLimits) -> Column:
    return F.coalesce((rpm >= lim.min_rpm) & (speed >= lim.min_speed), F.lit(False))


def with_ratio(grid: DataFrame, rpm: str, speed: str, lim: GearLimits) -> DataFrame:
    """Append ``ratio`` (speed per 1000 rpm), NULL where the sample is not useful."""
    r, v = F.col(rpm), F.col(speed)
    return grid.withColumn("ratio", F.when(_useful(r, v, lim), F.try_divide(v, r) * 1000.0))


def histogram(ratios: DataFrame, lim: GearLimits) -> DataFrame:
    """Samples per ratio cell; cells are open on the left."""
    cell = F.greatest(F.ceil(F.col("ratio") / lim.cell) - 1, F.lit(0))
    return ratios.filter(F.col("ratio").isNotNull()).groupBy("log_id", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n")
    )


def gear_table(hist: DataFrame, lim: GearLimits) -> DataFrame:
    """Candidate gears per log: local maxima, close ones merged by weight.

    Works on the histogram, a few hundred cells per log whatever the sample count.
    """
    w = Window.partitionBy("log_id").orderBy("cell")

    def neighbour(step: int) -> Column:
        other, n = F.lag("cell", step).over(w), F.lag("n", step).over(w)
        return F.when(other == F.col("cell") - step, n).otherwise(0)

    tops = hist.withColumns({"_left": neighbour(1), "_right": neighbour(-1)}).filter(
        (F.col("n") >= lim.min_samples) & (F.col("n") >= F.col("_left")) & (F.col("n") >= F.col("_right"))
    )
    item = F.struct(
        F.col("cell"), ((F.col("cell") + 0.5) * lim.cell).alias("c"), F.col("n").cast("double").alias("w")
    )
    peaks = tops.groupBy("log_id").agg(F.sort_array(F.collect_list(item)).alias("p"))

    def fold(acc: Column, x: Column) -> Column:
        end = F.try_element_at(acc, F.lit(-1))
        near = F.coalesce(x["c"] / end["c"] - 1.0 < lim.separation, F.lit(False))
        weight = end["w"] + x["w"]
        merged = F.struct(((end["c"] * end["w"] + x["c"] * x["w"]) / weight).alias("c"), weight.alias("w"))
        return F.when(
            near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))
        ).otherwise(F.concat(acc, F.array(F.struct(x["c"].alias("c"), x["w"].alias("w")))))

    empty = F.array().cast("array<struct<c:double,w:double>>")
    return peaks.select(
        "log_id",
        F.size("p").alias("peaks"),
        F.transform(
            F.aggregate("p", empty, fold),
            lambda g, i: F.struct(
                (i + 1).alias("k"), g["c"].alias("centre"),
                (g["c"] * (1.0 - lim.tolerance)).alias("lo"), (g["c"] * (1.0 + lim.tolerance)).alias("hi"),
            ),
        ).alias("gears"),
    )


def detect_gears(grid: DataFrame, rpm: str, speed: str, lim: GearLimits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(gears, summary, samples)``: kept gears renumbered from 1, reasons per log,
    and the grid with its ``gear`` (0 = none). With ``max_gears``, more peaks mark
    the log ``too_many_peaks`` and gives it no gears.
    """
    r, v = F.col(rpm), F.col(speed)
    ratios = with_ratio(grid, rpm, speed, lim)
    table = gear_table(histogram(ratios, lim), lim)
    too_many = F.lit(False) if lim.max_gears is None else F.coalesce("peaks", F.lit(0)) > lim.max_gears
    fine = table.filter(~too_many)
    band = F.try_element_at(
        F.filter("gears", lambda g: (F.col("ratio") >= g["lo"]) & (F.col("ratio") < g["hi"])), F.lit(1)
    )
    raw = ratios.join(measured(fine.select("log_id", "gears")), "log_id", "left").withColumn(
        "_k", F.when(F.col("ratio").isNotNull(), band["k"])
    )
    counts = raw.filter(F.col("_k").isNotNull()).groupBy("log_id", "_k").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.filter(F.col("n") >= lim.min_samples).withColumn(
        "gear", F.row_number().over(Window.partitionBy("log_id").orderBy("_k"))
    )
    useful = ratios.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(r.isNull() | v.isNull()).alias("no_data"),
        F.count("ratio").alias("useful"),
    )
    centres = fine.select("log_id", F.explode("gears").alias("g")).select(
        "log_id", F.col("g.k").alias("_k"), F.col("g.centre").alias("ratio")
    )
    gears = kept.join(centres, ["log_id", "_k"]).join(useful.select("log_id", "useful"), "log_id").select(
        "log_id", "gear", "ratio", "n", (F.col("n") / F.col("useful")).alias("share")
    )
    assigned = kept.groupBy("log_id").agg(F.sum("n").alias("_in"), F.count(F.lit(1)).alias("gears"))
    summary = (
        useful.join(assigned, "log_id", "left")
        .join(table.select("log_id", "peaks"), "log_id", "left")
        .select(
            "log_id", "n", "no_data", "useful",
            (F.col("n") - F.col("no_data") - F.col("useful")).alias("stopped"),
            (F.col("useful") - F.coalesce("_in", F.lit(0))).alias("between"),
            F.coalesce("gears", F.lit(0)).alias("gears"),
            F.when(too_many, "too_many_peaks").otherwise("ok").alias("status"),
        )
    )
    numbering = kept.groupBy("log_id").agg(F.map_from_entries(F.collect_list(F.struct("_k", "gear"))).alias("_m"))
    samples = (
        raw.join(measured(numbering), "log_id", "left")
        .withColumn("gear", F.coalesce(F.col("_m")[F.col("_k")], F.lit(0)))
        .drop("_k", "_m", "gears")
    )
    return gears, summary, samples
