"""Can a role be compared across logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SPAN_RATIO = 10.0


def exclusion_reasons(declared: DataFrame, units: DataFrame) -> DataFrame:
    """Append why a declaration cannot take part (NULL when it can).

    ``declared(role, log_id, channel_id, dim, confidence, source_unit, pressure,
    reference_kpa, factor, offset, lo, hi)`` with raw ``lo`` / ``hi``; ``pressure``
    is absolute, gauge or NULL.
    """
    known = units.groupBy(F.col("dim").alias("_d")).agg(F.collect_set("unit").alias("_units"))
    out = declared.join(known, declared["dim"] == known["_d"], "left")
    foreign = F.col("source_unit").isNotNull() & ~F.array_contains("_units", F.col("source_unit"))
    gauge = (F.col("dim") == "pressure") & (F.col("pressure") == "gauge") & F.col("reference_kpa").isNull()
    reason = (
        F.when(F.col("dim").isNull(), "no_dimension")
        .when(F.col("_units").isNull(), "unknown_dimension")
        .when(F.col("confidence") == "unknown", "unconfirmed_scale")
        .when(F.coalesce(foreign, F.lit(False)), "foreign_unit")
        .when(F.coalesce(gauge, F.lit(False)), "gauge_without_reference")
    )
    return out.withColumn("reason", reason).drop("_d", "_units")


def comparability(declared: DataFrame, units: DataFrame, max_ratio: float = MAX_SPAN_RATIO) -> DataFrame:
    """One verdict per role, from a single aggregate over its declarations."""
    d = exclusion_reasons(declared, units)
    early = F.col("reason").isNull() | (F.col("reason") == "gauge_without_reference")
    live = F.col("reason").isNull()
    relative = (F.col("dim") == "pressure") & (F.col("pressure") == "gauge")
    ref = F.when(relative, F.coalesce("reference_kpa", F.lit(0.0))).otherwise(0.0)
    ranged = live & F.col("lo").isNotNull() & F.col("hi").isNotNull()
    a, b = F.col("lo") * F.col("factor"), F.col("hi") * F.col("factor")
    d = d.withColumns(
        {
            "_lo": F.when(ranged, F.least(a, b) + F.col("offset") + ref),
            "_hi": F.when(ranged, F.greatest(a, b) + F.col("offset") + ref),
            "_span": F.when(ranged & (F.abs(a - b) > 0), F.abs(a - b)),
        }
    )
    g = d.groupBy("role").agg(
        F.count(F.lit(1)).alias("declared"),
        F.count_if(live).alias("comparable_logs"),
        F.count_if(early).alias("_early"),
        F.count_if(F.col("reason").isNotNull()).alias("excluded"),
        F.count_distinct(F.when(early, F.col("dim"))).alias("_dims"),
        F.min(F.when(early, F.col("dim"))).alias("_dim"),
        F.count("_lo").alias("_ranges"),
        F.count("_span").alias("_spans"),
        F.try_divide(F.max("_span"), F.min("_span")).alias("_ratio"),
        (F.max("_lo") > F.min("_hi")).alias("_disjoint"),
        F.count_if(live & relative).alias("_referenced"),
        F.count_if(live & (F.col("dim") == "pressure") & F.col("pressure").isNull()).alias("_undeclared"),
    )
    bad_span = (F.col("_ranges") >= 2) & (F.col("_spans") >= 2) & (F.col("_ratio") >= max_ratio)
    apart = (F.col("_ranges") >= 2) & F.coalesce("_disjoint", F.lit(False))
    reason = (
        F.when(F.col("declared") < 2, "single")
        .when(F.col("_dims") > 1, "different_dimensions")
        .when(F.col("comparable_logs") < 2, "too_few_left")
        .when(F.coalesce(bad_span, F.lit(False)), "incoherent_span")
        .when(apart, "disjoint_ranges")
    )
    noted = (F.col("excluded") > 0) | (F.col("_referenced") > 0) | (F.col("_undeclared") > 0)
    return g.withColumn("reason", reason).select(
        "role",
        F.when(F.col("reason") == "single", "nothing_to_compare")
        .when(F.col("reason").isNotNull(), "not_comparable")
        .when(noted, "with_reservation")
        .otherwise("comparable")
        .alias("verdict"),
        "reason", "declared", "comparable_logs", "excluded",
        F.when(F.col("_dims") == 1, F.col("_dim")).alias("dim"),
        ((F.col("_ranges") >= 2) & (F.col("_dims") == 1)).alias("scale_checked"),
    )
