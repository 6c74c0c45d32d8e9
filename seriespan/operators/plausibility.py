"""Does a channel's data fit the range its role allows, and if not, why."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.units import (
    AFFINE,
    DEFAULT_REFERENCE_KPA,
    GAUGE_DIMENSIONS,
    NOT_CONVERTIBLE,
    PARAMETRIC_KIND,
    RECIPROCAL,
    UNITS,
    units_of,
)

# Fixed values.
SEVERITIES = ["critica", "alta", "media", "baja", "informativa"]
DEFECTS = [
    "dimension_mismatch", "wrong_unit", "afr_for_lambda", "gauge_without_reference",
    "inverted_sign", "wrong_scale", "unexplained",
]
CANDIDATE_FACTORS = [-1.0, 10.0, 0.1, 100.0, 0.01, 1000.0, 0.001]


@dataclass(frozen=True)
class PlausibilityLimits:
    """Fixed default values."""

    max_excursion: float = 0.02
    max_after_fix: float = 0.02
    min_samples: int = 50
    factors: tuple[float, ...] = tuple(CANDIDATE_FACTORS)


def hypotheses(
    dimension: str | None, lim: PlausibilityLimits, reference_kpa: float | None = DEFAULT_REFERENCE_KPA
) -> list[tuple]:
    """Corrections to try for a dimension, in order; fewer than twenty.

    A correction maps ``v`` to ``(v - b) / a + shift`` or ``a / v``: the units of
    the dimension (the stoichiometric one first), a missing gauge reference, then
    plain factors by the size of their logarithm. Rows are ``(diagnosis, unit, kind,
    a, b, shift, factor)``.
    """
    tries: list[tuple] = []
    if dimension is not None and dimension not in NOT_CONVERTIBLE:
        for c in sorted(units_of(dimension)[1:], key=lambda c: c.parameter_role != "stoichiometry"):
            diagnosis = "afr_for_lambda" if c.parameter_role == "stoichiometry" else "wrong_unit"
            factor = None if c.kind == RECIPROCAL or c.b != 0 else 1.0 / c.a
            tries.append((diagnosis, c.unit, c.kind, c.a, c.b, 0.0, factor))
        if dimension in GAUGE_DIMENSIONS and reference_kpa is not None:
            tries.append(("gauge_without_reference", None, AFFINE, 1.0, 0.0, reference_kpa, None))
    for f in sorted(lim.factors, key=lambda x: abs(math.log(abs(x)))):
        tries.append(("inverted_sign" if abs(f) == 1 else "wrong_scale", None, AFFINE, 1.0 / f, 0.0, 0.0, f))
    return tries


TRY = "struct<diagnosis:string,unit:string,kind:string,a:double,b:double,shift:double,factor:double>"


def _with_tries(roles: DataFrame, lim: PlausibilityLimits) -> tuple[DataFrame, int]:
    """Roles with the corrections of their dimension, and the longest list."""
    known = list(dict.fromkeys(r[0] for r in UNITS))
    table = {dim: hypotheses(dim, lim) for dim in known}
    other = hypotheses(None, lim)
    frame = roles.sparkSession.createDataFrame(
        [*table.items(), ("*", other)], f"_dim string, tries array<{TRY}>"
    )
    keyed = roles.withColumn(
        "_key", F.when(F.col("role_dim").isin(known), F.col("role_dim")).otherwise("*")
    )
    out = keyed.join(F.broadcast(frame), F.col("_key") == F.col("_dim"), "left").drop("_key", "_dim")
    return out, max(len(t) for t in [*table.values(), other])


def evaluate(
    samples: DataFrame,
    channels: DataFrame,
    roles: DataFrame,
    lim: PlausibilityLimits,
    *,
    sentinels: Sequence[float] = (),
    stoichiometry: float | None = None,
) -> DataFrame:
    """One finding per channel, from a single pass over the samples.

    ``channels(log_id, channel_id, role, confidence, dim)``, ``roles(role, role_dim,
    lo, hi, critical)``. Each row is tested against its role's range as it is and
    under every correction of its dimension; the counters are plain sums that
    combine map-side, so nothing is expanded or read twice.
    """
    keys = ["log_id", "channel_id"]
    config, slots = _with_tries(roles, lim)
    info = channels.join(config, "role", "left")
    rows = samples.select(*keys, "v").join(info, keys)
    v = F.col("v")
    marked = F.coalesce(v.isin([float(s) for s in sentinels]), F.lit(False)) if sentinels else F.lit(False)
    good = v.isNotNull() & ~marked

    def out_of(x: Column) -> Column:
        low = F.when(F.col("lo").isNull(), False).otherwise(F.coalesce(x < F.col("lo"), F.lit(True)))
        high = F.when(F.col("hi").isNull(), False).otherwise(F.coalesce(x > F.col("hi"), F.lit(True)))
        return low | high

    def corrected(t: Column) -> Column:
        a = t["a"]
        if stoichiometry is not None:
            a = F.when(t["kind"] == PARAMETRIC_KIND, F.lit(float(stoichiometry))).otherwise(a)
        return F.when(t["kind"] == RECIPROCAL, F.try_divide(a, v)).otherwise((v - t["b"]) / a + t["shift"])

    rows = rows.select(
        *keys, v.alias("v"), good.alias("_good"), (v.isNotNull() & marked).alias("_marked"), out_of(v).alias("_out"),
        F.when(good, F.transform("tries", lambda t: out_of(corrected(t)))).alias("_tested"),
    )
    good = F.col("_good")
    bad = [F.count_if(F.get("_tested", F.lit(i))).alias(f"_bad_{i}") for i in range(slots)]
    counted = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(v.isNull()).alias("gaps"),
        F.count_if("_marked").alias("sentinels"),
        F.count_if(good).alias("valid"),
        F.count_if(good & F.col("_out")).alias("outside"),
        F.min(F.when(good, v)).alias("v_min"),
        F.max(F.when(good, v)).alias("v_max"),
        *bad,
    )
    base = info.join(counted, keys, "left").fillna(0, ["n", "gaps", "sentinels", "valid", "outside"])
    share = F.coalesce(F.try_divide(F.col("outside").cast("double"), F.col("valid")), F.lit(0.0))
    ranged = F.col("lo").isNotNull() | F.col("hi").isNotNull()
    mismatch = (
        F.col("dim").isNotNull() & (F.col("dim") != "unknown") & F.col("role_dim").isNotNull()
        & (F.col("dim") != F.col("role_dim"))
    )
    known = F.col("role_dim").isNotNull() | ranged
    verdict = (
        F.when(F.col("valid") == 0, "no_data")
        .when(F.col("role").isNull() | ~known, "no_role")
        .when(F.coalesce(mismatch, F.lit(False)), "dimension_mismatch")
        .when(~ranged, "no_range")
        .when(F.col("valid") < lim.min_samples, "few_samples")
        .when(F.col("outside") == 0, "plausible")
        .when(F.col("outside_share") <= lim.max_excursion, "excursion")
    )
    tested = F.zip_with(
        "tries",
        F.slice(F.array(*[F.col(f"_bad_{i}") for i in range(slots)]), F.lit(1), F.size("tries")),
        lambda t, n: F.struct(t.alias("t"), F.try_divide(n.cast("double"), F.col("valid")).alias("share")),
    )
    passing = F.filter(tested, lambda x: x["share"] <= lim.max_after_fix)
    out = base.withColumn("outside_share", share).withColumn("_verdict", verdict)
    out = out.withColumn("_fix", F.when(F.col("_verdict").isNull(), F.get(passing, F.lit(0))))
    out = out.withColumn("diagnosis", F.coalesce("_verdict", F.col("_fix.t.diagnosis"), F.lit("unexplained")))
    critical = F.coalesce("critical", F.lit(False))
    severity = (
        F.when(F.col("diagnosis").isin(DEFECTS), F.when(critical, "critica").otherwise("alta"))
        .when(F.col("diagnosis") == "excursion", F.when(critical, "media").otherwise("baja"))
        .when(F.col("diagnosis") == "no_data", F.when(critical, "media").otherwise("informativa"))
        .otherwise("informativa")
    )
    return out.select(
        *keys, "role", "diagnosis", severity.alias("severity"),
        "n", "valid", "gaps", "sentinels", "outside", "outside_share", "v_min", "v_max",
        F.col("_fix.t.unit").alias("likely_unit"),
        F.col("_fix.t.factor").alias("factor"),
        F.col("_fix.share").alias("fixed_share"),
        (F.col("confidence") == "fuzzy").alias("unconfirmed"),
    )


def severity_rank(severity: Column, order: Sequence[str] = SEVERITIES) -> Column:
    rank = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        rank = F.when(severity == s, i).otherwise(rank)
    return rank


def report(findings: DataFrame) -> DataFrame:
    """Findings ordered by severity, share outside (largest first) and channel."""
    return findings.withColumn("rank", severity_rank(F.col("severity"))).orderBy(
        "rank", F.col("outside_share").desc(), "channel_id", "log_id"
    )


def diagnosis_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("diagnosis").agg(F.count(F.lit(1)).alias("channels"))
