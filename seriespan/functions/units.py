"""Unit conversion as column expressions.

The magnitude class decides what a conversion may do: a POINT takes the affine
offset, an INTERVAL or RATE only the factor, a VARIANCE its square. Classes are
checked while the plan is built, never per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog.units import (
    AFFINE,
    DEFAULT_REFERENCE_KPA,
    GAUGE_DIMENSIONS,
    INTERVAL,
    NOT_CONVERTIBLE,
    POINT,
    RATE,
    RECIPROCAL,
    UNITS,
    VARIANCE,
    Conversion,
    canonical_unit,
    conversion,
)

CLASSES = (POINT, INTERVAL, RATE, VARIANCE)


def _check(conv: Conversion, cls: str) -> None:
    if cls not in CLASSES:
        raise ValueError(f"unknown magnitude class {cls!r}")
    if conv.kind == RECIPROCAL and cls != POINT:
        raise ValueError("a reciprocal unit only converts points")
    if conv.a == 0:
        raise ValueError("a conversion factor of zero is not invertible")


def _factor(conv: Conversion, param: Column | None) -> Column:
    default = F.lit(conv.a)
    return default if conv.kind == AFFINE or param is None else F.coalesce(param, default)


def _reference(x: Column, dimension: str, cls: str, reference: Column | float | None, sign: int) -> Column:
    if reference is None or cls != POINT:
        return x
    if dimension not in GAUGE_DIMENSIONS:
        raise ValueError(f"dimension {dimension!r} has no absolute / gauge reference")
    ref = reference if isinstance(reference, Column) else F.lit(float(reference))
    return x + ref * sign


def from_canonical(
    x: Column,
    dimension: str,
    unit: str,
    cls: str = POINT,
    *,
    param: Column | None = None,
    reference: Column | float | None = None,
) -> Column:
    conv = conversion(dimension, unit)
    _check(conv, cls)
    x = _reference(x, dimension, cls, reference, -1)
    if conv.kind == RECIPROCAL:
        return F.try_divide(F.lit(conv.a), x)
    a = _factor(conv, param)
    if cls == VARIANCE:
        return x * a * a
    return x * a + F.lit(conv.b) if cls == POINT else x * a


def to_canonical(
    x: Column,
    dimension: str,
    unit: str,
    cls: str = POINT,
    *,
    param: Column | None = None,
    reference: Column | float | None = None,
) -> Column:
    conv = conversion(dimension, unit)
    _check(conv, cls)
    if conv.kind == RECIPROCAL:
        out = F.try_divide(F.lit(conv.a), x)
    else:
        a = _factor(conv, param)
        if cls == VARIANCE:
            out = F.try_divide(x, a * a)
        elif cls == POINT:
            out = F.try_divide(x - F.lit(conv.b), a)
        else:
            out = F.try_divide(x, a)
    return _reference(out, dimension, cls, reference, +1)


def unit_frame(spark: SparkSession) -> DataFrame:
    """The unit catalogue, 85 rows: always small enough to broadcast."""
    return spark.createDataFrame(UNITS, "dim string, unit string, kind string, a double, b double")


def convert_by_catalogue(
    df: DataFrame, units: DataFrame, value: str, dim: str, unit: str, cls: str, out: str
) -> DataFrame:
    """Convert rows whose dimension, target unit and class are data.

    Unknown units and reciprocal non-points give NULL.
    """
    u = units.select(
        F.col("dim").alias("_dim"), F.col("unit").alias("_unit"),
        F.col("kind").alias("_kind"), F.col("a").alias("_a"), F.col("b").alias("_b"),
    )
    x, a, b = F.col(value), F.col("_a"), F.col("_b")
    linear = (
        F.when(F.col(cls) == POINT, x * a + b)
        .when(F.col(cls).isin(INTERVAL, RATE), x * a)
        .when(F.col(cls) == VARIANCE, x * a * a)
    )
    inverse = F.when(F.col(cls) == POINT, F.try_divide(a, x))
    return (
        df.join(F.broadcast(u), (F.col(dim) == F.col("_dim")) & (F.col(unit) == F.col("_unit")), "left")
        .withColumn(out, F.when(F.col("_kind") == RECIPROCAL, inverse).otherwise(linear))
        .drop("_dim", "_unit", "_kind", "_a", "_b")
    )


def compound_factor(numerator: tuple[str, str], denominator: tuple[str, str]) -> tuple[float, str]:
    """Factor and label of a quotient unit built from two affine units."""
    num, den = conversion(*numerator), conversion(*denominator)
    if num.kind != AFFINE or den.kind != AFFINE:
        raise ValueError("a compound unit needs two affine units")
    return num.a / den.a, f"{num.unit}/{den.unit}"


def compound_frame(units: DataFrame, compounds: DataFrame) -> DataFrame:
    """Every unit of the compound dimensions ``compounds(compound, num_dim, den_dim)``."""
    affine = units.filter(F.col("kind") == AFFINE)
    n = affine.select(F.col("dim").alias("num_dim"), F.col("unit").alias("num_unit"), F.col("a").alias("_an"))
    d = affine.select(F.col("dim").alias("den_dim"), F.col("unit").alias("den_unit"), F.col("a").alias("_ad"))
    return compounds.join(n, "num_dim").join(d, "den_dim").select(
        "compound", "num_unit", "den_unit",
        F.concat_ws("/", "num_unit", "den_unit").alias("label"),
        F.try_divide("_an", "_ad").alias("factor"),
    )


def effective_unit(
    channels: DataFrame, overrides: DataFrame, profile: DataFrame, preset: DataFrame, units: DataFrame
) -> DataFrame:
    """Unit of each channel and the layer that decided it.

    Order: channel override, profile, preset, canonical. ``overrides`` is keyed by
    channel, the others by dimension; a unit outside the dimension is ignored.
    """
    valid = units.select(F.col("dim").alias("_d"), F.col("unit").alias("_u"))

    def layer(frame: DataFrame, key: str, name: str) -> DataFrame:
        return frame.select(F.col(key).alias(f"_{name}_key"), F.col("unit").alias(f"_{name}"))

    out = (
        channels.join(layer(overrides, "channel_id", "override"), F.col("channel_id") == F.col("_override_key"), "left")
        .join(layer(profile, "dim", "profile"), F.col("dim") == F.col("_profile_key"), "left")
        .join(layer(preset, "dim", "preset"), F.col("dim") == F.col("_preset_key"), "left")
    )
    known = valid.groupBy("_d").agg(F.collect_set("_u").alias("_units"))
    out = out.join(known, F.col("dim") == F.col("_d"), "left")
    first = {d: canonical_unit(d) for d in dict.fromkeys(r[0] for r in UNITS)}
    canon = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])[F.col("dim")]

    def usable(name: str) -> Column:
        return F.when(F.array_contains("_units", F.col(f"_{name}")), F.col(f"_{name}"))

    o, p, s = usable("override"), usable("profile"), usable("preset")
    return out.select(
        *channels.columns,
        F.coalesce(o, p, s, canon).alias("unit"),
        F.when(o.isNotNull(), "override").when(p.isNotNull(), "profile")
        .when(s.isNotNull(), "preset").otherwise("canonical").alias("layer"),
    )


def conversion_parameter(samples: DataFrame, role: str, tolerance: float = 0.01) -> DataFrame:
    """Median of a parameter channel per log, flagged when it varies too much."""
    from ..operators.quantiles import quantiles

    rows = samples.filter(F.col("channel_id") == role)
    spread = rows.groupBy("log_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    return quantiles(rows, ["log_id"], "v", {"param": 0.5}).join(spread, "log_id").select(
        "log_id", "param",
        F.coalesce(F.try_divide(F.col("_hi") - F.col("_lo"), F.abs("param")) > tolerance, F.lit(False)).alias("varies"),
    )


def pressure_reference(
    logs: DataFrame,
    samples: DataFrame,
    *,
    pressure: str,
    speed: str,
    window_ms: int,
    declared: Column | None = None,
) -> DataFrame:
    """Reference per log: declared, else median pressure at standstill, else the constant."""
    from ..operators.align import role_grid
    from ..operators.ordered import has_splits
    from ..operators.quantiles import quantiles

    grid = role_grid(samples, pressure, [speed], window_ms)
    still = grid.filter(F.col(speed) == 0)
    measured = quantiles(still, ["log_id"], pressure, {"_measured": 0.5}, check=has_splits(grid))
    d = F.lit(None).cast("double") if declared is None else declared
    return logs.join(measured, "log_id", "left").select(
        *logs.columns,
        F.coalesce(d, F.col("_measured"), F.lit(DEFAULT_REFERENCE_KPA)).alias("reference_kpa"),
        (d.isNull() & F.col("_measured").isNull()).alias("estimated"),
    )


def scale_raw(channels: DataFrame, types: DataFrame) -> DataFrame:
    """Add ``dim, factor, confidence`` of each channel's declared type."""
    t = types.select("type", F.col("dim").alias("_dim"), F.col("factor").alias("_f"), F.col("confidence").alias("_c"))
    return channels.join(t, "type", "left").select(
        *channels.columns,
        F.coalesce("_dim", F.lit("unknown")).alias("dim"),
        F.when(F.col("_c").isin("confirmed", "inferred"), F.col("_f")).otherwise(F.lit(1.0)).alias("factor"),
        F.coalesce("_c", F.lit("unknown")).alias("confidence"),
    )


def export_policy(df: DataFrame, *, value: str = "raw") -> DataFrame:
    """Canonical value where it may be converted, else the raw one with a reason."""
    reason = (
        F.when(F.col("dim").isNull() | (F.col("dim") == "unknown"), "unknown_dimension")
        .when(F.col("confidence") != "confirmed", "unconfirmed_scale")
        .when(F.col("dim").isin(sorted(NOT_CONVERTIBLE)), "not_convertible")
    )
    return df.withColumn("reason", reason).withColumn(
        "value", F.when(F.col("reason").isNull(), F.col(value) * F.col("factor")).otherwise(F.col(value))
    )
