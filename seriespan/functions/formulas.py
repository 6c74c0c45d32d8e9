"""Derived channels over a role-pivoted frame (see ``align.role_grid``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def smallest(*xs: Column) -> Column:
    """``min`` that is NULL when any operand is; ``F.least`` would skip it."""
    return F.when(reduce(lambda a, b: a | b, [x.isNull() for x in xs]), None).otherwise(F.least(*xs))


def largest(*xs: Column) -> Column:
    return F.when(reduce(lambda a, b: a | b, [x.isNull() for x in xs]), None).otherwise(F.greatest(*xs))


def lambda_error(measured: Column, target: Column) -> Column:
    return F.try_divide(measured, target) - 1.0


def air_fuel_ratio(measured: Column, stoichiometry: Column) -> Column:
    return measured * stoichiometry


def gauge_boost(manifold: Column, barometric: Column) -> Column:
    return manifold - barometric


def pressure_ratio(manifold: Column, barometric: Column) -> Column:
    return F.try_divide(manifold, barometric)


def boost_error(actual: Column, target: Column) -> Column:
    return actual - target


def wheel_slip(driven: Column, vehicle: Column) -> Column:
    return driven - vehicle


def log_delta(here: Column, there: Column) -> Column:
    return here - there


# Operand roles, dimension and magnitude class of each formula.
LIBRARY = {
    "lambda_error": (lambda_error, ("lambda_measured", "lambda_target"), "ratio", "point"),
    "afr": (air_fuel_ratio, ("lambda_measured", "stoichiometry"), "mixture_ratio", "point"),
    "relative_boost": (gauge_boost, ("manifold_pressure", "baro_pressure"), "pressure", "interval"),
    "pressure_ratio": (pressure_ratio, ("manifold_pressure", "baro_pressure"), "ratio", "rate"),
    "boost_error": (boost_error, ("boost_pressure_actual", "boost_pressure_target"), "pressure", "interval"),
    "wheel_slip": (wheel_slip, ("driven_wheel_speed", "vehicle_speed"), "speed", "interval"),
    "log_delta": (log_delta, ("manifold_pressure", "manifold_pressure"), "pressure", "interval"),
}
