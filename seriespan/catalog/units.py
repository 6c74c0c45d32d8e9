"""Dimensions, units and presets.

Fixed values: conversion factors, names, presets and sentinels that results must
reproduce. ``UNITS`` rows are (dimension, unit, kind, a, b): canonical to unit is
``a * x + b`` for affine, ``a / x`` for reciprocal; a parametric factor is read
from the role channel named in ``PARAMETRIC`` or defaults to ``a``.
"""

from __future__ import annotations

from dataclasses import dataclass

POINT, INTERVAL, RATE, VARIANCE = "point", "interval", "rate", "variance"
AFFINE, RECIPROCAL, PARAMETRIC_KIND = "affine", "reciprocal", "parametric"

# Fixed values.
UNITS: list[tuple[str, str, str, float, float]] = [
    ("temperature", "K", "affine", 1.0, 0.0),
    ("temperature", "degC", "affine", 1.0, -273.15),
    ("temperature", "degF", "affine", 1.8, -459.67),
    ("temperature", "degR", "affine", 1.8, 0.0),
    ("pressure", "kPa", "affine", 1.0, 0.0),
    ("pressure", "hPa", "affine", 10.0, 0.0),
    ("pressure", "bar", "affine", 0.01, 0.0),
    ("pressure", "psi", "affine", 0.1450377377, 0.0),
    ("pressure", "atm", "affine", 0.009869232667, 0.0),
    ("pressure", "inHg", "affine", 0.2952998751, 0.0),
    ("pressure", "mmHg", "affine", 7.500615613, 0.0),
    ("mixture_ratio", "lambda", "affine", 1.0, 0.0),
    ("mixture_ratio", "afr", "parametric", 14.7, 0.0),
    ("mixture_ratio", "afr_gasolina", "affine", 14.7, 0.0),
    ("mixture_ratio", "phi", "reciprocal", 1.0, 0.0),
    ("angular_speed", "rpm", "affine", 1.0, 0.0),
    ("angular_speed", "rad/s", "affine", 0.1047197551, 0.0),
    ("angular_speed", "Hz", "affine", 0.01666666667, 0.0),
    ("speed", "km/h", "affine", 1.0, 0.0),
    ("speed", "mph", "affine", 0.6213711922, 0.0),
    ("speed", "m/s", "affine", 0.2777777778, 0.0),
    ("speed", "kn", "affine", 0.5399568035, 0.0),
    ("angle", "deg", "affine", 1.0, 0.0),
    ("angle", "rad", "affine", 0.01745329252, 0.0),
    ("angle", "deg_cam", "affine", 0.5, 0.0),
    ("ratio", "fraccion", "affine", 1.0, 0.0),
    ("ratio", "pct", "affine", 100.0, 0.0),
    ("ratio", "permil", "affine", 1000.0, 0.0),
    ("ratio", "ppm", "affine", 1000000.0, 0.0),
    ("voltage", "V", "affine", 1.0, 0.0),
    ("voltage", "mV", "affine", 1000.0, 0.0),
    ("time", "s", "affine", 1.0, 0.0),
    ("time", "ms", "affine", 1000.0, 0.0),
    ("time", "us", "affine", 1000000.0, 0.0),
    ("time", "min", "affine", 0.01666666667, 0.0),
    ("frequency", "Hz", "affine", 1.0, 0.0),
    ("frequency", "kHz", "affine", 0.001, 0.0),
    ("frequency", "rpm", "affine", 60.0, 0.0),
    ("frequency", "periodo_us", "reciprocal", 1000000.0, 0.0),
    ("resistance", "ohm", "affine", 1.0, 0.0),
    ("resistance", "kohm", "affine", 0.001, 0.0),
    ("resistance", "mohm", "affine", 1000.0, 0.0),
    ("sound_level", "dB", "affine", 1.0, 0.0),
    ("mass_flow", "kg/h", "affine", 1.0, 0.0),
    ("mass_flow", "g/s", "affine", 0.2777777778, 0.0),
    ("mass_flow", "lb/h", "affine", 2.204622622, 0.0),
    ("mass_flow", "lb/min", "affine", 0.03674371036, 0.0),
    ("volume_flow", "L/h", "affine", 1.0, 0.0),
    ("volume_flow", "cc/min", "affine", 16.66666667, 0.0),
    ("volume_flow", "gal/h", "affine", 0.2641720524, 0.0),
    ("volume", "L", "affine", 1.0, 0.0),
    ("volume", "cc", "affine", 1000.0, 0.0),
    ("volume", "in3", "affine", 61.02374409, 0.0),
    ("volume", "gal", "affine", 0.2641720524, 0.0),
    ("mass", "kg", "affine", 1.0, 0.0),
    ("mass", "g", "affine", 1000.0, 0.0),
    ("mass", "lb", "affine", 2.204622622, 0.0),
    ("mass", "oz", "affine", 35.27396195, 0.0),
    ("mass_per_cyl", "mg", "affine", 1.0, 0.0),
    ("mass_per_cyl", "g", "affine", 0.001, 0.0),
    ("mass_per_cyl", "grain", "affine", 0.01543235835, 0.0),
    ("density", "kg_m3", "affine", 1.0, 0.0),
    ("density", "g_cm3", "affine", 0.001, 0.0),
    ("density", "lb_ft3", "affine", 0.06242796058, 0.0),
    ("distance", "m", "affine", 1.0, 0.0),
    ("distance", "km", "affine", 0.001, 0.0),
    ("distance", "mi", "affine", 0.0006213711922, 0.0),
    ("distance", "ft", "affine", 3.280839895, 0.0),
    ("distance", "in", "affine", 39.37007874, 0.0),
    ("fuel_economy", "L/100km", "affine", 1.0, 0.0),
    ("fuel_economy", "km/L", "reciprocal", 100.0, 0.0),
    ("fuel_economy", "mpg_us", "reciprocal", 235.2145833, 0.0),
    ("fuel_economy", "mpg_uk", "reciprocal", 282.4809363, 0.0),
    ("torque", "Nm", "affine", 1.0, 0.0),
    ("torque", "lbft", "affine", 0.7375621493, 0.0),
    ("torque", "kgfm", "affine", 0.1019716213, 0.0),
    ("power", "kW", "affine", 1.0, 0.0),
    ("power", "hp", "affine", 1.34102209, 0.0),
    ("power", "PS", "affine", 1.359621617, 0.0),
    ("acceleration", "m_s2", "affine", 1.0, 0.0),
    ("acceleration", "g", "affine", 0.1019716213, 0.0),
    ("count", "count", "affine", 1.0, 0.0),
    ("enum", "enum", "affine", 1.0, 0.0),
    ("bitmask", "bitmask", "affine", 1.0, 0.0),
    ("unknown", "raw", "affine", 1.0, 0.0),
]

# Fixed values. The first unit listed for a dimension is its canonical one.
PARAMETRIC = {("mixture_ratio", "afr"): "stoichiometry"}
GAUGE_DIMENSIONS = {"pressure"}
NOT_CONVERTIBLE = {"sound_level", "count", "enum", "bitmask", "unknown"}
COMPOUNDS = {
    "pct_per_rpm": ("ratio", "angular_speed"),
    "pct_per_kPa": ("ratio", "pressure"),
    "pct_per_lambda": ("ratio", "mixture_ratio"),
}
DEFAULT_REFERENCE_KPA = 101.325
INT32_SENTINELS = [2147483647, -2147483648, -2147483645, -2147483628, -2147483639, 8388607]
TEXT_SENTINELS = ["", "NaN", "nan", "inf", "-inf", "#N/A", "N/A", "n/a", "NULL", "null", "---", "-"]
PRESETS: dict[str, dict[str, str]] = {
    "si": {
        "temperature": "K", "pressure": "kPa", "speed": "m/s", "mixture_ratio": "lambda",
        "volume": "L", "distance": "m", "time": "s", "ratio": "fraccion",
    },
    "metrico": {
        "temperature": "degC", "pressure": "bar", "speed": "km/h", "mixture_ratio": "lambda",
        "volume": "L", "distance": "km", "time": "ms", "ratio": "pct",
    },
    "imperial": {
        "temperature": "degF", "pressure": "psi", "speed": "mph", "mixture_ratio": "afr",
        "volume": "gal", "distance": "mi", "time": "ms", "ratio": "pct",
    },
    "motorsport_eu": {
        "temperature": "degC", "pressure": "bar", "speed": "km/h", "mixture_ratio": "lambda",
        "volume": "L", "distance": "km", "time": "ms", "ratio": "pct", "angle": "deg",
    },
    "motorsport_us": {
        "temperature": "degF", "pressure": "psi", "speed": "mph", "mixture_ratio": "afr",
        "volume": "gal", "distance": "mi", "time": "ms", "ratio": "pct", "angle": "deg",
    },
}


@dataclass(frozen=True)
class Conversion:
    dimension: str
    unit: str
    kind: str
    a: float
    b: float

    @property
    def parameter_role(self) -> str | None:
        return PARAMETRIC.get((self.dimension, self.unit))


def units_of(dimension: str) -> list[Conversion]:
    return [Conversion(*row) for row in UNITS if row[0] == dimension]


def canonical_unit(dimension: str) -> str:
    return units_of(dimension)[0].unit


def conversion(dimension: str, unit: str) -> Conversion:
    for c in units_of(dimension):
        if c.unit == unit:
            return c
    raise KeyError(f"unit {unit!r} does not belong to dimension {dimension!r}")
