"""Detector catalogue: fixed roles, severities and default thresholds."""

from __future__ import annotations

# Fixed values, in canonical units, seconds and fractions.
GENERAL = {"min_s": 0.1, "min_samples": 3, "margin": 0.02, "hold_ms": 250, "event_cap": 10_000, "peak_window_s": 0.5}

DETECTORS: dict[str, dict] = {
    "D1": {"roles": ["knock_count"], "severities": ["alta", "critica"], "min_delta": 1, "min_s": 0.0, "critical_rpm": 4000.0, "critical_map": 150.0},
    "D2": {"roles": ["knock_level", "knock_threshold"], "severities": ["media"], "margin_db": 0.0, "min_s": 0.1},
    "D3": {"roles": ["knock_retard"], "severities": ["media"], "max_deg": -1.0, "min_s": 0.1},
    "D4": {"roles": ["lambda_measured", "lambda_target", "throttle_position", "engine_speed"], "severities": ["critica"], "max_rel": 0.04, "throttle": 0.70, "rpm": 3000.0, "min_s": 0.2},
    "D5": {"roles": ["lambda_measured", "lambda_target", "throttle_position"], "severities": ["baja"], "min_rel": -0.07, "throttle": 0.50, "min_s": 2.0},
    "D6": {"roles": ["boost_pressure_actual"], "severities": ["alta"], "cut_fraction": 0.97, "absolute_kpa": 250.0, "min_s": 0.1},
    "D7": {"roles": ["boost_pressure_actual", "boost_pressure_target"], "severities": ["media"], "max_rel": 0.05},
    "D8": {"roles": ["injector_duty"], "severities": ["alta", "critica"], "warn": 0.85, "critical": 0.95, "min_s": 0.1},
    "D9": {"roles": ["coolant_temp"], "severities": ["alta"], "max_k": 378.15, "min_s": 3.0},
    "D10": {"roles": ["oil_pressure", "engine_speed"], "severities": ["critica"], "base_kpa": 201.3, "slope_kpa": 100.0, "min_s": 0.3},
    "D11": {"roles": ["battery_voltage", "engine_speed"], "severities": ["media"], "min_v": 11.5, "rpm": 500.0, "min_s": 1.0},
    "D12": {"roles": ["trigger_errors"], "severities": ["critica"], "min_s": 0.0},
    "D13": {"roles": ["protection_level"], "severities": ["media", "alta", "critica"], "min_level": 1.0, "min_s": 0.0},
    "D14": {"roles": ["cut_percentage"], "severities": ["media"], "min_cut": 0.01, "min_s": 0.1},
    "D15": {"roles": ["throttle_position", "lambda_measured", "lambda_target"], "severities": ["media"], "rate_per_s": 2.0, "window_s": 0.5, "rate_window_ms": 250, "max_rel": 0.06, "min_s": 0.0},
    "D16": {"roles": [], "severities": ["informativa"], "rpm": 500.0},
    "D17": {"roles": [], "severities": ["informativa"]},
    "D18": {"roles": [], "severities": ["informativa"], "factor": 3.0},
}
