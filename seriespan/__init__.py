"""Spark-native analytics over large collections of multi-rate telemetry logs."""
