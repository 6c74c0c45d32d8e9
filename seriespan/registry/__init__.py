"""Registered queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The samples view every oracle over the events table starts from.
SAMPLES = """
WITH s AS (
  SELECT user_id AS log_id, event_type AS channel_id, event_id AS seq,
         CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS t_ms, value AS v
  FROM events
)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``{S}`` in the SQL opens with the samples view."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.replace("{S}", SAMPLES)
        return fn

    return add


def load() -> None:
    """Import every module that registers queries."""
    from importlib import import_module

    for module in MODULES:
        import_module(f"{__name__}.{module}")


MODULES = [
    "conditions", "windows", "meshes", "rollups", "quality", "units", "phases", "catalogue", "logs", "cells",
    "detectors", "analyses", "ingest", "files",
]
