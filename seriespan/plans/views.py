"""Canonical frames built from the driver tables.

``events`` is a multi-log sample store: the user is the log, the event type the
channel, ``ts`` the clock and ``value`` the reading; ``event_id`` is the file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """``samples(log_id, channel_id, seq, t_ms, v)`` over the events table."""
    e = table(spark, folder, "events")
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{EPOCH}', ts)")
    return e.select(
        F.col("user_id").alias("log_id"),
        F.col("event_type").alias("channel_id"),
        F.col("event_id").alias("seq"),
        F.floor(micros / 1000).alias("t_ms"),
        finite(F.col("value")).alias("v"),
    )


def finite(column):
    """NaN and infinities are missing values everywhere in this package."""
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """Integer payload ``props.k`` of each event as a counter / bit-mask channel."""
    e = table(spark, folder, "events")
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{EPOCH}', ts)")
    return e.select(
        F.col("user_id").alias("log_id"),
        F.col("event_type").alias("channel_id"),
        F.col("event_id").alias("seq"),
        F.floor(micros / 1000).alias("t_ms"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
    )
