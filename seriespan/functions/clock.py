"""Row clocks, header stamps and the reconciliation of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_S = 86400

PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Fixed values.
ROW_CLOCK = r"^\d{1,2}:\d{2}:\d{2}([.,]\d+)?$"
FACTORY_DATES = ["19800101", "19700101", "20000101", "20010101"]
EARLIEST_DATE = "2005-01-01"
TOLERANCE_S = 60.0
AMBIGUITY_S = 43200


def to_number(text: Column) -> Column:
    """Plain decimal text to a double; the pattern spares failing casts, which are dear."""
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def row_clock_seconds(text: Column) -> Column:
    """``HH:MM:SS[.fraction]`` to seconds of the day; NULL where it is not one."""
    t = F.trim(text)
    hours = F.substring_index(t, ":", 1).try_cast("int")
    minutes = F.substring_index(F.substring_index(t, ":", 2), ":", -1).try_cast("int")
    seconds = F.replace(F.substring_index(t, ":", -1), F.lit(","), F.lit(".")).try_cast("double")
    fine = t.rlike(ROW_CLOCK) & (hours < 24) & (minutes < 60) & (seconds < 60)
    return F.when(fine, hours * 3600 + minutes * 60 + seconds)


def header_stamp(text: Column) -> Column:
    """``YYYYMMDD HH:MM:SS`` to a timestamp, NULL where malformed."""
    return F.try_to_timestamp(F.trim(text), F.lit("yyyyMMdd HH:mm:ss"))


def iso_instant(text: Column) -> Column:
    """ISO-8601 to epoch seconds; no zone means UTC, beyond 6 digits are cut."""
    t = F.regexp_replace(F.trim(text), r"([.,]\d{6})\d+", "$1")
    t = F.regexp_replace(F.regexp_replace(t, ",", "."), r"^(\S{10})T", "$1 ")
    return F.unix_micros(t.try_cast("timestamp")) / 1e6


def instant_seconds(text: Column, cls: Column, factor: Column, decimal: str = ".") -> Column:
    """Instant of a cell under the time class of its column, in seconds."""
    number = F.trim(text) if decimal == "." else F.replace(F.trim(text), F.lit(decimal), F.lit("."))
    return (
        F.when(cls == "iso8601", iso_instant(text))
        .when(cls == "clock", row_clock_seconds(text))
        .otherwise(to_number(number) * factor)
    )


def reconcile(
    logs: DataFrame,
    *,
    started: str = "started",
    downloaded: str = "downloaded",
    number: str = "log_number",
    first_row_s: str = "first_row_s",
    twelve_hours: bool = True,
    tolerance_s: float = TOLERANCE_S,
) -> DataFrame:
    """Header stamp against the first row's clock, one row per log.

    The header hour may be off by 12 h and may predate midnight: of the four
    readings the one with the smallest residual counts, if within the tolerance.
    """
    stamp = header_stamp(F.col(started))
    work = logs.withColumns({"_stamp": stamp, "_dl": header_stamp(F.col(downloaded))})
    midnight = F.date_trunc("day", "_stamp")
    sod = (F.unix_micros("_stamp") - F.unix_micros(midnight)) / 1e6
    hours = [sod, F.pmod(sod + AMBIGUITY_S, F.lit(float(DAY_S)))] if twelve_hours else [sod]
    first = F.col(first_row_s)
    readings = []
    for rank, (hour, day) in enumerate((h, d) for h in hours for d in (0, 1)):
        residual = hour - (first + F.lit(float(day * DAY_S)))
        readings.append(
            F.struct(F.abs(residual).alias("size"), F.lit(rank).alias("rank"), F.lit(day).alias("day"), residual.alias("residual"))
        )
    factory = F.date_format("_stamp", "yyyyMMdd").isin(FACTORY_DATES) | (F.col("_stamp") < F.lit(EARLIEST_DATE).cast("timestamp"))
    work = work.withColumns(
        {
            "_best": F.when(F.col("_stamp").isNotNull() & first.isNotNull(), F.array_min(F.array(*readings))),
            "_factory": F.coalesce(factory, F.lit(False)),
            "_midnight": midnight,
        }
    )
    fits = F.col("_best.size") <= tolerance_s
    status = (
        F.when(F.col("_stamp").isNull() | F.col("_factory") | first.isNull(), "unknown")
        .when(fits, "reliable")
        .otherwise("unreliable")
    )
    t0 = F.timestamp_micros(
        F.unix_micros("_midnight")
        + (F.col("_best.day").cast("bigint") * DAY_S * 1000000)
        + F.round(first * 1e6).cast("bigint")
    )
    missing = F.col(started).isNull() | (F.trim(F.col(started)) == "")
    has_number = F.col(number).try_cast("int").isNotNull()
    reliable = F.col("reliability") == "reliable"
    notices = F.array_compact(
        F.array(
            F.when(missing, "clock_without_metadata"),
            F.when(~missing & F.col("_stamp").isNull(), "clock_metadata_unreadable"),
            F.when(F.col("_factory"), "factory_epoch"),
            F.when(F.col("_stamp").isNotNull() & ~F.col("_factory") & first.isNull(), "clock_without_first_row"),
            F.when(F.col("reliability") == "unreliable", "clock_not_reliable"),
            F.when(reliable & (F.col("_best.day") == 1), "header_before_midnight"),
            F.when(reliable & (F.to_date("_dl") < F.to_date("_stamp")), "download_before_log"),
            F.when((F.col("reliability") == "unknown") & ~has_number, "clock_without_order"),
        )
    )
    return (
        work.withColumn("reliability", status)
        .select(
            *logs.columns,
            "reliability",
            F.when(reliable, t0).alias("t0"),
            F.when(~F.col("_factory"), F.col("_best.residual")).alias("residual_s"),
            F.when(reliable, "clock").when(has_number, "log_number").otherwise("none").alias("order_by"),
            F.when(reliable, "absolute_clock").otherwise("relative").alias("offset_mode"),
            notices.alias("notices"),
        )
    )
