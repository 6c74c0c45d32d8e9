"""Scan of the native log format: ``key : value`` header, then clocked rows.

Works on numbered lines of many files at once. A file that cannot be read becomes a
row with an error status; the others go on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog.units import INT32_SENTINELS
from ..functions.clock import row_clock_seconds
from ..session import settle
from .lines import field_count, split_fields

# Raw types of the format as (type, dimension, factor, confidence).
TYPES: list[tuple[str, str, float, str]] = [
    ("EngineSpeed", "angular_speed", 1.0, "confirmed"),
    ("Percentage", "ratio", 0.001, "confirmed"),
    ("Angle", "angle", 0.1, "confirmed"),
    ("Speed", "speed", 0.1, "confirmed"),
    ("Pressure", "pressure", 0.1, "confirmed"),
    ("AbsPressure", "pressure", 0.1, "confirmed"),
    ("Temperature", "temperature", 0.1, "confirmed"),
    ("BatteryVoltage", "voltage", 0.001, "confirmed"),
    ("AFR", "mixture_ratio", 0.001, "confirmed"),
    ("Stoichiometry", "ratio", 0.001, "confirmed"),
    ("Density", "density", 0.1, "confirmed"),
    ("Decibel", "sound_level", 0.01, "confirmed"),
    ("Time_us", "time", 0.000001, "confirmed"),
    ("Frequency", "frequency", 1.0, "confirmed"),
    ("ByteCount", "count", 1.0, "confirmed"),
    ("Raw", "unknown", 1.0, "confirmed"),
    ("MassOverTime", "mass_flow", 0.036, "confirmed"),
    ("AngularVelocity", "angular_speed", 16.666666666666668, "confirmed"),
    ("Time_ms_as_s", "time", 0.001, "inferred"),
    ("Time_s", "time", 1.0, "inferred"),
    ("Time_ms", "time", 0.001, "inferred"),
    ("Resistance", "resistance", 1.0, "inferred"),
    ("Flow", "volume_flow", 0.06, "confirmed"),
    ("InjFuelVolume", "volume", 0.00000001, "confirmed"),
    ("EngineVolume", "volume", 0.001, "inferred"),
    ("MassPerCyl", "mass_per_cyl", 1.0, "confirmed"),
    ("ShortDistance", "distance", 0.1, "inferred"),
    ("FuelEcomony", "fuel_economy", 0.01, "inferred"),
    ("Mileage", "fuel_economy", 1.0, "inferred"),
    ("FuelVolume", "unknown", 1.0, "unknown"),
    ("PulsesPerLongDistance", "unknown", 1.0, "unknown"),
    ("PercentPerRpm", "pct_per_rpm", 1.0, "unknown"),
    ("PercentPerKPa", "pct_per_kPa", 1.0, "unknown"),
    ("PercentPerLambda", "pct_per_lambda", 1.0, "unknown"),
]

#: Rows of a slice of the clock; a row looks through its slice's midnights.
SLICE_ROWS = 8192


@dataclass(frozen=True)
class NativeFormat:
    """Descriptor of a native format; the defaults are fixed values."""

    name: str = "nsp"
    signature: str = "%DataLog%"
    versions: tuple[str, ...] = ("1.1",)
    version_key: str = "DataLogVersion"
    channel_key: str = "Channel"
    id_key: str = "ID"
    type_key: str = "Type"
    range_key: str = "DisplayMaxMin"
    separator: str = ":"
    delimiter: str = ","
    row_pattern: str = r"^\d\d:\d\d:\d\d\.\d\d\d"
    started_key: str = "Log"
    downloaded_key: str = "DownloadDateTime"
    number_key: str = "Log Number"
    types: list[tuple[str, str, float, str]] = field(default_factory=lambda: TYPES)


def detect_format(lines: DataFrame, formats: list[NativeFormat]) -> DataFrame:
    """``(file, format)``: the first descriptor whose signature opens the file."""
    known = F.lit("generic")
    for f in reversed(formats):
        known = F.when(F.col("text").startswith(f.signature), f.name).otherwise(known)
    return lines.filter("line = 0").select("file", known.alias("format"))


def triage_paths(listing: DataFrame, formats: DataFrame, own: str | None = None) -> DataFrame:
    """Kind of every listed path: native, generic, or a notice why it is neither.

    ``own`` is the extension of the caller's own project files, which are not logs. Paths are
    those that lines carry. See ``listing.notices`` for given paths that are missing or hold no file.
    """
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = (
        F.when(F.col("format").isNotNull() & (F.col("format") != "generic"), "native")
        .when(F.lit(False) if own is None else ext == own, "own_format")
        .when(F.col("size") == 0, "empty")
        .when(ext == ".csv", "generic")
        .otherwise("unrecognised")
    )
    return listing.dropDuplicates(["path"]).join(
        formats.withColumnRenamed("file", "path"), "path", "left"
    ).select("path", "size", kind.alias("kind"))


def scan_marks(lines: DataFrame, fmt: NativeFormat = NativeFormat()) -> DataFrame:
    """Everything but the cells, in one pass over the text: ``(file, line, clock_s, is_row, head, signed)``.

    Rows keep their clock only, other lines that can be header pairs their text; the rest
    is dropped. The result is settled: a few bytes a row, whatever the rows' length.
    """
    is_row = F.col("text").rlike(fmt.row_pattern)
    signed = (F.col("line") == 0) & F.col("text").startswith(fmt.signature)
    pair = ~is_row & F.col("text").contains(fmt.separator)
    marks = lines.select(
        "file", "line", F.when(is_row, row_clock_seconds(F.substring_index("text", fmt.delimiter, 1))).alias("clock_s"),
        is_row.alias("is_row"), F.when(pair, F.col("text")).alias("head"), signed.alias("signed"),
    )
    return settle(marks.filter((F.col("line") == 0) | F.col("is_row") | F.col("head").isNotNull()))


def path_notices(requested: DataFrame, listing: DataFrame, lines: DataFrame) -> DataFrame:
    """``(path, notice)`` of requested paths that give nothing: missing, empty or unreadable.

    ``listing`` has size 0 for an empty file where its source lists it.
    """
    asked = requested.select("path").distinct()
    found = asked.join(listing.groupBy("path").agg(F.max("size").alias("_size")), "path", "left")
    found = found.join(lines.select(F.col("file").alias("path"), F.lit(True).alias("_read")).distinct(), "path", "left")
    notice = (
        F.when(F.col("_read"), None).when(F.col("_size").isNull(), "missing").when(F.col("_size") == 0, "empty").otherwise("unreadable")
    )
    return found.withColumn("notice", notice).filter("notice IS NOT NULL").select("path", "notice")


def _starts(marks: DataFrame) -> DataFrame:
    return marks.groupBy("file").agg(
        F.min(F.when(F.col("is_row"), F.col("line"))).alias("first_row"), F.max("signed").alias("signed")
    )


def _header(marks: DataFrame, starts: DataFrame, fmt: NativeFormat) -> DataFrame:
    """Header pairs of signed files with the channel block each belongs to (0 = metadata)."""
    key = F.trim(F.substring_index("head", fmt.separator, 1))
    value = F.trim(F.expr(f"substring(head, instr(head, '{fmt.separator}') + 1)"))
    head = (
        marks.filter(F.col("head").isNotNull()).select("file", "line", "head")
        .join(starts.filter("signed").select("file", "first_row"), "file")
        .filter(F.col("first_row").isNull() | (F.col("line") < F.col("first_row")))
        .select("file", "line", key.alias("key"), value.alias("value"))
    )
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("key") == fmt.channel_key
    in_block = F.col("key").isin(fmt.id_key, fmt.type_key, fmt.range_key)
    is_open = F.last(F.when(opens, True).when(~in_block, False), ignorenulls=True).over(w)
    number = F.sum(opens.cast("int")).over(w)
    return head.withColumn("block", F.when(F.coalesce(is_open, F.lit(False)), number).otherwise(0))


def read_header(
    lines: DataFrame, fmt: NativeFormat = NativeFormat(), marks: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(files, channels, metadata)`` of native files.

    ``files(file, status, first_row, version)``: status is ok or the first error.
    ``channels(file, pos, name, native_id, type, disp_min, disp_max, dim, factor,
    confidence)``. ``metadata(file, key, value)``, last value of each key. Headers
    are a few thousand lines per file; rows are never part of these windows, nor are
    files without the signature.
    """
    marks = scan_marks(lines, fmt) if marks is None else marks
    starts = _starts(marks)
    head = settle(_header(marks, starts, fmt))
    part = lambda k: F.max_by("value", F.when(F.col("key") == k, F.col("line")))
    blocks = (
        head.filter("block > 0")
        .groupBy("file", "block")
        .agg(
            F.min("line").alias("line"), part(fmt.channel_key).alias("name"), part(fmt.id_key).alias("_id"),
            part(fmt.type_key).alias("type"), part(fmt.range_key).alias("_range"),
        )
    )
    spark = lines.sparkSession
    types = spark.createDataFrame(fmt.types, "type string, dim string, factor double, confidence string")
    two = F.split("_range", ",")
    ok_range = F.size(two) == 2
    hi, lo = F.get(two, F.lit(0)).try_cast("int"), F.get(two, F.lit(1)).try_cast("int")
    channels = blocks.join(F.broadcast(types), "type", "left")
    channels = channels.select(
        "file", (F.col("block") - 1).cast("int").alias("pos"), "line", "name", F.col("_id").try_cast("int").alias("native_id"),
        "type", F.when(ok_range & hi.isNotNull(), lo).alias("disp_min"), F.when(ok_range & lo.isNotNull(), hi).alias("disp_max"),
        F.coalesce("dim", F.lit("unknown")).alias("dim"),
        F.when(F.coalesce("confidence", F.lit("unknown")) != "unknown", F.col("factor")).otherwise(1.0).alias("factor"),
        F.coalesce("confidence", F.lit("unknown")).alias("confidence"),
        F.col("dim").isNull().alias("unknown_type"),
        (F.col("_range").isNotNull() & ~F.coalesce(ok_range & hi.isNotNull() & lo.isNotNull(), F.lit(False))).alias("bad_range"),
        (F.col("_id").isNull() | F.col("type").isNull()).alias("incomplete"),
        (F.col("_id").isNotNull() & F.col("_id").try_cast("int").isNull()).alias("bad_id"),
    )
    metadata = head.filter("block = 0").groupBy("file", "key").agg(F.max_by("value", "line").alias("value"))
    version = metadata.filter(F.col("key") == fmt.version_key).select("file", F.col("value").alias("version"))
    per_file = channels.groupBy("file").agg(
        F.count(F.lit(1)).alias("channels"), F.max("incomplete").alias("_inc"), F.max("bad_id").alias("_bad")
    )
    files = starts.join(per_file, "file", "left").join(version, "file", "left")
    status = (
        F.when(~F.coalesce("signed", F.lit(False)), "not_native")
        .when(F.coalesce("_inc", F.lit(False)), "incomplete_channel")
        .when(F.coalesce("_bad", F.lit(False)), "bad_channel_id")
        .when(F.col("version").isNull(), "no_version")
        .when(~F.col("version").isin(list(fmt.versions)), "unsupported_version")
        .when(F.col("channels").isNull(), "no_channels")
        .when(F.col("first_row").isNull(), "no_rows")
        .otherwise("ok")
    )
    files = files.select("file", status.alias("status"), "first_row", "version", F.coalesce("channels", F.lit(0)).alias("channels"))
    return settle(files), settle(channels), metadata


def header_notices(channels: DataFrame) -> DataFrame:
    """Unknown types, unconfirmed scales, bad ranges, repeated names and ids."""
    flags = channels.select(
        "file", "line",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("unknown_type"), "unknown_type"),
                    F.when(~F.col("unknown_type") & (F.col("confidence") == "unknown"), "unconfirmed_scale"),
                    F.when(F.col("bad_range"), "invalid_display_range"),
                )
            )
        ).alias("code"),
    )
    names = Window.partitionBy("file", "name").orderBy("pos")
    ids = Window.partitionBy("file", "native_id").orderBy("pos")
    repeats = channels.withColumns({"_n": F.row_number().over(names), "_i": F.row_number().over(ids)}).select(
        "file", "line",
        F.explode(
            F.array_compact(F.array(F.when(F.col("_n") > 1, "duplicate_name"), F.when(F.col("_i") > 1, "duplicate_id")))
        ).alias("code"),
    )
    return flags.unionByName(repeats)


def read_rows(lines: DataFrame, files: DataFrame, fmt: NativeFormat = NativeFormat()) -> DataFrame:
    """Body rows of readable files: ``(file, bytes, seq, clock_s, text, fields, expected)``.

    The text stays whole: it is several times smaller to shuffle than its fields.
    """
    good = files.filter("status = 'ok'").select("file", "first_row", "channels")
    return (
        lines.join(good, "file")
        .filter(F.col("line") >= F.col("first_row"))
        .select(
            "file", "bytes", (F.col("line") - F.col("first_row")).alias("seq"),
            row_clock_seconds(F.substring_index("text", fmt.delimiter, 1)).alias("clock_s"), "text",
            field_count(F.col("text"), F.lit(fmt.delimiter)).alias("fields"), (F.col("channels") + 1).alias("expected"),
        )
    )


def clocks_of(marks: DataFrame, files: DataFrame) -> DataFrame:
    """``(file, seq, clock_s)`` of the rows of readable files, without reading the text again."""
    good = files.filter("status = 'ok'").select("file", "first_row")
    rows = marks.filter(F.col("is_row")).select("file", "line", "clock_s").join(good, "file")
    return rows.select("file", (F.col("line") - F.col("first_row")).alias("seq"), "clock_s")


def malformed_rows(rows: DataFrame, detailed: int | None = None) -> DataFrame:
    """Rows with a wrong field count; with ``detailed``, the first ones and a total of the rest."""
    bad = rows.filter(F.col("fields") != F.col("expected"))
    if detailed is None:
        return bad.select("file", F.col("seq").alias("row"), "fields", "expected", F.lit(1).cast("bigint").alias("rows"))
    w = Window.partitionBy("file").orderBy("seq")
    detail = (
        bad.withColumn("_k", F.row_number().over(w))
        .filter(F.col("_k") <= detailed)
        .select("file", F.col("seq").alias("row"), "fields", "expected", F.lit(1).cast("bigint").alias("rows"))
    )
    rest = (
        bad.groupBy("file")
        .agg((F.count(F.lit(1)) - detailed).alias("rows"), F.max("expected").alias("expected"))
        .filter("rows > 0")
        .select("file", F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("int").alias("fields"), "expected", "rows")
    )
    return detail.unionByName(rest)


def timeline(clocks: DataFrame, rows_per_slice: int = SLICE_ROWS) -> DataFrame:
    """``(file, slice, t0_s, days, wraps)``: how to turn a row's clock into its log time.

    A file is cut into slices of equal row counts, so none passes through one task. ``days``
    midnights lie before the slice and one at each row of ``wraps`` in it; ``t0_s`` is the
    log's first clock. A drop of more than twelve hours is a midnight.
    """
    cut = clocks.withColumn("slice", F.floor(F.col("seq") / rows_per_slice))
    inside = Window.partitionBy("file", "slice").orderBy("seq")
    wrapped = lambda step: F.coalesce(step < -43200, F.lit(False))
    cut = cut.withColumn("_wrap", wrapped(F.col("clock_s") - F.lag("clock_s").over(inside)))
    edge = F.struct(F.col("clock_s").alias("x"))
    slices = cut.groupBy("file", "slice").agg(
        F.min_by(edge, "seq").alias("_a"), F.max_by(edge, "seq").alias("_z"),
        F.sort_array(F.collect_list(F.when(F.col("_wrap"), F.col("seq")))).alias("wraps"),
    )
    order = Window.partitionBy("file").orderBy("slice")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = wrapped(F.col("_a.x") - F.lag("_z").over(order)["x"]).cast("bigint")
    slices = slices.withColumn("_edge", at_edge)
    before = F.coalesce(F.sum(F.size("wraps")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return slices.select(
        "file", "slice", F.first("_a").over(upto)["x"].alias("t0_s"), (before + F.sum("_edge").over(upto)).alias("days"), "wraps"
    )


def read_samples(
    rows: DataFrame,
    channels: DataFrame,
    *,
    clocks: DataFrame | None = None,
    rows_per_slice: int = SLICE_ROWS,
    keep_sentinels: bool = False,
    delimiter: str = ",",
) -> DataFrame:
    """Long samples ``(log_id, pos, channel_id, seq, t_ms, raw, v)`` of native rows.

    The row clock is unwrapped over midnight in file order and rebased to the log's
    first row; empty cells are not samples and the overflow codes become NULL. Only the
    ``clocks`` (see ``clocks_of``) are ordered; a row gets its slice's line of the settled
    ``timeline`` and is read in place, in one pass over the text.
    """
    clocks = rows.select("file", "seq", "clock_s") if clocks is None else clocks
    times = settle(timeline(clocks, rows_per_slice))
    per_file = settle(channels.groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col("native_id").cast("string").alias("id"), "factor"))).alias("info")
    ))
    days = F.col("days") + F.size(F.filter("wraps", lambda w: w <= F.col("seq")))
    t_ms = F.floor(F.round((F.col("clock_s") + days * 86400 - F.col("t0_s")) * 1000, 3)).cast("bigint")
    cells = (
        rows.select("file", "seq", "clock_s", "text")
        .withColumn("slice", F.floor(F.col("seq") / rows_per_slice))
        .join(times, ["file", "slice"])
        .join(per_file, "file")
        .select("file", "seq", t_ms.alias("t_ms"), "info", F.posexplode(split_fields(F.col("text"), F.lit(delimiter))).alias("_at", "cell"))
        .withColumn("pos", F.col("_at") - 1)
        .filter(F.col("pos").between(0, F.size("info") - 1) & (F.trim("cell") != ""))
        .withColumn("raw", F.trim("cell").try_cast("int"))  # a failing cast is dear: empty cells are gone
        .filter(F.col("raw").isNotNull())
    )
    raw = F.col("raw") if keep_sentinels else drop_sentinels(F.col("raw"))
    return cells.select(
        F.col("file").alias("log_id"), "pos", F.get("info", F.col("pos"))["id"].alias("channel_id"),
        "seq", "t_ms", raw.alias("raw"), (raw * F.get("info", F.col("pos"))["factor"]).alias("v"),
    )


def drop_sentinels(raw):
    """Overflow codes to NULL."""
    return F.when(~raw.isin(INT32_SENTINELS), raw)


def log_clocks(metadata: DataFrame, clocks: DataFrame, fmt: NativeFormat = NativeFormat()) -> DataFrame:
    """The header stamps and first clock per file, ready for ``clock.reconcile``."""
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    stamps = metadata.groupBy("file").agg(
        pick(fmt.started_key).alias("started"), pick(fmt.downloaded_key).alias("downloaded"), pick(fmt.number_key).alias("log_number")
    )
    first = clocks.groupBy("file").agg(F.min_by("clock_s", "seq").alias("first_row_s"))
    return first.join(stamps, "file", "left")
