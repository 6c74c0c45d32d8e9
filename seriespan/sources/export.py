"""Exports in which every log has the columns it has, with their units in headers and metadata.

Logs are grouped by layout: the names, units and classes of their channels in order. All layouts are
written by one job, however many there are: rows are dealt by layout, log and slice of rows, and a task
writes one file for each layout it has rows of. CSV carries the unit in the column's name; Parquet also
carries dimension, unit, class and reference of every column in the file's metadata.

A file's name holds the attempt that wrote it, and the table ``files`` lists those of tasks that
succeeded; a lost task's file is in the folder but not in the list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.parquet as papq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.units import POINT
from ..functions.units import convert_by_catalogue, unit_frame
from ..operators.lookup import measured
from ..session import settle
from . import stores

#: Rows of a log that one file holds at most.
FILE_ROWS = 1_000_000
UNIT_KEY = "seriespan:units"
CHANNELS = ("log_id", "channel_id", "name", "dimension", "unit", "cls", "reference_kpa", "reason")


def labelled(channels: DataFrame) -> DataFrame:
    """Channels with ``raw`` and ``label``: ``name [unit]``, with (rel) or (abs) where a pressure origin is defined."""
    raw = F.col("reason").isNotNull() | F.coalesce("dimension", F.lit("unknown")).isin("unknown")
    relative = F.col("reference_kpa").isNotNull() & (F.col("cls") == POINT)
    origin = F.when((F.col("dimension") == "pressure") & ~raw, F.when(relative, " (rel)").otherwise(" (abs)")).otherwise("")
    unit = F.when(raw, "raw").otherwise(F.col("unit"))
    return channels.select(*CHANNELS).withColumns({"raw": raw, "label": F.concat("name", F.lit(" ["), unit, origin, F.lit("]"))})


def layouts(channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``log_id, channel_id, layout, pos, ...`` of every channel, and ``layout, labels, units``.

    Columns stand in the order of their labels; equal labels of a log keep their channel's order.
    """
    shown = F.struct("label", "channel_id", "dimension", "unit", "cls", "reference_kpa", "reason", "raw")
    per_log = labelled(channels).groupBy("log_id").agg(F.sort_array(F.collect_list(shown)).alias("c"))
    facts = F.transform("c", lambda x: F.struct(x["label"], x["dimension"], x["unit"], x["cls"], x["reference_kpa"], x["reason"], x["raw"]))
    per_log = per_log.withColumn("units", F.to_json(facts)).withColumn("layout", F.substring(F.sha2("units", 256), 1, 16))
    each = per_log.select("log_id", "layout", F.posexplode("c").alias("pos", "x")).select("log_id", "layout", "pos", "x.*")
    tables = per_log.groupBy("layout").agg(F.first("units").alias("units"), F.first(F.transform("c", lambda x: x["label"])).alias("labels"))
    return each, tables


def shown_values(samples: DataFrame, each: DataFrame) -> DataFrame:
    """``layout, log_id, seq, t_ms, pos, x``: samples in the unit of their column."""
    found = samples.select("log_id", "channel_id", "seq", "t_ms", "v").join(measured(each), ["log_id", "channel_id"])
    offset = F.when((F.col("dimension") == "pressure") & (F.col("cls") == POINT), F.coalesce("reference_kpa", F.lit(0.0))).otherwise(0.0)
    found = found.withColumn("_c", F.col("v") - offset)
    found = convert_by_catalogue(found, unit_frame(samples.sparkSession), "_c", "dimension", "unit", "cls", "_x")
    return found.select("layout", "log_id", "seq", "t_ms", "pos", F.when(F.col("raw"), F.col("v")).otherwise(F.col("_x")).alias("x"))


def export_layouts(samples: DataFrame, channels: DataFrame, path: str, kind: str = "csv", file_rows: int = FILE_ROWS) -> DataFrame:
    """Write all logs below ``path/layout=<id>/`` and return ``files(layout, file, rows)``, also written to ``path/files``.

    ``channels(log_id, channel_id, name, dimension, unit, cls, reference_kpa, reason)``; a ``reason``
    keeps the values raw. Samples of channels that are not listed are left out.
    """
    if kind not in ("csv", "parquet"):
        raise ValueError(f"unknown kind {kind!r}")
    path = stores.qualified(samples.sparkSession, path)
    each, tables = layouts(channels)
    each, tables = settle(each), settle(tables)
    rows = shown_values(samples, each).repartition("log_id", "seq", "t_ms")
    one = rows.groupBy("log_id", "seq", "t_ms", "layout", "pos").agg(F.max("x").alias("x"))
    cells = one.groupBy("log_id", "seq", "t_ms", "layout").agg(F.map_from_entries(F.collect_list(F.struct("pos", "x"))).alias("m"))
    named = cells.join(measured(tables), "layout")
    dense = F.transform(F.sequence(F.lit(0), F.size("labels") - 1), lambda i: F.try_element_at("m", i))
    part: Column = F.floor(F.col("seq") / file_rows)
    ready = (
        named.select("layout", "labels", "units", F.col("log_id").cast("string").alias("log_id"), "seq", "t_ms", dense.alias("x"), part.alias("_part"))
        .repartition("layout", "log_id", "_part").sortWithinPartitions("layout", "log_id", "seq").drop("_part")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, done = None, None, []
        for batch in batches:
            layout = batch.column("layout").to_pylist()
            at = 0
            while at < len(layout):
                upto = at
                while upto < len(layout) and layout[upto] == layout[at]:
                    upto += 1
                if layout[at] != now:
                    if out is not None:
                        done.append(out.close())
                    now = layout[at]
                    out = _File(f"{path}/layout={now}", kind, batch.column("labels")[at].as_py(), batch.column("units")[at].as_py())
                out.add(batch.slice(at, upto - at))
                at = upto
        if out is not None:
            done.append(out.close())
        yield pa.RecordBatch.from_pylist(
            [{"layout": f.split("/layout=")[1].split("/")[0], "file": f, "rows": n} for f, n in done],
            pa.schema([("layout", pa.string()), ("file", pa.string()), ("rows", pa.int64())]),
        )

    files = ready.mapInArrow(run, "layout string, file string, rows long")
    files.write.mode("overwrite").parquet(f"{path}/files")
    return samples.sparkSession.read.schema("layout string, file string, rows long").parquet(f"{path}/files")


class _File:
    """One file of one layout, written batch by batch."""

    def __init__(self, folder: str, kind: str, labels: list[str], units: str):
        names, seen = ["log_id", "seq", "t_ms"], {"log_id", "seq", "t_ms"}
        for label in labels:  # a column's name must be its own
            name, k = label, 2
            while name in seen:
                name, k = f"{label}_{k}", k + 1
            seen.add(name)
            names.append(name)
        facts = dict(zip(names[3:], json.loads(units)))
        fields = [("log_id", pa.string()), ("seq", pa.int64()), ("t_ms", pa.int64()), *[(n, pa.float64()) for n in names[3:]]]
        self.schema = pa.schema(fields, {UNIT_KEY: json.dumps(facts, ensure_ascii=False)})
        self.path, self.rows = f"{folder}/part-{uuid.uuid4().hex}.{kind}", 0
        store, name = stores.locate(self.path)
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.sink = store.open_output_stream(name)
        self.writer = pacsv.CSVWriter(self.sink, self.schema) if kind == "csv" else papq.ParquetWriter(self.sink, self.schema)

    def add(self, batch: pa.RecordBatch) -> None:
        width = len(self.schema) - 3
        flat = batch.column("x").flatten()
        columns = [flat.take(pa.array(range(i, len(flat), width), pa.int64())) for i in range(width)]
        keys = [batch.column("log_id"), batch.column("seq").cast(pa.int64()), batch.column("t_ms").cast(pa.int64())]
        self.writer.write_batch(pa.RecordBatch.from_arrays([*keys, *columns], schema=self.schema))
        self.rows += batch.num_rows

    def close(self) -> tuple[str, int]:
        self.writer.close()
        self.sink.close()
        return self.path, self.rows
