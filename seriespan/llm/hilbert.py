"""Operator 6: shards along a Hilbert curve through quantised metadata.

Every dimension is quantised to ``bits`` bits, the cell's index along the Hilbert curve orders the
rows, and the order is cut into runs of equal row counts, one per shard. Neighbours on the curve are
neighbours in every dimension, so each shard covers a small box of the metadata space and a reader
with a predicate on any dimension skips most shards (``manifest``, ``prune``).

Defined results: a null in a dimension is quantised to 0; a null or empty text has size 1; equal
cells are ordered by the text's checksum, then by ``doc_id`` (nulls first), so copies lie together;
fully equal rows are interchangeable and each gets its own slot; an empty table gives no rows;
input columns are read by name and none is carried over, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

BITS = 6
SHARDS = 16


@dataclass(frozen=True)
class Numeric:
    """A numeric column cut at its quantiles, so that its cells hold about as many rows each."""

    column: str


@dataclass(frozen=True)
class Category:
    """A column whose values are dealt to cells by hash: equality predicates prune on it."""

    column: str


def category_code(value: Column, bits: int = BITS) -> Column:
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value.cast("string")), F.lit(1 << bits))).cast("int")


def numeric_code(value: Column, cuts: Sequence[float]) -> Column:
    """The number of cuts not above the value."""
    if not len(cuts):
        return F.lit(0)
    steps = F.array(*(F.lit(float(c)) for c in cuts))
    return F.when(value.isNull(), 0).otherwise(F.size(F.filter(steps, lambda c: c <= value.cast("double")))).cast("int")


def hilbert_index(codes: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of ``codes`` (rows x dimensions).

    Walks from the coarsest bit to the finest: at each level undo the reflection and the exchange of
    axes that the sub-cube's place on the curve implies, then read the axes' bits in Gray-code order.
    """
    x = [codes[:, d].astype(np.int64).copy() for d in range(codes.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(len(x)):
            high = (x[d] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    turn = np.zeros(len(codes), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x = [axis ^ turn for axis in x]
    index = np.zeros(len(codes), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            index = (index << 1) | ((axis >> level) & 1)
    return index


def quantised(rows: DataFrame, dimensions: Sequence[Numeric | Category], bits: int = BITS) -> list[Column]:
    """A code column ``_q0, _q1, ...`` per dimension; cut points come from all rows."""
    numbers = [d.column for d in dimensions if isinstance(d, Numeric)]
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = dict(zip(numbers, rows.approxQuantile(numbers, steps, 0.002), strict=True)) if numbers else {}
    return [
        (numeric_code(F.col(d.column), cuts[d.column]) if isinstance(d, Numeric) else category_code(F.col(d.column), bits)).alias(f"_q{i}")
        for i, d in enumerate(dimensions)
    ]


def hilbert_shards(
    docs: DataFrame, dimensions: Sequence[Numeric | Category], *, shards: int = SHARDS, bits: int = BITS,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``key, size, text_crc32, shard, slot, curve, _q0 ...`` for every row of ``docs``; see ``placed``."""
    used = docs.select(
        F.col(key).alias("_k"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"),
        *(F.col(d.column).alias(f"_d{i}") for i, d in enumerate(dimensions)),
    )
    held = [type(d)(f"_d{i}") for i, d in enumerate(dimensions)]
    rows = placed(settle(used), held, shards, bits)
    return rows.select(
        F.col("_k").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", "slot", "curve",
        *(f"_q{i}" for i in range(len(dimensions))),
    )


def sharded_rows(
    docs: DataFrame, dimensions: Sequence[Numeric | Category], *, shards: int = SHARDS, bits: int = BITS,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot``, which replace input columns of these names."""
    used = docs.select(
        F.struct("*").alias("_row"), F.col(key).alias("_k"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"),
        *(F.col(d.column).alias(f"_d{i}") for i, d in enumerate(dimensions)),
    )
    held = [type(d)(f"_d{i}") for i, d in enumerate(dimensions)]
    rows = placed(used, held, shards, bits)
    return rows.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")


def placed(used: DataFrame, dimensions: Sequence[Numeric | Category], shards: int, bits: int) -> DataFrame:
    """``used(_k, _crc, ...)`` with the codes, ``curve``, ``shard`` and ``slot``.

    Rows are dealt by range of (curve index, checksum, key), so a cell with a third of all rows is
    spread like any other. A row's rank is its place in its range plus the ranges before it; only the
    row count of each range reaches the driver. Shard ``s`` holds the ranks from ``ceil(s*n/shards)``
    on, so counts differ by one at most.
    """
    codes = [f"_q{i}" for i in range(len(dimensions))]
    coded = used.select("*", *quantised(used, dimensions, bits)).drop(*(d.column for d in dimensions))

    @F.pandas_udf("long")
    def index(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(hilbert_index(np.stack([p.to_numpy() for p in part], axis=1), bits))

    order = ["curve", "_crc", "_k"]
    spread = coded.withColumn("curve", index(*codes)).repartitionByRange(*order)
    ranged = settle(spread.withColumn("_range", F.spark_partition_id()))
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("_range").count().collect())
    total, before = sum(n for _, n in counts), 0
    offsets = []
    for at, n in counts:
        offsets.append((at, before))
        before += n
    starts = used.sparkSession.createDataFrame(offsets, "_range int, _before long")  # a row per range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = ranged.withColumn("_in", inside).join(F.broadcast(starts), "_range")
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_in") - 1)
    n = max(total, 1)
    ranked = ranked.withColumn("shard", F.expr(f"int(_rank * {shards}L div {n}L)"))
    return ranked.withColumn("slot", (F.col("_rank") - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}L")).cast("long"))


def manifest(sharded: DataFrame) -> DataFrame:
    """Rows, bytes and the box of codes each shard covers: a row per shard."""
    codes = [c for c in sharded.columns if c.startswith("_q")]
    return sharded.groupBy("shard").agg(
        F.count("*").alias("rows"),
        F.sum("size").alias("bytes"),
        *(F.min(c).alias(f"{c}_min") for c in codes),
        *(F.max(c).alias(f"{c}_max") for c in codes),
    )


def prune(boxes: DataFrame, wanted: dict[int, int]) -> DataFrame:
    """The shards that can hold rows whose dimension ``i`` has the code ``wanted[i]``."""
    for i, code in wanted.items():
        boxes = boxes.where(F.lit(code).between(F.col(f"_q{i}_min"), F.col(f"_q{i}_max")))
    return boxes.select("shard")
