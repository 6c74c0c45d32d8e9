"""Incremental index of a folder of logs: reuse, compute, discard, merge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINGERPRINT = ["path", "size", "mtime", "parser_version", "format_version"]


def same_fingerprint(a: Column, b: Column, columns: Sequence[str] = FINGERPRINT) -> Column:
    """Every key field of two fingerprint structs equal, NULL included."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def plan(listing: DataFrame, index: DataFrame, parser_version: str, format_version: str) -> DataFrame:
    """One row per path with its action: reuse, compute or discard.

    ``listing(path, size, mtime)``, ``index(path, size, mtime, parser_version,
    format_version, ...)``. One full join on the path decides all three.
    """
    versions = [F.lit(parser_version).alias("parser_version"), F.lit(format_version).alias("format_version")]
    now = listing.select("path", F.struct("path", "size", "mtime", *versions).alias("_now"))
    old = index.select("path", F.struct(*FINGERPRINT).alias("_old"))
    both = now.join(old, "path", "full_outer")
    reuse = F.col("_old").isNotNull() & same_fingerprint(F.col("_now"), F.col("_old"))
    action = F.when(F.col("_now").isNull(), "discard").when(reuse, "reuse").otherwise("compute")
    return both.select("path", action.alias("action"), F.col("_now.size").alias("size"), F.col("_now.mtime").alias("mtime"))


def merge(
    planned: DataFrame, index: DataFrame, computed: DataFrame, parser_version: str, format_version: str
) -> DataFrame:
    """New index: stored rows to reuse plus computed rows that were asked for.

    ``computed(path, status, summary...)``: files that failed carry an error status.
    """
    summary = [c for c in index.columns if c not in FINGERPRINT]
    reuse = index.join(planned.filter("action = 'reuse'").select("path"), "path", "left_semi")
    asked = planned.filter("action = 'compute'").select("path", "size", "mtime")
    fresh = asked.join(computed, "path").select(
        "path", "size", "mtime",
        F.lit(parser_version).alias("parser_version"), F.lit(format_version).alias("format_version"),
        *summary,
    )
    return reuse.select(*FINGERPRINT, *summary).unionByName(fresh).orderBy("path")


def candidates(listing: DataFrame, extensions: Sequence[str] = (".csv", ".txt", ".log")) -> DataFrame:
    """Mark each path with its extension and why it is left out, if it is."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return listing.withColumn("extension", ext).withColumn(
        "discard_reason",
        F.when(F.col("extension").isin([e.lower() for e in extensions]), None)
        .when(F.col("extension") == "", "no_extension")
        .otherwise("unsupported_extension"),
    )
