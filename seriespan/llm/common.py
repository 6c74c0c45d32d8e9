"""Helpers shared by the operators: reading tables, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def read(spark, folder: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return df.select(*columns) if columns else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)``, the smallest node reachable.

    Alternates the large-star and small-star steps (every node hands the smallest node it knows to
    its neighbours), which converge in a few rounds, in proportion to the logarithm of the size. A
    round is written to the shared folder, so lineage stays short and lost executors cost one round.
    Per round a node's edges are combined map-side; no component is gathered anywhere. The nodes'
    minima are written before they are joined back, so that both sides of the join are plain exchanges
    and adaptive execution can split a node that holds a large share of all edges. Null ends and loops
    are ignored; an empty input gives no rows.
    """
    now = settle(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        ).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = settle(
            large.join(low, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        now = small
        if _stars(now):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one root and no root on another node: the components are found."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_node.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()
