"""Values of a key attached to rows of which one key may hold any share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: A key counts as hot above this share of all rows, so there are at most ``1 / HOT_SHARE`` of them.
HOT_SHARE = 1e-4
#: Below so many rows a key is never hot: one task takes them easily.
HOT_ROWS = 20_000


def attach(rows: DataFrame, groups: DataFrame, key: str, *, count: str, total: int, spread: Column) -> DataFrame:
    """Left-join one row per key onto rows of which one key may hold any share.

    ``groups`` has ``key``, the key's row ``count`` and the values to attach. Keys above
    ``HOT_SHARE`` of ``total`` (at most ``1 / HOT_SHARE`` keys, so the broadcast is bounded) are
    looked up by broadcast. The others meet in a shuffled join, in which the rows already served
    and those without a key carry one of their own made from ``spread`` (not null) and so are dealt
    evenly. Where rows can be had twice at little cost, ``attach_apart`` spares the served ones the shuffle.
    """
    values = [c for c in groups.columns if c not in (key, count)]
    hot, cold = _by_heat(groups, key, count, total, values)
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left").drop("_hk")
    out = out.withColumn(
        "_ck",
        F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(
            F.concat(F.lit("s"), spread.cast("string"))
        ),
    )
    out = out.join(cold, "_ck", "left").drop("_ck")
    found = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *(found[v].alias(v) for v in values))


def attach_apart(rows: DataFrame, groups: DataFrame, key: str, *, count: str, total: int) -> DataFrame:
    """As ``attach``; only rows whose key is not hot are shuffled, for which ``rows`` is computed twice.

    Equal rows must come out of both computations: whether a row is served depends on its key alone.
    """
    values = [c for c in groups.columns if c not in (key, count)]
    hot, cold = _by_heat(groups, key, count, total, values)
    at = F.concat(F.lit("k"), F.col(key).cast("string"))
    seen = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left").drop("_hk")
    served = seen.where(F.col("_hot").isNotNull() | F.col(key).isNull())
    others = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.select("_hk")), F.col(key) == F.col("_hk"), "left_anti")
    met = others.withColumn("_ck", at).join(cold, "_ck", "left").drop("_ck")
    parts = [served.select(*rows.columns, *(F.col("_hot")[v].alias(v) for v in values)), met.select(*rows.columns, *(F.col("_cold")[v].alias(v) for v in values))]
    return parts[0].unionByName(parts[1])


def _by_heat(groups: DataFrame, key: str, count: str, total: int, values: list[str]) -> tuple[DataFrame, DataFrame]:
    limit = max(total * HOT_SHARE, HOT_ROWS)
    hot = groups.where(F.col(count) > limit).select(F.col(key).alias("_hk"), F.struct(*values).alias("_hot"))
    cold = groups.where(F.col(count) <= limit).select(
        F.concat(F.lit("k"), F.col(key).cast("string")).alias("_ck"), F.struct(*values).alias("_cold")
    )
    return hot, cold


#: A table up to this size is given to every task.
SMALL_ROWS = 200_000
SMALL_BYTES = 32 << 20


def measured(table: DataFrame) -> DataFrame:
    """The table settled, marked for broadcast if its rows and the bytes of its values are few."""
    table = settle(table)
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in table.columns), F.lit(0))
    size = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return F.broadcast(table) if size["n"] <= SMALL_ROWS and size["b"] <= SMALL_BYTES else table
