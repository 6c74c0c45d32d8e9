"""Two-dimensional binned statistics on explicit edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_edges(edges: Sequence[float]) -> list[float]:
    e = [float(x) for x in edges]
    if len(e) < 2 or any(b <= a for a, b in zip(e, e[1:])):
        raise ValueError("edges must be at least two strictly increasing numbers")
    return e


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """0-based bin; interior edges belong to the bin above, the last edge is closed."""
    e = check_edges(edges)
    inner = F.lit(0)
    for edge in e[1:-1]:
        inner = inner + (x >= F.lit(edge)).cast("int")
    return F.when((x >= F.lit(e[0])) & (x <= F.lit(e[-1])), inner)


def default_edges(df: DataFrame, value: Column, bins: int) -> list[float]:
    """Equal steps between the extremes of the valid values (one aggregate row)."""
    row = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if row.lo is None or not row.hi > row.lo:
        raise ValueError("no edges can be derived from an empty or constant channel")
    step = (row.hi - row.lo) / bins
    return [row.lo + step * i for i in range(bins)] + [row.hi]


def edge_table(df: DataFrame, keys: list[str], value: Column, bins: int) -> DataFrame:
    """``default_edges`` per key as an array column; NULL for a degenerate range."""
    lo, hi = F.col("_lo"), F.col("_hi")
    steps = F.transform(
        F.sequence(F.lit(0), F.lit(bins)),
        lambda i: F.when(i == bins, hi).otherwise(lo + (hi - lo) / F.lit(float(bins)) * i),
    )
    return (
        df.groupBy(*keys)
        .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        .select(*keys, F.when(hi > lo, steps).alias("edges"))
    )


def mesh(
    df: DataFrame,
    keys: list[str],
    x: Column,
    y: Column,
    value: Column,
    x_edges: Sequence[float],
    y_edges: Sequence[float],
) -> DataFrame:
    """Count, mean, population sd, min and max of the occupied cells."""
    return (
        df.select(*keys, bin_index(x, x_edges).alias("i"), bin_index(y, y_edges).alias("j"), value.alias("_v"))
        .filter(F.col("i").isNotNull() & F.col("j").isNotNull() & F.col("_v").isNotNull())
        .groupBy(*keys, "i", "j")
        .agg(
            F.count("_v").alias("n"),
            F.avg("_v").alias("mean"),
            F.stddev_pop("_v").alias("sd"),
            F.min("_v").alias("lo"),
            F.max("_v").alias("hi"),
        )
    )


def dense(cells: DataFrame, keys: list[str], nx: int, ny: int) -> DataFrame:
    """All ``nx * ny`` cells per key present in ``cells``; empty ones count 0."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))).alias("_c")
    owners = cells.select(*keys).distinct() if keys else cells.sparkSession.range(1).select()
    full = owners.select(*keys, grid).select(
        *keys, F.floor(F.col("_c") / ny).cast("int").alias("i"), (F.col("_c") % ny).alias("j")
    )
    return full.join(cells, [*keys, "i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def comparable_edges(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, comparable, reason)``: meshes whose edges differ must not be compared cell by cell.

    Both sides are ``edge_table`` rows ``(keys, edges)``; a mesh that only one side has is
    not comparable either.
    """
    b = before.select(*keys, F.col("edges").alias("_b"))
    both = b.join(after.select(*keys, F.col("edges").alias("_a")), keys, "full_outer")
    reason = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "missing").when(F.col("_a") != F.col("_b"), "different_edges")
    return both.select(*keys, reason.isNull().alias("comparable"), reason.alias("reason"))


def compare(before: DataFrame, after: DataFrame, keys: list[str], edges: DataFrame | None = None) -> DataFrame:
    """Cell by cell ``before - after``; the count is the smaller of the two.

    With ``edges`` (see ``comparable_edges``), only meshes of equal edges are compared.
    """
    if edges is not None:
        before = before.join(edges.filter("comparable").select(*keys), keys, "left_semi")
    stats = ["mean", "sd", "lo", "hi"]
    b = before.select(*keys, "i", "j", F.col("n").alias("_nb"), *[F.col(s).alias(f"_b_{s}") for s in stats])
    return b.join(after, [*keys, "i", "j"]).select(
        *keys, "i", "j",
        F.least("_nb", "n").alias("n"),
        *[(F.col(f"_b_{s}") - F.col(s)).alias(s) for s in stats],
    )


def correction_table(cells: DataFrame, min_samples: int = 20, max_sd: float | None = None) -> DataFrame:
    """Mean error per cell in percent; blank under ``min_samples``, flagged if noisy."""
    out = cells.select(
        "*", F.when(F.col("n") >= min_samples, F.col("mean") * 100.0).alias("correction_pct")
    )
    noisy = F.lit(False) if max_sd is None else F.coalesce(F.col("sd") > max_sd, F.lit(False))
    return out.withColumn("unreliable", noisy)
