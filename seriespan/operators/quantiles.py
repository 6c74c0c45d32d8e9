"""Exact quantiles with linear interpolation, safe for a key of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: Rows of a key up to which its values are kept in one aggregate's state.
TARGET_ROWS = 250_000
#: Keys that may be larger: a key counts as large above this share of all rows, too.
MAX_LARGE_KEYS = 100_000
#: Cells of one round of selection, and rows of an interval that are told apart value by value.
CELLS = 256
EXACT_ROWS = 100_000


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    target_rows: int | None = None,
    *,
    check: bool = True,
) -> DataFrame:
    """One row per key with a column per name in ``probs``; NULL values are ignored.

    ``check=False`` skips counting the rows per key, for callers that already know
    that no key is oversized.

    Ordinary keys use the exact ``percentile`` aggregate. Its state is one hash map per key, so the
    order statistics of a larger key are selected instead (``selected``).
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if not check:
        return _by_percentile(rows, keys, probs)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    limit = F.greatest(F.lit(target_rows or TARGET_ROWS), total / F.lit(MAX_LARGE_KEYS))
    large = counts.where(F.col("_n") > limit).collect()  # at most MAX_LARGE_KEYS rows
    if not large:
        return _by_percentile(rows, keys, probs)
    hot = df.sparkSession.createDataFrame(large, counts.schema)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    named = F.broadcast(hot.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
    small = _by_percentile(rows.join(named, same, "left_anti"), keys, probs)
    return small.select(*keys, *probs).unionByName(selected(rows, hot, keys, probs).select(*keys, *probs))


def _by_percentile(rows: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    ps = list(probs.values())
    return rows.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(p) for p in ps])).alias("_q")).select(
        *keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)]
    )


def _first_cell(v: Column) -> Column:
    """A number that never falls as ``v`` rises: sign and power of two; NaN comes last, as in sorting."""
    power = F.floor(F.log2(F.abs(v))) + 1100
    finite = F.when(v > 0, power).when(v < 0, -power).otherwise(0)
    ends = F.when(F.isnan(v), 4000).when(v == float("inf"), 3000).when(v == float("-inf"), -3000)
    return F.coalesce(ends, finite).cast("int")


def selected(rows: DataFrame, hot: DataFrame, keys: list[str], probs: dict[str, float], exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Quantiles of the keys in ``hot(keys, _n)`` by rounds of counting, without sorting any key.

    A round counts the values of every key in cells, adds the cells up in order and finds the cell of
    every wanted rank; the next round divides only those. The first cells are powers of two, later ones
    equal parts of what the cell's values span, so a round narrows a cell to its 256th. An interval of
    few rows is told apart value by value. Per key and round there are ``CELLS`` counters for each wanted
    rank, combined map-side; broadcast are the open intervals, two for each quantile of a key at most.
    """
    n = F.col("_n")
    ranks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (n - 1)
        ranks += [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), r.cast("bigint").alias("r")) for side, r in ((0, F.floor(at)), (1, F.ceil(at)))]
    wanted = hot.select(*keys, "_n", F.explode(F.array(*ranks)).alias("w")).select(*keys, "_n", "w.*")
    alias = [f"_k{i}" for i in range(len(keys))]
    same = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, alias)]
    tagged = lambda df: df.withColumnsRenamed(dict(zip(keys, alias)))

    def narrowed(cells: DataFrame, groups: list[str], open_: DataFrame, match: list[Column], start: Column) -> DataFrame:
        """For every open rank, its cell with the rows below it."""
        order = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.withColumn("_below", start + F.coalesce(F.sum("_c").over(order), F.lit(0)))
        found = open_.join(placed, match).where((F.col("r") >= F.col("_below")) & (F.col("r") < F.col("_below") + F.col("_c")))
        return found.select(*keys, "_n", "name", "side", "r", F.col("_below").alias("below"), F.col("_c").alias("c"), F.col("_a").alias("lo"), F.col("_z").alias("hi"))

    held = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_z")]
    mine = rows.join(F.broadcast(tagged(hot.select(*keys))), same)
    cells = mine.groupBy(*alias, _first_cell(F.col("_v")).alias("_cell")).agg(*held)
    open_ = settle(narrowed(cells, alias, wanted, same, F.lit(0)))
    while True:
        wide = tagged(open_.where("lo < hi").select(*keys, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("below").alias("_at"), F.col("c").alias("_rows")).distinct())
        most = wide.agg(F.max("_rows")).first()[0]
        if most is None:
            break
        inside = rows.join(F.broadcast(wide), same).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CELLS), F.lit(CELLS - 1)).cast("double")
        cell = F.when(F.col("_rows") <= exact_rows, F.col("_v")).otherwise(part)
        groups = [*alias, "_lo", "_hi", "_at"]
        cells = inside.groupBy(*groups, cell.alias("_cell")).agg(*held)
        match = [*same, F.col("lo") == F.col("_lo"), F.col("hi") == F.col("_hi")]
        open_ = settle(open_.where("NOT lo < hi").unionByName(narrowed(cells, groups, open_.where("lo < hi"), match, F.col("_at"))))
    picks = []
    for name, p in probs.items():
        side = [F.max(F.when((F.col("name") == name) & (F.col("side") == k), F.col("lo"))) for k in (0, 1)]
        at = F.lit(float(p)) * (F.max("_n") - 1)
        share = at - F.floor(at)
        picks.append(F.when((share == 0) | (side[0] == side[1]), side[0]).otherwise(side[0] * (1 - share) + side[1] * share).alias(name))
    return open_.groupBy(*keys).agg(*picks)
