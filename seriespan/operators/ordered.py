"""Ordered scans that stay parallel when one log holds most of the rows.

A window partitioned by log alone puts a whole log into one task. The operators
here partition by ``(log, chunk)`` instead, where ``chunk`` is NULL for every log
small enough for one task and a slice of the order axis for the others. State that only
depends on earlier rows (held value, previous row, running total) is aggregated per slice,
rolled forward over the few slice rows and unioned back as one seed row in front of each
slice. Range frames are cut by time instead (``windows.sliding``).

Only keys above the threshold take those extra passes. With none, the plan is one
exchange and one sort shared by all windows over the same axis.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLIT = "split"
_CHUNK = "_chunk"
_SEED = "_seed"

TARGET_ROWS = 4_000_000
MAX_HOT_KEYS = 100_000
HISTOGRAM_CELLS = 4096
#: Rows that one task should have to sort.
ROWS_A_TASK = 500_000


@dataclass(frozen=True)
class Axis:
    """Partition keys, the numeric order column and its tie breakers."""

    keys: tuple[str, ...]
    order: str
    ties: tuple[str, ...] = ()

    @property
    def position(self) -> list[Column]:
        return [F.col(self.order), *[F.col(c) for c in self.ties]]


LOG_TIME = Axis(("log_id",), "t_ms", ("seq",))
CHANNEL_TIME = Axis(("log_id", "channel_id"), "t_ms", ("seq",))
LOG_FILE = Axis(("log_id",), "seq")
CHANNEL_FILE = Axis(("log_id", "channel_id"), "seq")


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` of so many ``rows`` dealt by ``keys``, in more tasks than the session's shuffles have where those would be large.

    The session's number does not grow with the data, so the memory of a sort would. Windows over the
    keys find the rows dealt and shuffle no second time. Smaller frames come back unchanged.
    """
    tasks = min(-(-int(rows) // ROWS_A_TASK), MAX_HOT_KEYS)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if tasks <= usual else df.repartition(tasks, *keys)


def attach_splits(
    df: DataFrame,
    axis: Axis,
    target_rows: int = TARGET_ROWS,
    max_hot_keys: int = MAX_HOT_KEYS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add ``split = (lo, width)`` where some key is too large for one task.

    Rows per key are counted first (one column scan, combined map-side), and the span of keys where some are
    many, unless ``counted(*keys, _n, _lo, _hi)`` has each key's rows (at least) and span already. A key is
    oversized above ``max(target_rows, total / max_hot_keys)`` rows, so fewer than
    ``max_hot_keys`` keys can ever qualify: that bounds what reaches the driver and
    the broadcast whatever the data size. With none, ``df`` comes back unchanged and
    the operators plan one plain exchange. The slice width comes from the densest
    cell of a fixed grid over the key's own span, so bursts get narrow slices.
    """
    keys = list(axis.keys)
    order = F.col(axis.order).cast("double")
    per_key = counted
    if per_key is None:  # rows alone: the order may be dear to compute, and its span matters for large keys only
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = F.col("_n") > target_rows
    if counted is not None:
        large = large & (F.col("_hi") > F.col("_lo"))
    seen = per_key.agg(F.sum("_n").alias("total"), F.count_if(large).alias("large")).first()
    if not seen["large"]:  # the usual case takes one pass
        return dealt(df, keys, seen["total"] or 0)
    if counted is None:
        per_key = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi")
        )
        large = large & (F.col("_hi") > F.col("_lo"))
    hot = per_key.filter(large & (F.col("_n") > F.lit(seen["total"]) / F.lit(max_hot_keys)))
    hot_keys = hot.collect()
    if not hot_keys:
        return dealt(df, keys, seen["total"])
    spark = df.sparkSession
    hot = spark.createDataFrame(hot_keys, hot.schema)
    span = F.col("_hi") - F.col("_lo")
    cell = F.floor((order - F.col("_lo")) * HISTOGRAM_CELLS / span)
    fill = F.least(F.lit(target_rows) / F.col("_peak"), F.lit(float(HISTOGRAM_CELLS)))
    splits = (
        df.select(*keys, axis.order)
        .join(F.broadcast(hot), keys)
        .groupBy(*keys, "_lo", "_hi", cell.alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys, "_lo", "_hi")
        .agg(F.max("_n").alias("_peak"))
        .select(
            *keys,
            F.struct(F.col("_lo").alias("lo"), (span / HISTOGRAM_CELLS * fill).alias("width")).alias(SPLIT),
        )
    )
    splits = spark.createDataFrame(splits.collect(), splits.schema)
    return df.join(F.broadcast(splits), keys, "left")


def _chunk_at(position: Column, min_width: float = 0.0) -> Column:
    width = F.greatest(F.col(SPLIT)["width"], F.lit(float(min_width)))
    return F.when(
        F.col(SPLIT).isNotNull(), F.floor((position.cast("double") - F.col(SPLIT)["lo"]) / width)
    )


def has_splits(df: DataFrame) -> bool:
    return SPLIT in df.columns


def scan(
    df: DataFrame,
    axis: Axis,
    *,
    hold: Mapping[str, Column] | None = None,
    prev: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Append running columns along ``axis``.

    ``hold``  - last non-null value at or before the row;
    ``prev``  - value on the preceding row, NULL included;
    ``total`` - running sum including the row.
    """
    hold, prev, total = dict(hold or {}), dict(prev or {}), dict(total or {})
    names = [*df.columns, *hold, *prev, *total]
    if not has_splits(df):
        w = Window.partitionBy(*axis.keys).orderBy(*axis.position)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            "*",
            *[F.last(e, ignorenulls=True).over(upto).alias(n) for n, e in hold.items()],
            *[F.lag(e).over(w).alias(n) for n, e in prev.items()],
            *[F.sum(e).over(upto).alias(n) for n, e in total.items()],
        )

    inputs = {
        **{f"_h_{n}": e for n, e in hold.items()},
        **{f"_p_{n}": F.struct(e.alias("x")) for n, e in prev.items()},
        **{f"_t_{n}": e for n, e in total.items()},
    }
    work = df.select("*", _chunk_at(F.col(axis.order)).alias(_CHUNK), *[e.alias(n) for n, e in inputs.items()])
    pos = F.struct(*axis.position)
    ends = (
        work.filter(F.col(SPLIT).isNotNull())
        .groupBy(*axis.keys, _CHUNK)
        .agg(
            *[
                F.max_by(f"_h_{n}", F.when(F.col(f"_h_{n}").isNotNull(), pos)).alias(f"_h_{n}")
                for n in hold
            ],
            *[F.max_by(f"_p_{n}", pos).alias(f"_p_{n}") for n in prev],
            *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in total],
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    before = (
        Window.partitionBy(*axis.keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    seeds = ends.select(
        *axis.keys,
        _CHUNK,
        *[F.last(f"_h_{n}", ignorenulls=True).over(before).alias(f"_h_{n}") for n in hold],
        *[F.last(f"_p_{n}", ignorenulls=True).over(before).alias(f"_p_{n}") for n in prev],
        *[F.sum(f"_t_{n}").over(before).alias(f"_t_{n}") for n in total],
        F.lit(True).alias(_SEED),
    )
    both = work.withColumn(_SEED, F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    w = Window.partitionBy(*axis.keys, _CHUNK).orderBy(F.col(_SEED).desc(), *axis.position)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        both.select(
            *df.columns,
            _SEED,
            *[F.last(f"_h_{n}", ignorenulls=True).over(upto).alias(n) for n in hold],
            *[F.lag(f"_p_{n}").over(w)["x"].alias(n) for n in prev],
            *[F.sum(f"_t_{n}").over(upto).alias(n) for n in total],
        )
        .filter(~F.col(_SEED))
        .select(*names)
    )


def span_of_key(df: DataFrame, axis: Axis, first: str = "_t_first", last: str = "_t_last") -> DataFrame:
    """Append the first and last order value of each key.

    Ordinary keys read them from the window the caller needs anyway; oversized
    ones from a small aggregate (at most ``MAX_HOT_KEYS`` rows).
    """
    t = F.col(axis.order)
    if not has_splits(df):
        w = Window.partitionBy(*axis.keys)
        return df.select("*", F.min(t).over(w).alias(first), F.max(t).over(w).alias(last))
    edges = (
        df.filter(F.col(SPLIT).isNotNull())
        .groupBy(*axis.keys)
        .agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    )
    chunk = _chunk_at(t)
    w = Window.partitionBy(*axis.keys, chunk)
    return (
        df.join(F.broadcast(edges), list(axis.keys), "left")
        .select(
            *df.columns,
            F.coalesce(F.col("_lo"), F.min(t).over(w)).alias(first),
            F.coalesce(F.col("_hi"), F.max(t).over(w)).alias(last),
        )
    )


def any_of_key(df: DataFrame, axis: Axis, flags: Mapping[str, Column]) -> DataFrame:
    """Append whether each flag is TRUE on any row of the key; as ``span_of_key`` for large keys."""
    inputs = {f"_a_{n}": F.coalesce(c, F.lit(False)) for n, c in flags.items()}
    work = df.withColumns(inputs)
    if not has_splits(df):
        w = Window.partitionBy(*axis.keys)
        return work.select(*df.columns, *[F.max(f"_a_{n}").over(w).alias(n) for n in flags])
    large = (
        work.filter(F.col(SPLIT).isNotNull()).groupBy(*axis.keys).agg(*[F.max(f"_a_{n}").alias(f"_b_{n}") for n in flags])
    )
    w = Window.partitionBy(*axis.keys, _chunk_at(F.col(axis.order)))
    return work.join(F.broadcast(large), list(axis.keys), "left").select(
        *df.columns, *[F.coalesce(F.col(f"_b_{n}"), F.max(f"_a_{n}").over(w)).alias(n) for n in flags]
    )


AGGREGATES = ("min", "max", "sum", "first", "last")


def runs(
    df: DataFrame,
    axis: Axis,
    state: Column,
    aggregates: Mapping[str, tuple[str, Column]] | None = None,
    *,
    only_true: bool = True,
) -> DataFrame:
    """Collapse maximal runs of equal ``state`` into one row each.

    With ``only_true`` the state is a nullable condition and only runs of TRUE
    remain (NULL breaks a run); otherwise every non-null state gives runs and the
    value is kept in ``state``. Columns: keys, ``state``, ``t_start``, ``t_end``,
    ``i_start``, ``i_end`` (last tie breaker), ``n`` and the requested aggregates.
    """
    order, tie = axis.order, (axis.ties[-1] if axis.ties else axis.order)
    wanted = {
        "t_start": ("first", F.col(order)),
        "t_end": ("last", F.col(order)),
        "i_start": ("first", F.col(tie)),
        "i_end": ("last", F.col(tie)),
        **dict(aggregates or {}),
    }
    value = F.coalesce(state, F.lit(False)) if only_true else state
    work = df.select(
        *axis.keys,
        *dict.fromkeys([order, *axis.ties]),
        *([SPLIT] if has_splits(df) else []),
        value.alias("_s"),
        *[c.alias(f"_v_{n}") for n, (_, c) in wanted.items()],
    )
    work = scan(work, axis, prev={"_ps": F.col("_s"), "_any": F.lit(True)})
    starts = (~F.col("_s").eqNullSafe(F.col("_ps"))) | F.col("_any").isNull()
    chunked = has_splits(df)
    work = work.select(
        *axis.keys,
        *dict.fromkeys([order, *axis.ties]),
        *([_chunk_at(F.col(order)).alias(_CHUNK), SPLIT] if chunked else []),
        "_s",
        starts.cast("bigint").alias("_start"),
        *[f"_v_{n}" for n in wanted],
    )
    part = [*axis.keys, *([_CHUNK] if chunked else [])]
    w = Window.partitionBy(*part).orderBy(*axis.position)
    work = work.select(
        "*",
        F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"),
        F.row_number().over(w).alias("_rn"),
        *([F.lead(F.lit(True)).over(w).isNull().alias("_edge")] if chunked else []),
    )
    keep = F.col("_s") if only_true else F.col("_s").isNotNull()
    local = (
        work.filter(keep)
        .groupBy(*part, "_run", F.col("_s").alias("state"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[_reduce(fn, F.col(f"_v_{n}"), F.col("_rn")).alias(n) for n, (fn, _) in wanted.items()],
            *(
                [(F.max("_edge") & F.first(_CHUNK).isNotNull()).alias("_edge")]
                if chunked
                else []
            ),
        )
    )
    out = [*axis.keys, "state", "n", *wanted]
    if not chunked:
        return local.select(*out)
    touches = F.coalesce(F.col(_CHUNK).isNotNull() & ((F.col("_run") == 0) | F.col("_edge")), F.lit(False))
    inner = local.filter(~touches).select(*out)
    along = Window.partitionBy(*axis.keys).orderBy(_CHUNK, "_run")
    joined = (
        local.filter(F.col(_CHUNK).isNotNull() & touches)
        .withColumn(
            "_group",
            F.sum((F.col("_run") != 0).cast("bigint")).over(
                along.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .groupBy(*axis.keys, "_group", "state")
        .agg(
            F.sum("n").alias("n"),
            *[_reduce(fn, F.col(n), F.col(_CHUNK)).alias(n) for n, (fn, _) in wanted.items()],
        )
        .select(*out)
    )
    return inner.unionByName(joined)


def _reduce(fn: str, value: Column, position: Column) -> Column:
    if fn not in AGGREGATES:
        raise ValueError(f"unknown run aggregate {fn!r}")
    if fn == "first":
        return F.min_by(value, position)
    if fn == "last":
        return F.max_by(value, position)
    return {"min": F.min, "max": F.max, "sum": F.sum}[fn](value)
