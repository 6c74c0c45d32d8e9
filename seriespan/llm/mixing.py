"""Operator 10: a mix of sources at target token counts by entropy balancing.

Every document gets a rate between 0 and 3, as close as possible (in relative entropy) to taking each
document once, under one constraint per source: the rates' words sum to the source's target. The
solution is an exponential tilt, ``rate = min(3, exp(lambda_source * size / mean_size))``, where the
lambdas minimise the convex dual. They are found by Newton steps: each is a Spark aggregation of the
constraint's value and slope by source; steps that leave the bracket known so far are replaced by
its middle. Documents of equal source and size have equal rates, so the steps run on counts by
(source, size).

Rates become copies by systematic rounding: along each source from long to short documents, document
j takes the whole numbers passed by the running sum of rates, so the error of any stretch stays below
one copy. What then still lacks (or exceeds) in a source is made up by the longest documents that
fit, ``REPAIRS`` times. All sums are of integers (fixed point), so reruns agree exactly.

Only DataFrame functions are used. A hot group (one source and size) is dealt by salt; a source's
counts by size are as many as it has different sizes and salts.

Defined results: a null text has size 0; documents of size 0 are taken 0 words (0 copies); a null
source is a source of its own, last; rows that repeat are separate documents; an empty table gives
no rows. Input columns keep their values; new columns replace input columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

WEIGHTS = (5, 2, 1)
MOST = 3
SALTS = 32
REPAIRS = 4
ONE = 1 << 20  # fixed-point unit of a rate
MAX_STEPS = 80
TOLERANCE = 1e-7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(by_size: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``_s, source_size, weight, target`` per source from ``_s, _size, _n``.

    Sources share all words by weight; a target stops at ``most`` times its source's size, and what is
    over goes to the others by weight. Sorted by ``most * size / weight``, the capped sources come
    first, so one running sum finds them. A row per source: sources are few against documents.
    """
    cycle = F.array(*(F.lit(w) for w in weights))
    totals = by_size.groupBy("_s").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy("_s")) - 1
    ranked = totals.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "_s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("_all", F.sum("source_size").over(everything)).withColumn("_w", F.sum("weight").over(everything))
        .withColumn("_size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_w_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    left = F.col("_all") - most * F.col("_size_before")
    ranked = ranked.withColumn("_capped", most * F.col("source_size") * (F.col("_w") - F.col("_w_before")) <= left * F.col("weight"))
    free = F.when(~F.col("_capped"), F.col("weight"))
    taken = F.when(F.col("_capped"), most * F.col("source_size"))
    level = (F.col("_all") - F.coalesce(F.sum(taken).over(everything), F.lit(0))) / F.sum(free).over(everything)
    target = F.when(F.col("_capped"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level)
    return ranked.select("_s", "source_size", "weight", target.cast("double").alias("target"))


def balance(by_size: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """``_s, lambda, mean``: the dual's solution per source, by distributed Newton steps.

    A source at its cap, or without words, needs no tilt: its lambda is infinite or 0.
    """
    means = by_size.where("_size > 0").groupBy("_s").agg((F.sum(F.col("_size") * F.col("_n")) / F.sum("_n")).alias("mean"))
    full = F.col("target") >= most * F.col("source_size")
    start = F.when(F.col("source_size") == 0, 0.0).when(full, float("inf")).otherwise(F.log(F.col("target") / F.col("source_size")))
    state = settle(
        targets.join(means, "_s", "left").select(
            "_s", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"), start.alias("lambda"),
            (-60 * F.coalesce("mean", F.lit(1.0))).alias("low"), (math.log(most) * F.coalesce("mean", F.lit(1.0))).alias("high"),
            ((F.col("source_size") == 0) | full).alias("done"),
        )
    )
    sizes = settle(by_size.groupBy("_s", "_size").agg(F.sum("_n").alias("_n")).where("_size > 0"))
    for _ in range(MAX_STEPS):
        if state.where("NOT done").isEmpty():
            break
        x = F.col("_size") / F.col("mean")
        rate = F.exp(F.least(F.col("lambda") * x, F.lit(math.log(most))))
        words = F.col("_size") * F.col("_n")
        exact = lambda c: F.sum(F.round(c * 65536).cast("decimal(38,0)")).cast("double") / 65536
        value = (
            sizes.join(state.where("NOT done").select("_s", "mean", "lambda"), "_s").groupBy("_s").agg(
                exact(words * rate).alias("value"),
                exact(F.when(F.col("lambda") * x < math.log(most), words * x * rate).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("value") - F.col("target")
        moved = (
            state.join(value, "_s", "left")
            .withColumn("low", F.when(gap < 0, F.col("lambda")).otherwise(F.col("low")))
            .withColumn("high", F.when(gap > 0, F.col("lambda")).otherwise(F.col("high")))
        )
        newton = F.col("lambda") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        close = F.abs(gap) <= TOLERANCE * F.col("target")
        next_ = F.when(F.col("done") | close, F.col("lambda")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = settle(
            moved.select("_s", "target", "mean", next_.alias("lambda"), "low", "high", (F.col("done") | F.coalesce(close, F.lit(True))).alias("done"))
        )
    return state.select("_s", "lambda", "mean")


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken`` added to every row; these replace columns of ``docs``."""
    mixed = _mixed(docs, **how)
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in NEW]
    return mixed.select(*kept, *(F.col(f"_new_{c}").alias(c) for c in NEW))


def _mixed(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Every row whole as ``_row``, beside the columns ``NEW`` under names of their own."""
    rows = docs.select(
        F.struct("*").alias("_row"), F.col(key).alias("_k"), F.xxhash64(F.col(text)).alias("_sum"), word_count(F.col(text)).alias("_size"),
        # the sort order of this key is the sources' by code point, null last
        F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1")).alias("_s"),
    ).withColumn("_salt", F.pmod(F.xxhash64("_k", "_sum"), F.lit(SALTS)).cast("int"))
    group = ["_s", "_size", "_salt"]
    cells = settle(rows.groupBy(*group).agg(F.count("*").alias("_n")))
    targets = settle(source_targets(cells, weights, most))
    dual = balance(cells, targets, most)

    x = F.col("lambda") * F.col("_size") / F.col("mean")
    rate = F.when(F.col("_size") == 0, 0).otherwise(F.round(F.exp(F.least(x, F.lit(math.log(most)))) * ONE)).cast("long")
    rated = cells.join(dual, "_s").withColumn("_rate", F.least(rate, F.lit(most * ONE)))
    before = Window.partitionBy("_s").orderBy(F.desc("_size"), "_salt").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("_before", F.coalesce(F.sum(F.col("_n") * F.col("_rate")).over(before), F.lit(0)))
    rated = settle(rated.select(*group, "_n", "_rate", "_before").join(targets.select("_s", "source_size", "target"), "_s"))

    rounded = settle_cells(rated)
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_k", "_sum"))
    numbered = rows.withColumn("_j", place).join(rated, group)
    whole = copies_at(F.col("_j")) - copies_at(F.col("_j") - 1)
    fixed = repairs(rounded, targets, most)
    numbered = numbered.withColumn("_copies", whole).join(fixed, [*group, "_j"], "left")
    copies = F.col("_copies") + F.coalesce("_change", F.lit(0))
    new = {
        "size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"),
        "copies": copies.cast("int"), "taken": (copies * F.col("_size")).cast("long"),
    }
    return numbered.select("_row", *(v.alias(f"_new_{c}") for c, v in new.items()))


#: Columns that the mix adds.
NEW = ("size", "source_size", "target", "copies", "taken")


def copies_at(j: Column) -> Column:
    """Copies that the first ``j`` documents of a cell and all cells before it take."""
    return F.floor((F.col("_before") + j * F.col("_rate") + ONE // 2) / ONE).cast("long")


def settle_cells(rated: DataFrame) -> DataFrame:
    """Per cell: copies of all its documents, as the difference of the running sums at its ends."""
    return settle(rated.withColumn("_copies", copies_at(F.col("_n")) - copies_at(F.lit(0))))


def repairs(cells: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """``_s, _size, _salt, _j, _change``: single copies to add or drop so that sources meet targets.

    Each round takes, in every source, a document of the largest size that fits what is missing (or
    over), in a cell whose first document can still give or take a copy; a cell is used once.
    """
    group = ["_s", "_size", "_salt"]
    first = copies_at(F.lit(1)) - copies_at(F.lit(0))
    open_ = cells.where("_size > 0").select(*group, first.alias("_first"))
    left = cells.groupBy("_s").agg(F.sum(F.col("_copies") * F.col("_size")).alias("_taken")).join(targets, "_s")
    left = settle(left.select("_s", F.round(F.col("target") - F.col("_taken")).cast("long").alias("_left")))
    open_ = settle(open_)
    chosen = None
    for _ in range(REPAIRS):
        fits = (F.col("_size") <= F.abs("_left")) & F.when(F.col("_left") > 0, F.col("_first") < most).otherwise(F.col("_first") > 0)
        free = open_ if chosen is None else open_.join(chosen, group, "left_anti")
        picked = free.join(left, "_s").where(fits).groupBy("_s").agg(
            F.max(F.struct("_size", F.negate("_salt").alias("_m"))).alias("_b"), F.first("_left").alias("_left")
        )
        picked = settle(picked.select(
            "_s", F.col("_b._size").alias("_size"), (-F.col("_b._m")).alias("_salt"), F.signum("_left").cast("int").alias("_change")
        ))
        chosen = picked if chosen is None else chosen.unionByName(picked)
        left = settle(left.join(picked, "_s", "left").select("_s", (F.col("_left") - F.coalesce(F.col("_size") * F.col("_change"), F.lit(0))).alias("_left")))
    return chosen.withColumn("_j", F.lit(1))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs``, with its own columns, as often as the mix takes it."""
    copies = F.explode(F.sequence(F.lit(1), F.col("_new_copies")))
    return _mixed(docs, **how).where("_new_copies > 0").select("_row", copies.alias("_copy")).select("_row.*")
