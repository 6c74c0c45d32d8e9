"""Roll-ups that grow: rows are appended to a written pyramid without reading the old rows again.

    <pyramid>/blocks/append=<id>/level=<k>/     closed blocks, written once
    <pyramid>/state/v=<number>/                 series, open parts and the appends that count, published last

For values, counters and bits a block is a mergeable state (first, last, extremes, sum, OR, rows), so an
append aggregates its rows to blocks of all levels in one pass, the open block of each level among them:
what is full is written, what is not becomes the new open part, at most one row per series and level.
The mode of a block is that of its four children, which is no mergeable state: there each level is
made from the level below, and up to three closed children per level wait for their fourth.

New rows continue a series where it ended: its end stands in front of them as one seed row, so their ranks and
steps need no join and a series that holds most rows is cut into slices like any other (``ordered.scan``).
Rows of a series must come behind all its earlier rows; others are refused before anything is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import CHANNEL_TIME, SPLIT, Axis, attach_splits, scan
from ..operators.rollup import BASE
from ..session import settle
from .manifest import folder_names, publish

FIRST, LAST = (lambda c: F.min_by(c, "at")), (lambda c: F.max_by(c, "at"))
#: Columns of a block by kind: how the row gives them, and how states merge (``at`` is a state's first rank).
KINDS = {
    "continuous": {
        "t_start": ("t", F.min), "t_end": ("t", F.max), "v_min": ("v", F.min), "v_max": ("v", F.max), "v_first": ("v", FIRST), "v_last": ("v", LAST),
    },
    "counter": {"increase": ("step", F.sum), "v_first": ("v", FIRST), "v_last": ("v", LAST)},
    "bitmask": {"bits": ("v", F.bit_or)},
}
ENUM = ("mode", "changed")


class Pyramid:
    """One pyramid of levels 1 to ``levels`` over the series of ``axis``; ``kind`` as in ``KINDS``, or enum."""

    def __init__(self, spark: SparkSession, path: str, kind: str, levels: int, axis: Axis = CHANNEL_TIME, value: str = "v"):
        if kind != "enum" and kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        self.spark, self.path, self.kind, self.levels, self.axis, self.value = spark, path.rstrip("/"), kind, levels, axis, value
        self.keys = list(axis.keys)

    def version(self) -> int:
        return max(map(int, folder_names(self.spark, f"{self.path}/state", "v=")), default=0)

    def _state(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/state/v={version:09d}/{name}")

    def _continued(self, rows: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
        """The rows with rank and step behind the series' ends, and the new ends."""
        places = [self.axis.order, *self.axis.ties]
        names = [*self.keys, *places, self.value]
        work = rows.drop(SPLIT).select(*names, F.lit(1).cast("bigint").alias("_w"))
        if version:
            ends = self._state("series", version)
            touched = work.select(*self.keys).distinct()
            seeds = ends.join(touched, self.keys, "left_semi").select(*names, F.col("rows").alias("_w"), F.lit(True).alias("_seed"))
            work = work.withColumn("_seed", F.lit(False)).unionByName(seeds)
        else:
            work = work.withColumn("_seed", F.lit(False))
        work = scan(attach_splits(work, self.axis), self.axis, total={"_n": F.col("_w")}, prev={"_prev": F.col(self.value)})
        if version and not work.where("_seed AND _n > _w").isEmpty():
            raise ValueError("rows of a series must come behind its earlier rows")
        fresh = settle(work.where("NOT _seed").select(*names, (F.col("_n") - 1).alias("rn"), "_prev"))
        last = F.max_by(F.struct(*[c for c in names if c not in self.keys]), "rn")
        ends = fresh.groupBy(*self.keys).agg((F.max("rn") + 1).alias("rows"), last.alias("_l")).select(*self.keys, "_l.*", "rows")
        return fresh, ends

    def _merge(self, states: DataFrame, size) -> DataFrame:
        """Blocks of all levels from mergeable states ``keys, level, bucket, at, rows, ...``."""
        parts = {n: how(n).alias(n) for n, (_, how) in KINDS[self.kind].items()}
        out = states.groupBy(*self.keys, "level", "bucket").agg(*parts.values(), F.min("at").alias("at"), F.sum("rows").alias("rows"))
        return out.withColumn("full", F.col("rows") == size)

    def _mergeable(self, fresh: DataFrame, open_: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        t, v = F.col(self.axis.order), F.col(self.value)
        given = {"t": t, "v": v, "step": v - F.coalesce("_prev", v)}
        leaves = fresh.select(*self.keys, "rn", *[given[src].alias(n) for n, (src, _) in KINDS[self.kind].items()])
        leaves = leaves.withColumnsRenamed({"rn": "at"}).withColumns({"bucket": F.floor(F.col("at") / BASE), "level": F.lit(1), "rows": F.lit(1).cast("bigint")})
        first = self._merge(leaves, BASE).drop("full")
        shrink = F.pow(F.lit(BASE), F.col("level") - 1).cast("bigint")
        every = first.drop("level").withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(self.levels))))
        every = every.withColumn("bucket", F.floor(F.col("bucket") / shrink))
        if open_ is not None:
            touched = fresh.select(*self.keys).distinct()
            every = every.unionByName(open_.join(touched, self.keys, "left_semi"))
        blocks = settle(self._merge(every, F.pow(F.lit(BASE), F.col("level")).cast("bigint")))
        return blocks.where("full").drop("full", "rows", "at"), blocks.where("NOT full").drop("full")

    def _modes(self, fresh: DataFrame, open_: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        touched = fresh.select(*self.keys).distinct()
        waiting = None if open_ is None else open_.join(touched, self.keys, "left_semi")
        names = [*self.keys, "bucket", *ENUM]
        below = fresh.select(*self.keys, F.col("rn").alias("bucket"), F.col(self.value).alias("mode"), F.lit(False).alias("changed"))
        closed, still = [], []
        for k in range(1, self.levels + 1):
            if waiting is not None:
                below = below.unionByName(waiting.where(F.col("level") == k - 1).select(*names))
            children = F.sort_array(F.collect_list(F.struct("bucket", *ENUM))).alias("c")
            groups = settle(below.groupBy(*self.keys, F.floor(F.col("bucket") / BASE).alias("_up")).agg(children))
            four, c = groups.where(F.size("c") == BASE), F.col("c")
            votes = F.transform(
                c, lambda x: F.struct(F.size(F.filter(c, lambda y: y["mode"].eqNullSafe(x["mode"]))).alias("n"), (-x["bucket"]).alias("e"), x["mode"].alias("mode"))
            )
            changed = F.exists(c, lambda x: x["changed"] | ~x["mode"].eqNullSafe(c[0]["mode"]))
            below = four.select(*self.keys, F.col("_up").alias("bucket"), F.array_max(votes)["mode"].alias("mode"), changed.alias("changed"))
            closed.append(below.withColumn("level", F.lit(k)))
            rest = groups.where(F.size("c") < BASE).select(*self.keys, F.explode("c").alias("x")).select(*self.keys, "x.*")
            still.append(rest.withColumn("level", F.lit(k - 1)))
        both = [parts[0] for parts in (closed, still)]
        for i, parts in enumerate((closed, still)):
            for p in parts[1:]:
                both[i] = both[i].unionByName(p)
        return both[0], both[1]

    def append(self, rows: DataFrame) -> int:
        """Add rows behind those of earlier appends; returns the published version."""
        base = self.version()
        fresh, ends = self._continued(rows, base)
        open_ = self._state("open", base) if base else None
        closed, still = (self._modes if self.kind == "enum" else self._mergeable)(fresh, open_)
        name = uuid.uuid4().hex
        closed.write.partitionBy("level").parquet(f"{self.path}/blocks/append={name}")
        closed.limit(0).write.mode("ignore").parquet(f"{self.path}/empty")
        appends = self.spark.createDataFrame([(base + 1, name)], "number int, append string")
        if base:
            touched = ends.select(*self.keys)
            still = open_.join(touched, self.keys, "left_anti").unionByName(still)
            ends = self._state("series", base).join(touched, self.keys, "left_anti").unionByName(ends)
            appends = self._state("appends", base).unionByName(appends)
        aside = f"{self.path}/state/.{uuid.uuid4().hex}"
        for part, df in (("series", ends), ("open", still), ("appends", appends)):
            df.write.parquet(f"{aside}/{part}")
        publish(self.spark, aside, f"{self.path}/state/v={base + 1:09d}")
        return base + 1

    def read(self, levels: Sequence[int] | None = None) -> DataFrame:
        """Closed blocks of all published appends: keys, level, bucket and the kind's columns."""
        version = self.version()
        if not version:
            raise ValueError("nothing was appended yet")
        empty = self.spark.read.parquet(f"{self.path}/empty")
        named = [r[0] for r in self._state("appends", version).select("append").collect()]  # one per append
        full = [n for n in named if folder_names(self.spark, f"{self.path}/blocks/append={n}", "level=")]
        if not full:
            return empty
        found = self.spark.read.schema(empty.schema).option("basePath", f"{self.path}/blocks").parquet(*[f"{self.path}/blocks/append={n}" for n in full])
        found = found.select(*empty.columns)
        return found if levels is None else found.where(F.col("level").isin(list(levels)))

    def tail(self) -> DataFrame:
        """The open parts: of mergeable kinds a row per series and level, of modes the children that wait."""
        return self._state("open", self.version())
