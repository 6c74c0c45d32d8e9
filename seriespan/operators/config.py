"""Small configuration tables next to large frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Rows of one slice of a configuration.
SLICE_ROWS = 10_000


def with_each(df: DataFrame, config: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every row of ``df`` with every row of a configuration table.

    The configuration arrives as one array from a scalar subquery, so nothing is joined or shuffled.
    One of more than ``slice_rows`` rows is settled and arrives slice by slice, so a task holds one
    slice whatever the configuration's size; rows with each of all slices are the result as before.
    """

    def one(part: DataFrame) -> DataFrame:
        rows = part.agg(F.collect_list(F.struct(*config.columns)).alias("c")).scalar()
        return df.select("*", F.explode(rows).alias("_cfg")).select(*df.columns, *[F.col("_cfg")[c].alias(c) for c in config.columns])

    n = config.count()
    if n <= slice_rows:
        return one(config)
    slices = -(-n // slice_rows)
    kept = settle(config.withColumn("_slice", F.pmod(F.monotonically_increasing_id() % slices, F.lit(slices))))
    out = one(kept.where("_slice = 0").drop("_slice"))
    for s in range(1, slices):
        out = out.unionByName(one(kept.where(F.col("_slice") == s).drop("_slice")))
    return out
