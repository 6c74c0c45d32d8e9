"""Integer vectors from float arrays, for the operators on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there and every entry is a finite number."""
    x = F.col(vector)
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.coalesce(x.isNotNull() & F.forall(x, lambda v: F.coalesce(good(v.cast("double")), F.lit(False))), F.lit(False))


def integers(vector: str, scale: int = 256) -> Column:
    """``floor(scale * entry)`` of every entry as a long; beyond a long's range its ends."""

    def cut(v: Column) -> Column:
        wide = v.cast("double") * scale
        ends = F.when(wide > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63)))
        return F.when(F.abs(wide) < float(2**63), F.floor(wide)).otherwise(ends)

    return F.transform(vector, cut)


def integer_rows(rows: DataFrame, vector: str = "embedding", scale: int = 256, into: str = "x") -> DataFrame:
    """The rows with a finite vector, with its integers as ``into``."""
    return rows.where(finite(vector)).withColumn(into, integers(vector, scale))
