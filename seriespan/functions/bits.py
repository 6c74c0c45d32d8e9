"""Bit-mask channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit_width(maximum: Column) -> Column:
    """Bits of a mask channel from its declared maximum; NULL unless 2**k - 1."""
    m = maximum.cast("bigint")
    ok = (m > 0) & ((m + 1).bitwiseAND(m) == 0)
    return F.when(ok, F.round(F.log2((m + 1).cast("double"))).cast("int"))


def decode_bits(df: DataFrame, mask: str, bits: int) -> DataFrame:
    """One row per sample and bit, ``bit`` from 0 and ``on`` as 0 / 1."""
    if not 1 <= bits <= 64:
        raise ValueError("a mask has 1 to 64 bits")
    return df.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))).withColumn(
        "on", F.getbit(mask, F.col("bit")).cast("int")
    )


def active_bits(df: DataFrame, keys: list[str], mask: str, bits: int) -> DataFrame:
    """Which bits were ever set, from one OR per key instead of a row per bit."""
    ever = df.groupBy(*keys).agg(F.bit_or(mask).alias("_m"))
    return (
        ever.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
        .select(*keys, "bit", (F.getbit("_m", F.col("bit")) == 1).alias("active"))
    )
