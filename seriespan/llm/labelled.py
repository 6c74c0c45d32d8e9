"""Labelled rows for the classifiers: a bounded training sample and the held-out share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32(key as text) leaves 0 by this divisor never train a classifier.
FOLDS = 5


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is held out; a null key is never learnt from, so it counts as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``text, label`` of at most ``rows`` labelled rows that are not held out.

    The sample is the labels with the smallest hashes of their key, so it is the same in every run
    and its bound lets it be broadcast. A key labelled twice counts as 1 if any of its labels is. Of
    rows that repeat a key, the one whose text has the smallest hash stands for it, so ``rows`` holds.
    """
    chosen = (
        labels.where(~held_out(key) & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64(key), key).limit(rows)
    )
    found = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(chosen), key)
    one = found.groupBy(key).agg(F.min(F.struct(F.xxhash64("_text").alias("_h"), "_text", "_label")).alias("_r"))
    return one.select(F.col("_r._text").alias("text"), F.col("_r._label").alias("label"))
