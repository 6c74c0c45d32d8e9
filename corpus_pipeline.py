"""From raw documents to sharded training documents, one operator after the other.

``STAGES`` lists the stages in order. A stage takes ``(spark, docs, sf_dir)`` and returns the
documents it keeps with the columns of ``docs``; the last adds the shard. ``run`` writes every
stage's result to the shared folder and gives the reread table to the next.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from seriespan.llm import decontamination, hilbert, minhash, mixing, quality  # noqa: E402
from seriespan.llm.common import read  # noqa: E402
from seriespan.registry import query  # noqa: E402
from seriespan.session import settle  # noqa: E402


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours vote for; the labels are those of the folder's table."""
    model = quality.fit(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate class: that with the smallest id.

    Where ids repeat or are missing, rows are numbered first (by id, missing ones last, then by text), so
    that of equal rows one stays and rows that only share an id are judged by their texts.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("doc_id IS NULL OR n > 1").isEmpty():
        kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept"))
        return docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    number = F.monotonically_increasing_id().alias("doc_id")
    numbered = settle(whole.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text")).select("row", "text", number))
    kept = minhash.near_duplicates(numbered.select("doc_id", "text")).where("kept").select("doc_id")
    return numbered.join(kept, "doc_id", "left_semi").select("row.*")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeated(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot along the Hilbert curve."""
    dimensions = [hilbert.Category("source"), hilbert.Category("lang"), hilbert.Numeric("n_chars")]
    return hilbert.sharded_rows(docs, dimensions)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: The stages learn models, compare sets and iterate: SQL cannot express them.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
