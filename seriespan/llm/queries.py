"""The registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from . import decontamination, hilbert, lines, mixing, negatives, quality, rules, toxicity, warc, whitening
from .common import read
from .minhash import near_duplicates
from .suffixes import suffix_dedup
from .tokens import token_counts
from .vectors import integer_rows


OP11 = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.l = o.l AS same,
         CAST(list_inner_product(a.x, o.x) AS BIGINT) AS score
  FROM r AS a JOIN r AS o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5"""

_STRIPPED = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12 = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS line FROM cut),
k AS (SELECT doc_id, i, line, {_STRIPPED} AS key FROM l),
gone AS (
  SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.i, k.line, largest IS NOT NULL AND k.doc_id < largest AS dropped FROM k LEFT JOIN gone USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, folder, "labels", "doc_id", "toxic")))


@query("op2_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return quality.score(docs, quality.fit(docs, read(spark, folder, "labels", "doc_id", "quality")))


@query("op3_token_counts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, folder, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@query(
    "op4_warc",
    f"""
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
         substr('{BASE32}', 1 + CAST((CAST('0x' || substr(sha1(coalesce(html, '')), CAST(1 + 5 * i AS INT), 5) AS INT)
                >> CAST(15 - 5 * j AS INT)) & 31 AS INT), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id > min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))""",
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages", "page_id", "url", "html")
    place = warc.fresh_folder(spark, "warc")
    files = warc.write_index(warc.write_archives(pages, place), place)
    records = warc.read_records(warc.lookup(warc.keys_of(pages), files, place), place)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_minhash")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents", "doc_id", "text"))


@query("op6_hilbert_shards")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text", "lang", "source", "n_chars")
    dimensions = [hilbert.Category("source"), hilbert.Category("lang"), hilbert.Numeric("n_chars")]
    return hilbert.hilbert_shards(docs, dimensions).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


@query("op7_suffix_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup(read(spark, folder, "documents", "doc_id", "text"))


@query("op8_adaptive_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text", "lang", "source")
    return rules.adaptive_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op9_simhash_leaks")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return decontamination.leaks(docs, read(spark, folder, "benchmark", "item_id", "text"))


@query("op10_entropy_mix")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text", "source")
    return mixing.mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_hard_negatives", OP11)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = integer_rows(read(spark, folder, "embeddings", "vec_id", "embedding", "label"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("k") % 100 == 0)


@query("op12_line_dedup", OP12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lines.drop_lines(read(spark, folder, "documents", "doc_id", "text"))


@query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = integer_rows(read(spark, folder, "embeddings", "vec_id", "embedding"))
    return whitening.whiten(rows, whitening.fit(rows))
