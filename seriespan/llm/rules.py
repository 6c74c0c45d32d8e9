"""Operator 8: quality rules whose thresholds follow each language and source.

``measures`` counts words, symbols, repeated lines and repeated word windows of every whole text.
``sketch`` turns each measure into a mergeable quantile sketch per (lang, source): counts of
logarithmic buckets ``GAMMA`` apart, so a quantile is off by less than GAMMA - 1 of its value and two
sketches merge by adding counts. They are ordinary rows, combined map-side. ``thresholds`` reads the
quartiles off the sketches; the fences lie ``REACH`` times the interquartile range (at least the
measure's slack) outside. A (lang, source) of fewer than ``MIN_ROWS`` rows takes the fences of its
language's merged sketch, and a language of fewer rows those of all rows. ``judge`` joins the fences
back and filters.

Fixed and independent of the fences: ``base_failed`` for fewer than 50 words or more than half of
the words in repeated three-word windows.

Defined results: null texts count as empty and fail the base; null lang and source are groups of
their own; repeated rows count each; an empty table gives no rows; ``measures`` reads the named
columns only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import attach
from ..session import settle
from .text import IS_SPACE, Block, blocks, shingle_hashes, span_hashes

GAMMA = 1.02
SMALLEST = 1e-4
REACH = 4.0
MIN_ROWS = 200

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_FOLLOWS = (np.arange(256) & 0xC0) == 0x80


@dataclass(frozen=True)
class Rule:
    """A measure, the least interquartile range it is given, and the sides on which it can fail."""

    name: str
    value: str
    slack: float
    low: bool
    high: bool


RULES = (
    Rule("word_length", "word_chars / n_words", 0.4, True, True),
    Rule("symbol_share", "n_symbols / word_chars", 0.01, False, True),
    Rule("punct_share", "n_punct / word_chars", 0.01, False, True),
    Rule("upper_share", "n_upper / word_chars", 0.02, False, True),
    Rule("dup_line_share", "n_dup_lines / n_lines", 0.1, False, True),
    Rule("repeat_share", "n_repeat_words / n_words", 0.1, False, True),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punct", "n_upper")


def count_texts(texts: list[bytes]) -> np.ndarray:
    """``COUNTS`` of each text, a row per text."""
    block = Block(texts)
    data, begins = block.data, block.begins
    starts, ends, first = block.words()
    out = np.zeros((block.n, len(COUNTS)), np.int64)

    def per_text(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mark)])
        return total[begins[1:]] - total[begins[:-1]]

    out[:, 0] = np.diff(first)
    out[:, 1] = per_text(~IS_SPACE[data] & ~_FOLLOWS[data])
    out[:, 2] = per_text(_SYMBOL[data])
    out[:, 6] = per_text(_PUNCT[data])
    out[:, 7] = per_text(_UPPER[data])

    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    with_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[with_word], line_end[with_word]
    lines = span_hashes(data, line_start, line_end)
    line_first = np.searchsorted(line_start, begins)
    words = span_hashes(data, starts, ends)
    out[:, 5] = np.diff(line_first)
    for i in range(block.n):
        mine = lines[line_first[i] : line_first[i + 1]]
        if len(mine) > 1:
            out[i, 3] = len(mine) - len(np.unique(mine))
        windows = shingle_hashes(words[first[i] : first[i + 1]], 3)
        if len(windows) > 1:
            _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
            again = times[which] > 1
            if again.any():
                covered = np.zeros(len(windows) + 2, bool)
                for k in range(3):
                    covered[k : k + len(windows)] |= again
                out[i, 4] = covered.sum()
    return out


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``key, lang, source`` and ``COUNTS`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.concatenate([np.empty((0, len(COUNTS)), np.int64), *(count_texts(t) for _, t in blocks(batch, "_t"))])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_k", "lang", "source")), *(pa.array(np.ascontiguousarray(c)) for c in counts.T)],
                ["_k", "lang", "source", *COUNTS],
            )

    rows = docs.select(
        F.col(key).alias("_k"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("_t")
    )
    kind = rows.schema["_k"].dataType.simpleString()
    found = rows.mapInArrow(run, f"_k {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    return found.withColumnRenamed("_k", key)


def bucket(value: Column) -> Column:
    """The logarithmic bucket of a non-negative value; values up to ``SMALLEST`` share bucket 0."""
    return F.when(value <= SMALLEST, 0).otherwise(F.ceil(F.log(value / SMALLEST) / math.log(GAMMA))).cast("int")


def bucket_value(at: Column) -> Column:
    """The middle of a bucket; 0 for bucket 0."""
    return F.when(at == 0, 0.0).otherwise(F.pow(F.lit(GAMMA), at - 0.5) * SMALLEST)


def sketch(measured: DataFrame) -> DataFrame:
    """``lang, source, rule, bucket, n``: a quantile sketch per group and rule."""
    rules = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.expr(f"try_divide(1.0D * {r.value.split(' / ')[0]}, {r.value.split(' / ')[1]})").alias("value")) for r in RULES)))
    rows = measured.where("n_words > 0").select("lang", "source", rules.alias("_r"))
    return (
        rows.select("lang", "source", "_r.rule", bucket(F.col("_r.value")).alias("bucket"))
        .where("bucket IS NOT NULL").groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))
    )


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of coarser groups: the counts of equal buckets add up."""
    return sketches.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], at: tuple[float, ...]) -> DataFrame:
    """``by, rule, n, q0, q1, ...``: the value below which the share ``at`` of the rows lies."""
    group = Window.partitionBy(*by, "rule")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    rows = sketches.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(group))
    return rows.groupBy(*by, "rule").agg(
        F.max("_all").alias("n"),
        *(bucket_value(F.min(F.when(F.col("_upto") >= F.col("_all") * q, F.col("bucket")))).alias(f"q{i}") for i, q in enumerate(at)),
    )


def thresholds(sketches: DataFrame, reach: float = REACH, min_rows: int = MIN_ROWS) -> DataFrame:
    """``lang, source, rows`` and ``<rule>_low, <rule>_high`` (null: no fence) for every group."""
    fine = quantiles(sketches, ["lang", "source"], (0.25, 0.75))
    by_lang = quantiles(merge(sketches, "lang"), ["lang"], (0.25, 0.75))
    everything = quantiles(merge(sketches), [], (0.25, 0.75))

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*(c for c in df.columns if c not in ("n", "q0", "q1")), F.struct("n", "q0", "q1").alias(name))

    joined = (
        packed(fine, "f").alias("a")
        .join(packed(by_lang, "l").alias("b"), (F.col("a.rule") == F.col("b.rule")) & F.col("a.lang").eqNullSafe(F.col("b.lang")))
        .select("a.*", "l").join(packed(everything, "e"), "rule")
    )
    used = F.when(F.col("f.n") >= min_rows, F.col("f")).when(F.col("l.n") >= min_rows, F.col("l")).otherwise(F.col("e"))
    slack = F.lit(0.0)
    for r in RULES:
        slack = F.when(F.col("rule") == r.name, r.slack).otherwise(slack)
    fenced = joined.select("lang", "source", "rule", F.col("f.n").alias("n"), used.alias("u"), slack.alias("slack"))
    range_ = F.greatest(F.col("u.q1") - F.col("u.q0"), F.col("slack")) * reach
    fenced = fenced.select("lang", "source", "rule", "n", (F.col("u.q0") - range_).alias("low"), (F.col("u.q1") + range_).alias("high"))
    return fenced.groupBy("lang", "source").agg(
        F.max("n").alias("rows"),
        *(F.max(F.when(F.col("rule") == r.name, F.col(side))).alias(f"{r.name}_{side}") for r in RULES for side in ("low", "high") if getattr(r, side)),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, fences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Measures with ``base_failed`` and ``kept``: not failed, and inside all fences of its group."""
    group = F.concat(F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("-")), F.lit("\0"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")))
    rows = measured.withColumn("_g", group)
    marks = settle(fences.withColumn("_g", group).drop("lang", "source"))
    total = marks.agg(F.sum("rows")).first()[0] or 0
    joined = attach(rows, marks, "_g", count="rows", total=total, spread=F.xxhash64(key))
    inside = F.lit(True)
    for r in RULES:
        top, bottom = r.value.split(" / ")
        value = F.expr(f"try_divide(1.0D * {top}, {bottom})")
        if r.low:
            inside = inside & F.coalesce(value >= F.col(f"{r.name}_low"), F.lit(True))
        if r.high:
            inside = inside & F.coalesce(value <= F.col(f"{r.name}_high"), F.lit(True))
    judged = joined.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & inside).select(*measured.columns, "base_failed", "kept")


def adaptive_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Measures and verdict of every row of ``docs``; the measures are written once and read twice."""
    measured = settle(measures(docs, key, text, lang, source))
    return judge(measured, thresholds(settle(sketch(measured))), key)
