"""Operator 3: exact token counts of whole texts.

Texts are encoded in batches balanced by bytes; only lengths leave the Arrow function. A text is cut
at safe boundaries first: before a single space that stands between two characters that are not
white space. The pre-tokeniser (byte-level, no prefix space) always starts a new piece there, so the
pieces' lengths add up to the whole text's. Pieces repeat a lot, so each batch encodes its new
distinct pieces at once and the worker remembers their lengths, within ``CACHE_PIECES``.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; an
empty table gives an empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_PIECES = 300_000
BATCH_BYTES = 1 << 20

# White space of any Unicode version, so that a cut is never made where one might see a longer run.
SAFE_CUT = re.compile(r"(?<=[^\s᠎])(?= [^\s᠎])")


class Counter:
    """Token counts by the tokeniser file at ``path``; special strings as its library's default."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the texts together are one batch."""
        cut = [SAFE_CUT.split(text) for text in texts]
        new = list(set().union(*cut) - self.known.keys())
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known.clear()
            new = list(set().union(*cut))
        got = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.known.update(zip(new, map(len, got), strict=True))
        return [sum(map(self.known.__getitem__, pieces)) for pieces in cut]


def balanced(texts: list[str | None], size: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Successive texts in batches of about ``size`` characters; a longer text is alone."""
    batch: list[str] = []
    held = 0
    for text in texts:
        text = text or ""
        if batch and held + len(text) > size:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += len(text)
    if batch:
        yield batch


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``tokenizer`` is the path of a byte-level tokeniser file without prefix space, present on every
    executor. No row moves: the scan's splits are the batches' source.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for batch in batches:
            lengths = [n for part in balanced(batch.column("_t").to_pylist()) for n in counter.lengths(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k"), batch.column("_b"), pa.array(lengths, pa.int64())], ["_k", "_b", "_n"]
            )

    rows = docs.select(
        F.col(key).alias("_k"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_b"), F.col(text).alias("_t")
    )
    kind = rows.schema["_k"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"_k {kind}, _b long, _n long")
    return counted.select(
        F.col("_k").alias(key),
        F.col("_b").alias("n_bytes"),
        F.col("_n").alias("n_tokens"),
        (F.col("_n") > limit).alias("over_limit"),
    )
