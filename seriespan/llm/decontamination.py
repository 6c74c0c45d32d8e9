"""Operator 9: passages of benchmark items in documents, by SimHash windows.

An item is looked for in windows of its own number of words, at every word of every whole text.
Items and windows are multisets of five-word shingles; the similarity of two is the sum of the lesser
weights over the sum of the greater ones, a shingle's weight being how often it occurs. A window
matches an item at 0.75 or more.

``SIMHASH``: the fingerprint of a window has ``FINGERPRINT`` bits; bit b is the sign of the sum, over
the window's shingles, of +1 or -1 by bit b of the shingle's hash. Sums slide along the text, so a
window costs one step whatever its length.

Multi-index: item fingerprints are split into ``BLOCKS`` blocks; each block is indexed under every
value within ``RADIUS // BLOCKS`` bit errors of its own. A fingerprint within ``RADIUS`` of an item's
has, by the pigeonhole principle, a block with at most that many errors, so reading off one entry per
block finds every item within the radius. The similarity threshold corresponds to an angle of about
0.5, that is 11 differing bits of 64 (standard deviation 3); the radius of 23 lies four deviations
above.

What a window must have: a match shares at least 0.75 of the item's weight. Windows that hold less
weight of shingles known to any item of their length cannot match, so fingerprints are computed only
where they can. This drops no match, at any size.

The benchmark is small against the corpus; its fingerprints and shingle hashes are broadcast, and
``MAX_ITEM_WORDS`` bounds them: beyond it, ``leaks`` raises rather than cut. No row of the corpus
moves: each text is searched where it is read.

Defined results: null texts count as empty; an item of fewer than five words is the one shingle of
its whole sequence and matches an equal run; items without words match nothing; equal items are
found each; repeated documents are searched each; a document shorter than an item is one window;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Block, blocks, mix, shingle_hashes, span_hashes

SHINGLE = 5
SIMILAR_NUM, SIMILAR_DEN = 75, 100
FINGERPRINT, BLOCKS, RADIUS = 64, 8, 23
MAX_ITEM_WORDS = 20_000_000


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes (A-Z lower-cased) and each text's first word."""
    block = Block(texts, lower=True)
    starts, ends, first = block.words()
    return span_hashes(block.data, starts, ends), first


class Items:
    """The benchmark as the search needs it, by window length in words."""

    def __init__(self, ids: list, texts: list[str | None]):
        words, first = word_hashes([(t or "").encode() for t in texts])
        self.ids, self.length, self.shingles = [], [], []
        for i, item in enumerate(ids):
            own = words[first[i] : first[i + 1]]
            if len(own):
                self.ids.append(item)
                self.length.append(len(own))
                self.shingles.append(np.sort(shingle_hashes(own, min(SHINGLE, len(own)))))
        self.by_length = {}
        for n in sorted(set(self.length)):
            mine = [i for i, length in enumerate(self.length) if length == n]
            known = np.unique(np.concatenate([self.shingles[i] for i in mine]))
            prints = fingerprints_of([self.shingles[i] for i in mine])
            self.by_length[n] = Length(mine, known, prints)
        self.short = any(n < SHINGLE for n in self.by_length)
        self.every = np.unique(np.concatenate([np.empty(0, np.uint64), *(g.known for n, g in self.by_length.items() if n >= SHINGLE)]))


class Length:
    """Items of one length: known shingles, and the multi-index over their fingerprints."""

    def __init__(self, items: list[int], known: np.ndarray, prints: np.ndarray):
        self.items, self.known, self.prints = np.array(items), known, prints
        width = FINGERPRINT // BLOCKS
        masks = [sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(width), k)]
        self.index: list[list[list[int]]] = []
        for block in range(BLOCKS):
            entries: list[list[int]] = [[] for _ in range(1 << width)]
            for at, value in enumerate(prints):
                own = int(value >> np.uint64(block * width)) & ((1 << width) - 1)
                for mask in masks:
                    entries[own ^ mask].append(at)
            self.index.append(entries)

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Item by item, the windows whose fingerprint is within the radius."""
        width = FINGERPRINT // BLOCKS
        found: dict[int, list[np.ndarray]] = {}
        for block, entries in enumerate(self.index):
            values = ((prints >> np.uint64(block * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(values, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
                for item in entries[values[part[0]]]:
                    found.setdefault(item, []).append(part)
        for item, parts in found.items():
            windows = np.unique(np.concatenate(parts))
            apart = np.bitwise_count(prints[windows] ^ self.prints[item])
            yield item, windows[apart <= RADIUS]


def fingerprints_of(shingles: list[np.ndarray]) -> np.ndarray:
    return np.array([fingerprints(s, np.array([0]), len(s))[0] for s in shingles], np.uint64)


def fingerprints(shingles: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """The fingerprints of the windows of ``count`` shingles at ``starts``."""
    out = np.zeros(len(starts), np.uint64)
    spread = mix(shingles)
    for b in range(FINGERPRINT):
        bit = ((spread >> np.uint64(b)) & np.uint64(1)).astype(np.int32)
        total = np.concatenate([[0], np.cumsum(bit)])
        out |= (2 * (total[starts + count] - total[starts]) > count).astype(np.uint64) << np.uint64(b)
    return out


def similarity(window: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Sum of the lesser and of the greater weights of two multisets of shingles."""
    a, n = np.unique(window, return_counts=True)
    b, m = np.unique(item, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common, len(window) + len(item) - common


def search(words: np.ndarray, items: Items, known: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Best window of each matching item in a text: item, first word, common and total weight."""
    runs: dict[int, np.ndarray] = {}
    if len(words) >= SHINGLE:
        runs[SHINGLE] = shingle_hashes(words, SHINGLE)
        hit = np.isin(runs[SHINGLE], known)
        if not hit.any() and not items.short:
            return
    for n, group in items.by_length.items():
        size = min(SHINGLE, n)
        if len(words) < size:
            continue
        if size not in runs:
            runs[size] = shingle_hashes(words, size)
        shingles = runs[size]
        count = min(n - size + 1, len(shingles))  # a shorter text is one window
        own = np.isin(shingles, group.known)
        if not own.any():
            continue
        total = np.concatenate([[0], np.cumsum(own)])
        weight = total[count:] - total[: len(total) - count]
        starts = np.flatnonzero(SIMILAR_DEN * weight >= SIMILAR_NUM * (n - size + 1))
        if not len(starts):
            continue
        prints = fingerprints(shingles, starts, count)
        for at, windows in group.candidates(prints):
            best = None
            item = int(group.items[at])
            for w in windows:
                start = int(starts[w])
                common, over = similarity(shingles[start : start + count], items.shingles[item])
                if SIMILAR_DEN * common >= SIMILAR_NUM * over and (best is None or common * best[3] > best[2] * over):
                    best = item, start, common, over
            if best:
                yield best


def benchmark_items(benchmark: DataFrame, item: str, item_text: str):
    """The benchmark's rows as a broadcast, checked against ``MAX_ITEM_WORDS`` before."""
    found = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t"))
    length = F.coalesce(F.sum(F.regexp_count("t", F.lit("[^\\x20\\x09-\\x0D]+"))), F.lit(0))
    if found.agg(length).first()[0] > MAX_ITEM_WORDS:
        raise ValueError(f"the benchmark has more than {MAX_ITEM_WORDS} words; split it")
    rows = sorted(((r["i"], r["t"]) for r in found.collect()), key=lambda r: (r[0] is None, r[0], r[1] or ""))
    return benchmark.sparkSession.sparkContext.broadcast(rows)


def find_in(batch: pa.RecordBatch, text: str, items: Items) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
    """Row number and hit (see ``search``) of all leaks in a batch's texts."""
    for begin, texts in blocks(batch, text):
        words, first = word_hashes(texts)
        for i in doubtful(words, first, items.every, items):
            for hit in search(words[first[i] : first[i + 1]], items, items.every):
                yield begin + int(i), hit


def leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, item_id, first_word, n_words, similarity``: the best window of each item in a document."""
    rows = benchmark_items(benchmark, item, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items([r[0] for r in rows.value], [r[1] for r in rows.value])
        for batch in batches:
            found = list(find_in(batch, "_t", items))
            hits = [hit for _, hit in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_k").take(pa.array([row for row, _ in found], pa.int64())),
                    pa.array([items.ids[h[0]] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()),
                    pa.array([items.length[h[0]] for h in hits], pa.int64()), pa.array([h[2] / h[3] for h in hits], pa.float64()),
                ],
                ["_k", "item_id", "first_word", "n_words", "similarity"],
            )

    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    kind = texts.schema["_k"].dataType.simpleString()
    return texts.mapInArrow(run, f"_k {kind}, item_id long, first_word long, n_words long, similarity double").withColumnRenamed("_k", key)


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, without moving any."""
    rows = benchmark_items(benchmark, item, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items([r[0] for r in rows.value], [r[1] for r in rows.value])
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, _ in find_in(batch, text, items)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def doubtful(words: np.ndarray, first: np.ndarray, known: np.ndarray, items: Items) -> np.ndarray:
    """The texts of a block that share a shingle with any item (all, if an item is shorter than one)."""
    if items.short or not len(known):
        return np.arange(len(first) - 1) if items.short else np.empty(0, np.int64)
    runs = shingle_hashes(words, SHINGLE)
    place = np.searchsorted(known, runs)
    place[place == len(known)] = 0
    at = np.flatnonzero(known[place] == runs)
    return np.unique(np.searchsorted(first, at, "right") - 1)
