"""Operator 11: hard negatives by rotated one-bit codes with stored alignment.

``index`` rotates every integer vector by one fixed random rotation and codes it by the signs of its
coordinates, then codes what the first code leaves over in the same way, ``CODES`` times. Stored with
each code are its alignment (the coefficient that brings the code closest to the vector) and the length
of what remains. For an anchor, whose rotated coordinates are cut into ``PLANES`` bit planes, the inner
product with a code is a sum of population counts; the products times the alignments estimate the
score, and by Cauchy and Schwarz the rest is at most the remaining length times the part of the anchor
orthogonal to the last code. The cutting error of the planes and float rounding are added, so the
interval is certain. Rows whose interval cannot reach an anchor's list are passed over, the others are
scored in integers. Nothing is approximate in the result.

Rows of equal label and vector are one entry with its smallest keys (no list needs more), so a vector
that a third of the rows share costs one entry. Distinct anchors are searched in slices of about
``SLICE_BYTES``; a slice is broadcast, the entries are read where they lie, and a task returns at most
``positives + 1`` or ``negatives`` rows for each anchor and list. Memory: a slice, a batch of entries,
and products of ``ANCHORS`` x ``ROWS``.

Defined results: rows without key, label or vector take no part, nor do vectors with a null entry or
longer than 2**30 (their scores would not fit a long). Shorter vectors count as filled up with zeros.
Equal rows count once; rows that share only the key are rows of their own, but never "other" to each
other. Anchors without positives, and positives without a negative in the band, give no rows; an empty
table gives none. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import attach
from ..session import settle

CODES = 4
PLANES = 8
SEED = 11
POSITIVES = 5
NEGATIVES = 5
#: A negative's score lies between this share of the positive's and the positive's.
BAND = (4, 5)
LONGEST = 1 << 30
SLICE_BYTES = 16 << 20
ANCHORS, ROWS, PAIRS = 64, 4096, 1 << 15
#: Below this share of open pairs the next code costs more than scoring.
FEW = 0.02
ENTRIES = "label long, keys array<long>, x binary, codes binary, align binary"
NONE = np.iinfo(np.int64).min


def rotation(d: int) -> np.ndarray:
    """One fixed random rotation of ``d`` dimensions."""
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))[0]


def words(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, filled up with zeros."""
    bits = np.packbits(signs, axis=1, bitorder="little")
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``(rows, CODES, words)`` and alignments followed by remaining lengths ``(rows, 2 * CODES)``."""
    rest = x.astype(np.float64) @ rotation(x.shape[1])
    codes, align, left = [], [], []
    for _ in range(CODES):
        sign = rest >= 0
        size = np.abs(rest).mean(axis=1)
        rest -= np.where(sign, 1.0, -1.0) * size[:, None]
        codes.append(words(sign))
        align.append(size)
        left.append(np.sqrt((rest**2).sum(axis=1)))
    return np.stack(codes, axis=1), np.stack(align + left, axis=1)


class Anchors:
    """Some anchors' vectors, labels and bit planes."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, groups: np.ndarray):
        self.x, self.labels, self.groups = x, labels, groups
        d = max(x.shape[1], 1)
        z = x.astype(np.float64) @ rotation(x.shape[1])
        self.low = z.min(axis=1, initial=0.0)
        self.step = np.maximum(z.max(axis=1, initial=0.0) - self.low, 1e-300) / ((1 << PLANES) - 1)
        cut = np.rint((z - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        near = self.low[:, None] + self.step[:, None] * cut
        self.total = near.sum(axis=1)
        self.error = np.abs(z - near).sum(axis=1)
        self.planes = [words((cut >> b) & 1 == 1) for b in range(PLANES)]
        self.length = np.sqrt((z**2).sum(axis=1))
        self.dims = d

    def products(self, part: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of the anchors ``part`` (cut to bit planes) with sign codes, by population counts."""
        sums = np.zeros((len(part), len(codes)), np.int32)
        for b, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                sums += np.bitwise_count(plane[part, w][:, None] & codes[None, :, w]).astype(np.int32) << b
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        f = lambda v: v[part].astype(np.float32)[:, None]
        return 2 * (f(self.low) * ones.astype(np.float32)[None] + f(self.step) * sums) - f(self.total)


def survivors(a: Anchors, part: np.ndarray, codes: np.ndarray, align: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) whose certain score interval ``wanted(low, high)`` accepts, code by code."""
    estimate = np.zeros((len(part), len(codes)), np.float32)
    length = np.sqrt((align[:, :CODES] ** 2).sum(axis=1) * a.dims + align[:, -1] ** 2)
    slack = (4e-6 * math.sqrt(a.dims) * a.length[part])[:, None] * length[None] + 1e-3
    error, f = np.zeros(len(codes)), np.float32
    for k in range(CODES):
        product = a.products(part, codes[:, k])
        estimate += product * align[:, k].astype(f)[None]
        error = error + align[:, k]
        seen = np.maximum(np.abs(product) - a.error[part].astype(f)[:, None], 0)
        across = np.sqrt(np.maximum(a.length[part].astype(f)[:, None] ** 2 * f(1 + 1e-5) - seen**2 / a.dims * f(1 - 1e-5), 0))
        half = across * align[:, CODES + k].astype(f)[None] + (a.error[part][:, None] * error[None] + slack).astype(f)
        open_ = wanted(estimate - half, estimate + half)
        if open_.mean() < FEW:
            break
    return np.nonzero(open_)


class Best:
    """The first ``k`` (score, key) of every list: higher scores first, ties by the smaller key."""

    def __init__(self, lists: int, k: int):
        self.k, self.lists = k, lists
        self.at, self.score, self.key = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(lists, NONE)

    def add(self, at: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if not len(at):
            return
        at, score, key = (np.concatenate(p) for p in ((self.at, at), (self.score, score), (self.key, key)))
        order = np.lexsort((key, -score, at))
        at, score, key = at[order], score[order], key[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.k
        full = rank == self.k - 1
        self.floor[at[full]] = score[full]
        self.at, self.score, self.key = at[keep], score[keep], key[keep]


class Batch:
    """Entries of the index as arrays."""

    def __init__(self, batch: pa.RecordBatch, dims: int):
        n = batch.num_rows
        cells = lambda c, kind: np.frombuffer(b"".join(v.as_py() for v in batch.column(c)), kind)
        self.x = cells("x", np.int64).reshape(n, dims)
        self.codes = cells("codes", np.uint64).reshape(n, CODES, -1)
        self.align = cells("align", np.float64).reshape(n, 2 * CODES)
        self.labels = batch.column("label").to_numpy()
        lists = batch.column("keys")
        self.offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        self.keys = lists.flatten().to_numpy()

    def members(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the places it stands for (indices into ``rows``) and their keys."""
        count = self.offsets[rows + 1] - self.offsets[rows]
        which = np.repeat(np.arange(len(rows)), count)
        within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return which, self.keys[self.offsets[rows][which] + within]


def scored(a: Anchors, b: Batch, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer scores of pairs."""
    out = np.empty(len(anchors), np.int64)
    for at in range(0, len(anchors), PAIRS):
        s = slice(at, at + PAIRS)
        out[s] = np.einsum("ij,ij->i", a.x[anchors[s]], b.x[rows[s]])
    return out


def blocks(n: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, n, ANCHORS):
        for j in range(0, m, ROWS):
            yield np.arange(i, min(i + ANCHORS, n)), np.arange(j, min(j + ROWS, m))


def seek_positives(a: Anchors, b: Batch, best: Best) -> None:
    """Add the batch's rows of the anchors' own labels."""
    for label in np.intersect1d(a.labels, b.labels):
        mine, rows = np.flatnonzero(a.labels == label), np.flatnonzero(b.labels == label)
        for i, j in blocks(len(mine), len(rows)):
            part, these = mine[i], rows[j]

            def wanted(low, high, part=part):
                floor = best.floor[part].astype(np.float64)
                if low.shape[1] >= best.k:
                    floor = np.maximum(floor, np.partition(low, low.shape[1] - best.k, axis=1)[:, -best.k])
                return high >= floor[:, None]

            at, row = survivors(a, part, b.codes[these], b.align[these], wanted)
            at, row = part[at], these[row]
            score = scored(a, b, at, row)
            keep = score >= best.floor[at]
            which, key = b.members(row[keep])
            best.add(at[keep][which], score[keep][which], key)


def seek_negatives(a: Anchors, b: Batch, best: Best, limits: np.ndarray, band: tuple[int, int]) -> None:
    """Add the batch's rows of other labels to every band ``(anchor, positive score)`` they lie in.

    ``limits`` holds the positive scores of every anchor, filled up with ``NONE``.
    """
    width = limits.shape[1]
    lowest = np.where(limits == NONE, 1e300, limits * (band[0] / band[1]))
    for part, these in blocks(len(a.x), len(b.x)):
        other = a.labels[part][:, None] != b.labels[these][None]

        def wanted(low, high, part=part, other=other):
            out = np.zeros(low.shape, bool)
            for j in range(width):
                floor = np.maximum(lowest[part, j], best.floor[part * width + j].astype(np.float64))
                top = limits[part, j].astype(np.float64)
                out |= (high >= (floor - 1e-9 * np.abs(floor))[:, None] - 1e-3) & (low <= (top + 1e-9 * np.abs(top))[:, None] + 1e-3)
            return out & other

        at, row = survivors(a, part, b.codes[these], b.align[these], wanted)
        at, row = part[at], these[row]
        score = scored(a, b, at, row)
        for j in range(width):
            limit = limits[at, j]
            inside = (limit != NONE) & (score <= limit) & (score >= best.floor[at * width + j])
            inside[inside] = band[1] * score[inside] >= band[0] * limit[inside]
            which, key = b.members(row[inside])
            best.add((at[inside] * width + j)[which], score[inside][which], key)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """A column of integer lists as rows of equal length."""
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column):
        v = np.asarray(v.values)
        out[i, : len(v)] = v
    return out


def usable(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """``k, l, x`` of the rows that take part."""
    rows = rows.select(F.col(key).cast("long").alias("k"), F.col(label).cast("long").alias("l"), F.col(vector).alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return rows.where(F.col("k").isNotNull() & F.col("l").isNotNull() & (square <= float(LONGEST) ** 2))


def index(rows: DataFrame, dims: int, members: int) -> DataFrame:
    """An entry per label and vector with its ``members`` smallest keys, codes and alignments, written once."""
    same = Window.partitionBy("l", "x").orderBy("k")
    few = rows.withColumn("_r", F.dense_rank().over(same)).where(F.col("_r") <= members)
    entries = few.groupBy("l", "x").agg(F.sort_array(F.collect_set("k")).alias("keys"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            codes, align = encode(x)
            cells = [pa.array([v.tobytes() for v in m], pa.binary()) for m in (x, codes, align)]
            yield pa.RecordBatch.from_arrays([batch.column("l"), batch.column("keys"), *cells], ["label", "keys", "x", "codes", "align"])

    return settle(entries.select("l", "keys", "x").mapInArrow(code, ENTRIES))


def _slices(groups: DataFrame, dims: int, slice_bytes: int) -> Iterator[DataFrame]:
    n = max(1, math.ceil(groups.count() * (8 * dims + 64) / slice_bytes))
    for s in range(n):
        yield groups.where(F.pmod(F.xxhash64("g"), F.lit(n)) == s)


def _search(entries: DataFrame, part: DataFrame, dims: int, k: int, band: tuple[int, int] | None) -> DataFrame:
    """``g, p, score, key`` of the first ``k`` rows of every list of the anchors in ``part``."""
    got = part.toArrow()
    x, labels, groups = matrix(got.column("x"), dims), got.column("l").to_numpy(), got.column("g").to_numpy()
    limits = np.zeros((len(x), 1), np.int64)
    if band:
        lists = got.column("limits").to_pylist()
        limits = np.full((len(x), max(map(len, lists), default=1) or 1), NONE)
        for i, v in enumerate(lists):
            limits[i, : len(v)] = v
    shared = entries.sparkSession.sparkContext.broadcast((x, labels, groups, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, labels, groups, limits = shared.value
        a, best = Anchors(x, labels, groups), Best(limits.size, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            if band:
                seek_negatives(a, Batch(batch, dims), best, limits, band)
            else:
                seek_positives(a, Batch(batch, dims), best)
        cells = [groups[best.at // limits.shape[1]], limits.ravel()[best.at], best.score, best.key]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["g", "p", "score", "key"])

    found = entries.mapInArrow(run, "g long, p long, score long, key long")
    rank = F.row_number().over(Window.partitionBy("g", "p").orderBy(F.desc("score"), "key"))
    return settle(found.withColumn("rank", rank).where(F.col("rank") <= k))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    *,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "x",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    band: tuple[int, int] = BAND,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vector`` is an array of longs. ``anchor`` is a condition on ``k`` (the key as long). An anchor's
    positives are its first rows of the same label, its negatives for a positive the first of other
    labels with ``band[0] * positive <= band[1] * negative <= band[1] * positive`` (scores).
    """
    base = usable(rows, key, label, vector)
    dims = max(base.agg(F.max(F.size("x"))).first()[0] or 0, 1)
    anchors = settle(base.where(anchor).distinct())
    groups = settle(anchors.groupBy("l", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.monotonically_increasing_id()))
    entries = index(base, dims, max(positives + 1, negatives))
    near = _union([_search(entries, part, dims, positives + 1, None) for part in _slices(groups, dims, slice_bytes)])
    lists = near.groupBy("g").agg(F.sort_array(F.collect_set("score"), asc=False).alias("limits"))
    bands = settle(groups.join(lists, "g"))
    far = _union([_search(entries, part, dims, negatives, band) for part in _slices(bands, dims, slice_bytes)])
    hard = far.groupBy("g", "p").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "score"))).alias("hard"))
    pairs = near.drop("p").withColumnRenamed("score", "p").join(hard, ["g", "p"], "left")
    per_group = pairs.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "p", "hard"))).alias("found"))
    per_group = settle(per_group.join(groups.select("g", "n"), "g"))
    same = (F.col("l") == F.col("_l")) & (F.col("x") == F.col("_x"))
    named = anchors.join(groups.select(F.col("l").alias("_l"), F.col("x").alias("_x"), "g"), same).select("k", "g")
    named = settle(named)
    whole = attach(named, per_group, "g", count="n", total=named.count(), spread=F.col("k"))
    mine = F.slice(F.filter("found", lambda f: f["key"] != F.col("k")), 1, positives)
    return (
        whole.select("k", F.explode(mine).alias("f"))
        .select("k", "f", F.explode("f.hard").alias("h"))
        .select(
            F.col("k").alias("anchor_id"), F.col("f.key").alias("positive_id"), F.col("h.rank").cast("int").alias("rank"),
            F.col("h.key").alias("negative_id"), F.col("f.p").alias("positive_score"), F.col("h.score").alias("negative_score"),
        )
    )
