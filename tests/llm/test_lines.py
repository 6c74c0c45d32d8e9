"""Line dedup against brute force, in place and routed, and the perfect hash by itself."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

import frames
from seriespan.llm import lines as L
from seriespan.llm.perfect import LEVELS, PerfectIndex

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, chars=20, docs=3):
    """Multiset of (doc_id, lines, dropped, checksum); every row is a document."""
    small = lambda k: float("-inf") if k is None else k
    where = defaultdict(list)
    split = [((t or "").split("\n")) for _, t in rows]
    key = lambda s: s.strip(SPACE).translate(LOWER)
    for (k, _), parts in zip(rows, split):
        for s in {key(p) for p in parts if len(key(p)) >= chars}:
            where[s].append(small(k))
    out = []
    for (k, _), parts in zip(rows, split):
        kept = [p for p in parts if not (len(where[key(p)]) >= docs and small(k) < max(where[key(p)]))]
        out.append((k, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def samples():
    common = "A line that many documents share"
    rows = [(i, f"{common}\n\n own line of document {i} here\n  {common.upper()}\t\nshort") for i in range(12)]
    rows += [(i, t) for i, t in enumerate(frames.texts(), 100)]
    rows += [(200 + i, "Ünïcödé line of twenty　\nnineteen code point\nÜNÏCÖDÉ line of twenty　") for i in range(4)]
    rows += [(300, "nineteen codé point" + "\r\n" + "twenty codé points.."), (301, "twenty codé points..\v"), (302, "twenty codé points..\n")]
    rows += [(None, common), (None, None), (3, rows[3][1]), (3, common + "\n" + common), (11, common)]  # null ids, repeated rows and ids
    rows += [(400, "\n".join(f"line {i % 7000} of a very long document" for i in range(20_000))), (401, "\n" * 500), (402, "line 5 of a very long document"), (403, "line 5 OF a very long document ")]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "doc_id long, text string, k string, t long, a long, gone long")
    return df.repartition(5)


def rows_of(df):
    assert df.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("more", [{}, {"in_place_bytes": 0}, {"shard_keys": 2}, {"shard_keys": 2, "in_place_bytes": 0}])
def test_brute_force(spark, more):
    rows = samples()
    assert rows_of(L.drop_lines(frame(spark, rows), **more)) == brute(rows)


def test_other_bounds(spark):
    rows = samples()
    assert rows_of(L.drop_lines(frame(spark, rows), min_chars=1, min_docs=2)) == brute(rows, 1, 2)


def test_busy_shards_are_dealt_out(spark):
    rows = samples()
    docs = frame(spark, rows)
    index, shards = L.build(L.repeated_lines(docs), 4)
    assert rows_of(L.routed(docs, index, shards, "doc_id", "text", L.MIN_CHARS, probes=7)) == brute(rows)


@pytest.mark.parametrize("more", [{}, {"in_place_bytes": -1}])
def test_empty_and_nothing_repeated(spark, more):
    assert rows_of(L.drop_lines(frame(spark, []), **more)) == []
    rows = [(1, None), (2, ""), (3, "one line of this document")]
    assert rows_of(L.drop_lines(frame(spark, rows), **more)) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    marks = r.integers(0, 2**64, len(keys), dtype=np.uint64)
    index = PerfectIndex.from_bytes(PerfectIndex.build(keys, marks, {"v": np.arange(len(keys))}).to_bytes())
    slots = index.find(keys, marks)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert (index.payload["v"][slots] == np.arange(len(keys))).all()
    foreign = r.integers(0, 2**64, 10_000, dtype=np.uint64)
    assert (index.find(foreign, foreign) == -1).all() and (index.find(keys, marks + np.uint64(1)) == -1).all()
    assert n < 1000 or len(index.bits) * 64 < 4 * len(keys) + 64 * LEVELS


def test_equal_keys_with_other_fingerprints():
    keys = np.array([5, 5, 9, 5, 2**64 - 1], np.uint64)
    marks = np.array([3, 1, 1, 2, 0], np.uint64)
    index = PerfectIndex.build(keys, marks, {"v": np.arange(5)})
    assert index.payload["v"][index.find(keys, marks)].tolist() == [0, 1, 2, 3, 4]
    assert index.find(np.array([5, 9, 7], np.uint64), np.array([4, 2, 1], np.uint64)).tolist() == [-1, -1, -1]
