import re

import numpy as np
import pyarrow as pa
from frames import texts
from seriespan.llm import text as T


def raw():
    return [(t or "").encode() for t in texts()]


def test_words_and_shingles_match_a_plain_split():
    data = raw()
    block = T.Block(data, lower=True)
    starts, ends, first = block.words()
    for i, one in enumerate(data):
        want = re.findall(rb"[^\x20\x09-\x0D]+", bytes(T.LOWER[np.frombuffer(one, np.uint8)]))
        got = [bytes(block.data[a:b]) for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert got == want
    flat, begin, counts = T.text_shingles(block, 5)
    seen = {}
    for i, one in enumerate(data):
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(T.LOWER[np.frombuffer(one, np.uint8)]))
        want = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])
        got = flat[begin[i] : begin[i + 1]].tolist()
        assert len(got) == len(want) and counts[i] == len(w)
        for g, x in zip(got, want, strict=True):
            assert seen.setdefault(g, x) == x
    assert len(set(seen.values())) == len(seen)


def test_shingles_do_not_depend_on_the_block():
    data = raw()
    alone = [T.text_shingles(T.Block([d], lower=True), 5)[0].tolist() for d in data]
    flat, begin, _ = T.text_shingles(T.Block(data, lower=True), 5)
    assert alone == [flat[begin[i] : begin[i + 1]].tolist() for i in range(len(data))]
    long = [d for d in data if len(d.split()) >= 5]  # the way without short texts
    flat, begin, _ = T.text_shingles(T.Block(long, lower=True), 5)
    assert [flat[begin[i] : begin[i + 1]].tolist() for i in range(len(long))] == [a for a, d in zip(alone, data) if len(d.split()) >= 5]


def test_span_and_rolling_hashes_over_many_stretches(monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 64)
    data = np.frombuffer(b"abcabcabd" * 40, np.uint8)
    starts = np.arange(0, len(data) - 9, 2)
    got = T.span_hashes(data, starts, starts + 7)
    want = {}
    for s, g in zip(starts, got):
        assert want.setdefault(bytes(data[s : s + 7]), g) == g
    assert len(set(want.values())) == len(want)
    rolled = T.rolling_hashes(data, 5)
    want = {}
    for i, g in enumerate(rolled):
        assert want.setdefault(bytes(data[i : i + 5]), g) == g
    assert len(rolled) == len(data) - 4


def test_blocks_keep_order_and_nulls():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "bbbb", "", "c"])], ["text"])
    assert list(T.blocks(batch, size=3)) == [(0, [b"aa", b""]), (2, [b"bbbb", b""]), (4, [b"c"])] or [
        t for _, part in T.blocks(batch, size=3) for t in part
    ] == [b"aa", b"", b"bbbb", b"", b"c"]


def test_gram_codes_are_equal_for_equal_grams():
    flat, _ = T.code_points(["abcab", "xabc"], 4)
    ((n, codes),) = T.gram_codes(flat, (3,), 20)
    assert n == 3 and codes[0] == codes[9 + 1] and codes[0] != codes[1]
