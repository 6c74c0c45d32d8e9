"""Words, word hashes and shingles of many texts at once, on byte arrays.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; other Unicode spaces belong to
words. A text's bytes are its UTF-8 encoding; a null text counts as empty. Texts are worked in
blocks of about ``BLOCK_BYTES``, so a task's memory follows its block and its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = tuple(
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
                for b in (_BASE, _BASE_INVERSE)
            )
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span ``data[start:end]``; equal bytes give equal hashes everywhere.

    Spans must come in the order of their starts; they may overlap.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(starts, low + BLOCK_BYTES, "left")))
        high = int(ends[at:upto].max())
        power, inverse = _power_tables(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * power[: high - low], out=total[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = upto
    return out


def rolling_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all substrings of ``k`` bytes, worked in stretches to bound memory."""
    n = max(len(data) - k + 1, 0)
    out = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK_BYTES):
        part = data[at : at + BLOCK_BYTES + k - 1]
        power, inverse = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=total[1:])
        m = len(part) - k + 1
        out[at : at + m] = mix((total[k:] - total[:m]) * inverse[:m])
    return out


class Block:
    """Some whole texts in one byte array, a line feed after each."""

    def __init__(self, texts: Sequence[bytes], lower: bool = False):
        self.n = len(texts)
        self.sizes = np.fromiter(map(len, texts), np.int64, self.n)
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.data = LOWER[raw] if lower else raw
        self.begins = np.concatenate([[0], np.cumsum(self.sizes + 1)])  # one more than texts

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and each text's first word (one entry more than texts)."""
        gap = IS_SPACE[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, np.searchsorted(starts, self.begins, "left")


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` successive word hashes."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    count = len(words) - n + 1
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + count]
    return mix(out)


def text_shingles(block: Block, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, each text's first shingle, and its word count.

    A text of fewer than ``n`` words has the whole sequence as its one shingle; without words it
    has none.
    """
    starts, ends, first = block.words()
    words = span_hashes(block.data, starts, ends)
    counts = np.diff(first)
    runs = shingle_hashes(words, n)
    parts, sizes = [], np.maximum(counts - n + 1, 0)
    whole = counts >= n
    if whole.all():  # no short text: only the runs across two texts go
        keep = np.ones(len(runs), bool)
        for k in range(1, n):
            at = first[1:-1] - k
            keep[at[(at >= 0) & (at < len(keep))]] = False
        return runs[keep], np.concatenate([[0], np.cumsum(sizes)]), counts
    for i in range(block.n):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            parts.append(runs[a : b - n + 1])
        elif b > a:
            sizes[i] = 1
            one = np.zeros(1, np.uint64)
            for w in words[a:b]:
                one = one * np.uint64(0xD6E8FEB86659FD93) + w
            parts.append(mix(one + np.uint64(b - a)))
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)]), counts


def blocks(batch: pa.RecordBatch, column: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The batch's texts as UTF-8 in blocks of about ``size`` bytes, with the first row's index.

    A text longer than ``size`` is a block of its own; a null is an empty text.
    """
    values = batch.column(column).cast(pa.large_binary())
    got: list[bytes] = []
    held = begin = 0
    for i in range(len(values)):
        text = values[i].as_py() or b""
        if got and held + len(text) > size:
            yield begin, got
            got, held, begin = [], 0, i
        got.append(text)
        held += len(text)
    if got:
        yield begin, got


def code_points(texts: Sequence[str | None], pad: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, ``pad`` zeros after each, and where each text begins."""
    joined = ("\0" * pad).join([*((t or "").lower() if lower else t or "" for t in texts), ""])
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len((t or "").lower() if lower else t or "") for t in texts), np.int64, len(texts))
    return flat, np.concatenate([[0], np.cumsum(sizes + pad)])


def text_blocks(values: pa.Array, size: int = BLOCK_BYTES) -> Iterator[list[str | None]]:
    """A column's texts in blocks of about ``size`` characters; a longer text is a block of its own."""
    got: list[str | None] = []
    held = 0
    for value in values:
        text = value.as_py()
        if got and held + len(text or "") > size:
            yield got
            got, held = [], 0
        got.append(text)
        held += len(text or "")
    if got:
        yield got


def gram_codes(flat: np.ndarray, sizes: Sequence[int], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """``bits``-bit hashes of the character n-grams that begin at each place, for each n in ``sizes``."""
    value = np.zeros(len(flat), np.uint32)
    for n in range(1, max(sizes) + 1):
        count = max(len(flat) - n + 1, 0)
        value = value[:count] * np.uint32(0x01000193) + (flat[n - 1 :] + np.uint32(n))
        if n in sizes:
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            yield n, mixed >> np.uint32(32 - bits)
