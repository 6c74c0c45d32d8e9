"""A minimal perfect hash over 64-bit keys, with a fingerprint and payload per key, built in one shard.

Level by level every key not yet placed takes a bit of a bit array; bits that one key takes alone are
kept, the other keys go on to the next level with another hash. A key's number is the rank of its bit
among all kept bits, so ``n`` keys fill ``n`` slots, at about 3 bits a key. Keys that no level places
(equal 64-bit keys cannot be) are listed at the end and searched by bisection. A key that was not in
the set reaches some slot too, or none; the slot's fingerprint tells it apart.
"""

from __future__ import annotations

import io

import numpy as np

LEVELS = 24
#: Bits of a level for each key that reaches it.
ROOM = 1.5


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectIndex:
    """``find(keys, fingerprints)`` gives each key's slot in the payload arrays, -1 for foreign keys."""

    def __init__(self, sizes, bits, ranks, rest, fingerprints, payload):
        self.sizes, self.bits, self.ranks, self.rest = sizes, bits, ranks, rest
        self.fingerprints, self.payload = fingerprints, payload

    @staticmethod
    def build(keys: np.ndarray, fingerprints: np.ndarray, payload: dict[str, np.ndarray]) -> PerfectIndex:
        """Pairs (key, fingerprint) must be distinct; ``payload`` arrays are in the order of the keys."""
        left, at = keys.astype(np.uint64), np.arange(len(keys))
        sizes, bits, placed = [], [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-int(len(left) * ROOM) // 64) * 64 + 64
            spot = (mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(spot, minlength=size) == 1
            mine = alone[spot]
            order = np.argsort(spot[mine])
            placed.append(at[mine][order])
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left, at = left[~mine], at[~mine]
        order = np.lexsort((fingerprints[at], left))
        placed.append(at[order])
        slots = np.concatenate(placed)
        words = np.concatenate([*bits, np.zeros(0, np.uint64)])
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return PerfectIndex(
            np.array(sizes, np.int64), words, ranks, left[order], fingerprints[slots].astype(np.uint64), {k: v[slots] for k, v in payload.items()}
        )

    def find(self, keys: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
        slot = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            spot = (mixed(keys[open_], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.bits[spot >> 6], (spot & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[open_[there]] = (self.ranks[spot >> 6] + below)[there]
            open_ = open_[~there]
            base += size
        first = int(self.ranks[-1])
        if len(self.rest):
            lows = first + np.searchsorted(self.rest, keys[open_], "left")
            for i, low in zip(open_.tolist(), lows.tolist()):
                while low - first < len(self.rest) and self.rest[low - first] == keys[i]:
                    if self.fingerprints[low] == fingerprints[i]:
                        slot[i] = low
                        break
                    low += 1
        known = slot >= 0
        slot[known] = np.where(self.fingerprints[slot[known]] == fingerprints[known], slot[known], -1)
        return slot

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        names = {f"p_{k}": v for k, v in self.payload.items()}
        np.savez(out, sizes=self.sizes, bits=self.bits, rest=self.rest, fingerprints=self.fingerprints, **names)
        return out.getvalue()

    @staticmethod
    def from_bytes(cell: bytes) -> PerfectIndex:
        got = np.load(io.BytesIO(cell))
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(got["bits"]), dtype=np.int64)])
        payload = {k[2:]: got[k] for k in got.files if k.startswith("p_")}
        return PerfectIndex(got["sizes"], got["bits"], ranks, got["rest"], got["fingerprints"], payload)
