"""Places of distinct 64-bit hashes in an array, found for many at once without sorting."""

from __future__ import annotations

import numpy as np

_TIMES = np.random.default_rng(0x10C8).integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


class Lookup:
    """Tables in which a hash's slot holds its place; hashes that lose their slot to another go to the next, smaller table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        rest = np.arange(len(keys))
        while len(rest):
            bits = max(4, len(rest).bit_length() + 1)
            times, shift = _TIMES[len(self.tables) % 64], np.uint64(64 - bits)
            slot = (keys[rest] * times >> shift).astype(np.int64)
            table = np.full(1 << bits, -1, np.int32)
            table[slot] = rest
            self.tables.append((times, shift, table))
            rest = rest[keys[table[slot]] != keys[rest]]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash (of equal keys any); -1 where it is not there."""
        out = np.full(len(hashes), -1, np.int32)
        left = np.arange(len(hashes))
        for times, shift, table in self.tables:
            h = hashes[left]
            place = table.take((h * times >> shift).astype(np.int64))
            hit = (place >= 0) & (self.keys.take(np.maximum(place, 0)) == h)
            out[left[hit]] = place[hit]
            left = left[~hit]
            if not len(left):
                break
        return out
