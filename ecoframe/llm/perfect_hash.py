"""Minimal perfect hashing of 128-bit keys, built and probed with numpy.

Keys fall on random places of a bit array; places hit once keep their key, the others fall again on
the next, smaller array. A key's number is the count of set bits before its own.
"""

from __future__ import annotations

import struct

import numpy as np

SPREAD = 1.6  # places per key of a level
MAX_LEVELS = 200


def mix(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """A hash of the pair for one level."""
    x = high + low * np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build(high: np.ndarray, low: np.ndarray) -> bytes:
    """The function over distinct keys, as bytes."""
    levels: list[bytes] = []
    level = 0
    while len(high):
        if level == MAX_LEVELS:
            raise ValueError("keys are not distinct")
        size = max(64, int(len(high) * SPREAD))
        place = (mix(high, low, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        levels.append(struct.pack("<q", size) + np.packbits(alone).tobytes())
        left = ~alone[place]
        high, low = high[left], low[left]
        level += 1
    return struct.pack("<q", len(levels)) + b"".join(levels)


class PerfectHash:
    def __init__(self, blob: bytes):
        (count,) = struct.unpack_from("<q", blob)
        at, before, self.levels = 8, 0, []
        for _ in range(count):
            (size,) = struct.unpack_from("<q", blob, at)
            n_bytes = (size + 7) // 8
            bits = np.unpackbits(np.frombuffer(blob, np.uint8, n_bytes, at + 8), count=size)
            ranks = np.cumsum(bits, dtype=np.int64) - 1 + before
            self.levels.append((size, bits.view(bool), ranks))
            before = int(ranks[-1]) + 1
            at += 8 + n_bytes
        self.size = before

    def __call__(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 where no level holds a place, any number for other foreign keys."""
        found = np.full(len(high), -1, dtype=np.int64)
        open_ = np.arange(len(high))
        for level, (size, bits, ranks) in enumerate(self.levels):
            if not len(open_):
                break
            place = (mix(high[open_], low[open_], level) % np.uint64(size)).astype(np.int64)
            hit = bits[place]
            found[open_[hit]] = ranks[place[hit]]
            open_ = open_[~hit]
        return found
