"""Minimal perfect hashing of 64-bit keys: levels of bit arrays, as numpy array operations.

At each level a key has one place; keys alone at theirs are settled, the others go on to the next level. A key's number is
the count of settled places before its own, so n keys get the numbers 0 to n - 1. Tables are built for buckets of keys in
tasks of their own; PerfectHash puts them together.
"""

from __future__ import annotations

import numpy as np

from assetgraph.llm.words import mix

#: Places for each key that a level still has.
ROOM = 1.6
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def build(keys: np.ndarray) -> list[np.ndarray]:
    """The levels of distinct keys from 0 on: at each settled place its key, at others -1."""
    levels, left = [], np.asarray(keys).astype(np.uint64)
    while len(left):
        size = max(1, int(ROOM * len(left)))
        place = (mix(left ^ _SEEDS[len(levels)]) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size)[place] == 1
        level = np.full(size, -1, np.int64)
        level[place[alone]] = left[alone].astype(np.int64)
        levels.append(level)
        left = left[~alone]
    return levels


class PerfectHash:
    """Numbers for keys of all buckets; verifies each key it is asked for."""

    def __init__(self, buckets: list[list[np.ndarray]]):
        """buckets: build()'s levels of bucket 0, 1, ...; a key is in the bucket of its remainder by their number."""
        depth = max(map(len, buckets), default=0)
        n = len(buckets)
        sizes = np.ones((depth, n), np.uint64)
        starts = np.zeros((depth, n), np.int64)
        flat, at = [], 0
        for b, levels in enumerate(buckets):
            for k, level in enumerate(levels):
                sizes[k, b], starts[k, b] = len(level), at
                flat.append(level)
                at += len(level)
            for k in range(len(levels), depth):  # an empty place
                starts[k, b] = -1
        self.sizes, self.starts = sizes, starts
        keys = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        self.settled = np.append(keys >= 0, False)  # starts of -1 read the last, empty place
        self.rank = np.cumsum(self.settled) - self.settled
        #: The keys by their numbers.
        self.keys = keys[keys >= 0]

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; KeyError if one is not in the set."""
        keys = np.asarray(keys).astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        bucket, left = (keys % np.uint64(self.sizes.shape[1])).astype(np.int64), np.arange(len(keys))
        for k in range(len(self.sizes)):
            b, own = bucket[left], keys[left]
            start = self.starts[k, b]
            place = np.where(start < 0, -1, start + (mix(own ^ _SEEDS[k]) % self.sizes[k, b]).astype(np.int64))
            hit = self.settled[place]
            out[left[hit]] = self.rank[place[hit]]
            left = left[~hit]
            if not len(left):
                break
        if len(left) or not np.array_equal(self.keys[out], keys.astype(np.int64)):
            raise KeyError("a key that was not hashed")
        return out
