"""Static binary fuse filters over sets of 64-bit keys, as numpy array operations.

A filter of n keys holds about 1.13 n fingerprints of 16 bits. A key is in the set if the fingerprints at its three
places, which lie in consecutive segments, XOR to its own; a key outside passes with a chance of 1 in 65,536. Keys are
peeled in rounds: all keys that have a place to themselves leave together, and are given their values in reverse order.
"""

from __future__ import annotations

import numpy as np

from assetgraph.llm.words import mix

_HEAD = np.dtype([("seed", "<u8"), ("segment", "<u4"), ("segments", "<u4")])


def _shape(n: int) -> tuple[int, int]:
    """(length of a segment, number of segments): a power of two that grows with n, and room of at least 1.125 n."""
    segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return segment, max(3, int(np.ceil(room / segment)) + 2)


def _places(keys: np.ndarray, seed: np.uint64, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three places of each key (one row each), and its fingerprint."""
    h = mix(keys + seed)
    first = ((h >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)
    more = mix(h)
    inside = np.uint64(segment - 1)
    places = np.stack([first * np.uint64(segment) + ((h if k == 0 else more >> np.uint64(20 * (k - 1))) & inside) + np.uint64(k * segment) for k in range(3)])
    return places.astype(np.int64), (more >> np.uint64(48)).astype(np.uint16)


def _peel(places: np.ndarray, size: int) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
    """Rounds of (keys, the place that each has to itself), and whether all keys were peeled."""
    n = places.shape[1]
    degree = np.bincount(places.ravel(), minlength=size)
    owner = np.zeros(size, np.int64)  # XOR of the keys at a place: the key itself where it is alone
    for row in places:
        np.bitwise_xor.at(owner, row, np.arange(n))
    alone, keys, own, left = np.flatnonzero(degree == 1), [], [], n
    while len(alone):
        found, at = np.unique(owner[alone], return_index=True)
        keys.append(found)
        own.append(alone[at])
        left -= len(found)
        for row in places[:, found]:
            np.subtract.at(degree, row, 1)
            np.bitwise_xor.at(owner, row, found)
        touched = np.unique(places[:, found])
        alone = touched[degree[touched] == 1]
    return keys, own, left == 0


def build(keys: np.ndarray) -> bytes:
    """A filter of distinct uint64 keys."""
    keys = np.unique(np.asarray(keys, np.uint64))
    segment, segments = _shape(len(keys))
    for attempt in range(1, 200):
        seed = mix(np.array([attempt], np.uint64))[0]
        places, prints = _places(keys, seed, segment, segments)
        rounds, own, done = _peel(places, segment * segments)
        if done:
            break
        segments += max(1, segments // 16)  # a set that doesn't peel gets another seed and more room
    else:
        raise ValueError("no seed peels this set")
    table = np.zeros(segment * segments, np.uint16)
    for found, place in zip(reversed(rounds), reversed(own)):
        rest = table[places[0, found]] ^ table[places[1, found]] ^ table[places[2, found]]  # its own place is still 0
        table[place] = rest ^ prints[found]
    head = np.array([(seed, segment, segments)], _HEAD)
    return head.tobytes() + table.tobytes()


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """True for each key of the set, and for a few others."""
    head = np.frombuffer(blob, _HEAD, 1)[0]
    table = np.frombuffer(blob, np.uint16, offset=_HEAD.itemsize)
    places, prints = _places(np.asarray(keys, np.uint64), head["seed"], int(head["segment"]), int(head["segments"]))
    return (table[places[0]] ^ table[places[1]] ^ table[places[2]]) == prints
