"""Words, hashes and n-grams of Arrow string columns, as numpy array operations over whole batches.

All rules here are defined on UTF-8 bytes: separators and case folding touch ASCII only, so a
multi-byte character is always inside a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one document may exceed it. Arrays of 8 bytes per byte of text
#: are made, so a worker needs some 60 times this.
CHUNK_BYTES = 1 << 18
#: Bytes of the batches in which Spark hands rows to Python. A task holds some two or three at a time on either side, beside
#: its heap, and Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text: digits, a-z and all beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words of letters in lower-cased text: a-z and all beyond ASCII
LETTERS = np.zeros(256, dtype=bool)
LETTERS[97:123] = LETTERS[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        size = max(n, CHUNK_BYTES + 1)
        got = np.full(size, np.uint64(base), dtype=np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if size <= 4 * CHUNK_BYTES:
            _powers[name] = got
    return got[:n]


def bound_batches(df) -> None:
    """Set BATCH_BYTES for df's session, unless the session has a bound of its own. Spark asks for it when rows are handed over,
    which is after an operator has returned, so it stays set."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) is None:
        conf.set(BATCH_CONF, str(BATCH_BYTES))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (i, j, bytes, offsets) of a string column, of about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lower(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def spans(raw: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document the number of the first of its words
    (one more entry than documents)."""
    n = len(raw)
    flag = inside[raw]
    before = np.zeros(n, dtype=bool)
    before[1:] = flag[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = flag[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    starts = np.flatnonzero(flag & ~before)
    ends = np.flatnonzero(flag & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], by prefix sums of a polynomial hash."""
    n = len(raw)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[raw] * _power_table("up", _BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power_table("down", _BASE_INV, n + 1)[starts] + (ends - starts).astype(np.uint64))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive entries of h (documents' borders are for the caller)."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(_BASE)
        out += h[k : k + len(out)]
    return mix(out)


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each word, from spans()' third value."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """True at each window of n words (of all words of the chunk) that lies in one document."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, dtype=bool)
    doc = owners(first)
    return doc[: total - n + 1] == doc[n - 1 :]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where an entry of keys occurs twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """True for words in [start, start + n) of any start."""
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + n, total), -1)
    return np.cumsum(edge[:-1]) > 0


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values (one per word) by document."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def map_text(df, measure, schema: str, keep: list[str], text: str = "text"):
    """Run measure(bytes, offsets) -> {column: array} over chunks of df's text column, beside the
    columns in keep. One narrow job: nothing is shuffled, rows keep their order."""
    fields = [x for x in schema.split(", ") if x]

    def batches(it):
        for batch in it:
            parts = [measure(raw, off) for _, _, raw, off in chunks(batch.column(0))]
            if parts:
                made = [np.concatenate([p[f.split(" ")[0]] for p in parts]) if isinstance(next(iter(parts))[f.split(" ")[0]], np.ndarray) else sum((p[f.split(" ")[0]] for p in parts), []) for f in fields]
                names = [*keep, *(f.split(" ")[0] for f in fields)]
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + k) for k in range(len(keep))), *(pa.array(x) for x in made)], names=names)

    bound_batches(df)
    chosen = df.select(df[text].alias("__text"), *(df[c] for c in keep))
    kept = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes[1:])
    return chosen.mapInArrow(batches, ", ".join(x for x in (kept, schema) if x))
