"""Token ids packed into rows of fixed length by best-fit-decreasing.

Texts are encoded by a public byte-level BPE (path and pattern are parameters) with an end token after each
document. Documents longer than a row are split losslessly into full rows and a rest. Pieces are then packed,
longest first, each into the open row with the least room that still holds it; the room is found by a search in
a segment tree over capacities. Packing runs inside groups of about GROUP_BYTES of text, chosen by a hash of
the id, so it is distributed, bounded in memory, and the same on every cluster.

A packed row has the ids (little-endian uint16, or uint32 for large vocabularies, padded to the row length), the
cumulative segment lengths, position ids that restart at each segment, and for each segment the document
and its first token's place in it, so every document can be put together again.

Null and empty texts give no segment. Repeated rows are packed each. A null id is an id. An empty table gives an
empty table. A text must fit a task; other columns are not read.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_TOKENS = 2048
GROUP_BYTES = 8 << 20
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_TOKEN = 50256

_encoders: dict = {}


def encoder(path: str):
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


class Capacities:
    """How many open rows have each capacity; a segment tree finds the least one that is large enough."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        k = self.leaves + capacity
        while k:
            self.count[k] += n
            k >>= 1

    def least(self, size: int) -> int:
        """The least capacity >= size of an open row, or -1."""
        k = self.leaves + size
        if self.count[k]:
            return size
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return -1


def best_fit(sizes: list[int], most: int) -> list[list[int]]:
    """Rows of item numbers; sizes are at most ``most``. Ties go to the earlier item and the row opened last."""
    tree, open_ = Capacities(most), {}
    rows: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[item]
        room = tree.least(size)
        if room < 0:
            row, room = len(rows), most
            rows.append([])
        else:
            row = open_[room].pop()
            tree.add(room, -1)
        rows[row].append(item)
        if room > size:
            open_.setdefault(room - size, []).append(row)
            tree.add(room - size, 1)
    return rows


_ROWS = "pack_group int, pack_row int, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_ids binary, starts array<long>"


def _pack(path: str, end: int, length: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")]))
        encode = encoder(path).encode_to_numpy
        pieces, owner, start = [], [], []
        for k, text in enumerate(table["text"]):
            text = text.as_py()
            if not text:
                continue
            ids = np.append(encode(text, disallowed_special=()), end)
            for a in range(0, len(ids), length):
                pieces.append(ids[a : a + length])
                owner.append(k)
                start.append(a)
        rows = best_fit([len(p) for p in pieces], length)
        kind = np.uint16 if end < 1 << 16 else np.uint32
        out: list[list] = [[] for _ in range(8)]
        docs = []
        for row, items in enumerate(rows):
            ids, places = np.zeros(length, kind), np.zeros(length, np.uint16 if length <= 1 << 16 else np.uint32)
            cut = [0]
            for k in items:
                a, b = cut[-1], cut[-1] + len(pieces[k])
                ids[a:b], places[a:b] = pieces[k], np.arange(b - a)
                cut.append(b)
            for c, x in zip(out, (key[0].as_py(), row, cut[-1], len(items), ids.tobytes(), cut, places.tobytes(), [start[k] for k in items])):
                c.append(x)
            docs.append([owner[k] for k in items])
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()))
        names = [x.split(" ")[0] for x in _ROWS.split(", ")]
        ids = table["id"].combine_chunks() if isinstance(table["id"], pa.ChunkedArray) else table["id"]
        flat = ids.take(pa.array([k for d in docs for k in d], pa.int64()))
        cuts = pa.array(np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int32) if docs else np.zeros(1, np.int32))
        return pa.Table.from_arrays([*(pa.array(c, k) for c, k in zip(out, kinds)), pa.ListArray.from_arrays(cuts, flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat)], names=[*names, "doc_ids"])

    return run


def pack_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = ROW_TOKENS, tokenizer: str = TOKENIZER, end: int = END_TOKEN, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per packed row: pack_group, pack_row, n_tokens, n_segments, ids, cu_seqlens, position_ids,
    starts (of each segment in its document's tokens), doc_ids."""
    total = docs.agg(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    groups = max(1, math.ceil(total / group_bytes))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.pmod(F.xxhash64(docs[id_col], docs[text_col]), F.lit(groups)).cast("int").alias("pack_group"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.groupBy("pack_group").applyInArrow(_pack(tokenizer, end, length), f"{_ROWS}, doc_ids array<{kind}>")


def op4_token_packing(spark, sf_dir: str) -> DataFrame:
    return pack_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
