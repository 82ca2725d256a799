"""Alignment of the tokens of two tokenizers, with the counts of linked id pairs over all documents.

A text is encoded by a byte-level BPE (A, of space + text) and by a sentence-piece BPE (B, which adds the space itself). Byte
offsets where tokens of both end cut the tokens into groups; the two tokens that end there are linked. A pair's count is the
number of its links in all documents.

The first pass encodes the documents, writes their ids (two to four bytes each) and gives each task's pair counts. The distinct
pairs get numbers from a minimal perfect hash, built by buckets in tasks; tasks then turn pair counts into dense vectors
indexed by number, in blocks, and these are summed in a tree of FAN to one. The second pass aligns the documents again, from
their ids, and looks each link's count up; the hash verifies every key.

The table of pairs is bounded by the vocabularies, not by the corpus: as linked tokens end together, the shorter one's bytes
are a suffix of the longer one's, so a token of n bytes has at most n partners that are not longer. bound() gives the sum
(492,481 for the default files); that much is sent to the tasks.

No token of either tokenizer crosses a single space between two other characters, so a text is cut there (Pair checks the
files for it, else texts are not cut) and each task encodes a word once as long as it is in its cache; this changes no
result. Where the merges of A's file stand in the order of their ids, A's ids come from a faster encoder on the same ranks.

Null and empty texts have no tokens, nor has a text whose tokens' joined bytes differ from space + text (for B that is a text
with U+2581 in it); they count for nothing, their sums are 0 and their groups ''. Strings of special tokens in a text are plain
text. Repeated rows are aligned and counted each. Ids of any kind, null too, are carried; extra columns are not read. A text and its
tokens must fit a task. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetgraph.llm.perfect_hash import PerfectHash, build
from assetgraph.llm.scratch import written

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
FAN = 16
#: Numbers in a block of a count vector, and keys in a bucket of the hash, about.
BLOCK = 4096
#: Characters of text encoded at once, tokens aligned at once, and words and characters in a task's cache.
CHUNK, TOKENS, CACHE_WORDS, CACHE_CHARS = 1 << 20, 1 << 20, 1 << 18, 1 << 23
_CUT = re.compile(r" (?<=\S )(?=\S)")
_loaded: dict = {}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Two tokenizers: encoders, and the bytes of each id."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        self.plain = bool(byte_level) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.fast = self._ranked(spec, letters) if self.plain else None

    @staticmethod
    def _ranked(spec: dict, letters: dict[str, int]):
        """An encoder on ranks, if each merge gives the next id after the single bytes; else None."""
        import public_tokenizers
        import tiktoken

        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        ids = {token: k for token, k in spec["model"]["vocab"].items() if token not in special}
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        if sorted(ids.values()) != list(range(len(ids))) or [ids.get(m) for m in made] != list(range(len(ids) - len(made), len(ids))):
            return None
        ranks = {bytes(letters[c] for c in token): k for token, k in ids.items()}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def bound(self) -> int:
        """At most so many id pairs can be linked: each token has a partner that is not longer for each of its suffixes."""
        return int(self.length_a.sum() + self.length_b.sum())

    def encode(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of A and of B: the ids of words, one after another, and how many each has. Each word begins with the space that B adds."""
        sides = []
        b = self.b.encode([w[1:] for w in words], num_threads=1)
        a = None
        if self.fast:
            # words that neither begin nor end with more white space are cut apart again where they were joined
            clean = np.fromiter((len(w) > 1 and not w[1].isspace() and not w[-1].isspace() for w in words), bool, len(words))
            if clean.all():
                flat = self.fast.encode_to_numpy("".join(words), disallowed_special=()).astype(np.int64)
                ends = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
                a = flat, np.diff(np.searchsorted(np.cumsum(self.length_a[flat]), ends, "right"), prepend=0)
            else:
                lists = [self.fast.encode_ordinary(w) for w in words]
        else:
            lists = [x.ids for x in self.a.encode_batch(words, add_special_tokens=False)]
        for ids in ([lists] if a is None else []) + [b]:
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            sides.append((np.fromiter((x for word in ids for x in word), np.int64, int(n.sum())), n))
        return sides if a is None else [a, *sides]

    def whole(self, words: list[str], sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Whether both tokenizers' tokens of each word, joined, are the word's bytes."""
        raw = [w.encode() for w in words]
        size, joined, good = np.fromiter(map(len, raw), np.int64, len(raw)), b"".join(raw), True
        for (flat, n), table, length in zip(sides, (self.bytes_a, self.bytes_b), (self.length_a, self.length_b)):
            at = np.r_[0, np.cumsum(length[flat])][np.r_[0, np.cumsum(n)]]
            good = good and np.array_equal(np.diff(at), size) and b"".join(map(table.__getitem__, flat.tolist())) == joined
        if good:
            return np.ones(len(words), bool)
        out = np.ones(len(words), bool)
        for (flat, n), table in zip(sides, (self.bytes_a, self.bytes_b)):
            ids, at = flat.tolist(), np.r_[0, np.cumsum(n)].tolist()
            out &= [b"".join(map(table.__getitem__, ids[i:j])) == w for i, j, w in zip(at, at[1:], raw)]
        return out


def tokenizers(a: str, b: str) -> Pair:
    if (a, b) not in _loaded:
        _loaded[a, b] = Pair(a, b)
    return _loaded[a, b]


def linked(pair: Pair, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts' ids, one after another with how many each text has: which of A's and of B's tokens end a group; the linked pairs
    (A's id times B's vocabulary + B's id), and how many each text has."""
    ends = []
    for (flat, n), length in ((a, pair.length_a), (b, pair.length_b)):
        at = np.r_[0, np.cumsum(length[flat])]
        text = np.repeat(np.arange(len(n)), n)
        ends.append(at[1:] - at[np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)][text] + (text << 40))
    # both are sorted and without repeats
    cut_a, cut_b = (_among(x, y) for x, y in (ends, ends[::-1]))
    links = a[0][cut_a] * len(pair.bytes_b) + b[0][cut_b]
    return cut_a, cut_b, links, np.bincount(ends[0][cut_a] >> 40, minlength=len(a[1]))


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _gathered(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The pieces flat[first : first + n], one after another."""
    total = int(n.sum())
    return flat[np.repeat(first - np.r_[0, np.cumsum(n)[:-1]].astype(np.int64), n) + np.arange(total)] if total else flat[:0]


class Words:
    """Words of texts, each encoded and aligned once while it is held: their ids, links, and how often they came."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.number: dict[str, int] = {}
        self.chars = 0
        self.valid, self.count = np.zeros(0, bool), none
        #: Ids of A and of B and links of all words, one after another, with how many each word has.
        self.parts = [(none, none)] * 3

    def add(self, words: list[str]) -> None:
        sides = self.pair.encode(words)
        links, n = linked(self.pair, *sides)[2:]
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.chars += sum(map(len, words))
        self.valid, self.count = np.r_[self.valid, self.pair.whole(words, sides)], np.r_[self.count, np.zeros(len(words), np.int64)]
        self.parts = [(np.r_[old, new], np.r_[m, k]) for (old, m), (new, k) in zip(self.parts, [*sides, (links, n)])]

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' words, one after another, and how many each text has."""
        parts = [_CUT.split(t) if self.pair.plain else [t] for t in texts]
        flat = [" " + w for p in parts for w in p]
        if new := list(dict.fromkeys(w for w in flat if w not in self.number)):
            self.add(new)
        return np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat)), np.fromiter(map(len, parts), np.int64, len(parts))

    def ids(self, number: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of A and of B: the ids of texts of n words each, one after another, and how many each text has."""
        out = []
        for flat, size in self.parts[:2]:
            first, own = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64), size[number]
            at = np.r_[0, np.cumsum(own)][np.r_[0, np.cumsum(n)]]
            out.append((_gathered(flat, first[number], own), np.diff(at)))
        return out

    def totals(self) -> pa.RecordBatch:
        """(pair, n) of all words that were counted."""
        weight = np.repeat(self.count, self.parts[2][1])
        pairs, at = np.unique(self.parts[2][0][weight > 0], return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, at, weight[weight > 0])
        return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(sums, pa.int64())], names=["pair", "n"])

    def full(self) -> bool:
        return len(self.number) > CACHE_WORDS or self.chars > CACHE_CHARS


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most in size; one row may exceed it."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _packed(flat: np.ndarray, n: np.ndarray, kind: str) -> pa.Array:
    """Rows of n ids each, as bytes."""
    raw = flat.astype(kind)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.r_[0, np.cumsum(n * raw.itemsize)].astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind).astype(np.int64) if data is not None and len(off) else np.zeros(0, np.int64)
    return flat, np.diff(off).astype(np.int64) // size


def _kinds(pair: Pair) -> tuple[str, str]:
    return tuple("<u2" if len(table) <= 1 << 16 else "<u4" for table in (pair.bytes_a, pair.bytes_b))


def _encoded(a: str, b: str):
    """First pass: (id, text) -> (id, a, b), the ids of a row as bytes, none for a text that has no tokens; and (pair, n) in rows of
    their own, summed over as many documents as a task's cache allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(a, b)
        words, kinds = Words(pair), _kinds(pair)

        def totals() -> pa.RecordBatch:
            sums, none = words.totals(), [pa.nulls(1, t) for t in (kind, pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(sums), x.type) for x in none), *sums.columns], names=["id", "a", "b", "pair", "n"])

        kind = pa.null()
        for batch in batches:
            kind = batch.column(0).type
            texts = batch.column(1).to_pylist()
            for i, j in _slices(np.fromiter((len(t or "") for t in texts), np.int64, len(texts)), CHUNK):
                some = [k for k in range(i, j) if texts[k]]
                number, n = words.of([texts[k] for k in some])
                good = np.logical_and.reduceat(words.valid[number], np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)) if some else np.zeros(0, bool)
                number, n = number[np.repeat(good, n)], np.where(good, n, 0)
                words.count += np.bincount(number, minlength=len(words.count))
                sides = []
                for (flat, m), t in zip(words.ids(number, n), kinds):
                    size = np.zeros(j - i, np.int64)
                    size[np.array(some, np.int64) - i] = m
                    sides.append(_packed(flat, size, t))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *sides, pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.int64())], names=["id", "a", "b", "pair", "n"])
                if words.full():
                    yield totals()
                    words.clear()
        if words.number:
            yield totals()

    return run


def _levels(key: tuple, table: pa.Table) -> pa.Table:
    levels = build(table["pair"].to_numpy())
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary()))})


def _vectors(hashed):
    """(pair, n) -> (block, part, sums): a task's dense count vector, in those blocks that are not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: PerfectHash = hashed.value
        sums = np.zeros(math.ceil(len(table) / BLOCK) * BLOCK, np.int64)
        for batch in batches:
            np.add.at(sums, table.numbers(batch.column(0).to_numpy()), batch.column(1).to_numpy())
        blocks = sums.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([part] * len(some), pa.int32()), pa.array([blocks[k].tobytes() for k in some], pa.binary())], names=["block", "part", "sums"])

    return run


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for x in table["sums"]:
        total += np.frombuffer(x.as_py(), np.int64)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def pair_counts(pairs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, fan: int = FAN) -> tuple[PerfectHash, np.ndarray]:
    """The hash of all pairs in (pair, n), and their counts by number. Both are bounded by the vocabularies."""
    spark = pairs.sparkSession
    pair = tokenizers(a, b)
    buckets = max(1, pair.bound() // BLOCK)
    while math.gcd(buckets, len(pair.bytes_b)) > 1:  # else remainders of pairs depend on B's id alone
        buckets += 1
    distinct = pairs.select("pair").distinct().withColumn("bucket", (F.col("pair") % buckets).cast("int"))
    levels = written(distinct.groupBy("bucket").applyInArrow(_levels, "bucket int, levels array<binary>"), "pair-hash")
    built: list[list[np.ndarray]] = [[] for _ in range(buckets)]
    for r in levels.collect():
        built[r.bucket] = [np.frombuffer(x, np.int64) for x in r.levels]
    table = PerfectHash(built)
    if len(table) > pair.bound():
        raise ValueError("more linked pairs than the vocabularies allow")
    vectors = written(pairs.mapInArrow(_vectors(spark.sparkContext.broadcast(table)), "block int, part int, sums binary"), "pair-vectors")
    most = vectors.agg(F.max("part")).first()[0] or 0
    while most:
        most //= fan
        vectors = written(vectors.withColumn("part", (F.col("part") / fan).cast("int")).groupBy("block", "part").applyInArrow(_summed, "block int, part int, sums binary"), "pair-vectors")
    counts = np.zeros(math.ceil(len(table) / BLOCK) * BLOCK, np.int64)
    for r in vectors.collect():
        counts[r.block * BLOCK : (r.block + 1) * BLOCK] += np.frombuffer(r.sums, np.int64)
    return table, counts[: len(table)]


def _joined(strings: pa.Array, ids: np.ndarray, first: np.ndarray, sign: str) -> pa.Array:
    """The strings of ids, joined by groups that begin at first (one more entry than groups)."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), strings.take(pa.array(ids))), sign)


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = TOKENIZER_A, b: str = TOKENIZER_B, fan: int = FAN) -> DataFrame:
    """One row per row of docs: id_col, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their B id),
    count_sum (of counts over links), groups (`a1,a2|b1;a3|b2,b3`: A's and B's ids in order)."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    encoded = written(rows.mapInArrow(_encoded(a, b), f"id {kind}, a binary, b binary, pair long, n long"), "token-ids", codec="zstd")
    table, counts = pair_counts(encoded.where("pair is not null").select("pair", "n"), a, b, fan)
    most = np.zeros(len(tokenizers(a, b).bytes_b), np.int64)
    np.maximum.at(most, table.keys % len(most), counts)
    shared = docs.sparkSession.sparkContext.broadcast((table, counts, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(a, b)
        kinds, (hashed, count, best) = _kinds(pair), shared.value
        strings = pa.array([str(k) for k in range(max(len(pair.bytes_a), len(pair.bytes_b)))])
        for batch in batches:
            sizes = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset :][: len(batch) + 1])
            for i, j in _slices(sizes, TOKENS):
                sides = [_unpacked(batch.column(1 + k).slice(i, j - i), t) for k, t in enumerate(kinds)]
                cut_a, cut_b, links, n = linked(pair, *sides)
                found = count[hashed.numbers(links)]
                at = np.r_[0, np.cumsum(n)]
                per = lambda x: np.diff(np.r_[0, np.cumsum(x)][at])  # noqa: B023, E731
                ends = [np.r_[0, np.flatnonzero(c) + 1] for c in (cut_a, cut_b)]
                groups = pc.binary_join_element_wise(*(_joined(strings, flat, e, ",") for (flat, _), e in zip(sides, ends)), "|")
                text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), groups), ";")
                told = [sides[0][1], sides[1][1], n, n, per(found == best[links % len(best)]), per(found)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x, pa.int64()) for x in told), text], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    out = encoded.where("pair is null").select("id", "a", "b").mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return out.withColumnRenamed("id", id_col)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(*out.columns[:-1], F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
