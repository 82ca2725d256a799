"""A prefix trie over conversations: what a cache of shared leading turns would save.

A conversation is the sequence of its turns (role and text), each known by a 16-byte digest, so a text is read once and
never shuffled. Distinct sequences are range-partitioned by the digests of their turns in order, hence neighbours share
the longest prefixes. In a partition the edges between sorted neighbours are taken in descending depth of their longest
common prefix, and a union-find joins the two components: each join puts a branching node at that depth above them
(several joins at one depth, one node), and the turns between two such nodes are nodes with one child.

What a partition can't finish are the prefixes of its first and last sequence, which may go on in its neighbours. Its
forest is contracted to these two lines, each prefix holding the sums of all finished nodes below it, and FAN partitions'
lines at a time go through the same step, until one group is left. Lines are as long as a conversation, so a task of the
tree is bounded; the first level's tasks hold about PART_TURNS turns.

Equal conversations, however many, are one sequence; their ids are sorted over all tasks, and only pieces of joined ids
meet where a hash over all of them has to be made.

Turns are ordered by turn (null first), ties by the digest of role and text; repeated rows are turns of their own. A null
role or text is empty. Rows without a conv_id belong to no conversation and are left out. Long texts are only hashed and
counted. A conversation's digests must fit a task. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetgraph.llm.scratch import written

PART_TURNS = 50_000
FAN = 16
#: Bytes of joined ids in a piece.
PIECE = 1 << 20
#: Bytes of a turn's digest.
WIDE = 16
#: Of contract 12: ids of a block share the head of its first conversation.
BLOCK, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"


def conversation_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<th, words>>): the turns of each conversation in order."""
    role, text = F.coalesce(conversations[role_col], F.lit("")), F.coalesce(conversations[text_col], F.lit(""))
    rows = conversations.where(conversations[id_col].isNotNull()).select(
        conversations[id_col].alias("conv_id"), conversations[turn_col].alias("turn"), F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8")).alias("th"), F.regexp_count(text, F.lit(WORD)).alias("words")
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "th", "words"))).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["th"].alias("th"), t["words"].alias("words"))).alias("turns"))


def with_shared_heads(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """Each conversation c with the first h turns of c - c % block, then its own turns after its first h; h = crc32(c) % heads."""
    base = F.col("conv_id") - F.col("conv_id") % block
    first = turns.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads).alias("head"))
    both = turns.withColumn("h", (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % heads).cast("int")).join(first, base == F.col("base"), "left")
    mine = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0)), mine).alias("turns"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kd, conv_id) sorted by both -> (kd, first, n, ids): ids joined by commas, in pieces."""
    kind = None

    def made(kd, ids):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((kd, ids[0], len(ids), ",".join(map(str, ids)).encode()),)), (pa.binary(), kind, pa.int64(), pa.binary()))], names=["kd", "first", "n", "ids"])

    now, held, size = None, [], 0
    rows: list[tuple] = []
    for batch in batches:
        kind = batch.schema.field(1).type
        for kd, ids in itertools.groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), key=lambda x: x[0]):
            if kd != now and held:
                rows.append((now, held[0], len(held), ",".join(map(str, held)).encode()))
                held, size = [], 0
            now = kd
            for _, i in ids:
                held.append(i)
                size += 20
                if size > PIECE:
                    rows.append((now, held[0], len(held), ",".join(map(str, held)).encode()))
                    held, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), kind, pa.int64(), pa.binary()))], names=["kd", "first", "n", "ids"])
            rows = []
    if held:
        yield made(now, held)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (kd, first) -> (n, first, ends): one row for each kd, its ids hashed as they stream by."""
    now = None
    kind = pa.int64()

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), kind, pa.binary()))], names=["n", "first", "ends"])

    for batch in batches:
        kind, rows = batch.schema.field(1).type, []
        for kd, first, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if now and now[0] == kd:
                now[1] += n
                now[3].update(b"," + ids)
            else:
                if now:
                    rows.append((now[1], now[2], now[3].digest()))
                now = [kd, n, first, hashlib.sha256(ids)]
        if rows:
            yield out(rows)
    if now:
        yield out([(now[1], now[2], now[3].digest())])


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """(key, words, n, first, ends) of (conv_id, key, words): each distinct key once, with the number of its conversations, the
    smallest and a hash of all ids."""
    kind = sequences.schema["conv_id"].dataType.simpleString()
    ids = sequences.select(F.unhex(F.md5("key")).alias("kd"), "conv_id").repartitionByRange("kd", "conv_id").sortWithinPartitions("kd", "conv_id")
    pieces = ids.mapInArrow(_pieces, f"kd binary, first {kind}, n long, ids binary")
    groups = pieces.repartition("kd").sortWithinPartitions("kd", "first").mapInArrow(_hashed, f"n long, first {kind}, ends binary")
    return sequences.join(groups, sequences["conv_id"] == groups["first"]).select("key", "words", "n", "first", "ends")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their start."""
    most, k = min(len(a), len(b)), 0
    while k < most and a[k : k + WIDE] == b[k : k + WIDE]:
        k += WIDE
    return k // WIDE


class Item:
    """A sequence with what is known of its prefixes: for depths 0 to its length, the members that no other item brings (n,
    their smallest id), finished children, their leaves and savings, and the hash of the members that end there."""

    __slots__ = ("key", "words", "n", "least", "children", "leaves", "saved", "ends")

    def __init__(self, key: bytes, words: list[int], **sums: list):
        self.key, self.words = key, words
        size = len(words) + 1
        for name in ("n", "children", "leaves", "saved"):
            setattr(self, name, sums.get(name) or [0] * size)
        for name in ("least", "ends"):
            setattr(self, name, sums.get(name) or [None] * size)


def _less(a, b):
    return b if a is None else a if b is None else min(a, b)


def grow(items: list[Item], last: bool) -> tuple[list[tuple], list[Item]]:
    """The forest of sorted distinct items: (finished nodes, the contracted lines of the first and last item).

    A node is (depth, smallest id, n, children, leaves, saved, ends, the parent's smallest id or None, the parent's prefix if it
    isn't finished, the own prefix). last: no neighbours are left, so all nodes are finished."""
    m = len(items)
    depth, up, item = [len(x.words) for x in items], [-1] * m, list(range(m))
    top, joined = list(range(m)), list(range(m))

    def find(x: int) -> int:
        while joined[x] != x:
            joined[x] = joined[joined[x]]
            x = joined[x]
        return x

    def climb(node: int, to: int) -> int:
        while depth[node] > to:
            depth.append(depth[node] - 1)
            item.append(item[node])
            up.append(-1)
            up[node] = node = len(depth) - 1
        return node

    shared = [_common(a.key, b.key) for a, b in zip(items, items[1:])]
    for e in sorted(range(m - 1), key=lambda e: -shared[e]):  # equal depths from left to right: only the left side may have the node
        a, b = find(e), find(e + 1)
        node = climb(top[a], shared[e])
        up[climb(top[b], shared[e] + 1)] = node
        joined[b], top[a] = a, node
    climb(top[find(0)], 0)

    size = len(depth)
    n, least, children, leaves, saved, ends = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size, [None] * size
    for k, x in enumerate(items):
        node = k
        for d in range(len(x.words), -1, -1):
            n[node] += x.n[d]
            least[node] = _less(least[node], x.least[d])
            children[node] += x.children[d]
            leaves[node] += x.leaves[d]
            saved[node] += x.saved[d]
            ends[node] = ends[node] or x.ends[d]
            node = up[node]
    unfinished: list[list[int]] = []
    if not last:
        for k in sorted({0, m - 1}):
            line, node = [], k
            while node >= 0:
                line.append(node)
                node = up[node]
            unfinished.append(line[::-1])
    is_open = set(itertools.chain(*unfinished))
    order = [int(x) for x in np.argsort(-np.array(depth), kind="stable") if int(x) not in is_open]
    for x in order:
        leaves[x] = leaves[x] if children[x] else 1
        if depth[x]:
            saved[x] += (n[x] - 1) * items[item[x]].words[depth[x] - 1]
            p = up[x]
            n[p] += n[x]
            least[p] = _less(least[p], least[x])
            children[p] += 1
            leaves[p] += leaves[x]
            saved[p] += saved[x]
    finished = []
    for x in order:
        p, key = up[x], items[item[x]].key
        waits = p in is_open
        finished.append((depth[x], least[x], n[x], children[x], leaves[x], saved[x], ends[x], None if waits or p < 0 else least[p], key[: (depth[x] - 1) * WIDE] if waits else None, key[: depth[x] * WIDE]))
    lines, told = [], set()
    for k, line in zip(sorted({0, m - 1}), unfinished):
        x = Item(items[k].key, items[k].words)
        for d, node in enumerate(line):
            if node not in told:  # prefixes that both lines share are told once
                x.n[d], x.least[d], x.children[d], x.leaves[d], x.saved[d], x.ends[d] = n[node], least[node], children[node], leaves[node], saved[node], ends[node]
        told.update(line)
        lines.append(x)
    return finished, lines


def _schema(kind: str) -> str:
    node = f"depth int, conv_id {kind}, n long, children long, leaves long, saved long, ends binary, parent {kind}, parent_key binary, node_key binary"
    return f"{node}, part int, key binary, words array<int>, ns array<long>, leasts array<{kind}>, child array<long>, leaf array<long>, save array<long>, end array<binary>"


def _table(finished: list[tuple], lines: list[Item], part: int, kind: pa.DataType, keys: bool) -> pa.Table:
    ids, i64, raw = kind, pa.int64(), pa.binary()
    kinds = (pa.int32(), ids, i64, i64, i64, i64, raw, ids, raw, raw)
    digest = lambda x: None if x is None else hashlib.md5(x).digest()
    nodes = [(*f[:8], digest(f[8]), digest(f[9]) if keys else None) for f in finished]
    rows = [(x.key, x.words, x.n, x.least, x.children, x.leaves, x.saved, x.ends) for x in lines]
    many = (raw, pa.list_(pa.int32()), pa.list_(i64), pa.list_(ids), pa.list_(i64), pa.list_(i64), pa.list_(i64), pa.list_(raw))
    names = "depth conv_id n children leaves saved ends parent parent_key node_key part key words ns leasts child leaf save end".split()
    a, b = len(nodes), len(rows)
    columns = [pa.array([*(r[k] for r in nodes), *[None] * b], t) for k, t in enumerate(kinds)]
    columns.append(pa.array([*[None] * a, *[part] * b], pa.int32()))
    columns += [pa.array([*[None] * a, *(r[k] for r in rows)], t) for k, t in enumerate(many)]
    return pa.table(columns, names=names)


def _first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    items, kind = [], None
    for batch in batches:
        kind = batch.schema.field(3).type
        for key, words, n, first, ends in zip(*(c.to_pylist() for c in batch.columns)):
            zeros = len(words)
            items.append(Item(key, words, n=[*[0] * zeros, n], least=[*[None] * zeros, first], ends=[*[None] * zeros, ends]))
    if items:
        yield from _table(*grow(items, False), TaskContext.get().partitionId(), kind, False).to_batches(max_chunksize=10_000)


def _next_level(last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind = table.schema.field("leasts").type.value_type
        rows = sorted(table.drop_columns(["part"]).to_pylist(), key=lambda r: r["key"])
        items = [Item(r["key"], r["words"], n=r["ns"], least=r["leasts"], children=r["child"], leaves=r["leaf"], saved=r["save"], ends=r["end"]) for r in rows]
        return _table(*grow(items, last), key[0].as_py(), kind, True)

    return run


def prefix_trie(turns: DataFrame, part_turns: int = PART_TURNS, fan: int = FAN, parts: int | None = None) -> DataFrame:
    """One row for each distinct prefix of the conversations in turns (conv_id, turns array<struct<th, words>>), of conversation_turns():
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends (SHA-256 of the ids
    that end there, null for none)."""
    spark = turns.sparkSession
    kind = turns.schema["conv_id"].dataType.simpleString()
    th = F.transform("turns", lambda t: t["th"])
    sequences = written(turns.select("conv_id", F.unhex(F.array_join(th, "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")), "sequences")
    distinct = written(distinct_sequences(sequences), "distinct-sequences")
    if parts is None:
        total = distinct.agg(F.sum(F.size("words") + 1)).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / part_turns))
    sorted_ = distinct.select("key", "words", "n", "first", "ends").repartitionByRange(parts, "key").sortWithinPartitions("key")
    level = written(sorted_.mapInArrow(_first_level, _schema(kind)), "forests")
    levels = [level]
    top = level.agg(F.max("part")).first()[0]
    while top is not None:  # the lines of fan neighbours become one forest
        top //= fan
        lines = level.where("part is not null").select((F.col("part") / fan).cast("int").alias("group"), "part", "key", "words", "ns", "leasts", "child", "leaf", "save", "end")
        level = written(lines.groupBy("group").applyInArrow(_next_level(top == 0), _schema(kind)), "forests")
        levels.append(level)
        if top == 0:
            break
    names = ["depth", "conv_id", "n", "children", "leaves", "saved", "ends", "parent", "parent_key", "node_key"]
    nodes = levels[0].where("part is null").select(*names)
    for x in levels[1:]:
        nodes = nodes.unionByName(x.where("part is null").select(*names))
    met = nodes.where("node_key is not null").select(F.col("node_key").alias("__k"), F.col("conv_id").alias("__c"))
    both = nodes.join(met, nodes["parent_key"] == met["__k"], "left")
    return both.select("conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("parent", "__c").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_trie(with_shared_heads(conversation_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    return out.select(*out.columns[:-1], F.coalesce(F.lower(F.hex("ends")), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


OP12_SQL = r"""
WITH RECURSIVE own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS th,
         length(coalesce(text, '')) AS n_chars, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, 1 AS pos, 0 AS bit, 4294967295::BIGINT AS v FROM (SELECT DISTINCT c FROM own)
  UNION ALL
  SELECT c, CASE WHEN bit = 7 THEN pos + 1 ELSE pos END, (bit + 1) % 8, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT c, pos, bit, CASE WHEN bit = 0 THEN xor(v, ascii(substr(c::VARCHAR, pos, 1))::BIGINT) ELSE v END AS x FROM crc WHERE pos <= length(c::VARCHAR))),
heads AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE pos > length(c::VARCHAR)),
rebuilt AS (
  SELECT h.c, row_number() OVER (PARTITION BY h.c ORDER BY t.part, t.k) AS d, t.th, t.w
  FROM heads h JOIN (
    SELECT h.c, 0 AS part, o.k, o.th, o.w FROM heads h JOIN own o ON o.c = h.c - h.c % 20 AND o.k <= h.h
    UNION ALL SELECT h.c, 1, o.k, o.th, o.w FROM heads h JOIN own o ON o.c = h.c AND o.k > h.h) t ON t.c = h.c),
prefixes AS (
  SELECT c, d, string_agg(th, '') OVER (PARTITION BY c ORDER BY d) AS path, w, max(d) OVER (PARTITION BY c) AS most FROM rebuilt
  UNION ALL SELECT c, 0, '', 0, coalesce((SELECT max(d) FROM rebuilt r WHERE r.c = heads.c), 0) FROM heads),
nodes AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = most), '') AS ends
  FROM prefixes GROUP BY d, path),
children AS (SELECT left(path, 64 * (d - 1)::INT) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
subtree AS (
  SELECT left(b.path, 64 * a.d::INT) AS path, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.w) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM nodes) b JOIN (SELECT DISTINCT d FROM nodes) a ON a.d = b.up LEFT JOIN children k ON k.path = b.path GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.d > 0 AND p.path = left(n.path, 64 * (n.d - 1)::INT) LEFT JOIN children k ON k.path = n.path JOIN subtree s ON s.path = n.path
"""
