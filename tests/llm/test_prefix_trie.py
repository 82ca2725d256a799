"""The prefix trie against plain Python: odd rows, hot conversations, any number of partitions and levels."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from assetgraph.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, words string, n long, depth string, ends string"


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return own, {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}


def trie(conversations):
    members = collections.defaultdict(set)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, (r.ends or hashlib.sha256(b"").digest()).hex()) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 1, "x", "x") for r in rows], SCHEMA)


def drawn(seed, n):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(3 * n), n):
        for t in range(draw.choice([1, 1, 2, 3, 6])):
            rows.append((c, t, "user", "hello there" if t == 0 and draw.random() < 0.6 else draw.choice(["a b c", "d e", "f", ""])))
    return rows


@pytest.mark.parametrize("seed, parts, fan", [(1, 1, 16), (2, 3, 2), (3, 9, 2), (4, 40, 3), (5, 7, 16)])
def test_random_conversations(spark, seed, parts, fan):
    rows = drawn(seed, 150)
    turns = prefix_trie.conversation_turns(frame(spark, rows))
    own, shared = rebuilt(rows)
    assert found(prefix_trie.prefix_trie(turns, parts=parts, fan=fan)) == trie(own)
    assert found(prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns), parts=parts, fan=fan)) == trie(shared)


def test_odd_rows(spark):
    rows = [(1, None, "user", "null turn first"), (1, 5, None, None), (1, 2, "user", ""), (2, 0, "user", "w " * 100_000), (None, 0, "user", "nobody"), (20, 0, "a", "x"), (20, 1, "a", "x"), (20, 1, "a", "x"), (21, 0, "a", "x"), (25, 0, "ab", "c"), (26, 0, "a", "bc"), (27, 0, "a", " \t\n"), (63, 0, "z", "no base")]
    own, shared = rebuilt(rows)
    turns = prefix_trie.conversation_turns(frame(spark, rows))
    assert found(prefix_trie.prefix_trie(turns)) == trie(own)
    assert any(not t for t in shared.values())  # a conversation can lose all its turns
    assert found(prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns))) == trie(shared)


def test_an_empty_table(spark):
    turns = prefix_trie.conversation_turns(frame(spark, [(None, 1, "a", "b")]))
    assert prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns)).collect() == []


def test_one_hot_conversation_is_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 500)
    rows = [(c, 0, "user", "the same") for c in range(1000)] + [(c, 1, "user", f"own {c}") for c in range(700, 1000)]
    own, _ = rebuilt(rows)
    assert found(prefix_trie.prefix_trie(prefix_trie.conversation_turns(frame(spark, rows)), parts=5, fan=2)) == trie(own)
