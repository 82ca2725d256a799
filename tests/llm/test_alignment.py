"""Token alignment against plain Python over whole texts, and the minimal perfect hash."""

import collections
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetgraph.llm import alignment, perfect_hash, registry
from tests.test_queries import DIR

ODD = ["  two  spaces ", "a▁b", "a ▁ b c", "x\ny\n\nz  \n q", " lead", "trail ", "tab\t x\t y", "nb  x 　y", "<|endoftext|> hi <s> </s>", "\x00\x01 a", "é ü 日本語 テスト 🙂 🙂🙂", "a   b c\x1c d", "   ", "\n", "'s it's 'll", "ＡＢＣ ﬁ ① a", "", None, "the cat sat on the mat", "the cat sat on the mat"]


def expected(texts):
    """Whole texts encoded at once, aligned by dictionaries."""
    pair = alignment.tokenizers(alignment.TOKENIZER_A, alignment.TOKENIZER_B)
    found, count = [], collections.Counter()
    for text in texts:
        found.append(None)
        if not text:
            continue
        whole, ids = (" " + text).encode(), (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text))
        tables = (pair.bytes_a, pair.bytes_b)
        if any(b"".join(t[k] for k in x) != whole for t, x in zip(tables, ids)):
            continue
        ends = [dict(zip(np.cumsum([len(t[k]) for k in x]).tolist(), range(1, len(x) + 1))) for t, x in zip(tables, ids)]
        both, groups, i, j = sorted(ends[0].keys() & ends[1].keys()), [], 0, 0
        links = [(ids[0][ends[0][e] - 1], ids[1][ends[1][e] - 1]) for e in both]
        for e in both:
            groups.append(",".join(map(str, ids[0][i : ends[0][e]])) + "|" + ",".join(map(str, ids[1][j : ends[1][e]])))
            i, j = ends[0][e], ends[1][e]
        count.update(links)
        found[-1] = (len(ids[0]), len(ids[1]), links, ";".join(groups))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (x[0], x[1], len(x[2]), len(x[2]), sum(count[k] == most[k[1]] for k in x[2]), sum(count[k] for k in x[2]), x[3]) for x in found]


def aligned(docs, **how):
    return {r.doc_id: tuple(r)[1:] for r in alignment.align_tokens(docs, **how).collect()}


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts(spark, monkeypatch, small):
    if small:  # caches that overflow and chunks of a few characters or tokens give the same
        monkeypatch.setattr(alignment, "CHUNK", 10)
        monkeypatch.setattr(alignment, "TOKENS", 10)
        monkeypatch.setattr(alignment, "CACHE_WORDS", 3)
    texts = [*ODD, "word and " * 30_000]
    docs = spark.createDataFrame([(k, t, "x", 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, id string, pair long, groups string").repartition(7)
    assert aligned(docs, fan=2) == dict(enumerate(expected(texts)))


def test_ids_of_any_kind_and_an_empty_table(spark):
    docs = spark.createDataFrame([("a", "x y"), (None, "x y"), ("a", "x y")], "doc_id string, text string")
    got = alignment.align_tokens(docs)
    assert sorted((r.doc_id or "", r.n_a, r.count_sum) for r in got.collect()) == [("", 2, 6), ("a", 2, 6), ("a", 2, 6)]
    assert alignment.align_tokens(docs.where("false")).collect() == []
    assert [tuple(r)[1:] for r in alignment.align_tokens(docs.select("doc_id", F.lit(None).cast("string").alias("text"))).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")
def test_the_query(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(rows, expected([r.text for r in rows]))}
    got = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["op11_alignment"](spark, DIR).collect()}
    assert got == {k: (*x[:6], hashlib.sha256(x[6].encode()).hexdigest() if x[6] else "") for k, x in want.items()}


def test_ids_by_ranks_are_those_of_the_file():
    pair = alignment.tokenizers(alignment.TOKENIZER_A, alignment.TOKENIZER_B)
    assert pair.plain and pair.bound() < 500_000 and pair.fast is not None
    words = [" " + w for t in [*ODD, "the cat's 12345 <|endoftext|> résumé naïve"] for w in (t or "x").split(" ")]
    for some in (words, [w for w in words if len(w) > 1 and not w[1].isspace() and not w[-1].isspace()]):
        (flat, n), _ = pair.encode(some)
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [x.ids for x in pair.a.encode_batch(some, add_special_tokens=False)]


def test_without_ranks_and_cuts_the_result_is_the_same(spark, monkeypatch):
    texts = [t for t in ODD if t][:8]
    pair = alignment.tokenizers(alignment.TOKENIZER_A, alignment.TOKENIZER_B)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = alignment.Words(pair)
    before = [[x.tolist() for x in side] for side in words.ids(*words.of(texts))]
    monkeypatch.setattr(pair, "plain", False)
    monkeypatch.setattr(pair, "fast", None)
    words.clear()
    assert [[x.tolist() for x in side] for side in words.ids(*words.of(texts))] == before and docs.count() == 8


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_a_minimal_perfect_hash_numbers_its_keys_and_no_others(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 31, n))
    table = perfect_hash.PerfectHash([perfect_hash.build(keys[keys % 7 == k]) for k in range(7)])
    assert sorted(table.numbers(keys).tolist()) == list(range(len(keys))) and len(table) == len(keys)
    assert np.array_equal(table.keys[table.numbers(keys)], keys)
    for other in [x for x in (5, 1 << 33, 1 << 40) if x not in keys]:
        with pytest.raises(KeyError):
            table.numbers(np.array([other]))
