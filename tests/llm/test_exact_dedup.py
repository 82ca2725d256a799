"""Exact dedup and its filters: odd rows, classes over many batches, digests that meet without equal bytes."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetgraph.llm import exact_dedup, fuse

SCHEMA = "doc_id long, text string, batch int, tag long, digest string, n_bytes long, home int, bucket int"


def expected(rows):
    """Plain Python: {(id, text): (keep_id, group_size)} and the number of rows that stay."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    best = {k: (min(v, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(v)) for k, v in groups.items()}
    return {(i, t): best[re.sub(r"[\x20\x09-\x0D]", "", t or "")] for i, t in rows}, len(groups)


def check(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 0, 0, "x", 0, 0, 0) for i, t in rows], SCHEMA)
    got = exact_dedup.exact_dedup(docs, **how)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "digest"]
    want, classes = expected(rows)
    found = got.collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == collections.Counter((i, *want[i, t]) for i, t in rows)
    assert sum(r.kept for r in found) == classes
    return found


def test_odd_rows(spark):
    long = "word " * 200_000
    check(spark, [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\tb "), (5, None), (6, ""), (7, " \n"), (8, long), (9, long + " "), (10, "é"), (11, "é"), (12, "a b"), (None, "a   b   "), (None, "only"), (13, "ab"), (13, "ab"), (14, "A b")])


def test_an_empty_table(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_a_hot_class_and_many_batches(spark, batches):
    rows = [(k, "the same text" if k % 3 == 0 else f"text {k % 100}" + " " * (k % 5)) for k in range(600)]
    check(spark, rows, batches=batches, bucket_keys=16, least_buckets=3)


def test_equal_digests_of_unequal_bytes_stay_apart(spark):
    # the digest is the first letter; within a batch no two texts share it
    rows = [(k, f"{'abcdefgh'[k]}{k}") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    batch = {r.doc_id: r.b for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("b")).collect()}
    one, two = next(k for k in batch if batch[k] == 0), next(k for k in batch if batch[k] == 1)
    docs = spark.createDataFrame([(one, "x1"), (two, "x2")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs, batches=2, digest=lambda body: F.encode(F.substring(body, 1, 1), "UTF-8")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == sorted((k, k, 1, True) for k in (one, two))
    docs = spark.createDataFrame([(one, "x1"), (two, "x 1")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs, batches=2, digest=lambda body: F.encode(F.substring(body, 1, 1), "UTF-8")).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(two, 2)}


def test_drop_copies_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a ", "y"), (3, "b", None)], "doc_id long, text string, kept string")
    assert sorted(tuple(r) for r in exact_dedup.drop_copies(docs).collect()) == [(2, "a ", "y"), (3, "b", None)]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 64, 1000, 30_000])
def test_fuse_filters_hold_all_keys_and_few_others(n):
    draw = np.random.default_rng(n)
    keys, others = draw.integers(0, 1 << 63, n, dtype=np.uint64), draw.integers(0, 1 << 63, 100_000, dtype=np.uint64)
    blob = fuse.build(keys)
    assert fuse.contains(blob, keys).all()
    assert fuse.contains(blob, others).mean() < 1e-3
    assert len(blob) < 3.2 * n + 1000
