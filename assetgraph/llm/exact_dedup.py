"""Exact dedup of documents in batches, screened by static binary fuse filters.

Two texts are equal when they are the same after every character of [\\x20\\x09-\\x0D] is deleted. Of equal texts the row
with the most code points in the original text stays, of several the one with the smallest id.

A batch is first grouped by itself: rows of one digest (SHA-256 and length of the normalised text) are one class, with the
number of its rows, the best of them and one witness. Each batch that was added before is an immutable snapshot: its classes
in buckets by digest, and one static filter for each bucket. A new batch's classes meet the filters bucket by bucket; those
that no filter passes are new. The others join the exact buckets by the whole digest, and a match counts only if the
witnesses' normalised bytes are equal. Matched classes are counted for the class they match; the rest become the next
snapshot. So each digest is shuffled a fixed number of times, and texts only where two witnesses have to be compared.

A bucket holds about BUCKET_KEYS classes whatever the size of the input, so a filter and a task's work are bounded. Rows are
shuffled by digest only in partial aggregates and in the last join, where Spark splits skewed partitions.

Null texts count as empty; empty texts are equal. Null ids come last among ties; of rows that repeat in id and length, one
stays. Long texts pass through column functions only. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetgraph.llm import fuse
from assetgraph.llm.scratch import written

BATCHES = 4
BUCKET_KEYS = 1 << 18
#: At least so many buckets, to use a cluster on small inputs too.
LEAST_BUCKETS = 64
SPACE = " \t\n\x0b\x0c\r"
_KEY = ["digest", "n_bytes"]


def normalised(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    for c in SPACE:
        body = F.replace(body, F.lit(c), F.lit(""))
    return body


def digest_rows(docs: DataFrame, id_col: str, text_col: str, batches: int, digest=lambda body: F.unhex(F.sha2(body, 256))) -> DataFrame:
    """(batch, tag, id, digest, n_bytes, n_points, body): one row per row of docs; tag tells rows apart. Narrow."""
    rows = docs.select(docs[id_col].alias("id"), F.length(F.coalesce(docs[text_col], F.lit(""))).cast("long").alias("n_points"), normalised(docs[text_col]).alias("body"))
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"), F.monotonically_increasing_id().alias("tag"), "id", digest(F.col("body")).alias("digest"), F.octet_length("body").cast("long").alias("n_bytes"), "n_points", "body")


def _head(digests: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest, as a number."""
    return np.frombuffer(b"".join(x[:8].ljust(8, b"\0") for x in digests.to_pylist()), "<u8")


def _filter(key: tuple, table: pa.Table) -> pa.Table:
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([fuse.build(_head(table["digest"]))], pa.binary())})


def _screen(key: tuple, classes: pa.Table, filters: pa.Table) -> pa.Table:
    passed, heads = np.zeros(len(classes), bool), _head(classes["digest"])
    for blob in filters["blob"]:
        passed |= fuse.contains(blob.as_py(), heads)
    return classes.filter(pa.array(passed)).select(_KEY)


class Snapshots:
    """The store: add() batches of digest_rows(), read homes() and totals().

    rows: a stored table of digest_rows(), which holds the bytes that are compared."""

    def __init__(self, rows: DataFrame, buckets: int):
        self.rows, self.buckets = rows, buckets
        #: For each batch its classes (home, batch, digest, n_bytes, n, best, witness, bucket), home being the batch whose
        #: snapshot they belong to; the new ones among them, which are its snapshot; and the snapshot's filters.
        self.groups: list[DataFrame] = []
        self.snapshots: list[DataFrame] = []
        self.filters: list[DataFrame] = []

    def add(self, batch: int) -> None:
        best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "tag"))
        own = self.rows.where(F.col("batch") == batch).groupBy(*_KEY).agg(F.count("*").alias("n"), best.alias("best"), F.min("tag").alias("witness"))
        own = own.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int"))
        if self.snapshots:
            own = written(own, "classes")
            known = written(self._matches(own), "matches")
            own = own.join(known.withColumnsRenamed({"digest": "__d", "n_bytes": "__n"}), (F.col("digest") == F.col("__d")) & (F.col("n_bytes") == F.col("__n")), "left").drop("__d", "__n")
        else:
            own = own.withColumn("home", F.lit(None).cast("int"))
        own = own.select(F.coalesce("home", F.lit(batch)).alias("home"), F.lit(batch).alias("batch"), *_KEY, "n", "best", "witness", "bucket")
        # in buckets, sorted by digest, so that a read of few digests skips row groups
        self.groups.append(written(own.repartition("bucket").sortWithinPartitions("bucket", "digest"), "snapshot"))
        self.snapshots.append(self.groups[-1].where(F.col("home") == batch).select("bucket", *_KEY, "home", "witness"))
        self.filters.append(written(self.snapshots[-1].groupBy("bucket").applyInArrow(_filter, "bucket int, blob binary"), "filters"))

    def _matches(self, own: DataFrame) -> DataFrame:
        """(digest, n_bytes, home) of the classes whose bytes a snapshot holds."""
        filters, stored = self.filters[0], self.snapshots[0]
        for f, c in zip(self.filters[1:], self.snapshots[1:]):
            filters, stored = filters.unionByName(f), stored.unionByName(c)
        kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in _KEY)
        maybe = own.select("bucket", *_KEY).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_screen, kinds)
        held = stored.select(F.col("digest").alias("__d"), F.col("n_bytes").alias("__n"), "home", F.col("witness").alias("old"))
        pairs = maybe.join(held, (F.col("digest") == F.col("__d")) & (F.col("n_bytes") == F.col("__n"))).select(*_KEY, "home", "old")
        pairs = written(pairs.join(own.select(F.col("digest").alias("__d"), F.col("n_bytes").alias("__n"), "witness"), (F.col("digest") == F.col("__d")) & (F.col("n_bytes") == F.col("__n"))).select(*_KEY, "home", "old", "witness"), "pairs")
        # both texts of each pair, found by the rows' tags, which no two rows share
        wanted = pairs.select(*_KEY, "home", F.explode(F.array("old", "witness")).alias("__t"))
        bodies = wanted.join(self.rows.select("tag", "body"), F.col("__t") == F.col("tag"))
        same = bodies.groupBy(*_KEY, "home").agg((F.min("body") == F.max("body")).alias("same"))
        return same.where("same").groupBy(*_KEY).agg(F.min("home").alias("home"))

    def homes(self) -> DataFrame:
        """(home, batch, digest, n_bytes, n, best) over all batches."""
        out = self.groups[0]
        for g in self.groups[1:]:
            out = out.unionByName(g)
        return out.select("home", "batch", *_KEY, "n", "best")

    def totals(self) -> DataFrame:
        """(home, digest, n_bytes, group_size, best): a class over all batches."""
        return self.homes().groupBy("home", *_KEY).agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, bucket_keys: int = BUCKET_KEYS, least_buckets: int = LEAST_BUCKETS, **how) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, digest (SHA-256 of the normalised text)."""
    rows = written(digest_rows(docs, id_col, text_col, batches, **how), "digests", codec="zstd")
    store = Snapshots(rows, max(least_buckets, math.ceil(rows.count() / bucket_keys)))
    for k in range(batches):
        store.add(k)
    both = store.homes().drop("n", "best").join(store.totals(), ["home", *_KEY])
    both = written(both.select(F.col("batch").alias("__b"), F.col("digest").alias("__d"), F.col("n_bytes").alias("__n"), "group_size", "best"), "groups")
    own = rows.select("batch", "tag", "id", *_KEY)
    out = own.join(both, (F.col("digest") == F.col("__d")) & (F.col("n_bytes") == F.col("__n")) & (F.col("batch") == F.col("__b")))
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("tag") == F.col("best.tag")).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() drops, all columns kept; ids must be unique."""
    gone = exact_dedup(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("__gone")), "left_anti")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, first_value(doc_id) OVER w = doc_id AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
"""
