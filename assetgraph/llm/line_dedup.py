"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line without white space ([\\x20\\x09-\\x0D]) at both ends and with A-Z lower-cased; keys
under MIN_LENGTH code points are never duplicates. Documents come in batches. Each batch is aggregated to
(key hash, documents, largest id) and merge-joined with the runs stored so far: keys that no run knows
become a new run, the others go to the hit list. Runs are tables bucketed and sorted by the 128-bit key
hash, so a batch is shuffled once and the runs not at all; when a level holds FAN runs they are compacted into
one of the next level, so a batch meets a logarithmic number of them.

Keys found in at least MIN_DOCS documents lose their lines in all documents but the one with the largest id.

Null and empty texts are one empty line. Several rows with one id are one document for counting, each row
keeping its own lines. A null id counts as a document and is never the largest. Lines repeated inside a
document count once, and all of them go or stay. Extra columns are not read. An empty table gives an empty
table. Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetgraph.llm.scratch import written

MIN_LENGTH = 20
MIN_DOCS = 3
BATCHES = 4
FAN = 2
SPACE = " \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]


def line_keys(text: Column) -> Column:
    """Keys of all lines, in order. In the byte view of a text (each UTF-8 byte one Latin-1 character)
    lower() folds A-Z, and shifts the first byte of two-byte characters to values where it can still be
    told from the others by the number of bytes that follow: so keys are equal where they should be.
    Length counts exclude the bytes that continue a character."""
    bytes_ = F.lower(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))
    return F.transform(F.split(bytes_, "\n"), lambda x: F.btrim(x, F.lit(SPACE)))


def code_points(key: Column) -> Column:
    """Length in code points of a key of line_keys()."""
    return F.char_length(key) - F.regexp_count(key, F.lit("[\x80-\xbf]"))


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_length: int, batches: int) -> DataFrame:
    """(id, th, batch, pos, h1, h2): every line long enough."""
    body = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(body).alias("th"), F.pmod(F.xxhash64(docs[id_col]), F.lit(batches)).cast("int").alias("batch"), F.posexplode(line_keys(body)).alias("pos", "key"))
    rows = rows.where((F.char_length("key") >= min_length) & (code_points(F.col("key")) >= min_length))
    return rows.select("id", "th", "batch", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(77), "key").alias("h2"))


class LineRuns:
    """The store: add() batches of (h1, h2, n_docs, max_id), read totals()."""

    def __init__(self, spark: SparkSession, fan: int = FAN, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.hits: list[DataFrame] = []

    def _store(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{level}_{uuid.uuid4().hex[:12]}"
        rows.repartition(self.buckets, *_KEY).write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join the runs; the batch's new keys become a run of level 0."""
        joined, flags = batch, []
        for k, name in enumerate(self.runs()):
            run = self.spark.table(name).select(*_KEY, F.lit(True).alias(f"in{k}"))
            joined = joined.join(run.hint("merge"), _KEY, "left")
            flags.append(F.coalesce(f"in{k}", F.lit(False)))
        known = flags[0] if flags else F.lit(False)
        for flag in flags[1:]:
            known = known | flag
        if flags:
            parted = written(joined.select(*_KEY, "n_docs", "max_id", known.alias("known")), "line-batch")
            self.hits.append(parted.where("known").drop("known"))
            self._store(parted.where("not known").drop("known"), 0)
        else:
            self._store(batch, 0)
        self.compact()

    def compact(self) -> None:
        for level, names in enumerate(self.levels):
            if len(names) >= self.fan:
                both = self.spark.table(names[0])
                for name in names[1:]:
                    both = both.unionByName(self.spark.table(name))
                self.levels[level] = []
                self._store(both, level + 1)
                for name in names:
                    self.spark.sql(f"DROP TABLE {name}")

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, max_id) over all batches."""
        parts = [*map(self.spark.table, self.runs()), *self.hits]
        if not parts:
            raise ValueError("no batch was added")
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out.groupBy(*_KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_id").alias("max_id"))

    def drop(self) -> None:
        for name in self.runs():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """One row per row of docs: id_col, n_lines, n_dropped, kept_text."""
    spark = docs.sparkSession
    lines = written(line_rows(docs, id_col, text_col, min_length, batches), "lines")
    store = LineRuns(spark, fan)
    for k in range(batches):
        own = lines.where(F.col("batch") == k).groupBy(*_KEY, "id").agg(F.count("*").alias("n"))
        store.add(own.groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("max_id")))
    repeated = written(store.totals().where(F.col("n_docs") >= min_docs).select(*_KEY, "max_id"), "repeated-lines")
    store.drop()
    gone = lines.join(repeated, _KEY).where(~F.col("id").eqNullSafe(F.col("max_id"))).groupBy("id", "th").agg(F.collect_set("pos").alias("gone"))
    body = F.coalesce(F.col("body"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))
    rows = rows.withColumn("th", F.xxhash64(body))
    both = rows.join(gone.withColumnsRenamed({"id": "__i", "th": "__t"}), F.col("id").eqNullSafe(F.col("__i")) & (F.col("th") == F.col("__t")), "left")
    # split once, in a projection of its own: inside the lambda it would run for every line
    both = both.withColumn("split", F.split(body, "\n")).withColumn("n", F.size("split"))
    stay = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.array_join("split", "\n")).otherwise(F.array_join(F.transform(stay, lambda k: F.get(F.col("split"), k)), "\n"))
    return both.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
repeated AS (SELECT key, max(doc_id) AS largest FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND l.doc_id <> r.largest AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
