"""A corpus pipeline of five stages; each takes the documents that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. Empty tables pass through all stages; columns of other names
than doc_id, text and source are carried, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetgraph.llm.decontamination import drop_contaminated
from assetgraph.llm.mixing import mix_sources
from assetgraph.llm.ngram_join import drop_near_copies
from assetgraph.llm.quality_rules import filter_quality
from assetgraph.llm.scratch import written
from assetgraph.llm.sharding import shard_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, among them those whose text is null, empty or of fewer than ten words.
    Repeated rows and null ids are judged like others."""
    return filter_quality(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (one without an id only if none has one), and of
    rows that repeat it one. Null and empty texts are linked with nothing."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go, repeated ones and those without an id too. Null and empty texts stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times.

    Equal rows (id and text) are told apart by a number, so each gets a decision of its own. A null source is a source of its
    own. Texts without words take no share and stay as often as the whole part of their source's rate says."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    w = Window.partitionBy("__i", "__t")
    taken = mix_sources(docs, carry=[F.xxhash64("text").alias("__t")]).select(F.col("doc_id").alias("__i"), "__t", "copies")
    taken = taken.withColumn("__k", F.row_number().over(w.orderBy("copies"))).where("copies > 0").withColumnsRenamed({"__i": "__i2", "__t": "__t2"})
    rows = docs.select(F.col("doc_id").alias("__i"), F.xxhash64("text").alias("__t"), F.struct(*columns).alias("row"))
    rows = rows.withColumn("__n", F.row_number().over(w.orderBy("__i")))
    # the numbers are compared outside the join keys, so the texts are shuffled once
    both = rows.join(taken, F.col("__i").eqNullSafe(F.col("__i2")) & (F.col("__t") == F.col("__t2")) & (F.col("__n") - F.col("__k") == 0))
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, with the shard and the slot in it, which replace columns of these names. Repeated rows
    and rows with a null id have places of their own."""
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return shard_rows(docs, carry=[F.struct(*columns).alias("row")]).select("row.*", "shard", "slot")


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The mix draws by hashed chance and the n-gram join is too slow in SQL: tested by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
