"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: One row in so many, at most, for keys that several rows share to be looked at apart from the others.
SPARSE = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary folder; on a
    cluster that would lose data with an executor, so there it is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc._conf.get("assetgraph.scratch")
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-scratch-")
        sc._conf.set("assetgraph.scratch", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: this cuts the lineage, so that a lost executor costs
    a re-read and not the whole computation, and what was written never changes. What was shuffled for it is deleted when
    it is there, as nothing reads that again."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the tables of written() that df reads, to free their disk. Only where all that was made of them has been written
    itself: a lost executor then has no use for them either. Other tables that df reads stay."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    shared = hadoop.Path(shared_dir(spark))
    fs = shared.getFileSystem(spark._jsc.hadoopConfiguration())
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        place = hadoop.Path(path)
        if place.getParent().equals(fs.makeQualified(shared)) and re.fullmatch(r".*-[0-9a-f]{12}", place.getName()):
            fs.delete(place, True)


def shared_keys(df: DataFrame, *keys: str) -> DataFrame | None:
    """(__h), hashes of the keys that several rows of df have; null where more than one row in SPARSE has such a key. Only hashes
    are moved, so a key that no other row has may be among them if its hash is, but none is missing."""
    seen = Observation()
    counts = df.select(F.xxhash64(*keys).alias("__h")).groupBy("__h").agg(F.count("*").alias("n")).observe(seen, F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("several"))
    found = written(counts.where("n > 1").select("__h"), "keys")
    return found if SPARSE * (seen.get["several"] or 0) <= (seen.get["rows"] or 0) else None


def with_shared_keys(df: DataFrame, found: DataFrame, *keys: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose keys are among those of shared_keys(), or with how left_anti the others."""
    return df.join(found, F.xxhash64(*keys) == F.col("__h"), how)
