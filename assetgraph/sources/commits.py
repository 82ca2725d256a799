"""Appends and published graphs that count once, whatever fails: data first, then a small numbered record.

A record is written under another name and renamed to its number, which fails if the number is taken. So of two writers
one gets it, and the other looks at the log again. Data without a record is no part of the log. The rename must be atomic
and must not overwrite, as HDFS and local disks do it; plain object stores do not.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetgraph.sources.events import EVENT, append_events

_RECORD = "number long, batch_id string, part string, first_seq long, events long"
_VERSION = "number long, version string, buckets int"
RETRIES = 20


def _claim(spark: SparkSession, folder: str, number: int, record: dict) -> bool:
    """Whether this writer made the record of that number."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    name, target = hadoop.Path(f"{folder}/.{uuid.uuid4().hex}"), hadoop.Path(f"{folder}/{number:012d}.json")
    fs = name.getFileSystem(conf)
    out = fs.create(name, False)
    out.write(json.dumps({"number": number, **record}).encode())
    out.close()
    # flags: none, so an existing record stays
    flags = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    files = hadoop.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf)
    try:
        files.rename(fs.makeQualified(name), fs.makeQualified(target), flags)
    except Exception:
        fs.delete(name, False)
        if not fs.exists(target):
            raise
        return False
    return True


def _records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(folder)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The committed events of a log. Parts without a record are skipped before they are read: part is a partition column."""
    parts = _records(spark, f"{path}/commits", _RECORD).select("part")
    try:
        data = spark.read.schema(f"{EVENT}, part string").option("basePath", f"{path}/data").parquet(f"{path}/data")
    except AnalysisException:
        return spark.createDataFrame([], EVENT)
    return data.join(parts, "part", "left_semi").drop("part")


def commit_events(new: DataFrame, path: str, batch_id: str, order: str = "ts") -> DataFrame:
    """The log at path after the events of new (all columns but seq) were added as batch_id. A batch that is on record already adds
    nothing, so a repeated one and foreachBatch may call this again. Two writers never share a number: who comes second
    numbers its events anew, and leaves out keys that the first has brought."""
    spark = new.sparkSession
    columns = [f.split()[0] for f in EVENT.split(", ")]
    for _ in range(RETRIES):
        records = _records(spark, f"{path}/commits", _RECORD)
        known = records.agg(F.count("*"), F.max(F.col("first_seq") + F.col("events")), F.count_if(F.col("batch_id") == batch_id)).first()
        if known[2]:
            return read_log(spark, path)
        part, first = uuid.uuid4().hex, known[1] or 0
        place = f"{path}/data/part={part}"
        append_events(new, read_log(spark, path), order, after=first).select(*columns).write.parquet(place)
        n = spark.read.schema(EVENT).parquet(place).count()
        if _claim(spark, f"{path}/commits", known[0], {"batch_id": batch_id, "part": part, "first_seq": first, "events": n}):
            return read_log(spark, path)
    raise RuntimeError(f"batch {batch_id}: other writers took {RETRIES} numbers in turn")


def publish_graph(nodes: DataFrame, edges: DataFrame, path: str, buckets: int | None = None) -> str:
    """Write a version of the graph, then make it the current one; readers of an older version keep theirs. Nodes are bucketed by
    id and edges by frm, so that joins on them move neither. buckets: by default as many as the session's shuffles have."""
    spark = nodes.sparkSession
    version, n = uuid.uuid4().hex, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df, name, key in ((nodes, "nodes", "id"), (edges, "edges", "frm")):
        # one task per bucket, so a bucket is one file
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{path}/versions/{version}/{name}").saveAsTable(f"graph_{name}_{version}")
    for _ in range(RETRIES):
        number = _records(spark, f"{path}/manifests", _VERSION).count()
        if _claim(spark, f"{path}/manifests", number, {"version": version, "buckets": n}):
            return version
    raise RuntimeError(f"graph {version}: other writers took {RETRIES} numbers in turn")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the current version, as tables that know their buckets, also in a session that did not write them."""
    last = _records(spark, f"{path}/manifests", _VERSION).orderBy(F.desc("number")).first()
    if last is None:
        raise FileNotFoundError(f"no graph was published at {path}")
    tables = []
    for name, key in (("nodes", "id"), ("edges", "frm")):
        table, place = f"graph_{name}_{last['version']}", f"{path}/versions/{last['version']}/{name}"
        if not spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(place).schema)
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {last['buckets']} BUCKETS LOCATION '{place}'")
        tables.append(spark.table(table))
    return tables[0], tables[1]
