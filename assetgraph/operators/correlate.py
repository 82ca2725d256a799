"""Identity clusters: nodes that share a fingerprint.

Clusters over the size limit are reported, not expanded; sizes are known before any pair is made, so the
pairs per node are bounded by the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CLUSTER = 25
# Digests of the empty body.
TRIVIAL = ("", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "d41d8cd98f00b204e9800998ecf8427e")
# Signal, edge type, log-odds, in order of strength.
SIGNALS = [
    ("spki", "same_as", 2.4), ("response_hash", "same_as", 2.0), ("favicon_hash", "same_as", 1.6), ("default_404_hash", "same_as", 1.4), ("kid", "shared_trust_domain", 1.2), ("jarm", "co_deploy", 0.4),
    ("server", "co_deploy", 0.2),
]


def drop_trivial_fingerprints(df: DataFrame, column: str) -> DataFrame:
    value = F.lower(F.trim(F.col(column)))
    return df.withColumn(column, value).where(value.isNotNull() & ~value.isin(*TRIVIAL))


def cluster_sizes(prints: DataFrame) -> DataFrame:
    """(fingerprint, n, first_id) of fingerprints with two members or more, of rows (id, fingerprint)."""
    return prints.groupBy("fingerprint").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first_id")).where("n >= 2")


def cluster_pairs(prints: DataFrame, limit: int = MAX_CLUSTER) -> DataFrame:
    """(a, b, fingerprint) for all pairs a < b in clusters of up to limit members."""
    small = cluster_sizes(prints).where(F.col("n") <= limit).select("fingerprint")
    members = prints.select("id", "fingerprint").distinct().join(small, "fingerprint", "left_semi")
    other = members.select("fingerprint", F.col("id").alias("b"))
    return members.withColumnRenamed("id", "a").join(other, "fingerprint").where("a < b").select("a", "b", "fingerprint")


def oversized_clusters(prints: DataFrame, limit: int = MAX_CLUSTER) -> DataFrame:
    return cluster_sizes(prints).where(F.col("n") > limit)


#: Node types that carry fingerprints.
TYPES = ("WebApp", "Host", "Service")
#: What two agreeing body fingerprints add.
BONUS = 0.6


def node_prints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(signal, id, fingerprint) of nodes in scope (id, type, verdict, attrs) and their certificates: by attribute for
    the types that carry fingerprints, by presents_certificate edges for all."""
    scoped = nodes.where("verdict = 'in_scope'")
    names = [s for s, _, _ in SIGNALS if s not in ("spki", "kid")]
    text = lambda v: F.regexp_replace(v, r'^"(.*)"$', "$1")  # noqa: E731  values of a log are JSON text
    told = F.array(*(F.struct(F.lit(s).alias("signal"), F.lower(F.trim(text(F.col("attrs")[s]))).alias("fingerprint")) for s in names))
    kids = F.transform(F.from_json(F.col("attrs")["kids"], "array<string>"), lambda k: F.struct(F.lit("kid").alias("signal"), F.trim(k).alias("fingerprint")))
    typed = scoped.where(F.col("type").isin(*TYPES)).select("id", F.explode(F.concat(told, F.coalesce(kids, F.array().cast("array<struct<signal:string,fingerprint:string>>")))).alias("p")).select("p.signal", "id", "p.fingerprint")
    certs = edges.where("type = 'presents_certificate'").select(F.lit("spki").alias("signal"), F.col("frm").alias("id"), F.col("to").alias("fingerprint")).join(scoped.select("id"), "id", "left_semi")
    return typed.unionByName(certs).where(F.col("fingerprint").isNotNull() & ~F.col("fingerprint").isin(*TRIVIAL)).distinct()


def correlate(prints: DataFrame, limit: int = MAX_CLUSTER) -> DataFrame:
    """Rows (signal, id, fingerprint) -> edges (a, b, type, signal, log_odds), a < b: of each type the strongest signal of a
    pair. Icon and error-page clusters with the same members get BONUS."""
    spark = prints.sparkSession
    table = F.broadcast(spark.createDataFrame([(k, *s) for k, s in enumerate(SIGNALS)], "strength int, signal string, type string, log_odds double"))  # seven rows
    keyed = drop_trivial_fingerprints(prints.where("signal <> 'kid'"), "fingerprint").unionByName(prints.where("signal = 'kid'"))
    keyed = keyed.select("id", F.concat_ws("\x1f", "signal", "fingerprint").alias("fingerprint"))
    pairs = cluster_pairs(keyed, limit).withColumn("signal", F.substring_index("fingerprint", "\x1f", 1)).join(table, "signal")
    twice = corroborated_clusters(keyed, limit).withColumn("bonus", F.lit(BONUS))
    scored = pairs.join(twice, "fingerprint", "left").withColumn("log_odds", F.col("log_odds") + F.coalesce("bonus", F.lit(0.0)))
    w = Window.partitionBy("type", "a", "b").orderBy("strength", F.desc("log_odds"))
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("a", "b", "type", "signal", "log_odds")


def corroborated_clusters(keyed: DataFrame, limit: int = MAX_CLUSTER) -> DataFrame:
    """(fingerprint) of icon and error-page clusters that have one and the same set of members, of (id, signal and
    fingerprint in one). Sets are listed for clusters of up to limit members only: larger ones are never linked."""
    both = keyed.where(F.substring_index("fingerprint", "\x1f", 1).isin("favicon_hash", "default_404_hash"))
    small = cluster_sizes(both).where(F.col("n") <= limit).select("fingerprint")
    sets = both.join(small, "fingerprint", "left_semi").groupBy("fingerprint").agg(F.array_sort(F.collect_set("id")).alias("members"))
    sets = sets.withColumn("icon", F.col("fingerprint").startswith("favicon_hash"))
    shared = sets.groupBy("members").agg(F.count_if("icon").alias("icons"), F.count_if(~F.col("icon")).alias("pages")).where("icons > 0 and pages > 0").select("members")
    return sets.join(shared, "members", "left_semi").select("fingerprint")


def identity_edges(nodes: DataFrame, edges: DataFrame, limit: int = MAX_CLUSTER) -> DataFrame:
    """correlate() of a graph, in both directions: (type, frm, to, signal, log_odds)."""
    found = correlate(node_prints(nodes, edges), limit)
    both = F.explode(F.array(F.struct(F.col("a").alias("frm"), F.col("b").alias("to")), F.struct(F.col("b").alias("frm"), F.col("a").alias("to"))))
    return found.select("type", both.alias("e"), "signal", "log_odds").select("type", "e.frm", "e.to", "signal", "log_odds")
