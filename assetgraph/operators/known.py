"""Joins of new observations with what the graph already holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetgraph.functions import urls as U

CANDIDATE = "hyp:dns-candidate:"
# Attributes that mark an address as shared among tenants.
SHARED_TENANT = ("shared_tenant", "cdn_or_waf", "cdn", "cdn_provider", "provider", "fronted_by")


def drop_known(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates (fqdn, ...) that are neither a name nor a candidate in nodes (id)."""
    names = nodes.select(F.coalesce(*(F.when(F.col("id").startswith(p), F.substring("id", len(p) + 1, 1 << 20)) for p in ("dns:", CANDIDATE))).alias("fqdn")).where("fqdn is not null")
    return candidates.join(names, "fqdn", "left_anti")


def already_recorded(observations: DataFrame, recorded: DataFrame) -> DataFrame:
    """Observations (id, tool, sha256, ...) without those that recorded has: the same tool saw the same
    evidence of the same node before, so it is no new observation."""
    return observations.join(recorded.select("id", "tool", "sha256"), ["id", "tool", "sha256"], "left_anti")


def known_cnames(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(fqdn, cname): targets of cname_to edges and of the attribute cname_targets of names (fqdn, cname_targets)."""
    linked = edges.where("type = 'cname_to' and frm like 'dns:%'").select(F.substring("frm", 5, 1 << 20).alias("fqdn"), F.regexp_replace("to", "^dns:", "").alias("cname")).join(names.select("fqdn"), "fqdn", "left_semi")
    told = names.select("fqdn", F.explode("cname_targets").alias("cname"))
    both = linked.unionByName(told).select("fqdn", U.canonical_host(F.col("cname")).alias("cname"))
    return both.where(U.valid_fqdn(F.col("cname"))).distinct()


def ledger_key(hosts: DataFrame, edges: DataFrame) -> DataFrame:
    """hosts (ip, attrs, ...) with ledger_key: the registrable domain that a probe is charged to, by attribute, else
    by the first resolves_to edge (frm, to, type, seq) from a name; the address only where no name is known."""
    incoming = edges.where("type = 'resolves_to' and frm like 'dns:%'").groupBy(F.col("to").alias("__to")).agg(F.min_by("frm", "seq").alias("__frm"))
    told = F.coalesce(*(F.when(F.col("attrs")[k] != "", F.col("attrs")[k]) for k in ("fqdn", "resolved_from")))
    joined = hosts.join(incoming, F.concat(F.lit("host:"), F.col("ip")) == F.col("__to"), "left")
    by_edge = U.registrable_domain(F.substring("__frm", 5, 1 << 20))
    return joined.withColumn("ledger_key", F.coalesce(F.when(told.isNotNull(), U.registrable_domain(U.canonical_host(told))), by_edge, F.col("ip"))).drop("__to", "__frm")


def shared_tenant(hosts: DataFrame, edges: DataFrame) -> DataFrame:
    """hosts (ip, attrs, ...) with shared_tenant: one of the marking attributes is set, or a fronted_by edge leaves."""
    fronted = edges.where("type = 'fronted_by'").select(F.col("frm").alias("__frm"), F.lit(True).alias("__fronted")).distinct()
    marked = F.lit(False)
    for k in SHARED_TENANT:
        marked = marked | ~F.coalesce(F.col("attrs")[k], F.lit("")).isin("", "false", "null", '""', "0", "[]", "{}")
    joined = hosts.join(fronted, F.concat(F.lit("host:"), F.col("ip")) == F.col("__frm"), "left")
    return joined.withColumn("shared_tenant", marked | F.coalesce("__fronted", F.lit(False))).drop("__frm", "__fronted")


def orphan_guard(children: DataFrame, parents: DataFrame, parent: str, key: str = "id") -> DataFrame:
    """Children whose parent was emitted too; no edge or node hangs from something that is not there."""
    return children.join(parents.select(F.col(key).alias(parent)), parent, "left_semi")
