"""Extraction from collected probe results: DNS answers, connects, certificates."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from assetgraph.functions import urls as U
from assetgraph.operators import observe as O
from assetgraph.operators.known import CANDIDATE, drop_known, known_cnames, shared_tenant
from assetgraph.operators.extract import ENUMERATED, FINGERPRINTED, UNKNOWN, extractor, retainable
from assetgraph.operators.scope import bind_scope
from assetgraph.sources.shared import written

# Resolver and socket error names by outcome; most addresses, aliases, names and candidates kept.
NXDOMAIN = ("EAI_NONAME",)
NO_ADDRESS = ("EAI_NODATA", "EAI_ADDRFAMILY")
CLOSED = ("ECONNREFUSED", "ECONNRESET", "ECONNABORTED")
FILTERED = ("ETIMEDOUT",)
UNREACHABLE = ("EHOSTUNREACH", "ENETUNREACH", "EHOSTDOWN", "ENETDOWN")
MAX_ADDRESSES, MAX_ALIASES, MAX_SANS, MAX_CANDIDATES = 32, 16, 64, 32


def _ipv6(text: pd.Series) -> pd.Series:
    def one(x):
        try:
            return str(ipaddress.IPv6Address(x.strip()))
        except ValueError:
            return None

    return text.map(one, na_action="ignore")


def _ipv6_hex(text: pd.Series) -> pd.Series:
    return text.map(lambda x: ipaddress.IPv6Address(x).packed.hex(), na_action="ignore")


def canonical_addresses(answers: DataFrame) -> DataFrame:
    """(name, addresses) -> (name, ips, left_out): valid addresses, each once, by family and number, at most MAX_ADDRESSES, and
    how many more there were. Only IPv6 visits Python."""
    rows = answers.select("name", F.explode("addresses").alias("a")).select("name", F.trim("a").alias("a"))
    four = rows.where(U.is_ipv4(F.col("a"))).select("name", F.struct(F.lit(4).alias("family"), F.lpad(F.lower(F.hex(U.ipv4_number(F.col("a")))), 8, "0").alias("bytes"), F.col("a").alias("ip")).alias("x"))
    six = rows.where(F.col("a").contains(":")).withColumn("a", F.pandas_udf(_ipv6, "string")("a")).where("a is not null")
    six = six.select("name", F.struct(F.lit(6).alias("family"), F.pandas_udf(_ipv6_hex, "string")("a").alias("bytes"), F.col("a").alias("ip")).alias("x"))
    return four.unionByName(six).groupBy("name").agg(F.array_sort(F.collect_set("x")).alias("x")).select("name", F.transform(F.slice("x", 1, MAX_ADDRESSES), lambda e: e["ip"]).alias("ips"), F.greatest(F.size("x") - MAX_ADDRESSES, F.lit(0)).alias("left_out"))


def dns_outcome(errno):
    """resolved without an error, else what the resolver's error means; a flaky answer is never nxdomain."""
    return F.when(F.coalesce(errno, F.lit("")) == "", "resolved").when(errno.isin(*NXDOMAIN), "nxdomain").when(errno.isin(*NO_ADDRESS), "no_address").otherwise(F.concat(F.lit("error:gaierror:"), errno))


@extractor("resolver", "DNSName", "Host", "Hypothesis", rule_id="dns-resolution")
def dns_answers(answers: DataFrame, rules: DataFrame, nodes: DataFrame, edges: DataFrame, drops: Observation | None = None) -> DataFrame:
    """(name, canonical, aliases, addresses, errno) -> observations of names in scope.

    A resolved name stands with its addresses and aliases, as far as those are in scope too; a candidate among nodes
    (id, cname_targets) is corroborated. A known name that is gone but still points somewhere is a lead."""
    rows = U.with_idna(answers.withColumns({"name": U.canonical_host(F.col("name")), "outcome": dns_outcome(F.col("errno"))}), "name")
    rows = retainable(bind_scope(rows, "name", rules), drops=drops)
    rows = written(O.proved(rows, F.concat(F.lit("resolver:"), "name"), "name", "outcome", "canonical", "aliases", "addresses"), "answers")
    good = rows.where("outcome = 'resolved'")
    chain = F.transform(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))), U.canonical_host)
    good = U.with_idna(good.withColumn("chain", chain), "chain")
    alias = F.filter("chain", lambda x: (x != "") & (x != F.col("name")) & U.valid_fqdn(x))
    good = good.withColumn("cnames", F.slice(F.array_sort(F.array_distinct(alias)), 1, MAX_ALIASES))
    dns = U.dns_id(F.col("name"))
    # an address and an alias have verdicts of their own; their proof is the answer's
    answered = good.select("name", "proof", "region")
    ips = canonical_addresses(good).select("name", F.explode("ips").alias("ip")).join(answered, "name")
    ips = retainable(bind_scope(ips, "ip", rules))
    others = retainable(bind_scope(good.select("name", "proof", "region", F.explode("cnames").alias("cname")), "cname", rules))
    guess = F.concat(F.lit(CANDIDATE), F.col("name"))
    guessed = good.select("name", "verdict", "rule_matched", "proof", "region", guess.alias("id")).join(nodes.select("id"), "id", "left_semi")
    lost = rows.where("outcome = 'nxdomain'").select("name", dns.alias("id")).join(nodes.select("id", "cname_targets"), "id").select(F.col("name").alias("fqdn"), "cname_targets")
    gone = known_cnames(lost, edges).groupBy("fqdn").agg(F.array_sort(F.collect_set("cname")).alias("cnames"))
    gone = gone.join(rows.select(F.col("name").alias("fqdn"), "verdict", "rule_matched", "proof", "region"), "fqdn")
    probed = F.lit(True)
    return O.union_observations(
        O.nodes(good, "DNSName", dns, 2.0, ENUMERATED, active_probed=probed, cname_targets=F.when(F.size("cnames") > 0, F.col("cnames"))),
        O.nodes(ips, "Host", U.host_id(F.col("ip")), 2.0, UNKNOWN, active_probed=probed), O.edges(ips, "resolves_to", dns, U.host_id(F.col("ip")), 2.0, active_probed=probed),
        O.nodes(others, "DNSName", U.dns_id(F.col("cname")), 1.0, UNKNOWN, active_probed=probed), O.edges(others, "cname_to", dns, U.dns_id(F.col("cname")), 2.0, active_probed=probed),
        O.edges(guessed, "corroborates", F.col("id"), dns, 2.0, active_probed=probed, promotion=F.lit("dns-candidate->DNSName")),
        O.nodes(
            gone, "Hypothesis", U.hypothesis_id(F.lit("dangling-cname"), F.col("fqdn")), -0.5, UNKNOWN, dangling_fqdn=F.col("fqdn"), cname_targets=F.col("cnames"), candidate_class=F.lit("subdomain-takeover"), detection_only=F.lit(True),
            active_probed=probed,
        ),
    )


def connect_outcome(errno):
    return F.when(F.coalesce(errno, F.lit("")) == "", "open").when(errno.isin(*CLOSED), "closed").when(errno.isin(*FILTERED), "filtered").when(errno.isin(*UNREACHABLE), "unreachable").otherwise(F.concat(F.lit("error:"), errno))


@extractor("port_scan", "Service", rule_id="tcp-connect-scan")
def service_observations(connects: DataFrame, hosts: DataFrame, edges: DataFrame, rules: DataFrame, drops: Observation | None = None) -> DataFrame:
    """(ip, port, proto, outcome) -> a service for each open port of an address in scope, hosted on its host where hosts (ip, attrs)
    has it. Services on addresses that tenants share say so. The proof of an address is the list of its ports and outcomes."""
    proto = F.lower("proto").alias("proto")
    scans = connects.groupBy("ip").agg(F.array_sort(F.collect_set(F.struct("port", proto, "outcome"))).alias("ports"))  # of one address
    scans = O.proved(retainable(bind_scope(scans, "ip", rules), drops=drops), F.concat(F.lit("port_scan:"), "ip"), "ip", "ports").drop("ports")
    found = written(connects.where("outcome = 'open'").select("ip", "port", proto).distinct().join(scans, "ip"), "services")
    probed = F.lit(True)
    told = shared_tenant(found.join(hosts.select("ip", "attrs"), "ip", "left"), edges)
    sid = U.service_id(F.col("ip"), F.col("port"), F.col("proto"))
    hosted = found.join(hosts.select("ip"), "ip", "left_semi")
    return O.union_observations(O.nodes(told, "Service", sid, 2.0, ENUMERATED, active_probed=probed, state=F.lit("open"), ip=F.col("ip"), port=F.col("port"), proto=F.col("proto"), shared_tenant=F.when(F.col("shared_tenant"), F.lit(True))), O.edges(hosted, "hosted_on", sid, U.host_id(F.col("ip")), 2.0, active_probed=probed))


def certificate_names(certs: DataFrame) -> DataFrame:
    """certs with host canonical, sans (DNS names, sorted, at most MAX_SANS), n_left_out (how many more there were) and
    n_mail_dropped; mail addresses stay nowhere."""
    mail = F.size(F.filter("sans", lambda x: (F.lower(x["kind"]) == "email") | x["value"].contains("@")))
    names = F.transform(F.filter("sans", lambda x: (F.lower(x["kind"]) == "dns") & ~x["value"].contains("@")), lambda x: U.canonical_host(F.regexp_replace(F.trim(x["value"]), r"^\*\.", "")))
    rows = certs.withColumns({"host": U.canonical_host(F.col("host")), "n_mail_dropped": mail, "names": names}).drop("sans")
    rows = U.with_idna(U.with_idna(rows, "host"), "names")
    rows = rows.withColumn("names", F.array_sort(F.array_distinct(F.filter("names", U.valid_fqdn))))
    return rows.withColumns({"n_left_out": F.greatest(F.size("names") - MAX_SANS, F.lit(0)), "names": F.slice("names", 1, MAX_SANS)}).withColumnRenamed("names", "sans")


@extractor("tls_probe", "WebApp", "Certificate", "Hypothesis", rule_id="tls-certificate")
def tls_observations(certs: DataFrame, rules: DataFrame, nodes: DataFrame, drops: Observation | None = None) -> DataFrame:
    """(host, serial, not_before, not_after, sans, der, tls_version) -> web applications, their certificates, and
    candidates: names on a certificate that are new and in scope, at most MAX_CANDIDATES of each host's by name."""
    rows = retainable(bind_scope(certificate_names(certs), "host", rules), drops=drops)
    rows = O.proved(rows, F.concat(F.lit("tls_probe:"), "host"), "host", "serial", "not_before", "not_after", "sans", "tls_version", F.sha2("der", 256).alias("der"))
    rows = written(rows, "certificates")
    stamp = lambda c: F.date_format(F.coalesce(F.try_to_timestamp(F.regexp_replace(c, r"\s+", " "), F.lit("MMM d HH:mm:ss yyyy z")), F.col(c).try_cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    app, cert = U.webapp_id(F.lit("https"), F.col("host")), U.certificate_id(F.col("der"))
    held = rows.where("der is not null")
    names = rows.select("host", F.explode("sans").alias("fqdn")).where("fqdn <> host").distinct()
    fresh = retainable(bind_scope(drop_known(names, nodes), "fqdn", rules))
    first = fresh.withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy("fqdn"))).where(F.col("k") <= MAX_CANDIDATES).groupBy("fqdn").agg(F.min("host").alias("host"), F.first("verdict").alias("verdict"), F.first("rule_matched").alias("rule_matched"))
    first = first.join(rows.groupBy("host").agg(F.min_by(F.struct("proof", "region"), F.col("proof")[0]).alias("p")), "host").select("fqdn", "verdict", "rule_matched", "p.*")
    probed = F.lit(True)
    return O.union_observations(
        O.nodes(
            rows, "WebApp", app, 2.0, FINGERPRINTED, active_probed=probed, vhost=F.col("host"), scheme=F.lit("https"), serial=F.col("serial"), not_before=stamp("not_before"), not_after=stamp("not_after"), tls_version=F.col("tls_version"),
            tls_sans=F.when(F.size("sans") > 0, F.col("sans")), mail_names_dropped=F.when(F.col("n_mail_dropped") > 0, F.col("n_mail_dropped")),
        ),
        O.nodes(held, "Certificate", cert, 2.0, FINGERPRINTED, serial=F.col("serial"), not_before=stamp("not_before"), not_after=stamp("not_after"), keyed_on=F.lit("der_sha256"), active_probed=probed), O.edges(held, "presents_certificate", app, cert, 0.0),
        O.nodes(first, "Hypothesis", F.concat(F.lit(CANDIDATE), F.col("fqdn")), -0.5, UNKNOWN, candidate_fqdn=F.col("fqdn"), generator=F.lit("san-pivot"), active_probed=probed),
    )
