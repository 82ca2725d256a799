"""Queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetgraph.functions import confidence as C
from assetgraph.functions import urls as U
from assetgraph.operators import audit, contracts, correlate, extract, fold, gaps, known, observe, report, scope
from assetgraph.sources import events as E
from assetgraph.sources.shared import discard, written

INCLUDE, EXCLUDE, PREFILTER = ["*.example.com", "*.example.org"], ["*.spam-farm.example.org"], ["*.example.net"]
NETWORKS = ["10.0.0.0/8", "100.0.0.0/6", "192.0.0.0/3"]
NOW = "2026-01-10 00:00:00"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", "url", U.scheme_of(url).alias("scheme"), U.canonical_host(U.netloc_of(url)).alias("host"), U.path_of(url).alias("path"))


#: The same parsing in SQL, for the oracles.
_URLS = r"""
u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 1)) AS scheme,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2)), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS host,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3) AS path FROM pages)"""
_OPAQUE = r"""(regexp_matches(s, '^[0-9]+$') OR regexp_matches(lower(s), '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') OR regexp_matches(lower(s), '^[0-9a-f]{16,}$')
  OR regexp_matches(s, '^[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}$') OR regexp_matches(s, '^[A-Za-z0-9_-]{40,}$') OR (regexp_matches(s, '^[A-Za-z0-9]{20,}$') AND regexp_matches(s, '[0-9]')))"""
_TEMPLATES = rf"""
p AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM u),
t AS (SELECT *, CASE WHEN regexp_matches(path, '^[\x21-\x7e]*$') AND NOT contains(path, '@') AND len(segs) <= 12 AND length('/' || array_to_string(list_transform(segs, lambda s: CASE WHEN {_OPAQUE} THEN '{{id}}' ELSE s END), '/')) <= 200
  THEN '/' || array_to_string(list_transform(segs, lambda s: CASE WHEN {_OPAQUE} THEN '{{id}}' ELSE s END), '/') ELSE '' END AS template FROM p)"""
_VERDICT = """CASE WHEN host LIKE '%.spam-farm.example.org' OR host = 'spam-farm.example.org' THEN 'out_of_scope'
  WHEN host LIKE '%.example.com' OR host = 'example.com' OR host LIKE '%.example.org' OR host = 'example.org' THEN 'in_scope'
  WHEN host LIKE '%.example.net' OR host = 'example.net' THEN 'prefilter_only' ELSE 'out_of_scope' END"""


@query(rf"""WITH {_URLS}, {_TEMPLATES},
ok AS (SELECT scheme, host, template, lpad(CAST(page_id AS VARCHAR), 14, '0') AS ts, 'web:' || scheme || '://' || host AS app FROM t WHERE scheme IN ('http', 'https') AND template <> '' AND {_VERDICT} = 'in_scope'),
r AS (SELECT *, CASE WHEN host LIKE '%.example.com' OR host = 'example.com' THEN 'included by ''*.example.com''' ELSE 'included by ''*.example.org''' END AS rule_matched FROM ok)
SELECT app AS id, 'WebApp' AS type, host, scheme, '' AS template, min(ts) AS archived_timestamp, rule_matched FROM r GROUP BY ALL
UNION ALL SELECT 'route:' || app || template, 'Route', host, scheme, template, min(ts), rule_matched FROM r GROUP BY app, host, scheme, template, rule_matched""")
def archive_routes(spark, sf_dir):
    return extract.archive_routes(page_captures(spark, sf_dir), scope.scope_rules(spark, INCLUDE, EXCLUDE, PREFILTER))


def page_captures(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("url").alias("original"), F.lpad(F.col("page_id").cast("string"), 14, "0").alias("timestamp"))


@query(rf"""WITH {_URLS}, {_TEMPLATES},
ok AS (SELECT 'web:' || scheme || '://' || host AS app, 'route:web:' || scheme || '://' || host || template AS route, lpad(CAST(page_id AS VARCHAR), 14, '0') AS ts FROM t WHERE scheme IN ('http', 'https') AND template <> '' AND {_VERDICT} = 'in_scope')
SELECT 'node' AS kind, app AS id, 'WebApp' AS type, NULL AS frm, NULL AS "to", '"' || min(ts) || '"' AS stamp FROM ok GROUP BY app
UNION ALL SELECT 'node', route, 'Route', NULL, NULL, '"' || min(ts) || '"' FROM ok GROUP BY route
UNION ALL SELECT DISTINCT 'edge', 'exposes:' || app || '->' || route, 'exposes', app, route, NULL FROM ok""")
def archive_observations(spark, sf_dir):
    found = extract.archive_observations(page_captures(spark, sf_dir), scope.scope_rules(spark, INCLUDE, EXCLUDE, PREFILTER))
    return found.select("kind", "id", "type", "frm", "to", F.col("attrs")["archived_timestamp"].alias("stamp"))


_VALID = r"regexp_matches(host, '^([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]*[a-z0-9])?$')"


@query(rf"""WITH {_URLS}, h AS (SELECT DISTINCT host, {_VERDICT} AS verdict FROM u WHERE {_VALID})
SELECT 'dns:' || host AS id, 'kept' AS outcome FROM h WHERE verdict = 'in_scope' UNION ALL SELECT 'dns:' || host, verdict FROM h WHERE verdict <> 'in_scope'""")
def certificate_names(spark, sf_dir):
    """A certificate per page that names its host, also as a wildcard, and a mail address; logged by registrable domain."""
    logged = page_certificates(spark, sf_dir)
    rules = scope.scope_rules(spark, INCLUDE, EXCLUDE, PREFILTER)
    kept = extract.ct_names(logged, rules).select("id", F.lit("kept").alias("outcome"))
    return kept.unionByName(extract.ct_drops(logged, rules).select(F.concat(F.lit("dns:"), "host").alias("id"), F.col("verdict").alias("outcome")))


@query(rf"""WITH {_URLS}, h AS (SELECT host, {_VERDICT} AS verdict, count(DISTINCT scheme) AS n FROM u WHERE {_VALID} GROUP BY ALL)
SELECT 'dns:' || host AS id, 'host' AS kind, TRUE AS wildcard, 2 + n AS n_spellings, verdict FROM h""")
def seed_verdicts(spark, sf_dir):
    """The hosts of pages as seeds in several spellings, with comments between them."""
    host = F.col("host")
    spelled = F.array(F.concat(F.upper(host), F.lit(".")), F.concat(F.lit("*."), host), F.concat("scheme", F.lit("://"), host, F.lit("/x")), F.concat(F.lit("# "), host))
    seeds = page_hosts(spark, sf_dir).select(F.explode(spelled).alias("value"))
    found = extract.ingest_seeds(seeds, scope.scope_rules(spark, INCLUDE, EXCLUDE, PREFILTER))
    return found.select("id", "kind", "wildcard", F.size("spellings").cast("long").alias("n_spellings"), "verdict")


@query(rf"""WITH {_URLS}, q AS (SELECT page_id, scheme, host, path, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda s: s <> '')) AS args FROM u)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(args) = 0 THEN '' ELSE '?' || array_to_string(args, '&') END AS canonical_url FROM q""")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical_url"))


@query(rf"""WITH {_URLS}, d AS (SELECT CASE WHEN len(string_split(host, '.')) <= 2 THEN host ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS registrable, host FROM u)
SELECT registrable, count(*) AS n_pages, count(DISTINCT host) AS n_hosts FROM d GROUP BY registrable""")
def registrable_domains(spark, sf_dir):
    hosts = page_hosts(spark, sf_dir)
    return hosts.groupBy(U.registrable_domain(F.col("host")).alias("registrable")).agg(F.count("*").alias("n_pages"), F.count_distinct("host").alias("n_hosts"))


@query(rf"WITH {_URLS}, {_TEMPLATES} SELECT page_id, template FROM t")
def path_templates(spark, sf_dir):
    return page_hosts(spark, sf_dir).select("page_id", U.path_template(F.col("path")).alias("template"))


@query(rf"""WITH {_URLS}, {_TEMPLATES}, w AS (SELECT *, 'web:' || scheme || '://' || host AS app, ['10', CAST(page_id // 256 % 256 AS VARCHAR), CAST(page_id % 256 AS VARCHAR), '1'] AS quad, page_id % 3 AS m FROM t),
o AS (SELECT *, array_to_string(quad, '.') AS ip, 'op:' || CASE m WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'HEAD' END || ':route:' || app || template AS op FROM w)
SELECT page_id, 'dns:' || host AS dns_id, 'domain:' || array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain_id, app || CASE WHEN m = 0 THEN '' WHEN m = 1 THEN ':8443' WHEN scheme = 'https' THEN '' ELSE ':443' END AS webapp_id, 'host:' || ip AS host_id,
'svc:' || ip || ':' || (page_id % 9) || '/tcp' AS service_id, op AS operation_id, 'param:' || op || '#query:p' || m AS parameter_id, 'cert:' || sha256(host) AS certificate_id, 'hyp:dns-candidate:' || host AS hypothesis_id,
regexp_matches(host, '^([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]*[a-z0-9])?$') AS valid FROM o""")
def node_ids(spark, sf_dir):
    """Every id of a page's host, route and the things made up from its number."""
    host, scheme, n = F.col("host"), F.col("scheme"), F.col("page_id")
    pages = page_hosts(spark, sf_dir).withColumn("template", U.path_template(F.col("path")))
    ip = F.concat(F.lit("10."), (F.floor(n / 256) % 256).cast("string"), F.lit("."), (n % 256).cast("string"), F.lit(".1"))
    port = F.when(n % 3 == 1, 8443).when(n % 3 == 2, 443)
    operation = U.operation_id(F.when(n % 3 == 0, "get").when(n % 3 == 1, "Post").otherwise("HEAD"), U.route_id(U.webapp_id(scheme, host), F.col("template")))
    return pages.select(
        "page_id", U.dns_id(host).alias("dns_id"), U.domain_id(host).alias("domain_id"), U.webapp_id(scheme, host, port).alias("webapp_id"), U.host_id(ip).alias("host_id"), U.service_id(ip, n % 9, F.lit("TCP")).alias("service_id"), operation.alias("operation_id"),
        U.parameter_id(operation, F.concat(F.lit("p"), (n % 3).cast("string")), F.lit("Query")).alias("parameter_id"), U.certificate_id(host.cast("binary")).alias("certificate_id"), U.hypothesis_id(F.lit("dns-candidate"), host).alias("hypothesis_id"), U.valid_fqdn(host).alias("valid"),
    )


_EMAIL_SQL = C.EMAIL.replace("'", "''")


@query(f"""WITH f AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_EMAIL_SQL}') AS found FROM documents),
r AS (SELECT doc_id, text, found, list_reduce(list_prepend(text, found), lambda acc, x: replace(acc, x, '…+' || substr(sha256(x), 1, 16))) AS loose FROM f)
SELECT doc_id, CAST(len(found) AS BIGINT) AS n_found, length(regexp_replace(text, '{_EMAIL_SQL}', '', 'g')) + 18 * len(found) AS n_chars_left,
  array_to_string(list_transform(found, lambda x: '…+' || substr(sha256(x), 1, 16)), ' ') AS marks FROM r""")
def pii_minimise(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    safe = C.minimise_pii(F.col("text"))
    return docs.select("doc_id", C.pii_count(F.col("text")).alias("n_found"), F.char_length(safe).cast("long").alias("n_chars_left"), F.array_join(F.regexp_extract_all(safe, F.lit("…\\+[0-9a-f]{16}"), F.lit(0)), " ").alias("marks"))


_SECRET_SQL = r"^(?:ey[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{4,}|[A-Za-z0-9+/]{32,}={0,2}|[0-9a-fA-F]{32,})$"


@query(rf"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '["\s]')) AS word FROM documents)
SELECT doc_id, count(*) AS n_secrets, string_agg(DISTINCT substr(word, 1, 4) || '…+' || substr(sha256(word), 1, 16), ' ' ORDER BY substr(word, 1, 4) || '…+' || substr(sha256(word), 1, 16)) AS redacted
FROM w WHERE regexp_matches(word, '{_SECRET_SQL}') GROUP BY doc_id""")
def secret_redact(spark, sf_dir):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r'["\s]'), lambda x: x.rlike(C.SECRET))
    found = table(spark, sf_dir, "documents").select("doc_id", words.alias("words")).where(F.size("words") > 0)
    return found.select("doc_id", F.size("words").cast("long").alias("n_secrets"), F.array_join(F.array_sort(F.array_distinct(C.redact_secret_shaped(F.col("words")))), " ").alias("redacted"))


_IP_SQL = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
_IPV4_SQL = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"


def document_addresses(spark, sf_dir):
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_IP_SQL), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("value"))


@query(rf"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_IP_SQL}')) AS value FROM documents)
SELECT doc_id, value, CASE WHEN regexp_matches(value, '{_IPV4_SQL}') THEN 'ip' ELSE 'host' END AS kind,
  CASE WHEN regexp_matches(value, '{_IPV4_SQL}') THEN CAST(split_part(value, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(value, '.', 2) AS BIGINT) * 65536 + CAST(split_part(value, '.', 3) AS BIGINT) * 256 + CAST(split_part(value, '.', 4) AS BIGINT) END AS number FROM a""")
def ip_classify(spark, sf_dir):
    kind = U.classify_value(F.col("value"))
    return document_addresses(spark, sf_dir).select("doc_id", "value", kind.alias("kind"), F.when(kind == "ip", U.ipv4_number(F.col("value"))).cast("long").alias("number"))


@query(rf"""WITH {_URLS} SELECT page_id, host, {_VERDICT} AS verdict, {_VERDICT} = 'in_scope' AS actionable FROM u""")
def scope_verdicts(spark, sf_dir):
    bound = scope.bind_scope(page_hosts(spark, sf_dir).select("page_id", "host"), "host", scope.scope_rules(spark, INCLUDE, EXCLUDE, PREFILTER))
    return scope.scope_check(bound).select("page_id", "host", "verdict", "actionable")


@query(rf"WITH {_URLS} SELECT {_VERDICT} AS verdict, count(*) AS n FROM u GROUP BY 1")
def verdict_histogram(spark, sf_dir):
    return scope.verdict_histogram(scope.bind_scope(page_hosts(spark, sf_dir).select("host"), "host", scope.scope_rules(spark, INCLUDE, EXCLUDE, PREFILTER)))


@query(rf"""WITH a AS (SELECT DISTINCT value FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{_IP_SQL}')) AS value FROM documents) WHERE regexp_matches(value, '{_IPV4_SQL}')),
n AS (SELECT value, CAST(split_part(value, '.', 1) AS INT) AS o FROM a)
SELECT value, CASE WHEN o BETWEEN 224 AND 239 THEN 'out_of_scope' WHEN o = 10 OR o BETWEEN 100 AND 103 OR o >= 192 THEN 'in_scope' ELSE 'out_of_scope' END AS verdict,
  CASE WHEN o BETWEEN 224 AND 239 THEN 'excluded by ''224.0.0.0/4''' WHEN o = 10 THEN 'included by ''10.0.0.0/8''' WHEN o BETWEEN 100 AND 103 THEN 'included by ''100.0.0.0/6''' WHEN o >= 192 THEN 'included by ''192.0.0.0/3'''
  ELSE 'not matched by any include rule (default deny)' END AS rule_matched FROM n""")
def cidr_verdicts(spark, sf_dir):
    rules = scope.scope_rules(spark, NETWORKS, ["224.0.0.0/4"])
    ips = document_addresses(spark, sf_dir).select("value").where(U.is_ipv4(F.col("value"))).distinct()
    return scope.bind_scope(ips, "value", rules).select("value", "verdict", "rule_matched")


@query("""WITH v AS (SELECT s_suppkey AS k, s_nationkey AS n, printf('2001:db8:%x::%x', s_nationkey, s_suppkey) AS value, 128 AS len FROM supplier
UNION ALL SELECT s_suppkey, s_nationkey, printf('2001:db8:%x::/%d', s_nationkey, 32 + s_suppkey % 33), 32 + s_suppkey % 33 FROM supplier),
w AS (SELECT DISTINCT value, len, CASE WHEN len >= 48 THEN n WHEN len > 32 THEN (n // CAST(2 ** (48 - len) AS BIGINT)) * CAST(2 ** (48 - len) AS BIGINT) ELSE 0 END AS lo, CASE WHEN len >= 48 THEN n WHEN len > 32 THEN (n // CAST(2 ** (48 - len) AS BIGINT) + 1) * CAST(2 ** (48 - len) AS BIGINT) - 1 ELSE 65535 END AS hi FROM v)
SELECT value, CASE WHEN (lo <= 3 AND hi >= 3) OR (lo <= 7 AND hi >= 4) THEN 'out_of_scope' WHEN hi <= 15 THEN 'in_scope' WHEN lo >= 16 AND hi <= 19 THEN 'prefilter_only' ELSE 'out_of_scope' END AS verdict FROM w""")
def ipv6_verdicts(spark, sf_dir):
    """Addresses and networks of suppliers: one /48 of each nation, and networks around it of /32 to /64."""
    rules = scope.scope_rules(spark, ["2001:DB8::/44"], ["2001:db8:3::/48", "2001:db8:0004::/46"], ["2001:db8:10::/46"])
    nation, own = F.lower(F.hex("s_nationkey")), F.lower(F.hex("s_suppkey"))
    base = F.concat(F.lit("2001:db8:"), nation, F.lit("::"))
    rows = table(spark, sf_dir, "supplier").select(F.explode(F.array(F.concat(base, own), F.concat(base, F.lit("/"), (32 + F.col("s_suppkey") % 33).cast("string")))).alias("value")).distinct()
    return scope.bind_scope(rows, "value", rules).select("value", "verdict")


def observations(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("host:"), F.col("user_id").cast("string")).alias("id"), F.lit("Host").alias("type"), F.col("event_type").alias("tool"), F.lit("r1").alias("rule_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("attrs"),
    )


_OBS = """o AS (SELECT event_id AS seq, 'host:' || user_id AS id, event_type AS tool, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, json_extract_string(props, '$.k') AS k FROM events),
b AS (SELECT *, first_value(k) OVER (PARTITION BY id ORDER BY seq) AS k0 FROM o)"""


@query(f"""WITH {_OBS} SELECT id, any_value(k0) AS k, count(DISTINCT tool) AS n_sources, round(0.8::DOUBLE * (count(DISTINCT tool) - 1), 9) AS log_odds, arg_min(ts, seq) AS first_seen, arg_max(ts, seq) AS last_seen, count(*) AS observations
FROM b WHERE k = k0 GROUP BY id""")
def graph_project(spark, sf_dir):
    base = fold.project_graph(observations(spark, sf_dir)).where("fork = 0")
    return base.select("id", F.col("attrs")["k"].alias("k"), F.size("sources").cast("long").alias("n_sources"), F.round("log_odds", 9).alias("log_odds"), "first_seen", "last_seen", "observations")


@query(f"""WITH {_OBS} SELECT id || '#fork' || row_number() OVER (PARTITION BY id ORDER BY seq) AS id, id AS base, k, ts AS first_seen FROM b WHERE k <> k0""")
def graph_forks(spark, sf_dir):
    forks = fold.project_graph(observations(spark, sf_dir)).where("fork > 0")
    return forks.select("id", "base", F.col("attrs")["k"].alias("k"), "first_seen")


def order_log(spark, sf_dir):
    """Orders as a log: each is a sight of its customer, whose status contradicts for every tenth one, and of an edge between
    both; some customers are bound anew at the end, and returned line items are upserts without a datum."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    cid, oid = F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")), F.concat(F.lit("ord:"), F.col("o_orderkey").cast("string"))
    ts = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    step = F.struct(F.col("o_orderstatus").alias("evidence_id"), F.substring("o_orderpriority", 1, 1).alias("tool"), F.lit("1").alias("tool_version"), F.lit("r").alias("rule_id"), F.lit("1").alias("rule_version"), F.lit("").alias("config_hash"))
    common = [
        F.struct(F.array(step).alias("chain")).alias("provenance"), F.struct(F.lit(0.5).alias("log_odds")).alias("confidence"), F.struct(ts.alias("first_seen"), ts.alias("last_seen"), ts.alias("last_verified"), F.lit("P7D").alias("decay_half_life")).alias("temporal"),
        F.struct(F.lit("in_scope").alias("verdict"), F.lit("snap:1").alias("snapshot_id"), ts.alias("observed_at"), F.lit("r1").alias("rule_matched")).alias("scope_binding"),
        F.array(F.struct(F.sha2("o_orderstatus", 256).alias("sha256"), F.lit("eu").alias("region"), F.lit(True).alias("encrypted_at_rest"))).alias("evidence"),
        F.struct((F.col("o_totalprice") > 400000).alias("enumerated")).alias("coverage"),
    ]
    attrs = F.struct(F.col("c_nationkey").alias("nation"), F.when(F.col("o_custkey") % 10 == 0, F.col("o_orderstatus")).alias("status"), F.array(F.col("o_orderstatus")).alias("seen"))
    node = F.struct(cid.alias("id"), F.lit("Organization").alias("type"), attrs.alias("attrs"), *common)
    edge = F.struct(F.concat(F.lit("attributed_to:"), oid, F.lit("->"), cid).alias("id"), F.lit("attributed_to").alias("type"), oid.alias("frm"), cid.alias("to"), *common)
    row = lambda df, seq, kind, payload: df.select(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), F.to_json(payload).alias("payload"))
    log = row(orders, 2 * F.col("o_orderkey"), "node_upserted", F.struct(node.alias("node"))).unionByName(row(orders, 2 * F.col("o_orderkey") + 1, "edge_upserted", F.struct(edge.alias("edge"))))
    new = F.struct(F.lit("out_of_scope").alias("verdict"), F.lit("snap:2").alias("snapshot_id"), F.lit("2026-01-10").alias("observed_at"), F.lit("x").alias("rule_matched"))
    moved = table(spark, sf_dir, "customer").where("c_nationkey % 4 = 0")
    log = log.unionByName(row(moved, F.lit(1 << 40) + F.col("c_custkey"), "scope_binding_set", F.struct(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("id"), new.alias("binding"))))
    bare = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return log.unionByName(row(bare, F.lit(1 << 41) + F.col("l_orderkey"), "node_upserted", F.struct(F.col("l_orderkey").alias("id"))))


_REPLAY = """o AS (SELECT *, 'cust:' || o_custkey AS cid, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts, substr(o_orderpriority, 1, 1) AS tool, first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s0 FROM orders JOIN customer ON c_custkey = o_custkey),
k AS (SELECT *, o_custkey % 10 = 0 AND o_orderstatus <> s0 AS forked FROM o),
n AS (SELECT *, CASE WHEN forked THEN row_number() OVER (PARTITION BY o_custkey, forked ORDER BY o_orderkey) ELSE 0 END AS fork FROM k),
m AS (SELECT cid, fork, any_value(c_nationkey) AS nation, arg_min(o_orderstatus, o_orderkey) AS status, bool_or(o_custkey % 10 = 0) AS told, count(DISTINCT tool) AS tools, count(DISTINCT o_orderstatus) AS proofs, count(DISTINCT (o_orderstatus, tool)) AS steps,
  bool_or(o_totalprice > 400000) AS enumerated, arg_min(ts, o_orderkey) AS first_seen, arg_max(ts, o_orderkey) AS last_verified, count(*) AS observations FROM n GROUP BY cid, fork)"""


@query(f"""WITH {_REPLAY} SELECT CASE WHEN fork = 0 THEN cid ELSE cid || '#fork' || fork END AS id, CASE WHEN fork > 0 THEN cid END AS forked_from, CAST(nation AS VARCHAR) AS nation, CASE WHEN told THEN '"' || status || '"' END AS status, '["' || status || '"]' AS seen,
round(0.5 + 0.8::DOUBLE * (tools - 1), 9) AS log_odds, tools AS independent_sources, proofs, steps, enumerated, first_seen, last_verified, observations, CASE WHEN fork = 0 AND nation % 4 = 0 THEN 'out_of_scope' ELSE 'in_scope' END AS verdict,
CASE WHEN fork = 0 AND nation % 4 = 0 THEN 'snap:2' ELSE 'snap:1' END AS snapshot_id FROM m
UNION ALL SELECT 'attributed_to:ord:' || o_orderkey || '->' || cid, NULL, NULL, NULL, NULL, 0.5, 1, 1, 1, o_totalprice > 400000, ts, ts, 1, 'in_scope', 'snap:1' FROM o
UNION ALL SELECT 'skipped', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*), NULL, NULL FROM lineitem WHERE l_returnflag = 'R'""")
def graph_replay(spark, sf_dir):
    """The graph of order_log(), and one row that counts the upserts without a datum."""
    graph, skipped = fold.replay(order_log(spark, sf_dir))
    size = lambda c: F.size(c).cast("long").alias(c)
    rows = graph.select(
        "id", "forked_from", F.col("attrs")["nation"].alias("nation"), F.col("attrs")["status"].alias("status"), F.col("attrs")["seen"].alias("seen"), F.round("log_odds", 9).alias("log_odds"), F.col("independent_sources").cast("long").alias("independent_sources"),
        size("evidence").alias("proofs"), size("chain").alias("steps"), F.col("coverage")["enumerated"].alias("enumerated"), "first_seen", "last_verified", "observations", "verdict", "snapshot_id",
    )
    return rows.unionByName(skipped.agg(F.count("*").alias("observations")).withColumn("id", F.lit("skipped")), allowMissingColumns=True)


@query("SELECT 'host:' || user_id AS id, count(DISTINCT event_type) AS n_sources, round(0.8::DOUBLE * (count(DISTINCT event_type) - 1), 9) AS log_odds FROM events GROUP BY 1")
def corroboration(spark, sf_dir):
    return fold.corroboration(observations(spark, sf_dir).drop("attrs"))


@query("SELECT sha256(text) AS sha256, length(any_value(text)) AS n_chars, count(*) AS n_refs FROM documents WHERE text IS NOT NULL GROUP BY 1")
def evidence_store(spark, sf_dir):
    return E.put_evidence(table(spark, sf_dir, "documents"), "text").select("sha256", F.char_length("raw").cast("long").alias("n_chars"), "n_refs")


def event_log(spark, sf_dir):
    """The events table in the log's shape: a day is a run; type and user stand for kind and payload."""
    user, day = F.col("user_id"), F.dayofmonth("ts")
    views = {0: "edge_upserted", 1: "gate_decision_recorded", 2: "third_party_debit", 3: "evidence_captured"}
    view = F.lit("node_upserted")
    for k, name in views.items():
        view = F.when(user % 7 == k, name).otherwise(view)
    view = F.when((user % 7 == 3) & (day % 6 == 5), "scope_drift_detected").when((user % 7 == 3) & (day % 6 == 4), "invariant_violation").when((user % 7 == 3) & (day % 6 == 3), "loop_halted").otherwise(view)
    kind = F.when(F.col("event_type") == "click", "gap_dispatched").when(F.col("event_type") == "error", "contradiction_forked").when(F.col("event_type") == "purchase", "rate_debit").when(F.col("event_type") == "view", view).otherwise("node_upserted")
    text = user.cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), kind.alias("kind"),
        F.when((user % 10 == 0) & (F.col("event_type") == "signup"), F.concat(F.lit("hyp:dangling-cname:"), text)).otherwise(F.concat(F.lit("gap:"), text)).alias("id"), F.when(F.col("value") > 20, "created").otherwise("merged").alias("outcome"),
        F.col("event_type").alias("type"), F.when(F.col("value") > 10, "REFUSE").otherwise("ALLOW").alias("decision"), F.concat(F.lit("I"), (1 + user % 12).cast("string")).alias("code"), F.concat(F.lit("user "), text).alias("reason"),
        F.concat(F.lit("t"), (user % 5).cast("string")).alias("target"), F.concat(F.lit("s"), (user % 3).cast("string")).alias("source"),
    )


_LOG = """l AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts, '%Y-%m-%d') AS run_id, CASE WHEN user_id % 10 = 0 AND event_type = 'signup' THEN 'hyp:dangling-cname:' || user_id ELSE 'gap:' || user_id END AS id, event_type AS type,
  CASE event_type WHEN 'click' THEN 'gap_dispatched' WHEN 'error' THEN 'contradiction_forked' WHEN 'purchase' THEN 'rate_debit' WHEN 'view' THEN CASE user_id % 7 WHEN 0 THEN 'edge_upserted' WHEN 1 THEN 'gate_decision_recorded' WHEN 2 THEN 'third_party_debit'
    WHEN 3 THEN CASE day(ts) % 6 WHEN 5 THEN 'scope_drift_detected' WHEN 4 THEN 'invariant_violation' WHEN 3 THEN 'loop_halted' ELSE 'evidence_captured' END ELSE 'node_upserted' END ELSE 'node_upserted' END AS kind,
  CASE WHEN value > 20 THEN 'created' ELSE 'merged' END AS outcome, CASE WHEN value > 10 THEN 'REFUSE' ELSE 'ALLOW' END AS decision, 'I' || (1 + user_id % 12) AS code, 'user ' || user_id AS reason, 't' || (user_id % 5) AS target, 's' || (user_id % 3) AS source FROM events)"""
_DELTA = """d AS (SELECT run_id, count(*) FILTER (WHERE kind = 'node_upserted' AND outcome = 'created') AS nodes_created, count(*) FILTER (WHERE kind = 'node_upserted' AND outcome <> 'created') AS nodes_merged,
  count(*) FILTER (WHERE kind = 'edge_upserted' AND outcome = 'created') AS edges_created, count(*) FILTER (WHERE kind = 'contradiction_forked') AS forks, count(*) FILTER (WHERE kind = 'gap_dispatched') AS gaps_dispatched,
  count(*) FILTER (WHERE kind = 'gate_decision_recorded' AND decision = 'REFUSE') AS refusals, count(*) FILTER (WHERE kind = 'rate_debit') AS rate_debits, count(*) FILTER (WHERE kind = 'third_party_debit') AS third_party_debits,
  count(*) FILTER (WHERE kind = 'invariant_violation') AS violations, arg_min(code, seq) FILTER (WHERE kind = 'invariant_violation') AS first_violation, count(*) FILTER (WHERE kind = 'scope_drift_detected') AS drifts,
  coalesce(arg_max(reason, seq) FILTER (WHERE kind = 'loop_halted'), '') AS halted_because, count(*) FILTER (WHERE kind = 'node_upserted' AND outcome = 'created' AND id LIKE 'hyp:dangling-cname:%') AS notable,
  arg_min(ts, seq) AS first_ts, arg_max(ts, seq) AS last_ts FROM {} GROUP BY run_id)"""
_QUIET = "nodes_created = 0 AND edges_created = 0 AND forks = 0 AND notable = 0 AND drifts = 0"


@query(f"WITH {_LOG}, {_DELTA.format('l')} SELECT *, {_QUIET} AS quiet FROM d")
def run_delta(spark, sf_dir):
    return report.run_delta(event_log(spark, sf_dir))


@query(f"""WITH {_LOG}, {_DELTA.format('l')}, n AS (SELECT run_id, type, count(*) AS n FROM l WHERE kind = 'node_upserted' AND outcome = 'created' GROUP BY ALL), b AS (SELECT run_id, string_agg(n || ' new ' || type, '; ' ORDER BY type) AS new FROM n GROUP BY run_id)
SELECT run_id, CASE WHEN drifts > 0 THEN 'SCOPE DRIFT detected — re-bind before acting' WHEN violations > 0 THEN 'HALTED on a safety invariant (' || first_violation || ')' WHEN {_QUIET} THEN 'no change since the previous run'
  ELSE concat_ws('; ', new, CASE WHEN forks > 0 THEN forks || ' contradiction(s) forked' END, CASE WHEN notable > 0 THEN array_to_string(list_transform(range(least(notable, 100)), lambda x: 'subdomain-takeover candidate'), '; ') END) END AS headline, greatest(notable - 100, 0) AS leads_left_out FROM d LEFT JOIN b USING (run_id)""")
def delta_headline(spark, sf_dir):
    return report.delta_headline(event_log(spark, sf_dir))


@query(f"""WITH {_LOG} SELECT run_id, CASE kind WHEN 'rate_debit' THEN 'target' ELSE 'third_party' END AS ledger, CASE kind WHEN 'rate_debit' THEN target ELSE source END AS target, count(*) AS n FROM l WHERE kind IN ('rate_debit', 'third_party_debit') GROUP BY ALL""")
def run_spend(spark, sf_dir):
    return report.run_spend(event_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT run_id, seq, id, 'subdomain-takeover candidate' AS what FROM l WHERE kind = 'node_upserted' AND outcome = 'created' AND id LIKE 'hyp:dangling-cname:%'")
def notable_hypotheses(spark, sf_dir):
    return report.notable_hypotheses(event_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT run_id, type, count(*) FILTER (WHERE outcome = 'created') AS created, count(*) FILTER (WHERE outcome <> 'created') AS merged FROM l WHERE kind = 'node_upserted' GROUP BY run_id, type")
def run_delta_by_type(spark, sf_dir):
    return report.run_delta_by_type(event_log(spark, sf_dir))


@query(f"WITH {_LOG}, s AS (SELECT * FROM l WHERE run_id > '2024-01-10'), {_DELTA.format('s')} SELECT *, {_QUIET} AS quiet FROM d")
def delta_since(spark, sf_dir):
    return report.run_delta(report.events_since(event_log(spark, sf_dir), run_id="2024-01-10"))


@query(f"WITH {_LOG}, r AS (SELECT run_id, min(seq) AS first_seq FROM l GROUP BY run_id) SELECT run_id, first_seq, CAST(row_number() OVER (ORDER BY first_seq) AS INT) AS position FROM r")
def run_order(spark, sf_dir):
    return report.run_order(event_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT id AS gap_id, max(ts) AS last_dispatch, count(*) AS n FROM l WHERE kind = 'gap_dispatched' GROUP BY id")
def dispatch_history(spark, sf_dir):
    return report.dispatch_history(event_log(spark, sf_dir))


@query("""WITH b AS (SELECT event_type AS type, count(*) AS n FROM events WHERE value <= 20 GROUP BY 1), a AS (SELECT event_type AS type, count(*) AS n FROM events WHERE value > 20 GROUP BY 1)
SELECT coalesce(a.type, b.type) AS type, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM a FULL JOIN b ON a.type = b.type WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def cycle_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "type")
    return report.cycle_diff(report.type_counts(rows.where("value <= 20")), report.type_counts(rows.where("value > 20")))


_SIDES = ", ".join(f"list_sort(list_distinct(coalesce(list(event_type) FILTER (WHERE {c}), []))) AS {n}" for n, c in (("oi", "value <= 20"), ("ni", "value > 20"), ("oe", "value <= 5"), ("ne", "value > 60"), ("op", "value <= 40"), ("np", "value > 40")))


@query(f"""WITH s AS (SELECT user_id, {_SIDES}, sha256(CAST(user_id % 2 AS VARCHAR)) AS oh, sha256(CAST(user_id % 3 AS VARCHAR)) AS nh FROM events GROUP BY user_id),
c AS (SELECT user_id, list_filter(ni, lambda x: NOT list_contains(oi, x)) AS a, list_filter(oi, lambda x: NOT list_contains(ni, x)) AS r, list_filter(ne, lambda x: NOT list_contains(oe, x)) AS x, list_filter(oe, lambda x: NOT list_contains(ne, x)) AS u, op <> np AS prefilter_changed, oh <> nh AS policy_text_changed FROM s),
d AS (SELECT *, len(a) > 0 OR len(r) > 0 OR len(x) > 0 OR len(u) > 0 OR prefilter_changed OR policy_text_changed AS drifted, concat_ws('; ', CASE WHEN len(a) > 0 THEN len(a) || ' added' END, CASE WHEN len(r) > 0 THEN len(r) || ' removed' END,
  CASE WHEN len(x) > 0 THEN len(x) || ' newly excluded' END, CASE WHEN len(u) > 0 THEN len(u) || ' un-excluded' END) AS bits FROM c)
SELECT user_id, array_to_string(a, ',') AS added, array_to_string(r, ',') AS removed, array_to_string(x, ',') AS newly_excluded, array_to_string(u, ',') AS no_longer_excluded, prefilter_changed, policy_text_changed, drifted,
  CASE WHEN NOT drifted THEN 'no scope drift' WHEN bits <> '' THEN bits WHEN policy_text_changed THEN 'policy text changed (asset list unchanged)' ELSE 'scope drift' END AS summary FROM d""")
def policy_drift(spark, sf_dir):
    """Each user's event types of small and of large value, as the rules of an old and a new policy."""
    sides = {"old_include": F.col("value") <= 20, "new_include": F.col("value") > 20, "old_exclude": F.col("value") <= 5, "new_exclude": F.col("value") > 60, "old_prefilter": F.col("value") <= 40, "new_prefilter": F.col("value") > 40}
    pairs = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.collect_set(F.when(c, F.col("event_type"))).alias(n) for n, c in sides.items()))
    text = lambda k: F.sha2((F.col("user_id") % k).cast("string"), 256)
    drift = report.detect_drift(pairs.withColumns({"old_content_sha256": text(2), "new_content_sha256": text(3)}))
    listed = [F.array_join(c, ",").alias(c) for c in ("added", "removed", "newly_excluded", "no_longer_excluded")]
    return drift.select("user_id", *listed, "prefilter_changed", "policy_text_changed", "drifted", "summary")


def order_graph(spark, sf_dir):
    """Customers, orders and line items as nodes; what they contain as edges."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    cid, oid = F.concat(F.lit("c:"), F.col("o_custkey").cast("string")), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string"))
    lid = F.concat_ws(":", F.lit("l"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    edges = orders.select(cid.alias("frm"), oid.alias("to")).unionByName(lines.select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("frm"), lid.alias("to")))
    returned = lines.where("l_returnflag = 'R'").select(lid.alias("id")).distinct()
    return edges, returned


@query("""SELECT 'c:' || c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R')""")
def lacks_two_hop(spark, sf_dir):
    edges, returned = order_graph(spark, sf_dir)
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"))
    return gaps.lacks_two_hop(nodes, edges, returned)


@query("SELECT 'c:' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def lacks_out_edge(spark, sf_dir):
    """Customers without an urgent order."""
    orders = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("plain").alias("type"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("frm"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("to"))
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"))
    return gaps.lacks_out_edge(nodes, orders, "urgent")


def customer_graph(spark, sf_dir):
    """Customers as nodes of five types with what their orders tell: orders are edges by status and priority, and the things
    that edges of exposure lead to, some of which are typed; suppliers are web applications."""
    kinds = ("Domain", "DNSName", "WebApp", "Host", "Hypothesis")
    key = F.col("c_custkey").cast("string")
    names = (F.concat(F.lit("domain:c"), key), F.concat(F.lit("dns:c"), key, F.lit(".example.com")), F.concat(F.lit("web:https://c"), key, F.lit(".example.org")), F.concat(F.lit("host:"), key), F.concat(F.lit("hyp:dns-candidate:c"), key))
    pick = lambda values: F.element_at(F.array(*values), (F.col("c_custkey") % 5 + 1).cast("int"))
    node = pick(names)
    flag = lambda x: F.when(x, "true").otherwise("false")
    tell = lambda n, v: F.struct(F.lit(n).alias("key"), v.alias("value"))
    customers = table(spark, sf_dir, "customer")
    day = F.date_format(F.date_sub(F.lit("2026-01-10").cast("date"), F.col("c_nationkey") * 2), "yyyy-MM-dd")
    rows = customers.select(
        node.alias("id"), pick([F.lit(k) for k in kinds]).alias("type"), F.when(F.col("c_nationkey") % 4 == 0, "out_of_scope").when(F.col("c_nationkey") % 4 == 1, "prefilter_only").otherwise("in_scope").alias("verdict"),
        (F.col("c_nationkey") / 10.0).alias("log_odds"), day.alias("last_verified"), F.lit("P14D").alias("half_life"), F.map_from_entries(F.array(tell("permuted", flag(F.col("c_mktsegment") == "MACHINERY")), tell("email_assessed", flag(F.col("c_mktsegment") == "BUILDING")))).alias("attrs"),
        F.map_from_entries(F.array(tell("enumerated", F.col("c_acctbal") > 3000), tell("fingerprinted", F.col("c_acctbal") > 6000), tell("artifact_correlated", F.col("c_mktsegment") == "HOUSEHOLD"))).alias("coverage"),
    )
    orders = table(spark, sf_dir, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey"), node.alias("cid")), "o_custkey").withColumn("oid", F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")))
    status = F.when(F.col("o_orderstatus") == "F", "authenticates_with").when(F.col("o_orderstatus") == "O", "resolves_to").otherwise("same_as")
    urgent, high = F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority").startswith("2")
    edges = orders.where("o_totalprice > 350000").select(status.alias("type"), F.col("cid").alias("frm"), F.col("oid").alias("to"))
    edges = edges.unionByName(orders.where(urgent).select(F.lit("hosted_on").alias("type"), F.col("oid").alias("frm"), F.col("cid").alias("to")))
    edges = edges.unionByName(orders.where(high).select(F.lit("exposes").alias("type"), F.col("cid").alias("frm"), F.col("oid").alias("to")))
    lid = F.concat_ws(":", F.lit("l"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("frm"), lid.alias("to"), "l_quantity")
    # grouped by numbers, of which the names are made afterwards
    items = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity")).withColumn("to", lid)
    edges = edges.unionByName(lines.select(F.lit("exposes").alias("type"), "frm", "to"))
    other = lambda id_, kind, mined: (id_.alias("id"), F.lit(kind).alias("type"), F.lit("out_of_scope").alias("verdict"), F.lit(0.0).alias("log_odds"), F.lit("2026-01-10").alias("last_verified"), F.lit("P14D").alias("half_life"), F.create_map().cast("map<string,string>").alias("attrs"), F.create_map(F.lit("param_mined"), mined).alias("coverage"))
    rows = rows.unionByName(orders.select(*other(F.col("oid"), "Route", F.col("o_totalprice") > 400000))).unionByName(items.select(*other(F.col("to"), "Operation", F.col("l_quantity") > 49)))
    apps = table(spark, sf_dir, "supplier").select(*other(F.concat(F.lit("web:https://c"), F.col("s_suppkey").cast("string"), F.lit(".example.com")), "WebApp", F.lit(False)))
    return rows.unionByName(apps), edges


def stored_graph(spark, sf_dir):
    """customer_graph() as tables, which is what a graph is to those who plan with it: it is read several times."""
    nodes, edges = customer_graph(spark, sf_dir)
    return written(nodes, "nodes"), written(edges, "edges")


def gap_history(spark, sf_dir):
    """Gaps of customers that were dispatched within the last day, or before it."""
    key = F.concat(F.lit("enumerate-ct:domain:c"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(key.alias("gap_id"), F.when(F.col("c_custkey") % 2 == 0, "2026-01-09 12:00:00").otherwise("2026-01-08 12:00:00").alias("last_dispatch"))


_GAPS = """n AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'domain:c' || c_custkey WHEN 1 THEN 'dns:c' || c_custkey || '.example.com' WHEN 2 THEN 'web:https://c' || c_custkey || '.example.org' WHEN 3 THEN 'host:' || c_custkey ELSE 'hyp:dns-candidate:c' || c_custkey END AS id,
  ['Domain', 'DNSName', 'WebApp', 'Host', 'Hypothesis'][c_custkey % 5 + 1] AS type, 1 + c_nationkey * 2 / 14.0 AS stale, greatest(0.05, 1 - 1 / (1 + exp(-(c_nationkey / 10.0)))) AS deficit, c_nationkey % 4 = 1 AS pre,
  c_acctbal > 3000 AS enumerated, c_acctbal > 6000 AS fingerprinted, c_mktsegment AS seg FROM customer WHERE c_nationkey % 4 <> 0),
o AS (SELECT o_custkey AS k, bool_or(o_totalprice > 350000 AND o_orderstatus = 'F') AS auth, bool_or(o_totalprice > 350000 AND o_orderstatus = 'O') AS resolved, bool_or(o_totalprice > 350000 AND o_orderstatus = 'P') AS same,
  bool_or(o_orderpriority LIKE '1%') AS served, bool_or(o_orderpriority LIKE '2%' AND (o_totalprice > 400000 OR coalesce(q, 0) > 49)) AS typed FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1),
f AS (SELECT n.*, coalesce(auth, FALSE) AS auth, coalesce(resolved, FALSE) AS resolved, coalesce(same, FALSE) AS same, coalesce(served, FALSE) AS served, coalesce(typed, FALSE) AS typed, n.k IN (SELECT s_suppkey FROM supplier) AS app FROM n LEFT JOIN o USING (k)),
r(rule, type, passive, value, cost) AS (VALUES ('enumerate-ct', 'Domain', TRUE, 5.0, 1.0), ('enumerate-ct-host', 'DNSName', TRUE, 3.0, 1.0), ('archive-mine', 'Domain', TRUE, 2.5, 1.0), ('generate-candidates', 'DNSName', TRUE, 1.5, 0.5), ('resolve-identity', 'WebApp', TRUE, 2.0, 0.5),
  ('confirm-candidate', 'Hypothesis', FALSE, 2.0, 1.0), ('resolve-name', 'DNSName', FALSE, 4.0, 1.0), ('scan-host', 'Host', FALSE, 2.0, 3.0), ('email-posture', 'Domain', FALSE, 3.5, 1.0), ('probe-http', 'DNSName', FALSE, 4.0, 1.5), ('tls-fingerprint', 'WebApp', FALSE, 3.0, 1.5),
  ('auth-model', 'WebApp', FALSE, 5.0, 1.5), ('mobile-association', 'WebApp', FALSE, 4.0, 1.5), ('api-contract', 'WebApp', FALSE, 6.0, 2.0), ('graphql-contract', 'WebApp', FALSE, 6.0, 2.0)),
g AS (SELECT rule || ':' || id AS gap_id, rule, id AS node_id, passive, value * stale * deficit / cost AS priority FROM f JOIN r USING (type) WHERE (passive OR NOT pre) AND CASE rule WHEN 'enumerate-ct' THEN NOT enumerated WHEN 'enumerate-ct-host' THEN NOT enumerated
  WHEN 'archive-mine' THEN seg <> 'HOUSEHOLD' WHEN 'generate-candidates' THEN enumerated AND seg <> 'MACHINERY' WHEN 'resolve-identity' THEN fingerprinted AND NOT same WHEN 'confirm-candidate' THEN TRUE WHEN 'resolve-name' THEN NOT resolved WHEN 'scan-host' THEN NOT served
  WHEN 'email-posture' THEN NOT auth AND seg <> 'BUILDING' WHEN 'probe-http' THEN NOT app WHEN 'tls-fingerprint' THEN NOT fingerprinted WHEN 'auth-model' THEN NOT auth WHEN 'mobile-association' THEN NOT auth ELSE NOT typed END
  AND NOT (rule = 'enumerate-ct' AND k % 6 = 0)
UNION ALL SELECT 'reverify:' || id, 'reverify', id, TRUE, stale * deficit / 2 FROM f WHERE stale > 3 AND NOT pre)"""


@query(f"WITH {_GAPS} SELECT gap_id, rule, node_id, passive, round(priority, 9) AS priority FROM g")
def gap_rank(spark, sf_dir):
    found = gaps.rank_gaps(gaps.plan_gaps(*stored_graph(spark, sf_dir), gap_history(spark, sf_dir), NOW, allow_active=True, include_prefilter=True))
    return found.select("gap_id", "rule", "node_id", "passive", F.round("priority", 9).alias("priority"))


@query(f"WITH {_GAPS} SELECT gap_id, round(priority, 9) AS priority FROM g WHERE passive AND NOT (rule = 'enumerate-ct' AND TRY_CAST(split_part(node_id, ':c', 2) AS INT) % 2 = 1) ORDER BY g.priority DESC, gap_id LIMIT 1")
def next_gap(spark, sf_dir):
    attempted = table(spark, sf_dir, "customer").where("c_custkey % 2 = 1").select(F.concat(F.lit("enumerate-ct:domain:c"), F.col("c_custkey").cast("string")).alias("gap_id"))
    found = gaps.next_gap(gaps.plan_gaps(*stored_graph(spark, sf_dir), gap_history(spark, sf_dir), NOW, allow_active=True, include_prefilter=True), attempted)
    return found.select("gap_id", F.round("priority", 9).alias("priority"))


@query("SELECT 'dns:c' || c_custkey || '.example.com' AS id FROM customer WHERE c_custkey % 5 = 1 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def lacks_webapp(spark, sf_dir):
    nodes, _ = customer_graph(spark, sf_dir)
    return gaps.lacks_webapp(gaps.nodes_of_type(nodes, "DNSName"), nodes).select("id")


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS type, count(*) AS n, round(avg(CASE WHEN o_totalprice > 100000 THEN 0.20 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 0.15 ELSE 0 END), 3) AS avg_score FROM orders GROUP BY 1""")
def coverage_report(spark, sf_dir):
    signals = F.create_map(F.lit("fingerprinted"), F.col("o_totalprice") > 100000, F.lit("enumerated"), F.col("o_orderpriority").startswith("1"))
    nodes = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("type"), C.coverage_score(signals).alias("score"))
    return gaps.coverage_report(nodes)


@query("""SELECT c_custkey, round(1 / (1 + exp(-(c_acctbal / 2500))), 9) AS probability, CASE WHEN c_acctbal / 2500 >= 3 THEN 'verified' WHEN c_acctbal / 2500 >= 2.2 THEN 'corroborated' ELSE 'observed' END AS state FROM customer""")
def confidence_states(spark, sf_dir):
    x = F.col("c_acctbal") / 2500
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(C.probability(x), 9).alias("probability"), C.confidence_state(x).alias("state"))


@query("""WITH h AS (SELECT doc_id AS id, sha256(text) AS f FROM documents WHERE trim(coalesce(text, '')) <> ''), s AS (SELECT f FROM h GROUP BY f HAVING count(DISTINCT id) BETWEEN 2 AND 25)
SELECT a.id AS a, b.id AS b, 'same_as' AS type, 'response_hash' AS signal, 2.0::DOUBLE AS log_odds FROM h a JOIN h b ON a.f = b.f AND a.id < b.id WHERE a.f IN (SELECT f FROM s)""")
def identity_clusters(spark, sf_dir):
    prints = table(spark, sf_dir, "documents").where(F.trim("text") != "").select(F.lit("response_hash").alias("signal"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fingerprint"))
    return correlate.correlate(prints)


@query("SELECT CAST(label AS VARCHAR) AS fingerprint, count(DISTINCT vec_id) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY label HAVING count(DISTINCT vec_id) > 25")
def oversized_clusters(spark, sf_dir):
    return correlate.oversized_clusters(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("fingerprint")))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, sec, k, TRUE AS accepted, 2.0::DOUBLE AS bal FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.sec, e.k, least(3.0, w.bal + greatest(0, e.sec - w.sec) * 0.00002) >= 1, least(3.0, w.bal + greatest(0, e.sec - w.sec) * 0.00002) - CASE WHEN least(3.0, w.bal + greatest(0, e.sec - w.sec) * 0.00002) >= 1 THEN 1 ELSE 0 END
FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id AS target, event_id AS seq, accepted, round(bal, 6) AS balance_after FROM w""")
def token_bucket(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("target"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.lit(1.0).alias("cost"))
    return audit.token_bucket(rows, 0.00002, 3.0).withColumn("balance_after", F.round("balance_after", 6))


@query("""SELECT 'I3' AS code, 'c:' || c_custkey AS detail FROM customer WHERE c_acctbal < 0 AND c_nationkey > 10
UNION ALL SELECT 'I1', 'c:' || c_custkey FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 'I4', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < -500
UNION ALL SELECT 'I5', 'o:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 3 <> 0
UNION ALL SELECT 'I6', 'c:' || c_custkey FROM customer WHERE c_nationkey = 7
UNION ALL SELECT 'I7', 'c:' || c_custkey FROM customer WHERE c_nationkey % 3 = 0 AND c_acctbal > 9000
UNION ALL SELECT 'I8', 'c:' || c_custkey FROM customer WHERE c_nationkey % 3 = 1 AND c_acctbal <= 5000
UNION ALL SELECT 'I8', 'c:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal <= 8000
UNION ALL SELECT 'I9', 'o:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'I10', 'c:' || user_id FROM events WHERE event_type = 'click' AND user_id % 4 <> 0
UNION ALL SELECT 'I11', 'c:' || user_id FROM events LEFT JOIN customer ON c_custkey = user_id WHERE event_type = 'error' AND coalesce(c_nationkey % 2 = 0, TRUE)
UNION ALL SELECT 'I12', CAST(count(*) AS VARCHAR) FROM events WHERE event_type = 'view'""")
def invariant_violations(spark, sf_dir):
    """Customers as nodes, orders as edges to them, balances as a ledger, and events as a log under a stale snapshot."""
    customers = table(spark, sf_dir, "customer")
    cid = lambda c: F.concat(F.lit("c:"), F.col(c).cast("string"))
    flag = lambda n, x: F.struct(F.lit(n).alias("key"), F.when(x, "true").alias("value"))
    balance, nation = F.col("c_acctbal"), F.col("c_nationkey")
    mode = F.struct(F.lit("anti_cheat_action_mode").alias("key"), F.when(nation == 7, '"runtime_circumvent"').alias("value"))
    nodes = customers.select(
        cid("c_custkey").alias("id"), F.when(nation % 3 == 0, "Artifact").when(nation % 3 == 1, "Token").otherwise("Host").alias("type"), F.when(nation == 3, "snap:old").otherwise("snap:new").alias("snapshot_id"),
        F.map_from_entries(F.array(flag("active_probed", nation > 10), flag("published_externally", balance > 9000), mode)).alias("attrs"), F.when(balance < 0, "out_of_scope").otherwise("in_scope").alias("verdict"),
        F.when(balance > 8000, "S3").when(balance > 5000, "S1").otherwise("S0").alias("sensitivity"), F.when(F.col("c_mktsegment") == "BUILDING", "other").alias("data_subject"), F.when(nation % 2 == 1, "c:base").alias("forked_from"),
    )
    edges = table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("derived_from").alias("type"), F.lit("x").alias("frm"), cid("o_custkey").alias("to"), F.lit(None).cast("string").alias("forked_from"))
    ledger = customers.select(F.col("c_custkey").alias("target"), (balance + 500).alias("balance_after"))
    kinds = F.when(F.col("event_type") == "click", "gap_dispatched").when(F.col("event_type") == "error", "contradiction_forked").when(F.col("event_type") == "view", "gate_decision_recorded").otherwise("node_upserted")
    verb = F.element_at(F.array(*map(F.lit, ("resolve", "exploit", "content-discovery-wordlist", "teleport"))), (F.col("user_id") % 4 + 1).cast("int"))
    log = table(spark, sf_dir, "events").select(kinds.alias("kind"), cid("user_id").alias("id"), verb.alias("verb"), F.lit("ALLOW").alias("decision"))
    return audit.invariants(nodes, edges, ledger, "snap:new", log, snapshot_stale=True)


@query(rf"""WITH {_URLS}, h AS (SELECT DISTINCT 'w' || (page_id % 97) || 'x.' || host AS host FROM u WHERE {_VALID}), k AS (SELECT host, string_split(host, '.') AS l FROM h), d AS (SELECT DISTINCT array_to_string(list_slice(l, -2, -1), '.') AS apex FROM k),
w(word) AS (SELECT unnest(['api', 'dev', 'stage', 'staging', 'test', 'qa', 'internal', 'admin', 'auth', 'cdn', 'static', 'gateway', 'graphql', 'ws', 'mobile'])),
o(d) AS (VALUES (-2), (-1), (1), (2)), c AS (SELECT word || '.' || apex AS fqdn, 'prefix' AS generator FROM d, w
UNION SELECT 'w' || (CAST(regexp_extract(l[1], '^w([0-9]+)x$', 1) AS INT) + o.d) || 'x' || substr(host, len(l[1]) + 1), 'numeric' FROM k, o WHERE CAST(regexp_extract(l[1], '^w([0-9]+)x$', 1) AS INT) + o.d >= 0)
SELECT fqdn, generator FROM c WHERE fqdn NOT IN (SELECT host FROM h)""")
def candidate_names(spark, sf_dir):
    """Numbered names below the hosts of pages: prefixes of their domains, and numbers beside theirs."""
    hosts = page_hosts(spark, sf_dir).where(U.valid_fqdn(F.col("host")))
    return extract.candidate_names(hosts.select(F.concat(F.lit("w"), (F.col("page_id") % 97).cast("string"), F.lit("x."), F.col("host")).alias("host")))


@query(r"""SELECT page_id, substr(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), 1, 200) AS title FROM pages""")
def page_titles(spark, sf_dir):
    return extract.page_titles(table(spark, sf_dir, "pages")).select("page_id", "title")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT user_id, event_id, value FROM r WHERE k <= 3""")
def top_per_user(spark, sf_dir):
    kept, _ = gaps.top_n_per_group(table(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), F.asc("event_id")], 3)
    return kept.select("user_id", "event_id", "value")


@query("""WITH r AS (SELECT c_custkey, ['exploit', 'resolve', 'fingerprint', 'content-discovery-wordlist', 'teleport', 'http-GET'][c_nationkey % 6 + 1] AS verb, CASE WHEN c_acctbal < 0 THEN 'out_of_scope' ELSE 'in_scope' END AS verdict FROM customer),
s AS (SELECT *, CASE verb WHEN 'exploit' THEN 'verb ''exploit'' is on the blocked list and can never be scheduled' WHEN 'content-discovery-wordlist' THEN 'verb ''content-discovery-wordlist'' is human-gated; enqueue for authorization, do not auto-run'
  WHEN 'teleport' THEN 'verb ''teleport'' is not on the verb whitelist' WHEN 'fingerprint' THEN chr(39) || 'fingerprint' || chr(39) || ' is not an active verb' ELSE CASE WHEN verdict = 'in_scope' THEN '' ELSE 'not in scope: rule (out_of_scope)' END END AS reason FROM r)
SELECT c_custkey, CASE WHEN reason = '' THEN 'ALLOW' ELSE 'REFUSE' END AS decision, reason FROM s""")
def gate_decisions(spark, sf_dir):
    verbs = F.array(*map(F.lit, ("exploit", "resolve", "fingerprint", "content-discovery-wordlist", "teleport", "http-GET")))
    requests = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(verbs, (F.col("c_nationkey") % 6 + 1).cast("int")).alias("verb"), F.when(F.col("c_acctbal") < 0, "out_of_scope").otherwise("in_scope").alias("verdict"), F.lit("rule").alias("rule_matched"))
    return audit.gate_decisions(requests, True, "snap:1").select("c_custkey", "decision", "reason")


@query("""WITH o AS (SELECT event_id, 'host:' || user_id AS id, event_type AS tool, sha256(props) AS sha256, strftime(ts, '%Y-%m-%d') AS day FROM events)
SELECT event_id, id, tool FROM o n WHERE day > '2024-01-10' AND NOT EXISTS (SELECT 1 FROM o r WHERE r.day <= '2024-01-10' AND r.id = n.id AND r.tool = n.tool AND r.sha256 = n.sha256)""")
def already_recorded(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    seen = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("host:"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("tool"), F.sha2("props", 256).alias("sha256"), day)
    return known.already_recorded(seen.where("day > '2024-01-10'"), seen.where("day <= '2024-01-10'")).select("event_id", "id", "tool")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_guard(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return known.orphan_guard(table(spark, sf_dir, "lineitem"), done, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("""SELECT 'op:GET:route:web:https://c' || o_custkey || '.example.com/orders/' || o_orderkey AS operation, 'query' AS location, 'clerk' AS name, CASE WHEN o_orderstatus = 'F' THEN 'string' ELSE 'integer' END AS type FROM orders""")
def api_contracts(spark, sf_dir):
    """A contract per customer, with a path per order; some operations override their path's parameter."""
    return contracts.contract_parameters(contracts.contract_operations(order_contracts(spark, sf_dir))).select("operation", "location", "name", "type")


def order_contracts(spark, sf_dir):
    clerk = lambda t: F.array(F.struct(F.lit("clerk").alias("name"), F.lit("query").alias("in"), F.struct(F.lit(t).alias("type")).alias("schema")))
    get = F.struct(F.col("o_orderpriority").alias("summary"), F.when(F.col("o_orderstatus") == "F", clerk("string")).alias("parameters"))
    path = F.struct(F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string")), F.struct(clerk("integer").alias("parameters"), get.alias("get")))
    specs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(path)).alias("paths"))
    return specs.select(F.format_string("https://c%d.example.com/openapi.json", "o_custkey").alias("url"), F.to_json(F.struct(F.lit("3.0.0").alias("openapi"), "paths")).alias("body"))


@query("""SELECT 'tok:' || substr(sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))), 1, 16) AS id, 'auth:c' || o_custkey || '.example.com:oidc' AS issuer FROM orders GROUP BY o_custkey""")
def key_set_tokens(spark, sf_dir):
    """A key set per customer, with a key per order."""
    key = F.struct(F.col("o_orderkey").cast("string").alias("kid"), F.lit("RSA").alias("kty"))
    jwks = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(key).alias("keys")).select(F.format_string("https://c%d.example.com/jwks", "o_custkey").alias("url"), F.to_json(F.struct("keys")).alias("body"))
    return contracts.key_sets(jwks).where("kind = 'edge'").select(F.col("frm").alias("id"), F.col("to").alias("issuer"))


def logged(spark, *jobs):
    """The log that extraction jobs (name, tables) leave, one run after another. What a run has read and left goes when it is in the log."""
    log = spark.createDataFrame([], E.EVENT)
    for k, (name, *tables) in enumerate(jobs):
        new, _ = extract.run_extractor(name, observe.Run(f"run-{k}", f"2026-01-0{1 + k} 00:00:00", "snap:1", k), log, *tables)
        whole = log.unionByName(new.select(*log.columns))
        log = written(whole, "log")
        discard(whole)
    return log


def node_gaps(log):
    """The nodes of the graph of a log of logged() with the rules that still fire for them, sorted. The log goes when the graph is there."""
    folded, _ = fold.replay(log)
    graph = written(folded, "graph")
    discard(log)
    discard(folded)
    nodes, edges = graph.where("kind = 'node'"), graph.where("kind = 'edge'")
    rules = gaps.plan_gaps(nodes, edges, None, NOW, allow_active=True).where("rule <> 'reverify'").groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    return nodes.join(rules, "id", "left").withColumns({"rules": F.coalesce("rules", F.lit("")), "enumerated": F.coalesce(F.col("coverage")["enumerated"], F.lit(False)), "n_sources": F.col("independent_sources").cast("long"), "log_odds": F.round("log_odds", 9)}), edges


def page_certificates(spark, sf_dir):
    host = F.col("host")
    names = F.struct(F.concat(host, F.lit("\n*."), host, F.lit("\nadmin@"), host).alias("name_value"))
    return page_hosts(spark, sf_dir).select("host").groupBy(U.registrable_domain(host).alias("apex")).agg(F.to_json(F.sort_array(F.collect_list(names))).alias("body"))


@query(rf"""WITH {_URLS}, h AS (SELECT DISTINCT host, {_VERDICT} AS verdict FROM u WHERE {_VALID}), k AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS apex FROM h WHERE verdict <> 'out_of_scope'),
d AS (SELECT DISTINCT apex, CASE WHEN apex = 'example.net' THEN 'prefilter_only' ELSE 'in_scope' END AS verdict FROM k)
SELECT 'dns:' || host AS id, verdict, CASE verdict WHEN 'in_scope' THEN 0.8::DOUBLE ELSE 0 END AS log_odds, CASE verdict WHEN 'in_scope' THEN 2::BIGINT ELSE 1 END AS n_sources, TRUE AS enumerated, CASE verdict WHEN 'in_scope' THEN 'generate-candidates,probe-http,resolve-name' ELSE '' END AS rules FROM k
UNION ALL SELECT 'domain:' || apex, verdict, 0, 1, verdict = 'prefilter_only', CASE verdict WHEN 'in_scope' THEN 'archive-mine,email-posture,enumerate-ct' ELSE '' END FROM d""")
def certificate_graph(spark, sf_dir):
    """The hosts of pages as seeds, then their certificates: names in scope have a second source, and their gap of enumeration
    has closed, which opens that of candidates; their domains' gaps are still there."""
    rules = scope.scope_rules(spark, INCLUDE, EXCLUDE, PREFILTER)
    seeds = page_hosts(spark, sf_dir).select(F.col("host").alias("value"))
    nodes, _ = node_gaps(logged(spark, ("seeds", seeds, rules), ("crtsh", page_certificates(spark, sf_dir), rules)))
    return nodes.select("id", "verdict", "log_odds", "n_sources", "enumerated", "rules")


@query(rf"""WITH {_URLS}, {_TEMPLATES},
ok AS (SELECT scheme, host, 'web:' || scheme || '://' || host AS app, template, lpad(CAST(page_id AS VARCHAR), 14, '0') AS ts FROM t WHERE scheme IN ('http', 'https') AND template <> '' AND {_VERDICT} = 'in_scope'),
w AS (SELECT app AS id, 'WebApp' AS type, min(ts) AS ts, count(DISTINCT template) AS n_exposed, host FROM ok GROUP BY app, host UNION ALL SELECT 'route:' || app || template, 'Route', min(ts), 0, host FROM ok GROUP BY app, template, host)
SELECT id, type, '"' || ts || '"' AS stamp, n_exposed, 0::DOUBLE AS log_odds, TRUE AS enumerated, 'P' || CASE type WHEN 'WebApp' THEN 7 ELSE 30 END || 'D' AS half_life, host AS region, CASE type WHEN 'WebApp' THEN 'api-contract,auth-model,graphql-contract,mobile-association,tls-fingerprint' ELSE '' END AS rules FROM w""")
def archive_graph(spark, sf_dir):
    """Archived pages through the log into a graph: each application and route with the hash of its captures' host as evidence,
    the routes that an application exposes, and the gaps that an archive leaves open. A second run of the same job adds nothing."""
    rules = scope.scope_rules(spark, INCLUDE, EXCLUDE, PREFILTER)
    captures = page_captures(spark, sf_dir).withColumn("proof", F.sha2(U.canonical_host(U.netloc_of(F.col("original"))), 256))
    log = logged(spark, ("wayback", captures, rules), ("wayback", captures, rules))
    nodes, edges = node_gaps(log)
    exposed = edges.groupBy(F.col("frm").alias("id")).agg(F.count("*").alias("n_exposed"))
    region = F.when((F.size("evidence") == 1) & (F.size("chain") == 1) & (F.col("observations") == 1), F.regexp_replace(F.col("evidence")[0]["region"], "^wayback:", ""))
    return nodes.join(exposed, "id", "left").select("id", "type", F.col("attrs")["archived_timestamp"].alias("stamp"), F.coalesce("n_exposed", F.lit(0)).alias("n_exposed"), "log_odds", "enumerated", "half_life", region.alias("region"), "rules")


@query("""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT 'web:https://c' || c_custkey || '.example.com' AS id, 2::DOUBLE AS log_odds, coalesce(n, 0) AS n_routes, CASE WHEN c_nationkey % 2 = 0 THEN '"cloudflare"' END AS cdn,
CASE WHEN n > 0 THEN 'auth-model,mobile-association,resolve-identity' ELSE 'api-contract,auth-model,graphql-contract,mobile-association,resolve-identity' END AS rules FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def contract_graph(spark, sf_dir):
    """Responses of customers' applications, then the contracts of those with orders: their routes are known and typed, so the
    gaps of contracts close."""
    rules = scope.scope_rules(spark, ["*.example.com"])
    headers = F.when(F.col("c_nationkey") % 2 == 0, F.create_map(F.lit("CF-Ray"), F.lit("1"))).otherwise(F.create_map(F.lit("Server"), F.lit("nginx")))
    seen = table(spark, sf_dir, "customer").select(F.format_string("https://c%d.example.com/", "c_custkey").alias("url"), F.lit("HEAD").alias("method"), F.lit(200).alias("status"), headers.alias("headers"), F.lit(None).cast("string").alias("body"))
    nodes, edges = node_gaps(logged(spark, ("http_probe", seen, rules), ("openapi_discovery", order_contracts(spark, sf_dir), rules)))
    routes = edges.where("type = 'exposes' and to like 'route:%'").groupBy(F.col("frm").alias("id")).agg(F.count("*").alias("n_routes"))
    apps = nodes.where("type = 'WebApp'").join(routes, "id", "left")
    return apps.select("id", "log_odds", F.coalesce("n_routes", F.lit(0)).alias("n_routes"), F.col("attrs")["cdn_or_waf"].alias("cdn"), "rules")


def awkward_urls(spark, sf_dir):
    """Customers' names and comments in queries and hosts that need decoding, encoding and sorting."""
    n = F.col("c_custkey") % 6
    text = F.col("c_custkey").cast("string")
    query = F.concat(F.lit("b=%7Ex&a="), text, F.lit("&q=a%20b+c&e=\u00e9&s=/x*y&a=&z&&p=%zz"))
    base = F.when(n == 0, F.concat(F.lit("HTTP://C"), text, F.lit(".Example.com:80"))).when(n == 1, F.concat(F.lit("https://u:p@c"), text, F.lit(".example.com:8443/P"))).when(n == 2, F.concat(F.lit("c"), text, F.lit(".example.com/x"))).when(n == 3, F.lit("//h.example.com")).otherwise("https://h.example.com/a")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(base, F.when(n == 5, "#frag").otherwise(F.concat(F.lit("?"), query))).alias("url"))


@query(r"""WITH c AS (SELECT c_custkey, c_custkey % 6 AS n, c_custkey::VARCHAR AS t FROM customer),
q AS (SELECT *, 'a=&a=' || t || '&b=~x&e=%C3%A9&p=%25zz&q=a+b+c&s=%2Fx%2Ay&z=' AS q FROM c)
SELECT c_custkey, CASE n WHEN 0 THEN 'http://c' || t || '.example.com/?' || q WHEN 1 THEN 'https://c' || t || '.example.com:8443/P?' || q WHEN 2 THEN 'https://c' || t || '.example.com/x?' || q WHEN 3 THEN 'https://h.example.com/?' || q
  WHEN 4 THEN 'https://h.example.com/a?' || q ELSE 'https://h.example.com/a' END AS canonical_url FROM q""")
def encoded_urls(spark, sf_dir):
    return awkward_urls(spark, sf_dir).select("c_custkey", U.canonical_url(F.col("url")).alias("canonical_url"))


@query("""WITH c AS (SELECT c_custkey, c_custkey % 6 AS n, 'c' || c_custkey || CASE WHEN c_nationkey % 2 = 0 THEN '.example.com' ELSE '.example.org' END AS host, c_nationkey % 2 = 0 AS com, CASE WHEN c_nationkey % 3 = 0 THEN 'in_scope' ELSE 'out_of_scope' END AS was FROM customer),
v AS (SELECT *, CASE n WHEN 0 THEN 'dns:' || host WHEN 1 THEN 'web:https://' || host || '/x' WHEN 2 THEN 'hyp:dangling-cname:' || host WHEN 3 THEN 'hyp:email-spoofable:' || host WHEN 4 THEN 'svc:10.0.0.1:443/tcp#' || c_custkey ELSE 'route:web:https://' || host || '/x' END AS id FROM c),
w AS (SELECT id, was, CASE WHEN n = 4 THEN '10.0.0.1' ELSE host END AS subject, CASE WHEN n < 4 AND com THEN 'in_scope' ELSE 'out_of_scope' END AS now FROM v WHERE n < 5)
SELECT id, subject, was AS old_verdict, now AS new_verdict, CASE WHEN was = now THEN 'rebound' WHEN was = 'in_scope' THEN 'lost' ELSE 'gained' END AS change, now AS replayed FROM w""")
def rebinding(spark, sf_dir):
    """Nodes of many kinds under a new policy; replayed is the verdict that the fold of the binding events gives."""
    n, text = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    host = F.concat(F.lit("c"), text, F.when(F.col("c_nationkey") % 2 == 0, ".example.com").otherwise(".example.org"))
    prefix = F.when(n == 0, "dns:").when(n == 1, "web:https://").when(n == 2, "hyp:dangling-cname:").when(n == 3, "hyp:email-spoofable:").when(n == 5, "route:web:https://")
    node = F.when(n == 4, F.concat(F.lit("svc:10.0.0.1:443/tcp#"), text)).otherwise(F.concat(prefix, host, F.when(n % 4 == 1, "/x").otherwise("")))
    was = F.when(F.col("c_nationkey") % 3 == 0, "in_scope").otherwise("out_of_scope")
    nodes = table(spark, sf_dir, "customer").select(node.alias("id"), F.create_map().cast("map<string,string>").alias("attrs"), was.alias("verdict"), F.lit("snap:1").alias("snapshot_id"))
    rules = scope.scope_rules(spark, ["*.example.com"])
    events = scope.rebind_events(nodes, rules, "snap:2", "2026-01-10", "r").withColumn("seq", F.lit(2).cast("long"))
    seen = nodes.select(F.lit(1).cast("long").alias("seq"), F.lit("node").alias("kind"), "id", F.lit("Host").alias("type"), F.lit("t").alias("tool"), F.lit("r").alias("rule_id"), F.lit("1").alias("ts"), "attrs", "verdict", "snapshot_id")
    _, bindings, _ = fold.read_observations(events.select("seq", "kind", "payload"))
    graph = fold.project_graph(seen, bindings).where("snapshot_id = 'snap:2'")
    return scope.rebind(nodes, rules, "snap:2").join(graph.select("id", F.col("verdict").alias("replayed")), "id")


@query("SELECT DISTINCT 'c' || o_custkey || '.example.com' AS fqdn FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 2)")
def unknown_candidates(spark, sf_dir):
    """Names of customers with orders that are neither a known name nor a candidate already; an application is neither."""
    prefix = F.when(F.col("s_suppkey") % 3 == 0, "dns:").when(F.col("s_suppkey") % 3 == 1, known.CANDIDATE).otherwise("web:https://")
    nodes = table(spark, sf_dir, "supplier").select(F.format_string("%sc%d.example.com", prefix, "s_suppkey").alias("id"))
    return known.drop_known(table(spark, sf_dir, "orders").select(F.format_string("c%d.example.com", "o_custkey").alias("fqdn")).distinct(), nodes)


@query("""WITH e AS (SELECT o_custkey AS k, min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS o, bool_or(o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT '10.0.0.' || c_custkey AS ip, CASE WHEN c_nationkey % 4 = 0 THEN 'c' || c_custkey || '.co.uk' WHEN c_nationkey % 4 = 1 THEN 'c' || c_custkey || '.com' WHEN o IS NOT NULL THEN 'z' || o || '.org' ELSE '10.0.0.' || c_custkey END AS ledger_key,
c_nationkey % 4 = 1 OR coalesce(p, FALSE) AS shared_tenant FROM customer LEFT JOIN e ON k = c_custkey""")
def probe_charges(spark, sf_dir):
    """Who a probe of an address is charged to (its name by attribute, else by its first edge, else itself), and whether the
    address serves several tenants."""
    n, text = F.col("c_nationkey") % 4, F.col("c_custkey").cast("string")
    attrs = F.when(n == 0, F.create_map(F.lit("fqdn"), F.concat(F.lit("A.c"), text, F.lit(".co.uk.")))).when(n == 1, F.create_map(F.lit("resolved_from"), F.concat(F.lit("https://x.y.c"), text, F.lit(".com/")), F.lit("cdn"), F.lit("true")))
    hosts = table(spark, sf_dir, "customer").select(F.concat(F.lit("10.0.0."), text).alias("ip"), F.coalesce(attrs, F.create_map(F.lit("cdn"), F.lit("false"))).alias("attrs"))
    address, status = F.format_string("host:10.0.0.%d", "o_custkey"), F.col("o_orderstatus")
    name = F.format_string("%s%d.z%d.org", F.when(status == "F", "dns:o").otherwise("web:https://o"), "o_orderkey", "o_orderkey")
    edges = table(spark, sf_dir, "orders").select(F.when(status == "P", "fronted_by").otherwise("resolves_to").alias("type"), F.when(status == "P", address).otherwise(name).alias("frm"), F.when(status == "P", "x").otherwise(address).alias("to"), F.col("o_orderkey").alias("seq"))
    return known.shared_tenant(known.ledger_key(hosts, edges), edges).select("ip", "ledger_key", "shared_tenant")


@query("""SELECT DISTINCT 'c' || o_custkey || '.example.com' AS fqdn, CASE o_orderstatus WHEN 'F' THEN 'f' ELSE 'o' END || '.cdn.example.net' AS cname FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey IN (SELECT c_custkey FROM customer)
UNION SELECT 'c' || c_custkey || '.example.com', 'f.cdn.example.net' FROM customer WHERE c_nationkey % 2 = 0""")
def known_aliases(spark, sf_dir):
    """Where customers' names point, by edges and by what was read of the name before; what is no host name is left out."""
    status = F.col("o_orderstatus")
    edges = table(spark, sf_dir, "orders").select(F.when(status == "P", "resolves_to").otherwise("cname_to").alias("type"), F.format_string("dns:c%d.example.com", "o_custkey").alias("frm"), F.concat(F.lit("dns:"), status, F.lit(".CDN.example.net.")).alias("to"))
    told = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("F.cdn.example.net"), F.lit("10.0.0.1"), F.lit("localhost")))
    return known.known_cnames(table(spark, sf_dir, "customer").select(F.format_string("c%d.example.com", "c_custkey").alias("fqdn"), told.alias("cname_targets")), edges)


@query("""SELECT 'c:' || o_custkey AS id, o_orderstatus AS tool, o_orderpriority AS rule_id FROM orders WHERE o_totalprice >= 150000
EXCEPT SELECT 'c:' || o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice < 150000""")
def source_changes(spark, sf_dir):
    """Sources of a customer's dear orders that none of the cheap ones has."""
    seen = table(spark, sf_dir, "orders").select(F.format_string("c:%d", "o_custkey").alias("id"), F.col("o_orderstatus").alias("tool"), F.col("o_orderpriority").alias("rule_id"), "o_totalprice")
    return report.new_sources(seen.where("o_totalprice < 150000"), seen.where("o_totalprice >= 150000"))


@query("""WITH t AS (SELECT p_brand AS type, count(*) FILTER (WHERE p_size < 20) AS b, count(*) FILTER (WHERE p_size >= 20) AS a FROM part GROUP BY 1) SELECT type, a - b AS delta FROM t WHERE a <> b""")
def cycle_changes(spark, sf_dir):
    """How many more large parts than small ones each brand has, where there is a difference."""
    typed = table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), "p_size")
    return report.cycle_diff(report.type_counts(typed.where("p_size < 20")), report.type_counts(typed.where("p_size >= 20")))


@query("""WITH t AS (SELECT c_custkey, ['Token', 'Host', 'NetBlock', 'Invoice'][c_nationkey % 4 + 1] AS type, c_custkey % 200 AS age FROM customer)
SELECT c_custkey, type, ['PT12H', 'P3D', 'P180D', 'P14D'][list_position(['Token', 'Host', 'NetBlock', 'Invoice'], type)] AS half_life, age = 7 OR age > [0.5, 3, 180, 14][list_position(['Token', 'Host', 'NetBlock', 'Invoice'], type)] AS stale FROM t""")
def snapshot_ages(spark, sf_dir):
    """Half-lives by type, and whether something taken up to 199 days ago has outlived its own; an unreadable time has."""
    kind = F.element_at(F.array(*map(F.lit, ("Token", "Host", "NetBlock", "Invoice"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    age = (F.col("c_custkey") % 200).cast("int")
    rows = table(spark, sf_dir, "customer").select("c_custkey", kind.alias("type"), F.when(age != 7, F.date_sub(F.lit(NOW).cast("date"), age).cast("string")).otherwise("some day").alias("taken_at")).withColumn("half_life", C.half_life_for(F.col("type")))
    return rows.select("c_custkey", "type", "half_life", C.snapshot_is_stale(F.col("taken_at"), F.col("half_life"), F.lit(NOW)).alias("stale"))
