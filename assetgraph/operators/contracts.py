"""Extraction from collected JSON documents: API contracts, GraphQL schemas, identity metadata, app links.

Documents stay JSON text until a field is needed: a JSON value read as a string keeps its own text, so maps
with unknown keys open level by level. A reference inside a contract is resolved within the document's row,
before anything is exploded, so no copy of a document is made per parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from assetgraph.functions import urls as U
from assetgraph.functions.confidence import redact, redact_secret_shaped
from assetgraph.operators import observe as O
from assetgraph.operators.extract import ENUMERATED, FINGERPRINTED, extractor, retainable
from assetgraph.operators.scope import bind_scope
from assetgraph.sources.responses import read_json_documents
from assetgraph.sources.shared import written

# Methods of a path item, in order; depth of references; metadata fields; members of private keys.
METHODS = ("get", "head", "post", "put", "patch", "delete", "options", "trace")
REF_DEPTH = 8
URL_FIELDS = ("issuer", "authorization_endpoint", "token_endpoint", "jwks_uri")
LIST_FIELDS = ("grant_types_supported", "scopes_supported", "response_types_supported")
ENDPOINTS = (("token_endpoint", "POST", "token"), ("authorization_endpoint", "GET", "authorize"))
PRIVATE_JWK = ("d", "p", "q", "dp", "dq", "qi", "k", "oth")
TEMPLATE = r"^/[\x21-\x22\x24-\x3e\x40-\x7e]*$"
NAME = r"^[\x21-\x22\x24-\x7e]+$"
GRAPHQL_NAME = r"^[_A-Za-z][_0-9A-Za-z]*$"
_OBJECT, _LIST = "map<string,string>", "array<string>"
_PARAMETERS = "array<struct<name:string,location:string,type:string,required:boolean,enum:array<string>,level:int>>"


def in_scope(docs: DataFrame, rules: DataFrame | None, tool: str, drops: Observation | None = None, portless: bool = False) -> DataFrame:
    """docs (url, body, ...) of web applications whose host is in scope, with webapp (a struct of urls.parse_webapp), verdict,
    proof (the body's hash) and region. Without rules all are kept, and bound to nothing. portless: an application on a port
    of its own is refused, as its contract would speak for another."""
    rows = U.with_ascii_hosts(docs, "url").withColumn("app", F.explode(F.array_compact(F.array(U.parse_webapp(F.col("url"))))))
    rows = rows.where("app.port is null") if portless else rows
    rows = rows.withColumns({"webapp": F.col("app.id"), "host": F.col("app.host"), "proof": F.array(F.sha2("body", 256)), "region": F.concat(F.lit(f"{tool}:GET "), "url")}).drop("app")
    return rows if rules is None else retainable(bind_scope(rows, "host", rules), drops=drops)


_BOUND = ("verdict", "rule_matched", "proof", "region")


def _bound(df: DataFrame) -> list[str]:
    return [c for c in _BOUND if c in df.columns]


def member(json: Column, name: str) -> Column:
    """A member of a JSON object: text as it is, other values as JSON; null where there is none."""
    return F.get_json_object(json, f"$['{name}']")


def as_object(json: Column) -> Column:
    return F.when(F.trim(json).startswith("{"), F.from_json(json, _OBJECT))


def as_list(json: Column) -> Column:
    """The values of a JSON array, else an empty array."""
    return F.coalesce(F.when(F.trim(json).startswith("["), F.from_json(json, _LIST)), F.array().cast(_LIST))


def _child(node: Column, key: Column) -> Column:
    """What a VARIANT node holds under a member's name or, if it is an array, at a position; null where there is nothing."""
    quote = F.when(~key.contains('"'), '"').when(~key.contains("'"), "'")
    by_name = F.when((key != "") & quote.isNotNull(), F.try_variant_get(node, F.concat(F.lit("$["), quote, key, quote, F.lit("]")), "variant"))
    by_place = F.when(key.rlike("^[0-9]{1,9}$"), F.try_variant_get(node, F.concat(F.lit("$["), key, F.lit("]")), "variant"))
    return F.coalesce(by_name, by_place)


def resolved(value: Column, doc: Column) -> Column:
    """The value that a local reference leads to, through at most REF_DEPTH steps; null for external and missing ones. doc is the
    document as VARIANT, in which each step of a pointer is a lookup and not another reading of the text."""

    def step(x, _):
        ref = member(x, "$ref")
        keys = F.transform(F.split(F.substring(ref, 3, 1 << 20), "/"), lambda k: F.replace(F.replace(k, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
        return F.when(ref.isNull(), x).when(ref.startswith("#/"), F.to_json(F.aggregate(keys, doc, _child)))

    return F.when(value.contains("$ref"), F.aggregate(F.sequence(F.lit(1), F.lit(REF_DEPTH)), value, step)).otherwise(value)


def at_least(spark) -> int:
    """So many parts that each core has several."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def external_references(body: Column) -> Column:
    """How many references of a document lead out of it."""
    return F.regexp_count(body, F.lit(r'"\$ref"\s*:\s*"[^"#]'))


def _parameter(p: Column, level: Column) -> Column:
    schema = member(p, "schema")
    values = F.coalesce(member(schema, "enum"), member(p, "enum"))
    return F.struct(
        F.trim(member(p, "name")).alias("name"), F.coalesce(member(p, "in"), F.lit("")).alias("location"), F.coalesce(member(schema, "type"), member(p, "type"), F.lit("")).alias("type"),
        (F.coalesce(member(p, "required"), F.lit("false")) == "true").alias("required"), F.when(values.isNotNull(), redact_secret_shaped(as_list(values))).alias("enum"), level.alias("level"),
    )


def _properties(schema: Column, doc: Column) -> Column:
    """The properties of a request body's schema as parameters."""
    full = resolved(schema, doc)
    must = as_list(member(full, "required"))

    def one(e):
        p = resolved(e["value"], doc)
        values = member(p, "enum")
        return F.struct(
            F.trim(e["key"]).alias("name"), F.lit("body").alias("location"), F.coalesce(member(p, "type"), F.lit("")).alias("type"), F.array_contains(must, e["key"]).alias("required"),
            F.when(values.isNotNull(), redact_secret_shaped(as_list(values))).alias("enum"), F.lit(1).alias("level"),
        )

    return F.transform(F.coalesce(F.map_entries(as_object(member(full, "properties"))), F.array().cast("array<struct<key:string,value:string>>")), one)


def contract_operations(specs: DataFrame) -> DataFrame:
    """(url, body) -> one row per declared path and method: (webapp, spec_version, template, method, summary,
    operation_id, parameters). Documents without a version or paths give none.

    Parameters of the operation override those of its path with the same name and place. The body of Swagger 2 is a
    parameter, that of OpenAPI 3 the first typed media type by name; both give their schema's properties. In a document
    that VARIANT cannot hold (an object with a name twice) no reference is followed."""
    body, doc = F.col("body"), F.col("doc")
    version = F.coalesce(member(body, "openapi"), member(body, "swagger"))
    docs = specs if "webapp" in specs.columns else in_scope(specs, None, "openapi_discovery", portless=True)
    kept = _bound(docs)
    # a document of few bytes may take long, so they are dealt out and not left in as few tasks as their bytes ask for
    docs = read_json_documents(docs.select("body", "webapp", *kept).repartition(at_least(specs.sparkSession), F.xxhash64("body"))).where(F.trim("body").startswith("{")).select("doc", "webapp", *kept, version.alias("spec_version"), as_object(member(body, "paths")).alias("paths")).where("spec_version is not null and paths is not null")
    # exploded from an array of one, so that it is parsed once and not again at each reference
    docs = docs.withColumn("doc", F.explode(F.array("doc")))

    # each level is opened once: path items, then the declared operations with their parameters, then what these say
    good = F.filter(F.map_entries("paths"), lambda p: F.trim(p["key"]).rlike(TEMPLATE) & ~p["key"].contains("://"))
    items = F.transform(good, lambda p: F.struct(F.trim(p["key"]).alias("template"), as_object(p["value"]).alias("item")))
    declared = lambda i: F.filter(F.array(*map(F.lit, METHODS)), lambda m: F.coalesce(F.trim(F.try_element_at(i["item"], m)).startswith("{"), F.lit(False)))

    def given(json, level):
        return F.transform(F.filter(as_list(json), lambda p: p.isNotNull()), lambda p: F.struct(resolved(p, doc).alias("p"), F.lit(level).alias("level")))

    def opened(i, m):
        op = F.try_element_at(i["item"], m)
        return F.struct(i["template"].alias("template"), m.alias("method"), op.alias("op"), F.concat(given(F.try_element_at(i["item"], F.lit("parameters")), 0), given(member(op, "parameters"), 1)).alias("given"))

    def told(o):
        op = o["op"]
        plain = F.transform(F.filter(o["given"], lambda x: member(x["p"], "name").isNotNull() & (F.coalesce(member(x["p"], "in"), F.lit("")) != "body")), lambda x: _parameter(x["p"], x["level"]))
        old = F.flatten(F.transform(F.filter(o["given"], lambda x: member(x["p"], "in") == "body"), lambda x: _properties(member(x["p"], "schema"), doc)))
        media = F.array_sort(F.filter(F.map_entries(as_object(member(resolved(member(op, "requestBody"), doc), "content"))), lambda m: member(m["value"], "schema").isNotNull()))
        new = F.flatten(F.transform(F.slice(media, 1, 1), lambda m: _properties(member(m["value"], "schema"), doc)))
        return F.struct(
            o["template"].alias("template"), F.upper(o["method"]).alias("method"), F.trim(F.regexp_replace(member(op, "summary"), r"\s+", " ")).alias("summary"), F.trim(member(op, "operationId")).alias("operation_id"),
            F.concat(plain, old, F.when(op.contains("requestBody"), F.coalesce(new, F.array().cast(_PARAMETERS))).otherwise(F.array().cast(_PARAMETERS))).alias("parameters"),
        )

    every = F.transform(F.flatten(F.transform(items, lambda i: F.transform(declared(i), lambda m: opened(i, m)))), told)
    return docs.select("webapp", *kept, "spec_version", F.explode(every).alias("o")).select("webapp", *kept, "spec_version", "o.template", "o.method", "o.summary", "o.operation_id", "o.parameters")


def contract_parameters(operations: DataFrame) -> DataFrame:
    """One row per parameter of contract_operations(): the operation's declaration wins over the path's."""
    kept = _bound(operations)
    rows = operations.select("webapp", "template", "method", *kept, F.explode("parameters").alias("p")).where(F.col("p.name").rlike(NAME))
    op = U.operation_id(F.col("method"), U.route_id(F.col("webapp"), F.col("template")))
    best = rows.groupBy(op.alias("operation"), F.col("p.location").alias("location"), F.col("p.name").alias("name")).agg(F.max_by(F.struct("p", *kept), F.col("p.level")).alias("x"))
    return best.select("operation", "location", "name", "x.p.type", "x.p.required", "x.p.enum", *(f"x.{c}" for c in kept))


def _once(rows: DataFrame, *by: str) -> DataFrame:
    """One of the rows that share the columns by."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("x")).select(*by, "x.*")


@extractor("openapi_discovery", "Route", "Operation", "Parameter")
def api_contracts(specs: DataFrame, rules: DataFrame | None = None, drops: Observation | None = None, shapes: Observation | None = None) -> DataFrame:
    """Observations of routes, operations and parameters that contracts (url, body) declare, with their edges. Contracts on ports
    of their own are refused. shapes counts the documents, those that declare no paths, and references that lead out of them."""
    docs = in_scope(specs, rules, "openapi_discovery", drops, portless=True)
    if shapes is not None:
        no_spec = F.coalesce(member(F.col("body"), "openapi"), member(F.col("body"), "swagger")).isNull() | ~F.coalesce(F.trim(member(F.col("body"), "paths")).startswith("{"), F.lit(False))
        docs = docs.observe(shapes, F.count(F.lit(1)).alias("documents"), F.count_if(no_spec).alias("no_spec"), F.coalesce(F.sum(external_references(F.col("body"))), F.lit(0)).alias("external_references"))
    ops = contract_operations(docs)
    route = U.route_id(F.col("webapp"), F.col("template"))
    op = U.operation_id(F.col("method"), route)
    kept = _bound(ops)
    ops = written(_once(ops, "webapp", "template", "method"), "contracts")
    routes = _once(ops.select("webapp", "template", "spec_version", *kept), "webapp", "template")
    params = contract_parameters(ops)
    pid, probed = U.parameter_id(F.col("operation"), F.col("name"), F.col("location")), F.lit(True)
    mined = {"enumerated": True, "param_mined": True}
    return O.union_observations(
        O.nodes(routes, "Route", route, 2.0, mined, active_probed=probed, path_template=F.col("template"), webapp=F.col("webapp"), spec_version=F.col("spec_version")), O.edges(routes, "exposes", F.col("webapp"), route, 2.0, active_probed=probed),
        O.nodes(
            ops, "Operation", op, 2.0, mined, active_probed=probed, method=F.col("method"), path_template=F.col("template"), webapp=F.col("webapp"), spec_version=F.col("spec_version"), summary=F.coalesce("summary", F.lit("")),
            operation_id=F.coalesce("operation_id", F.lit("")),
        ),
        O.edges(ops, "exposes", route, op, 2.0, active_probed=probed),
        O.nodes(params, "Parameter", pid, 2.0, ENUMERATED, **{"active_probed": probed, "name": F.col("name"), "in": F.col("location"), "type": F.col("type"), "required": F.col("required"), "enum": F.when(F.size("enum") > 0, F.col("enum"))}),
        O.edges(params, "takes", F.col("operation"), pid, 2.0, active_probed=probed),
    )


_REF = "struct<name:string,kind:string,ofType:struct<name:string,kind:string>>"
_SCHEMA = (
    "struct<data:struct<__schema:struct<queryType:struct<name:string>,mutationType:struct<name:string>,types:array<struct<name:string,kind:string,"
    f"fields:array<struct<name:string,type:{_REF},args:array<struct<name:string,type:{_REF}>>>>>>>>>"
)


def _named(ref: Column) -> Column:
    """The name of a type, through one wrapper."""
    return F.coalesce(F.when(ref["name"].rlike(GRAPHQL_NAME), ref["name"]), F.when(ref["ofType"]["name"].rlike(GRAPHQL_NAME), ref["ofType"]["name"]))


@extractor("graphql_introspect", "ObjectType", "Operation", "Parameter", rule_id="graphql-introspection")
def graphql_contracts(schemas: DataFrame, rules: DataFrame | None = None, drops: Observation | None = None) -> DataFrame:
    """(url, body) of introspection answers -> object types, root fields as operations, and their arguments.
    Answers with errors or without a schema give none; a type is referenced only if it is emitted. Endpoints on ports of
    their own are refused."""
    docs = in_scope(schemas, rules, "graphql_introspect", drops, portless=True)
    kept = _bound(docs)
    route = U.route_id(F.col("webapp"), U.path_template(U.path_of(F.col("url"))))
    docs = docs.select("webapp", *kept, route.alias("route"), F.from_json("body", _SCHEMA)["data"]["__schema"].alias("s")).where("s is not null")
    docs = written(docs, "schemas")
    types = docs.select("webapp", "route", *kept, "s.queryType", "s.mutationType", F.explode("s.types").alias("t")).where(F.col("t.name").rlike(GRAPHQL_NAME))
    objects = types.where(~F.col("t.name").startswith("__")).select("webapp", *kept, F.col("t.name").alias("name"), F.col("t.kind").alias("kind"), F.coalesce(F.array_size("t.fields"), F.lit(0)).alias("field_count"))
    objects = _once(objects, "webapp", "name")
    kind = F.when(F.col("t.name") == F.col("queryType.name"), "query").when(F.col("t.name") == F.col("mutationType.name"), "mutation")
    fields = types.withColumn("kind", kind).where("kind is not null").select("webapp", "route", "kind", *kept, F.explode("t.fields").alias("f")).where(F.col("f.name").rlike(GRAPHQL_NAME))
    op = F.concat(U.operation_id(F.lit("POST"), F.col("route")), F.lit("#"), F.col("f.name"))
    fields = fields.select("webapp", "kind", *kept, op.alias("operation"), F.col("f.name").alias("field"), _named(F.col("f.type")).alias("returns"), "f.args")
    args = fields.select("operation", *kept, F.explode("args").alias("a")).where(F.col("a.name").rlike(GRAPHQL_NAME)).select("operation", *kept, F.col("a.name").alias("name"), _named(F.col("a.type")).alias("type"))
    args = _once(args, "operation", "name")
    pid, probed = U.parameter_id(F.col("operation"), F.col("name"), F.lit("arg")), F.lit(True)
    named = F.concat(F.lit("obj:"), F.col("name"))
    # within one document: the type must be among those that the same schema emits
    refs = fields.join(objects.select("webapp", F.col("name").alias("returns")), ["webapp", "returns"], "left_semi")
    return O.union_observations(
        O.nodes(objects, "ObjectType", named, 2.0, ENUMERATED, active_probed=probed, kind=F.col("kind"), field_count=F.col("field_count")),
        O.nodes(fields, "Operation", F.col("operation"), 2.0, {"param_mined": True, "flow_mapped": False}, active_probed=probed, graphql_kind=F.col("kind"), field=F.col("field"), return_type=F.coalesce("returns", F.lit("")), webapp=F.col("webapp")),
        O.edges(fields, "exposes", F.col("webapp"), F.col("operation"), 2.0, active_probed=probed),
        O.edges(refs, "references_object", F.col("operation"), F.concat(F.lit("obj:"), F.col("returns")), 2.0, active_probed=probed),
        O.nodes(args, "Parameter", pid, 2.0, ENUMERATED, **{"active_probed": probed, "name": F.col("name"), "in": F.lit("argument"), "type": F.coalesce("type", F.lit(""))}), O.edges(args, "takes", F.col("operation"), pid, 2.0, active_probed=probed),
    )


def disabled_introspection(schemas: DataFrame) -> DataFrame:
    """(url, body) of introspection answers whose errors say that there is no schema to read: (webapp, reason)."""
    rows = in_scope(schemas, None, "graphql_introspect", portless=True)
    errors = member(F.col("body"), "errors")
    has = F.from_json("body", _SCHEMA)["data"]["__schema"].isNotNull()
    return rows.where(errors.isNotNull() & ~has).select("webapp", F.coalesce(F.get_json_object(errors, "$[0].message"), F.lit("")).alias("reason")).distinct()


def safe_url(url: Column) -> Column:
    """A web URL on a host name without user and fragment, its query kept; else null."""
    host = U.canonical_host(U.netloc_of(url))
    query = F.regexp_extract(F.trim(url), r"^[^?#]*(\?[^#]*)?", 1)
    shown = F.concat(U.scheme_of(url), F.lit("://"), U.authority(host, U.port_of(url), U.scheme_of(url)), U.path_of(url), query)
    return F.when(U.scheme_of(url).isin("http", "https") & host.rlike(U.FQDN) & F.trim(url).rlike(r"^[\x21-\x7e]+$"), shown)


def kid_set_digest(kids: Column) -> Column:
    """16 hex digits of a set of key ids; a rotation gives another."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(kids)), "\n"), 256), 1, 16)


@extractor("oidc_discovery", "AuthScheme", "Operation", "Token", rule_id="oidc-metadata")
def identity_observations(docs: DataFrame, rules: DataFrame, jwks: DataFrame | None = None, drops: Observation | None = None) -> DataFrame:
    """identity_metadata() of discovery documents (url, body), and key_sets() of the key sets that jwks (url, body, and the
    issuing scheme where it is known) holds."""
    found = identity_metadata(docs, rules, drops)
    return found if jwks is None else O.union_observations(found, key_sets(jwks, rules))


def identity_metadata(docs: DataFrame, rules: DataFrame, drops: Observation | None = None) -> DataFrame:
    """(url, body) of discovery documents -> authentication schemes with the allow-listed fields, and the declared
    endpoints as operations, each only if its own host is in scope."""
    body = F.col("body")
    urls = {k: safe_url(member(body, k)) for k in URL_FIELDS}
    lists = {k: F.array_sort(F.array_distinct(F.filter(F.transform(as_list(member(body, k)), F.trim), lambda x: x != ""))) for k in LIST_FIELDS}
    bound = in_scope(docs, rules, "oidc_discovery", drops)
    rows = bound.where(F.trim("body").startswith("{")).select("webapp", *_BOUND, F.regexp_replace("webapp", r"^web:[a-z]+://", "").alias("authority"), *(v.alias(k) for k, v in urls.items()), *(F.when(F.size(v) > 0, v).alias(k) for k, v in lists.items()))
    rows = written(rows.where(F.coalesce(*(F.col(k).cast("string") for k in (*URL_FIELDS, *LIST_FIELDS))).isNotNull()), "metadata")
    scheme = F.concat(F.lit("auth:"), F.col("authority"), F.lit(":oidc"))
    mapped = F.coalesce("grant_types_supported", "response_types_supported").isNotNull()
    ends = rows.select("proof", "region", F.explode(F.array(*(F.struct(F.col(k).alias("url"), F.lit(m).alias("method"), F.lit(role).alias("role")) for k, m, role in ENDPOINTS))).alias("e")).select("proof", "region", "e.*").where("url is not null")
    ends = retainable(bind_scope(ends.withColumn("host", U.canonical_host(U.netloc_of(F.col("url")))), "host", rules))
    owner = U.webapp_id(U.scheme_of(F.col("url")), F.col("host"), U.port_of(F.col("url")))
    path = F.when(U.path_of(F.col("url")) == "", "/").otherwise(U.path_of(F.col("url")))
    ends = _once(ends.select("proof", "region", "verdict", "rule_matched", "method", "role", owner.alias("webapp"), path.alias("path")), "webapp", "path", "method", "role")
    target, probed = U.operation_id(F.col("method"), U.route_id(F.col("webapp"), F.col("path"))), F.lit(True)
    return O.union_observations(
        O.nodes(rows, "AuthScheme", scheme, 2.0, {"fingerprinted": True, "flow_mapped": F.when(mapped, True)}, active_probed=probed, **{k: F.col(k) for k in (*URL_FIELDS, *LIST_FIELDS)}),
        O.edges(rows, "authenticates_with", F.col("webapp"), scheme, 2.0, active_probed=probed),
        O.nodes(ends, "Operation", target, 1.5, ENUMERATED, active_probed=probed, method=F.col("method"), path_template=F.col("path"), endpoint_role=F.col("role"), webapp=F.col("webapp")),
        O.edges(ends, "exposes", F.col("webapp"), target, 1.5, active_probed=probed),
    )


def sanitized_keys(jwks: DataFrame) -> DataFrame:
    """(url, body) of key sets -> (url, kids, algs, keys, n_redacted): keys as maps by key id, members of private keys redacted."""
    keys = F.filter(F.transform(as_list(member(F.col("body"), "keys")), as_object), lambda k: k.isNotNull())
    rest = [c for c in jwks.columns if c not in ("url", "body")]
    rows = jwks.where(F.trim("body").startswith("{")).select("url", *rest, keys.alias("raw"))
    safe = F.transform("raw", lambda k: F.transform_values(k, lambda name, v: F.when(name.isin(*PRIVATE_JWK), redact(v)).otherwise(v)))
    tokens = lambda name: F.array_sort(F.array_distinct(F.filter(F.transform("raw", lambda k: F.trim(F.try_element_at(k, F.lit(name)))), lambda x: x.isNotNull() & (x != ""))))
    hidden = F.aggregate("raw", F.lit(0), lambda n, k: n + F.size(F.filter(F.map_keys(k), lambda name: name.isin(*PRIVATE_JWK))))
    ordered = F.array_sort(F.transform(safe, lambda k: F.struct(F.coalesce(F.try_element_at(k, F.lit("kid")), F.lit("")).alias("kid"), F.to_json(k).alias("key"))))
    return rows.select("url", *rest, tokens("kid").alias("kids"), tokens("alg").alias("algs"), F.transform(ordered, lambda x: x["key"]).alias("keys"), hidden.alias("n_redacted"))


def key_sets(jwks: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Token observations of key sets (url, body and, where known, scheme: the issuer's), known by the digest of their key ids;
    sets without an id give none. What proves a set is its redacted form."""
    rows = sanitized_keys(in_scope(jwks, rules, "oidc_discovery")).where(F.size("kids") > 0).withColumn("proof", F.array(F.sha2(F.to_json("keys"), 256)))
    token = F.concat(F.lit("tok:"), kid_set_digest(F.col("kids")))
    own = F.concat(F.lit("auth:"), F.regexp_replace("webapp", r"^web:[a-z]+://", ""), F.lit(":oidc"))
    scheme, probed = F.coalesce("scheme", own) if "scheme" in rows.columns else own, F.lit(True)
    return O.union_observations(O.nodes(rows, "Token", token, 2.0, FINGERPRINTED, "S1", active_probed=probed, kids=F.col("kids"), algs=F.col("algs")), O.edges(rows, "issued_by", token, scheme, 2.0, active_probed=probed))


@extractor("associated_domains", "AuthScheme", "Route", "Hypothesis")
def app_associations(docs: DataFrame, rules: DataFrame | None = None, drops: Observation | None = None) -> DataFrame:
    """(url, kind, body), kind applinks or assetlinks -> authentication schemes, declared routes and leads.

    Application links have details as a list, or as a map by application; paths are given as such or as components.
    A path with NOT before it is an exclusion."""
    body = F.col("body")
    based = written(in_scope(docs, rules, "associated_domains", drops), "associations")
    kept = ["host", "webapp", "url", *_bound(based)]
    clean = lambda a: F.array_distinct(F.filter(F.transform(a, F.trim), lambda x: x.isNotNull() & (x != "")))
    details = member(member(body, "applinks"), "details")
    listed = F.transform(as_list(details), lambda d: F.struct(F.coalesce(member(d, "appID"), member(d, "appId")).alias("app"), d.alias("d")))
    keyed = F.coalesce(F.transform(F.map_entries(as_object(details)), lambda e: F.struct(e["key"].alias("app"), e["value"].alias("d"))), F.slice(listed, 1, 0))
    entries = F.concat(listed, keyed)
    apps = F.flatten(F.transform(entries, lambda e: F.concat(F.array(e["app"]), as_list(member(e["d"], "appIDs")))))
    paths = F.flatten(F.transform(entries, lambda e: F.concat(as_list(member(e["d"], "paths")), F.transform(as_list(member(e["d"], "components")), lambda c: F.coalesce(member(c, "/"), member(c, "path"))))))
    web = as_list(member(member(body, "webcredentials"), "apps"))
    links = based.where((F.col("kind") == "applinks") & F.trim("body").startswith("{")).select(*kept, clean(apps).alias("app_ids"), clean(paths).alias("paths"), clean(web).alias("webcredentials"))
    statements = as_list(body)
    target = lambda space: F.filter(statements, lambda s: member(member(s, "target"), "namespace") == space)
    packages = F.transform(target("android_app"), lambda s: member(member(s, "target"), "package_name"))
    prints = F.flatten(F.transform(target("android_app"), lambda s: as_list(member(member(s, "target"), "sha256_cert_fingerprints"))))
    sites = F.transform(target("web"), lambda s: member(member(s, "target"), "site"))
    relations = F.flatten(F.transform(statements, lambda s: as_list(member(s, "relation"))))
    assets = based.where((F.col("kind") == "assetlinks") & F.trim("body").startswith("[")).select(*kept, clean(relations).alias("relations"), clean(packages).alias("packages"), clean(prints).alias("fingerprints"), clean(sites).alias("web_targets"))
    scheme = lambda kind: F.concat(F.lit("auth:"), F.col("host"), F.lit(f":{kind}"))
    declared = links.select(*kept, F.explode("paths").alias("raw")).select(*kept, F.regexp_replace("raw", "^NOT ", "").alias("pattern"), F.col("raw").startswith("NOT ").alias("excluded")).where(F.col("pattern").startswith("/"))
    route = U.route_id(F.col("webapp"), F.col("pattern"))
    probed = F.lit(True)
    declared = _once(declared, "webapp", "pattern", "excluded")
    lead = lambda df, kind, note: O.nodes(df, "Hypothesis", U.hypothesis_id(F.lit(kind), F.col("host")), 0.0, ENUMERATED, active_probed=probed, note=F.lit(note), host=F.col("host"))
    told = lambda paths: {"fingerprinted": F.lit(True), "flow_mapped": paths}
    # Kinds of documents and the words of notes.
    return O.union_observations(
        O.nodes(
            links, "AuthScheme", scheme("applinks"), 1.6, told(F.size("paths") > 0), active_probed=probed, kind=F.lit("apple-app-site-association"), app_ids=F.col("app_ids"), declared_paths=F.col("paths"),
            webcredentials_apps=F.col("webcredentials"), has_webcredentials=F.size("webcredentials") > 0, source_url=F.col("url"),
        ),
        O.nodes(
            assets, "AuthScheme", scheme("assetlinks"), 1.6, told(F.lit(False)), active_probed=probed, kind=F.lit("assetlinks.json"), relations=F.col("relations"), packages=F.col("packages"), sha256_cert_fingerprints=F.col("fingerprints"),
            web_targets=F.col("web_targets"), source_url=F.col("url"),
        ),
        O.edges(links, "authenticates_with", F.col("webapp"), scheme("applinks"), 0.0, active_probed=probed), O.edges(assets, "authenticates_with", F.col("webapp"), scheme("assetlinks"), 0.0, active_probed=probed),
        O.nodes(declared, "Route", route, 1.6, ENUMERATED, active_probed=probed, declared_by=F.lit("applinks"), pattern=F.col("pattern"), excluded=F.col("excluded")), O.edges(declared, "exposes", F.col("webapp"), route, 0.0, active_probed=probed),
        lead(links.where(F.size("app_ids") == 0), "aasa-declares-no-app", "AASA served but declares no appID — a stale or broken association"),
        lead(
            assets.where((F.size("packages") > 0) & (F.size("fingerprints") == 0)), "assetlinks-without-fingerprint",
            "assetlinks declares an android_app with no signing fingerprint — any app claiming that package name would match",
        ),
    )
