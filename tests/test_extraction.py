"""Extraction jobs and graph joins on small invented responses."""

import json

import pytest

from assetgraph.operators import contracts, extract, known, probes, scope


def ids(df, type_=None):
    return sorted(r.id for r in df.collect() if type_ is None or r.type == type_)


def rules(spark):
    return scope.scope_rules(spark, ["*.example.com", "203.0.113.0/24"])


SPEC = {
    "openapi": "3.0.0",
    "components": {"parameters": {"Page": {"$ref": "#/components/parameters/Page~1Base"}, "Page/Base": {"name": "page", "in": "query", "schema": {"type": "integer"}}}, "schemas": {"Item": {"required": ["sku"], "properties": {"sku": {"type": "string"}, "n": {"type": "integer"}}}}},
    "paths": {
        "/items/{id}": {
            "parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "string"}}, {"$ref": "other.json#/x"}],
            "get": {"summary": "Read  one", "parameters": [{"$ref": "#/components/parameters/Page"}, {"name": "id", "in": "path", "required": True, "schema": {"type": "integer"}}]},
            "post": {"requestBody": {"content": {"text/plain": {}, "application/json": {"schema": {"$ref": "#/components/schemas/Item"}}}}, "parameters": [{"name": "e", "in": "query", "schema": {"enum": ["a", "f" * 40]}}]},
        },
        "bad path": {"get": {}},
    },
}


def test_api_contracts(spark):
    specs = spark.createDataFrame([("https://a.example.com/openapi.json", json.dumps(SPEC)), ("https://b.example.com/x", "<html>"), ("https://c.example.com/x", None), ("https://d.example.com/x", '{"paths":{}}')], "url string, body string")
    found = contracts.api_contracts(specs)
    route = "route:web:https://a.example.com/items/{id}"
    assert ids(found, "Route") == [route] and ids(found, "Operation") == [f"op:GET:{route}", f"op:POST:{route}"]
    assert ids(found, "Parameter") == sorted(f"param:op:{m}:{route}#{p}" for m, p in [("GET", "query:page"), ("GET", "path:id"), ("POST", "path:id"), ("POST", "query:e"), ("POST", "body:sku"), ("POST", "body:n")])
    attrs = {r.id: r.attrs for r in found.collect() if r.kind == "node"}
    assert attrs[f"param:op:GET:{route}#path:id"]["type"] == '"integer"' and attrs[f"param:op:POST:{route}#path:id"]["type"] == '"string"'
    assert attrs[f"param:op:POST:{route}#body:sku"]["required"] == "true" and attrs[f"param:op:POST:{route}#body:n"]["required"] == "false"
    assert "f" * 40 not in attrs[f"param:op:POST:{route}#query:e"]["enum"] and attrs[f"op:GET:{route}"]["summary"] == '"Read one"'


def test_swagger_two_body(spark):
    spec = {"swagger": "2.0", "paths": {"/x": {"put": {"parameters": [{"name": "b", "in": "body", "schema": {"properties": {"k": {"type": "string"}}}}]}}}}
    found = contracts.api_contracts(spark.createDataFrame([("https://a.example.com/s", json.dumps(spec))], "url string, body string"))
    assert ids(found, "Parameter") == ["param:op:PUT:route:web:https://a.example.com/x#body:k"]


def test_graphql_contracts(spark):
    named = lambda n: {"kind": "NON_NULL", "name": None, "ofType": {"name": n, "kind": "OBJECT"}}
    query = {"name": "Query", "kind": "OBJECT", "fields": [{"name": "item", "type": named("Item"), "args": [{"name": "id", "type": named("ID")}]}, {"name": "gone", "type": named("Nope"), "args": []}]}
    types = [query, {"name": "Item", "kind": "OBJECT", "fields": []}, {"name": "__Type", "kind": "OBJECT", "fields": []}, {"name": "ID", "kind": "SCALAR", "fields": None}]
    body = {"data": {"__schema": {"queryType": {"name": "Query"}, "mutationType": None, "types": types}}}
    found = contracts.graphql_contracts(spark.createDataFrame([("https://a.example.com/graphql", json.dumps(body)), ("https://b.example.com/graphql", '{"errors":[]}')], "url string, body string"))
    assert ids(found, "ObjectType") == ["obj:ID", "obj:Item", "obj:Query"]
    op = "op:POST:route:web:https://a.example.com/graphql#"
    assert ids(found, "Operation") == [f"{op}gone", f"{op}item"] and ids(found, "Parameter") == [f"param:{op}item#arg:id"]
    assert [r.to for r in found.where("type = 'references_object'").collect()] == ["obj:Item"]


def test_identity_metadata(spark):
    doc = {"issuer": "https://id.example.com/", "token_endpoint": "https://user@id.example.com/token", "authorization_endpoint": "https://login.other.net/auth", "grant_types_supported": ["b", "a", "a"], "client_secret": "hush"}
    found = contracts.identity_metadata(spark.createDataFrame([("https://id.example.com/.well-known/openid-configuration", json.dumps(doc)), ("https://x.example.com/", "[]")], "url string, body string"), rules(spark))
    scheme = found.where("type = 'AuthScheme'").first()
    assert scheme.id == "auth:id.example.com:oidc" and scheme.attrs["grant_types_supported"] == '["a","b"]' and scheme.coverage == {"fingerprinted": True, "flow_mapped": True} and "client_secret" not in scheme.attrs
    assert ids(found, "Operation") == ["op:POST:route:web:https://id.example.com/token"]


def test_key_sets(spark):
    keys = {"keys": [{"kid": "k2", "kty": "RSA", "alg": "RS256", "d": "private-part"}, {"kid": "k1", "kty": "RSA"}]}
    jwks = spark.createDataFrame([("https://id.example.com/jwks", json.dumps(keys)), ("https://id.example.com/none", '{"keys":[{"kty":"RSA"}]}')], "url string, body string")
    safe = contracts.sanitized_keys(jwks).where("size(kids) > 0").first()
    assert safe.kids == ["k1", "k2"] and safe.algs == ["RS256"] and safe.n_redacted == 1 and "private-part" not in "".join(safe.keys)
    token = contracts.key_sets(jwks).where("type = 'Token'").collect()
    assert len(token) == 1 and token[0].attrs["kids"] == '["k1","k2"]' and len(token[0].id) == 20


def test_app_associations(spark):
    aasa = {"applinks": {"details": [{"appIDs": ["T.app"], "components": [{"/": "/buy/*"}]}, {"appID": "T.old", "paths": ["NOT /private/*", "relative"]}]}, "webcredentials": {"apps": ["T.app"]}}
    links = [{"relation": ["delegate"], "target": {"namespace": "android_app", "package_name": "com.example"}}, {"target": {"namespace": "web", "site": "https://www.example.com"}}]
    rows = [("https://a.example.com/x", "applinks", json.dumps(aasa)), ("https://b.example.com/x", "applinks", '{"applinks":{"details":{"T.k":{"paths":["/k"]}}}}'), ("https://c.example.com/x", "applinks", "{}"), ("https://d.example.com/x", "assetlinks", json.dumps(links)), ("https://e.example.com/x", "assetlinks", None)]
    found = contracts.app_associations(spark.createDataFrame(rows, "url string, kind string, body string"))
    assert ids(found, "Route") == ["route:web:https://a.example.com/buy/*", "route:web:https://a.example.com/private/*", "route:web:https://b.example.com/k"]
    assert ids(found, "Hypothesis") == ["hyp:aasa-declares-no-app:c.example.com", "hyp:assetlinks-without-fingerprint:d.example.com"]
    attrs = {r.id: r.attrs for r in found.collect()}
    assert attrs["auth:a.example.com:applinks"]["app_ids"] == '["T.app","T.old"]' and attrs["auth:a.example.com:applinks"]["has_webcredentials"] == "true"
    assert attrs["route:web:https://a.example.com/private/*"]["excluded"] == "true" and attrs["auth:d.example.com:assetlinks"]["packages"] == '["com.example"]'


def test_dns_answers(spark):
    rows = [
        ("a.example.com", "edge.vendor.net", ["a.example.com", "b.example.com"], ["203.0.113.9", "203.0.113.10", "203.0.113.9", "198.51.100.1", "2001:DB8::1", "junk"], None), ("gone.example.com", None, None, None, "EAI_NONAME"),
        ("late.example.com", None, None, None, "EAI_AGAIN"), ("a.other.net", None, None, ["203.0.113.1"], None),
    ]
    answers = spark.createDataFrame(rows, "name string, canonical string, aliases array<string>, addresses array<string>, errno string")
    nodes = spark.createDataFrame([("hyp:dns-candidate:a.example.com", None), ("dns:gone.example.com", ["old.vendor.net"]), ("dns:late.example.com", ["x.vendor.net"])], "id string, cname_targets array<string>")
    edges = spark.createDataFrame([("dns:gone.example.com", "dns:other.vendor.net", "cname_to")], "frm string, to string, type string")
    found = probes.dns_answers(answers, rules(spark), nodes, edges)
    assert ids(found, "DNSName") == ["dns:a.example.com", "dns:b.example.com"] and ids(found, "Host") == ["host:203.0.113.10", "host:203.0.113.9"]
    assert ids(found, "corroborates") == ["corroborates:hyp:dns-candidate:a.example.com->dns:a.example.com"] and ids(found, "Hypothesis") == ["hyp:dangling-cname:gone.example.com"]
    attrs = {r.id: r.attrs for r in found.collect() if r.kind == "node"}
    assert attrs["hyp:dangling-cname:gone.example.com"]["cname_targets"] == '["old.vendor.net","other.vendor.net"]' and attrs["dns:a.example.com"]["cname_targets"] == '["b.example.com","edge.vendor.net"]'
    assert probes.canonical_addresses(answers).where("name = 'a.example.com'").first().ips == ["198.51.100.1", "203.0.113.9", "203.0.113.10", "2001:db8::1"]


HOSTS = "ip string, attrs map<string,string>"
EDGES = "seq long, frm string, to string, type string"


def test_services_and_ledger(spark):
    hosts = spark.createDataFrame([("203.0.113.1", {"cdn": "x"}), ("203.0.113.2", {}), ("203.0.113.3", {"fqdn": "www.shop.example.co.uk"}), ("203.0.113.4", None)], HOSTS)
    edges = spark.createDataFrame([(2, "dns:b.example.com", "host:203.0.113.2", "resolves_to"), (1, "dns:a.example.net", "host:203.0.113.2", "resolves_to"), (3, "host:203.0.113.4", "net:x", "fronted_by")], EDGES)
    assert {r.ip: r.ledger_key for r in known.ledger_key(hosts, edges).collect()} == {"203.0.113.1": "203.0.113.1", "203.0.113.2": "example.net", "203.0.113.3": "example.co.uk", "203.0.113.4": "203.0.113.4"}
    assert {r.ip: r.shared_tenant for r in known.shared_tenant(hosts, edges).collect()} == {"203.0.113.1": True, "203.0.113.2": False, "203.0.113.3": False, "203.0.113.4": True}
    connects = spark.createDataFrame([("203.0.113.1", 443, "TCP", "open"), ("203.0.113.2", 22, "tcp", "closed"), ("203.0.113.9", 80, "tcp", "open")], "ip string, port int, proto string, outcome string")
    found = probes.service_observations(connects, hosts, edges, rules(spark))
    assert ids(found, "Service") == ["svc:203.0.113.1:443/tcp", "svc:203.0.113.9:80/tcp"] and [r.frm for r in found.where("type = 'hosted_on'").collect()] == ["svc:203.0.113.1:443/tcp"]


def test_tls_observations(spark):
    sans = [("DNS", "*.example.com"), ("DNS", "new.example.com"), ("DNS", "known.example.com"), ("email", "me@example.com"), ("DNS", "x.other.net"), ("DNS", "a.example.com")]
    certs = spark.createDataFrame([("a.example.com", "01", "Jan  5 00:00:00 2026 GMT", "2026-04-05 00:00:00", sans, b"der", "TLSv1.3"), ("x.other.net", "02", None, None, [], None, None)], "host string, serial string, not_before string, not_after string, sans array<struct<kind:string,value:string>>, der binary, tls_version string")
    found = probes.tls_observations(certs, rules(spark), spark.createDataFrame([("dns:known.example.com",), ("dns:example.com",)], "id string"))
    assert ids(found, "WebApp") == ["web:https://a.example.com"] and ids(found, "Hypothesis") == ["hyp:dns-candidate:new.example.com"]
    cert = found.where("type = 'Certificate'").first()
    assert cert.attrs["not_before"] == '"2026-01-05T00:00:00Z"' and cert.attrs["not_after"] == '"2026-04-05T00:00:00Z"' and "me@" not in str(found.collect())


def test_guards(spark):
    seen = spark.createDataFrame([("a", "t", "s1")], "id string, tool string, sha256 string")
    new = spark.createDataFrame([("a", "t", "s1"), ("a", "t", "s2"), ("b", "t", "s1"), ("a", "u", "s1")], "id string, tool string, sha256 string")
    assert known.already_recorded(new, seen).count() == 3
    kids = spark.createDataFrame([("r1", "w1"), ("r2", "w2"), ("r3", None)], "id string, webapp string")
    assert [r.id for r in known.orphan_guard(kids, spark.createDataFrame([("w1",)], "id string"), "webapp").collect()] == ["r1"]


def both(spark):
    return scope.scope_rules(spark, ["*.example.com", "203.0.113.0/24", "2001:db8::/32"], ["x.example.com"], ["*.example.net"], wildcard_includes_apex=False)


def test_seeds(spark):
    values = ["a.example.com", "A.example.com.", "*.b.example.com", "https://a.example.com/x", "# note", "", None, "203.0.113.7", "203.0.113.0/25", "2001:db8::1", "10.0.0.1", "w.example.net", "x.example.com", "not a host", "*.10.0.0.1"]
    seeds = spark.createDataFrame([(v,) for v in values], "value string")
    rows = {r.canonical: r for r in extract.ingest_seeds(seeds, both(spark)).collect()}
    assert set(rows) == {"a.example.com", "b.example.com", "203.0.113.7", "203.0.113.0/25", "2001:db8::1", "10.0.0.1", "w.example.net", "x.example.com"}
    assert rows["a.example.com"].spellings == ["A.example.com.", "a.example.com", "https://a.example.com/x"] and rows["b.example.com"].wildcard
    found = extract.seed_observations(seeds, both(spark))
    # the apex example.com has a verdict of its own, which refuses it
    assert ids(found, "DNSName") == ["dns:a.example.com", "dns:b.example.com", "dns:w.example.net"] and ids(found, "Domain") == [] and ids(found, "subdomain_of") == []
    assert ids(found, "Host") == ["host:2001:db8::1", "host:203.0.113.7"] and ids(found, "NetBlock") == ["net:203.0.113.0/25"]
    attrs = {r.id: r.attrs for r in found.collect()}
    assert attrs["net:203.0.113.0/25"]["prefixlen"] == "25" and attrs["dns:b.example.com"]["wildcard_seed"] == "true" and "wildcard_seed" not in attrs["dns:a.example.com"]
    apex = extract.seed_observations(spark.createDataFrame([("a.example.com",), ("example.com",)], "value string"), rules(spark))
    assert ids(apex, "Domain") == ["domain:example.com"] and ids(apex, "subdomain_of") == ["subdomain_of:dns:a.example.com->domain:example.com"]


def test_certificate_names(spark):
    body = json.dumps([{"name_value": "a.example.com\n*.b.example.com\nc.*.example.com\nme@example.com"}, {"name_value": "x.example.com\n203.0.113.9\nevil.org"}])
    rows = spark.createDataFrame([("example.com", body), ("example.com", "<html>"), ("y", None)], "apex string, body string")
    assert ids(extract.ct_observations(rows, both(spark))) == ["dns:a.example.com", "dns:b.example.com"]
    assert {r.host: r.verdict for r in extract.ct_drops(rows, both(spark)).collect()} == {"x.example.com": "out_of_scope", "evil.org": "out_of_scope"}
    kept = {r.pii_redactions: r.raw for r in extract.ct_evidence(rows).collect()}
    assert set(kept) == {0, 1} and "me@" not in kept[1]


def test_archives_expose_their_routes(spark):
    captures = spark.createDataFrame([("https://a.example.com/x/1", "20200101000000"), ("https://a.example.com/x/2", "20190101000000"), ("https://evil.org/", "20190101000000"), ("ftp://a.example.com/", "bad")], "original string, timestamp string")
    found = extract.archive_observations(captures, rules(spark))
    route = "route:web:https://a.example.com/x/{id}"
    assert ids(found) == sorted(["web:https://a.example.com", route, f"exposes:web:https://a.example.com->{route}"])
    assert {r.attrs["archived_timestamp"] for r in found.collect() if r.kind == "node"} == {'"20190101000000"'}


def test_candidates_are_new_and_in_scope(spark):
    hosts = spark.createDataFrame([("web1.example.com",), ("web1.evil.org",)], "host string")
    nodes = spark.createDataFrame([("dns:api.example.com",), ("hyp:dns-candidate:dev.example.com",)], "id string")
    found = ids(extract.candidate_observations(hosts, nodes, rules(spark)))
    assert "hyp:dns-candidate:web2.example.com" in found and not any("evil" in i or "api." in i or "dev." in i for i in found) and "hyp:dns-candidate:qa.example.com" in found


def test_responses(spark):
    head = {"CF-Ray": "1", "Server": "nginx", "Location": "https://b.example.com:8443/p?code=1", "Strict-Transport-Security": "x"}
    rows = [
        ("https://a.example.com/", "get", 200, {"server": "AkamaiGHost"}, "<title> Hi  there</title>"), ("https://a.example.com/", "HEAD", 301, head, None), ("https://b.example.com:8443/", "HEAD", 302, head, None), ("https://evil.org/", "GET", 200, {}, ""),
        ("https://c.example.com/", "HEAD", 302, {"Location": "https://u:p@c.example.com/", "x-varnish": ""}, None),
    ]
    table = spark.createDataFrame(rows, "url string, method string, status int, headers map<string,string>, body string")
    found = {r.id: r for r in extract.http_observations(table, rules(spark)).collect()}
    a, b, c = (found[f"web:https://{h}"].attrs for h in ("a.example.com", "b.example.com:8443", "c.example.com"))
    assert a["cdn_or_waf"] == '"akamai"' and a["title"] == '"Hi there"' and a["hsts"] == "false" and "redirect_to" not in a
    assert b["cdn_or_waf"] == '"cloudflare"' and b["redirect_to"] == '"https://b.example.com/p"' and b["hsts"] == "true"
    assert c["cdn_or_waf"] == '"varnish"' and "redirect_to" not in c
    assert {i for i in found if i.startswith("op:")} == {"op:GET:route:web:https://a.example.com/", "op:HEAD:route:web:https://a.example.com/", "op:HEAD:route:web:https://b.example.com:8443/", "op:HEAD:route:web:https://c.example.com/"}
    assert sum(i.startswith("exposes:") for i in found) == 4 and not any("evil" in i for i in found)


def test_mail_leads(spark):
    rows = [
        ("a.example.com", "TXT", ["v=spf1 include:_spf.gone.com include:gone.net redirect=OK.com. ~all", "other"]), ("_dmarc.a.example.com.", "TXT", ["v=DMARC1; p=none; sp=reject; pct=50; rua=mailto:x@y"]), ("_mta-sts.a.example.com", "TXT", ["v=STSv1; id=1"]),
        ("a.example.com", "MX", ["10 mx.gone.com.", "20 mx.ok.com"]), ("b.example.com", "TXT", ["v=spf1 -all"]), ("_dmarc.b.example.com", "TXT", ["v=DMARC1; p=reject"]), ("evil.org", "TXT", ["v=spf1 +all"]),
    ]
    records = spark.createDataFrame(rows, "name string, rrtype string, rdata array<string>")
    resolvable = spark.createDataFrame([("ok.com",), ("mx.ok.com",)], "name string")
    found = extract.email_observations(records, resolvable, rules(spark))
    # names with underscores are no hosts, so _spf.gone.com is not asked for
    assert ids(found, "Hypothesis") == ["hyp:email-spoofable:a.example.com", "hyp:mx-dangling:a.example.com|mx.gone.com", "hyp:spf-dangling-include:a.example.com|gone.net"]
    attrs = {r.id: r.attrs for r in found.collect()}["auth:a.example.com:email"]
    assert attrs["mx_hosts"] == '["mx.gone.com","mx.ok.com"]' and attrs["spf_includes"] == '["_spf.gone.com","gone.net","ok.com"]' and attrs["mta_sts_present"] == attrs["dmarc_has_reporting"] == "true" and attrs["dmarc_subdomain_policy"] == '"reject"'
    assert not any("@" in str(v) for v in attrs.values()) and ids(found, "AuthScheme") == ["auth:a.example.com:email", "auth:b.example.com:email"]


def test_extractors_have_one_name_each():
    assert extract.get_extractor("wayback") is extract.archive_observations and {"seeds", "crtsh", "permutations", "http_probe", "email_posture"} <= set(extract.EXTRACTORS)
    with pytest.raises(ValueError):
        extract.register_extractor("wayback", (), print)
    with pytest.raises(KeyError):
        extract.get_extractor("nope")


def test_references_into_arrays_and_out_of_documents(spark):
    from pyspark.sql import Observation

    spec = {
        "openapi": "3.1.0", "shared": {"list": [{"name": "zero", "in": "query"}, {"$ref": "#/shared/by'name"}], "by'name": {"name": "one", "in": "query", "schema": {"enum": [1, 2.5, "x"]}}, "7": {"name": "seven", "in": "header"}, "": {}},
        "paths": {"/a": {"parameters": [{"$ref": f"#/shared/{p}"} for p in ("list/0", "list/1", "list/2", "7", "none", "/x")] + [{"$ref": "other.json#/a"}, {"$ref": "#/paths/~1a/parameters/6"}], "get": {}}},
    }
    docs = spark.createDataFrame([("https://a.example.com/s", json.dumps(spec)), ("https://b.example.com/s", "{}"), ("https://c.example.com/s", '{"openapi": "3", "openapi": "3", "paths": {"/x": {"get": {}}}}')], "url string, body string")
    found = {p.name: p for r in contracts.contract_operations(docs).where("template = '/a'").collect() for p in r.parameters}
    assert sorted(found) == ["one", "seven", "zero"] and found["one"].enum == ["1", "2.5", "x"]
    seen = Observation("shapes")
    kinds = [r.type for r in contracts.api_contracts(docs, shapes=seen).select("type").collect()]
    assert kinds.count("Route") == 2 and kinds.count("Parameter") == 3
    assert seen.get == {"documents": 3, "no_spec": 1, "external_references": 1}


def test_hosts_beyond_ascii_are_one_host_in_every_job(spark):
    rules = scope.scope_rules(spark, ["*.xn--mnchen-3ya.example", "xn--mnchen-3ya.example"], [], [])
    name = "www.xn--mnchen-3ya.example"
    captures = spark.createDataFrame([("http://www.München.example:8080/a", "20200101000000"), (f"http://{name}/b", "20190101000000"), ("http://u@www.münchen.example/c", "20190101000000")], "original string, timestamp string")
    got = sorted((r.type, r.host, r.template) for r in extract.archive_routes(captures, rules).collect())
    assert got == [("Route", name, "/a"), ("Route", name, "/b"), ("WebApp", name, "")]
    logged = spark.createDataFrame([("münchen.example", json.dumps([{"name_value": f"*.www.MÜNCHEN.example\n{name}\n"}]))], "apex string, body string")
    assert [r.id for r in extract.ct_names(logged, rules).collect()] == [f"dns:{name}"]
    seeds = spark.createDataFrame([("https://www.münchen.example/x",), (name,)], "value string")
    assert [(r.id, r.verdict, len(r.spellings)) for r in extract.ingest_seeds(seeds, rules).collect()] == [(f"dns:{name}", "in_scope", 2)]
    spec = spark.createDataFrame([("https://www.münchen.example/s", '{"openapi": "3", "paths": {"/x": {"get": {}}}}')], "url string, body string")
    assert [r.webapp for r in contracts.contract_operations(contracts.in_scope(spec, rules, "t")).collect()] == [f"web:https://{name}"]
    answers = spark.createDataFrame([("www.münchen.example", "cdn.münchen.example", ["a.example.com"], ["10.0.0.1"], None)], "name string, canonical string, aliases array<string>, addresses array<string>, errno string")
    none = spark.createDataFrame([], "id string, cname_targets array<string>"), spark.createDataFrame([], "type string, frm string, to string")
    ids = {r.id for r in probes.dns_answers(answers, rules, *none).where("kind = 'node'").collect()}
    assert f"dns:{name}" in ids and "dns:cdn.xn--mnchen-3ya.example" in ids
    certs = spark.createDataFrame([("www.münchen.example", [("DNS", "*.münchen.example"), ("DNS", "xn--mnchen-3ya.example")])], "host string, sans array<struct<kind:string,value:string>>")
    row = probes.certificate_names(certs).first()
    assert (row.host, row.sans) == (name, ["xn--mnchen-3ya.example"])


def test_caps_say_what_they_leave_out(spark):
    answers = spark.createDataFrame([("a", [f"10.0.{k // 250}.{k % 250}" for k in range(probes.MAX_ADDRESSES + 3)]), ("b", ["10.0.0.1", "10.0.0.1", "x"])], "name string, addresses array<string>")
    assert {r.name: (len(r.ips), r.left_out) for r in probes.canonical_addresses(answers).collect()} == {"a": (probes.MAX_ADDRESSES, 3), "b": (1, 0)}
    certs = spark.createDataFrame([("a.example.com", [("DNS", f"n{k}.example.com") for k in range(probes.MAX_SANS + 2)])], "host string, sans array<struct<kind:string,value:string>>")
    row = probes.certificate_names(certs).first()
    assert (len(row.sans), row.n_left_out) == (probes.MAX_SANS, 2)
    spf = "v=spf1 " + " ".join(f"include:s{k}.net" for k in range(extract.MAX_INCLUDES + 1)) + " -all"
    mail = spark.createDataFrame([("a.com", "TXT", [spf]), ("a.com", "MX", [f"10 m{k}.net" for k in range(extract.MAX_MX + 4)]), ("b.com", "TXT", ["v=spf1 -all"])], "name string, rrtype string, rdata array<string>")
    got = {r.domain: (r.spf_includes_left_out, r.mx_left_out, len(r.mx_hosts)) for r in extract.email_posture(mail).collect()}
    assert got == {"a.com": (1, 4, extract.MAX_MX), "b.com": (0, 0, 0)}


def test_a_run_without_a_fresh_snapshot_finds_nothing_and_says_why(spark):
    from assetgraph.operators import observe
    from assetgraph.sources import events

    seeds, log = spark.createDataFrame([("a.example.com",)], "value string"), spark.createDataFrame([], events.EVENT)
    taken = events.take_snapshot(spark, "policy", ["*.example.com"], [], [], "2026-01-10 00:00:00")
    run = observe.Run("r", "2026-01-10T01:00:00Z", taken.first().snapshot_id)
    for snapshot, now, n, reason in ((taken, "2026-01-10 01:00:00", True, []), (taken, "2026-01-12 00:00:00", False, ["the snapshot is stale"]), (taken.limit(0), "2026-01-10 01:00:00", False, ["no snapshot is pinned"])):
        last = events.latest_snapshot(snapshot, now)
        new, _ = extract.run_extractor("seeds", run, log, seeds, rules(spark), snapshot=last)
        assert (new.count() > 0) == n and [r.reason for r in events.refusals(last).collect()] == reason
