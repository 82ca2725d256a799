import ipaddress

import pytest
from pyspark.sql import functions as F

from assetgraph.functions import confidence as C
from assetgraph.functions import urls as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "want"),
    [("HTTPS://API.Example.com:443/x", "api.example.com"), ("user:pw@api.example.com:8443", "api.example.com"), ("[2001:db8::1]:443", "2001:db8::1"), (" A.example.com. ", "a.example.com"), (None, ""), ("", "")],
)
def test_canonical_host(spark, value, want):
    assert one(spark, U.canonical_host(F.lit(value))) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/v1/items/12345", "/v1/items/{id}"), ("/a/deadbeefdeadbeef", "/a/{id}"), ("", "/"), (None, "/"), ("//x//y/", "/x/y"), ("/u/me@example.com", ""), ("/a b", ""), ("/" + "a/" * 13, ""),
        ("/ForgotPasswordConfirmation", "/ForgotPasswordConfirmation"), ("/" + "a" * 40, "/{id}"), ("/A/b", "/A/b"),
    ],
)
def test_path_template(spark, path, want):
    assert one(spark, U.path_template(F.lit(path).cast("string"))) == want


@pytest.mark.parametrize(("host", "want"), [("x.y.example.co.uk", "example.co.uk"), ("a.b.user.github.io", "user.github.io"), ("a.b.example.com", "example.com"), ("10.0.0.1", "10.0.0.1"), ("localhost", "localhost")])
def test_registrable_domain(spark, host, want):
    assert one(spark, U.registrable_domain(F.lit(host))) == want


def test_canonical_url_sorts_the_query_and_drops_the_default_port(spark):
    assert one(spark, U.canonical_url(F.lit("https://A.example.com:443/p?b=2&a=1#f"))) == "https://a.example.com/p?a=1&b=2"


def test_authority_brackets_ipv6(spark):
    assert one(spark, U.authority(F.lit("2001:db8::1"), F.lit(8443), F.lit("https"))) == "[2001:db8::1]:8443"


@pytest.mark.parametrize(("text", "want"), [("P1D", 86400), ("PT2H", 7200), ("P", 0), ("nonsense", 14 * 86400), (None, 14 * 86400)])
def test_parse_duration(spark, text, want):
    assert one(spark, U.parse_duration(F.lit(text).cast("string"))) == want


def test_binding_subject(spark):
    none = F.create_map().cast("map<string,string>")
    assert one(spark, U.binding_subject(F.lit("svc:1.2.3.4:443/tcp"), none)) == "1.2.3.4"
    assert one(spark, U.binding_subject(F.lit("hyp:dns-candidate:dev.example.com"), none)) == "dev.example.com"
    assert one(spark, U.binding_subject(F.lit("tok:1"), none)) == ""


def test_idna_touches_only_hosts_beyond_ascii(spark):
    rows = U.with_idna(spark.createDataFrame([("münchen.example",), ("a.example",), (None,)], "host string"), "host").collect()
    assert sorted(r.host or "" for r in rows) == ["", "a.example", "xn--mnchen-3ya.example"]


def test_minimise_pii_replaces_each_address(spark):
    got = one(spark, C.minimise_pii(F.lit("to a@example.com, b@example.org!")))
    assert got.startswith("to …+") and "@" not in got and got.endswith("!") and got.count("…+") == 2


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("203.0.113.77/24", (4, 24, "11001011")), ("10.0.0.1", (4, 32, "00001010")), ("2001:db8::1", (6, 128, "00100000")), ("::", (6, 128, "00000000")), ("1:2:3:4:5:6:7::", (6, 128, "00000000")), ("::ffff:1.2.3.4", (6, 128, "00000000")), ("fe80::/10", (6, 10, "11111110")),
        ("a.example.com", None), ("2001:db8::1::2", None), ("1:2:3:4:5:6:7:8:9", None), ("10.0.0.0/33", None), ("10.0.0.0/", None), ("12345::", None), (":1::", None), ("", None), (None, None),
    ],
)
def test_networks(spark, value, want):
    r = one(spark, U.ip_network(F.lit(value).cast("string")))
    assert (r if r is None else (r.version, r.length, r.bits[:8])) == want
    if r is not None:
        net = ipaddress.ip_interface(value)
        assert int(r.bits, 2) == int(net.ip)
