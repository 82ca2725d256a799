"""Host, URL and identifier expressions: native columns, for use in any select or filter.

Parsing is one regular expression over the URL, not Spark's parse_url, which gives null for hosts with
underscores. Hosts beyond ASCII go through ``with_idna`` and ``with_ascii_hosts``, which run Python only on the rows that
need it.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

# Two-label public suffixes under which names are registered at the third label.
MULTI_SUFFIX = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw", "edu.au", "firm.in",
    "gen.in", "github.io", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.uk", "govt.nz", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.in", "net.nz", "net.uk", "net.za", "or.jp",
    "or.kr", "org.au", "org.br", "org.cn", "org.in", "org.nz", "org.uk", "org.za", "sch.uk",
)
# Shapes of path segments that are identifiers.
OPAQUE = (
    r"^[0-9]+$", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"(?i)^[0-9a-f]{16,}$", r"^[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}$",
    r"^[A-Za-z0-9_-]{40,}$", r"^(?=.*[0-9])[A-Za-z0-9]{20,}$",
)
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443}
MAX_SEGMENTS, MAX_TEMPLATE = 12, 200
IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
FQDN = r"^[a-z0-9_]([a-z0-9_-]*[a-z0-9_])?(\.[a-z0-9_]([a-z0-9_-]*[a-z0-9_])?)+$"
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
#: A host with its port: one colon alone.
_PORT = r"([^:]*):(?=[^:]*\z).*$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, k)


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc_of(url: Column) -> Column:
    return _part(url, 2)


def path_of(url: Column) -> Column:
    return _part(url, 3)


def canonical_host(value: Column) -> Column:
    """Lower case; without scheme, path, user, brackets, a single port and final dots. Null is empty. The value is named once, so
    that hosts of hosts are not worked out many times over."""
    host = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    host = F.regexp_replace(host, r"^.*?://", "")
    host = F.regexp_replace(host, r"/.*$", "")
    host = F.regexp_replace(host, r"^.*@", "")
    # what is in brackets, or else what is before the only colon
    host = F.regexp_replace(host, rf"(?s:^\[([^\]]*).*$)|^(?!\[){_PORT}", "$1$2")
    return F.regexp_replace(host, r"\.+$", "")


def normalize_host(value: Column) -> Column:
    """The weaker form for scope matching: scheme, path, port and final dots go; user and brackets stay."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"^.*?://", ""), r"/.*$", "")
    return F.regexp_replace(F.regexp_replace(host, f"^{_PORT}", "$1"), r"\.+$", "")


def _idna(host: str) -> str:
    """The host in ASCII form; what has none stays as it is."""
    try:
        return host.encode("idna").decode("ascii").lower()
    except UnicodeError:
        return host


def _idna_all(host: pd.Series) -> pd.Series:
    return host.map(_idna, na_action="ignore")


def _idna_lists(hosts: pd.Series) -> pd.Series:
    return hosts.map(lambda x: [h if h is None else _idna(h) for h in x], na_action="ignore")


def _ascii(text: Column) -> Column:
    return F.coalesce(F.octet_length(text) == F.char_length(text), F.lit(True))


def with_idna(df: DataFrame, column: str) -> DataFrame:
    """df with the column of hosts, or of lists of hosts, in ASCII form; only rows beyond ASCII visit Python. df is read twice."""
    many = isinstance(df.schema[column].dataType, ArrayType)
    plain = _ascii(F.array_join(column, "")) if many else _ascii(F.col(column))
    encoded = F.pandas_udf(_idna_lists, "array<string>") if many else F.pandas_udf(_idna_all, "string")
    return df.where(plain).unionByName(df.where(~plain).withColumn(column, encoded(column)))


def with_ascii_hosts(df: DataFrame, column: str) -> DataFrame:
    """df with the hosts of the column of URLs in ASCII form; user, port, path, query and fragment stay. Only URLs beyond ASCII
    visit Python, and of these the host alone. df is read twice."""
    shape = r"(?s)^(\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?)([^/?#@:]*)(.*)$"
    part = lambda k: F.regexp_extract(column, shape, k)
    plain = _ascii(F.col(column))
    moved = df.where(~plain).withColumn(column, F.when(F.col(column).rlike(shape), F.concat(part(1), F.pandas_udf(_idna_all, "string")(F.lower(part(2))), part(3))).otherwise(F.col(column)))
    return df.where(plain).unionByName(moved)


def is_ipv4(host: Column) -> Column:
    return host.rlike(IPV4)


def valid_fqdn(host: Column) -> Column:
    """Of a canonical host: a plausible name, not an address."""
    labels = F.split(host, r"\.")
    return (F.length(host) <= 253) & (F.size(labels) >= 2) & ~is_ipv4(host) & F.forall(labels, lambda x: x.rlike(r"^(?!-)[a-z0-9-]{1,63}(?<!-)$"))


def registrable_domain(host: Column) -> Column:
    """Of a canonical host: its last two labels, or three below a two-label suffix; an address as it is."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, n - (k - 1), F.lit(k)), ".")
    return F.when(is_ipv4(host) | host.contains(":") | (n <= 2), host).when(last(2).isin(*MULTI_SUFFIX), last(3)).otherwise(last(2))


def authority(host: Column, port: Column, scheme: Column) -> Column:
    """host or host:port without the scheme's default port; IPv6 in brackets. A null port is none."""
    shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    usual = F.lit(None).cast("int")
    for name, number in DEFAULT_PORTS.items():
        usual = F.when(scheme == name, number).otherwise(usual)
    return F.when(port.isNull() | (port == F.coalesce(usual, F.lit(-1))), shown).otherwise(F.concat(shown, F.lit(":"), port.cast("string")))


def port_of(url: Column) -> Column:
    return F.regexp_extract(netloc_of(url), r":([0-9]+)$", 1).try_cast("int")


def _unescaped(text: Column) -> Column:
    """A query part as text: + is a space, %XX a byte of UTF-8; what is no escape stays, and bytes that are no UTF-8 become
    U+FFFD. The text is read as hex: each escape is its two digits, anything else the hex of its bytes."""
    plain = F.replace(text, F.lit("+"), F.lit(" "))
    pieces = F.regexp_extract_all(plain, F.lit("(?s)%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    code = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike("^%[0-9A-Fa-f]{2}$"), F.substring(x, 2, 2)).otherwise(F.hex(x.cast("binary")))), "")
    return F.when(text.contains("%"), F.make_valid_utf8(F.unhex(code).cast("string"))).otherwise(plain)


def _escaped(text: Column) -> Column:
    """Form encoding: letters, digits and _ . - ~ stay, a space is +, all else %XX of its bytes."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(query: Column) -> Column:
    """The pairs of a query, decoded, sorted and encoded again; a pair without = has an empty value, an empty pair goes."""
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    pair = lambda x: F.struct(_unescaped(F.substring_index(x, "=", 1)).alias("k"), _unescaped(F.regexp_replace(x, "(?s)^[^=]*=?", "")).alias("v"))
    return F.array_join(F.transform(F.sort_array(F.transform(pairs, pair)), lambda x: F.concat(_escaped(x["k"]), F.lit("="), _escaped(x["v"]))), "&")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, default port and fragment gone, path at least /, query decoded, sorted and encoded again. Without
    a scheme it is https; without // before it there is no host, and all is path and query."""
    text = F.trim(url)
    shape = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
    part = lambda k: F.regexp_extract(text, shape, k)
    scheme = F.when(part(1) == "", "https").otherwise(F.lower(part(1)))
    port = F.regexp_extract(part(2), r":([0-9]+)$", 1).try_cast("int")
    host = F.regexp_replace(F.lower(part(2)), "^.*@", "")
    host = F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)", 1)).otherwise(F.regexp_replace(host, ":.*$", ""))
    path = F.when(part(3) == "", "/").otherwise(part(3))
    query = canonical_query(part(4))
    return F.concat(scheme, F.lit("://"), authority(F.regexp_replace(host, r"\.+$", ""), port, scheme), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_opaque_segment(segment: Column) -> Column:
    out = F.lit(False)
    for shape in OPAQUE:
        out = out | segment.rlike(shape)
    return out


def path_template(path: Column) -> Column:
    """Identifiers become {id}, empty segments go; empty where the path is unsafe, holds @, or is too deep or long."""
    def shape(full: Column) -> Column:
        segments = F.filter(F.split(full, "/"), lambda x: x != "")
        bad = lambda segs, shown: ~full.rlike(r"^[\x21-\x7e]*$") | full.contains("@") | (F.size(segs) > MAX_SEGMENTS) | (F.length(shown) > MAX_TEMPLATE)
        shown = lambda segs: F.concat(F.lit("/"), F.array_join(F.transform(segs, lambda x: F.when(is_opaque_segment(x), "{id}").otherwise(x)), "/"))
        return _once(segments, lambda segs: _once(shown(segs), lambda text: F.when(bad(segs, text), "").otherwise(text)))

    return _once(F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path), shape)


def parse_webapp(url: Column) -> Column:
    """struct(scheme, host, port, id) of a web URL's application, else null. Readers of contracts take only those whose
    port is null."""
    host, scheme, port = canonical_host(netloc_of(url)), scheme_of(url), port_of(url)
    return F.when(scheme.isin("http", "https") & (host != ""), F.struct(scheme.alias("scheme"), host.alias("host"), port.alias("port"), webapp_id(scheme, host, port).alias("id")))


def webapp_id(scheme: Column, host: Column, port: Column | None = None) -> Column:
    return F.concat(F.lit("web:"), scheme, F.lit("://"), authority(host, port if port is not None else F.lit(None).cast("int"), scheme))


def route_id(webapp: Column, template: Column) -> Column:
    return F.concat(F.lit("route:"), webapp, template)


def dns_id(host: Column) -> Column:
    return F.concat(F.lit("dns:"), host)


def domain_id(host: Column) -> Column:
    return F.concat(F.lit("domain:"), registrable_domain(host))


def host_id(ip: Column) -> Column:
    return F.concat(F.lit("host:"), ip)


def service_id(ip: Column, port: Column, proto: Column) -> Column:
    return F.concat(F.lit("svc:"), ip, F.lit(":"), port.cast("string"), F.lit("/"), F.lower(proto))


def operation_id(method: Column, route: Column) -> Column:
    return F.concat(F.lit("op:"), F.upper(method), F.lit(":"), route)


def parameter_id(operation: Column, name: Column, location: Column) -> Column:
    return F.concat(F.lit("param:"), operation, F.lit("#"), F.lower(location), F.lit(":"), name)


def certificate_id(der: Column) -> Column:
    return F.concat(F.lit("cert:"), F.sha2(der, 256))


def hypothesis_id(kind: Column, slug: Column) -> Column:
    return F.concat(F.lit("hyp:"), kind, F.lit(":"), slug)


def archived_url(url: Column) -> Column:
    """struct(scheme, host, template) of a usable web URL on a host name, else null."""
    def parsed(netloc: Column, host: Column, scheme: Column, template: Column) -> Column:
        good = scheme.isin("http", "https") & ~netloc.contains("@") & (F.length(host) <= 253) & host.rlike(FQDN) & ~is_ipv4(host) & (template != "")
        return F.when(good, F.struct(scheme.alias("scheme"), host.alias("host"), template.alias("template")))

    parts = F.struct(scheme_of(url).alias("scheme"), netloc_of(url).alias("netloc"), canonical_host(netloc_of(url)).alias("host"), path_template(path_of(url)).alias("template"))
    return _once(parts, lambda x: parsed(x["netloc"], x["host"], x["scheme"], x["template"]))


def redirect_target(location: Column) -> Column:
    """A redirect as scheme, authority without a port, and path, at most 300 characters. Null where there is none, for @,
    unprintable characters and other schemes. Query and fragment may hold secrets and are left out."""
    text = F.trim(location)
    shape = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"
    scheme, host, path = F.lower(F.regexp_extract(text, shape, 1)), canonical_host(F.regexp_extract(text, shape, 2)), F.regexp_extract(text, shape, 3)
    bad = text.contains("@") | ~text.rlike(r"^[\x21-\x7e]+$") | ~scheme.isin("", "http", "https")
    shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    target = F.when((host != "") & (scheme != ""), F.concat(scheme, F.lit("://"), shown, path)).when(host != "", F.concat(F.lit("//"), shown, path)).when(path == "", "/").otherwise(path)
    return F.when(~bad, F.substring(target, 1, 300))


def ipv4_number(ip: Column) -> Column:
    part = F.split(ip, r"\.")
    return sum((F.get(part, F.lit(k)).try_cast("long") * (256 ** (3 - k)) for k in range(1, 4)), F.get(part, F.lit(0)).try_cast("long") * 256**3)


def _ipv6_all(ip: pd.Series) -> pd.Series:
    """Bits of IPv6 addresses; null stays null, and so becomes anything else."""

    def one(x):
        try:
            return f"{int(ipaddress.IPv6Address(x)):0128b}"
        except ValueError:
            return None

    return ip.map(one, na_action="ignore")


def ip_network(value: Column) -> Column:
    """struct(version, bits, length) of an address or network of either family, else null: bits are the address
    as a string of 0 and 1, of which the first length count. A zone (%eth0) of an address is ignored. IPv4 is worked
    out natively; only what holds a colon reaches Python."""
    text = F.regexp_replace(F.trim(value), r"\.+$", "")
    net = text.contains("/")
    ip = F.when(net, F.substring_index(text, "/", 1)).otherwise(F.regexp_replace(text, r"%[^/%]+$", ""))
    given = F.regexp_extract(text, r"^[^/]*/([0-9]{1,3})$", 1).try_cast("int")
    four = F.when(ip.rlike(IPV4), F.lpad(F.conv(ipv4_number(ip).cast("string"), 10, 2), 32, "0"))
    six = F.pandas_udf(_ipv6_all, "string")(F.when(ip.contains(":"), ip))
    most = F.when(ip.contains(":"), 128).otherwise(32)
    length = F.when(net, given).otherwise(most)
    bits = F.when(ip.contains(":"), six).otherwise(four)
    return F.when(bits.isNotNull() & length.between(0, most), F.struct(F.when(ip.contains(":"), 6).otherwise(4).alias("version"), bits.alias("bits"), length.alias("length")))


def classify_value(value: Column) -> Column:
    """ip, network or host; addresses of both families."""
    return F.when(ip_network(value).isNull(), "host").when(F.trim(value).contains("/"), "network").otherwise("ip")


def parse_duration(text: Column) -> Column:
    """Seconds of P[nD][T[nH][nM][nS]]; 14 days for null and anything else."""
    shape = r"^P(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?)?$"
    part = lambda k: F.coalesce(F.regexp_extract(text, shape, k).try_cast("long"), F.lit(0))
    return F.when(F.coalesce(text, F.lit("")).rlike(shape), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)).otherwise(14 * 86400).cast("long")


def binding_subject(node_id: Column, attrs: Column) -> Column:
    """What a node's scope verdict is about: an attribute, else part of its id, else empty. A web application's is its authority, a
    lead's the last part of its id, whatever its kind."""
    named = F.coalesce(*(F.when(attrs[k] != "", attrs[k]) for k in ("fqdn", "ip", "host", "registrable", "candidate_fqdn")))
    by_id = (
        F.when(node_id.rlike("^(?:dns|domain|host|net):"), F.regexp_extract(node_id, "^[a-z]+:(.*)$", 1)).when(node_id.startswith("web:"), F.regexp_extract(node_id, "^web:(?:.*?://)?([^/]*)", 1))
        .when(node_id.startswith("svc:"), F.regexp_extract(node_id, "^svc:(.*):[^:]*$", 1)).when(node_id.startswith("hyp:"), F.substring_index(node_id, ":", -1))
    )
    return F.coalesce(named, by_id, F.lit(""))
