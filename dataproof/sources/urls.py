"""Screening and redaction of source URLs, as column expressions over whole tables.

The rules are those for fetching a dataset from a URL: HTTP(S) only, no credentials, no
fragment, no local or metadata host, default port, no literal address of a non-public
network. Names are not resolved.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataproof.functions.types import column

# Host names and networks that are never fetched from.
BLOCKED_HOSTS = (
    "localhost",
    "localhost.localdomain",
    "metadata.google.internal",
    "metadata.azure.internal",
    "instance-data.ec2.internal",
)
BLOCKED_SUFFIXES = (".localhost", ".internal")
BLOCKED_IPV4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.88.99.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
)
MAPPED_IPV4 = "::ffff:0:0/96"
BLOCKED_IPV6 = (
    "::/96",
    "3fff::/20",
    "5f00::/16",
    "64:ff9b::/96",
    "64:ff9b:1::/48",
    "100::/64",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "fc00::/7",
    "fe80::/10",
    "fec0::/10",
    "ff00::/8",
)

INVALID = "invalid_url"
SCHEME = "scheme_not_http"
CREDENTIALS = "credentials"
FRAGMENT = "fragment"
HOST = "blocked_host"
PORT = "non_default_port"
ADDRESS = "prohibited_address"
NON_ASCII = "non_ascii_host"

# Characters that newer rules for international names keep (sharp s, final sigma, joiners) and the
# rules of 2003 fold or drop: a host with one of them would become another host.
_DEVIATING = "[\u00df\u1e9e\u03c2\u200c\u200d]"

# Characters that a host name cannot contain, and full-width forms of the
# characters that matter in an address, which URL parsers read as their plain forms.
_FORBIDDEN_IN_HOST = r"""[\x00-\x20"#%/:<>?@\[\\\]^`{|}\x7f]"""
_WIDE = "０１２３４５６７８９．。｡"
_PLAIN = "0123456789..."


def prohibited_ipv4(value: Column) -> Column:
    """Whether a 32-bit address, as BIGINT, lies in a blocked network."""
    result = F.lit(False)
    for text in BLOCKED_IPV4:
        network = ipaddress.ip_network(text)
        result = result | value.between(int(network.network_address), int(network.broadcast_address))
    return result


def _bits(network: str) -> str:
    parsed = ipaddress.ip_network(network)
    return format(int(parsed.network_address), "0128b")[: parsed.prefixlen]


def prohibited_ipv6(bits: Column) -> Column:
    """The same for 128 binary digits; a mapped IPv4 address goes by its IPv4 rule."""
    mapped = F.conv(F.substring(bits, 97, 32), 2, 10).cast("bigint")
    result = F.lit(False)
    for network in BLOCKED_IPV6:
        result = result | F.startswith(bits, F.lit(_bits(network)))
    return F.when(F.startswith(bits, F.lit(_bits(MAPPED_IPV4))), prohibited_ipv4(mapped)).otherwise(result)


def _ipv4_part(part: Column) -> Column:
    """Decimal, octal (leading 0) or hexadecimal (leading 0x) number; NULL if it is none."""
    def number(digits: Column, base: int) -> Column:
        short = F.regexp_replace(digits, "^0+", "")
        return F.when(F.length(short) == 0, F.lit(0)).when(F.length(short) <= 11, F.conv(short, base, 10).cast("bigint"))

    return (
        F.when(part.rlike("^0x[0-9a-f]*$"), number(F.substr(part, F.lit(3)), 16))
        .when(part.rlike("^0[0-7]+$"), number(part, 8))
        .when(part.rlike("^(0|[1-9][0-9]*)$"), number(part, 10))
    )


def _ipv4_parts(host: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), _ipv4_part)


def ipv4_value(parts: Column) -> Column:
    """32-bit address of up to four number parts, the last of which fills the remaining bytes."""
    leading = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    high = F.aggregate(leading, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p)
    room = F.pow(F.lit(256.0), (5 - F.size(parts)).cast("double")).cast("bigint")
    fits = F.forall(parts, lambda p: p.isNotNull()) & F.forall(leading, lambda p: p <= 255)
    return F.when((F.size(parts) <= 4) & fits, F.when(F.element_at(parts, -1) < room, high * room + F.element_at(parts, -1)))


def ipv4_text(value: Column) -> Column:
    octets = [F.shiftright(value, shift).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def _with_ipv6_bits(df: DataFrame, address: str) -> DataFrame:
    """Add ``_bits``: 128 binary digits of an address without brackets, NULL if it is not one."""
    text = F.col(address)
    tail = F.regexp_extract(text, r":((?:\d{1,3}\.){3}\d{1,3})$", 1)
    low = F.lit(65535).cast("bigint")
    hextets = F.concat(F.lower(F.hex(F.shiftright("_tail", 16))), F.lit(":"), F.lower(F.hex(F.col("_tail").bitwiseAND(low))))
    plain = F.when(~text.contains("."), text).when(
        F.col("_tail").isNotNull(), F.concat(F.regexp_replace(text, "[^:]*$", ""), hextets)
    )

    def groups(index: int) -> Column:
        half = F.coalesce(F.try_element_at("_halves", F.lit(index)), F.lit(""))
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    given = F.size("_left") + F.size("_right")
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0)))
    full = F.when((F.size("_halves") == 1) & (F.size("_left") == 8), F.col("_left")).when(
        (F.size("_halves") == 2) & (given < 8), F.concat("_left", zeros, "_right")
    )
    bits = F.array_join(F.transform("_groups", lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    return (
        df.withColumn("_tail_parts", F.when(tail != "", _ipv4_parts(tail)))
        .withColumn("_tail", ipv4_value(F.col("_tail_parts")))
        .withColumn("_halves", F.split(plain, "::"))
        .withColumns({"_left": groups(1), "_right": groups(2)})
        .withColumn("_groups", full)
        .withColumn("_bits", F.when(F.forall("_groups", lambda g: g.rlike("^[0-9a-f]{1,4}$")), bits))
    )


def ascii_host(name: Column) -> Column:
    """A host name with its international labels folded, composed and written as ``xn--`` labels; others stay.

    Java's own mapping does it where the rows are: case folding, compatibility forms, characters that are dropped (soft
    hyphens), the dots of other scripts, and Punycode. NULL for names that it refuses (characters unknown to its
    tables, wrong directions, labels too long) and for those that newer rules map to another name.
    """
    mapped = F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name))
    folds = ~name.rlike(_DEVIATING) & ~mapped.rlike(r"[^\x00-\x7f]")
    return F.when(~name.rlike(r"[^\x00-\x7f]"), name).when(folds, mapped)


def _with_parts(df: DataFrame, url: Column) -> DataFrame:
    """Split a URL. Every step is a column of its own, so that no pattern is matched twice."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*([^/\\?#]*)([^?#]*)(?:\?([^#]*))?(?:#((?s:.*)))?$"
    text = F.col("_text")
    place = F.col("_place")
    host_pattern = r"^(\[[^\]]*\]|[^:\[]*)(?::([0-9]*))?$"
    raw = F.col("_raw")
    decoded = F.when(raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)
    return (
        df.withColumn(
            "_text", F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
        )
        .withColumns(
            {
                "_scheme": F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)),
                "_authority": F.regexp_extract(text, pattern, 1),
                "_path": F.regexp_replace(F.regexp_extract(text, pattern, 2), r"\\", "/"),
                "_query": F.regexp_extract(text, pattern, 3),
                "_fragment": F.regexp_extract(text, pattern, 4),
            }
        )
        .withColumns(
            {"_place": F.regexp_replace("_authority", "^.*@", ""), "_user": F.regexp_extract("_authority", "^(.*)@", 1)}
        )
        .withColumns(
            {
                "_is_v6": F.startswith(place, F.lit("[")),
                "_parsed": place.rlike(host_pattern),
                "_raw": F.regexp_replace(F.regexp_extract(place, host_pattern, 1), r"^\[|\]$", ""),
                "_port": F.regexp_replace(F.regexp_extract(place, host_pattern, 2), "^0+(?=[0-9])", ""),
            }
        )
        .withColumn("_given", F.lower(F.translate(decoded, _WIDE, _PLAIN)))
        .withColumn("_ascii", F.when(F.col("_given").rlike(r"[^\x00-\x7f]"), ascii_host(F.col("_given"))))
        .withColumn("_name", F.coalesce("_ascii", "_given"))
        .withColumn("_bare", F.regexp_replace("_name", r"\.$", ""))
        .withColumn("_is_v4", ~F.col("_is_v6") & F.col("_bare").rlike(r"(^|\.)(0x[0-9a-f]*|[0-9]+)$"))
        .withColumn("_v4_parts", F.when(F.col("_is_v4"), _ipv4_parts(F.col("_name"))))
        .withColumn("_v4", ipv4_value(F.col("_v4_parts")))
        .withColumn("_v6_text", F.when(F.col("_is_v6"), F.col("_name")))
    )


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved, as URL parsers do; plain paths stay as they are."""
    segments = F.slice(F.split(path, "/"), 2, F.length(path))
    kind = lambda s: F.replace(F.lower(s), F.lit("%2e"), F.lit("."))

    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(kind(segment) == "..", up).when(kind(segment) == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_with_dots = kind(F.element_at(segments, -1)).isin(".", "..")
    resolved = F.concat(F.lit("/"), F.array_join(F.when(ends_with_dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))
    return F.when(kind(path).rlike(r"/\.{1,2}(/|$)"), resolved).otherwise(path)


def screen_source_urls(df: DataFrame, url_col: str) -> DataFrame:
    """Add ``allowed, reason, normalized_url, query_redacted`` to every row.

    ``reason`` is the first rule a URL breaks. International host names are mapped to ASCII first
    (:func:`ascii_host`), and the rules look at what they are then; a host that has no sure ASCII form is refused.
    ``normalized_url`` is given for allowed URLs, without query and fragment.
    """
    steps = _with_ipv6_bits(_with_parts(df, column(url_col)), "_v6_text")
    name, bare, port, scheme = (F.col(c) for c in ("_name", "_bare", "_port", "_scheme"))
    is_http = scheme.isin("http", "https")
    bad_host = (
        F.coalesce(name, F.lit("")).isin("", ".")
        | (F.col("_is_v4") & F.col("_v4").isNull())
        | (F.col("_is_v6") & F.col("_bits").isNull())
        | (~F.col("_is_v6") & name.rlike(_FORBIDDEN_IN_HOST))
    )
    bad_port = F.coalesce((F.length(port) > 5) | (port.try_cast("int") > 65535), F.lit(False))
    blocked = bare.isin(*BLOCKED_HOSTS)
    for suffix in BLOCKED_SUFFIXES:
        blocked = blocked | F.endswith(bare, F.lit(suffix))
    default_port = F.when(scheme == "https", F.lit("443")).otherwise(F.lit("80"))
    prohibited = F.coalesce(prohibited_ipv4(F.col("_v4")), prohibited_ipv6(F.col("_bits")), F.lit(False))
    reason = (
        F.when(column(url_col).isNull() | (scheme == ""), F.lit(INVALID))
        .when(is_http & (~F.col("_parsed") | bad_port | bad_host), F.lit(INVALID))
        .when(~is_http, F.lit(SCHEME))
        .when(~F.col("_user").isin("", ":"), F.lit(CREDENTIALS))
        .when(F.col("_fragment") != "", F.lit(FRAGMENT))
        .when(name.rlike(r"[^\x00-\x7f]"), F.lit(NON_ASCII))
        .when(blocked, F.lit(HOST))
        .when((port != "") & (port != default_port), F.lit(PORT))
        .when(prohibited, F.lit(ADDRESS))
    )
    host = (
        F.when(F.col("_is_v6"), F.concat(F.lit("["), name, F.lit("]")))
        .when(F.col("_v4").isNotNull(), ipv4_text(F.col("_v4")))
        .otherwise(name)
    )
    path = F.when(F.col("_path") == "", F.lit("/")).otherwise(_without_dots(F.col("_path")))
    verdict = steps.withColumn("_reason", reason)
    return verdict.select(
        *[column(c) for c in df.columns],
        F.col("_reason").alias("reason"),
        F.col("_reason").isNull().alias("allowed"),
        F.when(F.col("_reason").isNull(), F.concat(scheme, F.lit("://"), host, path)).alias("normalized_url"),
        F.coalesce(F.col("_query") != "", F.lit(False)).alias("query_redacted"),
    )


def redact_url(url: Column) -> Column:
    """``struct(source_url, query_redacted)``: a URL without query and fragment."""
    return F.struct(
        F.regexp_extract(url, r"^([^?#]*)", 1).alias("source_url"),
        (F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1) != "").alias("query_redacted"),
    )
