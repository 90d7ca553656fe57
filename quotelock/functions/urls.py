"""URL display and target policy (F14 and the address rules)."""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelock.functions.ladder import bind, holds
from quotelock.functions.text import bounded_display

# Address ranges a capture may not target. 2000::/3 is the only
# IPv6 space allowed at all.
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
    "224.0.0.0/3",
)
BLOCKED_IPV6 = (
    "::/128",
    "::1/128",
    "fc00::/7",
    "fe80::/10",
    "ff00::/8",
    "2002::/16",
    "2001::/32",
    "2001:db8::/32",
    "100::/64",
    "2001::/23",
)
ALLOWED_IPV6 = "2000::/3"
LOCAL_LABEL = "local snapshot"
STORED_LABEL = "stored snapshot"


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def scheme(url: Column) -> Column:
    return F.lower(url_part(url, "PROTOCOL"))


def source_kind(uri: Column) -> Column:
    return F.when(holds(scheme(uri).isin("http", "https")), "web").otherwise("local")


def origin(url: Column) -> Column:
    """Scheme, host and port without user information or a default port."""
    host = F.lower(F.regexp_replace(url_part(url, "HOST"), r"^.*@", ""))
    authority = F.regexp_replace(url_part(url, "AUTHORITY"), r"^.*@", "")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    default = ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443"))
    suffix = F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port))
    return F.concat(scheme(url), F.lit("://"), host, suffix)


def url_path(url: Column) -> Column:
    path = url_part(url, "PATH")
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("/")).otherwise(path)


def display_source(uri: Column, limit: int = 4096) -> Column:
    """Origin and path only: query, fragment and user information are dropped."""
    web = bounded_display(F.concat(origin(uri), url_path(uri)), limit)
    return (
        F.when(holds(scheme(uri) == "file"), F.lit(LOCAL_LABEL))
        .when(holds(scheme(uri).isin("http", "https")) & web.isNotNull(), web)
        .otherwise(F.lit(STORED_LABEL))
    )


def is_http_url(url: Column) -> Column:
    return holds(
        (F.char_length(url) <= 8192)
        & scheme(url).isin("http", "https")
        & (F.char_length(url_part(url, "HOST")) > 0)
        & url_part(url, "USERINFO").isNull()
    )


def ipv4_number(host: Column) -> Column:
    """Address of a numeric host, also in the short, octal and hex forms; else NULL."""

    def number(part: Column) -> Column:
        return (
            F.when(
                part.rlike(r"^0[xX][0-9A-Fa-f]{0,8}$"),
                F.conv(F.concat(F.lit("0"), F.substring(part, 3, 8)), 16, 10),
            )
            .when(part.rlike(r"^0[0-7]{0,12}$"), F.conv(part, 8, 10))
            .when(part.rlike(r"^[1-9]\d{0,9}$"), part)
            .try_cast("bigint")
        )

    def assemble(numbers: Column) -> Column:
        size = F.size(numbers)
        leading = F.slice(numbers, F.lit(1), F.greatest(F.lit(0), size - 1))
        last = F.try_element_at(numbers, F.lit(-1))
        high = F.aggregate(leading, F.lit(0).cast("bigint"), lambda total, part: total * 256 + part)
        shift = F.pow(F.lit(256), F.lit(5) - size).cast("bigint")
        valid = (
            size.between(1, 4)
            & F.forall(numbers, lambda part: F.coalesce(part >= 0, F.lit(False)))
            & F.forall(leading, lambda part: part <= 255)
            & (last < shift)
        )
        # The high parts fill bytes from the left, the last part fills the rest.
        scaled = high * shift
        return F.when(holds(valid), scaled + last)

    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    return bind(F.transform(parts, number), assemble)


def ends_numeric(host: Column) -> Column:
    """The last label is a number, so the host must be read as an IPv4 address."""
    return holds(F.regexp_replace(host, r"\.$", "").rlike(r"(^|\.)(\d+|0[xX][0-9A-Fa-f]*)$"))


#: An address is groups of one to four hex digits between colons, at most one gap ``::``,
#: and in place of the last two groups possibly four decimal numbers.
_GROUP = "[0-9a-f]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_SHAPE = rf"^(?=.*:)(?:{_GROUP}(?::{_GROUP})*)?(?:::)?(?:{_GROUP}(?::{_GROUP})*)?(?:(?<=[0-9a-f]):{_QUAD}|(?<=::){_QUAD})?$"


def ipv6_hex(host: Column) -> Column:
    """32 hex digits of an IPv6 address; NULL when it is not one.

    The form is checked against the grammar as a whole; then the decimal tail becomes two
    groups, the gap is filled with the groups that are missing, and all are padded.
    """
    bare = F.lower(F.split_part(F.regexp_replace(host, r"^\[|\]$", ""), F.lit("%"), F.lit(1)))

    def plain(text: Column) -> Column:
        quad = F.regexp_extract(text, rf"({_QUAD})$", 1)
        numbers = F.transform(F.split(quad, r"\."), lambda octet: F.lpad(F.hex(octet.cast("int")), 2, "0"))
        pairs = F.concat_ws(
            ":", F.array_join(F.slice(numbers, 1, 2), ""), F.array_join(F.slice(numbers, 3, 2), "")
        )
        return F.when(quad == "", text).otherwise(F.concat(F.regexp_replace(text, rf"{_QUAD}$", ""), F.lower(pairs)))

    def filled(text: Column) -> Column:
        groups = F.size(F.regexp_extract_all(text, F.lit(_GROUP), F.lit(0)))
        gap = F.contains(text, F.lit("::"))
        zeros = F.array_join(F.array_repeat(F.lit("0"), 8 - groups), ":")
        spread = F.regexp_replace(F.replace(text, F.lit("::"), F.concat(F.lit(":"), zeros, F.lit(":"))), "^:|:$", "")
        padded = F.transform(F.split(spread, ":"), lambda group: F.lpad(group, 4, "0"))
        fits = F.when(gap, groups <= 7).otherwise(groups == 8)
        return F.when(fits, F.array_join(padded, ""))

    return F.when(holds(bare.rlike(_SHAPE)), bind(bind(bare, plain), filled))


def _ipv4_blocked(number: Column) -> Column:
    blocked = F.lit(False)
    for network in map(ip_network, BLOCKED_IPV4):
        blocked = blocked | number.between(
            int(network.network_address), int(network.broadcast_address)
        )
    return blocked


def _hex_between(address: Column, network: str) -> Column:
    bounds = ip_network(network)
    return address.between(
        f"{int(bounds.network_address):032x}", f"{int(bounds.broadcast_address):032x}"
    )


def _ipv6_blocked(address: Column) -> Column:
    blocked = ~_hex_between(address, ALLOWED_IPV6)
    for network in BLOCKED_IPV6:
        blocked = blocked | _hex_between(address, network)
    mapped = address.startswith("0" * 20 + "ffff")
    inner = F.conv(F.substring(address, 25, 8), 16, 10).try_cast("bigint")
    return F.when(mapped, _ipv4_blocked(inner)).otherwise(blocked)


# A lenient reading of scheme and authority: what a browser would connect to, also
# where a strict parser gives up.
_AUTHORITY = r"^\s*[A-Za-z][A-Za-z0-9+.-]*:[/\\]*([^/\\?#]*)"
_NAMED_HOST = r"^[^\s%<>^|`{}\[\]:@\x00-\x20\x7f]+$"
# Characters that a resolver may turn into digits or dots.
_FOLDED_HOST = r"[\x{FF00}-\x{FFEF}\x{3002}]|(?![0-9])[\p{Nd}\p{No}]"


def target_policy(url: Column) -> Column:
    """PUBLIC, or the code that keeps a URL from being captured.

    Named hosts are PUBLIC here: their addresses are known only to a resolver. Hosts
    that cannot be read for certain are INVALID_URL. The ranges are constants, so the
    check is row-local and needs no range join.
    """
    opaque = F.coalesce(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit(""))

    def address_policy(host: Column) -> Column:
        return (
            F.when(
                host.startswith("["),
                bind(
                    ipv6_hex(host),
                    lambda words: F.when(words.isNull(), "INVALID_URL")
                    .when(holds(_ipv6_blocked(words)), "ADDRESS_BLOCKED")
                    .otherwise("PUBLIC"),
                ),
            )
            .when(~host.rlike(_NAMED_HOST) | host.rlike(_FOLDED_HOST), "INVALID_URL")
            .when(
                ends_numeric(host),
                bind(
                    ipv4_number(host),
                    lambda number: F.when(number.isNull(), "INVALID_URL")
                    .when(holds(_ipv4_blocked(number)), "ADDRESS_BLOCKED")
                    .otherwise("PUBLIC"),
                ),
            )
            .otherwise("PUBLIC")
        )

    def policy(authority: Column) -> Column:
        user = F.regexp_extract(authority, "^(.*)@", 1)
        place = F.regexp_replace(authority, "^.*@", "")
        port = F.regexp_extract(place, r":(\d{1,9})$", 1)
        return (
            F.when(url.isNull() | (opaque == ""), "INVALID_URL")
            .when(~F.lower(opaque).isin("http", "https"), "SCHEME_BLOCKED")
            .when((port != "") & (port.try_cast("int") > 65535), "INVALID_URL")
            .when(~user.isin("", ":"), "CREDENTIALS_BLOCKED")
            .otherwise(bind(F.regexp_replace(place, r":\d*$", ""), address_policy))
        )

    return bind(F.regexp_extract(url, _AUTHORITY, 1), policy)


def resolve_location(base: Column, location: Column) -> Column:
    """Absolute form of a redirect location; NULL for forms that are not resolved here.

    Absolute, scheme-relative and root-relative locations are resolved. Fragments
    stay, as in the stored records.
    """
    absolute = location.rlike(r"^(?i:https?)://[^/?#\s]+")
    with_path = F.when(
        location.rlike(r"^(?i:https?)://[^/?#]+$"), F.concat(location, F.lit("/"))
    ).otherwise(location)
    return (
        F.when(holds(absolute), with_path)
        .when(holds(location.startswith("//")), F.concat(scheme(base), F.lit(":"), location))
        .when(holds(location.startswith("/")), F.concat(origin(base), location))
    )
