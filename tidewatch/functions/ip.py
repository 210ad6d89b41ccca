"""IP text to fixed-width lower-case hex, whose text order is the address order.

IPv4 gives 8 hex digits, IPv6 gives 32, so the length tells the family and a
plain string comparison replaces 128-bit arithmetic.  Everything is a native
expression, so addresses never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_TAIL_V4 = rf"^(.*:){_IPV4}$"
_SCOPE = r"^([^%]*)%[^%]+$"

V4_DIGITS, V6_DIGITS = 8, 32
V4_PREFIX, V6_PREFIX = 4, 6
V6_BUCKET_BASE = 1 << 16


def _byte(text: Column, pattern: str, group: int) -> Column:
    return F.lpad(F.hex(F.regexp_extract(text, pattern, group).cast("bigint")), 2, "0")


def _ipv4_hex(text: Column) -> Column:
    """Hex of text that is known to be a dotted address, which is split once."""
    zero = F.lit(0).cast("bigint")
    value = F.aggregate(F.split(text, r"\."), zero, lambda sum_, octet: sum_ * 256 + octet.cast("bigint"))
    return F.lower(F.lpad(F.hex(value), V4_DIGITS, "0"))


def _groups(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":", -1))


def _padded(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")


def _ipv6_hex(text: Column) -> Column:
    # an embedded dotted tail stands for the last two groups
    dotted = F.concat(
        F.regexp_extract(text, _TAIL_V4, 1),
        _byte(text, _TAIL_V4, 2),
        _byte(text, _TAIL_V4, 3),
        F.lit(":"),
        _byte(text, _TAIL_V4, 4),
        _byte(text, _TAIL_V4, 5),
    )
    address = F.when(text.rlike(_TAIL_V4), dotted).otherwise(text)
    halves = F.split(address, "::", -1)
    left = _groups(F.get(halves, F.lit(0)))
    right = _groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    count = F.size(left) + F.size(right)
    well_formed = F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
    full = (F.size(halves) == 1) & (count == 8)
    shortened = (F.size(halves) == 2) & (count <= 7)
    return F.when(
        well_formed & (full | shortened),
        F.lower(F.concat(_padded(left), F.repeat(F.lit("0000"), F.lit(8) - count), _padded(right))),
    )


def parse_ip(text: Column | str) -> Column:
    """Dotted IPv4 or IPv6 text to hex; invalid or NULL text gives NULL.

    A clean dotted address, the usual case, costs one match and one split.
    """
    c = F.col(text) if isinstance(text, str) else text
    dotted = f"^{_IPV4}$"
    bare = F.regexp_replace(c, _EDGE_SPACE, "")
    unscoped = F.when(bare.rlike(_SCOPE), F.regexp_extract(bare, _SCOPE, 1)).otherwise(bare)
    return (
        F.when(c.rlike(dotted), _ipv4_hex(c))
        .when(c.contains(":"), _ipv6_hex(unscoped))
        .when(bare.rlike(dotted), _ipv4_hex(bare))
    )


def parse_ipv4(text: Column | str) -> Column:
    """Like :func:`parse_ip` for dotted addresses; any other text gives NULL."""
    c = F.col(text) if isinstance(text, str) else text
    dotted = f"^{_IPV4}$"
    bare = F.regexp_replace(c, _EDGE_SPACE, "")
    return F.when(c.rlike(dotted), _ipv4_hex(c)).when(bare.rlike(dotted), _ipv4_hex(bare))


def ip_bucket(address: Column | str) -> Column:
    """Join bucket of a hex address: a /16 for IPv4, a 24-bit prefix for IPv6."""
    c = F.col(address) if isinstance(address, str) else address

    def prefix(digits: int) -> Column:
        return F.conv(F.substring(c, 1, digits), 16, 10).cast("bigint")

    return F.when(F.length(c) == V4_DIGITS, prefix(V4_PREFIX)).otherwise(
        F.lit(V6_BUCKET_BASE) + prefix(V6_PREFIX)
    )
