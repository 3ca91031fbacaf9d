"""IP addresses: validity, canonical form, version, scope."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# IPv4 blocks of no public use (first address, prefix length), and public ones inside them.
_PRIVATE = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.0.170", 31),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4), ("255.255.255.255", 32),
)
_PUBLIC_INSIDE = (("192.0.0.9", 32), ("192.0.0.10", 32))
_SHARED = ("100.64.0.0", 10)
# The same of IPv6.
_PRIVATE_V6 = (
    ("::", 128), ("::1", 128), ("64:ff9b:1::", 48), ("100::", 64), ("2001::", 23), ("2001:db8::", 32), ("2002::", 16), ("fc00::", 7), ("fe80::", 10),
)
_PUBLIC_INSIDE_V6 = (("2001:1::1", 128), ("2001:1::2", 128), ("2001:3::", 32), ("2001:4:112::", 48), ("2001:20::", 28), ("2001:30::", 28))
_MAPPED = "0" * 20 + "ffff"
_OCTET = r"(0|[1-9][0-9]{0,2})"


def number_v4(address: Column) -> Column:
    """An IPv4 text as a number; null if it isn't one."""
    shaped = address.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")
    parts = F.when(shaped, F.transform(F.split(address, r"\."), lambda p: p.cast("bigint")))
    whole = F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n * 256 + p)
    return F.when(F.forall(parts, lambda p: p <= 255), whole)


def _inside(n: Column, block: tuple[str, int]) -> Column:
    first, size = int(ipaddress.IPv4Address(block[0])), 2 ** (32 - block[1])
    return (n >= first) & (n < first + size)


def _any(n: Column, blocks) -> Column:
    hit = F.lit(False)
    for b in blocks:
        hit = hit | _inside(n, b)
    return hit


def _digits_v6(address: Column) -> Column:
    """An IPv6 text (no zone) as 32 hexadecimal digits; null if it isn't one."""
    halves = F.split(F.lower(address), "::")
    groups = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))
    whole, tail = F.size(halves) == 1, F.element_at(halves, -1)
    # A dotted end is two groups.
    quad = number_v4(F.substring_index(tail, ":", -1))
    dotted = F.when(quad.isNotNull(), F.concat_ws(":", F.lower(F.hex(F.shiftright(quad, 16))), F.lower(F.hex(quad % 65_536))))
    ended = F.when(dotted.isNotNull(), F.concat(F.left(tail, F.length(tail) - F.length(F.substring_index(tail, ":", -1))), dotted)).otherwise(tail)
    first, last = F.when(whole, groups(ended)).otherwise(groups(halves[0])), F.when(whole, F.array().cast("array<string>")).otherwise(groups(ended))
    given = F.size(first) + F.size(last)
    full = F.concat(first, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - given)), last)
    shaped = F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & F.when(whole, given == 8).otherwise((F.size(halves) == 2) & (given <= 7))
    return F.when(shaped, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))


def _short_v6(digits: Column) -> Column:
    """The short form of 32 digits: the first longest run of two or more zero groups is "::"."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(digits, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))
    plain = F.array_join(groups, ":")
    out = plain
    for n in range(2, 9):
        run = "^(?:(.*?):)??0(?::0){%d}(?::(.*))?$" % (n - 1)
        out = F.when(plain.rlike(run), F.regexp_replace(plain, run, "$1::$2")).otherwise(out)
    return out


def _any_v6(digits: Column, blocks) -> Column:
    hit = F.lit(False)
    for first, size in blocks:
        net = ipaddress.IPv6Network(f"{first}/{size}")
        hit = hit | digits.between(f"{int(net[0]):032x}", f"{int(net[-1]):032x}")
    return hit


def address(df, column: str):
    """df with struct columns ip (canonical, version, scope, routable); canonical is null if invalid.

    All of it is column work. An IPv6 zone ("%eth0") stays; an IPv4 address inside an
    IPv6 one (::ffff:0:0/96) is written with dots and has that address' scope.
    """
    text, n = F.trim(F.coalesce(F.col(column), F.lit(""))), F.col("_v4")
    private = _any(n, _PRIVATE) & ~_any(n, _PUBLIC_INSIDE)
    six_ = F.when(F.contains(text, F.lit(":")) & ~text.rlike("%$|%.*%"), _digits_v6(F.substring_index(text, "%", 1)))
    # Each step is a column of its own, so that what follows reads it instead of repeating it.
    rows = df.withColumn("_v6", six_).withColumn("_mapped", F.left(F.col("_v6"), F.lit(24)) == _MAPPED)
    inner = F.when(F.col("_mapped"), F.conv(F.right(F.col("_v6"), F.lit(8)), 16, 10).cast("bigint"))
    rows = rows.withColumn("_v4", F.coalesce(number_v4(text), inner)).withColumn("_private", private)
    open_ = ~F.col("_private") & ~_inside(n, _SHARED)
    four = F.struct(text.alias("canonical"), F.lit(4).alias("version"), F.when(F.col("_private"), "private").otherwise("public").alias("scope"), open_.alias("routable"))
    dots = F.concat_ws(".", *(F.shiftright(n, k) % 256 for k in (24, 16, 8, 0)))
    zone = F.when(F.contains(text, F.lit("%")), F.concat(F.lit("%"), F.substring_index(text, "%", -1))).otherwise("")
    shut = F.when(F.col("_mapped"), F.col("_private")).otherwise(_any_v6(F.col("_v6"), _PRIVATE_V6) & ~_any_v6(F.col("_v6"), _PUBLIC_INSIDE_V6))
    rows = rows.withColumn("_shut", shut)
    shown = F.concat(F.when(F.col("_mapped"), F.concat(F.lit("::ffff:"), dots)).otherwise(_short_v6(F.col("_v6"))), zone)
    six = F.struct(shown.alias("canonical"), F.lit(6).alias("version"), F.when(F.col("_shut"), "private").otherwise("public").alias("scope"), (~F.col("_shut")).alias("routable"))
    return rows.withColumn("ip", F.when(F.col("_v6").isNotNull(), six).when(n.isNotNull(), four)).drop("_v4", "_v6", "_private", "_mapped", "_shut")
