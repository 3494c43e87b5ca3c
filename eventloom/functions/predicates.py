"""Functions for rules where Spark's built-ins need a guard or do not exist.

Each returns NULL where the operation fails, which a rule reads as an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.jsontext import json_quote
from eventloom.functions.text import ascii_lower, ascii_upper  # noqa: F401

# --- strings -----------------------------------------------------------------


def _number(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def char_at(text: Column, index: Column | int) -> Column:
    """Return the character at a 0-based index, '' at the end, NULL beyond it."""
    index = _number(index)
    at = F.substring(text, (index + 1).cast("int"), F.lit(1))
    return F.when((index >= 0) & (F.length(text) >= index), at)


def index_of(text: Column, part: Column) -> Column:
    """Return the 0-based index of the first occurrence, -1 without one."""
    return F.position(part, text) - 1


def last_index_of(text: Column, part: Column) -> Column:
    """Return the 0-based index of the last occurrence, -1 without one."""
    found = F.position(F.reverse(part), F.reverse(text))
    return F.when(found == 0, F.lit(-1)).otherwise(F.length(text) - F.length(part) - found + 1)


def sub_string(text: Column, start: Column | int, end: Column | int | None = None) -> Column:
    """Return the characters from ``start`` up to ``end``, NULL outside the text."""
    start, stop = _number(start), F.length(text) if end is None else _number(end)
    inside = (start >= 0) & (start <= stop) & (stop <= F.length(text))
    return F.when(inside, F.substring(text, (start + 1).cast("int"), (stop - start).cast("int")))


def split_literal(text: Column, separator: str) -> Column:
    """Split on a literal separator."""
    return F.split(text, r"\Q" + separator + r"\E")


def trim_space(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def quote(text: Column) -> Column:
    """Return the text in double quotes with special characters escaped."""
    return json_quote(text)


def find(text: Column, pattern: str) -> Column:
    """Return the first match of a pattern, '' without one."""
    return F.regexp_extract(text, f"({pattern})", 1)


def find_all(text: Column, pattern: str) -> Column:
    """Return every match of a pattern."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


# --- lists -------------------------------------------------------------------


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def set_contains(items: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, items)) == 0


def set_equivalent(left: Column, right: Column) -> Column:
    return set_contains(left, right) & set_contains(right, left)


def set_intersects(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right)) > 0


# --- times -------------------------------------------------------------------

# Parts counted from zero, in UTC.


def month_of(time: Column) -> Column:
    return F.month(time) - 1


def day_of_month(time: Column) -> Column:
    return F.dayofmonth(time) - 1


def day_of_week(time: Column) -> Column:
    return F.dayofweek(time) - 1


def day_of_year(time: Column) -> Column:
    return F.dayofyear(time) - 1


def milliseconds_of(time: Column) -> Column:
    return F.date_format(time, "SSS").cast("int")


# --- semantic versions -------------------------------------------------------

_IDENTIFIER = r"(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)"
_SEMVER = (
    r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)"
    rf"(?:-({_IDENTIFIER}(?:\.{_IDENTIFIER})*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?$"
)


def is_semver(text: Column) -> Column:
    return text.rlike(_SEMVER)


def _semver_part(text: Column, group: int) -> Column:
    return F.when(is_semver(text), F.regexp_extract(text, _SEMVER, group).cast("decimal(20,0)").cast("bigint"))


def semver_major(text: Column) -> Column:
    return _semver_part(text, 1)


def semver_minor(text: Column) -> Column:
    return _semver_part(text, 2)


def semver_patch(text: Column) -> Column:
    return _semver_part(text, 3)


def semver_key(text: Column) -> Column:
    """Return a sort key: comparing two keys compares the versions, NULL for no version.

    A prerelease sorts before its release. Its identifiers compare one by one,
    numbers before texts, numbers by value and texts by bytes.
    """
    prerelease = F.regexp_extract(text, _SEMVER, 4)
    identifiers = F.transform(
        F.when(prerelease == "", F.array().cast("array<string>")).otherwise(F.split(prerelease, r"\.")),
        lambda part: F.struct(
            F.when(part.rlike(r"^\d+$"), F.lit(0)).otherwise(F.lit(1)).alias("is_text"),
            F.when(part.rlike(r"^\d+$"), F.length(part)).otherwise(F.lit(0)).alias("digits"),
            part.alias("value"),
        ),
    )
    key = F.struct(
        semver_major(text).alias("major"),
        semver_minor(text).alias("minor"),
        semver_patch(text).alias("patch"),
        (prerelease == "").alias("released"),
        identifiers.alias("identifiers"),
    )
    return F.when(is_semver(text), key)


def normalized_semver(text: Column) -> Column:
    """Complete a short form such as ``v1`` or ``1.02`` to three plain numbers."""
    bare = F.regexp_replace(text, r"^v", "")
    core = F.regexp_extract(bare, r"^([0-9.]+)(.*)$", 1)
    rest = F.regexp_extract(bare, r"^([0-9.]+)(.*)$", 2)
    numbers = F.transform(F.split(core, r"\."), lambda part: F.regexp_replace(part, r"^0+(?=\d)", ""))
    padded = F.when(
        F.size(numbers) < 3, F.concat(numbers, F.array_repeat(F.lit("0"), F.lit(3) - F.size(numbers)))
    ).otherwise(numbers)
    return F.concat(F.array_join(padded, "."), rest)


def semver_compare(left: Column, right: Column) -> Column:
    """Return -1, 0 or 1; build metadata does not count."""
    a, b = semver_key(left), semver_key(right)
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).when(a == b, F.lit(0))


# --- IP addresses ------------------------------------------------------------

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def is_ipv4(text: Column) -> Column:
    return text.rlike(_IPV4)


def ipv4_number(text: Column) -> Column:
    """Return an IPv4 address as a number, NULL for anything else."""
    parts = F.split(text, r"\.")
    number = sum((F.get(parts, F.lit(i)).cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    return F.when(is_ipv4(text), number)


def cidr_range(cidr: Column) -> Column:
    """Return the (lo, hi, prefix) numbers of an IPv4 CIDR, NULL for anything else."""
    address = F.substring_index(cidr, "/", 1)
    prefix = F.regexp_extract(cidr, r"/(3[0-2]|[12]?\d)$", 1)
    valid = is_ipv4(address) & (prefix != "")
    bits = F.try_to_number(prefix, F.lit("99")).cast("int")
    block = F.pow(F.lit(2), F.lit(32) - bits).cast("bigint")
    number = ipv4_number(address)
    low = number - F.pmod(number, block)
    return F.when(
        valid,
        F.struct(low.alias("lo"), (low + block - 1).alias("hi"), bits.alias("prefix")),
    )


def cidr_contains_ip(cidr: Column, ip: Column) -> Column:
    bounds, number = cidr_range(cidr), ipv4_number(ip)
    return (number >= bounds["lo"]) & (number <= bounds["hi"])


def cidr_contains_cidr(outer: Column, inner: Column) -> Column:
    a, b = cidr_range(outer), cidr_range(inner)
    return (b["lo"] >= a["lo"]) & (b["hi"] <= a["hi"])


def ipv4_text(number: Column) -> Column:
    octets = [F.pmod(F.shiftright(number, shift), F.lit(256)).cast("string") for shift in (24, 16, 8, 0)]
    return F.when(number.isNotNull(), F.concat_ws(".", *octets))


def cidr_masked(cidr: Column) -> Column:
    bounds = cidr_range(cidr)
    return F.concat(ipv4_text(bounds["lo"]), F.lit("/"), bounds["prefix"].cast("string"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _hex_address(text: Column) -> Column:
    """Return the hex digits of an address, 8 of IPv4 or 32 of IPv6; NULL for anything else.

    An IPv6 address with a zone, or one that maps an IPv4 address, is none here.
    """
    four = F.lower(F.lpad(F.hex(ipv4_number(text)), 8, "0"))
    # A dotted end counts as two groups.
    dotted = r"^(.*:)(\d+\.\d+\.\d+\.\d+)$"
    end = F.lpad(F.hex(ipv4_number(F.regexp_extract(text, dotted, 2))), 8, "0")
    grouped = F.concat(F.regexp_extract(text, dotted, 1), F.substring(end, 1, 4), F.lit(":"), F.substring(end, 5, 4))
    plain = F.lower(F.when(text.rlike(dotted), grouped).otherwise(text))
    none = F.array().cast("array<string>")

    def groups(half: Column) -> Column:
        return F.when(F.coalesce(half, F.lit("")) == "", none).otherwise(F.split(half, ":", -1))

    def filled(halves: Column) -> Column:
        left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
        missing = F.lit(8) - F.size(left) - F.size(right)
        gap = F.when(missing >= 1, F.concat(left, F.array_repeat(F.lit("0"), missing), right))
        return F.when(F.size(halves) == 2, gap).when((F.size(halves) == 1) & (missing == 0), left)

    def joined(whole: Column) -> Column:
        digits = F.array_join(F.transform(whole, lambda group: F.lpad(group, 4, "0")), "")
        return F.when(F.forall(whole, lambda group: group.rlike("^[0-9a-f]{1,4}$")), digits)

    six = _let(_let(F.split(plain, "::", -1), filled), joined)
    return F.when(is_ipv4(text), four).otherwise(_let(six, lambda x: F.when(~x.startswith("0" * 20 + "ffff"), x)))


def _bits(digits: Column) -> Column:
    """Return the bits of an address as text, 64 converted at a time."""
    half = lambda at: F.lpad(F.conv(F.substring(digits, at, 16), 16, 2), 64, "0")
    return F.when(F.length(digits) == 8, F.lpad(F.conv(digits, 16, 2), 32, "0")).otherwise(F.concat(half(1), half(17)))


def _masked_hex(digits: Column, prefix: Column, fill: str) -> Column:
    """Set the bits behind a prefix to ``fill``."""

    def digits_of(bits: Column) -> Column:
        half = lambda at: F.lpad(F.conv(F.substring(bits, at, 64), 2, 16), 16, "0")
        four = F.lpad(F.conv(bits, 2, 16), 8, "0")
        return F.lower(F.when(F.length(bits) == 32, four).otherwise(F.concat(half(1), half(65))))

    return _let(F.rpad(F.substr(_bits(digits), F.lit(1), prefix), F.length(digits) * 4, F.lit(fill)), digits_of)


def _key(digits: Column) -> Column:
    return F.unhex(F.concat(F.when(F.length(digits) == 8, F.lit("04")).otherwise(F.lit("06")), digits))


def _address_text(digits: Column) -> Column:
    """Write an address in its canonical form; the longest run of zero groups of IPv6 is left out."""
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda k: F.regexp_replace(F.substr(digits, k * 4 + 1, F.lit(4)), "^0{1,3}", ""),
    )

    def shortened(six: Column) -> Column:
        short = six
        for run in range(2, 9):  # the longest that is there wins
            found = rf"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::|$)(.*)$"
            short = F.when(six.rlike(found), F.regexp_replace(six, found, "$1::$2")).otherwise(short)
        return short

    four = ipv4_text(F.conv(digits, 16, 10).cast("bigint"))
    six = _let(F.array_join(groups, ":"), shortened)
    return F.when(F.length(digits) == 8, four).when(digits.isNotNull(), six)


def ip_facts(text: Column) -> Column:
    """Return family, canonical form and class of an IPv4 or IPv6 address, NULLs for anything else."""

    def facts(digits: Column) -> Column:
        four = F.length(digits) == 8
        unspecified = digits.rlike("^0+$")
        loopback = F.when(four, digits.startswith("7f")).otherwise(digits == "0" * 31 + "1")
        local_multicast = F.when(four, digits.startswith("e00000")).otherwise(digits.rlike("^ff.2"))
        local_unicast = F.when(four, digits.startswith("a9fe")).otherwise(digits.rlike("^fe[89ab]"))
        multicast = F.when(four, digits.startswith("e")).otherwise(digits.startswith("ff"))
        broadcast = four & (digits == "ffffffff")
        return F.struct(
            F.when(digits.isNotNull(), F.when(four, 4).otherwise(6)).cast("int").alias("family"),
            _address_text(digits).alias("canonical"),
            unspecified.alias("unspecified"),
            loopback.alias("loopback"),
            local_multicast.alias("link_local_multicast"),
            local_unicast.alias("link_local_unicast"),
            (~(unspecified | loopback | multicast | local_unicast | broadcast)).alias("global_unicast"),
        )

    return _let(_hex_address(text), facts)


def is_canonical_ip(text: Column) -> Column:
    return text == ip_facts(text)["canonical"]


def ip_key(text: Column) -> Column:
    """Return a byte key that orders addresses of both families, NULL for anything else."""
    return _let(_hex_address(text), _key)


def cidr_facts(cidr: Column) -> Column:
    """Return the first and last address key, prefix length and masked form of an IPv4 or IPv6 CIDR, NULLs for anything else."""
    given = F.regexp_extract(cidr, r"^[^/]*/(0|[1-9]\d{0,2})$", 1)

    def facts(digits: Column) -> Column:
        prefix = F.when(given != "", given.cast("int"))
        prefix = F.when(prefix <= F.length(digits) * 4, prefix)
        low = F.when(prefix.isNotNull(), _masked_hex(digits, prefix, "0"))
        high = F.when(prefix.isNotNull(), _masked_hex(digits, prefix, "1"))
        masked = F.concat(_let(low, _address_text), F.lit("/"), prefix.cast("string"))
        return F.struct(_let(low, _key).alias("lo"), _let(high, _key).alias("hi"), prefix.alias("prefix"), masked.alias("masked"))

    return _let(_hex_address(F.substring_index(cidr, "/", 1)), facts)


def network_contains_ip(cidr: Column, ip: Column) -> Column:
    """Return whether a network of either family holds an address; IPv4 alone is faster with the plain form."""
    network, key = cidr_facts(cidr), ip_key(ip)
    return (key >= network["lo"]) & (key <= network["hi"])


def network_contains_network(outer: Column, inner: Column) -> Column:
    a, b = cidr_facts(outer), cidr_facts(inner)
    return (b["lo"] >= a["lo"]) & (b["hi"] <= a["hi"])


def tag_cidr(rows: DataFrame, ip: str, networks: DataFrame) -> DataFrame:
    """Tag each row with every network ``cidr, tag`` of either family that holds its address.

    The range test becomes an equi-join on (prefix length, first address), with
    one probe per row and prefix length that occurs in ``networks``; of those
    there are at most 162, and they are read first.
    """
    address = _hex_address(F.substring_index("cidr", "/", 1))
    known = networks.select("cidr", "tag", cidr_facts(F.col("cidr"))["prefix"].alias("_prefix"), address.alias("_digits"))
    keyed = known.filter("_prefix is not null").select(
        F.length("_digits").alias("_family"), "_prefix", F.substr(_bits(F.col("_digits")), F.lit(1), F.col("_prefix")).alias("_net"), "cidr", "tag"
    )
    lengths: dict[int, list[int]] = {8: [], 32: []}
    for row in keyed.select("_family", "_prefix").distinct().collect():
        lengths[row["_family"]].append(row["_prefix"])
    tried = [F.array(*map(F.lit, sorted(lengths[family]))).cast("array<int>") for family in (8, 32)]
    located = rows.withColumn("_digits", _hex_address(F.col(ip))).filter("_digits is not null")
    located = located.withColumns({"_family": F.length("_digits"), "_bits": _bits(F.col("_digits"))})
    probes = F.explode(F.when(F.col("_family") == 8, tried[0]).otherwise(tried[1]))
    probed = located.withColumn("_prefix", probes).withColumn("_net", F.substr("_bits", F.lit(1), F.col("_prefix")))
    return probed.join(keyed, ["_family", "_prefix", "_net"]).select(*rows.columns, "cidr", "tag")
