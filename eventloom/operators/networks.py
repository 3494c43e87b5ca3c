"""The most specific of many networks that holds an address."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.predicates import _bits, _hex_address, _key, _let, cidr_facts
from eventloom.operators.segments import SEGMENT, SPAN, before, in_segment, join_carry, with_segment
from eventloom.scratch import keep

_FAMILY = ["_family"]
#: What stands at one address, in order: networks begin, addresses are looked up, networks end.
_BEGINS, _LOOKS, _ENDS = 0, 1, 2


def nested_networks(networks: DataFrame) -> DataFrame:
    """Return ``(_family, lo, hi, prefix, cidr, tag, outer_cidr, outer_tag)`` of the distinct networks ``cidr, tag``.

    ``outer_cidr`` and ``outer_tag`` are those of the most specific network
    around it, null for an outermost one. A network given twice keeps its
    smallest tag; what is no network is left out.
    """
    facts = cidr_facts(F.col("cidr"))
    digits = _hex_address(F.substring_index("cidr", "/", 1))
    known = networks.select(facts.alias("net"), digits.alias("digits"), "tag").where("net.prefix is not null")
    whole = keep(
        known.select(
            F.length("digits").alias("_family"),
            "net.lo",
            "net.hi",
            "net.prefix",
            F.col("net.masked").alias("cidr"),
            F.substr(_bits(F.col("digits")), F.lit(1), F.col("net.prefix")).alias("bits"),
            "tag",
        )
        .groupBy("_family", "lo", "hi", "prefix", "cidr", "bits")
        .agg(F.min("tag").alias("tag")),
        "networks",
    )
    # Networks nest or are apart, so what holds one is found by its shorter prefixes; there are at most 162 lengths.
    lengths = whole.groupBy("_family").agg(F.sort_array(F.collect_set("prefix")).alias("lengths"))
    tried = whole.join(F.broadcast(lengths), "_family").select(
        "_family", "cidr", "bits", F.explode(F.filter("lengths", lambda n: n < F.col("prefix"))).alias("shorter")
    )
    probes = tried.select("_family", F.col("cidr").alias("inner"), F.col("shorter").alias("prefix"), F.substr("bits", F.lit(1), F.col("shorter")).alias("bits"))
    around = (
        probes.join(whole, ["_family", "prefix", "bits"])
        .groupBy("inner")
        .agg(F.max(F.struct("prefix", "cidr", "tag")).alias("outer"))
        .select(F.col("inner").alias("cidr"), F.col("outer.cidr").alias("outer_cidr"), F.col("outer.tag").alias("outer_tag"))
    )
    return whole.join(around, "cidr", "left").drop("bits")


def most_specific_network(rows: DataFrame, ip: str, networks: DataFrame, span: int = SPAN) -> DataFrame:
    """Add ``cidr`` and ``tag`` of the most specific network that holds each row's address, NULL where none does.

    The networks of both families are flattened into disjoint intervals: at its
    first address a network takes over, behind its last the one around it does
    again. The distinct addresses are merged into these borders in one sorted,
    segmented scan, and each takes what the last border before it says. So an
    address costs one place in the sort, whatever the prefix lengths are, and
    neither side has to fit into memory anywhere.
    """
    nested = nested_networks(networks)
    at = lambda key, what, rank: F.struct(F.col(key).alias("key"), F.lit(what).alias("what"), rank.alias("rank"))
    begins = nested.select("_family", at("lo", _BEGINS, F.col("prefix")).alias("_at"), F.struct("cidr", "tag").alias("_net"))
    # Of several that end together, the outermost comes last.
    outer = F.struct(F.col("outer_cidr").alias("cidr"), F.col("outer_tag").alias("tag"))
    ends = nested.select("_family", at("hi", _ENDS, -F.col("prefix")).alias("_at"), outer.alias("_net"))
    # Reading an address is dear, and the sort samples its rows: each distinct one is read once, and written.
    asked = rows.select(F.col(ip).alias("_ip")).distinct()
    place = _let(_hex_address(F.col("_ip")), lambda digits: F.struct(F.length(digits).alias("family"), _key(digits).alias("key")))
    located = keep(asked.select("_ip", place.alias("_place")), "addresses").select("_ip", F.col("_place.family").alias("_family"), F.col("_place.key").alias("_key"))
    looks = located.where("_key is not null").select("_family", at("_key", _LOOKS, F.lit(0)).alias("_at"), "_ip")
    merged = with_segment(
        begins.unionByName(ends).unionByName(looks, allowMissingColumns=True), _FAMILY, span, "_at"
    )
    window = in_segment(_FAMILY, "_at")
    last = F.last("_net", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    running = merged.select("*", last.alias("_last"), F.lead("_at").over(window).isNull().alias("_closes"))
    carry = running.where("_closes").select(*_FAMILY, SEGMENT, F.last("_last", ignorenulls=True).over(before(_FAMILY)).alias("_carried"))
    found = join_carry(running.where(F.col("_at.what") == _LOOKS), carry, _FAMILY)
    found = found.select("_ip", F.coalesce("_last", "_carried").alias("_found"))
    joined = rows.join(found, F.col(ip) == F.col("_ip"), "left")
    kept = [rows[name] for name in rows.columns if name not in ("cidr", "tag")]
    return joined.select(*kept, F.col("_found.cidr").alias("cidr"), F.col("_found.tag").alias("tag"))
