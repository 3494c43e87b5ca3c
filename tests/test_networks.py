"""The most specific network against the standard library."""

import ipaddress
import random

import pytest

from eventloom.operators import networks
from eventloom.operators.networks import most_specific_network


def model(address, networks):
    try:
        ip = ipaddress.ip_address(address)
    except (ValueError, AttributeError):
        return None, None
    held = [(n, tag) for n, tag in networks if ip.version == n.version and ip in n]
    if not held:
        return None, None
    network = max((n for n, _ in held), key=lambda n: n.prefixlen)
    return str(network), min(tag for n, tag in held if n == network)


@pytest.mark.parametrize(("span", "coalesce"), [(5, "false"), (1000, "true")])
def test_against_the_standard_library(spark, span, coalesce):
    r = random.Random(span)
    networks = [(ipaddress.ip_network("0.0.0.0/0"), "all"), (ipaddress.ip_network("2001:db8::/32"), "doc"), (ipaddress.ip_network("2001:db8::1/128"), "one")]
    for _ in range(60):
        networks.append((ipaddress.ip_network((r.choice([10, 192]) << 24 | r.getrandbits(6) << 18 | r.getrandbits(8), r.randrange(6, 33)), strict=False), f"t{r.randrange(9)}"))
        networks.append((ipaddress.ip_network((0x20010DB8 << 96 | r.getrandbits(5) << 90 | r.getrandbits(6), r.randrange(30, 129)), strict=False), f"t{r.randrange(9)}"))
    addresses = [str(n[edge]) for n, _ in networks for edge in (0, -1)] + [str(ipaddress.ip_address(r.choice([10, 192]) << 24 | r.getrandbits(24))) for _ in range(80)]
    addresses += [None, "", "nowhere", "1.2.3.4", "::1", "255.255.255.255", "2001:db8::1", "2001:DB8:0::1", "10.0.0.0"] + addresses[:20]
    rows = spark.createDataFrame([(k, a, "x") for k, a in enumerate(addresses)], "k long, ip string, tag string").repartition(3)
    given = spark.createDataFrame([(str(n), tag) for n, tag in networks] + [("bad", "x"), ("1.2.3.4/40", "x"), (None, "x")], "cidr string, tag string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = most_specific_network(rows, "ip", given, span).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(addresses)
    for row in got:
        assert (row.cidr, row.tag) == model(row.ip, networks), row


def test_no_networks_and_no_rows(spark):
    rows = spark.createDataFrame([("1.2.3.4",)], "ip string")
    none = spark.createDataFrame([], "cidr string, tag string")
    assert [tuple(row) for row in most_specific_network(rows, "ip", none).collect()] == [("1.2.3.4", None, None)]
    assert most_specific_network(rows.limit(0), "ip", spark.createDataFrame([("1.0.0.0/8", "a")], "cidr string, tag string")).count() == 0


def test_each_distinct_address_is_read_once(spark, monkeypatch):
    kept = {}

    def keep(df, name):
        kept[name] = networks.keep_as_is(df, name)
        return kept[name]

    monkeypatch.setattr(networks, "keep_as_is", networks.keep, raising=False)
    monkeypatch.setattr(networks, "keep", keep)
    rows = spark.createDataFrame([("10.0.0.1",)] * 5 + [("::1",), ("nowhere",)], "ip string")
    found = networks.most_specific_network(rows, "ip", spark.createDataFrame([("10.0.0.0/8", "ten")], "cidr string, tag string"))
    assert [row.tag for row in found.collect()].count("ten") == 5
    assert kept["addresses"].count() == 3
