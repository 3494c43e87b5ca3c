"""Filter verdicts, rule helpers, routing and flow definitions."""

import ipaddress
import random

import pytest
from conftest import event, ref
from pyspark.sql import functions as F

from eventloom.functions import predicates as fn
from eventloom.operators.filters import RuleError, check_rules, choose, exists_one, matches, verdict
from eventloom.operators.metrics import drop_counts, filter_drops
from eventloom.operators.routing import match, route, route_write, verdict_counts
from eventloom.plans.spec import BindingError, Flow, accepted_flows, check_bindings, swap_filters


@pytest.mark.parametrize(
    "rules, expected",
    [
        ([], "matched"),
        (["type = 'Warning'", "regarding.kind = 'Pod'"], "matched"),
        (["type = 'Normal'"], "unmatched"),
        (["type = 'Warning'", "namespace = 'other'", "reason = 'Failed'"], "unmatched"),
        (["labels['nope'] = 'x'"], "eval_error"),
        (["type = 'Normal'", "labels['nope'] = 'x'"], "unmatched"),
        (["labels['nope'] = 'x'", "type = 'Normal'"], "eval_error"),
        (["type = 'Normal' AND labels['nope'] = 'x'"], "unmatched"),
        (["type = 'Warning' OR labels['nope'] = 'x'"], "matched"),
        (["series.count > 1"], "eval_error"),
        (["series IS NULL"], "matched"),
        (["regardingObject.owner.kind = 'x'"], "eval_error"),
        (["try_divide(1, size(labels)) > 0"], "eval_error"),
        (["exists(map_values(labels), v -> v = 'x')"], "unmatched"),
    ],
)
def test_verdict(events, rules, expected):
    rows = events(event(type="Warning", reason="Failed", regarding=ref(kind="Pod")))
    assert rows.select(verdict(rules).alias("v")).collect()[0]["v"] == expected
    assert rows.filter(matches(rules)).count() == int(expected == "matched")


def test_verdict_takes_columns(events):
    rows = events(event(type="Warning"))
    assert rows.select(verdict([F.col("type") == "Warning"]).alias("v")).collect()[0]["v"] == "matched"


@pytest.mark.parametrize("rule", ["unknown = 'x'", "type", "labels", "type =", " ", "size(labels)", "labels > 1"])
def test_rules_refused_at_definition(spark, rule):
    with pytest.raises(RuleError):
        check_rules(spark, [rule])


def test_rules_accepted(spark):
    check_rules(spark, ["type = 'x'", "labels['a'] = 'b'", "regardingObject.terminating", F.col("note").contains("x")])


def test_unknown_condition_and_exists_one(spark):
    rows = spark.createDataFrame([(["a", "b"], True), (["a", "a"], False), (["a", None], None)], "l array<string>, c boolean")
    got = rows.select(exists_one(F.col("l"), lambda x: x == "a").alias("e"), choose(F.col("c"), F.lit(1), F.lit(2)).alias("c"))
    assert [tuple(row) for row in got.collect()] == [(True, 1), (False, 2), (None, None)]


FLOWS = [
    Flow("b-second", sinks=("x", "y"), filters=("type = 'Warning'",)),
    Flow("a-first", sinks=("x",), filters=("labels['app'] = 'web'",)),
    Flow("narrow", sinks=("z",), watches=("team-b",)),
]


def routed(events):
    rows = events(
        event(uid="1", type="Warning", labels={"app": "web"}) | {"watch": "team-a"},
        event(uid="2", type="Warning") | {"watch": "team-b"},
        event(uid="3", type="Normal", labels={"app": "db"}) | {"watch": "team-a"},
        watch="string",
    )
    return match(rows, FLOWS)


def test_a_shared_sink_gets_an_event_once_and_an_error_stops_one_flow_only(events):
    matched = routed(events)
    got = sorted((row["uid"], row["sink"]) for row in route(matched).collect())
    assert got == [("1", "x"), ("1", "y"), ("2", "x"), ("2", "y"), ("2", "z")]
    counts = sorted(tuple(row) for row in verdict_counts(matched).collect())
    assert counts == [("a-first", "eval_error", 1), ("a-first", "matched", 1), ("b-second", "matched", 2), ("narrow", "matched", 1)]
    drops = [tuple(row) for row in drop_counts(filter_drops(matched)).collect()]
    assert drops == [("filter", "eval_error", "a-first", "", 1)]


def test_routing_does_not_shuffle(events):
    plan = route(routed(events))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_route_write_hands_each_sink_its_rows(events):
    written = {}
    route_write(route(routed(events)), {sink: (lambda rows, s=sink: written.update({s: rows.count()})) for sink in "xyz"})
    assert written == {"x": 2, "y": 2, "z": 1}


@pytest.mark.parametrize(
    "flows, watches, sinks",
    [
        ([Flow("a", ("x",), watches=("n",))], ["*"], ["x"]),
        ([Flow("a", ("x",), watches=("n",))], ["m"], ["x"]),
        ([Flow("a", ("x",), watches=("n",))], ["n", "m"], ["x"]),
        ([Flow("a", ("x",))], ["n"], ["x", "y"]),
        ([Flow("a", ("x", "q"))], ["n"], ["x"]),
        ([Flow("a", ("x",)), Flow("a", ("x",))], ["n"], ["x"]),
    ],
)
def test_bindings_refused(flows, watches, sinks):
    with pytest.raises(BindingError):
        check_bindings(flows, watches, sinks)


def test_all_binding_faults_are_named():
    with pytest.raises(BindingError) as refused:
        check_bindings([Flow("a", ("x", "q"), watches=("n",)), Flow("a", ("x",), watches=("m",))], ["n", "o"], ["x", "y"])
    for name in ("watch asked for but not there: m", "watch that serves no flow: o", "sink that serves no flow: y", "more than once: a"):
        assert name in str(refused.value)


@pytest.mark.parametrize("rule", ["reason", "nope = 1", "note + ("])
def test_refused_rules_never_reach_a_plan(events, rule):
    with pytest.raises(RuleError):
        match(events(event()), [Flow("a", ("x",), filters=(rule,))])


def test_a_refused_swap_keeps_the_rules(spark):
    now = [Flow("a", ("x",), filters=("type = 'Warning'",))]
    assert accepted_flows(spark, now, [Flow("a", ("x",), filters=("reason",))]) == (now, False)
    flows, accepted = accepted_flows(spark, now, [Flow("a", ("x",), filters=("reason = 'r'",))])
    assert accepted and flows[0].filters == ("reason = 'r'",)


@pytest.mark.parametrize("fields", [{"sinks": ()}, {"sinks": ("x", "x")}, {"watches": ()}, {"filters": (" ",)}, {"name": "-a"}])
def test_flow_refused(fields):
    with pytest.raises(BindingError):
        Flow(**({"name": "a", "sinks": ("x",)} | fields))


def test_bindings_accepted():
    check_bindings([Flow("a", ("x",)), Flow("b", ("y",), watches=("n",))], ["n", "m"], ["x", "y"])
    check_bindings([Flow("a", ("x",))], ["*"], ["x"])


def test_swap_filters():
    old = [Flow("a", ("x",), ("type = 'A'",)), Flow("b", ("y",), ("type = 'B'",))]
    new = [Flow("a", ("z",), ("type = 'C'",)), Flow("c", ("x",))]
    assert swap_filters(old, new) == [Flow("a", ("x",), ("type = 'C'",)), Flow("b", ("y",), ("type = 'B'",))]


# --- helpers -----------------------------------------------------------------


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def test_text_helpers(spark):
    text = F.lit("banana é😀")
    assert value(spark, fn.char_at(text, 0)) == "b" and value(spark, fn.char_at(text, 8)) == "😀"
    assert value(spark, fn.char_at(text, 9)) == "" and value(spark, fn.char_at(text, 10)) is None
    assert value(spark, fn.char_at(text, -1)) is None
    assert value(spark, fn.index_of(text, F.lit("an"))) == 1 and value(spark, fn.index_of(text, F.lit("x"))) == -1
    assert value(spark, fn.last_index_of(text, F.lit("an"))) == 3 and value(spark, fn.last_index_of(text, F.lit("x"))) == -1
    assert value(spark, fn.sub_string(text, 7)) == "é😀" and value(spark, fn.sub_string(text, 1, 3)) == "an"
    assert value(spark, fn.sub_string(text, 4, 20)) is None and value(spark, fn.sub_string(text, 3, 2)) is None
    assert value(spark, fn.split_literal(F.lit("a.b.c"), ".")) == ["a", "b", "c"]
    assert value(spark, fn.trim_space(F.lit("\t  a b \n"))) == "a b"
    assert value(spark, fn.ascii_lower(F.lit("ÀBC"))) == "Àbc" and value(spark, fn.ascii_upper(F.lit("àbc"))) == "àBC"
    assert value(spark, fn.quote(F.lit('a"b'))) == '"a\\"b"'
    assert value(spark, fn.find(F.lit("a12b3"), "[0-9]+")) == "12" and value(spark, fn.find(F.lit("x"), "[0-9]")) == ""
    assert value(spark, fn.find_all(F.lit("a12b3"), "[0-9]+")) == ["12", "3"]


def test_list_helpers(spark):
    def items(*values):
        return F.array(*[F.lit(v) for v in values])

    empty = F.array().cast("array<int>")
    assert value(spark, fn.first(items(1, 2))) == 1 and value(spark, fn.last(items(1, 2))) == 2
    assert value(spark, fn.first(empty)) is None and value(spark, fn.last(empty)) is None
    assert value(spark, fn.set_contains(items(1, 2, 3), items(2, 2))) is True
    assert value(spark, fn.set_contains(items(1), items(1, 2))) is False
    assert value(spark, fn.set_equivalent(items(1, 1, 2), items(2, 1))) is True
    assert value(spark, fn.set_intersects(items(1, 2), items(3))) is False


ORDERED = ["0.9.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.10.0", "10.0.0"]


def test_semver(spark):
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(ORDERED)][::-1], "v string, i int")
    assert [row["v"] for row in rows.orderBy(fn.semver_key(F.col("v"))).collect()] == ORDERED
    for bad in ("1.0", "01.0.0", "1.0.0-", "v1.0.0", "1.0.0-01", ""):
        assert value(spark, fn.is_semver(F.lit(bad))) is False
        assert value(spark, fn.semver_compare(F.lit(bad), F.lit("1.0.0"))) is None
    assert value(spark, fn.semver_compare(F.lit("1.0.0+a"), F.lit("1.0.0+b"))) == 0
    assert value(spark, fn.semver_compare(F.lit("2.0.0"), F.lit("10.0.0"))) == -1
    assert value(spark, fn.normalized_semver(F.lit("v1"))) == "1.0.0"
    assert value(spark, fn.normalized_semver(F.lit("1.02-rc"))) == "1.2.0-rc"
    assert value(spark, fn.semver_minor(F.lit("1.22.3-x"))) == 22 and value(spark, fn.semver_patch(F.lit("1.22.3"))) == 3


@pytest.mark.parametrize("cidr", ["10.0.0.0/8", "0.0.0.0/0", "192.168.1.7/32", "172.16.5.9/20", "255.255.255.255/1"])
def test_cidr_against_stdlib(spark, cidr):
    network = ipaddress.ip_network(cidr, strict=False)
    assert value(spark, fn.cidr_masked(F.lit(cidr))) == str(network)
    for ip in ("10.1.2.3", "192.168.1.7", "172.16.15.255", "172.16.16.0", "0.0.0.0", "255.255.255.255"):
        assert value(spark, fn.cidr_contains_ip(F.lit(cidr), F.lit(ip))) == (ipaddress.ip_address(ip) in network)
    for inner in ("10.2.0.0/16", "10.0.0.0/7", "172.16.0.0/24"):
        held = ipaddress.ip_network(inner, strict=False).subnet_of(network)
        assert value(spark, fn.cidr_contains_cidr(F.lit(cidr), F.lit(inner))) == held


def test_bad_addresses_are_errors(spark):
    for bad in ("1.2.3", "1.2.3.256", "01.2.3.4", "::1", ""):
        assert value(spark, fn.ipv4_number(F.lit(bad))) is None
    for bad in ("1.2.3.4", "1.2.3.4/33", "1.2.3.4/x", "/8"):
        assert value(spark, fn.cidr_masked(F.lit(bad))) is None


def test_ip_facts(spark):
    cases = {
        "127.0.0.1": (4, True, False, True, False, False, False),
        "0.0.0.0": (4, True, True, False, False, False, False),
        "10.1.2.3": (4, True, False, False, False, False, True),
        "169.254.1.1": (4, True, False, False, False, True, False),
        "224.0.0.7": (4, True, False, False, True, False, False),
        "255.255.255.255": (4, True, False, False, False, False, False),
        "::1": (6, True, False, True, False, False, False),
        "2001:DB8::1": (6, False, False, False, False, False, True),
        "ff02::1": (6, True, False, False, True, False, False),
        "fe80::1": (6, True, False, False, False, True, False),
        "::ffff:1.2.3.4": (None,) * 7,
        "fe80::1%eth0": (None,) * 7,
        "nonsense": (None,) * 7,
    }
    rows = spark.createDataFrame([(ip,) for ip in cases], "ip string")
    facts = fn.ip_facts(F.col("ip"))
    got = rows.select(
        "ip", facts["family"], fn.is_canonical_ip(F.col("ip")), facts["unspecified"], facts["loopback"],
        facts["link_local_multicast"], facts["link_local_unicast"], facts["global_unicast"],
    )
    assert {row[0]: tuple(row[1:]) for row in got.collect()} == cases


def test_networks_of_both_families(spark):
    cases = [
        ("2001:db8::/32", "2001:DB8::7", True), ("2001:db8::/32", "2001:db9::1", False), ("10.0.0.0/8", "10.9.9.9", True),
        ("::/0", "10.9.9.9", False), ("fe80::1/64", "fe80::2", True), ("::ffff:1.2.3.0/120", "1.2.3.4", None),
        ("10.0.0.0/33", "10.0.0.1", None), ("10.0.0.1", "10.0.0.1", None), ("10.0.0.0/8", "x", None),
    ]
    rows = spark.createDataFrame([(c, i) for c, i, _ in cases], "c string, i string")
    got = rows.select(fn.network_contains_ip(F.col("c"), F.col("i")).alias("h"), fn.cidr_facts(F.col("c"))["masked"].alias("m")).collect()
    assert [row["h"] for row in got] == [held for *_, held in cases]
    assert (got[0]["m"], got[4]["m"]) == ("2001:db8::/32", "fe80::/64")
    nested = spark.createDataFrame([("2001:db8::/32", "2001:db8:1::/48"), ("2001:db8:1::/48", "2001:db8::/32")], "a string, b string")
    assert [r[0] for r in nested.select(fn.network_contains_network(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_tag_cidr(spark):
    rows = spark.createDataFrame([("a", "10.1.2.3"), ("b", "11.0.0.1"), ("c", "bad")], "id string, ip string")
    nets = spark.createDataFrame([("10.0.0.0/8", "ten"), ("10.1.0.0/16", "one"), ("0.0.0.0/0", "all"), ("x", "bad")], "cidr string, tag string")
    expected = [("a", "all"), ("a", "one"), ("a", "ten"), ("b", "all")]
    assert sorted((row["id"], row["tag"]) for row in fn.tag_cidr(rows, "ip", nets).collect()) == expected


def test_networks_of_every_length_equal_the_library(spark):
    choose = random.Random(21)
    number = {4: lambda: choose.getrandbits(32), 6: lambda: choose.getrandbits(128) & ~(choose.getrandbits(96) << 16)}
    build = {4: ipaddress.IPv4Address, 6: ipaddress.IPv6Address}
    ips = [build[f](number[f]()) for f in (4, 6) for _ in range(40)] + [ipaddress.ip_address(t) for t in ("::", "::1", "1::", "64:ff9b::7f00:1", "255.255.255.255")]
    nets = [ipaddress.ip_network((choose.choice([i for i in ips if i.max_prefixlen == bits]), n), strict=False) for bits in (32, 128) for n in range(bits + 1)]
    rows = spark.createDataFrame([(str(i) if k % 2 else i.exploded.upper(),) for k, i in enumerate(ips)], "ip string")
    got = rows.select("ip", fn.ip_facts(F.col("ip"))["canonical"].alias("c")).collect()
    assert [r["c"] for r in got] == [str(ipaddress.ip_address(r["ip"])) for r in got]
    table = spark.createDataFrame([(str(n), str(k)) for k, n in enumerate(nets)], "cidr string, tag string")
    tagged = {(r["ip"], r["tag"]) for r in fn.tag_cidr(rows, "ip", table).collect()}
    assert tagged == {(r["ip"], str(k)) for r in got for k, n in enumerate(nets) if ipaddress.ip_address(r["ip"]) in n}
    assert "Python" not in fn.tag_cidr(rows, "ip", table)._jdf.queryExecution().executedPlan().toString()
