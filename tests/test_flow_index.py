"""Many flows by index and form, against one expression a flow."""

import random
import time

import pytest
from conftest import event, ref
from pyspark.sql import functions as F

from eventloom.operators.filters import RuleError
from eventloom.operators.flow_index import FlowIndex, match_many
from eventloom.operators.routing import match, route, verdict_counts
from eventloom.plans.spec import Flow


def rows(events):
    made = []
    for k in range(40):
        labels = {} if k % 5 == 0 else {"k": str(k)} if k % 3 else {"k": "x"}
        series = None if k % 4 else {"count": k, "lastObservedTime": None}
        made.append(
            event(uid=str(k), type=["Normal", "Warning"][k % 2], reason=f"r{k % 7}", note=f"n{k}", labels=labels, series=series, regarding=ref(kind=["Pod", "Node", ""][k % 3], name=f"p{k}"))
            | {"watch": ["a", "b", None][k % 3]}
        )
    return events(*made, watch="string")


RULES = [
    ("reason = 'r1'",),
    ("'r2' = reason",),
    ("reason IN ('r1', 'r3', 'r1')",),
    ("reason = 'r1' AND int(labels['k']) > 20",),
    ("int(labels['k']) > 5 AND reason = 'r3'",),
    ("int(labels['k']) > 20 AND reason = 'r1' AND labels['k'] <> '29'",),
    ("reason = 'r2' OR type = 'Warning'",),
    ("NOT reason = 'r2'",),
    ("type = 'Warning'", "reason = 'r5'", "series.count > 4"),
    ("int(labels['k']) > 3", "reason = 'r4'"),
    ("labels['k'] = '7'",),
    ("regarding.kind = 'Pod' AND regarding.name IN ('p3', 'p6')", "contains(note, '6')"),
    ("reason = 'r1' AND exists(map_values(labels), v -> int(v) > 7)",),
    ("reason = 'r1' AND 100 / series.count > 3",),
    ("reason = NULL",),
    ("reason = 'r3' AND coalesce(eventTime, timestamp'2024-06-01') >= timestamp'2024-06-01' AND 1.5 < 2.5 AND 2.5 > int(uid) / 8 AND true = (type = 'Warning')",),
    ("column", "series IS NULL"),
    (),
]


def both(events, flows):
    table = rows(events)
    plain, indexed = match(table, flows), match_many(table, flows)
    said = F.filter("verdicts", lambda v: v["verdict"].isin("matched", "eval_error"))
    one = {row.uid: ([tuple(v) for v in row.said], row.sinks) for row in plain.select("uid", said.alias("said"), "sinks").collect()}
    other = {row.uid: ([tuple(v) for v in row.verdicts], row.sinks) for row in indexed.select("uid", "verdicts", "sinks").collect()}
    assert one == other
    assert {tuple(r) for r in verdict_counts(plain).collect()} == {tuple(r) for r in verdict_counts(indexed).collect()}
    assert {tuple(r) for r in route(plain).select("uid", "sink").collect()} == {tuple(r) for r in route(indexed).select("uid", "sink").collect()}
    assert set(indexed.columns) == set(plain.columns)


def test_every_kind_of_rule(events):
    watches = [None, ("a",), ("a", "b")]
    given = [tuple(F.col("type") == "Normal" if rule == "column" else rule for rule in rules) for rules in RULES]
    both(events, [Flow(f"f{k:02}", (f"s{k % 4}", "all"), rules, watches[k % 3]) for k, rules in enumerate(given)])


@pytest.mark.parametrize("seed", range(3))
def test_random_flows(events, seed):
    r = random.Random(seed)
    atoms = ["reason = 'r{}'", "type = 'Warning'", "int(labels['k']) > {}", "series.count > {}", "regarding.kind = 'Pod'", "labels['k'] = '{}'", "contains(note, '{}')"]

    def rule(depth=2):
        if depth and r.random() < 0.6:
            return f"({rule(depth - 1)} {r.choice(['AND', 'AND', 'OR'])} {rule(depth - 1)})"
        made = r.choice(atoms).format(r.randrange(9))
        return f"NOT {made}" if r.random() < 0.2 else made

    both(events, [Flow(f"f{k}", (f"s{r.randrange(5)}",), tuple(rule() for _ in range(r.randrange(1, 3)))) for k in range(25)])


def test_forms_and_keys(spark, events):
    schema = rows(events).schema
    flows = [Flow(f"f{k}", ("s",), (f"reason = 'r{k}' AND int(labels['k']) > {k}",)) for k in range(50)]
    flows += [Flow(f"g{k}", ("s",), (f"regarding.name = 'p{k}'",)) for k in range(50)]
    index = FlowIndex(spark, flows, schema)
    assert len(index.forms) == 2 and not index.unkeyed
    assert set(index.keys) == {"reason", "regarding.name"} and len(index.keys["reason"]) == 50


def test_refusals(events):
    for flows in ([Flow("a", ("s",), ("unknown = 'x'",))], [Flow("a", ("s",), ("type",))], [Flow("a", ("s",)), Flow("a", ("t",))]):
        with pytest.raises(RuleError):
            match_many(rows(events), flows)


def test_five_thousand_flows(events):
    flows = [Flow(f"f{k}", (f"s{k % 50}",), (f"reason = 'r{k % 2500}' AND int(labels['k']) > {k % 40}",)) for k in range(5000)]
    start = time.perf_counter()
    indexed = match_many(rows(events), flows)
    found = {row.uid: sorted(v.flow for v in row.verdicts if v.verdict == "matched") for row in indexed.collect()}
    assert time.perf_counter() - start < 60
    for k in range(40):
        value = k if k % 5 and k % 3 else None
        assert found[str(k)] == sorted(f"f{f}" for f in range(5000) if f % 2500 == k % 7 and value is not None and value > f % 40)
    plan = indexed._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("Exchange hashpartitioning") == 0
