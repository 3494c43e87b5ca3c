"""Rules whose evaluation fails: an error on their rows, never the end of the job."""

import pytest
from conftest import event, ref
from pyspark.sql import functions as F

from eventloom.operators.filters import check_rules, matches, verdict
from eventloom.operators.guard import guarded
from eventloom.operators.routing import match
from eventloom.plans.spec import Flow
from eventloom.schema import EVENT


def rows(events):
    return events(
        event(uid="bad", note="a,b", labels={"k": "text", "n": "9"}, series={"count": 0, "lastObservedTime": None}),
        event(uid="good", note="1,2,x", labels={"k": "7", "n": "5"}, series={"count": 5, "lastObservedTime": None}),
        event(uid="big", note="3", labels={"k": "2147483647", "n": "0"}, series={"count": 2147483647, "lastObservedTime": None}),
    )


#: A rule, and the uids it matches and those it fails on; it is false for the others.
FAILING = [
    ("1/(series.count-series.count) > 0", "", "bad good big"),
    ("10 % series.count = 0", "good", "bad"),
    ("10 div series.count = 2", "good", "bad"),
    ("int(labels['k']) > 3", "good big", "bad"),
    ("CAST(labels['k'] AS INT) > 3", "good big", "bad"),
    ("labels['k'] > 3", "good big", "bad"),
    ("int(labels['k']) + 2147483640 > 0", "good", "bad big"),
    ("int(labels['k']) * 2 = 14", "good", "bad big"),
    ("0 - int(labels['k']) - 2 < 0", "good", "bad big"),
    ("-int(labels['k']) < 0", "good big", "bad"),
    ("abs(int(labels['k'])) = 7", "good", "bad"),
    ("element_at(split(note, ','), 3) = 'x'", "good", "bad big"),
    ("split(note, ',')[2] = 'x'", "good", "bad big"),
    ("element_at(labels, 'n') = '5'", "good", ""),
    ("element_at(split(note, ','), 0) = 'x'", "", "bad good big"),
    ("to_timestamp(note) IS NOT NULL", "", "bad good big"),
    ("date(labels['k']) > date'2020-01-01'", "", "bad good big"),
    ("rlike(note, labels['k'])", "", ""),
    ("substring(note, int(labels['n']), 1) = 'x'", "good", ""),
    ("raise_error('no') IS NULL", "", "bad good big"),
    ("assert_true(series.count > 0) IS NULL", "good big", "bad"),
    ("size(sequence(1, int(labels['k']), -1)) > 0", "", "bad good big"),
    # absorbed by the other operand, in either order
    ("uid = 'good' AND int(labels['k']) = 7", "good", ""),
    ("int(labels['k']) = 7 AND uid = 'good'", "good", ""),
    ("int(labels['k']) > 3 OR uid = 'bad'", "bad good big", ""),
    ("NOT (int(labels['k']) > 3 AND 1 / series.count > 0)", "", "bad"),
    ("int(labels['k']) > 3 OR 1 / series.count > 100", "good big", "bad"),
    # an element that fails is outweighed by one that decides
    ("exists(split(note, ','), x -> int(x) > 1)", "good big", "bad"),
    ("exists(split(note, ','), x -> x = 'a' OR int(x) > 1)", "bad good big", ""),
    ("forall(split(note, ','), x -> int(x) > 2)", "big", "bad"),
    ("size(filter(split(note, ','), x -> int(x) > 0)) = 1", "big", "bad good"),
    ("transform(split(note, ','), x -> int(x))[0] = 3", "big", "bad good"),
]


@pytest.mark.parametrize(("rule", "matched", "failed"), FAILING)
def test_a_failure_is_the_verdict_of_its_row(events, rule, matched, failed):
    table = rows(events)
    check_rules(table.sparkSession, [rule])
    got = {row.uid: row.v for row in table.select("uid", verdict([rule]).alias("v")).collect()}
    assert {uid for uid, v in got.items() if v == "matched"} == set(matched.split())
    assert {uid for uid, v in got.items() if v == "eval_error"} == set(failed.split())
    assert {row.uid for row in table.filter(matches([rule])).collect()} == set(matched.split())


def test_conditions_that_share_a_failing_part(events):
    """Generated code works shared parts out first; that must not fail for all of them."""
    rules = ["int(labels['k']) > 3", "int(labels['k']) > 5", "-int(labels['k']) < 0", "-int(labels['k']) < 3", "abs(int(labels['k'])) > 0"]
    flows = [Flow(f"f{k}", sinks=("s",), filters=(rule,)) for k, rule in enumerate(rules)]
    found = match(rows(events), flows).select("uid", "verdicts").repartition(2).collect()
    for row in found:
        expected = "eval_error" if row.uid == "bad" else "matched"
        assert {entry.verdict for entry in row.verdicts} == {expected}


def test_columns_are_guarded_too(events):
    rules = [1 / F.col("series.count") > 0, F.col("labels")["k"].cast("int") > 3]
    got = {row.uid: row.v for row in rows(events).select("uid", verdict(rules).alias("v")).collect()}
    assert got == {"bad": "eval_error", "good": "matched", "big": "matched"}


def test_columns_beyond_the_schema(events):
    table = rows(events).withColumn("extra", F.lit("x"))
    got = table.select(verdict(["int(extra) > 0"]).alias("v"), verdict(["extra = 'x'"]).alias("w")).distinct().collect()
    assert [tuple(row) for row in got] == [("eval_error", "matched")]
    assert match(table, [Flow("f", sinks=("s",), filters=("extra = 'x' AND int(extra) > 0",))]).first().verdicts[0].verdict == "eval_error"


def test_plain_rules_are_left_alone(spark):
    plain = ["type = 'x'", "labels['a'] = 'b'", "series.count > 1", "note IN ('a', 'b') AND NOT contains(note, 'c')", "regardingObject.terminating"]
    for rule, column in zip(plain, guarded(plain, EVENT), strict=True):
        assert str(column._jc) == str(F.expr(rule)._jc)


def test_plain_operands_still_reach_the_scan(spark, events, tmp_path):
    path = str(tmp_path / "events")
    events(event(uid="1", type="Warning", labels={"k": "x"}, regarding=ref())).write.parquet(path)
    kept = spark.read.parquet(path).filter(matches(["type = 'Warning' AND int(labels['k']) > 3"]))
    assert "EqualTo(type,Warning)" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 0


def test_a_place_in_a_list_is_asked_for_in_a_form_that_does_not_fail(spark):
    rule = guarded(["split(note, 'x')[1] = '7'"], EVENT)[0]
    assert "get(" in spark._jsparkSession.expression(rule._jc).toString()
