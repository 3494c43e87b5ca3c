"""Counters, series limits and delivery accounting."""

import datetime as dt
import random

import pytest
from conftest import event, utc
from pyspark.sql import functions as F

from eventloom.operators import delivery, metrics
from eventloom.operators.metrics import Metric, MetricError, check_metrics, count_metrics, metric_delivery

BY_NAMESPACE = Metric("a", labels={"namespace": "namespace"})


def made(events, *namespaces):
    return events(*[event(namespace=n) | {"seq": i} for i, n in enumerate(namespaces)], seq="long").repartition(3)


def values(counted):
    return {(row["metric"], tuple(sorted(row["labels"].items()))): row["value"] for row in counted.collect()}


def test_counts_and_constant_labels(events):
    both = [
        Metric("total", const_labels={"env": "x"}),
        Metric("by", namespace="ns", subsystem="sub", labels={"z": "labels.z", "n": "namespace"}, const_labels={"m": "1"}),
    ]
    assert values(count_metrics(made(events, "a", "a", "b"), both)) == {
        ("events_total", (("env", "x"),)): 3,
        ("ns_sub_by", (("m", "1"), ("n", "a"), ("z", ""))): 2,
        ("ns_sub_by", (("m", "1"), ("n", "b"), ("z", ""))): 1,
    }


def test_series_limit(events):
    ten = made(events, *[f"team-{i}" for i in range(10)])
    assert len(values(count_metrics(ten, [BY_NAMESPACE], 3, "seq"))) == 3
    known = made(events, "team-a", "team-a", "team-b", "team-a")
    assert values(count_metrics(known, [BY_NAMESPACE], 1, "seq")) == {("events_a", (("namespace", "team-a"),)): 3}
    two = [BY_NAMESPACE, Metric("b", labels={"namespace": "namespace"})]
    assert values(count_metrics(made(events, "team-a", "team-b"), two, 2, "seq")) == {
        ("events_a", (("namespace", "team-a"),)): 1, ("events_b", (("namespace", "team-a"),)): 1,
    }
    with pytest.raises(ValueError):
        count_metrics(known, [BY_NAMESPACE], 1)


@pytest.mark.parametrize("limit", [0, 1, 4, 9, 50])
def test_limited_sink_equals_a_sequential_one(events, limit):
    choose = random.Random(limit)
    rows = [(choose.choice("abcdef"), choose.choice("xyz")) for _ in range(80)]
    table = events(*[event(namespace=n, reason=r) | {"seq": i} for i, (n, r) in enumerate(rows)], seq="long").repartition(4)
    defined = [Metric("m", labels={"n": "namespace"}), Metric("k", labels={"n": "namespace", "r": "reason"})]
    series, delivered = {}, []
    for n, r in rows:
        recorded = False
        for key in (("m", n), ("k", n, r)):
            if key in series or not limit or len(series) < limit:
                series[key] = series.get(key, 0) + 1
                recorded = True
        delivered.append(recorded)
    got = {(row["metric"][-1], *[row["labels"][k] for k in sorted(row["labels"])]): row["value"]
           for row in count_metrics(table, defined, limit, "seq").collect()}
    assert got == series
    flags = metric_delivery(table, defined, limit, "seq").orderBy("seq").collect()
    assert [row["delivered"] for row in flags] == delivered


def test_counting_is_one_exchange(events):
    counted = count_metrics(made(events, "a"), [BY_NAMESPACE, Metric("b"), Metric("c", labels={"r": "reason"})])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(metric_index") == 1


@pytest.mark.parametrize(
    "definition",
    [
        [],
        [Metric("x", namespace="9lives")],
        [Metric("bad:name")],
        [Metric("two words")],
        [Metric("")],
        [Metric("x", namespace="go")],
        [Metric("a"), Metric("a")],
        [Metric("a", labels={"__x": "type"})],
        [Metric("a", labels={"x-y": "type"})],
        [Metric("a", labels={"x": "nope"})],
        [Metric("a", labels={"x": "type"}, const_labels={"x": "1"})],
    ],
)
def test_metrics_refused(spark, definition):
    with pytest.raises(MetricError):
        check_metrics(definition)


def test_refused_metrics_never_reach_a_plan(events):
    with pytest.raises(MetricError):
        count_metrics(made(events, "a"), [Metric("bad:name"), Metric("good")])


def test_values_that_are_no_text_are_not_counted(events):
    rows = made(events, "a", "b").withColumn("namespace", F.when(F.col("seq") == 0, F.unhex(F.lit("FF")).cast("string")).otherwise("b"))
    for limit, expected in ((0, {("events_a", (("namespace", "b"),)): 1}), (1, {})):
        assert values(count_metrics(rows, [BY_NAMESPACE], limit, "seq")) == expected
        flags = [row["delivered"] for row in metric_delivery(rows, [BY_NAMESPACE], limit, "seq").orderBy("seq").collect()]
        assert flags == [False, limit == 0]


def test_a_metric_name_belongs_to_one_sink():
    metrics.check_metric_sinks({"x": [Metric("a")], "y": [Metric("b")]})
    with pytest.raises(MetricError):
        metrics.check_metric_sinks({"x": [Metric("a.b")], "y": [Metric("a_b")]})


def test_utf8_names(spark):
    check_metrics([Metric("a.b", labels={"x.y": "type"})], scheme="utf8")
    for refused in ([Metric("a.b"), Metric("a_b")], [Metric("a", labels={"x.y": "type", "x_y": "type"})], [Metric("x", namespace="go.a")]):
        with pytest.raises(MetricError):
            check_metrics(refused, scheme="utf8")
    with pytest.raises(MetricError):
        check_metrics([Metric("a")], scheme="other")


# --- delivery ----------------------------------------------------------------


def outcomes(spark, column, values, schema):
    rows = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [row["o"] for row in rows.select(column.alias("o")).collect()]


def test_http_outcomes(spark):
    cases = {200: "success", 299: "success", 301: "permanent", 400: "permanent", 408: "retryable", 413: "oversized",
             429: "retryable", 500: "retryable", 501: "permanent", 503: "retryable", None: "retryable"}
    assert outcomes(spark, delivery.http_outcome(F.col("s")), cases, "s int") == list(cases.values())
    assert outcomes(spark, delivery.http_outcome(F.col("s"), F.col("t")), [(None, True), (200, False)], "s int, t boolean") == ["timeout", "success"]


def test_grpc_outcomes(spark):
    cases = {(0, False): "success", (1, False): "retryable", (3, False): "permanent", (4, False): "retryable", (8, False): "oversized",
             (8, True): "retryable", (14, False): "retryable", (16, False): "permanent", (None, False): "retryable"}
    assert outcomes(spark, delivery.grpc_outcome(F.col("c"), F.col("r")), list(cases), "c int, r boolean") == list(cases.values())


def test_kafka_attempts_add_up_refusals(spark):
    rows = [("k", "b", 1, 10), ("k", "b", 1, 7), ("k", "b", 1, 0), ("k", "b", 2, 2), ("k", "b", 2, 0), ("k", "c", 1, 29), ("k", "c", 1, 0)]
    records = spark.createDataFrame(rows, "sink string, batch_id string, attempt long, code int")
    got = sorted(tuple(r) for r in delivery.kafka_attempts(records).collect())
    assert got == [("k", "b", 1, "retryable", 0), ("k", "b", 2, "success", 2), ("k", "c", 1, "permanent", 0)]


@pytest.mark.parametrize(
    "header, delay",
    [("5", 5.0), ("0", None), ("-3", None), ("", None), (None, None), ("soon", None), ("Wed, 21 Oct 2015 07:28:10 GMT", 10.0), ("Wed, 21 Oct 2015 07:27:00 GMT", None)],
)
def test_retry_after(spark, header, delay):
    now = utc(2015, 10, 21, 7, 28)
    rows = spark.createDataFrame([(header, now)], "h string, now timestamp")
    assert rows.select(delivery.retry_after_seconds(F.col("h"), F.col("now")).alias("d")).collect()[0]["d"] == delay


def test_batch_fates_and_counts(spark):
    rows = [
        ("s", "ok", 1, 10, 0, "retryable"), ("s", "ok", 2, 10, 3, "success"),
        ("s", "neg", 1, 10, -4, "success"), ("s", "over", 1, 10, 40, "success"),
        ("s", "bad", 1, 5, 0, "permanent"), ("s", "big", 1, 6, 0, "oversized"),
        ("s", "gone", 1, 7, 0, "retryable"), ("s", "gone", 2, 7, 0, "timeout"),
    ]
    attempts = spark.createDataFrame(rows, "sink string, batch_id string, attempt int, frames int, refused int, result string")
    fates = delivery.batch_fate(attempts)
    assert {r["batch_id"]: r["fate"] for r in fates.collect()} == {
        "ok": "success", "neg": "success", "over": "success", "bad": "permanent_error", "big": "permanent_error", "gone": "retry_exhausted",
    }
    assert [tuple(r) for r in delivery.delivered_counts(fates).collect()] == [("s", 17, 13)]
    drops = sorted(tuple(r) for r in metrics.drop_counts(delivery.delivery_drops(fates)).collect())
    assert drops == [("delivery", "permanent_error", "", "s", 11), ("delivery", "retry_exhausted", "", "s", 7), ("sink", "rejected", "", "s", 13)]


def test_send_histogram(spark):
    rows = spark.createDataFrame([("s", "success", x) for x in (0.001, 0.005, 0.2, 31.0)], "sink string, result string, seconds double")
    found = {r["le"]: r["attempts"] for r in delivery.send_duration_hist(rows).collect()}
    assert found["0.005"] == 2 and found["0.1"] == 2 and found["0.25"] == 3 and found["30.0"] == 3 and found["+Inf"] == 4
    assert len(found) == 13


def test_backoff(spark):
    rows = spark.createDataFrame(
        [(1, "retryable", 0.0, None), (2, "retryable", 0.0, None), (20, "timeout", 16.0, None), (1, "retryable", 0.0, 25), (1, "permanent", 0.0, None), (1, "retryable", 29.6, None)],
        "attempt_no int, result string, elapsed_s double, retry_after_s int",
    )
    got = [(r["wait_min_s"], r["wait_max_s"], r["may_retry"], r["must_retry"]) for r in delivery.backoff_plan(rows).collect()]
    assert got == [
        (0.5, 0.75, True, True), (0.75, 1.125, True, True), (10.0, 15.0, True, False), (25.0, 37.5, True, False),
        (0.5, 0.75, False, False), (0.5, 0.75, False, False),
    ]
    off = delivery.backoff_plan(rows, delivery.RetryPolicy(enabled=False, timeout=dt.timedelta(seconds=60)))
    assert not any(r["may_retry"] for r in off.collect())
