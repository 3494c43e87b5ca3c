"""Encoders, request bodies and signatures."""

import base64
import hashlib
import hmac
import json

import pytest
from conftest import event, ref, utc
from pyspark.sql import functions as F

from eventloom.catalogue import QUERIES
from eventloom.operators import batching, export
from eventloom.operators.encode import Identity, TemplateError, cloudevents, gelf, kafka_records, template, to_canonical_json
from eventloom.operators.otlp import otlp_compact, otlp_groups, otlp_records, severity_number

FULL = event(
    uid="u1", resourceVersion="7005", namespace="team-a", name="web.1",
    labels={"role": "edge", "crew": "blue"}, annotations={"example.org/why": "drill"},
    eventTime=utc(2031, 5, 6, 7, 8, 9, 101112), series=(7, utc(2031, 5, 6, 7, 9, 9, 120000)),
    reportingController="kubelet", reportingInstance="node-1", action="Moving", reason="Throttled",
    regarding=ref(kind="Pod", namespace="team-a", name="web", uid="p1", apiVersion="v1", resourceVersion="4", fieldPath="spec.containers{web}"),
    related=ref(kind="ConfigMap", name="conf"),
    note='put <left> & "right"\n\t\\ é  ', type="Warning",
    regardingObject=({"app": "web"}, {"a/b": "x"}, ref(kind="ReplicaSet", namespace="team-a", name="rs", uid="r1", apiVersion="apps/v1"), True),
)
ME = Identity(cluster="prod", node="node-7", namespace="agents", pod="agent-0", version="1.0.0", commit="abc")


def text(events, row, column):
    return events(row).select(column.alias("t")).collect()[0]["t"]


def test_canonical_json_of_a_full_event(events):
    expected = (
        '{"uid":"u1","resourceVersion":"7005","namespace":"team-a","name":"web.1",'
        '"labels":{"crew":"blue","role":"edge"},"annotations":{"example.org/why":"drill"},'
        '"eventTime":"2031-05-06T07:08:09.101112Z","series":{"count":7,"lastObservedTime":"2031-05-06T07:09:09.120000Z"},'
        '"reportingController":"kubelet","reportingInstance":"node-1","action":"Moving","reason":"Throttled",'
        '"regarding":{"kind":"Pod","namespace":"team-a","name":"web","uid":"p1","apiVersion":"v1","resourceVersion":"4","fieldPath":"spec.containers{web}"},'
        '"related":{"kind":"ConfigMap","name":"conf"},'
        '"note":"put <left> & \\"right\\"\\n\\t\\\\ é  ","type":"Warning",'
        '"regardingObject":{"labels":{"app":"web"},"annotations":{"a/b":"x"},'
        '"owner":{"kind":"ReplicaSet","namespace":"team-a","name":"rs","uid":"r1","apiVersion":"apps/v1"},"terminating":true}}'
    )
    assert text(events, FULL, to_canonical_json()) == expected


@pytest.mark.parametrize(
    "row, expected",
    [
        (event(), '{"eventTime":null,"regarding":{}}'),
        (event(uid="q", series=(31, None), regarding=ref(uid="w")), '{"uid":"q","eventTime":null,"series":{"count":31,"lastObservedTime":null},"regarding":{"uid":"w"}}'),
        (event(note="n", regardingObject=({}, {"k": ""}, None, False)), '{"eventTime":null,"regarding":{},"note":"n","regardingObject":{"annotations":{"k":""}}}'),
        (event(type="T", related=ref()), '{"eventTime":null,"regarding":{},"related":{},"type":"T"}'),
        (event(eventTime=utc(2031, 12, 31, 23, 59, 59, 7)), '{"eventTime":"2031-12-31T23:59:59.000007Z","regarding":{}}'),
    ],
)
def test_canonical_json_edges(events, row, expected):
    assert text(events, row, to_canonical_json()) == expected


def test_control_characters_parse_back(events):
    note = "".join(map(chr, range(1, 32))) + "\x7f"
    assert json.loads(text(events, event(note=note), to_canonical_json()))["note"] == note


def test_kafka_records(events):
    for key, expected in (("uid", "u1"), ("namespace", "team-a"), ("none", None)):
        row = kafka_records(events(FULL), key, ME, prefix="app").collect()[0]
        assert row["key"] == expected and json.loads(row["value"])["uid"] == "u1"
        assert [(h["key"], bytes(h["value"]).decode()) for h in row["headers"]] == [
            ("app-cluster", "prod"), ("app-pod", "agent-0"), ("app-namespace", "agents"), ("app-node", "node-7"), ("app-version", "1.0.0"),
        ]
    bare = kafka_records(events(event())).collect()[0]
    assert bare["key"] is None and bare["headers"] == []
    with pytest.raises(ValueError):
        kafka_records(events(FULL), "name")


def test_cloudevents(events):
    document = json.loads(text(events, FULL, cloudevents("here", "io.k8s.event")))
    assert list(document) == ["specversion", "id", "source", "type", "time", "datacontenttype", "data"]
    assert (document["id"], document["time"], document["source"]) == ("u1/7005", "2031-05-06T07:09:09.12Z", "here")
    assert document["data"]["regarding"]["kind"] == "Pod"
    whole = json.loads(text(events, event(eventTime=utc(2033, 4, 5, 6, 7, 8)), cloudevents()))
    assert (whole["id"], whole["time"]) == ("/", "2033-04-05T06:07:08Z")


def test_template(events):
    compiled = template('{"n":"{{ note }}","c":"{{agent.cluster}}","x":"{{ labels.none }}"}', ME)
    assert json.loads(text(events, FULL, compiled)) == {"n": FULL["note"], "c": "prod", "x": ""}
    assert text(events, FULL, template("plain")) == "plain"
    assert text(events, event(), template("{{ reason }}")) == ""
    for refused in ("{{ nope }}", "{{ }}", "a {{ note", "{{ agent.nope }}"):
        with pytest.raises(TemplateError):
            template(refused)


def test_gelf(events):
    document = json.loads(text(events, FULL, gelf("", ME, {"env": "live", "b/c": "2"}, prefix="me_")))
    assert document == {
        "version": "1.1", "host": "agent-0", "short_message": "Throttled", "full_message": FULL["note"], "timestamp": 1935817749.12,
        "level": 4, "_event_reason": "Throttled", "_event_action": "Moving", "_event_type": "Warning", "_event_count": 7,
        "_event_start_time": "2031-05-06T07:08:09.101112Z", "_event_name": "web.1", "_event_uid": "u1",
        "_event_reporting_controller": "kubelet", "_event_reporting_instance": "node-1", "_namespace_name": "team-a",
        "_object_kind": "Pod", "_object_name": "web", "_object_namespace": "team-a", "_object_uid": "p1",
        "_object_api_version": "v1", "_object_resource_version": "4", "_object_owner_kind": "ReplicaSet",
        "_object_owner_name": "rs", "_object_terminating": True, "_object_label_app": "web", "_object_annotation_a_b": "x",
        "_me_cluster": "prod", "_me_node": "node-7", "_me_namespace": "agents", "_me_pod": "agent-0", "_me_version": "1.0.0",
        "_b_c": "2", "_env": "live",
    }
    bare = text(events, event(type="Other", eventTime=utc(2033, 4, 5)), gelf("h"))
    assert bare == '{"version":"1.1","host":"h","short_message":"-","timestamp":1996272000.000,"level":6,"_event_type":"Other","_event_count":1}'
    assert "timestamp" not in json.loads(text(events, event(), gelf("h")))
    for name in ("", "_x", "id", "ID", "agent_x", "a b", "a:b"):
        with pytest.raises(ValueError):
            gelf("h", additional={name: "v"})


def test_gelf_seconds_round_from_the_double(events):
    micros = [500, 1500, 123500, 179500, 999500, 999499, 999999]
    rows = events(*[event(uid=str(m), eventTime=utc(2024, 1, 1, 0, 0, 7, m)) for m in micros])
    for row in rows.select("uid", gelf("h").alias("t")).collect():
        stamp = row["t"].split('"timestamp":')[1].split(",")[0]
        assert stamp == f"{1704067207 + int(row['uid']) * 1000 / 1e9:.3f}"


def test_otlp(events):
    observed = F.lit("2032-02-29 01:02:03").cast("timestamp")
    row = otlp_records(events(FULL), observed, ME, "svc").collect()[0]
    resource = [(a["key"], *a["value"].items()) for a in json.loads(row["resource"])["attributes"]]
    keys = ["service.name", "service.version", "k8s.cluster.name", "k8s.namespace.name", "k8s.pod.name", "k8s.node.name"]
    keys += [f"k8s.object.{k}" for k in ("kind", "name", "namespace", "uid", "api_version", "resource_version", "fieldpath",
             "label.app", "annotation.a/b", "terminating", "owner.kind", "owner.name", "owner.namespace", "owner.uid", "owner.api_version")]
    assert [a[0] for a in resource] == keys
    assert ("k8s.object.terminating", ("boolValue", True)) in resource
    record = json.loads(row["record"])
    assert record["timeUnixNano"] == "1935817749120000000" and record["observedTimeUnixNano"] == "1961629323000000000"
    assert (record["severityNumber"], record["severityText"], record["body"]) == ("SEVERITY_NUMBER_WARN", "Warning", {"stringValue": FULL["note"]})
    attributes = {a["key"]: a["value"] for a in record["attributes"]}
    assert attributes["k8s.event.start_time"] == {"stringValue": "2031-05-06T07:08:09.101112Z"}
    assert attributes["k8s.event.count"] == {"intValue": "7"} and list(attributes)[0] == "k8s.event.name"
    bare = otlp_records(events(event(eventTime=utc(2033, 4, 5))), observed).collect()[0]
    assert set(json.loads(bare["record"])) == {"timeUnixNano", "observedTimeUnixNano", "body"}


def test_otlp_severity(events):
    cases = {"Normal": 9, "NORMAL": 9, "warning": 13, "Error": 17, "Critical": 21, "Odd": 0, "": 0}
    rows = events(*[event(type=kind) for kind in cases])
    assert {row[0]: row[1] for row in rows.select("type", severity_number(F.col("type"))).collect()} == cases


def test_otlp_groups_keep_arrival_order(spark):
    rows = [("b1", 1, "R2", "a"), ("b1", 2, "R1", "b"), ("b1", 3, "R2", "c"), ("b2", 4, "R2", "d"), ("b1", 11, "R1", "e")]
    records = spark.createDataFrame(rows, "batch_id string, seq long, resource string, record string").repartition(3)
    groups = {(r["batch_id"], r["resource"]): r["log_records"] for r in otlp_groups(records).collect()}
    assert groups == {("b1", "R2"): ["a", "c"], ("b1", "R1"): ["b", "e"], ("b2", "R2"): ["d"]}
    quoted = records.withColumns({"resource": F.concat(F.lit('"'), "resource", F.lit('"')), "record": F.concat(F.lit('"'), "record", F.lit('"'))})
    bodies = {r["batch_id"]: json.loads(r["body"]) for r in otlp_compact(quoted, "scope", "1").collect()}
    assert [g["resource"] for g in bodies["b1"]["resourceLogs"]] == ["R2", "R1"]
    assert bodies["b1"]["resourceLogs"][1]["scopeLogs"] == [{"scope": {"name": "scope", "version": "1"}, "logRecords": ["b", "e"]}]


def test_many_records_are_placed_over_more_partitions(spark):
    """What a task sorts of the texts of batches has a bound, whatever the number of shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert batching.parts_for(spark.range(10)) == least
    assert batching.parts_for(spark.range(0)) == least
    parts = batching.parts_for(spark.range(10 * least + 1), 10)
    assert parts == least + 1
    rows = spark.range(2000).selectExpr(
        "string(id div 4) AS batch_id", "id AS seq", "string(id % 2) AS resource", "string(id) AS record", "string(id) AS frame"
    )
    placed = F.spark_partition_id().alias("part")
    for grouped in (otlp_groups(rows, parts), export.batch_lists(rows, parts)):
        assert grouped.select(placed).distinct().count() == parts
    assert sorted(otlp_groups(rows, parts).collect()) == sorted(otlp_groups(rows).collect())
    assert sorted(otlp_compact(rows, parts=parts).collect()) == sorted(otlp_compact(rows).collect())
    assert sorted(export.request_bodies(rows, parts=parts).collect()) == sorted(export.request_bodies(rows).collect())


def test_otlp_queries_place_by_number_of_events(spark, tmp_path, monkeypatch):
    """The queries hand the bound on: with a low one, their batches lie in more partitions than Spark shuffles into."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(batching.parts_for, "__defaults__", (20,))
    for name in ("otlp_resource_groups", "otlp_requests", "request_bodies", "signed_requests"):
        parts = QUERIES[name](spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("part")).distinct().count()
        assert parts > least, name


def test_request_bodies(spark):
    frames = spark.createDataFrame([("b", 2, "{2}"), ("b", 1, "{1}"), ("c", 10, "{10}"), ("c", 9, "{9}")], "batch_id string, seq long, frame string").repartition(3)

    def bodies(*args):
        return {r["batch_id"]: (r["body"], r["content_type"], r["frames"]) for r in export.request_bodies(frames, *args).collect()}

    assert bodies("json-list")["c"] == ("[{9},{10}]", "application/json", 2)
    assert bodies("ndjson")["b"] == ("{1}\n{2}\n", "application/x-ndjson", 2)
    assert bodies("cloudevents")["b"][:2] == ("[{1},{2}]", "application/cloudevents-batch+json")
    assert bodies("template", "; ")["b"][:2] == ("{1}; {2}", "application/json")
    with pytest.raises(ValueError):
        export.request_bodies(frames, "xml")


@pytest.mark.parametrize("size", [24, 32, 64])
def test_signature_equals_the_standard_library(spark, size):
    key = bytes(range(7, 7 + size))
    body = '[{"n":"é"}]'
    requests = spark.createDataFrame([("id1", body)], "batch_id string, body string")
    row = export.sign_requests(requests, "whsec_" + base64.b64encode(key).decode(), F.lit(1717200000)).collect()[0]
    expected = base64.b64encode(hmac.new(key, f"msg_id1.1717200000.{body}".encode(), hashlib.sha256).digest()).decode()
    assert (row["webhook_id"], row["webhook_timestamp"], row["webhook_signature"]) == ("msg_id1", "1717200000", "v1," + expected)


@pytest.mark.parametrize("secret", ["abc", "whsec_!!", "whsec_" + base64.b64encode(b"x" * 23).decode(), "whsec_" + base64.b64encode(b"x" * 65).decode()])
def test_secret_refused(secret):
    with pytest.raises(ValueError):
        export.decode_secret(secret)
