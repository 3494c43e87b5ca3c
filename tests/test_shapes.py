"""Lifting, sanitising and enrichment."""

import pytest
from conftest import event, ref, utc
from pyspark.sql import functions as F

from eventloom.functions.fields import UnknownFieldError, field, get_or, has, same_object, same_reference
from eventloom.functions.text import truncate_bytes, valid_utf8
from eventloom.operators import enrich as enrichment
from eventloom.operators.lift import lift
from eventloom.operators.sanitize import LAST_APPLIED, SanitizeSpec, cap_map, limit_values, sanitize
from eventloom.schema import EVENT, OBJECT, RAW_EVENT

READ = "2024-06-01 00:00:00"


@pytest.fixture
def lifted(spark):
    def one(**fields):
        raw = {name: None for name in RAW_EVENT.names} | fields
        rows = spark.createDataFrame([tuple(raw[name] for name in RAW_EVENT.names)], RAW_EVENT)
        return lift(rows, READ).collect()[0]

    return one


def test_lift_never_leaves_null_strings(lifted):
    row = lifted()
    assert [row[name] for name in ("uid", "namespace", "note", "type")] == [""] * 4
    assert row["labels"] == {} and row["annotations"] == {}
    assert row["regarding"].asDict() == ref()
    assert row["related"] is None and row["series"] is None and row["regardingObject"] is None
    assert row["eventTime"].isoformat() == "2024-06-01T00:00:00"


def test_lift_promotes_deprecated_fields(lifted):
    row = lifted(
        deprecatedSource=("kubelet", "node-1"),
        deprecatedFirstTimestamp=utc(2024, 1, 1),
        deprecatedLastTimestamp=utc(2024, 1, 2),
        deprecatedCount=3,
    )
    assert row["reportingController"] == "kubelet" and row["reportingInstance"] == "node-1"
    assert row["eventTime"].isoformat() == "2024-01-01T00:00:00"
    assert row["series"]["count"] == 3 and row["series"]["lastObservedTime"].isoformat() == "2024-01-02T00:00:00"


def test_lift_prefers_modern_fields(lifted):
    row = lifted(
        reportingController="scheduler",
        reportingInstance="",
        deprecatedSource=("kubelet", "node-1"),
        eventTime=utc(2024, 2, 1),
        deprecatedFirstTimestamp=utc(2024, 1, 1),
        series=(9, None),
        deprecatedCount=3,
    )
    assert (row["reportingController"], row["reportingInstance"]) == ("scheduler", "node-1")
    assert row["eventTime"].isoformat() == "2024-02-01T00:00:00"
    assert row["series"].asDict() == {"count": 9, "lastObservedTime": None}


@pytest.mark.parametrize("count, built", [(None, False), (0, False), (1, False), (2, True)])
def test_lift_builds_a_series_only_for_repeats(lifted, count, built):
    series = lifted(deprecatedCount=count)["series"]
    assert (series is not None) == built
    if built:
        assert series["lastObservedTime"] is None


@pytest.mark.parametrize(
    "data, expected",
    [
        ("61FFFE62", "a�b"),
        ("FF", "�"),
        ("61E282", "a�"),
        ("EDA080", "�"),
        ("C0AF41FF", "�A�"),
        ("F48FBFBFF4908080", "\U0010ffff�"),
        ("EFBFBDFF", "��"),
        ("C3A9E282ACF09D849E", "é€𝄞"),
        ("", ""),
    ],
)
def test_valid_utf8(spark, data, expected):
    rows = spark.range(1).select(F.unhex(F.lit(data)).cast("string").alias("t"))
    assert rows.select(valid_utf8(F.col("t")).alias("t")).collect()[0]["t"] == expected


def test_valid_utf8_long_invalid_text(spark):
    rows = spark.range(1).select(
        F.concat(F.repeat(F.unhex(F.lit("FF")).cast("string"), 50_000), F.lit("é"), F.repeat(F.lit("x"), 50_000)).alias("t")
    )
    assert rows.select(valid_utf8(F.col("t")).alias("t")).collect()[0]["t"] == "�" + "é" + "x" * 50_000


@pytest.mark.parametrize(
    "text, limit, expected",
    [
        ("seven", 9, "seven"),
        ("seven", 5, "seven"),
        ("seven", 4, "seve"),
        ("", 3, ""),
        ("ñandú", 1, ""),
        ("ñandú", 2, "ñ"),
        ("ñandú", 6, "ñand"),
        ("日本", 5, "日"),
        ("x🦉y", 4, "x"),
        ("x🦉y", 5, "x🦉"),
    ],
)
def test_truncate_bytes(spark, text, limit, expected):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(truncate_bytes(F.col("t"), limit).alias("t")).collect()[0]["t"] == expected


def test_truncate_bytes_at_every_limit(spark):
    text = "aé€𝄞" * 3
    rows = spark.createDataFrame([(text,)], "t string")
    limits = range(1, len(text.encode()) + 2)
    got = rows.select(*[truncate_bytes(F.col("t"), n).alias(str(n)) for n in limits]).collect()[0]
    for n in limits:
        assert got[str(n)] == text.encode()[:n].decode(errors="ignore")


def test_map_limits(spark):
    rows = spark.createDataFrame([({"zone": "north", "app": "parser", "tier": "back", "build": "20240601"},)], "m map<string,string>")

    def after(column):
        return rows.select(column.alias("m")).collect()[0]["m"]

    assert sorted(after(cap_map(F.col("m"), 3))) == ["app", "build", "tier"]
    assert len(after(cap_map(F.col("m"), 0))) == 4
    assert after(limit_values(F.col("m"), 4)) == {"zone": "nort", "app": "pars", "tier": "back", "build": "2024"}
    assert after(limit_values(F.col("m"), 0))["build"] == "20240601"


def test_sanitize_order_and_limits(events):
    long = "x" * 200
    rows = events(
        event(
            reason=long,
            action=long,
            note="n" * 2000,
            reportingController="c" * 400,
            regarding=ref(name="r" * 600, kind="Pod"),
            labels={"b": "1", "a": "2", "c": "3"},
            annotations={LAST_APPLIED: "secret", "z": "abcdef", "y": "1"},
        )
    )
    spec = SanitizeSpec(allowed_values={"reason": [long], "action": ["Killing"]}, max_labels=2, max_annotations=2, max_annotation_bytes=3)
    row = sanitize(rows, spec).collect()[0]
    # The allowlist sees the whole value, the limit then cuts it.
    assert (len(row["reason"]), row["action"]) == (128, "")
    assert (len(row["note"]), len(row["reportingController"])) == (1024, 317)
    assert len(row["regarding"]["name"]) == 512 and row["related"] is None
    assert row["labels"] == {"a": "2", "b": "1"}
    # The dropped annotation takes no slot of the limit.
    assert row["annotations"] == {"y": "1", "z": "abc"}


def test_sanitize_spec_is_checked():
    for refused in (
        {"allowed_values": {"note": []}},
        {"allowed_values": {"type": [" x"]}},
        {"allowed_values": {"type": ["x", "x"]}},
        {"allowed_values": {"type": None}},
        {"max_labels": -1},
    ):
        with pytest.raises(ValueError):
            SanitizeSpec(**refused)


def test_field_paths(events):
    rows = events(
        event(
            labels={"app": "web"},
            annotations={"kubernetes.io/change-cause": "rollout"},
            eventTime=utc(2009, 1, 3, 10, 29, 15, 123456),
            series=(7, None),
            regarding=ref(fieldPath="spec.containers{web}"),
            regardingObject=({}, {"cni.example.org/podIP": "10.1.2.3/32"}, ref(kind="ReplicaSet"), True),
        )
    )
    expected = {
        "labels.app": "web",
        "labels.none": "",
        "annotations.kubernetes.io/change-cause": "rollout",
        "series.count": "7",
        "series.lastObservedTime": "",
        "eventTime": "2009-01-03T10:29:15.123456Z",
        "regarding.fieldPath": "spec.containers{web}",
        "related.kind": "",
        "regardingObject.annotations.cni.example.org/podIP": "10.1.2.3/32",
        "regardingObject.owner.kind": "ReplicaSet",
        "regardingObject.terminating": "true",
    }
    row = rows.select(*[field(path).alias(str(i)) for i, path in enumerate(expected)]).collect()[0]
    assert list(row) == list(expected.values())
    bare = events(event()).select(field("regardingObject.terminating").alias("a"), field("regardingObject.labels.x").alias("b"))
    assert list(bare.collect()[0]) == ["false", ""]
    for unknown in ("unknown", "labels", "labels.", "regarding", "regarding.x", "series.x", "regardingObject.owner", "regardingObject.labels."):
        with pytest.raises(UnknownFieldError):
            field(unknown)


def test_presence_and_content_equality(events):
    one = ref(kind="Pod", name="a")
    obj = ({"a": "1", "b": "2"}, {}, one, False)
    rows = events(
        event(labels={"a": "1"}, series=(0, None), regarding=one, related=one, regardingObject=obj),
        event(),
    )
    checks = [has("labels"), has("labels.a"), has("series"), has("series.count"), has("regarding"), has("related.kind"),
              has("regardingObject.owner"), has("regardingObject.terminating"), has("eventTime")]
    got = [list(row) for row in rows.select(*[check.alias(str(i)) for i, check in enumerate(checks)]).collect()]
    assert got[0] == [True, True, True, False, True, True, True, False, False]
    assert got[1] == [False, False, False, None, False, None, None, None, False]
    same = rows.select(
        same_reference(F.col("regarding"), F.col("related")).alias("r"),
        same_object(F.col("regardingObject"), F.col("regardingObject")).alias("o"),
        get_or("labels.a", "d").alias("g"),
    )
    assert [list(row) for row in same.collect()] == [[True, True, "1"], [False, True, "d"]]


# --- enrichment --------------------------------------------------------------

KINDS = [
    enrichment.Kind("pods", "", "Pod", True),
    enrichment.Kind("nodes", "", "Node", False),
    enrichment.Kind("replicasets", "apps", "ReplicaSet", True),
    enrichment.Kind("secrets", "", "Secret", True),
]
DECLARED = ["pods", "nodes", "replicasets.apps", "nothing.example.com"]


@pytest.fixture
def live(spark):
    def make(*rows):
        full = []
        for row in rows:
            base = {"group": "", "kind": "Pod", "namespace": "team-a", "name": "", "uid": "", "labels": {}, "annotations": {},
                    "deletionTimestamp": None, "ownerReferences": []} | row
            full.append(tuple(base[name] for name in OBJECT.names))
        return spark.createDataFrame(full, OBJECT)

    return make


CASES = [
    (ref(apiVersion="v1", kind="Pod", namespace="team-a", name="web-0"), "hit"),
    (ref(apiVersion="v1", kind="Pod", namespace="team-a", name="web-0", uid="3f2b"), "hit"),
    (ref(apiVersion="v1", kind="Pod", namespace="team-a", name="web-0", uid="other"), "miss"),
    (ref(apiVersion="v1", kind="Pod", namespace="team-a", name="web-9"), "miss"),
    (ref(apiVersion="v1", kind="Secret", namespace="team-a", name="db"), "undeclared"),
    (ref(apiVersion="v1", kind="Pod", namespace="team-b", name="web-0"), "cross_namespace"),
    (ref(apiVersion="v1", kind="Pod", namespace="team-a"), "skipped"),
    (ref(apiVersion="v1", name="web-0"), "skipped"),
    (ref(apiVersion="v1", kind="Node", namespace="elsewhere", name="n1"), "hit"),
    (ref(apiVersion="apps/v1beta1", kind="ReplicaSet", namespace="team-a", name="rs"), "hit"),
    (ref(apiVersion="a/b/c", kind="Pod", namespace="team-a", name="web-0"), "undeclared"),
    (ref(apiVersion="", kind="Pod", namespace="team-a", name="web-0"), "hit"),
]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
@pytest.mark.parametrize("salts", [1, 3])
def test_enrich_outcomes(spark, events, live, threshold, salts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        objects = live(
            {"name": "web-0", "uid": "3f2b", "labels": {"app": "web"}},
            {"kind": "Node", "namespace": "", "name": "n1", "uid": "n"},
            {"group": "apps", "kind": "ReplicaSet", "name": "rs", "uid": "r"},
        )
        declared = enrichment.declared_kinds(KINDS, DECLARED)
        rows = events(*[event(uid=str(i), namespace="team-a", regarding=case) for i, (case, _) in enumerate(CASES)])
        projected = enrichment.project_objects(objects, KINDS)
        got = enrichment.enrich(rows, projected, declared, hot_object_salts=salts)
        found = {int(row["uid"]): row for row in got.collect()}
        assert [found[i]["enrich_result"] for i in range(len(CASES))] == [result for _, result in CASES]
        assert all((row["regardingObject"] is not None) == (row["enrich_result"] == "hit") for row in found.values())
        assert found[0]["regardingObject"]["labels"] == {"app": "web"}
        counts = {row["enrich_result"]: row["events"] for row in enrichment.enrich_counts(got).collect()}
        assert counts == {"hit": 5, "miss": 2, "undeclared": 2, "cross_namespace": 1, "skipped": 2}
        assert got.schema["regardingObject"].dataType == EVENT["regardingObject"].dataType
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_enrich_without_declared_kinds_leaves_events_alone(events, live):
    rows = events(event())
    assert enrichment.enrich(rows, live(), []) is rows


def test_declared_kinds(spark):
    assert [kind.kind for kind in enrichment.declared_kinds(KINDS, DECLARED)] == ["Pod", "Node", "ReplicaSet"]
    with pytest.raises(ValueError):
        enrichment.declared_kinds([*KINDS, enrichment.Kind("po", "", "Pod", True)], ["pods", "po"])
    table = spark.createDataFrame([(k.resource, k.group, k.kind, k.namespaced) for k in KINDS], "resource string, `group` string, kind string, namespaced boolean")
    assert enrichment.declared_kinds(enrichment.load_kinds(table.union(table), DECLARED), DECLARED) == enrichment.declared_kinds(KINDS, DECLARED)
    with pytest.raises(ValueError):
        enrichment.load_kinds(table.union(table.withColumn("kind", F.lit("Other"))), DECLARED)


@pytest.mark.parametrize(
    "version, kind, namespace",
    [("apps/v1", "ReplicaSet", "team-a"), ("v1", "Node", ""), ("example.com/v1", "Unknown", "")],
)
def test_owner_namespace(live, version, kind, namespace):
    owners = [("v1", "Pod", "x", "u0", False), (version, kind, "own", "u1", True)]
    row = enrichment.project_objects(live({"name": "a", "ownerReferences": owners}), KINDS).collect()[0]
    assert row["regardingObject"]["owner"].asDict() == ref(apiVersion=version, kind=kind, name="own", uid="u1", namespace=namespace)


def test_project_objects(live):
    objects = live({"name": "a", "labels": {"x": "1", "y": "2"}, "annotations": {"k": "v" * 10}, "deletionTimestamp": utc(2024, 1, 1)})
    plain = enrichment.project_objects(objects, KINDS).collect()[0]["regardingObject"]
    assert plain["labels"] == {"x": "1", "y": "2"} and plain["annotations"] == {}
    assert plain["owner"] is None and plain["terminating"] is True
    allow = enrichment.Allowlist(keys=("y", "z"))
    some = enrichment.project_objects(objects, KINDS, allow, enrichment.Allowlist(), SanitizeSpec(max_annotation_bytes=4)).collect()[0]["regardingObject"]
    assert some["labels"] == {"y": "2"} and some["annotations"] == {"k": "vvvv"}
    with pytest.raises(ValueError):
        enrichment.Allowlist(enabled=False, keys=("x",))


def test_latest_objects(spark):
    log = spark.createDataFrame(
        [(1, "ADDED", "", "Pod", "a", "x", "u1"), (2, "DELETED", "", "Pod", "a", "x", "u1"), (3, "ADDED", "", "Pod", "a", "x", "u2"),
         (4, "ADDED", "", "Pod", "a", "y", "u3"), (5, "DELETED", "", "Pod", "a", "y", "u3")],
        "seq long, change string, `group` string, kind string, namespace string, name string, uid string",
    )
    assert [(row["name"], row["uid"]) for row in enrichment.latest_objects(log).collect()] == [("x", "u2")]
