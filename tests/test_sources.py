import datetime as dt

import pytest
from conftest import event, ref, utc
from pyspark.sql import functions as F

from eventloom.schema import FRAME, RAW_EVENT
from eventloom.sources import events as source
from eventloom.sources import replay


def names(rows):
    return sorted(row["name"] for row in rows.select("name").collect())


def test_field_selector(events):
    rows = events(
        event(name="a", reason="Failed", type="Warning", regarding=ref(kind="Pod")),
        event(name="b", reason="Failed", type="Normal", regarding=ref(kind="Node")),
        event(name="c", reason="Pulled", type="Normal", regarding=ref(kind="Pod")),
    )
    assert names(rows.filter(source.field_selector("reason=Failed"))) == ["a", "b"]
    assert names(rows.filter(source.field_selector("regarding.kind==Pod,type!=Warning"))) == ["c"]
    assert names(rows.filter(source.field_selector([("metadata.name", "=", "b")]))) == ["b"]
    assert names(rows.filter(source.field_selector(""))) == ["a", "b", "c"]
    for refused in ("note=x", "reason>x", "reason"):
        with pytest.raises(source.SelectorError):
            source.field_selector(refused)


@pytest.mark.parametrize(
    "spec, expected",
    [
        ("app=web", ["a"]),
        ("app!=web", ["b", "c"]),
        ("app in (web, db)", ["a", "b"]),
        ("app notin (web,db)", ["c"]),
        ("app", ["a", "b"]),
        ("!app", ["c"]),
        ("app,tier notin (front)", ["b"]),
        ([("app", "exists", []), ("tier", "=", "front")], ["a"]),
    ],
)
def test_label_selector(events, spec, expected):
    rows = events(
        event(name="a", labels={"app": "web", "tier": "front"}),
        event(name="b", labels={"app": "db"}),
        event(name="c"),
    )
    assert names(rows.filter(source.label_selector(spec))) == expected


def test_watches_are_checked():
    for refused in (
        [],
        [source.Watch(), source.Watch("a")],
        [source.Watch("a"), source.Watch("a")],
        [source.Watch("Not_A_Name")],
        [source.Watch("a", field_selector="note=x")],
        [source.Watch("a", label_selector="a b c")],
    ):
        with pytest.raises(ValueError):
            source.check_watches(refused)
    assert source.Watch().name == "*"


def test_read_and_bind(spark, tmp_path):
    (tmp_path / "in.json").write_text(
        '{"uid":"1","namespace":"team-a","reason":"x","labels":{"a":"b"},"regarding":{"kind":"Pod"}}\n'
        '{"uid":"2","namespace":"team-b","reason":"x"}\n{"uid":"3","namespace":"team-c","reason":"x"}\n'
    )
    watches = [source.Watch("team-a"), source.Watch("team-b", field_selector="reason=y")]
    rows = source.read_events(spark, str(tmp_path), "json", watches)
    assert [(row.uid, row.watch) for row in rows.collect()] == [("1", "team-a")]
    everything = source.read_events(spark, str(tmp_path), "json")
    assert {row.watch for row in everything.collect()} == {"*"}
    assert everything.drop("watch").schema.simpleString() == RAW_EVENT.simpleString()


def test_parse_events(spark):
    rows = spark.createDataFrame([(1, bytearray(b'{"uid":"1","deprecatedCount":3}'))], "offset long, value binary")
    row = source.parse_events(rows, keep=["offset"]).collect()[0]
    assert (row["offset"], row["uid"], row["deprecatedCount"], row["regarding"]) == (1, "1", 3, None)


def frame(watch, seq, kind, version, ends=False):
    raw = {name: None for name in RAW_EVENT.names}
    raw |= {"resourceVersion": version, "uid": f"{watch}-{seq}"}
    raw["annotations"] = {replay.INITIAL_EVENTS_END: "true"} if ends else {}
    return (watch, seq, kind, tuple(raw[name] for name in RAW_EVENT.names))


@pytest.mark.parametrize("kind, delivered", [("ADDED", 1), ("MODIFIED", 1), ("DELETED", 0), ("BOOKMARK", 0)])
def test_every_frame_advances_but_only_some_deliver(spark, kind, delivered):
    frames = spark.createDataFrame([frame("w", 1, kind, "1042")], FRAME)
    stored = spark.createDataFrame([("w", "1000")], "watch string, resource_version string")
    assert source.frame_events(source.deliverable_frames(frames)).count() == delivered
    assert [tuple(row) for row in replay.positions(frames, stored).collect()] == [("w", "1042")]


def test_positions_wait_for_the_end_of_the_replay(spark):
    frames = spark.createDataFrame(
        [
            frame("a", 1, "ADDED", "7"),
            frame("a", 2, "BOOKMARK", "9", ends=True),
            frame("b", 3, "ADDED", "11"),
            frame("c", 4, "BOOKMARK", "20", ends=True),
            frame("c", 5, "DELETED", "21"),
            frame("c", 6, "ADDED", ""),
            frame("d", 7, "BOOKMARK", "", ends=True),
            frame("e", 8, "BOOKMARK", "30"),
        ],
        FRAME,
    )
    assert sorted(tuple(row) for row in replay.positions(frames).collect()) == [("a", "9"), ("c", "21")]
    stored = spark.createDataFrame(
        [("b", "5"), ("e", "6"), ("gone", "8"), ("blank", "")], "watch string, resource_version string"
    )
    moved = replay.positions(frames, stored, replaying=["e"])
    assert sorted(tuple(row) for row in moved.collect()) == [
        ("a", "9"), ("b", "11"), ("c", "21"), ("e", "6"), ("gone", "8"),
    ]


def test_changed_positions(spark):
    def table(*rows):
        return spark.createDataFrame(rows, "watch string, resource_version string")

    old = table(("a", "1"), ("b", "2"), ("c", "3"))
    assert replay.changed_positions(old, old).isEmpty()
    changed = replay.changed_positions(old, table(("a", "1"), ("b", "5"), ("d", "4")))
    assert sorted(tuple(row) for row in changed.collect()) == [
        ("b", "2", "5"), ("c", "3", None), ("d", None, "4"),
    ]


@pytest.mark.parametrize(
    "version, floor, kept",
    [
        ("999", "1000", False),
        ("1000", "1000", False),
        ("1001", "1000", True),
        ("abc", "1000", True),
        ("", "1000", True),
        ("0999", "1000", True),
        ("1", "abc", True),
        ("123456789012345678901234567890", "123456789012345678901234567889", True),
        ("99", "123456789012345678901234567889", False),
    ],
)
def test_replay_after(events, spark, version, floor, kept):
    rows = events(event(resourceVersion=version) | {"watch": "w"}, watch="string")
    stored = spark.createDataFrame([("w", floor)], "watch string, resource_version string")
    assert replay.replay_after(rows, stored).count() == int(kept)


def test_replay_age_and_expiry(events, spark):
    start = utc(2024, 1, 2)
    rows = events(
        event(name="old", eventTime=utc(2024, 1, 1), resourceVersion="1") | {"watch": "a"},
        event(name="edge", eventTime=utc(2024, 1, 1, 23), resourceVersion="2") | {"watch": "a"},
        event(name="again", eventTime=utc(2023, 1, 1), series=(2, utc(2024, 1, 1, 23, 30)), resourceVersion="3")
        | {"watch": "a"},
        event(name="b-old", eventTime=utc(2020, 1, 1), resourceVersion="8") | {"watch": "b"},
        event(name="b-seen", eventTime=utc(2024, 1, 1, 23), resourceVersion="6") | {"watch": "b"},
        watch="string",
    )
    hour = dt.timedelta(hours=1)
    only_a = rows.filter("watch = 'a'")
    assert names(replay.replay_max_age(only_a, start, hour)) == ["again", "edge"]
    assert names(replay.replay_max_age(only_a, start, dt.timedelta(0))) == ["again", "edge", "old"]
    stored = spark.createDataFrame([("b", "7")], "watch string, resource_version string")
    assert names(replay.expiry_replay(rows, stored, start, hour)) == ["again", "b-old", "edge"]
    counts = replay.replay_counts(replay.replay_verdicts(rows, stored, start, hour))
    assert sorted(tuple(row) for row in counts.collect()) == [("a", 2, 1), ("b", 1, 1)]


def test_field_selector_reaches_the_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").withColumnRenamed("c_mktsegment", "reason")
    plan = rows.filter(source.field_selector("reason=BUILDING")).select(F.col("reason"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in text


def test_parse_events_leaves_out_what_is_no_object(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(["{}", "", "no", "[1]", "null", '{"uid": "u"', '{"uid": "u"}', None])], "k long, value string")
    got = {row.k: row.uid for row in source.parse_events(rows, keep=["k"]).collect()}
    assert got == {0: None, 6: "u"}
