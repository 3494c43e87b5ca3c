"""The same operators on streams: one result, whatever the trigger cuts."""

import datetime as dt
import json
import uuid

import pytest
from conftest import utc
from pyspark.sql import functions as F
from test_sources import FRAME, frame

from eventloom.catalogue.tables import KINDS, frames, objects
from eventloom.functions.fields import field
from eventloom.operators import sampling
from eventloom.operators.encode import to_canonical_json
from eventloom.operators.enrich import declared_kinds
from eventloom.operators.metrics import Metric, count_metrics, series
from eventloom.plans.flow import EventPath
from eventloom.plans.spec import Flow
from eventloom.session import shared_folder
from eventloom.sources.events import Watch, read_frames
from eventloom.sources.replay import positions
from eventloom.streaming.run import count_limited, load_positions, load_refused, per_interval_stream, run_stream, running_counts, save_positions

SF_DIR = "/root/testdata/sf0.001"
READ = "2024-06-01 00:00:00"

PATH = EventPath(
    watches=[Watch(f"team-{i}") for i in range(5)],
    flows=[
        Flow("alerts", ("webhook", "archive"), ("type = 'Warning'",)),
        Flow("hits", ("archive",), ("regardingObject.labels['segment'] = 'BUILDING'",)),
    ],
    sinks=["webhook", "archive"],
    kinds=KINDS,
    declared=declared_kinds(KINDS, ["customers.shop.example.com"]),
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The frames of the test tables as four files, read one per trigger."""
    target = str(tmp_path_factory.mktemp("frames"))
    rows = frames(spark, SF_DIR).orderBy("seq").collect()
    schema = frames(spark, SF_DIR).schema
    for part in range(4):
        size = len(rows) // 4 + 1
        written = spark.createDataFrame(rows[part * size : (part + 1) * size], schema).coalesce(1).write.mode("append")
        written.json(target, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return target


def stream(spark, folder):
    return read_frames(spark, folder, "json", streaming=True, maxFilesPerTrigger="1")


def test_stream_delivers_what_the_batch_does(spark, folder, tmp_path):
    written = {"webhook": [], "archive": []}

    def writer(sink):
        def write(rows, epoch):
            written[sink] += [(epoch, row["value"]) for row in rows.select(to_canonical_json().alias("value")).collect()]

        return write

    query = run_stream(
        stream(spark, folder),
        PATH,
        {sink: writer(sink) for sink in written},
        checkpoint=str(tmp_path / "checkpoint"),
        trigger={"availableNow": True},
        objects=lambda: objects(spark, SF_DIR),
        positions_folder=str(tmp_path / "positions"),
    )
    query.awaitTermination()
    expected = PATH.routed(frames(spark, SF_DIR), READ, objects(spark, SF_DIR))
    for sink, rows in written.items():
        batch = expected.filter(F.col("sink") == sink).select(to_canonical_json().alias("value")).collect()
        assert sorted(value for _, value in rows) == sorted(row["value"] for row in batch)
        assert len({epoch for epoch, _ in rows}) > 1
    stored = load_positions(spark, str(tmp_path / "positions"))
    reached = stored.filter("resource_version <> ''").select("watch", "resource_version")
    assert sorted(map(tuple, reached.collect())) == sorted(map(tuple, positions(frames(spark, SF_DIR)).collect()))

    # A restart from the checkpoint delivers nothing a second time.
    before = {sink: len(rows) for sink, rows in written.items()}
    again = run_stream(
        stream(spark, folder), PATH, {sink: writer(sink) for sink in written}, str(tmp_path / "checkpoint"), {"availableNow": True}
    )
    again.awaitTermination()
    assert {sink: len(rows) for sink, rows in written.items()} == before


def test_rules_swap_between_batches(spark, folder, tmp_path):
    seen, rules = [], iter([("type = 'Warning'",), ("type = 'Nothing'",), ("type = 'Warning'",), ("type = 'Nothing'",)])
    path = EventPath([Watch(f"team-{i}") for i in range(5)], [Flow("a", ("x",), ("true",))], ["x"])
    query = run_stream(
        stream(spark, folder),
        path,
        {"x": lambda rows, epoch: seen.append((epoch, rows.count(), rows.filter("type = 'Warning'").count()))},
        str(tmp_path / "checkpoint"),
        {"availableNow": True},
        flows=lambda: [Flow("a", ("ignored",), next(rules))],
    )
    query.awaitTermination()
    assert len(seen) == 4
    assert [count > 0 for _, count, _ in seen] == [True, False, True, False]
    assert all(count == warnings for _, count, warnings in seen)
    assert load_refused(spark, str(tmp_path / "checkpoint")).count() == 0


def test_refused_rules_are_told(spark, folder, tmp_path):
    """The second and the fourth set are refused; the rules before them stay."""
    seen, checkpoint = [], str(tmp_path / "checkpoint")
    rules = iter([("type = 'Warning'",), ("unknown = 'x'",), ("type = 'Nothing'",), ("type",)])
    path = EventPath([Watch(f"team-{i}") for i in range(5)], [Flow("a", ("x",), ("true",))], ["x"])
    query = run_stream(
        stream(spark, folder), path, {"x": lambda rows, epoch: seen.append(rows.count())}, checkpoint, {"availableNow": True}, flows=lambda: [Flow("a", ("x",), next(rules))]
    )
    query.awaitTermination()
    assert [count > 0 for count in seen] == [True, True, False, False]
    told = sorted(tuple(row) for row in load_refused(spark, checkpoint).collect())
    assert told == [(1, "a", ["unknown = 'x'"], True), (3, "a", ["type"], True)]


def test_positions_are_written_only_when_they_move(spark, tmp_path):
    rows = frames(spark, SF_DIR)
    folder = str(tmp_path / "positions")
    assert save_positions(spark, rows.limit(0), folder, 0) is False
    assert save_positions(spark, rows, folder, 1) is True
    assert save_positions(spark, rows, folder, 2) is False
    assert load_positions(spark, folder).count() == 5
    # The same epoch run again gives the same state.
    assert save_positions(spark, rows, folder, 1) is True


def test_positions_stay_during_a_replay(spark, tmp_path):
    folder = str(tmp_path / "positions")

    def state(epoch, *rows):
        save_positions(spark, spark.createDataFrame(list(rows), FRAME), folder, epoch)
        return {row["watch"]: (row["resource_version"], row["replaying"]) for row in load_positions(spark, folder).collect()}

    assert state(0, frame("w", 1, "ADDED", "90"), frame("w", 2, "BOOKMARK", "100", ends=True)) == {"w": ("100", False)}
    # The watch fails and is listed anew; its replay goes on over two epochs.
    assert state(1, frame("w", 3, "ADDED", "101"), frame("w", 4, "ERROR", ""), frame("w", 5, "ADDED", "150")) == {"w": ("101", True)}
    assert state(2, frame("w", 6, "ADDED", "90"), frame("v", 7, "BOOKMARK", "", ends=True)) == {"w": ("101", True), "v": ("", False)}
    # The other watch is live without ever having had a position.
    assert state(3, frame("w", 8, "BOOKMARK", "160", ends=True), frame("v", 9, "ADDED", "5")) == {"w": ("160", False), "v": ("5", False)}
    assert len(list((tmp_path / "positions").glob("epoch=*"))) == 2


def test_a_replay_delivers_only_what_is_new(spark, tmp_path):
    path = EventPath([Watch("w")], [Flow("a", ("x",))], ["x"])
    source, seen = tmp_path / "frames", []
    epochs = [
        [frame("w", 1, "ADDED", "90"), frame("w", 2, "BOOKMARK", "100", ends=True), frame("w", 3, "ADDED", "101")],
        [frame("w", 4, "ERROR", ""), frame("w", 5, "ADDED", "90"), frame("w", 6, "ADDED", "101")],
        [frame("w", 7, "ADDED", "102"), frame("w", 8, "BOOKMARK", "110", ends=True)],
        [frame("w", 9, "MODIFIED", "95")],
    ]
    for rows in epochs:
        spark.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(str(source))
        run_stream(
            spark.readStream.schema(FRAME).parquet(str(source)),
            path,
            {"x": lambda rows, epoch: seen.append([r["resourceVersion"] for r in rows.orderBy("seq").collect()])},
            str(tmp_path / "checkpoint"),
            {"availableNow": True},
            positions_folder=str(tmp_path / "positions"),
        ).awaitTermination()
    assert seen == [["90", "101"], [], ["102"], ["95"]]


def test_objects_given_twice_match_once(spark):
    rows, known = frames(spark, SF_DIR), objects(spark, SF_DIR)
    once, twice = (PATH.events(rows, READ, given) for given in (known, known.union(known)))
    assert twice.count() == once.count() == PATH.events(rows, READ).count()
    assert twice.filter("regardingObject is not null").count() == once.filter("regardingObject is not null").count() > 0


def test_sinks_need_writers(spark, folder, tmp_path):
    with pytest.raises(ValueError):
        run_stream(stream(spark, folder), PATH, {}, str(tmp_path / "checkpoint"))


METRICS = [Metric("n", labels={"ns": "namespace"}), Metric("r", labels={"reason": "reason", "k": "labels.k"})]


def test_running_counts(spark, folder):
    events = PATH.events(stream(spark, folder), READ)
    query = running_counts(events, METRICS).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    expected = series(PATH.events(frames(spark, SF_DIR), READ), METRICS)
    key = ["metric_index", "label_values", "value"]
    assert sorted(map(tuple, spark.table("counts").select(key).collect())) == sorted(map(tuple, expected.select(key).collect()))


@pytest.mark.parametrize("limit", [0, 7])
def test_limited_counts_add_up_over_batches(spark, folder, tmp_path, limit):
    totals = []

    def count(batch, epoch):
        found = count_limited(spark, PATH.events(batch, READ), epoch, str(tmp_path / "totals"), METRICS, limit)
        first = found.count()
        again = count_limited(spark, PATH.events(batch, READ), epoch, str(tmp_path / "totals"), METRICS, limit)
        totals[:] = sorted((r["metric_index"], tuple(r["label_values"]), r["value"]) for r in again.collect())
        assert again.count() == first

    query = stream(spark, folder).writeStream.foreachBatch(count).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    whole = series(PATH.events(frames(spark, SF_DIR), READ), METRICS, "seq")
    whole = whole.orderBy("first_seq", "metric_index").limit(limit) if limit else whole
    assert totals == sorted((r["metric_index"], tuple(r["label_values"]), r["value"]) for r in whole.collect())


def test_interval_stream_equals_the_batch(spark, tmp_path):
    source = str(tmp_path / "records")
    start = utc(2024, 1, 1)
    # Gate g2 stays silent for whole batches, g0 and g1 carry intervals over.
    rows = [("g" + str(i % 2 if i % 40 else 2), i, start + dt.timedelta(minutes=7 * i), "ab"[i % 6 == 0]) for i in range(160)]
    schema = "gate string, seq long, ts timestamp, key string"
    for part in range(4):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(source)
    records = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    columns = ["gate", "seq", "key", "suppressed"]
    hour = dt.timedelta(hours=1)
    found = {}

    def write(admitted, epoch):
        found[epoch] = [tuple(row) for row in admitted.select(columns).collect()]

    per_interval_stream(records, hour, 2, write, str(tmp_path / "gates"), str(tmp_path / "c"), {"availableNow": True}).awaitTermination()
    batch = sampling.with_suppressed(sampling.per_interval(spark.read.parquet(source), hour, 2))
    assert len(found) == 4
    assert sorted(row for rows in found.values() for row in rows) == sorted(map(tuple, batch.select(columns).collect()))


def test_json_lines_round_trip(spark, tmp_path):
    events = PATH.events(frames(spark, SF_DIR), READ, objects(spark, SF_DIR))
    target = str(tmp_path / "out")
    events.select(to_canonical_json().alias("value")).write.text(target)
    lines = [json.loads(row["value"]) for row in spark.read.text(target).collect()]
    assert len(lines) == events.count() and all(line["regarding"]["apiVersion"] for line in lines)


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or spark.sparkContext.getCheckpointDir())


def test_default_checkpoint_is_in_the_shared_folder(spark, folder):
    sink = "s" + uuid.uuid4().hex
    path = EventPath([Watch(f"team-{i}") for i in range(5)], [Flow("a", (sink,))], [sink])
    runs = []
    for _ in range(2):
        run_stream(stream(spark, folder), path, {sink: lambda rows, epoch: runs.append(epoch)}, trigger={"availableNow": True}).awaitTermination()
    assert runs == [0, 1, 2, 3]


def test_field_reads_the_same_on_a_stream(spark, folder):
    events = PATH.events(stream(spark, folder), READ)
    assert events.isStreaming and events.select(field("regarding.kind")).isStreaming
