"""Writers and the composed export."""

import base64
import glob
import json

import pandas as pd
import pytest
from conftest import event, utc
from pyspark.sql import Observation
from pyspark.sql import functions as F

from eventloom.operators import observe
from eventloom.operators.batching import BatchLimits
from eventloom.operators.encode import gelf, template, to_canonical_json
from eventloom.operators.metrics import Metric, drop_counts
from eventloom.operators.routing import match, route, route_lines, route_write
from eventloom.plans.export import export_drops, export_requests
from eventloom.plans.spec import Flow
from eventloom.sinks import writers
from eventloom.streaming.run import load_totals


def rows(events, count=7):
    made = [event(uid=str(i), note="n" * i, type=["Normal", "Warning"][i % 2], eventTime=utc(2024, 1, 1, 0, i)) | {"seq": i, "watch": "w"} for i in range(count)]
    return events(*made, seq="long", watch="string")


def test_export_packs_composes_and_signs(events):
    limits = BatchLimits.for_format("json-list", max_events=3, max_bytes=10_000)
    secret = "whsec_" + base64.b64encode(b"k" * 32).decode()
    requests = export_requests(
        rows(events), to_canonical_json(), "json-list", ["watch"], limits, secret=secret, sent_at=F.lit(1717200000), epoch="4"
    ).collect()
    bodies = sorted(([e["uid"] for e in json.loads(r["body"])] for r in requests))
    assert bodies == [["0", "1", "2"], ["3", "4", "5"], ["6"]]
    assert all(r["webhook_signature"].startswith("v1,") and r["webhook_id"] == "msg_" + r["batch_id"] for r in requests)


def test_export_leaves_out_what_no_queue_takes(events):
    limits = BatchLimits.for_format("template", max_events=10, max_bytes=0)
    requests = export_requests(rows(events), template("{{ note }}"), "template", ["watch"], limits, queue_bytes=4).collect()
    assert [r["body"] for r in requests] == ["n\nnn\nnnn\nnnnn"]


def test_writers_replace_their_epoch(spark, events, tmp_path):
    folder = str(tmp_path)
    routed = route(match(rows(events), [Flow("all", ("lines", "docs", "requests", "counts"))]))
    limits = BatchLimits.for_format("ndjson", max_events=4, max_bytes=0)
    sinks = {
        "lines": writers.lines_writer(f"{folder}/lines"),
        "docs": writers.documents_writer(f"{folder}/docs", lambda: gelf("h"), terminator="\0"),
        "requests": writers.requests_writer(f"{folder}/requests", to_canonical_json, "ndjson", ["watch"], limits),
        "counts": writers.counters_writer(f"{folder}/counts", [Metric("n", labels={"t": "type"})]),
    }
    for _ in range(2):
        route_write(routed, {sink: (lambda found, write=write: write(found, 1)) for sink, write in sinks.items()})
    lines = spark.read.text(f"{folder}/lines/epoch=1").collect()
    assert sorted(json.loads(row["value"])["uid"] for row in lines) == [str(i) for i in range(7)]
    documents = "".join(open(path).read() for path in glob.glob(f"{folder}/docs/epoch=1/part-*"))
    assert documents.count("\0") == 7 and json.loads(documents.split("\0")[0])["version"] == "1.1"
    requests = spark.read.parquet(f"{folder}/requests/epoch=1")
    assert sorted(row["frames"] for row in requests.collect()) == [3, 4]
    totals = load_totals(spark, f"{folder}/counts")
    assert {row["label_values"][0]: row["value"] for row in totals.collect()} == {"Normal": 4, "Warning": 3}


def test_the_console_gets_every_event(events, capsys):
    writers.console_writer()(events(*[event(uid=str(i)) for i in range(1000)]), 1)
    printed = capsys.readouterr().out.splitlines()
    assert sorted(json.loads(line)["uid"] for line in printed if line.startswith("{")) == sorted(map(str, range(1000)))


def test_frames_that_no_queue_takes_are_counted(events):
    table = events(event(uid="a", note="x" * 200), event(uid="b", note="short"), event(uid="c", note=""))
    drops = drop_counts(export_drops(table, F.col("note"), "webhook", "hook", queue_bytes=100))
    assert {(r["stage"], r["reason"], r["sink"]): r["events"] for r in drops.collect()} == {
        ("queue", "too_large", "hook"): 1, ("sink", "rejected", "hook"): 1,
    }


def counting(spark, rows):
    """Rows that count, in an accumulator, how often each is computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def note(values: pd.Series) -> pd.Series:
        seen.add(len(values))
        return values

    return rows.withColumn("note", note("note")), seen


def test_the_plan_above_the_sinks_runs_once(spark, events, tmp_path):
    folder = str(tmp_path)
    flows = [Flow("all", ("a", "b", "c")), Flow("warn", ("a", "d"), ("type = 'Warning'",))]
    counted, seen = counting(spark, rows(events))
    got = {}
    writers_of = {sink: (lambda found, sink=sink: got.update({sink: sorted(row.uid for row in found.collect())})) for sink in "abcd"}
    route_write(route(match(counted, flows)), writers_of)
    assert seen.value == 7
    assert got == {"a": list("0123456"), "b": list("0123456"), "c": list("0123456"), "d": list("135")}
    counted, seen = counting(spark, rows(events))
    route_lines(match(counted, flows), {sink: F.concat(F.lit(sink), F.col("note")) for sink in "abcd"}, f"{folder}/lines")
    assert seen.value == 7
    lines = spark.read.schema("value string, sink string").text(f"{folder}/lines").collect()
    assert sorted((row.sink, row.value) for row in lines) == sorted(
        [(sink, sink + "n" * n) for sink in "abc" for n in range(7)] + [("d", "d" + "n" * n) for n in (1, 3, 5)]
    )


def test_a_failed_task_leaves_no_visible_lines(spark, events, tmp_path):
    folder = str(tmp_path)
    matched = match(rows(events).repartition(4), [Flow("all", ("a", "b"))])
    broken = F.when(F.col("uid") == "5", F.raise_error(F.lit("broken"))).otherwise(F.col("uid"))
    with pytest.raises(Exception, match="broken"):
        route_lines(matched, {"a": F.col("uid"), "b": broken}, f"{folder}/lines")
    assert not glob.glob(f"{folder}/lines/**/part-*", recursive=True) or not glob.glob(f"{folder}/lines/sink=*")
    route_lines(matched, {"a": F.col("uid"), "b": F.col("uid")}, f"{folder}/lines")
    assert spark.read.text(f"{folder}/lines").count() == 14


def test_counts_beside_the_pass(spark, events):
    flows = [Flow("b", ("x",), ("int(note) > 0",)), Flow("a", ("x",), ("type = 'Warning'",))]
    observation = Observation("verdicts")
    matched = observe.observe_verdicts(match(rows(events), flows), flows, observation)
    matched.write.format("noop").mode("overwrite").save()
    got = {tuple(row) for row in observe.counted(spark, observation.get).collect()}
    assert got == {("matched", "a", 3), ("eval_error", "b", 7)}
    read = Observation("read")
    observe.observe_read(rows(events).withColumn("watch", F.when(F.col("seq") < 5, "w")), ["w", "none"], read).write.format("noop").mode("overwrite").save()
    assert read.get == {"read:w": 5, "read:none": 0, "read:*": 2}
    kept = Observation("kept")
    observe.observe_kept(rows(events).withColumn("kept", F.col("seq") > 1), kept).write.format("noop").mode("overwrite").save()
    assert kept.get == {"kept": 5, "dropped": 2}


def test_counts_of_a_stream(spark, events, tmp_path):
    folder = str(tmp_path)
    for part in range(2):
        rows(events).write.mode("append").parquet(f"{folder}/in")
    flows = [Flow("a", ("x",), ("type = 'Warning'",))]
    arriving = spark.readStream.schema(rows(events).schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in")
    matched = observe.observe_verdicts(match(arriving, flows), flows, "verdicts")
    stream = matched.writeStream.format("noop").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert observe.progress_counts(stream.recentProgress, "verdicts") == {"matched:a": 6, "eval_error:a": 0}
