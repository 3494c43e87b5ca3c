"""Running counters in keyed state, against counting everything at once."""

import glob
import random
from collections import Counter

import pyarrow as pa
import pytest
from conftest import event

from eventloom.catalogue.streams import _in_quarters
from eventloom.operators.metrics import Metric, MetricError
from eventloom.streaming import counters
from eventloom.streaming.batches import STATE_STORE
from eventloom.streaming.counters import last_totals, running_totals

METRICS = [Metric("by_type", labels={"type": "type"}), Metric("by_reason", labels={"reason": "reason", "ns": "namespace"}), Metric("all")]


@pytest.fixture
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def model(rows, limit):
    totals, refused = {}, Counter()
    for row in sorted(rows, key=lambda row: row["seq"]):
        for index, values in enumerate(((row["type"],), (row["namespace"], row["reason"]), ())):
            if (index, values) not in totals and limit and len(totals) >= limit:
                refused[index] += 1
                continue
            totals[index, values] = totals.get((index, values), 0) + 1
    return totals, dict(refused)


@pytest.mark.parametrize("limit", [0, 1, 9, 1000])
def test_totals_over_micro_batches_and_a_restart(spark, events, state_store, tmp_path, limit):
    r = random.Random(limit)
    rows = [event(type=r.choice(["Normal", "Warning"]), reason=f"r{r.randrange(9)}", namespace=r.choice("ab")) | {"seq": k} for k in range(300)]
    folder, written = str(tmp_path), []

    def run():
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        totals = running_totals(arriving, METRICS, limit)

        def write(batch, epoch):
            batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")
            written.append(batch.count())

        stream = totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/c")
        stream.trigger(availableNow=True).start().awaitTermination()

    schema = events(rows[0], seq="long").schema
    for part in (rows[:90], rows[90:120], rows[120:290], rows[290:]):
        events(*part, seq="long").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if part[0]["seq"] in (90, 290):
            run()
    got = last_totals(spark.read.parquet(f"{folder}/out")).collect()
    totals, refused = model(rows, limit)
    assert {(row.metric_index, tuple(row.label_values)): row.value for row in got if not row.refused} == totals
    assert {row.metric_index: row.value for row in got if row.refused} == refused
    assert written[-1] <= 10 * 3 + 3  # ten events move no more than their own series


def test_what_is_needed_is_checked(spark):
    arriving = spark.readStream.format("rate").load().selectExpr("value AS seq", "'' AS type")
    with pytest.raises(ValueError, match="providerClass"):
        running_totals(arriving, [Metric("n", labels={"t": "type"})])
    with pytest.raises(MetricError):
        running_totals(arriving, [])


def test_a_task_adds_up_more_rows_than_it_holds(monkeypatch):
    monkeypatch.setattr(counters, "HELD", 10)
    kinds = [("shard", pa.int32(), False), ("metric_index", pa.int32(), False), ("series", pa.string(), True), ("value", pa.int64(), False), ("first_seq", pa.int64(), True)]
    schema = pa.schema([pa.field(name, kind, null) for name, kind, null in kinds])
    rows = [(0, k % 2, f'["{k % 7}"]', 1, 500 - k) for k in range(100)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 9]), schema)], schema=schema) for at in range(0, 100, 9)]
    got = pa.Table.from_batches(counters._added_up(iter(batches))).to_pylist()
    many = Counter(row[1:3] for row in rows)
    first = {row[1:3]: row[4] for row in rows}  # falls with k
    assert len(got) == len(many) == 14
    assert {(r["metric_index"], r["series"]): (r["value"], r["first_seq"]) for r in got} == {key: (many[key], first[key]) for key in many}
    assert list(counters._added_up(iter([]))) == []


def test_micro_batches_are_written_and_read_by_several_tasks(spark, tmp_path):
    rows, seen, files = spark.range(0, 4000, 1, 8).withColumnRenamed("id", "seq"), [], []

    def start(arriving):
        files.append(len(glob.glob(f"{tmp_path}/in/part-*")))
        sink = arriving.writeStream.foreachBatch(lambda batch, epoch: seen.append(batch.count()))
        return sink.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()

    _in_quarters(rows, "seq", f"{tmp_path}/in", start)
    assert len(seen) == 4 and sum(seen) == 4000 and all(900 <= many <= 1100 for many in seen)
    assert all(after - before > 1 for before, after in zip([0, *files], files))
