"""Batches that stay open between micro-batches."""

import datetime as dt
import random
import time

import pytest
from test_scans import model_batches

from eventloom.operators.batching import BatchLimits
from eventloom.streaming.batches import STATE_STORE, stream_batches

SCHEMA = "sink string, shard int, seq long, size long, frame string"


@pytest.fixture
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, folder, limits, until):
    """Run the stream until the closed batches hold so many frames, and stop it."""
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    closed = stream_batches(arriving, ["sink", "shard"], limits)
    stream = closed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c")
    stream = stream.trigger(processingTime="100 milliseconds").start()
    try:
        deadline = time.time() + 90
        while time.time() < deadline:
            assert stream.isActive, stream.exception()
            if stream.lastProgress and sum(len(row.frames) for row in spark.read.schema(closed.schema).parquet(f"{folder}/out").collect()) >= until:
                break
            time.sleep(0.3)
    finally:
        stream.stop()
    return spark.read.schema(closed.schema).parquet(f"{folder}/out").collect()


def test_batches_go_on_over_micro_batches_and_a_restart(spark, state_store, tmp_path):
    r = random.Random(8)
    rows = [(r.choice(["hot", "hot", "b"]), 1, seq, r.choice([1, 20, 60]), f"f{seq}") for seq in range(120)]
    folder = str(tmp_path)

    def put(some):
        r.shuffle(some)
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    limits = BatchLimits(max_events=5, max_bytes=130, separator_bytes=1, timeout=dt.timedelta(seconds=40))
    put(rows[:30])
    put(rows[30:50])
    first = run(spark, folder, limits, 40)
    assert first and {row.reason for row in first} == {"full"}
    put(rows[50:])
    got = run(spark, folder, limits, 120)  # the open ones close when they time out
    for sink in ("hot", "b"):
        frames = [(size, 0) for name, _, _, size, _ in sorted(rows, key=lambda row: row[2]) if name == sink]
        numbers = model_batches(frames, BatchLimits(max_events=5, max_bytes=130, separator_bytes=1))
        found = sorted((row.batch_no, row.frames, row.reason) for row in got if row.sink == sink)
        assert [n for n, held, _ in found for _ in held] == numbers
        assert [f.seq for _, held, _ in found for f in held] == [row[2] for row in sorted(rows, key=lambda row: row[2]) if row[0] == sink]
        assert [reason for *_, reason in found] == ["full"] * numbers[-1] + ["timeout"]


def test_a_waiting_batch_times_out(spark, state_store, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([("s", None, 1, 5, "a"), ("s", None, 2, 5, "é")], SCHEMA).coalesce(1).write.parquet(f"{folder}/in")
    got = run(spark, folder, BatchLimits(timeout=dt.timedelta(seconds=1)), 2)
    assert [(row.sink, row.shard, row.batch_no, row.reason, [f.frame for f in row.frames]) for row in got] == [("s", None, 0, "timeout", ["a", "é"])]


def test_the_state_store_is_checked(spark):
    arriving = spark.readStream.format("rate").load().selectExpr("'s' AS sink", "value AS seq", "value AS size", "'' AS frame")
    with pytest.raises(ValueError, match="providerClass"):
        stream_batches(arriving, ["sink"])
