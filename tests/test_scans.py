"""Batch packing and failure sampling against plain sequential models."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import utc
from pyspark.sql import functions as F

from eventloom.operators import batching, chains, sampling
from eventloom.operators.batching import BatchLimits, pack_batches
from eventloom.operators.segments import SEGMENT, in_range, with_position, with_segment

EPOCH = utc(2024, 1, 1)


def model_batches(frames, limits):
    """Pack (size, arrival) frames one by one."""
    numbers, batch, events, payload, opened = [], -1, 0, 0, 0
    for size, arrival in frames:
        fits = events > 0
        if fits and limits.max_events and events >= limits.max_events:
            fits = False
        if fits and limits.max_bytes and payload + limits.separator_bytes + size > limits.max_bytes - limits.fixed_bytes:
            fits = False
        if fits and limits.timeout is not None and arrival > opened + limits.timeout // dt.timedelta(microseconds=1):
            fits = False
        if fits:
            events, payload = events + 1, payload + limits.separator_bytes + size
        else:
            batch, events, payload, opened = batch + 1, 1, size, arrival
        numbers.append(batch)
    return numbers


def table(spark, groups, partitions=3):
    rows = [(g, i, size, at) for g, frames in groups.items() for i, (size, at) in enumerate(frames)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "sink string, seq long, size long, arrival_us long").repartition(partitions)


def packed(frames, limits, span):
    rows = pack_batches(frames, ["sink"], limits, span=span).collect()
    found = {}
    for row in sorted(rows, key=lambda r: r["seq"]):
        found.setdefault(row["sink"], []).append(row["batch_no"])
    return found


@pytest.mark.parametrize(
    "sizes, limits, expected",
    [
        ([10, 10, 10], {"max_events": 2, "max_bytes": 0}, [0, 0, 1]),
        ([10] * 4, {"max_events": 0, "max_bytes": 50, "separator_bytes": 1, "fixed_bytes": 20}, [0, 0, 1, 1]),
        ([500, 10], {"max_events": 0, "max_bytes": 100}, [0, 1]),
        ([500, 500], {"max_events": 0, "max_bytes": 100}, [0, 1]),
        ([40, 60, 1], {"max_events": 0, "max_bytes": 100}, [0, 0, 1]),
    ],
)
@pytest.mark.parametrize("span", [1, 2, 1000])
def test_known_batches(spark, sizes, limits, expected, span):
    frames = table(spark, {"s": [(size, 0) for size in sizes]})
    assert packed(frames, BatchLimits(**limits), span) == {"s": expected}


@pytest.mark.parametrize(
    "limits",
    [
        BatchLimits(max_events=7, max_bytes=0),
        BatchLimits(max_events=0, max_bytes=100, separator_bytes=1, fixed_bytes=2),
        BatchLimits(max_events=5, max_bytes=90),
        BatchLimits(max_events=50, max_bytes=300, timeout=dt.timedelta(microseconds=40), separator_bytes=3),
        BatchLimits(max_events=4, max_bytes=0, timeout=dt.timedelta(0)),
    ],
)
@pytest.mark.parametrize("span, partitions", [(3, 1), (64, 3)])
def test_batches_equal_a_sequential_packer(spark, limits, span, partitions):
    choose = random.Random(span)
    groups = {}
    for name, count in (("hot", 200), ("b", 37), ("c", 1)):
        at, frames = 0, []
        for _ in range(count):
            at += choose.choice([0, 1, 5, 30])
            frames.append((choose.choice([1, 5, 20, 60, 120]), at))
        groups[name] = frames
    got = packed(table(spark, groups, partitions), limits, span)
    assert got == {name: model_batches(frames, limits) for name, frames in groups.items()}


@pytest.fixture
def many_ranges(spark):
    """Leave the ranges of a sort as they are, so that a group spans several and their summaries are walked."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("span", [2, 9])
@pytest.mark.parametrize(
    "limits",
    [
        BatchLimits(max_events=5, max_bytes=90),
        BatchLimits(max_events=0, max_bytes=2000, separator_bytes=1, fixed_bytes=2),  # a batch goes on over segments and ranges
        BatchLimits(max_events=300, max_bytes=0, timeout=dt.timedelta(microseconds=150)),
        BatchLimits(max_events=1000, max_bytes=100_000),  # one batch
    ],
)
def test_batches_over_ranges(spark, many_ranges, limits, span):
    choose = random.Random(span)
    groups = {}
    for name, count in (("hot", 300), ("b", 40)):
        at, frames = 0, []
        for _ in range(count):
            at += choose.choice([0, 1, 5, 30])
            frames.append((choose.choice([1, 5, 20, 60, 120]), at))
        groups[name] = frames
    frames = table(spark, groups)
    assert with_segment(frames, ["sink"], span).select((in_range()).alias("r")).distinct().count() > 1
    assert packed(frames, limits, span) == {name: model_batches(frames, limits) for name, frames in groups.items()}


def test_batches_keep_columns_and_take_gaps_in_seq(spark):
    rows = [("s", 5 * i * i, 10, 0, f"payload-{i}") for i in range(20)]
    frames = spark.createDataFrame(rows, "sink string, seq long, size long, arrival_us long, frame string")
    got = pack_batches(frames, ["sink"], BatchLimits(max_events=3, max_bytes=1000), span=50)
    found = sorted((r["seq"], r["frame"], r["batch_no"]) for r in got.collect())
    assert found == [(5 * i * i, f"payload-{i}", i // 3) for i in range(20)]
    ids = got.select(batching.batch_id(["sink"]).alias("id"), "batch_no").distinct().collect()
    assert len(ids) == len({r["id"] for r in ids}) == 7


def test_limits_are_checked():
    for refused in ({"max_events": 0, "max_bytes": 0}, {"max_events": -1}):
        with pytest.raises(ValueError):
            BatchLimits(**refused)
    framed = BatchLimits.for_format("template", separator="; ", max_events=1)
    assert (framed.separator_bytes, framed.fixed_bytes) == (2, 0)


def test_frame_sizes_and_fates(spark):
    rows = spark.createDataFrame([("é", "k"), ("", None)], "frame string, key string")
    frame = F.col("frame")
    got = rows.select(
        *[batching.frame_bytes(frame, fmt).alias(fmt) for fmt in ("ndjson", "jsonl", "gelf")],
        batching.frame_bytes(frame, "kafka", F.col("key")).alias("kafka"),
        batching.frame_fate(F.octet_length(frame), 1).alias("fate"),
    )
    assert [tuple(row) for row in got.collect()] == [(2, 3, 3, 11, "too_large"), (0, 1, 1, 8, "rejected")]
    kept, dropped = batching.split_too_large(rows.withColumn("n", F.octet_length("frame")), "n", 1)
    assert kept.count() == 0 and {r["reason"] for r in dropped.collect()} == {"too_large", "rejected"}


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_positions(spark, span):
    rows = spark.createDataFrame([(g, s) for g in "ab" for s in range(0, 60, 3)], "g string, seq long").repartition(4)
    got = sorted((r["g"], r["seq"], r["n"]) for r in with_position(rows, ["g"], "n", span).collect())
    assert got == [(g, s, s // 3) for g in "ab" for s in range(0, 60, 3)]


# --- sampling ----------------------------------------------------------------

HOUR = dt.timedelta(hours=1)
MILLI = dt.timedelta(milliseconds=1)


def records(spark, keys, times=None, gate="g"):
    times = times or [0] * len(keys)
    rows = [(gate, i, EPOCH + dt.timedelta(microseconds=t), key) for i, (key, t) in enumerate(zip(keys, times))]
    return spark.createDataFrame(rows, "gate string, seq long, ts timestamp, key string").repartition(2)


def flags(rows, gate="g"):
    found = [r for r in rows.collect() if r["gate"] == gate]
    return "".join("T" if r["admitted"] else "F" for r in sorted(found, key=lambda r: r["seq"]))


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_known_samples(spark, span):
    assert flags(sampling.per_interval(records(spark, "aaaabbba"), HOUR, 2, span)) == "TTFFTTFT"
    assert flags(sampling.per_interval(records(spark, "aaaa", [0, 10, 2000, 2010]), MILLI, 1, span)) == "TFTF"
    assert flags(sampling.per_interval(records(spark, "aaa", [0, 10**9, 10**12]), dt.timedelta(0), 1, span)) == "TFF"
    assert flags(sampling.on_change(records(spark, "aaabbaa"), span)) == "TFFTFTF"
    for keep in (False, True):
        changes = sampling.on_change(records(spark, "aaaab"), span, keep_segment=keep)
        suppressed = sampling.with_suppressed(changes, span)
        assert sorted((r["key"], r["suppressed"]) for r in suppressed.collect()) == [("a", 0), ("b", 3)]
        assert "_segment" not in suppressed.columns


def test_first_seen(spark):
    assert flags(sampling.first_seen(records(spark, "aabbcca"), 2)) == "TFTFFFF"
    assert flags(sampling.first_seen(records(spark, "aa"), 0)) == "FF"


def model_interval(rows, width, threshold):
    admitted, key, since, count = [], None, 0, 0
    for row_key, at in rows:
        if row_key != key or (width > 0 and at - since >= width):
            key, since, count = row_key, at, 1
            admitted.append(True)
        elif count < threshold:
            count += 1
            admitted.append(True)
        else:
            admitted.append(False)
    return admitted


def model_suppressed(admitted):
    found, withheld = [], 0
    for flag in admitted:
        if flag:
            found.append(withheld)
            withheld = 0
        else:
            withheld += 1
    return found


@pytest.mark.parametrize("width, threshold", [(50, 3), (200, 1), (0, 2), (7, 100)])
@pytest.mark.parametrize("span", [5, 50])
def test_samples_equal_a_sequential_gate(spark, width, threshold, span):
    check_samples(spark, width, threshold, span)


@pytest.mark.parametrize("width, threshold", [(50, 3), (3000, 2), (0, 2)])
@pytest.mark.parametrize("step", [1, 1_000_000])
def test_samples_over_ranges(spark, many_ranges, width, threshold, step):
    check_samples(spark, width, threshold, 4, step)


def check_samples(spark, width, threshold, span, step=1):
    choose = random.Random(width * 31 + span)
    rows, model = [], {}
    for gate, count, letters in (("hot", 200, "aaaaaaaaab"), ("one", 150, "a"), ("mixed", 80, "abc"), ("z", 1, "a")):
        at, made = 0, []
        for seq in range(count):
            at += choose.choice([0, 0, 1, 3, 20, 60])
            made.append((choose.choice(letters), at))
            rows.append((gate, (seq - 50) * step, EPOCH + dt.timedelta(microseconds=at), made[-1][0]))
        model[gate] = model_interval(made, width, threshold)
    choose.shuffle(rows)
    table = spark.createDataFrame(rows, "gate string, seq long, ts timestamp, key string").repartition(3)
    thinned = sampling.per_interval(table, dt.timedelta(microseconds=width), threshold, span)
    for gate, admitted in model.items():
        assert flags(thinned, gate) == "".join("T" if flag else "F" for flag in admitted)
    counted = sampling.with_suppressed(thinned, span).collect()
    for gate, admitted in model.items():
        found = [r["suppressed"] for r in sorted(counted, key=lambda r: r["seq"]) if r["gate"] == gate]
        assert found == model_suppressed(admitted)
    changed = sampling.on_change(table, span)
    for gate in model:
        keys = [row[3] for row in sorted(rows, key=lambda row: row[1]) if row[0] == gate]
        assert flags(changed, gate) == "".join("T" if k == 0 or key != keys[k - 1] else "F" for k, key in enumerate(keys))


def test_long_segments_come_in_pieces():
    """Python holds at most PIECE rows of a segment, and all of its rows come in order."""
    rows = 3 * chains.PIECE + 7
    seq = np.arange(rows + 5)
    whole = pa.table(
        {
            "gate": pa.array(["a"] * rows + ["b"] * 5),
            chains.RANGE: pa.array(np.zeros(rows + 5, np.int64)),
            SEGMENT: pa.array(np.r_[np.zeros(rows, np.int64), np.ones(5, np.int64)]),
            "seq": pa.array(seq),
        }
    )
    pieces = list(chains._pieces(iter(whole.to_batches(max_chunksize=9_999)), ["gate"]))
    assert [piece.num_rows for _, _, piece in pieces] == [chains.PIECE] * 3 + [7, 5]
    assert [key for key, _, _ in pieces] == [("a",)] * 4 + [("b",)]
    assert np.array_equal(np.concatenate([piece["seq"].to_numpy() for _, _, piece in pieces]), seq)


def test_scans_in_pieces_equal_sequential_ones(spark):
    """Intervals and batches that go on over the pieces of long segments, of which a task has several."""
    count = 260_000
    assert count // 4 > chains.PIECE
    rows = spark.range(count).selectExpr(
        "'g' AS gate", "'s' AS sink", "id AS seq", "timestamp_millis(id) AS ts", "if(id % 70001 = 0, 'b', 'a') AS key",
        "1 + id % 7 AS size", "id AS arrival_us",
    )
    keys = [("b" if i % 70001 == 0 else "a", i * 1000) for i in range(count)]
    for width, threshold in ((30_000_000, 2), (0, 3)):
        thinned = sampling.per_interval(rows.select("gate", "seq", "ts", "key"), dt.timedelta(microseconds=width), threshold)
        admitted = [r["seq"] for r in thinned.where("admitted").orderBy("seq").collect()]
        assert admitted == [i for i, taken in enumerate(model_interval(keys, width, threshold)) if taken]
        assert thinned.count() == count
    frames = [(1 + i % 7, i) for i in range(count)]
    for limits in (BatchLimits(max_events=0, max_bytes=300_000), BatchLimits(max_events=0, max_bytes=10**9, timeout=dt.timedelta(microseconds=61_000))):
        numbers = pack_batches(rows.select("sink", "seq", "size", "arrival_us"), ["sink"], limits).groupBy("batch_no")
        got = {r["batch_no"]: (r["low"], r["high"], r["n"]) for r in numbers.agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n")).collect()}
        want = {}
        for i, number in enumerate(model_batches(frames, limits)):
            low, _, n = want.get(number, (i, i, 0))
            want[number] = (low, i, n + 1)
        assert got == want and len(want) > 2
