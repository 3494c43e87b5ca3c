"""Packing frames into batches."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.chains import Scan, last_openings, openings_from, range_marks, range_states, with_marks
from eventloom.operators.segments import SEGMENT, SPAN, rejoin, whole_quotient, with_position, with_segment
from eventloom.scratch import keep

# Queue limit in bytes when none is given (fixed value).
QUEUE_BYTES = 32 * 1024 * 1024

#: Whole frames that one task sorts at most on average when they are placed by batch.
PART_FRAMES = 50_000

# Separator and wrapping bytes around the frames of a request (fixed values).
FRAMING = {
    "json-list": (1, 2),
    "cloudevents": (1, 2),
    "ndjson": (1, 1),
    "template": (1, 0),
    "jsonl": (0, 0),
    "gelf": (0, 0),
    "kafka": (0, 0),
    "otlp": (0, 0),
}


@dataclass(frozen=True)
class BatchLimits:
    """When a batch closes; a limit of zero is off, and one of the first two has to be set."""

    max_events: int = 512
    max_bytes: int = 4 * 1024 * 1024
    timeout: dt.timedelta | None = None
    separator_bytes: int = 0
    fixed_bytes: int = 0

    def __post_init__(self) -> None:
        if self.max_events < 0 or self.max_bytes < 0:
            raise ValueError("limits must not be negative")
        if not self.max_events and not self.max_bytes:
            raise ValueError("max_events and max_bytes must not both be off")

    @classmethod
    def for_format(cls, fmt: str, separator: str = "\n", **limits) -> BatchLimits:
        """Return limits with the framing of a request format."""
        separator_bytes, fixed_bytes = FRAMING[fmt]
        if fmt == "template":
            separator_bytes = len(separator.encode())
        return cls(separator_bytes=separator_bytes, fixed_bytes=fixed_bytes, **limits)


def frame_bytes(frame: Column, fmt: str = "jsonl", key: Column | None = None) -> Column:
    """Return the size a frame takes in a queue; lines and documents count their terminator."""
    size = F.octet_length(frame).cast("bigint")
    if fmt in ("jsonl", "gelf"):
        return size + 1
    if fmt == "kafka":
        return size + 8 + F.coalesce(F.octet_length(key), F.lit(0)) if key is not None else size + 8
    return size


def frame_fate(size: Column, queue_bytes: int = QUEUE_BYTES) -> Column:
    """Return ``rejected`` for an empty frame, ``too_large`` for one no queue holds, else ``queued``."""
    return (
        F.when(size == 0, F.lit("rejected")).when(size > queue_bytes, F.lit("too_large")).otherwise(F.lit("queued"))
    )


def split_too_large(frames: DataFrame, size: str, queue_bytes: int = QUEUE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Return the frames a queue takes, and the dropped ones with a ``reason``."""
    judged = frames.withColumn("reason", frame_fate(F.col(size), queue_bytes))
    return judged.filter(F.col("reason") == "queued").drop("reason"), judged.filter(F.col("reason") != "queued")


def shard(key: Column, shards: int) -> Column:
    """Return which of several independent packers a row belongs to."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def batch_id(keys: Sequence[str], epoch: str = "", batch_no: str = "batch_no") -> Column:
    """Return a batch's identifier, the same on every attempt and rerun."""
    parts = [F.col(name).cast("string") for name in keys]
    return F.sha2(F.concat_ws("\u001f", *parts, F.lit(epoch), F.col(batch_no).cast("string")), 256)


def parts_for(frames: DataFrame, part_frames: int = PART_FRAMES) -> int:
    """Return over how many partitions frames are to be placed by batch, by their number.

    Counts the rows, so hand in a table that is cheap to count, such as the one
    the frames are made of. Never fewer than Spark's shuffle partitions.
    """
    least = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-frames.count() // part_frames))


def _next_openings(sizes: np.ndarray, times: np.ndarray, limits: BatchLimits) -> tuple[np.ndarray, np.ndarray]:
    """Return, per row that opens a batch, the row that opens the next, and the running payload."""
    count = len(sizes)
    rows = np.arange(count, dtype=np.int64)
    # payload[j] - payload[i] is what rows i..j-1 take, a separator before each.
    payload = np.concatenate(([0], np.cumsum(sizes + limits.separator_bytes)))
    following = np.full(count, count, dtype=np.int64)
    if limits.max_events:
        following = np.minimum(following, rows + limits.max_events)
    if limits.max_bytes:
        room = limits.max_bytes - limits.fixed_bytes + limits.separator_bytes
        full = np.searchsorted(payload[1:], payload[:-1] + room, side="right")
        following = np.minimum(following, np.maximum(full, rows + 1))
    if limits.timeout is not None:
        late = np.searchsorted(times, times + _micros(limits.timeout), side="right")
        following = np.minimum(following, np.maximum(late, rows + 1))
    return following, payload


def _micros(duration: dt.timedelta) -> int:
    return duration // dt.timedelta(microseconds=1)


def _first_unfit(
    events: int, taken: int, opened_at: int, payload: np.ndarray, times: np.ndarray, limits: BatchLimits
) -> int:
    """Return the first row that the batch open at a segment's start does not take."""
    first = len(times)
    if limits.max_events:
        first = min(first, limits.max_events - events)
    if limits.max_bytes:
        room = limits.max_bytes - limits.fixed_bytes - taken
        first = min(first, int(np.searchsorted(payload[1 : len(times) + 1], room, side="right")))
    if limits.timeout is not None:
        first = min(first, int(np.searchsorted(times, opened_at + _micros(limits.timeout), side="right")))
    return first


def pack_batches(
    frames: DataFrame,
    keys: Sequence[str],
    limits: BatchLimits = BatchLimits(),
    size: str = "size",
    arrival: str = "arrival_us",
    seq: str = "seq",
    span: int = SPAN,
) -> DataFrame:
    """Add ``batch_no``, packing each group's frames greedily in ``seq`` order.

    ``keys`` names the packer: a sink, or a sink and :func:`shard`. The first
    frame of a batch is taken whatever its size; the next ones while they fit.
    With a timeout, a frame that arrives later than that after the batch's
    first one opens a new batch; ``arrival`` holds microseconds in ``seq`` order.
    The result is the same however the rows are partitioned.
    """
    keys = list(keys)
    if not limits.max_bytes and limits.timeout is None:
        numbered = with_position(frames, keys, "batch_no", span, seq)
        return numbered.withColumn("batch_no", whole_quotient(F.col("batch_no"), limits.max_events))

    times = F.col(arrival) if limits.timeout is not None else F.lit(0).cast("bigint")
    # Written once: sizes come from encoded frames, which nothing below encodes again.
    written = keep(frames, "frames")
    deciding = written.select(*keys, F.col(seq).alias("seq"), F.col(size).cast("bigint").alias("size"), times.alias("arrival_us"))
    narrow = with_segment(deciding, keys, span)
    scan = _scan(limits)
    marks = range_marks(narrow, range_states(narrow, keys, scan), keys, scan)
    mixed, so_far = with_marks(narrow.select(*keys, SEGMENT, "seq"), marks, keys)
    numbered = mixed.withColumn("batch_no", F.last("batch_no", ignorenulls=True).over(so_far)).filter("_row = 1")
    return rejoin(written, numbered.select(*keys, F.col("seq").alias(seq), "batch_no"), keys, seq)


def _scan(limits: BatchLimits) -> Scan:
    return Scan(
        summarise=_summarise(limits),
        compose=_compose(limits),
        advance=_advance(limits),
        mark=_mark(limits),
        start={"batches": 0, "events": 0, "taken": 0, "opened_at": 0},
        summary_schema="frames bigint, payload array<bigint>, times array<bigint>, end_events array<bigint>, "
        "end_payload array<bigint>, end_time array<bigint>, opened array<bigint>",
        state_schema="batches bigint, events bigint, taken bigint, opened_at bigint",
        mark_schema="seq bigint, batch_no bigint",
    )


def _summarise(limits: BatchLimits):
    def summarise(segment: pa.Table) -> dict:
        times = segment["arrival_us"].to_numpy()
        count = len(times)
        following, payload = _next_openings(segment["size"].to_numpy(), times, limits)
        last, opened = last_openings(following, count)
        # The batch open at the start holds a frame already and opened no later
        # than now, so it takes this many rows at most.
        reach = _first_unfit(1, 0, int(times[0]), payload, times, limits)
        entries = last[: reach + 1]
        return {
            "frames": count,
            "payload": np.append(payload[1 : reach + 2], payload[count]),
            "times": times[: reach + 1],
            "end_events": count - entries,
            "end_payload": payload[count] - payload[entries] - limits.separator_bytes,
            "end_time": times[entries],
            "opened": opened[: reach + 1],
        }

    return summarise


def _advance(limits: BatchLimits):
    def advance(state: dict, run: dict) -> dict:
        first = 0
        if state["batches"]:
            # payload[k] is what rows 0..k take; the last entry is the whole run.
            payload = np.append(0, run["payload"][:-1])
            first = _first_unfit(state["events"], state["taken"], state["opened_at"], payload, run["times"], limits)
        if first >= run["frames"]:
            return state | {"events": state["events"] + run["frames"], "taken": state["taken"] + int(run["payload"][-1])}
        return {
            "batches": state["batches"] + int(run["opened"][first]),
            "events": int(run["end_events"][first]),
            "taken": int(run["end_payload"][first]),
            "opened_at": int(run["end_time"][first]),
        }

    return advance


def _compose(limits: BatchLimits):
    def compose(first: dict, second: dict) -> dict:
        """Where a batch of the first run may go on in the second, the second's entries follow the first's."""
        events, taken, at = first["end_events"], first["end_payload"], first["end_time"]
        total, known = int(first["payload"][-1]), len(second["times"])
        # What each of the first's last batches does in the second.
        unfit = np.full(len(events), known)
        if limits.max_events:
            unfit = np.minimum(unfit, limits.max_events - events)
        if limits.max_bytes:
            room = limits.max_bytes - limits.fixed_bytes - taken
            unfit = np.minimum(unfit, np.searchsorted(second["payload"][:-1], room, side="right"))
        if limits.timeout is not None:
            unfit = np.minimum(unfit, np.searchsorted(second["times"], at + _micros(limits.timeout), side="right"))
        goes_on, entry = unfit >= second["frames"], np.minimum(unfit, known - 1)
        after = {
            "end_events": np.where(goes_on, events + second["frames"], second["end_events"][entry]),
            "end_payload": np.where(goes_on, taken + int(second["payload"][-1]), second["end_payload"][entry]),
            "end_time": np.where(goes_on, at, second["end_time"][entry]),
            "opened": first["opened"] + np.where(goes_on, 0, second["opened"][entry]),
        }
        payload, times = first["payload"][:-1], first["times"]
        if len(times) == first["frames"]:
            payload, times = np.append(payload, total + second["payload"][:-1]), np.append(times, second["times"])
            after = {name: np.append(values, second[name]) for name, values in after.items()}
        whole = {"frames": first["frames"] + second["frames"], "payload": np.append(payload, total + second["payload"][-1])}
        return whole | {"times": times} | after

    return compose


def _mark(limits: BatchLimits):
    def mark(segment: pa.Table, state: dict) -> tuple[dict, dict]:
        times = segment["arrival_us"].to_numpy()
        count = len(times)
        following, payload = _next_openings(segment["size"].to_numpy(), times, limits)
        batches, first = state["batches"], 0
        if batches:
            first = _first_unfit(state["events"], state["taken"], state["opened_at"], payload, times, limits)
        opened = openings_from(following, first)
        # The batch that is open at the start has a mark of its own, before any row.
        numbers = np.append(batches - 1, batches + np.arange(len(opened)))
        marks = {"seq": [None, *segment["seq"].to_numpy()[opened].tolist()], "batch_no": numbers}
        if not len(opened):
            return marks, state | {"events": state["events"] + count, "taken": state["taken"] + int(payload[count])}
        last = int(opened[-1])
        return marks, {
            "batches": batches + len(opened),
            "events": count - last,
            "taken": int(payload[count] - payload[last]) - limits.separator_bytes,
            "opened_at": int(times[last]),
        }

    return mark
