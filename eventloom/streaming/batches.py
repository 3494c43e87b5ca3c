"""Batches that stay open from one micro-batch to the next.

A packer takes its frames in ``seq`` order, as :func:`pack_batches` does, and
hands a batch on when the next frame does not fit, or when the batch's first
frame has waited for the timeout. The open batch, which the batch limits
bound, lives in Spark's state store under its packer, and its timeout is a
processing-time timer there. So offsets, open batches and timers are of one
checkpoint: a restart goes on with them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventloom.operators.batching import BatchLimits

#: The state store that keyed state needs; set it before the stream starts.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_FRAME = T.StructType([T.StructField("seq", T.LongType()), T.StructField("size", T.LongType()), T.StructField("frame", T.StringType())])


class Packer(StatefulProcessor):
    """Pack the frames of one key."""

    def __init__(self, keys: Sequence[str], limits: BatchLimits) -> None:
        self.keys, self.limits = list(keys), limits
        self.wait_ms = None if limits.timeout is None else limits.timeout // dt.timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The number of the open batch, its events and payload, and when it times out (0: never).
        self.open = handle.getValueState("open", "batch_no bigint, events bigint, payload bigint, due bigint")
        self.frames = handle.getListState("frames", _FRAME)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # What one micro-batch has for one packer; the trigger's intake and the shards bound it.
        arrived = pd.concat(list(rows)).sort_values("seq")
        number, events, payload, due = self.open.get() if self.open.exists() else (0, 0, 0, 0)
        held = [tuple(frame) for frame in self.frames.get()] if events else []
        closed = []
        for frame in zip(arrived["seq"].tolist(), arrived["size"].tolist(), arrived["frame"].tolist(), strict=True):
            if events and not self._fits(events, payload, frame[1]):
                closed.append(self._batch(key, number, held, "full"))
                self._cancel(due)
                number, events, payload, held, due = number + 1, 0, 0, [], 0
            payload += frame[1] + (self.limits.separator_bytes if events else 0)
            events += 1
            held.append(frame)
            if events == 1 and self.wait_ms is not None:
                due = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
        if due and due not in self._timers():
            self.handle.registerTimer(due)
        self.open.update((number, events, payload, due))
        self.frames.put(held)
        yield self._rows(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, events, _, due = self.open.get()
        if events and due == expiredTimerInfo.getExpiryTimeInMs():
            closed = [self._batch(key, number, [tuple(frame) for frame in self.frames.get()], "timeout")]
            self.open.update((number + 1, 0, 0, 0))
            self.frames.clear()
            yield self._rows(closed)
        else:
            yield self._rows([])

    def _fits(self, events: int, payload: int, size: int) -> bool:
        limits = self.limits
        if limits.max_events and events >= limits.max_events:
            return False
        return not limits.max_bytes or payload + limits.separator_bytes + size <= limits.max_bytes - limits.fixed_bytes

    def _timers(self) -> list[int]:
        return [due for timers in self.handle.listTimers() for due in (timers if isinstance(timers, (list, tuple)) else [timers])]

    def _cancel(self, due: int) -> None:
        if due and due in self._timers():
            self.handle.deleteTimer(due)

    def _batch(self, key, number: int, held: list[tuple], reason: str) -> tuple:
        return (*key, number, reason, [{"seq": seq, "size": size, "frame": frame} for seq, size, frame in held])

    def _rows(self, closed: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(closed, columns=[*self.keys, "batch_no", "reason", "frames"])


def stream_batches(frames: DataFrame, keys: Sequence[str], limits: BatchLimits = BatchLimits(timeout=dt.timedelta(seconds=5))) -> DataFrame:
    """Pack a stream of ``keys, seq, size, frame`` and return one row for every batch that closed.

    ``keys`` names the packer: a sink, or a sink and a shard of it where one
    task should not take all of a sink. The rows are ``keys, batch_no, reason,
    frames``: ``reason`` is ``full`` or ``timeout``, ``frames`` the list of
    ``seq, size, frame`` in order. Numbers go on over restarts. Frames of later
    micro-batches must not have smaller ``seq``. Needs the state store
    :data:`STATE_STORE` and a query in append mode.
    """
    spark = frames.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        raise ValueError(f"open batches need spark.sql.streaming.stateStore.providerClass={STATE_STORE}")
    fields = [frames.schema[name] for name in keys]
    out = T.StructType(
        [
            *fields,
            T.StructField("batch_no", T.LongType()),
            T.StructField("reason", T.StringType()),
            T.StructField("frames", T.ArrayType(_FRAME)),
        ]
    )
    narrow = frames.select(*keys, "seq", frames["size"].cast("bigint").alias("size"), "frame")
    return narrow.groupBy(*keys).transformWithStateInPandas(Packer(keys, limits), out, "Append", "ProcessingTime")
