"""Events to request tables: encode, refuse, pack, compose, sign."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.batching import QUEUE_BYTES, BatchLimits, batch_id, frame_bytes, pack_batches, split_too_large
from eventloom.operators.export import request_bodies, sign_requests
from eventloom.operators.metrics import frame_drops


def export_requests(
    events: DataFrame,
    frame: Column,
    fmt: str,
    keys: Sequence[str],
    limits: BatchLimits,
    queue_bytes: int = QUEUE_BYTES,
    separator: str = "\n",
    epoch: str = "",
    secret: str | None = None,
    sent_at: Column | None = None,
) -> DataFrame:
    """Return one request per batch of frames.

    ``keys`` names the packer columns of ``events``, ``seq`` orders them. Empty
    frames and frames larger than a queue are left out; :func:`export_drops`
    returns those. The frames are encoded once for their sizes and once for the bodies; checkpoint
    ``events`` first when what is above them is expensive.
    """
    framed = events.select(
        *keys, "seq", F.unix_micros("eventTime").alias("arrival_us"), frame.alias("frame")
    ).withColumn("size", frame_bytes(F.col("frame"), fmt))
    kept, _ = split_too_large(framed, "size", queue_bytes)
    packed = pack_batches(kept, keys, limits).withColumn("batch_id", batch_id(keys, epoch))
    requests = request_bodies(packed, fmt, separator)
    return requests if secret is None else sign_requests(requests, secret, sent_at)


def export_drops(events: DataFrame, frame: Column, fmt: str, sink: Column | str, queue_bytes: int = QUEUE_BYTES) -> DataFrame:
    """Return a drop row for every frame that :func:`export_requests` leaves out."""
    named = F.lit(sink) if isinstance(sink, str) else sink
    framed = events.select(named.alias("sink"), frame_bytes(frame, fmt).alias("size"))
    return frame_drops(split_too_large(framed, "size", queue_bytes)[1])
