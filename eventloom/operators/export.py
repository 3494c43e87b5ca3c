"""Request bodies and their signatures."""

from __future__ import annotations

import base64
import binascii

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Content type per body format (fixed values).
CONTENT_TYPES = {
    "json-list": "application/json",
    "ndjson": "application/x-ndjson",
    "cloudevents": "application/cloudevents-batch+json",
    "template": "application/json",
}

_SECRET_PREFIX = "whsec_"
_BLOCK_BYTES = 64


def batch_lists(frames: DataFrame, parts: int | None = None) -> DataFrame:
    """Return ``(batch_id, frames, frame_list)`` of the rows ``batch_id, seq, frame``, the frames in ``seq`` order.

    A group is one batch, which the batch limits bound. Frames of a batch cannot
    be combined before they meet, so the rows are placed by batch first and no
    lists are built ahead of the shuffle. A partition's frames are sorted: with
    ``parts`` from :func:`eventloom.operators.batching.parts_for` they stay in
    memory however many there are.
    """
    ordered = F.sort_array(F.collect_list(F.struct("seq", "frame")))
    placed = frames.repartition("batch_id") if parts is None else frames.repartition(parts, "batch_id")
    return placed.groupBy("batch_id").agg(
        F.count("*").alias("frames"), F.transform(ordered, lambda entry: entry["frame"]).alias("frame_list")
    )


def body(frame_list: Column | str, fmt: str = "json-list", separator: str = "\n") -> Column:
    """Compose the body of a batch from the list of its frames."""
    if fmt not in CONTENT_TYPES:
        raise ValueError(f"unknown body format {fmt!r}")
    joiner = {"ndjson": "\n", "template": separator}.get(fmt, ",")
    opening, closing = {"ndjson": ("", "\n"), "template": ("", "")}.get(fmt, ("[", "]"))
    return F.concat(F.lit(opening), F.array_join(frame_list, joiner), F.lit(closing))


def request_bodies(frames: DataFrame, fmt: str = "json-list", separator: str = "\n", parts: int | None = None) -> DataFrame:
    """Compose one body per batch from the rows ``batch_id, seq, frame``. ``parts`` as for :func:`batch_lists`."""
    composed = body("frame_list", fmt, separator)
    return batch_lists(frames, parts).select("batch_id", "frames", composed.alias("body"), F.lit(CONTENT_TYPES[fmt]).alias("content_type"))


def decode_secret(secret: str) -> bytes:
    """Return the key of a ``whsec_`` secret, refusing anything but 24 to 64 bytes of base64."""
    if not secret.startswith(_SECRET_PREFIX):
        raise ValueError(f"a secret has to start with {_SECRET_PREFIX!r}")
    try:
        key = base64.b64decode(secret.removeprefix(_SECRET_PREFIX), validate=True)
    except binascii.Error as error:
        raise ValueError(f"a secret has to be base64: {error}") from error
    if not 24 <= len(key) <= 64:
        raise ValueError(f"a secret has to decode to 24 to 64 bytes, not {len(key)}")
    return key


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Return the HMAC-SHA256 of a binary message."""
    block = key.ljust(_BLOCK_BYTES, b"\0")
    inner_pad = F.lit(bytes(byte ^ 0x36 for byte in block))
    outer_pad = F.lit(bytes(byte ^ 0x5C for byte in block))
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    return F.unhex(F.sha2(F.concat(outer_pad, inner), 256))


def sign_requests(requests: DataFrame, secret: str, sent_at: Column) -> DataFrame:
    """Add the Standard Webhooks v1 headers; a retried batch keeps its identifier.

    ``sent_at`` is the send time in whole seconds.
    """
    key = decode_secret(secret)
    message_id = F.concat(F.lit("msg_"), F.col("batch_id"))
    stamp = sent_at.cast("bigint").cast("string")
    signed = F.concat_ws(".", message_id, stamp, F.col("body")).cast("binary")
    return requests.withColumns(
        {
            "webhook_id": message_id,
            "webhook_timestamp": stamp,
            "webhook_signature": F.concat(F.lit("v1,"), F.base64(hmac_sha256(key, signed))),
        }
    )
