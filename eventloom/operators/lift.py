"""Raw event objects to canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import valid_utf8
from eventloom.schema import EVENT_COLUMNS, REFERENCE_FIELDS, REGARDING_OBJECT, STRING_MAP


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _map(column: Column) -> Column:
    return F.coalesce(column, F.create_map().cast(STRING_MAP))


def promote_time(ingest_ts: Column) -> Column:
    """Return the event time, the deprecated first timestamp, or the read time."""
    return F.coalesce(F.col("eventTime"), F.col("deprecatedFirstTimestamp"), ingest_ts)


def promote_series() -> Column:
    """Return the series, or one built from the deprecated count when it is above one."""
    count = F.coalesce(F.col("deprecatedCount"), F.lit(0))
    built = F.struct(
        F.col("deprecatedCount").alias("count"),
        F.col("deprecatedLastTimestamp").alias("lastObservedTime"),
    )
    return F.when(F.col("series").isNotNull() | (count <= 1), F.col("series")).otherwise(built)


def promote_source(modern: str, deprecated: str) -> Column:
    """Return the modern reporter field, or the deprecated one when it is empty."""
    return F.coalesce(F.nullif(F.col(modern), F.lit("")), F.col(f"deprecatedSource.{deprecated}"), F.lit(""))


def clean_reference(reference: str) -> Column:
    """Rebuild a reference with valid text and no NULL strings."""
    strings = F.array(*[_text(F.col(f"{reference}.{name}")) for name in REFERENCE_FIELDS])
    plain = F.struct(*[strings[i].alias(name) for i, name in enumerate(REFERENCE_FIELDS)])
    repaired = F.transform(strings, valid_utf8)
    rebuilt = F.struct(*[repaired[i].alias(name) for i, name in enumerate(REFERENCE_FIELDS)])
    return F.when(_all_valid(strings), plain).otherwise(rebuilt)


def _all_valid(strings: Column) -> Column:
    """Return whether every string is valid; the joint keeps broken ends from completing each other."""
    return F.is_valid_utf8(F.concat_ws(" ", strings))


def clean_values(entries: Column) -> Column:
    """Repair the values of a map that holds an invalid one."""
    return F.when(_all_valid(F.map_values(entries)), entries).otherwise(
        F.transform_values(entries, lambda _, value: valid_utf8(value))
    )


def lift(raw: DataFrame, ingest_ts: Column | str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Project raw events onto the canonical schema in one pass.

    ``ingest_ts`` is the read time as a column or literal, so reruns agree.
    ``carry`` names extra columns such as ``watch`` and ``seq`` to keep.
    """
    read_time = F.lit(ingest_ts).cast("timestamp") if isinstance(ingest_ts, str) else ingest_ts
    lifted = {
        "uid": _text(F.col("uid")),
        "resourceVersion": _text(F.col("resourceVersion")),
        "namespace": _text(F.col("namespace")),
        "name": valid_utf8(_text(F.col("name"))),
        "labels": _map(F.col("labels")),
        "annotations": clean_values(_map(F.col("annotations"))),
        "eventTime": promote_time(read_time),
        "series": promote_series(),
        "reportingController": valid_utf8(promote_source("reportingController", "component")),
        "reportingInstance": valid_utf8(promote_source("reportingInstance", "host")),
        "action": valid_utf8(_text(F.col("action"))),
        "reason": valid_utf8(_text(F.col("reason"))),
        "regarding": clean_reference("regarding"),
        "related": F.when(F.col("related").isNotNull(), clean_reference("related")),
        "note": valid_utf8(_text(F.col("note"))),
        "type": valid_utf8(_text(F.col("type"))),
        "regardingObject": F.lit(None).cast(REGARDING_OBJECT),
    }
    return raw.select(*carry, *[lifted[name].alias(name) for name in EVENT_COLUMNS])
