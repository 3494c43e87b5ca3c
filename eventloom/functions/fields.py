"""Field addressing over the canonical event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.times import rfc3339_micro
from eventloom.schema import REFERENCE_FIELDS

TOP_LEVEL_STRINGS = (
    "uid",
    "resourceVersion",
    "namespace",
    "name",
    "reportingController",
    "reportingInstance",
    "action",
    "reason",
    "note",
    "type",
)


class UnknownFieldError(ValueError):
    """A dotted path names no field of an event."""


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def field(path: str) -> Column:
    """Return the field a dotted path addresses as a string, '' when absent.

    Everything after ``labels.`` or ``annotations.`` is the key.
    """
    if path in TOP_LEVEL_STRINGS:
        return F.col(path)
    if path == "eventTime":
        return _or_empty(rfc3339_micro(F.col("eventTime")))
    head, _, rest = path.partition(".")
    if rest and head in ("labels", "annotations"):
        return _or_empty(F.col(head)[F.lit(rest)])
    if head == "series" and rest == "count":
        return _or_empty(F.col("series.count").cast("string"))
    if head == "series" and rest == "lastObservedTime":
        return _or_empty(rfc3339_micro(F.col("series.lastObservedTime")))
    if head in ("regarding", "related") and rest in REFERENCE_FIELDS:
        return _or_empty(F.col(head)[rest])
    if head == "regardingObject":
        inner, _, key = rest.partition(".")
        if rest == "terminating":
            return F.coalesce(F.col("regardingObject.terminating"), F.lit(False)).cast("string")
        if key and inner in ("labels", "annotations"):
            return _or_empty(F.col(f"regardingObject.{inner}")[F.lit(key)])
        if inner == "owner" and key in REFERENCE_FIELDS:
            return _or_empty(F.col(f"regardingObject.owner.{key}"))
    raise UnknownFieldError(f"unknown event field {path!r}")


_STRING_PATHS = (
    set(TOP_LEVEL_STRINGS)
    | {f"{ref}.{name}" for ref in ("regarding", "related", "regardingObject.owner") for name in REFERENCE_FIELDS}
)
_MAP_PATHS = {"labels", "annotations", "regardingObject.labels", "regardingObject.annotations"}
_TIME_PATHS = {"eventTime", "series.lastObservedTime"}
_OBJECT_PATHS = {"series", "related", "regardingObject", "regardingObject.owner"}


def has(path: str) -> Column:
    """Return whether a field holds something; NULL when its parent object is absent."""
    if path in _STRING_PATHS:
        return F.col(path) != ""
    if path in _MAP_PATHS:
        size = F.size(F.col(path)) > 0
        return F.when(F.col(path).isNotNull(), size)
    parent, _, leaf = path.rpartition(".")
    if path in _TIME_PATHS or path in _OBJECT_PATHS:
        present = F.col(path).isNotNull()
        return F.when(F.col(parent).isNotNull(), present) if parent else present
    if path == "series.count":
        return F.col(path) != 0
    if path == "regardingObject.terminating":
        return F.col(path)
    if path == "regarding":
        return F.concat(*[F.col(f"regarding.{name}") for name in REFERENCE_FIELDS]) != ""
    if parent not in _MAP_PATHS:
        for prefix in sorted(_MAP_PATHS, key=len, reverse=True):
            if path.startswith(prefix + "."):
                parent, leaf = prefix, path[len(prefix) + 1 :]
                break
    if parent in _MAP_PATHS and leaf:
        return F.map_contains_key(F.col(parent), F.lit(leaf))
    raise UnknownFieldError(f"unknown event field {path!r}")


def get_or(path: str, default: str) -> Column:
    """Return a map entry such as ``labels.team``, or the default when it is missing."""
    for prefix in sorted(_MAP_PATHS, key=len, reverse=True):
        if path.startswith(prefix + ".") and len(path) > len(prefix) + 1:
            return F.coalesce(F.col(prefix)[F.lit(path[len(prefix) + 1 :])], F.lit(default))
    if path in _STRING_PATHS:
        return F.coalesce(F.nullif(F.col(path), F.lit("")), F.lit(default))
    raise UnknownFieldError(f"no optional field {path!r}")


def same_reference(left: Column, right: Column) -> Column:
    """Compare two references or two series by content; absent equals only absent."""
    return left.eqNullSafe(right)


def same_object(left: Column, right: Column) -> Column:
    """Compare two enriched objects by content, maps included."""

    def entries(value: Column) -> Column:
        return F.sort_array(F.map_entries(value))

    both = (
        left["terminating"].eqNullSafe(right["terminating"])
        & left["owner"].eqNullSafe(right["owner"])
        & entries(left["labels"]).eqNullSafe(entries(right["labels"]))
        & entries(left["annotations"]).eqNullSafe(entries(right["annotations"]))
    )
    return F.when(left.isNull() | right.isNull(), left.isNull() & right.isNull()).otherwise(both)
