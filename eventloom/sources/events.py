"""Reading raw events, binding them to watches, and selecting them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.schema import FRAME, RAW_EVENT

ALL_NAMESPACES = "*"

# Fields a field selector may name (fixed values).
SELECTABLE_FIELDS = (
    "metadata.name",
    "metadata.namespace",
    "reason",
    "reportingController",
    "type",
    "regarding.apiVersion",
    "regarding.fieldPath",
    "regarding.kind",
    "regarding.name",
    "regarding.namespace",
    "regarding.resourceVersion",
    "regarding.uid",
)


#: Where a value that is no object is put, so that it can be told from an empty one.
_CORRUPT = "_corrupt"


class SelectorError(ValueError):
    """A selector cannot be parsed or names a field that cannot be selected on."""


@dataclass(frozen=True)
class Watch:
    """One stream of events: a namespace, or every namespace when empty."""

    namespace: str = ""
    label_selector: str = ""
    field_selector: str = ""

    @property
    def name(self) -> str:
        return self.namespace or ALL_NAMESPACES


def check_watches(watches: Sequence[Watch]) -> None:
    """Refuse an empty list, duplicates, and an all-namespace watch beside others."""
    if not watches:
        raise ValueError("at least one watch has to be declared")
    names = [watch.name for watch in watches]
    if ALL_NAMESPACES in names and len(names) > 1:
        raise ValueError("a watch over every namespace has to be declared alone")
    if len(set(names)) != len(names):
        raise ValueError("a namespace is watched twice")
    for watch in watches:
        if watch.namespace and not re.fullmatch(r"[a-z0-9]([-a-z0-9]{0,61}[a-z0-9])?", watch.namespace):
            raise ValueError(f"invalid namespace {watch.namespace!r}")
        _field_requirements(watch.field_selector)
        _label_requirements(watch.label_selector)


def read_events(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    watches: Sequence[Watch] = (Watch(),),
    schema: T.StructType = RAW_EVENT,
    streaming: bool = False,
    **options: str,
) -> DataFrame:
    """Read raw events of the given watches with an explicit schema."""
    reader = spark.readStream if streaming else spark.read
    events = reader.format(fmt).options(**options).schema(schema).load(path)
    return bind_watch(events, watches)


def parse_events(values: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Read raw events from JSON values, such as those of a Kafka topic; what is no object is left out.

    A binary value is read as it is, so that invalid bytes reach the repair of the lift.
    """
    schema = T.StructType(list(RAW_EVENT.fields)).add(_CORRUPT, T.StringType())
    parsed = F.from_json(F.col(column).cast("string"), schema, {"columnNameOfCorruptRecord": _CORRUPT})
    whole = values.select(*keep, parsed.alias("_event")).filter(F.col("_event").isNotNull() & F.col(f"_event.{_CORRUPT}").isNull())
    return whole.select(*keep, *(F.col(f"_event.{name}").alias(name) for name in RAW_EVENT.names))


def read_frames(spark: SparkSession, path: str, fmt: str = "json", streaming: bool = False, **options: str) -> DataFrame:
    """Read a log of watch frames: ``watch, seq, frame_type, object``."""
    reader = spark.readStream if streaming else spark.read
    return reader.format(fmt).options(**options).schema(FRAME).load(path)


def bind_watch(events: DataFrame, watches: Sequence[Watch]) -> DataFrame:
    """Keep the events some watch selects and tag each with its watch name.

    Watches never overlap, so this is one row-local filter and no join.
    """
    check_watches(watches)
    name = F.lit(None).cast("string")
    for watch in watches:
        served = field_selector(watch.field_selector) & label_selector(watch.label_selector)
        if watch.namespace:
            served = served & (F.col("namespace") == watch.namespace)
        name = F.when(served, F.lit(watch.name)).otherwise(name)
    wanted = [watch.namespace for watch in watches if watch.namespace]
    if wanted:
        events = events.filter(F.col("namespace").isin(wanted))
    return events.withColumn("watch", name).filter(F.col("watch").isNotNull())


def field_selector(spec: str | Iterable[tuple[str, str, str]]) -> Column:
    """Return the conjunction a field selector stands for.

    ``spec`` is ``"reason=Failed,type!=Normal"`` or triples of (field, operator, value).
    """
    condition = F.lit(True)
    for name, operator, value in _field_requirements(spec):
        column = F.col(name.removeprefix("metadata."))
        condition = condition & (column != value if operator == "!=" else column == value)
    return condition


def _field_requirements(spec: str | Iterable[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    if isinstance(spec, str):
        terms = [re.fullmatch(r"\s*([\w.]+)\s*(!=|==|=)(.*)", term) for term in filter(None, spec.split(","))]
        if None in terms:
            raise SelectorError(f"cannot read field selector {spec!r}")
        spec = [(term[1], term[2], term[3]) for term in terms]
    found = list(spec)
    for name, operator, _ in found:
        if name not in SELECTABLE_FIELDS:
            raise SelectorError(f"{name!r} cannot be selected on")
        if operator not in ("=", "==", "!="):
            raise SelectorError(f"unknown operator {operator!r}")
    return found


def label_selector(spec: str | Iterable[tuple[str, str, Sequence[str]]], labels: str = "labels") -> Column:
    """Return the conjunction of label requirements.

    ``spec`` is a selector text or triples of (key, operator, values) with the
    operators ``=  !=  in  notin  exists  !exists``. A missing key satisfies
    ``!=`` and ``notin``.
    """
    condition = F.lit(True)
    for key, operator, values in _label_requirements(spec):
        value = F.col(labels)[F.lit(key)]
        values = [values] if isinstance(values, str) else list(values)
        if operator in ("=", "==", "in"):
            condition = condition & F.coalesce(value.isin(values), F.lit(False))
        elif operator in ("!=", "notin"):
            condition = condition & F.coalesce(~value.isin(values), F.lit(True))
        elif operator == "exists":
            condition = condition & F.map_contains_key(F.col(labels), F.lit(key))
        elif operator == "!exists":
            condition = condition & ~F.map_contains_key(F.col(labels), F.lit(key))
        else:
            raise SelectorError(f"unknown operator {operator!r}")
    return condition


def _label_requirements(
    spec: str | Iterable[tuple[str, str, Sequence[str]]],
) -> list[tuple[str, str, Sequence[str]]]:
    if not isinstance(spec, str):
        return list(spec)
    found: list[tuple[str, str, Sequence[str]]] = []
    for term in filter(None, (part.strip() for part in re.split(r",(?![^(]*\))", spec))):
        if parsed := re.fullmatch(r"([\w./-]+)\s+(in|notin)\s*\(([^)]*)\)", term):
            found.append((parsed[1], parsed[2], [value.strip() for value in parsed[3].split(",")]))
        elif parsed := re.fullmatch(r"([\w./-]+)\s*(!=|==|=)\s*([\w.-]*)", term):
            found.append((parsed[1], parsed[2], [parsed[3]]))
        elif parsed := re.fullmatch(r"(!?)\s*([\w./-]+)", term):
            found.append((parsed[2], parsed[1] + "exists", []))
        else:
            raise SelectorError(f"cannot read selector term {term!r}")
    return found


def deliverable_frames(frames: DataFrame) -> DataFrame:
    """Keep the frames that carry an event to deliver; deletions and bookmarks never do."""
    return frames.filter(F.col("frame_type").isin("ADDED", "MODIFIED"))


def frame_events(frames: DataFrame) -> DataFrame:
    """Unpack the event object of each frame next to its ``watch`` and ``seq``."""
    return frames.select("watch", "seq", "object.*")
