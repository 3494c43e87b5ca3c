"""Event counters with a limit on series, and drop accounting."""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.fields import field as event_field
from eventloom.operators.filters import EVAL_ERROR

DEFAULT_NAMESPACE = "events"

# Drop reasons per stage (fixed values).
DROP_REASONS = {
    "filter": ("eval_error",),
    "queue": ("too_large",),
    "delivery": ("retry_exhausted", "permanent_error"),
    "sink": ("rejected",),
}

_LEGACY_METRIC = re.compile(r"[a-zA-Z_:][a-zA-Z0-9_:]*")
_LEGACY_LABEL = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


class MetricError(ValueError):
    """A metric definition is refused."""


@dataclass(frozen=True)
class Metric:
    """A counter incremented once per event; labels map to event fields."""

    name: str
    namespace: str = ""
    subsystem: str = ""
    help: str = ""
    labels: Mapping[str, str] = field(default_factory=dict)
    const_labels: Mapping[str, str] = field(default_factory=dict)

    def full_name(self, default_namespace: str = DEFAULT_NAMESPACE) -> str:
        parts = (self.namespace or default_namespace, self.subsystem, self.name)
        return "_".join(part for part in parts if part)

    def label_names(self) -> list[str]:
        return sorted(self.labels)


def escape_name(name: str) -> str:
    """Return the form a name takes where only the legacy characters are accepted."""
    plain = re.sub(r"[^a-zA-Z0-9_:]", "_", name)
    return "_" + plain[1:] if plain[:1].isdigit() else plain


def exposed_names(metrics: Sequence[Metric], default_namespace: str = DEFAULT_NAMESPACE) -> list[tuple[str, str, str, str]]:
    """Return every name that metrics show: ``(kind, owner, name, name as a legacy reader gets it)``."""
    rows = []
    for metric in metrics:
        full = metric.full_name(default_namespace) if metric.name else ""
        rows.append(("metric", "", full, escape_name(full)))
        rows += [("label", full, label, escape_name(label)) for label in (*metric.labels, *metric.const_labels)]
    return rows


def check_metrics(
    metrics: Sequence[Metric],
    default_namespace: str = DEFAULT_NAMESPACE,
    scheme: str = "legacy",
    reserved_prefixes: Sequence[str] = ("go_", "process_"),
) -> None:
    """Refuse names that a reader could not take or tell apart, and labels of fields that events lack.

    All names are put in one table first; each rule is then one condition on it.
    """
    allowed = {"legacy": {"metric": _LEGACY_METRIC, "label": _LEGACY_LABEL}, "utf8": dict.fromkeys(("metric", "label"), re.compile(".+", re.S))}
    if scheme not in allowed:
        raise MetricError(f"there is no name scheme {scheme!r}")
    rows = exposed_names(metrics, default_namespace)
    kept_back = {"metric": tuple(reserved_prefixes), "label": ("__",)}
    seen = Counter((kind, owner, plain) for kind, owner, _, plain in rows)
    faults = [
        f"{kind} {name!r}: {fault}"
        for kind, owner, name, plain in rows
        for fault, found in (
            ("not a name under this scheme", not allowed[scheme][kind].fullmatch(name)),
            ("a colon belongs to recording rules", kind == "metric" and ":" in name),
            ("its beginning is kept for others", name.startswith(kept_back[kind]) or plain.startswith(kept_back[kind])),
            ("not the only one a reader gets under this name", seen[kind, owner, plain] > 1),
        )
        if found
    ]
    for path in {path for metric in metrics for path in metric.labels.values()}:
        try:
            event_field(path)
        except ValueError as error:
            faults.append(str(error))
    if not metrics:
        faults.append("there is nothing to count")
    if faults:
        raise MetricError("; ".join(sorted(set(faults))))


def check_metric_sinks(sinks: Mapping[str, Sequence[Metric]], default_namespace: str = DEFAULT_NAMESPACE) -> None:
    """Refuse a metric name that two sinks expose."""
    owners: dict[str, set[str]] = {}
    for sink, metrics in sinks.items():
        for kind, _, _, plain in exposed_names(metrics, default_namespace):
            if kind == "metric":
                owners.setdefault(plain, set()).add(sink)
    if shared := sorted(f"{name} ({', '.join(sorted(of))})" for name, of in owners.items() if len(of) > 1):
        raise MetricError(f"metrics of more than one sink: {'; '.join(shared)}")


def label_values(metric: Metric) -> Column:
    """Return a metric's label values on an event, in label-name order."""
    values = [event_field(metric.labels[name]) for name in metric.label_names()]
    return F.array(*values) if values else F.array().cast("array<string>")


def series(events: DataFrame, metrics: Sequence[Metric], seq: str | None = None) -> DataFrame:
    """Count events per metric index and label values, every metric in one pass and one shuffle.

    With ``seq`` the first occurrence of each series is kept as ``first_seq``.
    """
    entries = F.array(
        *[
            F.struct(F.lit(index).alias("metric_index"), label_values(metric).alias("label_values"))
            for index, metric in enumerate(metrics)
        ]
    )
    order = [] if seq is None else [F.col(seq).alias("_seq")]
    rows = events.select(*order, F.inline(entries))
    totals = [F.count("*").alias("value")] + ([F.min("_seq").alias("first_seq")] if seq else [])
    return rows.groupBy("metric_index", "label_values").agg(*totals)


def admitted_series(
    events: DataFrame, metrics: Sequence[Metric], max_series: int, seq: str | None
) -> DataFrame:
    """Return the series counted under the limit: the first ``max_series`` to occur, over all metrics.

    Within an event the metrics are tried in their order. A series keeps
    counting once admitted, so its total is the plain one. Zero is no limit.
    A series with a value that is no valid text takes its place and is not counted.
    """
    counted = series(events, metrics, seq)
    if max_series:
        counted = counted.orderBy("first_seq", "metric_index").limit(max_series)
    return counted.filter(valid_values(F.col("label_values")))


def valid_values(values: Column) -> Column:
    return F.is_valid_utf8(F.concat_ws(" ", values))


def count_metrics(
    events: DataFrame,
    metrics: Sequence[Metric],
    max_series: int = 0,
    seq: str | None = None,
    default_namespace: str = DEFAULT_NAMESPACE,
) -> DataFrame:
    """Return ``metric, labels, value`` per series; constant labels are added at the end."""
    check_metrics(metrics, default_namespace)
    if max_series and seq is None:
        raise ValueError("a series limit needs the column that orders the events")
    counted = admitted_series(events, metrics, max_series, seq if max_series else None)
    name = F.lit(None).cast("string")
    labels = F.lit(None).cast("map<string,string>")
    for index, metric in enumerate(metrics):
        this = F.col("metric_index") == index
        name = F.when(this, F.lit(metric.full_name(default_namespace))).otherwise(name)
        keys = F.array(*[F.lit(label) for label in metric.label_names()]).cast("array<string>")
        built = F.map_from_arrays(keys, F.col("label_values"))
        if metric.const_labels:
            constants = [F.lit(part) for pair in sorted(metric.const_labels.items()) for part in pair]
            built = F.map_concat(built, F.create_map(*constants))
        labels = F.when(this, built).otherwise(labels)
    return counted.select(name.alias("metric"), labels.alias("labels"), "value")


def metric_delivery(events: DataFrame, metrics: Sequence[Metric], max_series: int, seq: str) -> DataFrame:
    """Add ``delivered``: whether at least one metric recorded the event.

    Each metric looks its series up among the admitted ones; Spark broadcasts
    those when they measure small enough.
    """
    if not max_series:
        recorded = [valid_values(label_values(metric)) for metric in metrics]
        return events.withColumn("delivered", reduce(operator.or_, recorded))
    admitted = admitted_series(events, metrics, max_series, seq).select("metric_index", "label_values")
    delivered = F.lit(False)
    for index, metric in enumerate(metrics):
        own = admitted.filter(F.col("metric_index") == index).select(
            F.col("label_values").alias(f"_series_{index}"), F.lit(True).alias(f"_admitted_{index}")
        )
        events = events.join(own, label_values(metric) == F.col(f"_series_{index}"), "left")
        delivered = delivered | F.coalesce(F.col(f"_admitted_{index}"), F.lit(False))
    helpers = [f"{name}_{index}" for index in range(len(metrics)) for name in ("_series", "_admitted")]
    return events.withColumn("delivered", delivered).drop(*helpers)


def read_counts(events: DataFrame) -> DataFrame:
    """Count the events handed to the flows per watch."""
    return events.groupBy("watch").agg(F.count("*").alias("events"))


def filter_drops(matched: DataFrame) -> DataFrame:
    """Return one drop row per failed evaluation of a flow."""
    return (
        matched.select(F.explode("verdicts").alias("entry"))
        .filter(F.col("entry.verdict") == EVAL_ERROR)
        .select(
            F.lit("filter").alias("stage"),
            F.lit(EVAL_ERROR).alias("reason"),
            F.col("entry.flow").alias("flow"),
            F.lit("").alias("sink"),
            F.lit(1).cast("bigint").alias("events"),
        )
    )


def frame_drops(frames: DataFrame) -> DataFrame:
    """Return one drop row per frame whose ``reason`` keeps it out of its sink's queue."""
    return frames.filter(F.col("reason").isin("too_large", "rejected")).select(
        F.when(F.col("reason") == "too_large", F.lit("queue")).otherwise(F.lit("sink")).alias("stage"),
        "reason",
        F.lit("").alias("flow"),
        "sink",
        F.lit(1).cast("bigint").alias("events"),
    )


def drop_counts(*drops: DataFrame) -> DataFrame:
    """Sum drop rows ``stage, reason, flow, sink, events`` by stage, reason, flow and sink."""
    rows = drops[0]
    for more in drops[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("stage", "reason", "flow", "sink").agg(F.sum("events").alias("events"))
