"""Limits and allowlists applied to every canonical event."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import truncate_bytes
from eventloom.schema import REFERENCE_FIELDS

# Byte limits of the event fields (fixed values).
FIELD_LIMITS = {
    "action": 128,
    "note": 1024,
    "reason": 128,
    "reportingController": 317,
    "reportingInstance": 128,
}
REFERENCE_FIELD_LIMIT = 512

# Fields an allowlist can constrain (fixed values).
RESTRICTED_FIELDS = ("type", "reason", "action", "reportingController", "reportingInstance")

LAST_APPLIED = "kubectl.kubernetes.io/last-applied-configuration"


@dataclass(frozen=True)
class SanitizeSpec:
    """Which sanitizers run; a limit of zero is off."""

    allowed_values: Mapping[str, Sequence[str]] = field(default_factory=dict)
    field_limits: bool = True
    drop_last_applied: bool = True
    max_labels: int = 100
    max_annotations: int = 100
    max_annotation_bytes: int = 4096

    def __post_init__(self) -> None:
        if min(self.max_labels, self.max_annotations, self.max_annotation_bytes) < 0:
            raise ValueError("limits must not be negative")
        for name, values in self.allowed_values.items():
            if name not in RESTRICTED_FIELDS:
                raise ValueError(f"unknown field {name!r}, allowed fields are {', '.join(RESTRICTED_FIELDS)}")
            if values is None or isinstance(values, str):
                raise ValueError(f"{name}: list the allowed values, or give an empty list to allow none")
            for value in values:
                if not value.strip() or value != value.strip():
                    raise ValueError(f"{name}: value {value!r} is blank or padded")
            if len(set(values)) != len(values):
                raise ValueError(f"{name}: a value is listed more than once")


def allowed_value(name: str, values: Sequence[str]) -> Column:
    """Return the field, cleared when its value is not listed."""
    if not values:
        return F.lit("")
    return F.when(F.col(name).isin(list(values)), F.col(name)).otherwise(F.lit(""))


def limit_reference(reference: Column) -> Column:
    """Limit every string of a reference; one that fits is passed through whole."""
    strings = F.array(*[reference[name] for name in REFERENCE_FIELDS])
    fit_together = F.octet_length(F.concat_ws("", strings)) <= REFERENCE_FIELD_LIMIT
    cut = F.transform(strings, lambda value: truncate_bytes(value, REFERENCE_FIELD_LIMIT))
    rebuilt = F.struct(*[cut[i].alias(name) for i, name in enumerate(REFERENCE_FIELDS)])
    return F.when(reference.isNull() | fit_together, reference).otherwise(rebuilt)


def drop_last_applied(annotations: Column) -> Column:
    """Remove the annotation that mirrors the object as it was applied."""
    key = F.lit(LAST_APPLIED)
    entry = F.struct(key.alias("key"), annotations[key].alias("value"))
    others = F.map_from_entries(F.array_remove(F.map_entries(annotations), entry))
    return F.when(F.map_contains_key(annotations, key), others).otherwise(annotations)


def cap_map(entries: Column, limit: int) -> Column:
    """Keep the first ``limit`` entries in key order; zero keeps all."""
    if limit <= 0:
        return entries
    kept = F.map_from_entries(F.slice(F.sort_array(F.map_entries(entries)), 1, limit))
    return F.when(F.size(entries) <= limit, entries).otherwise(kept)


def limit_values(entries: Column, limit: int) -> Column:
    """Truncate every value of a map to ``limit`` bytes; zero keeps all."""
    if limit <= 0:
        return entries
    # Values that fit together fit one by one; only larger maps are looked at value by value.
    fit_together = F.octet_length(F.concat_ws("", F.map_values(entries))) <= limit
    return F.when(fit_together, entries).otherwise(
        F.transform_values(entries, lambda _, value: truncate_bytes(value, limit))
    )


def sanitize_metadata(labels: Column, annotations: Column, spec: SanitizeSpec) -> tuple[Column, Column]:
    """Return labels and annotations after the metadata steps, in their fixed order."""
    if spec.drop_last_applied:
        annotations = drop_last_applied(annotations)
    labels = cap_map(labels, spec.max_labels)
    annotations = cap_map(annotations, spec.max_annotations)
    return labels, limit_values(annotations, spec.max_annotation_bytes)


def sanitize(events: DataFrame, spec: SanitizeSpec = SanitizeSpec()) -> DataFrame:
    """Apply allowlists, then byte limits, then the metadata steps, in one projection.

    Steps that are off add nothing to the plan.
    """
    columns: dict[str, Column] = {}
    for name, values in spec.allowed_values.items():
        columns[name] = allowed_value(name, values)
    if spec.field_limits:
        for name, limit in FIELD_LIMITS.items():
            columns[name] = truncate_bytes(columns.get(name, F.col(name)), limit)
        columns["regarding"] = limit_reference(F.col("regarding"))
        columns["related"] = limit_reference(F.col("related"))
    columns["labels"], columns["annotations"] = sanitize_metadata(F.col("labels"), F.col("annotations"), spec)
    return events.select(*[columns[name].alias(name) if name in columns else F.col(name) for name in events.columns])
