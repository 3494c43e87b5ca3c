"""OTLP/JSON log records, and their grouping per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.jsontext import sorted_map, text_or_null
from eventloom.functions.times import occurrence_time, rfc3339_trimmed
from eventloom.operators.encode import Identity, _quoted

# Severity per lower-case event type: number and name (fixed values).
SEVERITIES = {
    "normal": (9, "SEVERITY_NUMBER_INFO"),
    "warning": (13, "SEVERITY_NUMBER_WARN"),
    "error": (17, "SEVERITY_NUMBER_ERROR"),
    "critical": (21, "SEVERITY_NUMBER_FATAL"),
}

# Attribute keys and the event columns they carry (fixed values).
RECORD_ATTRIBUTES = (
    ("k8s.event.name", "name"),
    ("k8s.event.uid", "uid"),
    ("k8s.event.namespace", "namespace"),
    ("k8s.event.reason", "reason"),
    ("k8s.event.action", "action"),
    ("k8s.event.reporting_controller", "reportingController"),
    ("k8s.event.reporting_instance", "reportingInstance"),
)
OBJECT_ATTRIBUTES = (
    ("k8s.object.kind", "regarding.kind"),
    ("k8s.object.name", "regarding.name"),
    ("k8s.object.namespace", "regarding.namespace"),
    ("k8s.object.uid", "regarding.uid"),
    ("k8s.object.api_version", "regarding.apiVersion"),
    ("k8s.object.resource_version", "regarding.resourceVersion"),
    ("k8s.object.fieldpath", "regarding.fieldPath"),
)
OWNER_ATTRIBUTES = (
    ("k8s.object.owner.kind", "regardingObject.owner.kind"),
    ("k8s.object.owner.name", "regardingObject.owner.name"),
    ("k8s.object.owner.namespace", "regardingObject.owner.namespace"),
    ("k8s.object.owner.uid", "regardingObject.owner.uid"),
    ("k8s.object.owner.api_version", "regardingObject.owner.apiVersion"),
)
AGENT_ATTRIBUTES = (
    ("service.version", "version"),
    ("k8s.cluster.name", "cluster"),
    ("k8s.namespace.name", "namespace"),
    ("k8s.pod.name", "pod"),
    ("k8s.node.name", "node"),
)


def severity_number(event_type: Column) -> Column:
    """Return the severity number of an event type, whatever its case; 0 when it has none."""
    number = F.lit(0)
    for name, (value, _) in SEVERITIES.items():
        number = F.when(F.lower(event_type) == name, F.lit(value)).otherwise(number)
    return number


def _severity_name(event_type: Column) -> Column:
    name = F.lit(None).cast("string")
    for known, (_, value) in SEVERITIES.items():
        name = F.when(F.lower(event_type) == known, F.lit(value)).otherwise(name)
    return name


def _value(text: Column | None = None, flag: Column | None = None, number: Column | None = None) -> Column:
    """Return an attribute value; the members that are NULL are not written."""
    return F.struct(
        (F.lit(None) if text is None else text).cast("string").alias("stringValue"),
        (F.lit(None) if flag is None else flag).cast("boolean").alias("boolValue"),
        (F.lit(None) if number is None else number).cast("string").alias("intValue"),
    )


def _attribute(key: str, present: Column, value: Column) -> Column:
    """Return one attribute, NULL when it is absent."""
    return F.when(present, F.struct(F.lit(key).alias("key"), value.alias("value")))


def _texts(pairs: tuple[tuple[str, str], ...]) -> list[Column]:
    return [_attribute(key, F.col(path) != "", _value(F.col(path))) for key, path in pairs]


def _map_attributes(prefix: str, entries: Column) -> Column:
    """Return the non-empty entries of a map as attributes in key order, none for a NULL map."""
    listed = F.transform(
        F.filter(F.map_entries(sorted_map(entries)), lambda entry: entry["value"] != ""),
        lambda entry: F.struct(F.concat(F.lit(prefix), entry["key"]).alias("key"), _value(entry["value"]).alias("value")),
    )
    return F.coalesce(listed, F.array())


def otlp_resource(identity: Identity, service_name: str = "event-agent") -> Column:
    """Return the resource: the exporter, and the object the event regards."""
    agent = [("service.name", service_name)] + [(key, getattr(identity, name)) for key, name in AGENT_ATTRIBUTES]
    terminating = F.coalesce(F.col("regardingObject.terminating"), F.lit(False))
    attributes = F.concat(
        F.array_compact(
            F.array(
                *[_attribute(key, F.lit(True), _value(F.lit(value))) for key, value in agent if value],
                *_texts(OBJECT_ATTRIBUTES),
            )
        ),
        _map_attributes("k8s.object.label.", F.col("regardingObject.labels")),
        _map_attributes("k8s.object.annotation.", F.col("regardingObject.annotations")),
        F.array_compact(
            F.array(
                _attribute("k8s.object.terminating", terminating, _value(flag=F.lit(True))),
                *_texts(OWNER_ATTRIBUTES),
            )
        ),
    )
    return F.to_json(F.struct(attributes.alias("attributes")))


def _nanos(time: Column) -> Column:
    return F.concat(F.unix_micros(time).cast("string"), F.lit("000"))


def otlp_record(observed: Column) -> Column:
    """Return the log record of an event."""
    attributes = F.array_compact(
        F.array(
            *_texts(RECORD_ATTRIBUTES),
            _attribute(
                "k8s.event.start_time", F.col("series").isNotNull(), _value(rfc3339_trimmed(F.col("eventTime")))
            ),
            _attribute("k8s.event.count", F.col("series.count") > 0, _value(number=F.col("series.count"))),
        )
    )
    any_text = F.concat_ws("", *[F.col(path) for _, path in RECORD_ATTRIBUTES]) != ""
    return F.to_json(
        F.struct(
            _nanos(occurrence_time()).alias("timeUnixNano"),
            _nanos(observed).alias("observedTimeUnixNano"),
            _severity_name(F.col("type")).alias("severityNumber"),
            text_or_null(F.col("type")).alias("severityText"),
            F.struct(F.col("note").alias("stringValue")).alias("body"),
            F.when(any_text | F.col("series").isNotNull(), attributes).alias("attributes"),
        )
    )


def otlp_records(
    events: DataFrame,
    observed: Column,
    identity: Identity = Identity(),
    service_name: str = "event-agent",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Return ``resource`` and ``record`` JSON per event, with the severity number beside them."""
    return events.select(
        *carry,
        otlp_resource(identity, service_name).alias("resource"),
        otlp_record(observed).alias("record"),
        severity_number(F.col("type")).alias("severity_number"),
    )


def otlp_groups(records: DataFrame, parts: int | None = None) -> DataFrame:
    """Group the records ``batch_id, seq, resource, record`` of each batch by resource.

    Records keep their order in a group. A group holds at most one batch, which
    the batch limits bound. The rows are placed by batch once, which serves this
    grouping and the one in :func:`otlp_compact` without another shuffle. Both
    sort the texts of a partition: with ``parts`` from
    :func:`eventloom.operators.batching.parts_for` these stay in memory however
    many records there are; without it Spark's shuffle partitions hold them all.
    """
    ordered = F.sort_array(F.collect_list(F.struct("seq", "record")))
    placed = records.repartition("batch_id") if parts is None else records.repartition(parts, "batch_id")
    return placed.groupBy("batch_id", "resource").agg(
        F.min("seq").alias("first_seq"),
        F.count("*").alias("records"),
        F.transform(ordered, lambda entry: entry["record"]).alias("log_records"),
    )


def otlp_compact(
    records: DataFrame, scope_name: str = "eventloom.otlp", scope_version: str = "", parts: int | None = None
) -> DataFrame:
    """Return one OTLP/JSON export request per batch; groups follow their first record. ``parts`` as for :func:`otlp_groups`."""
    version = f',"version":{_quoted(scope_version)}' if scope_version else ""
    scope = f'"scope":{{"name":{_quoted(scope_name)}{version}}}'
    group = F.concat(
        F.lit('{"resource":'),
        F.col("resource"),
        F.lit(f',"scopeLogs":[{{{scope},"logRecords":['),
        F.array_join("log_records", ","),
        F.lit("]}]}"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("first_seq", group.alias("body"))))
    return (
        otlp_groups(records, parts)
        .groupBy("batch_id")
        .agg(ordered.alias("groups"), F.sum("records").alias("records"))
        .select(
            "batch_id",
            "records",
            F.concat(
                F.lit('{"resourceLogs":['),
                F.array_join(F.transform("groups", lambda entry: entry["body"]), ","),
                F.lit("]}"),
            ).alias("body"),
        )
    )
