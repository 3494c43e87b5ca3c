"""Encoding canonical events as wire rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.fields import UnknownFieldError, field
from eventloom.functions.jsontext import (
    json_escape,
    json_object,
    json_quote,
    members,
    object_or_null,
    sorted_map,
    text_or_null,
    unclosed,
)
from eventloom.functions.times import occurrence_time, rfc3339_micro, rfc3339_trimmed
from eventloom.schema import REFERENCE_FIELDS


@dataclass(frozen=True)
class Identity:
    """Who exports: empty values are left out of every format."""

    cluster: str = ""
    node: str = ""
    namespace: str = ""
    pod: str = ""
    version: str = ""
    commit: str = ""


def _quoted(text: str) -> str:
    """Quote a constant the way the column functions quote values."""
    short = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return '"' + "".join(short.get(c, f"\\u{ord(c):04x}" if c < " " else c) for c in text) + '"'


# --- canonical JSON ----------------------------------------------------------


def _texts_or_null(names: Iterable[str], parent: str = "") -> Column:
    """Return a struct of the named strings in which empty ones are NULL, so that a writer omits them."""
    return F.expr(f"named_struct({', '.join(f"'{name}', nullif({parent}{name}, '')" for name in names)})")


def _reference_members(path: str) -> Column:
    return _texts_or_null(REFERENCE_FIELDS, f"{path}.")


def _optional_reference(path: str) -> Column:
    return F.when(F.col(path).isNotNull(), _reference_members(path))


def to_canonical_json() -> Column:
    """Return the event as JSON with a fixed member order.

    Empty strings, maps and false flags are left out; ``eventTime`` and
    ``regarding`` are always written, and an unset observation time as null.
    Only events with an unset time are put together from parts, since a JSON
    writer leaves nulls out.
    """
    head = [
        text_or_null(F.col("uid")).alias("uid"),
        text_or_null(F.col("resourceVersion")).alias("resourceVersion"),
        text_or_null(F.col("namespace")).alias("namespace"),
        text_or_null(F.col("name")).alias("name"),
        object_or_null(F.col("labels")).alias("labels"),
        object_or_null(F.col("annotations")).alias("annotations"),
    ]
    enriched = F.when(
        F.col("regardingObject").isNotNull(),
        F.struct(
            object_or_null(F.col("regardingObject.labels")).alias("labels"),
            object_or_null(F.col("regardingObject.annotations")).alias("annotations"),
            _optional_reference("regardingObject.owner").alias("owner"),
            F.nullif(F.col("regardingObject.terminating"), F.lit(False)).alias("terminating"),
        ),
    )
    tail = [
        text_or_null(F.col("reportingController")).alias("reportingController"),
        text_or_null(F.col("reportingInstance")).alias("reportingInstance"),
        text_or_null(F.col("action")).alias("action"),
        text_or_null(F.col("reason")).alias("reason"),
        _reference_members("regarding").alias("regarding"),
        _optional_reference("related").alias("related"),
        text_or_null(F.col("note")).alias("note"),
        text_or_null(F.col("type")).alias("type"),
        enriched.alias("regardingObject"),
    ]
    count = F.coalesce(F.col("series.count"), F.lit(0))
    observed = rfc3339_micro(F.col("series.lastObservedTime"))
    event_time = rfc3339_micro(F.col("eventTime"))
    series = F.when(F.col("series").isNotNull(), F.struct(count.alias("count"), observed.alias("lastObservedTime")))
    whole = F.to_json(F.struct(*head, event_time.alias("eventTime"), series.alias("series"), *tail))

    series_text = F.concat(
        F.lit('"series":{"count":'), count.cast("string"), F.lit(',"lastObservedTime":'), _text_or_nil(observed), F.lit("}")
    )
    parts = json_object(
        members(F.struct(*head)),
        F.concat(F.lit('"eventTime":'), _text_or_nil(event_time)),
        F.when(F.col("series").isNotNull(), series_text),
        members(F.struct(*tail)),
    )
    unset = F.col("eventTime").isNull() | (F.col("series").isNotNull() & F.col("series.lastObservedTime").isNull())
    return F.when(unset, parts).otherwise(whole)


def _text_or_nil(text: Column) -> Column:
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def json_lines(events: DataFrame) -> DataFrame:
    """Return one ``value`` per event, as the text writers and the console take it."""
    return events.select(to_canonical_json().alias("value"))


# --- Kafka records -----------------------------------------------------------


def kafka_headers(identity: Identity, prefix: str = "agent") -> Column:
    """Return the record headers naming the exporter, empty values left out."""
    pairs = [(name, getattr(identity, name)) for name in ("cluster", "pod", "namespace", "node", "version")]
    headers = [
        F.struct(F.lit(f"{prefix}-{name}").alias("key"), F.lit(value).cast("binary").alias("value"))
        for name, value in pairs
        if value
    ]
    empty = F.array().cast("array<struct<key:string,value:binary>>")
    return F.array(*headers) if headers else empty


def kafka_records(
    events: DataFrame,
    key: str = "uid",
    identity: Identity = Identity(),
    prefix: str = "agent",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Return ``key, value, headers`` rows for Spark's Kafka writer (``includeHeaders``)."""
    if key not in ("uid", "namespace", "none"):
        raise ValueError(f"unknown message key {key!r}, allowed values are uid, namespace, none")
    chosen = F.lit(None).cast("string") if key == "none" else text_or_null(F.col(key))
    return events.select(
        *carry,
        chosen.alias("key"),
        to_canonical_json().alias("value"),
        kafka_headers(identity, prefix).alias("headers"),
    )


# --- CloudEvents -------------------------------------------------------------


def cloudevents(source: str = "event-agent", event_type: str = "io.k8s.event") -> Column:
    """Return the event as one CloudEvents 1.0 document with the canonical event as data."""
    return F.concat(
        F.lit('{"specversion":"1.0","id":'),
        json_quote(F.concat_ws("/", "uid", "resourceVersion")),
        F.lit(f',"source":{_quoted(source)},"type":{_quoted(event_type)},"time":"'),
        rfc3339_trimmed(occurrence_time()),
        F.lit('","datacontenttype":"application/json","data":'),
        to_canonical_json(),
        F.lit("}"),
    )


# --- templates ---------------------------------------------------------------


class TemplateError(ValueError):
    """A template text cannot be compiled."""


def template(text: str, identity: Identity = Identity()) -> Column:
    """Return the text with each ``{{ path }}`` tag replaced by the field, JSON-escaped.

    ``{{ agent.x }}`` tags are constants. Unknown, empty and unclosed tags are refused.
    """
    parts: list[Column] = []
    position = 0
    while (start := text.find("{{", position)) >= 0:
        end = text.find("}}", start + 2)
        if end < 0:
            raise TemplateError(f"unclosed tag at index {start}")
        tag = text[start + 2 : end].strip()
        if not tag:
            raise TemplateError(f"empty tag at index {start}")
        parts.append(F.lit(text[position:start]))
        scope, _, member = tag.partition(".")
        if scope == "agent" and member in Identity.__dataclass_fields__:
            parts.append(F.lit(_quoted(getattr(identity, member))[1:-1]))
        else:
            try:
                parts.append(json_escape(field(tag)))
            except UnknownFieldError as error:
                raise TemplateError(f"unknown tag {tag!r} at index {start}") from error
        position = end + 2
    return F.concat(*parts, F.lit(text[position:]))


# --- GELF --------------------------------------------------------------------

#: A name that a field may be given: no leading underscore, not "id", and none but these characters.
_GELF_NAME = re.compile(r"(?!_|id\Z)[a-z0-9_.\-/]+", re.IGNORECASE)


def _gelf_name(name: str, prefix: str) -> str:
    """Return a field name as it is written, with underscores for slashes."""
    written = name.replace("/", "_")
    if written.startswith(prefix) or not _GELF_NAME.fullmatch(name):
        raise ValueError(f"{name!r} does not fit {_GELF_NAME.pattern!r}, or begins like the fields under {prefix!r}")
    return written


def _gelf_map(prefix: str, entries: Column) -> Column:
    """Return a map as one member per key in key order, NULL for an empty map."""
    renamed = F.transform(
        F.map_entries(sorted_map(entries)),
        lambda entry: F.concat(
            F.lit(f'"{prefix}'),
            F.replace(entry["key"], F.lit("/"), F.lit("_")),
            F.lit('":'),
            json_quote(entry["value"]),
        ),
    )
    return F.nullif(F.array_join(renamed, ","), F.lit(""))


def _seconds_with_millis(time: Column) -> Column:
    """Return a time as seconds with three decimals, rounded from its double value.

    The seconds are taken off before scaling, which keeps every step exact, so
    the rounding sees the very double that the format carries.
    """
    micros = F.unix_micros(time)
    part = F.pmod(micros, F.lit(1_000_000))
    whole = (micros - part) / F.lit(1_000_000)
    double = whole + part * 1000 / F.lit(1e9)
    millis = whole * 1000 + F.rint((double - whole) * 1000)
    return (millis.cast("decimal(20,0)") * F.lit(Decimal("0.001"))).cast("decimal(20,3)")


def gelf(
    host: str = "",
    identity: Identity = Identity(),
    additional: Mapping[str, str] | None = None,
    prefix: str = "agent_",
) -> Column:
    """Return the event as one GELF 1.1 document, without the NUL terminator."""
    count = F.when(F.col("series").isNotNull(), F.col("series.count")).otherwise(F.lit(1))

    def optional(name: str, value: Column) -> Column:
        return text_or_null(value).alias(name)

    document = F.to_json(
        F.struct(
            F.lit("1.1").alias("version"),
            F.lit(host or identity.pod).alias("host"),
            F.coalesce(text_or_null(F.col("reason")), F.lit("-")).alias("short_message"),
            optional("full_message", F.col("note")),
            _seconds_with_millis(occurrence_time()).alias("timestamp"),
            F.when(F.col("type") == "Warning", F.lit(4)).otherwise(F.lit(6)).alias("level"),
            optional("_event_reason", F.col("reason")),
            optional("_event_action", F.col("action")),
            optional("_event_type", F.col("type")),
            count.alias("_event_count"),
            F.when(F.col("series").isNotNull(), rfc3339_trimmed(F.col("eventTime"))).alias("_event_start_time"),
            optional("_event_name", F.col("name")),
            optional("_event_uid", F.col("uid")),
            optional("_event_reporting_controller", F.col("reportingController")),
            optional("_event_reporting_instance", F.col("reportingInstance")),
            optional("_namespace_name", F.col("namespace")),
            optional("_object_kind", F.col("regarding.kind")),
            optional("_object_name", F.col("regarding.name")),
            optional("_object_namespace", F.col("regarding.namespace")),
            optional("_object_uid", F.col("regarding.uid")),
            optional("_object_api_version", F.col("regarding.apiVersion")),
            optional("_object_resource_version", F.col("regarding.resourceVersion")),
            optional("_object_owner_kind", F.col("regardingObject.owner.kind")),
            optional("_object_owner_name", F.col("regardingObject.owner.name")),
            F.col("regardingObject.terminating").alias("_object_terminating"),
        )
    )
    constants = [
        (f"_{prefix}{name}", getattr(identity, name)) for name in ("cluster", "node", "namespace", "pod", "version")
    ]
    constants = [(name, value) for name, value in constants if value]
    constants += [(f"_{_gelf_name(name, prefix)}", value) for name, value in sorted((additional or {}).items())]
    static = ",".join(f'"{name}":{_quoted(value)}' for name, value in constants)
    # Labels and annotations have keys of their own, so they follow as members.
    return F.concat(
        F.concat_ws(
            ",",
            unclosed(document),
            _gelf_map("_object_label_", F.col("regardingObject.labels")),
            _gelf_map("_object_annotation_", F.col("regardingObject.annotations")),
            F.lit(static or None).cast("string"),
        ),
        F.lit("}"),
    )
