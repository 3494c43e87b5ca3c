"""Fixed schemas shared by every operator.

Strings and maps of a canonical event are never NULL (absent is the empty
value); absent sub-objects are NULL structs. Times are TIMESTAMP and the
session time zone has to be UTC (see :func:`eventloom.session.use_utc`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())

REFERENCE_FIELDS = ("kind", "namespace", "name", "uid", "apiVersion", "resourceVersion", "fieldPath")

REFERENCE = T.StructType([T.StructField(name, T.StringType()) for name in REFERENCE_FIELDS])

SERIES = T.StructType(
    [
        T.StructField("count", T.IntegerType()),
        T.StructField("lastObservedTime", T.TimestampType()),
    ]
)

REGARDING_OBJECT = T.StructType(
    [
        T.StructField("labels", STRING_MAP),
        T.StructField("annotations", STRING_MAP),
        T.StructField("owner", REFERENCE),
        T.StructField("terminating", T.BooleanType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("resourceVersion", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("labels", STRING_MAP),
        T.StructField("annotations", STRING_MAP),
        T.StructField("eventTime", T.TimestampType()),
        T.StructField("series", SERIES),
        T.StructField("reportingController", T.StringType()),
        T.StructField("reportingInstance", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("regarding", REFERENCE),
        T.StructField("related", REFERENCE),
        T.StructField("note", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("regardingObject", REGARDING_OBJECT),
    ]
)

EVENT_COLUMNS = tuple(EVENT.names)

# Raw event objects: the modern fields plus the deprecated ones they replaced.
RAW_EVENT = T.StructType(
    [field for field in EVENT.fields if field.name != "regardingObject"]
    + [
        T.StructField(
            "deprecatedSource",
            T.StructType([T.StructField("component", T.StringType()), T.StructField("host", T.StringType())]),
        ),
        T.StructField("deprecatedFirstTimestamp", T.TimestampType()),
        T.StructField("deprecatedLastTimestamp", T.TimestampType()),
        T.StructField("deprecatedCount", T.IntegerType()),
    ]
)

FRAME = T.StructType(
    [
        T.StructField("watch", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("frame_type", T.StringType()),
        T.StructField("object", RAW_EVENT),
    ]
)

OWNER_REFERENCE = T.StructType(
    [
        T.StructField("apiVersion", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("uid", T.StringType()),
        T.StructField("controller", T.BooleanType()),
    ]
)

OBJECT = T.StructType(
    [
        T.StructField("group", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("uid", T.StringType()),
        T.StructField("labels", STRING_MAP),
        T.StructField("annotations", STRING_MAP),
        T.StructField("deletionTimestamp", T.TimestampType()),
        T.StructField("ownerReferences", T.ArrayType(OWNER_REFERENCE)),
    ]
)

ATTEMPT = T.StructType(
    [
        T.StructField("sink", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("attempt", T.LongType()),
        T.StructField("frames", T.LongType()),
        T.StructField("refused", T.LongType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("retry_after_s", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("result", T.StringType()),
    ]
)


def empty_map() -> Column:
    """Return an empty map<string,string>."""
    return F.create_map().cast("map<string,string>")


def reference(**fields: Column) -> Column:
    """Build an object reference; fields not given are empty strings."""
    unknown = set(fields) - set(REFERENCE_FIELDS)
    if unknown:
        raise ValueError(f"unknown reference fields: {sorted(unknown)}")
    return F.struct(*[fields.get(name, F.lit("")).alias(name) for name in REFERENCE_FIELDS])
