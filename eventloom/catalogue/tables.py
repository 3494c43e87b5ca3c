"""The star-schema tables as cluster events, objects, frames and attempts.

Each table here has the same definition in Spark and as a SQL common table
expression, so that the operators on top of it can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.operators.enrich import Kind
from eventloom.schema import EVENT, OBJECT, RAW_EVENT

GROUP = "shop.example.com"
KINDS = [
    Kind("customers", GROUP, "Customer", True),
    Kind("orders", GROUP, "Order", True),
    Kind("nations", GROUP, "Nation", False),
]
DECLARED = ["customers." + GROUP, "nations." + GROUP]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as(rows: DataFrame, schema: StructType) -> list[Column]:
    """Return the columns of a schema; those a table lacks are NULL, and equal types are not cast."""
    columns = []
    for field in schema.fields:
        column = F.col(field.name) if field.name in rows.columns else F.lit(None)
        if field.name not in rows.columns or rows.schema[field.name].dataType.simpleString() != field.dataType.simpleString():
            column = column.cast(field.dataType)
        columns.append(column.alias(field.name))
    return columns


_K = "get_json_object(props, '$.k')"

_REGARDING = """named_struct(
    'kind', CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN 'Order' ELSE 'Customer' END,
    'namespace', CASE WHEN event_id % 11 = 0 THEN 'other' ELSE concat('team-', user_id % 5) END,
    'name', concat('customer-', user_id),
    'uid', CASE WHEN event_id % 13 = 0 THEN 'stale' ELSE concat('c-', user_id) END,
    'apiVersion', 'shop.example.com/v1',
    'resourceVersion', '',
    'fieldPath', '')"""


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return ``events`` as canonical events, with ``watch`` and ``seq``."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "concat('team-', user_id % 5) AS watch",
        "event_id AS seq",
        "concat('ev-', event_id) AS uid",
        f"CASE WHEN {_K} = '7' THEN concat('x', event_id) ELSE string(event_id + 1000) END AS resourceVersion",
        "concat('team-', user_id % 5) AS namespace",
        "concat('event-', event_id) AS name",
        f"CASE WHEN event_id % 5 = 0 THEN map('kind', event_type) ELSE map('kind', event_type, 'k', {_K}) END AS labels",
        "map('props', props) AS annotations",
        "CAST(ts AS TIMESTAMP) AS eventTime",
        """CASE WHEN event_id % 7 = 0 THEN named_struct(
             'count', int(event_id % 50),
             'lastObservedTime',
             CASE WHEN event_id % 14 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) + INTERVAL 1 MINUTE END) END AS series""",
        "concat('controller-', event_id % 3) AS reportingController",
        "concat('node-', user_id % 20) AS reportingInstance",
        "CASE event_type WHEN 'purchase' THEN 'Buying' WHEN 'click' THEN 'Clicking' ELSE '' END AS action",
        "event_type AS reason",
        f"{_REGARDING} AS regarding",
        """CASE WHEN event_type = 'purchase' THEN named_struct(
             'kind', 'Order', 'namespace', concat('team-', user_id % 5), 'name', concat('order-', event_id),
             'uid', '', 'apiVersion', 'shop.example.com/v1', 'resourceVersion', '', 'fieldPath', '') END AS related""",
        "props AS note",
        "CASE WHEN event_type = 'error' THEN 'Warning' ELSE 'Normal' END AS type",
    )
    return rows.select("watch", "seq", *_as(rows, EVENT))


EV = """
ev AS (
  SELECT 'team-' || (user_id % 5) AS watch, event_id AS seq, user_id, 'ev-' || event_id AS uid,
    json_extract_string(props, '$.k') AS k,
    CASE WHEN json_extract_string(props, '$.k') = '7' THEN 'x' || event_id
         ELSE CAST(event_id + 1000 AS VARCHAR) END AS rv,
    'team-' || (user_id % 5) AS namespace, 'event-' || event_id AS name,
    CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') END AS label_k,
    ts AS event_time, event_id % 7 = 0 AS has_series,
    CASE WHEN event_id % 7 = 0 THEN event_id % 50 END AS series_count,
    CASE WHEN event_id % 7 = 0 AND event_id % 14 <> 0 THEN ts + INTERVAL 1 MINUTE END AS series_last,
    'controller-' || (event_id % 3) AS controller, 'node-' || (user_id % 20) AS instance,
    CASE event_type WHEN 'purchase' THEN 'Buying' WHEN 'click' THEN 'Clicking' ELSE '' END AS action,
    event_type AS reason,
    CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN 'Order' ELSE 'Customer' END AS r_kind,
    CASE WHEN event_id % 11 = 0 THEN 'other' ELSE 'team-' || (user_id % 5) END AS r_namespace,
    'customer-' || user_id AS r_name,
    CASE WHEN event_id % 13 = 0 THEN 'stale' ELSE 'c-' || user_id END AS r_uid,
    props AS note, CASE WHEN event_type = 'error' THEN 'Warning' ELSE 'Normal' END AS type, value
  FROM events
)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return ``events`` as watch frames."""
    return frames_of(table(spark, sf_dir, "events"))


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Return a table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def frames_of(events: DataFrame) -> DataFrame:
    """Return rows of ``events`` as watch frames."""
    rows = events.selectExpr(
        "concat('team-', user_id % 5) AS watch",
        "event_id AS seq",
        """CASE WHEN event_type = 'signup' THEN 'BOOKMARK' WHEN event_type = 'view' THEN 'MODIFIED'
             WHEN value < 5 THEN 'DELETED' ELSE 'ADDED' END AS frame_type""",
        f"""CASE WHEN event_type = 'signup' AND int({_K}) >= 50
              THEN map('k8s.io/initial-events-end', 'true') ELSE map('props', props) END AS annotations""",
        f"""CASE WHEN {_K} = '9' THEN '' WHEN {_K} = '7' THEN concat('x', event_id)
              ELSE string(event_id + 1000) END AS resourceVersion""",
        "concat('ev-', event_id) AS uid",
        "concat('team-', user_id % 5) AS namespace",
        "concat('event-', event_id) AS name",
        "CAST(ts AS TIMESTAMP) AS eventTime",
        "event_type AS reason",
        "props AS note",
        "CASE WHEN event_type = 'error' THEN 'Warning' ELSE 'Normal' END AS type",
        f"{_REGARDING} AS regarding",
    )
    return rows.select("watch", "seq", "frame_type", F.struct(*_as(rows, RAW_EVENT)).alias("object"))


FR = """
fr AS (
  SELECT 'team-' || (user_id % 5) AS watch, event_id AS seq,
    CASE WHEN event_type = 'signup' THEN 'BOOKMARK' WHEN event_type = 'view' THEN 'MODIFIED'
         WHEN value < 5 THEN 'DELETED' ELSE 'ADDED' END AS frame_type,
    event_type = 'signup' AND CAST(json_extract_string(props, '$.k') AS INT) >= 50 AS ends_replay,
    CASE json_extract_string(props, '$.k') WHEN '9' THEN '' WHEN '7' THEN 'x' || event_id
         ELSE CAST(event_id + 1000 AS VARCHAR) END AS rv,
    'ev-' || event_id AS uid, ts
  FROM events
)"""


def stored_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return a stored position per region's watch; the last region has none."""
    return table(spark, sf_dir, "region").selectExpr(
        "concat('team-', r_regionkey) AS watch",
        "CASE WHEN r_regionkey = 4 THEN '' ELSE string(1000 + 1000 * r_regionkey) END AS resource_version",
    )


POS = """
pos AS (
  SELECT 'team-' || r_regionkey AS watch,
    CASE WHEN r_regionkey = 4 THEN '' ELSE CAST(1000 + 1000 * r_regionkey AS VARCHAR) END AS resource_version
  FROM region
)"""


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return ``documents`` as raw events written through the deprecated fields, the whole text as note."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS seq",
        "concat('doc-', doc_id) AS uid",
        "concat('lang-', lang) AS namespace",
        "concat('document-', doc_id) AS name",
        "CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' + make_interval(0, 0, 0, 0, 0, int(doc_id % 1000), 0) END AS eventTime",
        "CASE WHEN doc_id % 3 = 1 THEN TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, int(doc_id % 1000), 0) END AS deprecatedFirstTimestamp",
        "CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' END AS deprecatedLastTimestamp",
        "int(doc_id % 4) AS deprecatedCount",
        "CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS reportingController",
        "named_struct('component', lang, 'host', source) AS deprecatedSource",
        "text AS note",
        "source AS reason",
        "lang AS type",
        """map('lang', lang, 'source', source, 'size', string(n_chars),
               'band', CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END) AS labels""",
        """map('text', text, 'kubectl.kubernetes.io/last-applied-configuration', text, 'lang', lang) AS annotations""",
    )
    return rows.select("seq", *_as(rows, RAW_EVENT))


DOC = """
doc AS (
  SELECT doc_id AS seq, 'doc-' || doc_id AS uid, lang, source, text, n_chars,
    CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-02-01' + to_minutes(CAST(doc_id % 1000 AS INT)) END AS event_time,
    CASE WHEN doc_id % 3 = 1 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id % 1000 AS INT)) END AS first_ts,
    CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-03-01' END AS last_ts,
    doc_id % 4 AS dep_count,
    CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS controller
  FROM documents
)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return the customers as live objects owned by their nation; those in debt go by a name that no event regards."""
    rows = (
        table(spark, sf_dir, "customer")
        .selectExpr(
            f"'{GROUP}' AS group",
            "'Customer' AS kind",
            "concat('team-', c_custkey % 5) AS namespace",
            "concat(CASE WHEN c_acctbal < 0 THEN 'debtor-' ELSE 'customer-' END, c_custkey) AS name",
            "concat('c-', c_custkey) AS uid",
            "map('segment', c_mktsegment, 'nation', concat('nation-', c_nationkey)) AS labels",
            "map('title', c_name) AS annotations",
            "CASE WHEN c_acctbal > 9000 THEN TIMESTAMP '2024-01-01 00:00:00' END AS deletionTimestamp",
            f"""array(
                  named_struct('apiVersion', 'v1', 'kind', 'Team', 'name', 'team', 'uid', 't', 'controller', false),
                  named_struct('apiVersion', '{GROUP}/v1', 'kind',
                    CASE WHEN c_mktsegment = 'BUILDING' THEN 'Order' ELSE 'Nation' END,
                    'name', concat('nation-', c_nationkey), 'uid', concat('n-', c_nationkey), 'controller', true)
                ) AS ownerReferences""",
        )
    )
    return rows.select(*_as(rows, OBJECT))


OBJ = """
obj AS (
  SELECT 'team-' || (c_custkey % 5) AS o_namespace,
    CASE WHEN c_acctbal < 0 THEN 'debtor-' ELSE 'customer-' END || c_custkey AS o_name, 'c-' || c_custkey AS o_uid,
    c_mktsegment AS segment, 'nation-' || c_nationkey AS nation, c_name AS title, c_acctbal > 9000 AS terminating,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'Order' ELSE 'Nation' END AS owner_kind
  FROM customer
)"""

# Events joined to their objects, as the enrichment rules say.
ENR = f"""{EV},{OBJ},
enr AS (
  SELECT ev.*, obj.*,
    CASE WHEN r_kind = '' OR r_name = '' THEN 'skipped'
         WHEN r_kind = 'Order' THEN 'undeclared'
         WHEN r_namespace <> namespace THEN 'cross_namespace'
         WHEN o_uid IS NULL OR o_uid <> r_uid THEN 'miss' ELSE 'hit' END AS enrich_result
  FROM ev LEFT JOIN obj ON o_namespace = r_namespace AND o_name = r_name
)"""


def object_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return ``orders`` as a change log of customer objects; a pending order deletes its customer."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS seq",
        "CASE WHEN o_orderstatus = 'P' THEN 'DELETED' ELSE 'MODIFIED' END AS change",
        f"'{GROUP}' AS group",
        "'Customer' AS kind",
        "concat('team-', o_custkey % 5) AS namespace",
        "concat('customer-', o_custkey) AS name",
        "concat('c-', o_custkey) AS uid",
        "o_orderpriority AS priority",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return ``events`` as a log of delivery attempts, a batch per user and day."""
    return table(spark, sf_dir, "events").selectExpr(
        """CASE event_type WHEN 'error' THEN 'webhook' WHEN 'purchase' THEN 'otlp'
             WHEN 'click' THEN 'kafka' ELSE 'gelf' END AS sink""",
        "concat('b-', user_id, '-', date_format(ts, 'yyyyMMdd')) AS batch_id",
        "event_id AS attempt",
        f"bigint({_K}) + 1 AS frames",
        "bigint(floor(value)) - 5 AS refused",
        f"""CASE WHEN int({_K}) < 60 THEN 200 WHEN int({_K}) < 70 THEN 503 WHEN int({_K}) < 80 THEN 429
              WHEN int({_K}) < 85 THEN 413 WHEN int({_K}) < 90 THEN 501 WHEN int({_K}) < 95 THEN 404
              ELSE 408 END AS status""",
        f"int({_K}) % 17 AS code",
        "value / 10 AS seconds",
    )


ATT = """
att AS (
  SELECT CASE event_type WHEN 'error' THEN 'webhook' WHEN 'purchase' THEN 'otlp'
           WHEN 'click' THEN 'kafka' ELSE 'gelf' END AS sink,
    'b-' || user_id || '-' || strftime(ts, '%Y%m%d') AS batch_id, event_id AS attempt,
    CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS frames,
    CAST(floor(value) AS BIGINT) - 5 AS refused,
    CAST(json_extract_string(props, '$.k') AS INT) AS k, value / 10 AS seconds
  FROM events
),
outc AS (
  SELECT *, CASE WHEN k < 60 THEN 'success' WHEN k < 80 THEN 'retryable' WHEN k < 85 THEN 'oversized'
    WHEN k < 95 THEN 'permanent' ELSE 'retryable' END AS result
  FROM att
)"""


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return ``events`` as failure records, a gate per controller."""
    return failures_of(table(spark, sf_dir, "events"))


def failures_of(events: DataFrame) -> DataFrame:
    """Return rows of ``events`` as failure records."""
    return events.selectExpr(
        "concat('controller-', event_id % 3) AS gate",
        "event_id AS seq",
        "CAST(ts AS TIMESTAMP) AS ts",
        "event_type AS key",
    )


FAIL = """
fail AS (
  SELECT 'controller-' || (event_id % 3) AS gate, event_id AS seq, ts, event_type AS key FROM events
)"""
