"""Wire rows, batches and request bodies."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.catalogue.registry import query
from eventloom.catalogue.shapes import READ_AT, enriched_events, with_objects
from eventloom.catalogue.tables import DOC, ENR, EV, canonical_events, raw_documents, table
from eventloom.operators import batching, export
from eventloom.operators.encode import Identity, cloudevents, gelf, json_lines, kafka_records, template, to_canonical_json
from eventloom.operators.lift import lift
from eventloom.operators.otlp import otlp_compact, otlp_groups, otlp_records
from eventloom.operators.metrics import drop_counts
from eventloom.operators.routing import match, route, route_lines
from eventloom.plans.export import export_drops
from eventloom.plans.spec import Flow
from eventloom.session import shared_folder

IDENTITY = Identity(cluster="prod", node="node-7", namespace="agents", pod="agent-0", version="1.2.3")
SECRET = "whsec_MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY="

MICROS = "'%Y-%m-%dT%H:%M:%S.%fZ'"
API = "shop.example.com/v1"


def _trimmed(time: str) -> str:
    return f"regexp_replace(strftime({time}, {MICROS}), '\\.?0+Z$', 'Z')"


_EVENT_JSON = f"""'{{"uid":"' || uid || '","resourceVersion":"' || rv || '","namespace":"' || namespace
  || '","name":"' || name || '","labels":{{' || CASE WHEN label_k IS NULL THEN '' ELSE '"k":"' || label_k || '",' END
  || '"kind":"' || reason || '"}},"annotations":{{"props":' || to_json(note) || '}},"eventTime":"'
  || strftime(event_time, {MICROS}) || '"'
  || CASE WHEN has_series THEN ',"series":{{"count":' || series_count || ',"lastObservedTime":'
     || coalesce('"' || strftime(series_last, {MICROS}) || '"', 'null') || '}}' ELSE '' END
  || ',"reportingController":"' || controller || '","reportingInstance":"' || instance || '"'
  || CASE WHEN action <> '' THEN ',"action":"' || action || '"' ELSE '' END
  || ',"reason":"' || reason || '","regarding":{{' || CASE WHEN r_kind <> '' THEN '"kind":"' || r_kind || '",' ELSE '' END
  || '"namespace":"' || r_namespace || '","name":"' || r_name || '","uid":"' || r_uid || '","apiVersion":"{API}"}}'
  || CASE WHEN reason = 'purchase' THEN ',"related":{{"kind":"Order","namespace":"' || namespace
     || '","name":"order-' || seq || '","apiVersion":"{API}"}}' ELSE '' END
  || ',"note":' || to_json(note) || ',"type":"' || type || '"'"""

EVENT_JSON = f"({_EVENT_JSON} || '}}')"

ENRICHED_JSON = f"""({_EVENT_JSON}
  || CASE WHEN enrich_result = 'hit' THEN ',"regardingObject":{{"labels":{{"nation":"' || nation || '","segment":"'
     || segment || '"}},"owner":{{"kind":"' || owner_kind || '",'
     || CASE WHEN owner_kind = 'Order' THEN '"namespace":"' || o_namespace || '",' ELSE '' END
     || '"name":"' || nation || '","uid":"n-' || substr(nation, 8) || '","apiVersion":"{API}"}}'
     || CASE WHEN terminating THEN ',"terminating":true' ELSE '' END || '}}' ELSE '' END || '}}')"""


@query(f"WITH {ENR} SELECT uid, {ENRICHED_JSON} AS value FROM enr")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_events(spark, sf_dir).select("uid", to_canonical_json().alias("value"))


@query(
    f"""WITH {DOC} SELECT md5('{{"uid":"' || uid || '","namespace":"lang-' || lang || '","name":"document-' || seq
      || '","labels":{{"band":"' || CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END || '","lang":"' || lang
      || '","size":"' || n_chars || '","source":"' || source
      || '"}},"annotations":{{"kubectl.kubernetes.io/last-applied-configuration":' || to_json(text)
      || ',"lang":"' || lang || '","text":' || to_json(text) || '}},"eventTime":"'
      || strftime(coalesce(event_time, first_ts, TIMESTAMP '{READ_AT}'), {MICROS}) || '"'
      || CASE WHEN dep_count > 1 THEN ',"series":{{"count":' || dep_count || ',"lastObservedTime":'
         || coalesce('"' || strftime(last_ts, {MICROS}) || '"', 'null') || '}}' ELSE '' END
      || ',"reportingController":"' || CASE WHEN controller = '' THEN lang ELSE controller END
      || '","reportingInstance":"' || source || '","reason":"' || source || '","regarding":{{}},"note":'
      || to_json(text) || ',"type":"' || lang || '"}}') AS line FROM doc"""
)
def json_lines_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = json_lines(lift(raw_documents(spark, sf_dir), READ_AT))
    return lines.select(F.md5("value").alias("line"))


@query(
    f"""WITH {EV} SELECT uid AS key, {EVENT_JSON} AS value,
      'agent-cluster=prod,agent-pod=agent-0,agent-namespace=agents,agent-node=node-7,agent-version=1.2.3' AS headers
    FROM ev"""
)
def kafka_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = kafka_records(canonical_events(spark, sf_dir), "uid", IDENTITY)
    texts = F.transform("headers", lambda header: F.concat_ws("=", header["key"], header["value"].cast("string")))
    return records.select("key", "value", F.array_join(texts, ",").alias("headers"))


@query(
    f"""WITH {EV} SELECT uid, '{{"specversion":"1.0","id":"' || uid || '/' || rv || '","source":"shop","type":"shop.event",'
      || '"time":"' || {_trimmed('coalesce(series_last, event_time)')}
      || '","datacontenttype":"application/json","data":' || {EVENT_JSON} || '}}' AS document FROM ev"""
)
def cloudevents_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(spark, sf_dir).select("uid", cloudevents("shop", "shop.event").alias("document"))


TEMPLATE = '{"c":"{{ agent.cluster }}","r":"{{reason}}","n":"{{ note }}","k":"{{ labels.k }}","o":"{{ regarding.name }}"}'


@query(
    f"""WITH {EV} SELECT uid, '{{"c":"prod","r":"' || reason || '","n":"' || trim(to_json(note), '"')
      || '","k":"' || coalesce(label_k, '') || '","o":"' || r_name || '"}}' AS body FROM ev"""
)
def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(spark, sf_dir).select("uid", template(TEMPLATE, IDENTITY).alias("body"))


_OCCURRED = "epoch_us(coalesce(series_last, event_time))"


@query(
    f"""WITH {ENR} SELECT uid, '{{"version":"1.1","host":"agent-0","short_message":"' || reason || '","full_message":'
      || to_json(note) || ',"timestamp":'
      || printf('%.3f', CAST({_OCCURRED} // 1000000 AS DOUBLE) + CAST({_OCCURRED} % 1000000 * 1000 AS DOUBLE) / 1e9)
      || ',"level":' || CASE WHEN type = 'Warning' THEN 4 ELSE 6 END || ',"_event_reason":"' || reason || '"'
      || CASE WHEN action <> '' THEN ',"_event_action":"' || action || '"' ELSE '' END
      || ',"_event_type":"' || type || '","_event_count":' || coalesce(series_count, 1)
      || CASE WHEN has_series THEN ',"_event_start_time":"' || {_trimmed('event_time')} || '"' ELSE '' END
      || ',"_event_name":"' || name || '","_event_uid":"' || uid || '","_event_reporting_controller":"' || controller
      || '","_event_reporting_instance":"' || instance || '","_namespace_name":"' || namespace || '"'
      || CASE WHEN r_kind <> '' THEN ',"_object_kind":"' || r_kind || '"' ELSE '' END
      || ',"_object_name":"' || r_name || '","_object_namespace":"' || r_namespace || '","_object_uid":"' || r_uid
      || '","_object_api_version":"{API}"'
      || CASE WHEN enrich_result = 'hit' THEN ',"_object_owner_kind":"' || owner_kind || '","_object_owner_name":"'
         || nation || '","_object_terminating":' || CASE WHEN terminating THEN 'true' ELSE 'false' END
         || ',"_object_label_nation":"' || nation || '","_object_label_segment":"' || segment || '"' ELSE '' END
      || ',"_agent_cluster":"prod","_agent_node":"node-7","_agent_namespace":"agents","_agent_pod":"agent-0"'
      || ',"_agent_version":"1.2.3","_env":"production"}}' AS document FROM enr"""
)
def gelf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = gelf(identity=IDENTITY, additional={"env": "production"})
    return enriched_events(spark, sf_dir).select("uid", document.alias("document"))


# --- batches -----------------------------------------------------------------

PER_BATCH = 64

# Batches of a fixed number of events per watch.
_COUNTED = f"""cnt AS (
  SELECT ev.*, watch || '-' || ((row_number() OVER (PARTITION BY watch ORDER BY seq) - 1) // {PER_BATCH}) AS batch_id
  FROM ev)"""


def counted_batches(rows: DataFrame) -> DataFrame:
    limits = batching.BatchLimits(max_events=PER_BATCH, max_bytes=0)
    packed = batching.pack_batches(rows, ["watch"], limits)
    return packed.withColumn("batch_id", F.concat_ws("-", "watch", "batch_no"))


@query(
    f"""WITH {EV},{_COUNTED} SELECT batch_id, count(*) AS frames, min(seq) AS first_seq, max(seq) AS last_seq
    FROM cnt GROUP BY batch_id"""
)
def batches_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = counted_batches(canonical_events(spark, sf_dir).select("watch", "seq"))
    return packed.groupBy("batch_id").agg(
        F.count("*").alias("frames"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


def _byte_limits() -> batching.BatchLimits:
    return batching.BatchLimits.for_format(
        "json-list", max_events=12, max_bytes=6000, timeout=dt.timedelta(hours=12)
    )


_PACKED = f"""frm AS (
    SELECT instance, seq, strlen({EVENT_JSON}) AS size, epoch_us(event_time) AS arrived,
      row_number() OVER (PARTITION BY instance ORDER BY seq) AS rn FROM ev),
  pack AS (
    SELECT instance, rn, seq, size, 0 AS batch_no, 1 AS events, size AS payload, arrived AS opened FROM frm WHERE rn = 1
    UNION ALL
    SELECT instance, f.rn, f.seq, f.size,
      CASE WHEN events < 12 AND payload + 1 + f.size <= 5998 AND f.arrived <= opened + 43200000000
           THEN batch_no ELSE batch_no + 1 END,
      CASE WHEN events < 12 AND payload + 1 + f.size <= 5998 AND f.arrived <= opened + 43200000000
           THEN events + 1 ELSE 1 END,
      CASE WHEN events < 12 AND payload + 1 + f.size <= 5998 AND f.arrived <= opened + 43200000000
           THEN payload + 1 + f.size ELSE f.size END,
      CASE WHEN events < 12 AND payload + 1 + f.size <= 5998 AND f.arrived <= opened + 43200000000
           THEN opened ELSE f.arrived END
    FROM pack JOIN frm f USING (instance) WHERE f.rn = pack.rn + 1)"""


_BYTES_SQL = f"""WITH RECURSIVE {EV},{_PACKED} SELECT instance, CAST(batch_no AS BIGINT) AS batch_no, count(*) AS frames,
      CAST(sum(size) AS BIGINT) AS bytes, min(seq) AS first_seq FROM pack GROUP BY 1, 2"""


def _packed_by_bytes(spark: SparkSession, sf_dir: str, **cut) -> DataFrame:
    frames = canonical_events(spark, sf_dir).select(
        F.col("reportingInstance").alias("instance"),
        "seq",
        batching.frame_bytes(to_canonical_json(), "json-list").alias("size"),
        F.unix_micros("eventTime").alias("arrival_us"),
    )
    packed = batching.pack_batches(frames, ["instance"], _byte_limits(), **cut)
    return packed.groupBy("instance", "batch_no").agg(
        F.count("*").alias("frames"), F.sum("size").alias("bytes"), F.min("seq").alias("first_seq")
    )


@query(_BYTES_SQL)
def batches_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack the JSON frames of each reporting instance by count, bytes and time at once."""
    return _packed_by_bytes(spark, sf_dir)


@query(_BYTES_SQL)
def batches_over_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches from segments of 50 rows, so that they cross the borders."""
    return _packed_by_bytes(spark, sf_dir, span=50)


@query(
    f"""WITH {EV},{_COUNTED} SELECT batch_id, count(*) AS frames, min(seq) AS first_seq, count(DISTINCT sha256(watch || chr(31) || 'e1' || chr(31) || split_part(batch_id, '-', 3))) AS ids,
      min(sha256(watch || chr(31) || 'e1' || chr(31) || split_part(batch_id, '-', 3))) AS id FROM cnt GROUP BY batch_id"""
)
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of batches, the same on every attempt; positions are counted over segments of 100 rows."""
    rows = canonical_events(spark, sf_dir).select("watch", "seq")
    packed = batching.pack_batches(rows, ["watch"], batching.BatchLimits(max_events=PER_BATCH, max_bytes=0), span=100)
    named = packed.withColumn("id", batching.batch_id(["watch"], epoch="e1")).withColumn("batch_id", F.concat_ws("-", "watch", "batch_no"))
    return named.groupBy("batch_id").agg(
        F.count("*").alias("frames"), F.min("seq").alias("first_seq"), F.countDistinct("id").alias("ids"), F.min("id").alias("id")
    )


@query(
    """SELECT CASE WHEN strlen(text) = 0 THEN 'rejected' WHEN strlen(text) > 4000 THEN 'too_large'
      ELSE 'queued' END AS fate, count(*) AS frames, CAST(sum(strlen(text)) AS BIGINT) AS bytes
    FROM documents GROUP BY 1"""
)
def drop_too_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = batching.frame_bytes(F.col("text"), "ndjson")
    sized = table(spark, sf_dir, "documents").select(size.alias("size"))
    return sized.groupBy(batching.frame_fate(F.col("size"), 4000).alias("fate")).agg(
        F.count("*").alias("frames"), F.sum("size").alias("bytes")
    )


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(spark, sf_dir).select("watch", "seq", to_canonical_json().alias("frame"))


def _batch_parts(spark: SparkSession, sf_dir: str) -> int:
    return batching.parts_for(table(spark, sf_dir, "events"))


@query(
    f"""WITH {EV},{_COUNTED} SELECT batch_id, count(*) AS frames,
      md5('[' || string_agg({EVENT_JSON}, ',' ORDER BY seq) || ']') AS list_body,
      md5(string_agg({EVENT_JSON}, chr(10) ORDER BY seq) || chr(10)) AS lines_body,
      md5(string_agg({EVENT_JSON}, ';;' ORDER BY seq)) AS template_body FROM cnt GROUP BY batch_id"""
)
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies of three formats from one list of frames a batch."""
    lists = export.batch_lists(counted_batches(_framed(spark, sf_dir)), _batch_parts(spark, sf_dir))
    return lists.select(
        "batch_id",
        "frames",
        F.md5(export.body("frame_list", "json-list")).alias("list_body"),
        F.md5(export.body("frame_list", "ndjson")).alias("lines_body"),
        F.md5(export.body("frame_list", "template", ";;")).alias("template_body"),
    )


def _pad(byte: int) -> str:
    key = export.decode_secret(SECRET).ljust(64, b"\0")
    return "unhex('" + bytes(value ^ byte for value in key).hex() + "')"


@query(
    f"""WITH {EV},{_COUNTED}, req AS (
      SELECT batch_id, '[' || string_agg({EVENT_JSON}, ',' ORDER BY seq) || ']' AS body FROM cnt GROUP BY batch_id),
    msg AS (SELECT batch_id, encode('msg_' || batch_id || '.1717200000.' || body) AS message FROM req)
    SELECT 'msg_' || batch_id AS webhook_id, '1717200000' AS webhook_timestamp,
      'v1,' || to_base64(unhex(sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || message))))) AS webhook_signature
    FROM msg"""
)
def signed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = export.request_bodies(counted_batches(_framed(spark, sf_dir)), "json-list", parts=_batch_parts(spark, sf_dir))
    signed = export.sign_requests(requests, SECRET, F.lit(1717200000))
    return signed.select("webhook_id", "webhook_timestamp", "webhook_signature")


# --- OTLP --------------------------------------------------------------------


def _attribute(key: str, value: str) -> str:
    return f"""'{{"key":"{key}","value":{{"stringValue":"' || {value} || '"}}}}'"""


def _optional(key: str, value: str, condition: str | None = None) -> str:
    return f"CASE WHEN {condition or value + " <> ''"} THEN {_attribute(key, value)} END"


_RESOURCE = f"""'{{"attributes":[' || concat_ws(',',
  {_attribute("service.name", "'event-agent'")}, {_attribute("service.version", "'1.2.3'")},
  {_attribute("k8s.cluster.name", "'prod'")}, {_attribute("k8s.namespace.name", "'agents'")},
  {_attribute("k8s.pod.name", "'agent-0'")}, {_attribute("k8s.node.name", "'node-7'")},
  {_optional("k8s.object.kind", "r_kind")}, {_attribute("k8s.object.name", "r_name")},
  {_attribute("k8s.object.namespace", "r_namespace")}, {_attribute("k8s.object.uid", "r_uid")},
  {_attribute("k8s.object.api_version", f"'{API}'")},
  {_optional("k8s.object.label.nation", "nation", "enrich_result = 'hit'")},
  {_optional("k8s.object.label.segment", "segment", "enrich_result = 'hit'")},
  CASE WHEN enrich_result = 'hit' AND terminating
    THEN '{{"key":"k8s.object.terminating","value":{{"boolValue":true}}}}' END,
  {_optional("k8s.object.owner.kind", "owner_kind", "enrich_result = 'hit'")},
  {_optional("k8s.object.owner.name", "nation", "enrich_result = 'hit'")},
  {_optional("k8s.object.owner.namespace", "o_namespace", "enrich_result = 'hit' AND owner_kind = 'Order'")},
  {_optional("k8s.object.owner.uid", "'n-' || substr(nation, 8)", "enrich_result = 'hit'")},
  {_optional("k8s.object.owner.api_version", f"'{API}'", "enrich_result = 'hit'")}) || ']}}'"""

_RECORD = f"""'{{"timeUnixNano":"' || {_OCCURRED} || '000","observedTimeUnixNano":"1717200000000000000",'
  || '"severityNumber":"' || CASE WHEN type = 'Warning' THEN 'SEVERITY_NUMBER_WARN' ELSE 'SEVERITY_NUMBER_INFO' END
  || '","severityText":"' || type || '","body":{{"stringValue":' || to_json(note) || '}},"attributes":['
  || concat_ws(',', {_attribute("k8s.event.name", "name")}, {_attribute("k8s.event.uid", "uid")},
    {_attribute("k8s.event.namespace", "namespace")}, {_attribute("k8s.event.reason", "reason")},
    {_optional("k8s.event.action", "action")}, {_attribute("k8s.event.reporting_controller", "controller")},
    {_attribute("k8s.event.reporting_instance", "instance")},
    {_optional("k8s.event.start_time", _trimmed("event_time"), "has_series")},
    CASE WHEN series_count > 0 THEN '{{"key":"k8s.event.count","value":{{"intValue":"' || series_count || '"}}}}' END)
  || ']}}'"""

_OTLP = f"""{ENR}, rec AS (
  SELECT uid, seq, {_RESOURCE} AS resource, {_RECORD} AS record,
    watch || '-' || ((row_number() OVER (PARTITION BY watch ORDER BY seq) - 1) // {PER_BATCH}) AS batch_id FROM enr),
  grp AS (
    SELECT batch_id, resource, min(seq) AS first_seq, count(*) AS records,
      string_agg(record, ',' ORDER BY seq) AS log_records FROM rec GROUP BY batch_id, resource)"""


def _otlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = F.lit("2024-06-01 00:00:00").cast("timestamp")
    # Batches by count depend on neither the objects nor the records: narrow rows are numbered, and meet the events by place,
    # so that the texts, several times as wide, are shuffled once only.
    events = canonical_events(spark, sf_dir)
    batches = counted_batches(events.select("watch", "seq")).select("watch", "seq", "batch_id")
    batched = events.join(batches, ["watch", "seq"])
    return otlp_records(with_objects(batched, spark, sf_dir), observed, IDENTITY, carry=("batch_id", "seq"))


@query(f"WITH {_OTLP} SELECT uid, md5(resource) AS resource, record FROM rec")
def otlp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = F.lit("2024-06-01 00:00:00").cast("timestamp")
    records = otlp_records(enriched_events(spark, sf_dir), observed, IDENTITY, carry=("uid",))
    return records.select("uid", F.md5("resource").alias("resource"), "record")


@query(
    f"""WITH {_OTLP} SELECT batch_id, md5(resource) AS resource, first_seq, records, md5(log_records) AS log_records
    FROM grp"""
)
def otlp_resource_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp_groups(_otlp(spark, sf_dir), _batch_parts(spark, sf_dir)).select(
        "batch_id",
        F.md5("resource").alias("resource"),
        "first_seq",
        "records",
        F.md5(F.array_join("log_records", ",")).alias("log_records"),
    )


@query(
    f"""WITH {_OTLP} SELECT batch_id, CAST(sum(records) AS BIGINT) AS records,
      md5('{{"resourceLogs":[' || string_agg('{{"resource":' || resource
        || ',"scopeLogs":[{{"scope":{{"name":"eventloom.otlp","version":"1.2.3"}},"logRecords":[' || log_records || ']}}]}}',
        ',' ORDER BY first_seq) || ']}}') AS body FROM grp GROUP BY batch_id"""
)
def otlp_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = otlp_compact(_otlp(spark, sf_dir), scope_version="1.2.3", parts=_batch_parts(spark, sf_dir))
    return requests.select("batch_id", "records", F.md5("body").alias("body"))


@query(
    f"""WITH {EV} SELECT 'archive' AS sink, count(*) AS frames, CAST(sum(strlen({EVENT_JSON}) + 1) AS BIGINT) AS bytes
    FROM ev
    UNION ALL
    SELECT 'alerts', count(*), CAST(sum(strlen({EVENT_JSON}) + 1) AS BIGINT) FROM ev WHERE type = 'Warning'"""
)
def routed_frame_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sink of two flows would be sent as JSON lines."""
    flows = [
        Flow("everything", sinks=("archive",)),
        Flow("warnings", sinks=("archive", "alerts"), filters=("type = 'Warning'",)),
    ]
    framed = match(canonical_events(spark, sf_dir), flows).select(
        "sinks", batching.frame_bytes(to_canonical_json(), "jsonl").alias("size")
    )
    return route(framed).groupBy("sink").agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"))


@query(
    f"""WITH {EV}, lines AS (
      SELECT 'archive' AS sink, {EVENT_JSON} AS value FROM ev
      UNION ALL SELECT 'alerts', uid || ' ' || reason FROM ev WHERE type = 'Warning'
      UNION ALL SELECT 'pages', name FROM ev WHERE reason = 'view' AND label_k IS NOT NULL AND CAST(label_k AS INT) > 50)
    SELECT sink, count(*) AS lines, CAST(sum(strlen(value)) AS BIGINT) AS bytes, md5(min(value)) AS first_line FROM lines GROUP BY sink"""
)
def routed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three sinks of different formats hold after one pass that writes all of them."""
    flows = [
        Flow("everything", sinks=("archive",)),
        Flow("pages", sinks=("pages", "archive"), filters=("reason = 'view'", "int(labels['k']) > 50")),
        Flow("warnings", sinks=("archive", "alerts"), filters=("type = 'Warning'",)),
    ]
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    documents = {"archive": to_canonical_json(), "alerts": F.concat_ws(" ", "uid", "reason"), "pages": F.col("name")}
    route_lines(match(canonical_events(spark, sf_dir), flows), documents, folder)
    lines = spark.read.schema("value string, sink string").text(folder)
    return lines.groupBy("sink").agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("value")).alias("bytes"), F.md5(F.min("value")).alias("first_line")
    )


@query(
    f"""WITH {EV}, sized AS (SELECT CASE WHEN strlen(note) > 8 THEN 'too_large' WHEN reason = 'view' THEN 'rejected' END AS reason FROM ev)
    SELECT CASE reason WHEN 'too_large' THEN 'queue' ELSE 'sink' END AS stage, reason, '' AS flow, 'webhook' AS sink, count(*) AS events FROM sized WHERE reason IS NOT NULL GROUP BY reason"""
)
def queue_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that no queue takes: the empty ones, and those larger than a whole queue."""
    frame = F.when((F.col("reason") == "view") & (F.octet_length("note") <= 8), F.lit("")).otherwise(F.col("note"))
    return drop_counts(export_drops(canonical_events(spark, sf_dir), frame, "json-list", "webhook", queue_bytes=8))
