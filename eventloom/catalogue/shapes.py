"""Lifting, sanitising, field addressing and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.catalogue.registry import query
from eventloom.catalogue.tables import (
    DECLARED,
    DOC,
    ENR,
    EV,
    GROUP,
    KINDS,
    OBJ,
    canonical_events,
    object_changes,
    objects,
    raw_documents,
)
from eventloom.catalogue.tables import table
from eventloom.functions.fields import field, get_or, has
from eventloom.functions.text import truncate_bytes, valid_utf8
from eventloom.functions.times import rfc3339_micro
from eventloom.operators import enrich as enrichment
from eventloom.operators.lift import lift
from eventloom.operators.sanitize import SanitizeSpec, sanitize
from eventloom.schema import OBJECT

READ_AT = "2024-06-01 00:00:00"
MICROS = "'%Y-%m-%dT%H:%M:%S.%fZ'"


def _longest_prefix(text: str, limit: int) -> str:
    """SQL for the longest prefix of at most ``limit`` bytes."""
    return (
        f"CASE WHEN strlen({text}) <= {limit} THEN {text} ELSE left({text}, list_max(list_filter(range(0, {limit + 1}),"
        f" lambda n: strlen(left(left({text}, {limit}), n)) <= {limit}))) END"
    )


def with_objects(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    projected = enrichment.project_objects(objects(spark, sf_dir), KINDS)
    return enrichment.enrich(events, projected, enrichment.declared_kinds(KINDS, DECLARED))


def enriched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_objects(canonical_events(spark, sf_dir), spark, sf_dir)


@query(
    f"""WITH {DOC} SELECT uid,
      strftime(coalesce(event_time, first_ts, TIMESTAMP '{READ_AT}'), {MICROS}) AS event_time,
      CASE WHEN dep_count > 1 THEN CAST(dep_count AS INT) ELSE 0 END AS series_count,
      CASE WHEN dep_count > 1 THEN coalesce(strftime(last_ts, {MICROS}), 'unset') ELSE '' END AS series_last,
      CASE WHEN controller = '' THEN lang ELSE controller END AS controller, source AS instance,
      md5(text) AS note FROM doc"""
)
def lift_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift(raw_documents(spark, sf_dir), READ_AT).select(
        "uid",
        rfc3339_micro(F.col("eventTime")).alias("event_time"),
        F.coalesce("series.count", F.lit(0)).alias("series_count"),
        F.when(F.col("series").isNull(), "")
        .otherwise(F.coalesce(rfc3339_micro(F.col("series.lastObservedTime")), F.lit("unset")))
        .alias("series_last"),
        F.col("reportingController").alias("controller"),
        F.col("reportingInstance").alias("instance"),
        F.md5("note").alias("note"),
    )


@query(
    """SELECT doc_id, md5(chr(65533) || left(text, length(text) - 1)
      || CASE WHEN strlen(right(text, 1)) > 1 THEN chr(65533) ELSE '' END) AS repaired FROM documents"""
)
def repair_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage every text at both ends, the last character by its last byte, and repair it."""
    data = F.col("text").cast("binary")
    kept = F.octet_length("text") - F.when(F.octet_length(F.right("text", F.lit(1))) > 1, 1).otherwise(
        F.octet_length(F.right("text", F.lit(1)))
    )
    damaged = F.concat(F.unhex(F.lit("FFFE")), F.substring(data, F.lit(1), kept)).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(valid_utf8(damaged)).alias("repaired"))


@query(
    f"""WITH {DOC}, cut AS (SELECT uid, {_longest_prefix('text', 1024)} AS note,
      {_longest_prefix('text', 301)} AS short FROM doc)
    SELECT uid, strlen(note) AS note_bytes, md5(note) AS note, strlen(short) AS short_bytes, md5(short) AS short
    FROM cut"""
)
def truncate_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    note, short = truncate_bytes(F.col("text"), 1024), truncate_bytes(F.col("text"), 301)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("uid"),
        F.octet_length(note).cast("bigint").alias("note_bytes"),
        F.md5(note).alias("note"),
        F.octet_length(short).cast("bigint").alias("short_bytes"),
        F.md5(short).alias("short"),
    )


@query(
    f"""WITH {DOC} SELECT uid, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE '' END AS type,
      'band,lang' AS label_keys, 'lang' AS annotation_keys,
      md5({_longest_prefix('text', 1024)}) AS note FROM doc"""
)
def sanitize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SanitizeSpec(
        allowed_values={"type": ["en", "fr"]}, max_labels=2, max_annotations=1, max_annotation_bytes=64
    )
    clean = sanitize(lift(raw_documents(spark, sf_dir), READ_AT), spec)
    return clean.select(
        "uid",
        "type",
        F.array_join(F.array_sort(F.map_keys("labels")), ",").alias("label_keys"),
        F.array_join(F.array_sort(F.map_keys("annotations")), ",").alias("annotation_keys"),
        F.md5("note").alias("note"),
    )


@query(
    f"""WITH {DOC}, cut AS (SELECT uid, {_longest_prefix('text', 64)} AS value FROM doc)
    SELECT uid, strlen(value) AS bytes, md5(value) AS value FROM cut"""
)
def annotation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = sanitize(lift(raw_documents(spark, sf_dir), READ_AT), SanitizeSpec(max_annotation_bytes=64))
    value = F.col("annotations")["text"]
    return clean.select("uid", F.octet_length(value).cast("bigint").alias("bytes"), F.md5(value).alias("value"))


@query(
    f"""WITH {EV} SELECT CASE WHEN reason IN ('click', 'error') THEN reason ELSE '' END AS reason,
      CASE WHEN action IN ('Buying') THEN action ELSE '' END AS action, '' AS instance,
      count(*) AS events FROM ev GROUP BY 1, 2"""
)
def field_values_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SanitizeSpec(
        allowed_values={"reason": ["click", "error"], "action": ["Buying"], "reportingInstance": []}
    )
    clean = sanitize(canonical_events(spark, sf_dir), spec)
    return clean.groupBy("reason", "action", F.col("reportingInstance").alias("instance")).agg(
        F.count("*").alias("events")
    )


@query(
    f"""WITH {EV} SELECT uid, coalesce(label_k, '') AS label_k,
      coalesce(CAST(series_count AS VARCHAR), '') AS series_count,
      coalesce(strftime(series_last, {MICROS}), '') AS series_last,
      strftime(event_time, {MICROS}) AS event_time, r_name AS regarding_name,
      CASE WHEN reason = 'purchase' THEN 'Order' ELSE '' END AS related_kind,
      'false' AS terminating, '' AS owner_kind FROM ev"""
)
def field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(spark, sf_dir).select(
        "uid",
        field("labels.k").alias("label_k"),
        field("series.count").alias("series_count"),
        field("series.lastObservedTime").alias("series_last"),
        field("eventTime").alias("event_time"),
        field("regarding.name").alias("regarding_name"),
        field("related.kind").alias("related_kind"),
        field("regardingObject.terminating").alias("terminating"),
        field("regardingObject.owner.kind").alias("owner_kind"),
    )


@query(
    f"""WITH {EV} SELECT uid, label_k IS NOT NULL AS has_k, has_series AS has_series,
      CASE WHEN NOT has_series THEN 'error' WHEN series_count <> 0 THEN 'true' ELSE 'false' END AS has_count, action <> '' AS has_action,
      coalesce(label_k, 'none') AS k_or_none FROM ev"""
)
def has_and_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(spark, sf_dir).select(
        "uid",
        has("labels.k").alias("has_k"),
        has("series").alias("has_series"),
        F.coalesce(has("series.count").cast("string"), F.lit("error")).alias("has_count"),
        has("action").alias("has_action"),
        get_or("labels.k", "none").alias("k_or_none"),
    )


@query(f"""WITH {ENR} SELECT enrich_result, count(*) AS events FROM enr GROUP BY 1""")
def enrich_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.enrich_counts(enriched_events(spark, sf_dir))


@query(
    f"""WITH {ENR} SELECT uid, enrich_result, CASE WHEN enrich_result = 'hit' THEN segment ELSE '' END AS segment,
      CASE WHEN enrich_result = 'hit' THEN owner_kind ELSE '' END AS owner_kind,
      CASE WHEN enrich_result = 'hit' AND owner_kind = 'Order' THEN o_namespace ELSE '' END AS owner_namespace,
      CASE WHEN enrich_result = 'hit' AND terminating THEN 'true' ELSE 'false' END AS terminating FROM enr"""
)
def enriched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_events(spark, sf_dir).select(
        "uid",
        "enrich_result",
        field("regardingObject.labels.segment").alias("segment"),
        field("regardingObject.owner.kind").alias("owner_kind"),
        field("regardingObject.owner.namespace").alias("owner_namespace"),
        field("regardingObject.terminating").alias("terminating"),
    )


@query(
    f"""WITH {OBJ} SELECT o_uid AS uid, segment, title, owner_kind,
      CASE WHEN owner_kind = 'Order' THEN o_namespace ELSE '' END AS owner_namespace, terminating FROM obj"""
)
def project_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected = enrichment.project_objects(
        objects(spark, sf_dir),
        KINDS,
        labels=enrichment.Allowlist(keys=("segment",)),
        annotations=enrichment.Allowlist(keys=("title", "none")),
    )
    found = F.col("regardingObject")
    return projected.select(
        "uid",
        found["labels"]["segment"].alias("segment"),
        found["annotations"]["title"].alias("title"),
        found["owner"]["kind"].alias("owner_kind"),
        found["owner"]["namespace"].alias("owner_namespace"),
        found["terminating"].alias("terminating"),
    )


@query(
    """SELECT 'customer-' || o_custkey AS name, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders
    GROUP BY o_custkey HAVING arg_max(o_orderstatus, o_orderkey) <> 'P'"""
)
def latest_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.latest_objects(object_changes(spark, sf_dir)).select("name", "priority")


@query(
    f"""WITH {EV}, chg AS (SELECT 'customer-' || o_custkey AS c_name, 'team-' || (o_custkey % 5) AS c_namespace,
      o_orderkey AS c_at, o_orderstatus, o_orderpriority, o_orderdate FROM orders),
    lk AS (SELECT *, seq * 6 AS at, CASE WHEN r_kind = '' THEN 'skipped' WHEN r_kind = 'Order' THEN 'undeclared'
      WHEN r_namespace <> namespace THEN 'cross_namespace' END AS barred FROM ev),
    met AS (SELECT lk.*, chg.* FROM lk ASOF LEFT JOIN chg
      ON chg.c_name = lk.r_name AND chg.c_namespace = lk.r_namespace AND lk.at >= chg.c_at)
    SELECT uid, CASE WHEN barred IS NOT NULL THEN barred WHEN c_at IS NULL OR o_orderstatus = 'P' OR r_uid = 'stale'
        THEN 'miss' ELSE 'hit' END AS enrich_result,
      CASE WHEN barred IS NULL AND o_orderstatus <> 'P' AND r_uid <> 'stale' THEN o_orderpriority ELSE '' END AS priority,
      CASE WHEN barred IS NULL AND o_orderstatus <> 'P' AND r_uid <> 'stale' THEN CAST(c_at AS VARCHAR) ELSE '' END AS version
    FROM met"""
)
def enrich_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the state its customer had when it was read; segments of 1,000 rows, so that states cross borders."""
    log = object_changes(spark, sf_dir).withColumns(
        {
            "at": F.col("seq"),
            "labels": F.create_map(F.lit("priority"), "priority", F.lit("version"), F.col("seq").cast("string")),
            "annotations": F.create_map().cast("map<string,string>"),
            "deletionTimestamp": F.lit(None).cast("timestamp"),
            "ownerReferences": F.array().cast(OBJECT["ownerReferences"].dataType),
        }
    )
    projected = enrichment.project_objects(log, KINDS, carry=("at", "seq", "change"))
    events = canonical_events(spark, sf_dir).withColumn("at", F.col("seq") * 6)
    found = enrichment.enrich_as_of(events, projected, enrichment.declared_kinds(KINDS, DECLARED), event_id=("uid", "seq"), span=1000)
    return found.select(
        "uid", "enrich_result", field("regardingObject.labels.priority").alias("priority"), field("regardingObject.labels.version").alias("version")
    )


@query(
    f"""WITH {EV},{OBJ}, hot AS (SELECT uid, seq % 10 < 3 AS is_hot, CASE WHEN seq % 10 < 3 THEN 'team-1' ELSE namespace END AS ns,
        CASE WHEN seq % 10 < 3 THEN 'Customer' ELSE r_kind END AS kind, CASE WHEN seq % 10 < 3 THEN 'team-1' ELSE r_namespace END AS r_ns,
        CASE WHEN seq % 10 < 3 THEN 'customer-1' ELSE r_name END AS name, CASE WHEN seq % 10 < 3 THEN '' ELSE r_uid END AS r_uid FROM ev)
    SELECT uid, CASE WHEN kind = '' THEN 'skipped' WHEN kind = 'Order' THEN 'undeclared' WHEN r_ns <> ns THEN 'cross_namespace'
        WHEN o_uid IS NULL OR (r_uid <> '' AND o_uid <> r_uid) THEN 'miss' ELSE 'hit' END AS enrich_result,
      CASE WHEN kind NOT IN ('', 'Order') AND r_ns = ns AND (r_uid = '' OR o_uid = r_uid) THEN coalesce(segment, '') ELSE '' END AS segment
    FROM hot LEFT JOIN obj ON o_namespace = r_ns AND o_name = name"""
)
def enrich_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tenths of the events regard one customer, which is found and spread."""
    hot = F.col("seq") % 10 < 3
    regarding = F.col("regarding").withField("kind", F.lit("Customer")).withField("namespace", F.lit("team-1"))
    regarding = regarding.withField("name", F.lit("customer-1")).withField("uid", F.lit(""))
    events = canonical_events(spark, sf_dir).withColumns(
        {"namespace": F.when(hot, F.lit("team-1")).otherwise(F.col("namespace")), "regarding": F.when(hot, regarding).otherwise(F.col("regarding"))}
    )
    projected = enrichment.unique_objects(enrichment.project_objects(objects(spark, sf_dir), KINDS))
    found = enrichment.enrich_spread(events, projected, enrichment.declared_kinds(KINDS, DECLARED))
    return found.select("uid", "enrich_result", field("regardingObject.labels.segment").alias("segment"))


@query(
    f"""WITH {ENR}, l AS (SELECT enrich_result AS outcome, seq,
        CASE WHEN enrich_result = 'undeclared' THEN '{GROUP}' ELSE namespace END AS subject,
        CASE WHEN enrich_result = 'undeclared' THEN r_kind ELSE r_namespace END AS detail,
        row_number() OVER (PARTITION BY enrich_result ORDER BY seq) AS n
      FROM enr WHERE enrich_result IN ('undeclared', 'cross_namespace')),
    f AS (SELECT outcome, subject, detail, min(seq) AS seq, min(n) AS n FROM l GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY seq) AS place FROM f)
    SELECT outcome, subject, detail, seq, n - coalesce(lag(n) OVER (PARTITION BY outcome ORDER BY seq), 0) - 1 AS suppressed
    FROM r WHERE place <= 3"""
)
def lookup_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three uncovered look-ups of each outcome, and how many came between them."""
    return enrichment.lookup_reports(enriched_events(spark, sf_dir), limit=3)


@query(
    """SELECT 'nation-' || n_regionkey AS name, CASE WHEN n_regionkey = 2 THEN '' ELSE 'shop.example.com' END AS "group",
      'Nation' || n_regionkey AS kind, n_regionkey % 2 = 0 AS namespaced
    FROM nation WHERE n_regionkey IN (0, 2, 3) GROUP BY n_regionkey"""
)
def declared_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that resource names stand for, read from a discovery table; one name stands for nothing."""
    discovered = table(spark, sf_dir, "nation").selectExpr(
        "concat('nation-', n_regionkey) AS resource",
        "CASE WHEN n_regionkey = 2 THEN '' ELSE 'shop.example.com' END AS group",
        "concat('Nation', n_regionkey) AS kind",
        "n_regionkey % 2 = 0 AS namespaced",
    )
    names = ["nation-0.shop.example.com", "nation-2", "nation-3.shop.example.com", "nation-9"]
    kinds = enrichment.declared_kinds(enrichment.load_kinds(discovered, names), names)
    rows = [(kind.resource, kind.group, kind.kind, kind.namespaced) for kind in kinds]
    return spark.createDataFrame(rows, "name string, group string, kind string, namespaced boolean")
