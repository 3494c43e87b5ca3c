"""Event counters and delivery accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.catalogue.registry import query
from eventloom.catalogue.tables import ATT, EV, attempts, canonical_events
from eventloom.operators import delivery, metrics
from eventloom.operators.metrics import Metric

METRICS = [
    Metric("total", labels={"namespace": "namespace"}, const_labels={"source": "shop"}),
    Metric("by_node", subsystem="nodes", labels={"node": "reportingInstance", "reason": "reason"}),
    Metric("by_k", namespace="shop", labels={"k": "labels.k"}),
]

_SERIES = f"""WITH {EV}, rows_ AS (
  SELECT seq, 0 AS metric_index, namespace AS a, '' AS b FROM ev
  UNION ALL SELECT seq, 1, instance, reason FROM ev
  UNION ALL SELECT seq, 2, coalesce(label_k, ''), '' FROM ev),
series AS (SELECT metric_index, a, b, count(*) AS value, min(seq) AS first_seq FROM rows_ GROUP BY 1, 2, 3)"""

_NAMED = """CASE metric_index WHEN 0 THEN 'events_total' WHEN 1 THEN 'events_nodes_by_node' ELSE 'shop_by_k' END AS metric,
      CASE metric_index WHEN 0 THEN 'namespace=' || a || ',source=shop' WHEN 1 THEN 'node=' || a || ',reason=' || b
        ELSE 'k=' || a END AS labels, value"""


def _flat(counted: DataFrame) -> DataFrame:
    pairs = F.transform(
        F.array_sort(F.map_entries("labels")), lambda entry: F.concat_ws("=", entry["key"], entry["value"])
    )
    return counted.select("metric", F.array_join(pairs, ",").alias("labels"), "value")


@query(f"{_SERIES} SELECT {_NAMED} FROM series")
def metric_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(metrics.count_metrics(canonical_events(spark, sf_dir), METRICS))


@query(f"{_SERIES} SELECT {_NAMED} FROM (SELECT * FROM series ORDER BY first_seq, metric_index LIMIT 60)")
def metric_max_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(metrics.count_metrics(canonical_events(spark, sf_dir), METRICS, max_series=60, seq="seq"))


@query(
    f"""{_SERIES}, admitted AS (
      SELECT * FROM series WHERE metric_index > 0 ORDER BY first_seq, metric_index LIMIT 60)
    SELECT uid, EXISTS (SELECT 1 FROM admitted WHERE metric_index = 1 AND a = instance AND b = reason)
      OR EXISTS (SELECT 1 FROM admitted WHERE metric_index = 2 AND a = coalesce(label_k, '')) AS delivered FROM ev"""
)
def metric_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a limited sink records."""
    delivered = metrics.metric_delivery(canonical_events(spark, sf_dir), METRICS[1:], 60, "seq")
    return delivered.select("uid", "delivered")


# --- delivery ----------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts(spark, sf_dir).withColumn("result", delivery.http_outcome(F.col("status")))


_FATES = f"""WITH {ATT}, last AS (
  SELECT sink, batch_id, arg_max(result, attempt) AS result, arg_max(frames, attempt) AS frames,
    arg_max(refused, attempt) AS refused, count(*) AS attempts FROM outc GROUP BY sink, batch_id),
fates AS (SELECT sink, batch_id, attempts, frames, greatest(0, least(refused, frames)) AS refused,
  CASE WHEN result = 'success' THEN 'success' WHEN result IN ('permanent', 'oversized') THEN 'permanent_error'
       ELSE 'retry_exhausted' END AS fate FROM last)"""


@query(f"WITH {ATT} SELECT sink, result, count(*) AS attempts FROM outc GROUP BY sink, result")
def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("sink", "result").agg(F.count("*").alias("attempts"))


@query(
    f"""WITH {ATT} SELECT k % 17 AS code, CASE WHEN k % 17 = 0 THEN 'success'
        WHEN k % 17 = 8 AND k % 2 = 1 THEN 'oversized' WHEN k % 17 IN (1, 4, 8, 10, 11, 14, 15) THEN 'retryable'
        ELSE 'permanent' END AS grpc,
      CASE WHEN k % 17 = 0 THEN 'delivered' WHEN k % 17 = 3 THEN 'fatal' WHEN k % 17 IN (2, 10) THEN 'refused'
        ELSE 'pending' END AS kafka, count(*) AS attempts FROM att GROUP BY ALL"""
)
def grpc_and_kafka_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("code")
    judged = attempts(spark, sf_dir).select(
        "code",
        delivery.grpc_outcome(code, F.col("frames") % 2 == 1).alias("grpc"),
        delivery.kafka_record_outcome(code).alias("kafka"),
    )
    return judged.groupBy("code", "grpc", "kafka").agg(F.count("*").alias("attempts"))


@query(f"{_FATES} SELECT sink, batch_id, attempts, frames, refused, fate FROM fates")
def batch_fate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.batch_fate(_judged(spark, sf_dir))


@query(
    f"""{_FATES} SELECT sink, CAST(sum(frames - refused) AS BIGINT) AS delivered,
      CAST(sum(refused) AS BIGINT) AS rejected FROM fates WHERE fate = 'success' GROUP BY sink"""
)
def delivered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.delivered_counts(delivery.batch_fate(_judged(spark, sf_dir)))


@query(
    f"""{_FATES} SELECT 'delivery' AS stage, fate AS reason, '' AS flow, sink, CAST(sum(frames) AS BIGINT) AS events
    FROM fates WHERE fate <> 'success' GROUP BY fate, sink
    UNION ALL
    SELECT 'sink', 'rejected', '', sink, CAST(sum(refused) AS BIGINT) FROM fates
    WHERE fate = 'success' AND refused > 0 GROUP BY sink"""
)
def drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.drop_counts(delivery.delivery_drops(delivery.batch_fate(_judged(spark, sf_dir))))


@query(
    f"""WITH {ATT}, b(le, bound) AS (VALUES ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05),
      ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0), ('2.5', 2.5), ('5.0', 5.0), ('10.0', 10.0),
      ('30.0', 30.0), ('+Inf', 'infinity'::DOUBLE))
    SELECT sink, result, le, count(*) FILTER (WHERE seconds <= CAST(bound AS DOUBLE)) AS attempts, count(*) AS total
    FROM outc CROSS JOIN b GROUP BY sink, result, le"""
)
def send_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = delivery.send_duration_hist(_judged(spark, sf_dir))
    return hist.select("sink", "result", "le", "attempts", F.col("count").alias("total"))


@query(
    f"""WITH {ATT}, p AS (
      SELECT batch_id, attempt, result, frames % 9 + 1 AS n, frames % 40 AS elapsed, frames % 13 AS after FROM outc),
    w AS (SELECT *, greatest(CASE WHEN n = 1 THEN 0.5 ELSE least(0.5 * pow(1.5, n - 1), 10.0) END, after) AS low FROM p)
    SELECT attempt, CAST(round(low * 1000000) AS BIGINT) AS wait_min_us,
      CAST(round(low * 1.5 * 1000000) AS BIGINT) AS wait_max_us,
      result IN ('retryable', 'timeout') AND elapsed + low <= 30 AS may_retry,
      result IN ('retryable', 'timeout') AND elapsed + low * 1.5 <= 30 AS must_retry FROM w"""
)
def backoff_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = _judged(spark, sf_dir).withColumns(
        {
            "attempt_no": F.col("frames") % 9 + 1,
            "elapsed_s": F.col("frames") % 40,
            "retry_after_s": F.col("frames") % 13,
        }
    )
    planned = delivery.backoff_plan(logged)
    return planned.select(
        "attempt",
        F.round(F.col("wait_min_s") * 1_000_000).cast("bigint").alias("wait_min_us"),
        F.round(F.col("wait_max_s") * 1_000_000).cast("bigint").alias("wait_max_us"),
        "may_retry",
        "must_retry",
    )


@query(
    f"""WITH {ATT}, r AS (
      SELECT sink, batch_id, attempt // 100 AS attempt, k % 17 AS code FROM att),
    a AS (SELECT sink, batch_id, attempt, count(*) FILTER (WHERE code IN (2, 10)) AS refused,
      bool_or(code = 3) AS fatal, bool_or(code NOT IN (0, 2, 3, 10)) AS pending FROM r GROUP BY 1, 2, 3),
    s AS (SELECT *, sum(refused) OVER (PARTITION BY sink, batch_id ORDER BY attempt) AS so_far FROM a)
    SELECT sink, batch_id, attempt, CASE WHEN fatal THEN 'permanent' WHEN pending THEN 'retryable'
      ELSE 'success' END AS result, CAST(CASE WHEN fatal OR pending THEN 0 ELSE so_far END AS BIGINT) AS refused FROM s"""
)
def kafka_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = attempts(spark, sf_dir).select(
        "sink", "batch_id", F.floor(F.col("attempt") / 100).alias("attempt"), "code"
    )
    return delivery.kafka_attempts(records)
