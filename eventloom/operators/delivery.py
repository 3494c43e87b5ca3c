"""Outcomes and accounting over a log of delivery attempts."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUCCESS = "success"
RETRYABLE = "retryable"
PERMANENT = "permanent"
TIMEOUT = "timeout"
OVERSIZED = "oversized"

# Upper bounds of the send-duration buckets in seconds (fixed values).
SEND_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)

# gRPC codes a client may send again after (fixed values).
RETRYABLE_GRPC = (1, 4, 10, 11, 14, 15)
RESOURCE_EXHAUSTED = 8

# Kafka error codes of a record a broker never accepts (fixed values): message
# too large, record list too large, invalid record, invalid timestamp, corrupt.
REFUSED_KAFKA = (10, 18, 87, 32, 2)

# Kafka error codes that concern the connection or the topic (fixed values):
# SASL authentication failed, unsupported mechanism, illegal SASL state, topic
# and cluster authorization failed, invalid acks, invalid topic, unknown topic
# or partition, unknown topic id.
FATAL_KAFKA = (58, 33, 34, 29, 31, 21, 17, 3, 100)


def http_outcome(status: Column, timed_out: Column | None = None) -> Column:
    """Return the outcome of an HTTP response status."""
    answered = (
        F.when(status.between(200, 299), F.lit(SUCCESS))
        .when(status == 413, F.lit(OVERSIZED))
        .when(status.isin(408, 429) | ((status >= 500) & (status != 501)), F.lit(RETRYABLE))
        .when(status.isNull(), F.lit(RETRYABLE))
        .otherwise(F.lit(PERMANENT))
    )
    return _or_timeout(answered, timed_out)


def grpc_outcome(code: Column, has_retry_info: Column, timed_out: Column | None = None) -> Column:
    """Return the outcome of a gRPC status code; throttling with a retry hint is retryable."""
    answered = (
        F.when(code == 0, F.lit(SUCCESS))
        .when((code == RESOURCE_EXHAUSTED) & ~has_retry_info, F.lit(OVERSIZED))
        .when((code == RESOURCE_EXHAUSTED) | code.isin(*RETRYABLE_GRPC) | code.isNull(), F.lit(RETRYABLE))
        .otherwise(F.lit(PERMANENT))
    )
    return _or_timeout(answered, timed_out)


def kafka_record_outcome(code: Column) -> Column:
    """Return what becomes of a record: ``delivered``, ``refused``, ``fatal`` or ``pending``."""
    return (
        F.when(code == 0, F.lit("delivered"))
        .when(code.isin(*FATAL_KAFKA), F.lit("fatal"))
        .when(code.isin(*REFUSED_KAFKA), F.lit("refused"))
        .otherwise(F.lit("pending"))
    )


def _or_timeout(answered: Column, timed_out: Column | None) -> Column:
    return answered if timed_out is None else F.when(timed_out, F.lit(TIMEOUT)).otherwise(answered)


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Return the positive delay of a Retry-After header, a count or an HTTP date; else NULL."""
    count = F.when(header.rlike(r"^[+]?\d+$"), header.try_cast("bigint"))
    date = F.try_to_timestamp(
        F.regexp_extract(header, r"^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1),
        F.lit("dd MMM yyyy HH:mm:ss"),
    )
    delay = F.coalesce(count.cast("double"), (F.unix_micros(date) - F.unix_micros(now)) / F.lit(1_000_000))
    return F.when(delay > 0, delay)


def batch_fate(attempts: DataFrame) -> DataFrame:
    """Return the end of each batch: the outcome of its last attempt decides.

    Retrying until the last attempt is ``retry_exhausted``; a refusal for size
    counts as a ``permanent_error``.
    """
    last = attempts.groupBy("sink", "batch_id").agg(
        F.max(F.struct("attempt", "result", "frames", "refused")).alias("last"),
        F.count("*").alias("attempts"),
    )
    fate = (
        F.when(F.col("last.result") == SUCCESS, F.lit(SUCCESS))
        .when(F.col("last.result").isin(PERMANENT, OVERSIZED), F.lit("permanent_error"))
        .otherwise(F.lit("retry_exhausted"))
    )
    return last.select(
        "sink", "batch_id", "attempts", fate.alias("fate"), F.col("last.frames").alias("frames"),
        F.greatest(F.lit(0), F.least(F.col("last.refused"), F.col("last.frames"))).cast("bigint").alias("refused"),
    )


def delivered_counts(fates: DataFrame) -> DataFrame:
    """Count delivered and rejected events per sink; refusals are held to the batch."""
    return (
        fates.filter(F.col("fate") == SUCCESS)
        .groupBy("sink")
        .agg(F.sum(F.col("frames") - F.col("refused")).alias("delivered"), F.sum("refused").alias("rejected"))
    )


def delivery_drops(fates: DataFrame) -> DataFrame:
    """Return the drop rows of batches that failed, and of records refused in accepted ones."""
    failed = F.col("fate") != SUCCESS
    return (
        fates.select(
            F.when(failed, F.lit("delivery")).otherwise(F.lit("sink")).alias("stage"),
            F.when(failed, F.col("fate")).otherwise(F.lit("rejected")).alias("reason"),
            F.lit("").alias("flow"),
            "sink",
            F.when(failed, F.col("frames")).otherwise(F.col("refused")).alias("events"),
        )
        .filter(F.col("events") > 0)
    )


def send_duration_hist(attempts: DataFrame, buckets: tuple[float, ...] = SEND_BUCKETS) -> DataFrame:
    """Return a cumulative histogram of send seconds per sink and outcome: one row per bound, +Inf last.

    One aggregation computes every bucket; the bounds are unpivoted from its few rows.
    """
    counts = [F.count_if(F.col("seconds") <= bound).alias(f"_le_{i}") for i, bound in enumerate(buckets)]
    totals = attempts.groupBy("sink", "result").agg(
        *counts, F.count("*").alias("count"), F.sum("seconds").alias("sum_seconds")
    )
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_le_{i}").alias("attempts")) for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("attempts")))
    return totals.select("sink", "result", "count", "sum_seconds", F.inline(F.array(*rows)))


@dataclass(frozen=True)
class RetryPolicy:
    """Exponential backoff within a budget; a wait gets up to half its length on top."""

    enabled: bool = True
    timeout: dt.timedelta = dt.timedelta(seconds=30)
    initial: dt.timedelta = dt.timedelta(milliseconds=500)
    multiplier: float = 1.5
    maximum: dt.timedelta = dt.timedelta(seconds=10)

    def interval(self, attempt: Column) -> Column:
        """Return the backoff in seconds after a 1-based attempt, before any jitter."""
        grown = F.lit(self.initial.total_seconds()) * F.pow(F.lit(self.multiplier), attempt - 1)
        # The first wait is not held to the maximum; growth is.
        return F.when(attempt <= 1, F.lit(self.initial.total_seconds())).otherwise(
            F.least(grown, F.lit(self.maximum.total_seconds()))
        )


def backoff_plan(attempts: DataFrame, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """Add the least and greatest wait after each attempt, and whether another one may follow.

    ``elapsed_s`` is the time since the batch's first attempt when this one
    ended, ``retry_after_s`` the delay the destination asked for, and
    ``attempt_no`` counts from one.
    """
    low = F.greatest(policy.interval(F.col("attempt_no")), F.coalesce(F.col("retry_after_s"), F.lit(0)).cast("double"))
    budget = F.lit(policy.timeout.total_seconds())
    may_retry = F.lit(policy.enabled) & F.col("result").isin(RETRYABLE, TIMEOUT)
    return attempts.withColumns(
        {
            "wait_min_s": low,
            "wait_max_s": low * 1.5,
            "may_retry": may_retry & (F.col("elapsed_s") + low <= budget),
            "must_retry": may_retry & (F.col("elapsed_s") + low * 1.5 <= budget),
        }
    )


def kafka_attempts(records: DataFrame) -> DataFrame:
    """Reduce produced records ``sink, batch_id, attempt, code`` to one row per attempt.

    A fatal record fails the batch, a pending one makes it retryable. Records
    settled by an attempt are not sent again, so refusals add up over the
    attempts of a batch.
    """
    outcome = kafka_record_outcome(F.col("code"))
    attempts = records.groupBy("sink", "batch_id", "attempt").agg(
        F.count_if(outcome == "refused").alias("_refused"),
        F.max(outcome == "fatal").alias("_fatal"),
        F.max(outcome == "pending").alias("_pending"),
    )
    so_far = Window.partitionBy("sink", "batch_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    result = (
        F.when(F.col("_fatal"), F.lit(PERMANENT)).when(F.col("_pending"), F.lit(RETRYABLE)).otherwise(F.lit(SUCCESS))
    )
    refused = F.when(result == SUCCESS, F.sum("_refused").over(so_far)).otherwise(F.lit(0))
    return attempts.select("sink", "batch_id", "attempt", result.alias("result"), refused.alias("refused"))
