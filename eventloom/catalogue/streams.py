"""The event path as a stream over the same tables.

Each query runs the stream until its input is read, into a fresh folder of the
shared one, and returns what was written.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.catalogue.registry import query
from eventloom.catalogue.sampling import INTERVAL_SQL
from eventloom.catalogue.tables import DECLARED, EV, FAIL, FR, KINDS, canonical_events, failures_of, frames, frames_of, objects, streamed, table
from eventloom.operators.batching import BatchLimits
from eventloom.operators.enrich import declared_kinds
from eventloom.operators.metrics import Metric
from eventloom.plans.flow import EventPath
from eventloom.plans.spec import Flow
from eventloom.session import shared_folder
from eventloom.sinks.writers import counters_writer, lines_writer
from eventloom.sources.archive import archive_frames, read_archive
from eventloom.sources.events import Watch
from eventloom.streaming.batches import STATE_STORE, stream_batches as open_batches
from eventloom.streaming.counters import last_totals, running_totals
from eventloom.streaming.run import first_seen_stream, load_positions, load_totals, on_change_stream, per_interval_stream, run_stream

_DELIVERED = f"""{FR}, ev AS (
  SELECT watch, seq, uid, event_type, user_id, event_id FROM fr JOIN events ON event_id = seq
  WHERE frame_type IN ('ADDED', 'MODIFIED'))"""


def _path() -> EventPath:
    return EventPath(
        watches=[Watch(f"team-{number}") for number in range(5)],
        flows=[
            Flow("warnings", ("archive", "counters"), ("type = 'Warning'",)),
            Flow("pages", ("archive",), ("reason = 'view'",), ("team-1", "team-2")),
        ],
        sinks=["archive", "counters"],
        kinds=KINDS,
        declared=declared_kinds(KINDS, DECLARED),
    )


def _run(spark: SparkSession, sf_dir: str) -> str:
    """Run the path to the end of its input and return the folder it wrote to."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run_stream(
        frames_of(streamed(spark, sf_dir, "events")),
        _path(),
        {
            "archive": lines_writer(f"{folder}/archive"),
            "counters": counters_writer(f"{folder}/counters", [Metric("warnings", labels={"ns": "namespace"})]),
        },
        checkpoint=f"{folder}/checkpoint",
        trigger={"availableNow": True},
        objects=lambda: objects(spark, sf_dir),
        positions_folder=f"{folder}/positions",
    ).awaitTermination()
    return folder


@query(
    f"""WITH {_DELIVERED} SELECT uid, event_type AS reason FROM ev
    WHERE event_type = 'error' OR (event_type = 'view' AND watch IN ('team-1', 'team-2'))"""
)
def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.schema("value string").text(f"{_run(spark, sf_dir)}/archive")
    event = F.from_json("value", "uid string, reason string")
    return lines.select(event.alias("e")).select("e.uid", "e.reason")


@query(f"WITH {_DELIVERED} SELECT watch AS namespace, count(*) AS value FROM ev WHERE event_type = 'error' GROUP BY 1")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = load_totals(spark, f"{_run(spark, sf_dir)}/counters")
    return totals.select(F.col("label_values")[0].alias("namespace"), "value")


@query(
    f"""WITH {FR}, ends AS (SELECT watch, min(seq) AS end_seq FROM fr WHERE ends_replay GROUP BY watch)
    SELECT watch, arg_max(rv, seq) AS resource_version FROM fr JOIN ends USING (watch)
    WHERE seq >= end_seq AND rv <> '' GROUP BY watch"""
)
def stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = load_positions(spark, f"{_run(spark, sf_dir)}/positions")
    return stored.filter("resource_version <> ''").select("watch", "resource_version")


def _quarters(rows: DataFrame, seq: str) -> list[DataFrame]:
    """Cut rows into four about equal parts that follow each other."""
    borders = rows.approxQuantile(seq, [0.25, 0.5, 0.75], 0.01)
    return [rows.where((F.col(seq) > low) & (F.col(seq) <= high)) for low, high in zip([float("-inf"), *borders], [*borders, float("inf")])]


def _in_quarters(rows: DataFrame, seq: str, folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Let rows arrive in four micro-batches, each of the files that all tasks write; the stream goes on from its checkpoint."""
    for part in _quarters(rows, seq):
        part.write.mode("append").parquet(folder)
        start(rows.sparkSession.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


def _thinned(spark: SparkSession, sf_dir: str, start: Callable[..., StreamingQuery], *limits) -> DataFrame:
    """Run a gate over the failures in four micro-batches, and return what it wrote."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(admitted: DataFrame, epoch: int) -> None:
        admitted.write.mode("overwrite").parquet(f"{folder}/admitted/epoch={epoch}")

    def thin(arriving: DataFrame) -> StreamingQuery:
        places = {"folder": f"{folder}/gates", "checkpoint": f"{folder}/checkpoint"}
        return start(failures_of(arriving), *limits, write, **places, trigger={"availableNow": True})

    _in_quarters(table(spark, sf_dir, "events"), "event_id", f"{folder}/in", thin)
    return spark.read.parquet(f"{folder}/admitted").select("gate", "seq", "key", "suppressed")


@query(
    f"""{INTERVAL_SQL} SELECT gate, seq, key,
      rn - coalesce(lag(rn) OVER (PARTITION BY gate ORDER BY seq), 0) - 1 AS suppressed FROM w WHERE admitted"""
)
def stream_per_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two records of a kind per hour and gate, over four micro-batches."""
    return _thinned(spark, sf_dir, per_interval_stream, dt.timedelta(hours=1), 2)


_NUMBERED = f"""WITH {FAIL}, n AS (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY seq) AS rn,
  key IS DISTINCT FROM lag(key) OVER (PARTITION BY gate ORDER BY seq) AS changed,
  row_number() OVER (PARTITION BY gate, key ORDER BY seq) = 1 AS first FROM fail)"""


@query(
    f"""{_NUMBERED} SELECT gate, seq, key, rn - coalesce(lag(rn) OVER (PARTITION BY gate ORDER BY seq), 0) - 1 AS suppressed
    FROM n WHERE changed"""
)
def stream_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of key with what was withheld before them, over four micro-batches."""
    return _thinned(spark, sf_dir, on_change_stream)


@query(
    f"""{_NUMBERED}, f AS (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY seq) AS place FROM n WHERE first)
    SELECT gate, seq, key, rn - coalesce(lag(rn) OVER (PARTITION BY gate ORDER BY seq), 0) - 1 AS suppressed FROM f WHERE place <= 3"""
)
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three kinds of each gate with what was withheld before them, over four micro-batches."""
    return _thinned(spark, sf_dir, first_seen_stream, 3)


def _until_read(stream: StreamingQuery, rows: int) -> None:
    """Wait until a stream that never idles has taken in so many rows and written what they gave, then stop it."""
    try:
        while sum(progress["numInputRows"] for progress in stream.recentProgress) < rows:
            if not stream.isActive:
                raise stream.exception() or RuntimeError("the stream ended early")
            time.sleep(0.1)
    finally:
        stream.stop()


#: A packer of small batches, one event after the other.
_STREAMED_LIMITS = BatchLimits(max_events=12, max_bytes=150, separator_bytes=1, fixed_bytes=2)


@query(
    f"""WITH RECURSIVE {EV}, frm AS (
      SELECT instance, seq, strlen(note) AS size, row_number() OVER (PARTITION BY instance ORDER BY seq) AS rn FROM ev),
    pack AS (
      SELECT instance, rn, seq, size, 0 AS batch_no, 1 AS events, size AS payload FROM frm WHERE rn = 1
      UNION ALL
      SELECT instance, f.rn, f.seq, f.size, CASE WHEN events < 12 AND payload + 1 + f.size <= 148 THEN batch_no ELSE batch_no + 1 END,
        CASE WHEN events < 12 AND payload + 1 + f.size <= 148 THEN events + 1 ELSE 1 END,
        CASE WHEN events < 12 AND payload + 1 + f.size <= 148 THEN payload + 1 + f.size ELSE f.size END
      FROM pack JOIN frm f USING (instance) WHERE f.rn = pack.rn + 1),
    g AS (SELECT instance, CAST(batch_no AS BIGINT) AS batch_no, count(*) AS frames, min(seq) AS first_seq, max(seq) AS last_seq
      FROM pack GROUP BY ALL)
    SELECT * FROM g QUALIFY batch_no < max(batch_no) OVER (PARTITION BY instance)"""
)
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that stay open over four micro-batches and a restart; the last of each packer is still open at the end."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").selectExpr(
        "concat('node-', user_id % 20) AS instance", "event_id AS seq", "bigint(octet_length(props)) AS size", "props AS frame"
    )
    quarters = events.approxQuantile("seq", [0.25, 0.5, 0.75], 0.01)
    parts = [events.where((F.col("seq") > low) & (F.col("seq") <= high)) for low, high in zip([float("-inf"), *quarters], [*quarters, float("inf")])]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        for some in (parts[:2], parts[2:]):  # the stream is stopped in between
            rows = 0
            for part in some:
                part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
                rows += part.count()
            arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            closed = open_batches(arriving, ["instance"], _STREAMED_LIMITS)
            sink = closed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
            _until_read(sink.trigger(processingTime="100 milliseconds").start(), rows)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{folder}/out").select(
        "instance",
        "batch_no",
        F.size("frames").cast("bigint").alias("frames"),
        F.array_min("frames.seq").alias("first_seq"),
        F.array_max("frames.seq").alias("last_seq"),
    )


@query(
    f"""WITH {FR} SELECT watch, seq, frame_type, uid, rv AS resource_version FROM fr
    WHERE watch <> 'team-0' OR seq > 2000"""
)
def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived frames as a stream that is stopped and goes on; one watch starts behind a position."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = frames(spark, sf_dir)
    middle = rows.approxQuantile("seq", [0.5], 0.01)[0]
    for some in (rows.where(F.col("seq") <= middle), rows.where(F.col("seq") > middle)):
        archive_frames(some, f"{folder}/archive", file_rows=1500)
        arriving = read_archive(spark, f"{folder}/archive", streaming=True, positions={"team-0": 2000})
        narrow = arriving.select("watch", "seq", "frame_type", "object.uid", F.col("object.resourceVersion").alias("resource_version"))
        sink = narrow.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(
    f"""WITH {EV}, occ AS (
      SELECT seq, 0 AS metric, [namespace, reason] AS labels FROM ev UNION ALL SELECT seq, 1, [r_kind] FROM ev),
    ser AS (SELECT metric, labels, count(*) AS value, min(seq) AS first_seq FROM occ GROUP BY ALL),
    adm AS (SELECT *, row_number() OVER (ORDER BY first_seq, metric) <= 14 AS admitted FROM ser)
    SELECT metric, array_to_string(labels, '/') AS labels, value, false AS refused FROM adm WHERE admitted
    UNION ALL SELECT metric, '', CAST(sum(value) AS BIGINT), true FROM adm WHERE NOT admitted GROUP BY metric"""
)
def stream_counters_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the first 14 series over four micro-batches, and what was refused of each metric."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = canonical_events(spark, sf_dir).select("seq", "namespace", "reason", "regarding")
    metrics = [Metric("reasons", labels={"a_namespace": "namespace", "b_reason": "reason"}), Metric("kinds", labels={"kind": "regarding.kind"})]

    def write(totals: DataFrame, epoch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    def count(arriving: DataFrame) -> StreamingQuery:
        stream = running_totals(arriving, metrics, 14).writeStream.outputMode("update").foreachBatch(write)
        return stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        _in_quarters(events, "seq", f"{folder}/in", count)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    totals = last_totals(spark.read.parquet(f"{folder}/out"))
    return totals.select(F.col("metric_index").alias("metric"), F.array_join("label_values", "/").alias("labels"), "value", "refused")
