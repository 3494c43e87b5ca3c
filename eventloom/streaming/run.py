"""Running an event path as a stream.

Delivery is at least once: a micro-batch that is run again after a failure
hands the same rows, with the same epoch, to the writers.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators.filters import RuleError, check_rules
from eventloom.operators.metrics import Metric, check_metrics, series, valid_values
from eventloom.operators.routing import route, route_write
from eventloom.operators.sampling import first_seen, interval_states, on_change, per_interval, with_suppressed
from eventloom.plans.flow import EventPath
from eventloom.plans.spec import Flow, accepted_flows
from eventloom.operators.segments import with_segment
from eventloom.scratch import keep, scratch
from eventloom.session import shared_folder
from eventloom.sources.replay import ReplayStates, positions_after, replay_states, replay_verdicts

Writer = Callable[[DataFrame, int], None]


def run_stream(
    frames: DataFrame,
    path: EventPath,
    writers: Mapping[str, Writer],
    checkpoint: str | None = None,
    trigger: Mapping[str, object] | None = None,
    objects: Callable[[], DataFrame] | None = None,
    flows: Callable[[], Sequence[Flow]] | None = None,
    positions_folder: str | None = None,
    max_age: dt.timedelta | None = None,
    relisted: Sequence[str] = (),
) -> StreamingQuery:
    """Start the event path on a stream of frames.

    ``objects`` and ``flows`` are read at the start of every micro-batch, so a
    batch sees one snapshot of the objects and one set of rules; where a new
    rule is refused, the rules before it stay, and :func:`load_refused` tells. Watch
    positions are written after the sinks, only when some position moved.
    With a ``positions_folder``, a watch that replays delivers only what is newer than its position, or, where it
    never had one, no older than ``max_age``; ``relisted`` names watches whose input starts with a replay although
    they have a position. Offsets go to ``checkpoint``, by default a folder of the cluster's shared
    one named after the sinks, so that a restart finds it again.
    """
    spark = frames.sparkSession
    if unserved := set(path.sinks) ^ set(writers):
        raise ValueError(f"sinks and writers differ: {', '.join(sorted(unserved))}")
    for flow in path.flows:
        check_rules(spark, flow.filters)
    if checkpoint is None:
        checkpoint = f"{shared_folder(spark)}/events-{'-'.join(sorted(writers))}"

    rules = {"current": list(path.flows)}

    def deliver(batch: DataFrame, epoch: int) -> None:
        current = path.flows
        if flows:
            offered = flows()
            current, accepted = accepted_flows(spark, rules["current"], offered)
            rules["current"] = current
            if not accepted:
                save_refused(spark, f"{checkpoint}-refused", epoch, offered)
        started = read_time(spark, f"{checkpoint}-read-times", epoch)
        stored = load_positions(spark, positions_folder, below=epoch) if positions_folder else None
        states = replay_states(batch, stored, relisted if epoch == 0 else ()) if positions_folder else None
        keep = (lambda lifted: _newer(lifted, stored, states, started, max_age)) if states else None
        events = path.events(batch, F.lit(started), objects() if objects else None, keep)
        with scratch(spark):
            routed = route(path.matched(events, current))
            route_write(routed, {sink: _bound(write, epoch) for sink, write in writers.items()})
        if positions_folder:
            save_positions(spark, batch, positions_folder, epoch, states)

    return (
        frames.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def _newer(
    lifted: DataFrame, stored: DataFrame | None, states: ReplayStates, started: dt.datetime, max_age: dt.timedelta | None
) -> DataFrame:
    """Drop what replaying watches have delivered before; live watches deliver everything."""
    if not states.within:
        return lifted
    known = stored or lifted.sparkSession.createDataFrame([], "watch string, resource_version string")
    judged = replay_verdicts(lifted, known, started.strftime("%Y-%m-%d %H:%M:%S.%f"), max_age)
    return judged.filter(F.col("kept") | ~F.col("watch").isin(sorted(states.within))).drop("kept")


def _bound(write: Writer, epoch: int) -> Callable[[DataFrame], None]:
    return lambda rows: write(rows, epoch)


# --- refused rules -----------------------------------------------------------

_REFUSED = "epoch bigint, flow string, rules array<string>, refused boolean"


def save_refused(spark: SparkSession, folder: str, epoch: int, flows: Sequence[Flow]) -> None:
    """Write down a set of rules that a micro-batch refused, and which of its flows were at fault."""
    rows = []
    for flow in flows:
        try:
            check_rules(spark, flow.filters)
            refused = False
        except RuleError:
            refused = True
        rows.append((epoch, flow.name, [str(rule) for rule in flow.filters], refused))
    spark.createDataFrame(rows, _REFUSED).coalesce(1).write.mode("overwrite").parquet(f"{folder}/part={epoch}")


def load_refused(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Return the refused rule sets of a stream: ``epoch, flow, rules, refused``; no rows while none was."""
    folder = f"{checkpoint}-refused"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(folder)):
        return spark.createDataFrame([], _REFUSED)
    return spark.read.schema(_REFUSED).option("recursiveFileLookup", "true").parquet(folder)


# --- versioned state tables --------------------------------------------------


def _latest_version(spark: SparkSession, folder: str, below: int | None = None) -> str | None:
    """Return the newest complete version of a state table, or None."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    versions = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("epoch=") and files.exists(hadoop(status.getPath(), "_SUCCESS")):
            versions.append(int(name.removeprefix("epoch=")))
    versions = [version for version in versions if below is None or version < below]
    return f"{folder}/epoch={max(versions)}" if versions else None


def _prune(spark: SparkSession, folder: str, epoch: int, kept: int = 2) -> None:
    """Delete the versions of a state table that no epoch can start from any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(root)]
    versions = sorted(int(name.removeprefix("epoch=")) for name in names if name.startswith("epoch="))
    for version in [v for v in versions if v <= epoch][:-kept]:
        files.delete(hadoop(f"{folder}/epoch={version}"), True)


def read_time(spark: SparkSession, folder: str, epoch: int) -> dt.datetime:
    """Return when an epoch was first read; run again, it has the time of its first run."""
    version = f"{folder}/epoch={epoch}"
    now = spark.createDataFrame([(dt.datetime.now(dt.timezone.utc),)], "at timestamp")
    now.coalesce(1).write.mode("ignore").parquet(version)
    _prune(spark, folder, epoch)
    return spark.read.schema("at timestamp").parquet(version).first()["at"]


def load_positions(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame | None:
    """Return the stored positions, or None when there are none yet."""
    version = _latest_version(spark, folder, below)
    return spark.read.schema("watch string, resource_version string, replaying boolean").parquet(version) if version else None


def save_positions(
    spark: SparkSession, frames: DataFrame, folder: str, epoch: int, states: ReplayStates | None = None
) -> bool:
    """Write the positions after a batch of frames, and return whether they or the replays changed.

    During a replay the old position stays. A new state replaces the old one
    as a whole, in a version of its own; it has a row for each watch.
    """
    stored = load_positions(spark, folder, below=epoch)
    states = states or replay_states(frames, stored)
    rows = sorted(map(tuple, positions_after(frames, stored, states).collect()))
    if rows == ([] if stored is None else sorted(map(tuple, stored.collect()))):
        return False
    moved = spark.createDataFrame(rows, "watch string, resource_version string, replaying boolean")
    moved.coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
    _prune(spark, folder, epoch)
    return True


# --- counters ----------------------------------------------------------------


def running_counts(events: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """Count events per series on a stream; run it in update or complete mode."""
    return series(events, metrics)


_TOTALS = "metric_index int, label_values array<string>, value bigint, first_epoch bigint, first_seq bigint"


def count_limited(
    spark: SparkSession,
    events: DataFrame,
    epoch: int,
    folder: str,
    metrics: Sequence[Metric],
    max_series: int,
    seq: str = "seq",
) -> DataFrame:
    """Add a micro-batch to the totals of the admitted series, and return the totals.

    Series admitted earlier stay; new ones take what is left of the limit in
    the order they occur. The totals hold at most ``max_series`` rows; a series
    with a value that is no valid text takes its place and is not reported. A
    batch run again starts from the same earlier version.
    """
    check_metrics(metrics)
    earlier = _stored_totals(spark, folder, below=epoch)
    batch = series(events, metrics, seq).select(
        "metric_index",
        "label_values",
        "value",
        F.lit(epoch).cast("bigint").alias("first_epoch"), "first_seq"
    )
    if earlier is not None:
        batch = earlier.unionByName(batch)
    totals = (
        batch.groupBy("metric_index", "label_values")
        .agg(F.sum("value").alias("value"), F.min(F.struct("first_epoch", "first_seq")).alias("first"))
        .select("metric_index", "label_values", "value", "first.first_epoch", "first.first_seq")
    )
    if max_series:
        totals = totals.orderBy("first_epoch", "first_seq", "metric_index").limit(max_series)
    totals.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
    _prune(spark, folder, epoch)
    return load_totals(spark, folder, epoch + 1)


def _stored_totals(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame | None:
    version = _latest_version(spark, folder, below)
    return spark.read.schema(_TOTALS).parquet(version) if version else None


def load_totals(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame | None:
    """Return the newest totals of :func:`count_limited`, or None when there are none yet."""
    totals = _stored_totals(spark, folder, below)
    return None if totals is None else totals.filter(valid_values(F.col("label_values")))


# --- rate-limited records ----------------------------------------------------

_GATES = "gate string, key string, since bigint, count bigint, pending bigint"

#: Thin a batch, given the states before it; and the states after it.
Thin = Callable[[DataFrame, DataFrame | None], DataFrame]


def _gate_stream(
    rows: DataFrame,
    thin: Thin,
    after: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame],
    write: Writer,
    folder: str,
    checkpoint: str,
    trigger: Mapping[str, object] | None,
) -> StreamingQuery:
    """Thin a stream of records ``gate, seq, ts, key`` and hand on the admitted ones with ``suppressed``.

    Each micro-batch runs the batch operators, so that a hot gate is spread
    over tasks here too. What a gate carries on are a few rows of a state table
    in ``folder``, with a version per epoch; an epoch run again starts from the
    same earlier version.
    """
    spark = rows.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        version = _latest_version(spark, folder, below=epoch)
        states = spark.read.schema(_GATES).parquet(version) if version else None
        with scratch(spark):
            segmented = with_segment(batch, ["gate"])
            flagged = keep(thin(segmented, states), "flagged")
            waiting = None if states is None else states.select("gate", "pending").distinct()
            reported = with_suppressed(flagged, pending=waiting)
            write(reported.drop("admitted"), epoch)
            tallied = [flagged.select("gate", F.when(F.col("admitted"), 0).otherwise(1).alias("pending"))]
            tallied.append(reported.select("gate", -F.col("suppressed")))
            if waiting is not None:
                tallied.append(waiting)
            pending = reduce(DataFrame.union, tallied).groupBy("gate").agg(F.sum("pending").alias("pending"))
            found = after(segmented, flagged, states).join(pending, "gate")
            found.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
            _prune(spark, folder, epoch)

    return (
        rows.withColumn("gate", F.col("gate").cast("string"))
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def per_interval_stream(
    rows: DataFrame,
    interval: dt.timedelta,
    threshold: int,
    write: Writer,
    folder: str,
    checkpoint: str,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Admit up to ``threshold`` rows of a key per interval, on a stream; see :func:`per_interval`."""

    def after(batch: DataFrame, _: DataFrame, states: DataFrame | None) -> DataFrame:
        return interval_states(batch, interval, states=states)

    return _gate_stream(
        rows, lambda batch, states: per_interval(batch, interval, threshold, states=states), after, write, folder, checkpoint, trigger
    )


def _key_states(rows: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return rows.select("gate", "key", zero.alias("since"), zero.alias("count"))


def on_change_stream(
    rows: DataFrame, write: Writer, folder: str, checkpoint: str, trigger: Mapping[str, object] | None = None
) -> StreamingQuery:
    """Admit the rows whose key differs from the gate's previous one, on a stream; a gate carries its last key on."""

    def after(batch: DataFrame, _: DataFrame, states: DataFrame | None) -> DataFrame:
        last = batch.groupBy("gate").agg(F.max("seq").alias("seq"))
        newest = batch.join(last, ["gate", "seq"])
        if states is not None:
            newest = newest.select("gate", "key").union(states.join(last, "gate", "left_anti").select("gate", "key"))
        return _key_states(newest)

    return _gate_stream(rows, lambda batch, states: on_change(batch, states=states), after, write, folder, checkpoint, trigger)


def first_seen_stream(
    rows: DataFrame, limit: int, write: Writer, folder: str, checkpoint: str, trigger: Mapping[str, object] | None = None
) -> StreamingQuery:
    """Admit the first row of each gate's first ``limit`` distinct keys, on a stream; a gate carries on which those are."""

    def after(_: DataFrame, flagged: DataFrame, states: DataFrame | None) -> DataFrame:
        seen = flagged.where("admitted").select("gate", "key")
        return _key_states(seen if states is None else seen.union(states.select("gate", "key")))

    return _gate_stream(rows, lambda batch, states: first_seen(batch, limit, states), after, write, folder, checkpoint, trigger)
