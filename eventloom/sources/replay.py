"""Replay rules and watch positions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.times import occurrence_time

# Annotation of the bookmark that ends a replay (fixed value).
INITIAL_EVENTS_END = "k8s.io/initial-events-end"


def comparable_version(version: Column) -> Column:
    """Return whether a resource version is a decimal that can be ordered."""
    return F.coalesce(version.rlike("^[1-9][0-9]*$"), F.lit(False))


def newer_version(version: Column, floor: Column) -> Column:
    """Return whether ``version`` is above ``floor``; digits of any length compare exactly."""
    longer = F.length(version) > F.length(floor)
    same_length = F.length(version) == F.length(floor)
    return longer | (same_length & (version > floor))


def keep_recent(start: dt.datetime | str, max_age: dt.timedelta | None) -> Column:
    """Return whether an event is recent enough for a first replay; no age keeps all."""
    if not max_age:
        return F.lit(True)
    oldest = F.lit(start).cast("timestamp") - F.lit(max_age)
    return occurrence_time() >= oldest


def keep_after(floor: Column) -> Column:
    """Return whether an event was not delivered before the floor was recorded.

    Versions that cannot be compared are kept.
    """
    version = F.col("resourceVersion")
    comparable = comparable_version(version) & comparable_version(floor)
    return ~comparable | newer_version(version, floor)


def replay_max_age(events: DataFrame, start: dt.datetime | str, max_age: dt.timedelta | None) -> DataFrame:
    """Keep the events a first replay delivers."""
    return events.filter(keep_recent(start, max_age))


def with_floor(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Add the stored position of each event's watch as ``floor``, NULL without one.

    There is one position per watch; Spark broadcasts the table when its
    measured size allows and joins by shuffle otherwise.
    """
    floors = positions.select("watch", F.nullif("resource_version", F.lit("")).alias("floor"))
    return events.join(floors, "watch", "left")


def replay_after(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Keep the events newer than their watch's position; a watch without one keeps all."""
    floored = with_floor(events, positions)
    return floored.filter(F.col("floor").isNull() | keep_after(F.col("floor"))).drop("floor")


def resume(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Start each watch at its stored position; a watch without one is read in full."""
    return replay_after(events, positions)


def replay_verdicts(
    events: DataFrame, positions: DataFrame, start: dt.datetime | str, max_age: dt.timedelta | None
) -> DataFrame:
    """Add ``kept``: by position where the watch has one, by age where it has none."""
    floored = with_floor(events, positions)
    kept = F.when(F.col("floor").isNotNull(), keep_after(F.col("floor"))).otherwise(keep_recent(start, max_age))
    return floored.withColumn("kept", kept).drop("floor")


def expiry_replay(
    events: DataFrame, positions: DataFrame, start: dt.datetime | str, max_age: dt.timedelta | None
) -> DataFrame:
    """Replay after an expired position, or from the start for a watch that never had one."""
    return replay_verdicts(events, positions, start, max_age).filter("kept").drop("kept")


def replay_counts(verdicts: DataFrame) -> DataFrame:
    """Count kept and skipped events per watch."""
    return verdicts.groupBy("watch").agg(
        F.count_if("kept").alias("kept"),
        F.count_if(~F.col("kept")).alias("skipped"),
    )


def ends_replay() -> Column:
    """Return whether a frame is the bookmark that ends a replay."""
    marked = F.coalesce(F.col("object.annotations")[F.lit(INITIAL_EVENTS_END)], F.lit("")) == "true"
    return (F.col("frame_type") == "BOOKMARK") & marked


@dataclass(frozen=True)
class ReplayStates:
    """Which watches replay: before some frames, within them, and after; and where a new replay begins."""

    before: frozenset[str]
    within: frozenset[str]
    after: frozenset[str]
    begins: Mapping[str, int]


def replay_states(frames: DataFrame, stored: DataFrame | None, relisted: Iterable[str] = ()) -> ReplayStates:
    """Follow the replays of the watches through some frames.

    A watch replays from its first frame on when no state of it is stored, when
    it is named in ``relisted``, and after an ERROR frame; until the bookmark
    that ends the replay. At most one row a watch is read.
    """
    kept = {} if stored is None else {row["watch"]: row["replaying"] for row in stored.select("watch", "replaying").collect()}
    ends = F.when(ends_replay(), F.col("seq"))
    fails = F.when(F.col("frame_type") == "ERROR", F.col("seq"))
    seen = frames.groupBy("watch").agg(F.max(ends).alias("ended"), F.max(fails).alias("failed")).collect()
    before = {w for w in {*kept, *(row["watch"] for row in seen)} if kept.get(w, True)} | set(relisted)
    within, after, begins = set(before), set(before), {}
    for row in seen:
        watch, ended, failed = row["watch"], row["ended"], row["failed"]
        if failed is not None:
            within.add(watch)
        if failed is not None and (ended is None or ended < failed):
            after.add(watch)
            begins[watch] = failed
        elif ended is not None:
            after.discard(watch)
    return ReplayStates(frozenset(before), frozenset(within), frozenset(after), begins)


def positions_after(frames: DataFrame, stored: DataFrame | None, states: ReplayStates) -> DataFrame:
    """Return ``watch, resource_version, replaying`` after some frames; a position stays as it is during a replay."""
    spark = frames.sparkSession
    for watch, seq in states.begins.items():  # what follows is a replay that has not ended
        frames = frames.filter((F.col("watch") != watch) | (F.col("seq") < seq))
    waiting = {w for w in states.within if w in states.before or w not in states.begins}
    known = stored if stored is None else stored.select("watch", "resource_version")
    live = (set() if stored is None else {row["watch"] for row in stored.select("watch").collect()}) - waiting
    moved = positions(frames, known, waiting, live)
    flags = spark.createDataFrame(
        [(w, w in states.after) for w in sorted({*states.before, *states.within, *states.after, *live})], "watch string, replaying boolean"
    )
    return flags.join(moved, "watch", "full_outer").select(
        "watch", F.coalesce("resource_version", F.lit("")).alias("resource_version"), F.coalesce("replaying", F.lit(False)).alias("replaying")
    )


def positions(
    frames: DataFrame, previous: DataFrame | None = None, replaying: Iterable[str] = (), live: Iterable[str] = ()
) -> DataFrame:
    """Return the position of each watch after the given frames.

    A watch without a previous position that is not named in ``live``, or one
    named in ``replaying``, moves only from the bookmark that ends its replay on. The last version overall
    counts exactly when it is not before that bookmark, so one partial
    aggregation of numbers per watch is enough; the versions of the few last
    frames are looked up then.
    """
    version = F.col("object.resourceVersion")
    moving = frames.filter(F.col("frame_type").isin("ADDED", "MODIFIED", "DELETED", "BOOKMARK"))
    bounds = moving.groupBy("watch").agg(
        F.max(F.when(version != "", F.col("seq"))).alias("last_seq"),
        F.min(F.when(ends_replay(), F.col("seq"))).alias("end_seq"),
    )
    versions = moving.filter(version != "").select(F.col("watch").alias("_of"), F.col("seq").alias("_at"), version.alias("last_version"))
    last = bounds.join(versions, F.col("watch").eqNullSafe(F.col("_of")) & (F.col("last_seq") == F.col("_at")), "left").drop("_of", "_at")
    ended = F.col("last_seq") >= F.col("end_seq")
    if previous is None:
        return last.filter(ended).select("watch", F.col("last_version").alias("resource_version"))
    known = previous.select("watch", F.nullif("resource_version", F.lit("")).alias("known"))
    replaying = list(replaying)
    going = F.col("known").isNotNull() | F.col("watch").isin(list(live))
    if replaying:
        going = going & ~F.col("watch").isin(replaying)
    moved = F.when(going | F.coalesce(ended, F.lit(False)), F.col("last_version"))
    return (
        last.join(known, "watch", "full_outer")
        .select("watch", F.coalesce(moved, F.col("known")).alias("resource_version"))
        .filter(F.col("resource_version").isNotNull())
    )


def changed_positions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Return the watches whose position appeared, moved or was forgotten.

    No rows means the stored state is current and the write can be skipped.
    The stored state is replaced as a whole, never merged.
    """
    before = old.select("watch", F.col("resource_version").alias("old_version"))
    after = new.select("watch", F.col("resource_version").alias("new_version"))
    return before.join(after, "watch", "full_outer").filter(
        ~F.col("old_version").eqNullSafe(F.col("new_version"))
    )
