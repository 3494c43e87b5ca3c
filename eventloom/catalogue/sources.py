"""Selectors, frames, replay and positions."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.catalogue.registry import query
from eventloom.catalogue.tables import EV, FR, POS, canonical_events, frames, stored_positions
from eventloom.functions.times import occurrence_time, rfc3339_micro
from eventloom.operators.lift import lift
from eventloom.operators.metrics import read_counts
from eventloom.session import shared_folder
from eventloom.sources import events as source
from eventloom.sources import replay

START = dt.datetime(2024, 1, 30, tzinfo=dt.timezone.utc)
MAX_AGE = dt.timedelta(days=10)

# The same instant in SQL.
OLDEST = "TIMESTAMP '2024-01-20 00:00:00'"

OCCURRED = "coalesce(series_last, event_time)"
NEWER = "(length(rv) > length(floor) OR (length(rv) = length(floor) AND rv > floor))"
KEPT_AFTER = f"(NOT regexp_matches(rv, '^[1-9][0-9]*$') OR {NEWER})"

WATCHES = [
    source.Watch("team-0", field_selector="type=Warning"),
    source.Watch("team-1", label_selector="kind in (click, view),k"),
    source.Watch("team-2"),
]


@query(
    f"""WITH {EV} SELECT watch, count(*) AS events FROM ev
    WHERE (namespace = 'team-0' AND type = 'Warning')
       OR (namespace = 'team-1' AND reason IN ('click', 'view') AND label_k IS NOT NULL)
       OR namespace = 'team-2' GROUP BY watch"""
)
def bind_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_counts(source.bind_watch(canonical_events(spark, sf_dir).drop("watch"), WATCHES))


@query(
    f"""WITH {EV} SELECT uid, reason FROM ev
    WHERE type = 'Normal' AND reason <> 'view' AND r_kind = 'Customer' AND r_uid <> 'stale'"""
)
def field_selector_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = source.field_selector("type=Normal,reason!=view,regarding.kind=Customer,regarding.uid!=stale")
    return canonical_events(spark, sf_dir).filter(selected).select("uid", "reason")


@query(
    f"""WITH {EV} SELECT uid, reason FROM ev
    WHERE reason IN ('click', 'error') AND (label_k IS NULL OR label_k NOT IN ('1', '2', '3'))
      AND (label_k IS NULL OR label_k <> '50')"""
)
def label_selector_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = source.label_selector("kind in (click,error),k notin (1,2,3),k!=50,!team")
    return canonical_events(spark, sf_dir).filter(selected).select("uid", "reason")


@query(
    f"""WITH {FR} SELECT watch, frame_type, count(*) AS events FROM fr
    WHERE frame_type IN ('ADDED', 'MODIFIED') GROUP BY watch, frame_type"""
)
def deliverable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = source.deliverable_frames(frames(spark, sf_dir))
    return kept.groupBy("watch", "frame_type").agg(F.count("*").alias("events"))


@query(
    f"""WITH {EV} SELECT uid, strftime({OCCURRED}, '%Y-%m-%dT%H:%M:%S.%fZ') AS occurred FROM ev"""
)
def occurrence_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(spark, sf_dir).select("uid", rfc3339_micro(occurrence_time()).alias("occurred"))


@query(f"""WITH {EV} SELECT uid FROM ev WHERE {OCCURRED} >= {OLDEST}""")
def replay_max_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_max_age(canonical_events(spark, sf_dir), START, MAX_AGE).select("uid")


@query(
    f"""WITH {EV},{POS}, e AS (
      SELECT ev.*, nullif(resource_version, '') AS floor FROM ev LEFT JOIN pos USING (watch))
    SELECT uid FROM e WHERE floor IS NULL OR {KEPT_AFTER}"""
)
def replay_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_after(canonical_events(spark, sf_dir), stored_positions(spark, sf_dir)).select("uid")


_VERDICTS = f"""WITH {EV},{POS}, e AS (
      SELECT ev.*, nullif(resource_version, '') AS floor FROM ev LEFT JOIN pos USING (watch)),
    judged AS (SELECT watch, uid, CASE WHEN floor IS NOT NULL THEN {KEPT_AFTER}
                                  ELSE {OCCURRED} >= {OLDEST} END AS kept FROM e)"""


@query(f"""{_VERDICTS} SELECT watch, uid FROM judged WHERE kept""")
def expiry_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, stored = canonical_events(spark, sf_dir), stored_positions(spark, sf_dir)
    return replay.expiry_replay(events, stored, START, MAX_AGE).select("watch", "uid")


@query(
    f"""{_VERDICTS} SELECT watch, count(*) FILTER (WHERE kept) AS kept,
      count(*) FILTER (WHERE NOT kept) AS skipped FROM judged GROUP BY watch"""
)
def replay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, stored = canonical_events(spark, sf_dir), stored_positions(spark, sf_dir)
    return replay.replay_counts(replay.replay_verdicts(events, stored, START, MAX_AGE))


_FIRST_POSITIONS = f"""WITH {FR}, ends AS (
      SELECT watch, min(seq) AS end_seq FROM fr WHERE ends_replay GROUP BY watch),
    moved AS (SELECT watch, arg_max(rv, seq) AS resource_version FROM fr JOIN ends USING (watch)
              WHERE seq >= end_seq AND rv <> '' GROUP BY watch)"""


@query(f"{_FIRST_POSITIONS} SELECT watch, resource_version FROM moved")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.positions(frames(spark, sf_dir))


@query(
    f"""WITH {FR},{POS}, new AS (
      SELECT watch, arg_max(rv, seq) AS new_version FROM fr WHERE rv <> '' GROUP BY watch)
    SELECT watch, coalesce(resource_version, 'none') AS old_version, coalesce(new_version, 'none') AS new_version
    FROM (SELECT * FROM pos WHERE resource_version <> '') FULL JOIN new USING (watch)
    WHERE nullif(resource_version, '') IS DISTINCT FROM new_version"""
)
def changed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stored_positions(spark, sf_dir).filter("resource_version <> ''")
    changed = replay.changed_positions(stored, replay.positions(frames(spark, sf_dir), stored))
    return changed.fillna("none")


@query(
    f"""WITH {FR},{POS} SELECT watch, count(*) AS events FROM fr LEFT JOIN pos USING (watch)
    WHERE frame_type IN ('ADDED', 'MODIFIED')
      AND (nullif(resource_version, '') IS NULL OR rv = '' OR NOT regexp_matches(rv, '^[1-9][0-9]*$')
           OR length(rv) > length(resource_version)
           OR (length(rv) = length(resource_version) AND rv > resource_version))
    GROUP BY watch"""
)
def read_counts_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = source.frame_events(source.deliverable_frames(frames(spark, sf_dir)))
    events = lift(raw, "2024-06-01 00:00:00", carry=("watch", "seq"))
    return read_counts(replay.resume(events, stored_positions(spark, sf_dir)))


def _written(rows: DataFrame, fmt: str) -> str:
    """Write rows as JSON lines to a new folder of the shared one."""
    folder = f"{shared_folder(rows.sparkSession)}/{fmt}-{uuid.uuid4().hex}"
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)
    return folder


@query(
    f"""WITH {EV} SELECT watch, uid, reason, note, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%fZ') AS event_time FROM ev
    WHERE (namespace = 'team-0' AND type = 'Warning') OR (namespace = 'team-1' AND reason IN ('click', 'view') AND label_k IS NOT NULL)
       OR namespace = 'team-2'"""
)
def read_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events read from JSON files with their schema, and bound to the watches that select them."""
    folder = _written(canonical_events(spark, sf_dir).drop("watch", "seq", "regardingObject"), "events")
    read = lift(source.read_events(spark, folder, "json", WATCHES), START.strftime("%Y-%m-%d %H:%M:%S"), carry=("watch",))
    return read.select("watch", "uid", "reason", "note", rfc3339_micro(F.col("eventTime")).alias("event_time"))


@query(f"WITH {FR} SELECT watch, seq, frame_type, uid, rv AS resource_version FROM fr")
def read_json_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch frames read from JSON files."""
    read = source.read_frames(spark, _written(frames(spark, sf_dir), "frames"))
    return read.select("watch", "seq", "frame_type", "object.uid", F.col("object.resourceVersion").alias("resource_version"))


@query(f"WITH {EV} SELECT uid, namespace, note, label_k IS NOT NULL AS has_k FROM ev WHERE seq % 5 <> 2")
def parse_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events parsed from binary values, as of a topic; a fifth of them is no object and left out."""
    event = F.to_json(F.struct(*[F.col(name) for name in ("uid", "namespace", "note", "labels")]))
    value = F.when(F.col("seq") % 5 == 2, F.lit("no object")).otherwise(event).cast("binary")
    parsed = source.parse_events(canonical_events(spark, sf_dir).select(value.alias("value")))
    return parsed.select("uid", "namespace", "note", F.map_contains_key("labels", F.lit("k")).alias("has_k"))
