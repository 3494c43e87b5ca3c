"""Thinning failure records: rows ``gate, seq, ts, key`` in ``seq`` order per gate.

Gates may be hot, so every scan works on bounded segments (see
:mod:`eventloom.operators.segments`).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.chains import AFTER, RANGE, Scan, last_openings, openings_from, range_marks, range_states, with_marks
from eventloom.operators.segments import SEGMENT, SPAN, before, in_segment, join_carry, with_segment
from eventloom.scratch import keep

_GATE = ["gate"]


def on_change(rows: DataFrame, span: int = SPAN, keep_segment: bool = False, states: DataFrame | None = None) -> DataFrame:
    """Add ``admitted``: whether the key differs from the gate's previous one.

    ``states`` holds ``gate, key``: the last key before these rows. With ``keep_segment`` the rows stay cut as they are, so that
    :func:`with_suppressed` on top needs no shuffle of its own.
    """
    segmented = with_segment(rows, _GATE, span)
    window = in_segment(_GATE)
    numbered = segmented.withColumn("_previous", F.lag("key").over(window))
    last = segmented.select("gate", SEGMENT, "key", F.lead("seq").over(window).alias("_next")).where("_next is null")
    carry = last.select("gate", SEGMENT, F.last("key").over(before(_GATE)).alias("_carried"), F.lit(True).alias("_any"))
    joined = join_carry(numbered.withColumn("_first", F.row_number().over(window) == 1), carry, _GATE)
    if states is not None:
        earlier = states.select(F.col("gate").alias("_of"), F.col("key").alias("_earlier")).distinct()
        joined = joined.join(earlier, F.col("gate").eqNullSafe(F.col("_of")), "left").drop("_of")
        joined = joined.withColumn("_carried", F.coalesce("_carried", "_earlier")).drop("_earlier")
    previous = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_previous"))
    flagged = joined.withColumn("admitted", ~F.col("key").eqNullSafe(previous))
    return flagged.drop("_previous", "_carried", "_any", "_first", *([] if keep_segment else [SEGMENT]))


def first_seen(rows: DataFrame, limit: int, states: DataFrame | None = None) -> DataFrame:
    """Add ``admitted``: the first row of each distinct key, for the gate's first ``limit`` keys.

    The keys' first rows come from one partial aggregation. Spark prunes the
    ranking to ``limit`` per gate before shuffling it. ``states`` holds ``gate,
    key``: the keys that earlier rows were admitted with, at most ``limit`` a gate.
    """
    firsts = rows.groupBy("gate", "key").agg(F.min("seq").alias("seq"))
    known = F.lit(0)
    if states is not None:
        seen = states.select("gate", "key").distinct()
        firsts = firsts.join(seen, ["gate", "key"], "left_anti").join(seen.groupBy("gate").agg(F.count("*").alias("_known")), "gate", "left")
        known = F.coalesce("_known", F.lit(0))
    rank = F.row_number().over(Window.partitionBy("gate").orderBy("seq"))
    admitted = (
        firsts.withColumn("_rank", rank)
        .filter(F.col("_rank") <= limit)  # what Spark prunes by
        .filter(F.col("_rank") + known <= limit)
        .select("gate", "seq", F.lit(True).alias("_admitted"))
    )
    return (
        rows.join(admitted, ["gate", "seq"], "left")
        .withColumn("admitted", F.coalesce("_admitted", F.lit(False)))
        .drop("_admitted")
    )


def with_suppressed(rows: DataFrame, span: int = SPAN, pending: DataFrame | None = None) -> DataFrame:
    """Return the admitted rows with ``suppressed``: the rows withheld since the gate's previous admitted one.

    ``pending`` holds ``gate, pending``: rows withheld before these and not reported yet.
    """
    segmented = with_segment(rows, _GATE, span).withColumn("_withheld", F.when(F.col("admitted"), 0).otherwise(1))
    running = F.sum("_withheld").over(in_segment(_GATE).rowsBetween(Window.unboundedPreceding, 0))
    counted = segmented.withColumn("_running", running)
    # Withheld rows before each segment, and how many of them the last admission had seen.
    summary = counted.groupBy("gate", SEGMENT).agg(
        F.sum("_withheld").alias("_total"), F.max(F.when(F.col("admitted"), F.col("_running"))).alias("_seen")
    )
    offsets = summary.withColumn("_offset", F.coalesce(F.sum("_total").over(before(_GATE)), F.lit(0)))
    reported = F.max(F.col("_offset") + F.col("_seen")).over(before(_GATE))
    if pending is None:
        unreported = F.lit(0)
    else:
        offsets = offsets.join(pending.select("gate", F.col("pending").alias("_earlier")), "gate", "left")
        unreported = F.coalesce("_earlier", F.lit(0))
    carry = offsets.select(
        "gate", SEGMENT, (F.col("_offset") - F.coalesce(reported, -unreported)).alias("_pending")
    )
    previous = F.lag("_running").over(in_segment(_GATE))
    admitted = counted.filter("admitted").withColumn("_before", previous)
    return (
        join_carry(admitted, carry, _GATE)
        .withColumn("suppressed", F.col("_running") - F.coalesce(F.col("_before"), -F.col("_pending")))
        .drop("_withheld", "_running", "_before", "_pending", SEGMENT)
    )


def with_runs(rows: DataFrame, span: int = SPAN, recovered: str = "recovered") -> DataFrame:
    """Add ``run``: how often the gate had recovered before the row."""
    segmented = with_segment(rows, _GATE, span)
    ended = F.coalesce(F.col(recovered), F.lit(False)).cast("bigint")
    window = in_segment(_GATE)
    counted = segmented.withColumn("_run", F.coalesce(F.sum(ended).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = segmented.groupBy("gate", SEGMENT).agg(F.sum(ended).alias("_ended"))
    carry = totals.select("gate", SEGMENT, F.coalesce(F.sum("_ended").over(before(_GATE)), F.lit(0)).alias("_runs"))
    return join_carry(counted, carry, _GATE).withColumn("run", F.col("_run") + F.col("_runs")).drop("_run", "_runs", SEGMENT)


def until_recovered(
    rows: DataFrame, thin: Callable[[DataFrame], DataFrame], span: int = SPAN, recovered: str = "recovered"
) -> DataFrame:
    """Thin failures run by run, where rows with ``recovered`` end the runs.

    A recovery starts the gate afresh: the next failure is admitted like a
    first one, also with a key that a first-seen gate knows. It is reported
    itself, with what was withheld since the last admission, unless nothing
    had failed since the recovery before.

    ``thin`` is one of this module's operators. Returns the admitted rows and
    the reported recoveries, with ``run`` and ``suppressed``.
    """
    numbered = keep(with_runs(rows, span, recovered), "runs")
    ends = F.coalesce(F.col(recovered), F.lit(False))
    # Every run is a gate of its own.
    gate = F.struct("gate", "run")
    failures = numbered.where(~ends).withColumns({"_gate": F.col("gate"), "gate": F.concat_ws("\u001f", F.col("gate").cast("string"), F.col("run").cast("string"))})
    flagged = keep(thin(failures), "thinned")
    reported = with_suppressed(flagged, span).drop("gate", "admitted").withColumnRenamed("_gate", "gate")
    tally = flagged.select(F.struct(F.col("_gate").alias("gate"), "run").alias("of"), F.when(F.col("admitted"), 0).otherwise(1).alias("pending"))
    pending = tally.union(reported.select(gate, -F.col("suppressed"))).groupBy("of").agg(F.sum("pending").alias("suppressed"))
    recoveries = numbered.where(ends).join(pending, F.struct("gate", "run").eqNullSafe(F.col("of"))).drop("of")
    return reported.select(*recoveries.columns).union(recoveries)


def per_interval(
    rows: DataFrame, interval: dt.timedelta, threshold: int, span: int = SPAN, states: DataFrame | None = None
) -> DataFrame:
    """Add ``admitted``: up to ``threshold`` rows of a key per interval.

    A different key is admitted at once and opens a fresh interval. An interval
    starts at the row that opened it and re-opens at the first row at least
    ``interval`` later; an interval of zero never expires. ``ts`` must not
    decrease with ``seq``. ``states`` from :func:`interval_states` carries the
    gates on from earlier rows.
    """
    width = interval // dt.timedelta(microseconds=1)
    segmented = with_segment(rows, _GATE, span)
    narrow = _narrow(segmented)
    scan = _scan(width)
    marks = range_marks(narrow, range_states(narrow, _GATE, scan, _given(states)), _GATE, scan)
    mixed, so_far = with_marks(segmented, marks, _GATE)
    # The rank of a row in its interval: rows up to it, less those before the opening.
    counted = mixed.withColumn("_rows", F.sum("_row").over(so_far))
    before_opening = F.when(F.col("_row") == 0, F.coalesce(-F.col("_carried"), F.col("_rows")))
    rank = F.col("_rows") - 1 - F.last(before_opening, ignorenulls=True).over(so_far)
    # The row that opens an interval is admitted under any threshold.
    ranked = counted.withColumn("admitted", rank < max(threshold, 1)).filter("_row = 1")
    return ranked.drop("_row", "_rows", "_carried", SEGMENT)


def interval_states(
    rows: DataFrame, interval: dt.timedelta, span: int = SPAN, states: DataFrame | None = None
) -> DataFrame:
    """Return the interval open at each gate after the rows: ``gate, key, since, count``."""
    width = interval // dt.timedelta(microseconds=1)
    narrow = _narrow(with_segment(rows, _GATE, span))
    after = range_states(narrow, _GATE, _scan(width), _given(states)).filter(F.col(RANGE) == AFTER)
    return after.select("gate", "key", "since", "count")


def _given(states: DataFrame | None) -> DataFrame | None:
    return None if states is None else states.withColumn("open", F.lit(True))


def _narrow(segmented: DataFrame) -> DataFrame:
    return segmented.select("gate", SEGMENT, "seq", F.unix_micros("ts").alias("at"), "key")


def _scan(width: int) -> Scan:
    return Scan(
        summarise=_summarise(width),
        compose=_compose(width),
        advance=_advance(width),
        mark=_mark(width),
        start={"open": False, "key": "", "since": 0, "count": 0},
        summary_schema="rows bigint, first_key string, reset bigint, until array<bigint>, end_key array<string>, "
        "end_at array<bigint>, end_count array<bigint>",
        state_schema="open boolean, key string, since bigint, count bigint",
        mark_schema="seq bigint, _carried bigint",
    )


def _next_openings(keys: pa.Array, at: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Return, per row that opens an interval, the row that opens the next, and the first change of key."""
    count = len(at)
    differs = pc.not_equal(keys.slice(1), keys.slice(0, count - 1)).to_numpy(zero_copy_only=False)
    changes = np.flatnonzero(differs) + 1
    position = np.searchsorted(changes, np.arange(count), side="right")
    following = np.append(changes, count)[position]
    if width > 0:
        following = np.minimum(following, np.searchsorted(at, at + width, side="left"))
    return following, int(changes[0]) if len(changes) else count


def _columns(segment: pa.Table) -> tuple[pa.Array, np.ndarray]:
    return segment["key"].combine_chunks(), segment["at"].to_numpy()


def _summarise(width: int):
    def summarise(segment: pa.Table) -> dict:
        keys, at = _columns(segment)
        count = len(at)
        following, reset = _next_openings(keys, at, width)
        last, _ = last_openings(following, count)
        # The segment's first opening is at most the first change of key. Rows
        # in a row that lead to the same last opening share one entry.
        entries = last[: reset + 1]
        ends = np.array([len(entries) - 1])
        if width > 0:
            ends = np.flatnonzero(np.append(entries[1:] != entries[:-1], True))
        ends = np.unique(np.append(ends, 0))
        chosen = entries[ends]
        return {
            "rows": count,
            "first_key": keys[0].as_py(),
            "reset": reset,
            "until": at[ends],
            "end_key": np.array(keys.take(pa.array(chosen)).to_pylist(), object),
            "end_at": at[chosen],
            "end_count": count - chosen,
        }

    return summarise


def _advance(width: int):
    def advance(state: dict, run: dict) -> dict:
        until = run["until"]
        if not state["open"] or state["key"] != run["first_key"]:
            entry = 0
        elif width > 0 and (late := int(np.searchsorted(until, state["since"] + width, side="left"))) < len(until):
            entry = late
        elif run["reset"] < run["rows"]:
            entry = len(until) - 1
        else:
            return state | {"count": state["count"] + run["rows"]}
        return {
            "open": True,
            "key": run["end_key"][entry],
            "since": int(run["end_at"][entry]),
            "count": int(run["end_count"][entry]),
        }

    return advance


def _compose(width: int):
    advance = _advance(width)

    def compose(first: dict, second: dict) -> dict:
        """Where the first run has one key throughout, the second's entries follow the first's."""
        states = zip(first["end_key"], first["end_at"], first["end_count"], strict=True)
        ends = [advance({"open": True, "key": key, "since": int(at), "count": int(count)}, second) for key, at, count in states]
        more, reset = 0, first["reset"]
        if reset == first["rows"]:
            same = second["first_key"] == first["first_key"]
            more = len(second["until"]) if same else 1  # another key opens an interval at once, with its first row
            reset += second["reset"] if same else 0
        return first | {
            "rows": first["rows"] + second["rows"],
            "reset": reset,
            "until": np.append(first["until"], second["until"][:more]),
            "end_key": np.array([end["key"] for end in ends] + list(second["end_key"][:more]), object),
            "end_at": np.append([end["since"] for end in ends], second["end_at"][:more]).astype(np.int64),
            "end_count": np.append([end["count"] for end in ends], second["end_count"][:more]).astype(np.int64),
        }

    return compose


def _mark(width: int):
    def mark(segment: pa.Table, state: dict) -> tuple[dict, dict]:
        keys, at = _columns(segment)
        count, first, carried = len(at), 0, 0
        following, reset = _next_openings(keys, at, width)
        if state["open"] and state["key"] == keys[0].as_py():
            first, carried = reset, state["count"]
            if width > 0:
                first = min(first, int(np.searchsorted(at, state["since"] + width, side="left")))
        opened = openings_from(following, first)
        # The rows before the first opening go on with the interval that came in.
        marks = {
            "seq": [None, *segment["seq"].to_numpy()[opened].tolist()],
            "_carried": [carried, *[None] * len(opened)],
        }
        if not len(opened):
            return marks, state | {"count": state["count"] + count}
        last = int(opened[-1])
        return marks, {"open": True, "key": keys[last].as_py(), "since": int(at[last]), "count": count - last}

    return mark
