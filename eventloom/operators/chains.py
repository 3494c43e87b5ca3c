"""Greedy scans whose next step depends on where the last one started.

Packing frames into batches and re-opening rate intervals both walk a group in
order: a block opens at a row, and closes at the first row that does not fit.
The walk looks sequential, but the block open at the end of a segment depends
on earlier rows only through the block open at its start. So:

1. each segment works out for every row that could be its first opening which
   block is then open at its end. Such summaries compose: what a block does to
   one segment and what comes out of that does to the next is again a summary,
   of both. So each range of the sort, in parallel, hands on one summary;
2. the ranges of a group are walked in order on those summaries alone;
3. each range, in parallel, names the rows that open its blocks, given the
   block it starts with.

Python sees the few narrow columns that decide, as a stream that holds at most
``PIECE`` rows of one segment at a time, and gives back these marks only. The rows themselves meet
the marks in a window over their segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.segments import SEGMENT, in_range

RANGE = "_range"
#: Rows of a segment that Python holds at once; summaries compose, so a segment may come in pieces.
PIECE = 50_000
#: The range of a state from before all rows, and of the state after all rows.
BEFORE, AFTER = -1, 1 << 40


@dataclass(frozen=True)
class Scan:
    """What a greedy scan does.

    ``summarise(segment)`` returns a summary; ``compose(first, second)`` that
    of two neighbouring runs of rows; ``advance(state, summary)`` the state
    after a run; ``mark(segment, state)`` the marks of a segment and the state
    after it, of which the first is that of the block that is open at its
    start. ``start`` is the state before any row.
    """

    summarise: Callable[[pa.Table], dict]
    compose: Callable[[dict, dict], dict]
    advance: Callable[[dict, dict], dict]
    mark: Callable[[pa.Table, dict], tuple[dict, dict]]
    start: dict
    summary_schema: str
    state_schema: str
    mark_schema: str


def last_openings(following: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow next-opening indices to the end of a segment.

    Returns, per row that opens a block, the last row to open one and how many
    blocks open on the way. Each round doubles the steps that all rows have
    taken.
    """
    rows = np.arange(count, dtype=np.int64)
    ended = following >= count
    last, opened = np.where(ended, rows, following), np.where(ended, 0, 1).astype(np.int64)
    while True:
        further = last[last]
        if np.array_equal(further, last):
            return last, opened + 1
        opened = opened + opened[last]
        last = further


def openings_from(following: np.ndarray, first: int) -> np.ndarray:
    """Return the rows of a segment that open a block, given the first one."""
    found = []
    count = len(following)
    steps = following.tolist()
    while first < count:
        found.append(first)
        first = steps[first]
    return np.array(found, dtype=np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, int, pa.Table]]:
    """Cut sorted batches into ``(keys, range, rows)`` of one segment each, a long one in pieces that follow each other."""
    held: list[pa.RecordBatch] = []
    open_at, size = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, bool)
        for name in (*keys, RANGE, SEGMENT):
            codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
            changed |= codes[1:] != codes[:-1]
        borders = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for at, stop in zip(borders, borders[1:]):
            here = tuple(batch.column(name)[at].as_py() for name in (*keys, RANGE, SEGMENT))
            while at < stop:
                if held and (here != open_at or size >= PIECE):
                    yield open_at[:-2], open_at[-2], pa.Table.from_batches(held).combine_chunks()
                    held, size = [], 0
                open_at = here
                held.append(batch.slice(at, min(stop - at, PIECE - size)))
                size += held[-1].num_rows
                at += held[-1].num_rows
    if held:
        yield open_at[:-2], open_at[-2], pa.Table.from_batches(held).combine_chunks()


def _emit(rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[name] for row in rows], kind) for name, kind in kinds.items()], names=list(kinds))


_KINDS = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
_KINDS |= {f"array<{name}>": pa.list_(kind) for name, kind in _KINDS.items()}


def _fields(schema: str) -> dict[str, pa.DataType]:
    return {name: _KINDS[kind] for name, kind in (field.split() for field in schema.split(", "))}


def range_states(narrow: DataFrame, keys: Sequence[str], scan: Scan, states: DataFrame | None = None) -> DataFrame:
    """Return the state that each range of each group starts with, and after all rows.

    ``states`` holds the state a group comes with from earlier rows. The state
    after all rows has the range ``AFTER``, also for a group that has a state
    and no rows. ``seq`` orders the rows of ``narrow``.
    """
    keys = list(keys)
    key_kinds = {name: narrow.schema[name].dataType.simpleString() for name in keys}
    key_fields = ", ".join(f"`{name}` {kind}" for name, kind in key_kinds.items())
    placed = {name: _KINDS[kind] for name, kind in key_kinds.items()} | {RANGE: pa.int64()}
    summary, state_fields = placed | _fields(scan.summary_schema), placed | _fields(scan.state_schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, None
        for key, number, segment in _pieces(batches, keys):
            found = scan.summarise(segment)
            if (key, number) == place:
                held = scan.compose(held, found)
                continue
            if held is not None:
                yield _emit([dict(zip(placed, (*place[0], place[1]))) | held], summary)
            place, held = (key, number), found
        if held is not None:
            yield _emit([dict(zip(placed, (*place[0], place[1]))) | held], summary)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, scan.start
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                key = tuple(row[name] for name in keys)
                if key != group:
                    if group is not None:
                        rows.append(dict(zip(placed, (*group, AFTER))) | state)
                    group, state = key, scan.start
                if row[RANGE] == BEFORE:
                    state = {name: row[f"from_{name}"] for name in scan.start}
                    continue
                rows.append(dict(zip(placed, (*key, row[RANGE]))) | state)
                state = scan.advance(state, {name: np.asarray(v) if isinstance(v, list) else v for name, v in row.items()})
            yield _emit(rows, state_fields)
        if group is not None:
            yield _emit([dict(zip(placed, (*group, AFTER))) | state], state_fields)

    numbered = narrow.withColumn(RANGE, in_range()).repartition(*keys, RANGE).sortWithinPartitions(*keys, RANGE, "seq")
    composed = numbered.mapInArrow(fold, f"{key_fields}, `{RANGE}` bigint, {scan.summary_schema}")
    if states is not None:
        given = states.select(*keys, F.lit(BEFORE).cast("bigint").alias(RANGE), *(F.col(name).alias(f"from_{name}") for name in scan.start))
        composed = composed.unionByName(given, allowMissingColumns=True)
    in_order = composed.repartition(*keys).sortWithinPartitions(*keys, RANGE)
    return in_order.mapInArrow(walk, f"{key_fields}, `{RANGE}` bigint, {scan.state_schema}")


def range_marks(narrow: DataFrame, states: DataFrame, keys: Sequence[str], scan: Scan) -> DataFrame:
    """Return the marks of every segment, given the state that each range starts with.

    A state travels as the first row of its range, so rows and states meet in
    one shuffle.
    """
    keys = list(keys)
    key_kinds = {name: narrow.schema[name].dataType.simpleString() for name in keys}
    key_fields = ", ".join(f"`{name}` {kind}" for name, kind in key_kinds.items())
    out = {name: _KINDS[kind] for name, kind in key_kinds.items()} | {SEGMENT: pa.int64()} | _fields(scan.mark_schema)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = scan.start, None
        for key, _, segment in _pieces(batches, keys):
            number = segment[SEGMENT][0].as_py()
            if number is None:
                state = {name: segment[f"from_{name}"][0].as_py() for name in scan.start}
                continue
            marks, state = scan.mark(segment, state)
            if (key, number) == last:  # a further piece goes on with what the one before has open
                marks = {name: values[1:] for name, values in marks.items()}
            last = key, number
            count = len(next(iter(marks.values())))
            same = {name: [value] * count for name, value in zip((*keys, SEGMENT), (*key, number))}
            yield pa.RecordBatch.from_arrays([pa.array((same | marks)[name], kind) for name, kind in out.items()], names=list(out))

    starts = states.where(F.col(RANGE) < AFTER).select(*keys, RANGE, *(F.col(name).alias(f"from_{name}") for name in scan.start))
    mixed = narrow.withColumn(RANGE, in_range()).unionByName(starts, allowMissingColumns=True)
    in_order = mixed.repartition(*keys, RANGE).sortWithinPartitions(*keys, RANGE, F.col("seq").asc_nulls_first())
    return in_order.mapInArrow(mark, f"{key_fields}, `{SEGMENT}` bigint, {scan.mark_schema}")


def with_marks(rows: DataFrame, marks: DataFrame, keys: Sequence[str], seq: str = "seq") -> tuple[DataFrame, Window]:
    """Put the marks of each segment among its rows, and return both with the window up to each of them.

    A mark without a ``seq`` comes first in its segment, any other right before
    the row it names. ``_row`` is 1 for rows and 0 for marks.
    """
    mixed = rows.withColumn("_row", F.lit(1)).unionByName(
        marks.withColumn("_row", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy(*keys, SEGMENT).orderBy(F.col(seq).asc_nulls_first(), "_row")
    return mixed, order.rowsBetween(Window.unboundedPreceding, 0)
