"""Ordered scans over hot groups, cut into bounded segments.

A group (a sink, a gate) may hold a third of all rows, so no operator orders a
whole group in one task. The rows are sorted by group and ``seq`` over all
partitions, in ranges that Spark samples, and written once; a segment is at
most ``span`` consecutive rows of one group in one such range, whatever the
steps between their sequence numbers. Each segment is worked on by itself, and
what it needs from the ones before it comes from a summary with one row per
segment. The summaries of a range are put together first, so that what walks a
group in order sees a row per range.

``seq`` has to be unique within the group, such as an offset.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.scratch import keep

SPAN = 500_000
SEGMENT = "_segment"
#: Bits of a segment's number that count within its range.
WITHIN = 31


def with_segment(rows: DataFrame, keys: Sequence[str], span: int = SPAN, seq: str = "seq") -> DataFrame:
    """Sort and write the rows, and add the number of the segment that each falls into, unless an earlier scan left it there.

    Numbers ascend with the order within a group. Every scan that follows reads
    the written table. Sorting samples the rows and then shuffles them, so what
    is above them is computed twice: hand in few columns of a written table
    where that is dear.
    """
    if SEGMENT in rows.columns:
        return rows
    in_order = rows.repartitionByRange(*keys, seq).sortWithinPartitions(*keys, seq)
    # The number holds the partition in its upper bits and counts its rows, in their order, in the lower ones.
    counted = in_order.withColumn(SEGMENT, F.monotonically_increasing_id())
    part, at = F.shiftright(SEGMENT, 33), F.col(SEGMENT).bitwiseAND(F.lit((1 << 33) - 1))
    return keep(counted.withColumn(SEGMENT, F.shiftleft(part, WITHIN) + whole_quotient(at, span)), "segments")


def in_range(segment: Column | str = SEGMENT) -> Column:
    """Return the number of the range that a segment lies in."""
    return F.shiftright(segment, WITHIN)


def whole_quotient(number: Column, divisor: int) -> Column:
    """Return an integer division rounded down, exact for every bigint."""
    return F.call_function("div", number - F.pmod(number, F.lit(divisor)), F.lit(divisor).cast("bigint"))


def in_segment(keys: Sequence[str], seq: str = "seq"):
    """Return the window over one segment of a group, in order."""
    return Window.partitionBy(*keys, SEGMENT).orderBy(seq)


def before(keys: Sequence[str]):
    """Return the window over the summaries of a group's earlier segments."""
    return Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)


def join_carry(segmented: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join each segment's carried values to its rows."""
    return segmented.join(carry, [*keys, SEGMENT], "left")


def rejoin(rows: DataFrame, found: DataFrame, keys: Sequence[str], seq: str = "seq", how: str = "inner") -> DataFrame:
    """Put what was found of narrow rows back to the whole rows; no group meets in one task."""
    names = [*keys, seq]
    renamed = found.withColumnsRenamed({name: f"_of_{name}" for name in names})
    same = functools.reduce(operator.and_, (F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in names))
    return rows.join(renamed, same, how).drop(*(f"_of_{name}" for name in names))


def with_position(rows: DataFrame, keys: Sequence[str], name: str, span: int = SPAN, seq: str = "seq") -> DataFrame:
    """Add the 0-based position of each row in its group's order."""
    narrow = with_segment(rows.select(*keys, seq), keys, span, seq)
    earlier = F.coalesce(F.sum("_rows").over(before(keys)), F.lit(0))
    carry = (
        narrow.groupBy(*keys, SEGMENT)
        .agg(F.count("*").alias("_rows"))
        .select(*(F.col(key).alias(f"_of_{key}") for key in keys), F.col(SEGMENT).alias("_in"), earlier.alias("_offset"))
    )
    local: Column = F.row_number().over(in_segment(keys, seq)) - 1
    same = functools.reduce(operator.and_, (F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys), F.col(SEGMENT) == F.col("_in"))
    numbered = narrow.withColumn("_local", local).join(carry, same)
    found = numbered.select(*keys, seq, (F.col("_offset") + F.col("_local")).alias(name))
    return found if set(rows.columns) == {*keys, seq} else rejoin(rows, found, keys, seq)
