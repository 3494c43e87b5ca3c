"""Evaluating every flow on each event and sending it once to each sink."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.operators.filters import EVAL_ERROR, MATCHED, check_rules, verdict
from eventloom.plans.spec import Flow
from eventloom.schema import EVENT
from eventloom.scratch import keep

UNBOUND = "unbound"


def flow_verdict(flow: Flow, schema: StructType = EVENT) -> Column:
    """Return a flow's verdict on an event, ``unbound`` for the watches it does not take."""
    decided = verdict(flow.filters, schema)
    if flow.watches is None:
        return decided
    return F.when(F.col("watch").isin(list(flow.watches)), decided).otherwise(F.lit(UNBOUND))


def match(events: DataFrame, flows: Sequence[Flow]) -> DataFrame:
    """Evaluate every flow in name order, in one pass.

    ``verdicts`` holds one (flow, verdict) entry per flow, and ``sinks`` the
    distinct sinks of the matching ones, in the order they are reached. A rule
    that does not analyse or is not boolean is refused here.
    """
    flows = sorted(flows, key=lambda flow: flow.name)
    for flow in flows:
        check_rules(events.sparkSession, flow.filters, events.schema)
    found = [flow_verdict(flow, events.schema) for flow in flows]
    entries = [F.struct(F.lit(flow.name).alias("flow"), verdict.alias("verdict")) for flow, verdict in zip(flows, found)]
    none = F.array().cast("array<string>")
    reached = [
        F.when(verdict == MATCHED, F.array(*[F.lit(sink) for sink in flow.sinks])).otherwise(none)
        for flow, verdict in zip(flows, found)
    ]
    return events.withColumns({"verdicts": F.array(*entries), "sinks": F.array_distinct(F.concat(*reached))})


def route(matched: DataFrame) -> DataFrame:
    """Return one row per event and reached sink; the sinks are deduplicated in the row, without a shuffle."""
    return matched.withColumn("sink", F.explode("sinks")).drop("verdicts", "sinks")


def verdict_counts(matched: DataFrame) -> DataFrame:
    """Count matched and failed evaluations per flow; non-matches are not counted."""
    return (
        matched.select(F.explode("verdicts").alias("entry"))
        .select("entry.flow", "entry.verdict")
        .filter(F.col("verdict").isin(MATCHED, EVAL_ERROR))
        .groupBy("flow", "verdict")
        .agg(F.count("*").alias("events"))
    )


def route_write(routed: DataFrame, writers: Mapping[str, Callable[[DataFrame], None]]) -> None:
    """Hand each sink its own rows; what is above them is computed once, for however many sinks.

    Rows for several writers are written once to the shared folder,
    partitioned by sink, and each writer reads its partition only. Spark
    commits that table as a whole, so that no writer sees rows of a task that
    failed. Sinks that take lines of text can do without the table: see
    :func:`route_lines`.
    """
    if len(writers) > 1:
        routed = keep(routed.filter(F.col("sink").isin(sorted(writers))), "routed", partition_by=["sink"])
    for sink, write in writers.items():
        write(routed.filter(F.col("sink") == sink).drop("sink"))


def route_lines(matched: DataFrame, documents: Mapping[str, Column], folder: str, compression: str = "none") -> None:
    """Write one line of text for each event and sink that it reached, all sinks in one pass.

    ``documents`` holds each sink's encoding, so an event is encoded only for
    the sinks that it reached. The lines of a sink are the text files of
    ``folder/sink=<name>``. Spark commits the folder as a whole and replaces
    what an earlier attempt left.
    """
    encoded = [
        F.when(F.array_contains("sinks", F.lit(sink)), F.struct(F.lit(sink).alias("sink"), document.alias("value")))
        for sink, document in sorted(documents.items())
    ]
    rows = matched.select(F.explode(F.array_compact(F.array(*encoded))).alias("row")).select("row.sink", "row.value")
    rows.write.mode("overwrite").partitionBy("sink").text(folder, compression=compression)
