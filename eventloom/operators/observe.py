"""Counts taken beside the main pass.

What a pass lets through, drops or fails to evaluate is counted by Spark while
the rows go by, and no second pass reads them for it. A batch names the counts
by an ``Observation``; a stream by a text, under which each micro-batch
reports them in its progress (see :func:`progress_counts`).

A retried task counts once; rows that a pass does not read, as below a limit,
are not counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.enrich import OUTCOMES
from eventloom.operators.filters import EVAL_ERROR, MATCHED
from eventloom.plans.spec import Flow

Name = Observation | str


def _named(counts: Mapping[str, Column]) -> list[Column]:
    return [F.count_if(condition).alias(label) for label, condition in counts.items()]


def observe_verdicts(matched: DataFrame, flows: Sequence[Flow], name: Name) -> DataFrame:
    """Count matched and failed evaluations of each flow as the rows of :func:`match` go by."""
    counts = {}
    for index, flow in enumerate(sorted(flows, key=lambda flow: flow.name)):
        for verdict in (MATCHED, EVAL_ERROR):
            counts[f"{verdict}:{flow.name}"] = F.col("verdicts")[index]["verdict"] == verdict
    return matched.observe(name, *_named(counts))


def observe_outcomes(enriched: DataFrame, name: Name) -> DataFrame:
    """Count the events of each enrichment outcome as they go by."""
    return enriched.observe(name, *_named({outcome: F.col("enrich_result") == outcome for outcome in OUTCOMES}))


def observe_read(events: DataFrame, watches: Iterable[str], name: Name) -> DataFrame:
    """Count the events of each watch as they go by, and under ``*`` those of any other."""
    known = sorted(watches)
    counts = {f"read:{watch}": F.col("watch") == watch for watch in known}
    counts["read:*"] = ~F.coalesce(F.col("watch").isin(known), F.lit(False))
    return events.observe(name, *_named(counts))


def observe_kept(judged: DataFrame, name: Name, kept: str = "kept") -> DataFrame:
    """Count kept and dropped rows, as of a replay, as they go by."""
    return judged.observe(name, *_named({"kept": F.col(kept), "dropped": ~F.col(kept)}))


def counted(spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
    """Return ``name, subject, events`` rows of observed counts that are not zero: the count's name, and what it is of."""
    rows = [(*label.partition(":")[::2], int(count)) for label, count in counts.items() if count]
    return spark.createDataFrame(rows, "name string, subject string, events bigint")


def progress_counts(progress: Sequence[Mapping], name: str) -> dict[str, int]:
    """Sum up what the micro-batches of a stream report under a name in their progress."""
    total: dict[str, int] = {}
    for batch in progress:
        row = batch["observedMetrics"].get(name)
        for label, count in (row.asDict() if hasattr(row, "asDict") else dict(row or {})).items():
            total[label] = total.get(label, 0) + int(count)
    return total
