"""Running counters in keyed state.

The total of a series lives in Spark's state store, so a micro-batch reads and
writes the series that it counts and no others. The limit on series is kept as
state too: a series that comes first stays, one that comes when the limit is
reached is refused, and what was refused is counted for each metric.

Each task adds its events up before they are shuffled. So what meets in the
state is one row a task and series, however many events a series has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventloom.operators.metrics import Metric, check_metrics, label_values
from eventloom.streaming.batches import STATE_STORE

#: Keys that unlimited counters spread over; a limit is one order of admission, so limited ones share a key.
SHARDS = 64
_SERIES = ["shard", "metric_index", "series"]
_PARTIAL = "shard int, metric_index int, series string, value bigint, first_seq bigint"
#: Rows that a task holds before it adds them up.
HELD = 1 << 19
_TOTALS = "metric_index int, label_values array<string>, value bigint, refused boolean"


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add a task's rows up by series, a column at a time."""

    names = [*_SERIES, "value", "first_seq"]

    def added(parts: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(parts).group_by(_SERIES, use_threads=False).aggregate([("value", "sum"), ("first_seq", "min")])
        return sums.select([*_SERIES, "value_sum", "first_seq_min"]).rename_columns(names)

    held: list[pa.Table] = []
    size, most = 0, HELD
    for batch in batches:
        held.append(pa.Table.from_arrays(batch.columns, names=names))  # columns that may be null, as those of sums are
        size += batch.num_rows
        if size >= most:
            held = [added(held)]
            size = held[0].num_rows
            most = max(HELD, 2 * size)
    if held:
        yield from added(held).to_batches()


class Totals(StatefulProcessor):
    """Totals of the series of one key, and how many events were refused of each metric."""

    def __init__(self, max_series: int) -> None:
        self.max_series = max_series

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getMapState("totals", "metric_index int, label_values array<string>", "value bigint")
        self.refused = handle.getMapState("refused", "metric_index int", "value bigint")
        self.admitted = handle.getValueState("admitted", "many bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        first: dict[tuple, int] = {}
        for part in rows:
            for row in part.itertuples(index=False):
                series = (int(row.metric_index), tuple(row.label_values))
                counts[series] += int(row.value)
                first[series] = min(int(row.first_seq), first.get(series, int(row.first_seq)))
        many = self.admitted.get()[0] if self.admitted.exists() else 0
        out, refused = [], Counter()
        for index, values in sorted(counts, key=lambda series: (first[series], series[0])):
            place = (index, list(values))
            known = self.totals.containsKey(place)
            if not known and self.max_series and many >= self.max_series:
                refused[index] += counts[index, values]
                continue
            many += not known
            total = (self.totals.getValue(place)[0] if known else 0) + counts[index, values]
            self.totals.updateValue(place, (total,))
            out.append((index, list(values), total, False))
        for index, events in refused.items():
            total = (self.refused.getValue((index,))[0] if self.refused.containsKey((index,)) else 0) + events
            self.refused.updateValue((index,), (total,))
            out.append((index, [], total, True))
        self.admitted.update((many,))
        yield pd.DataFrame(out, columns=["metric_index", "label_values", "value", "refused"])


def running_totals(events: DataFrame, metrics: Sequence[Metric], max_series: int = 0, seq: str = "seq") -> DataFrame:
    """Count a stream of events, and return the totals of the series that each micro-batch moved.

    Rows are ``metric_index, label_values, value, refused``: the total of a
    series so far, or, with ``refused``, how many events of the metric were
    refused so far because their series came after ``max_series`` others, over
    all metrics, in the order of ``seq``. Zero is no limit. Run it in update
    mode; needs the state store :data:`STATE_STORE`.
    """
    check_metrics(metrics)
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        raise ValueError(f"running totals need spark.sql.streaming.stateStore.providerClass={STATE_STORE}")
    entries = F.array(
        *[
            F.struct(F.lit(index).alias("metric_index"), label_values(metric).alias("label_values"))
            for index, metric in enumerate(metrics)
        ]
    )
    rows = events.select(F.col(seq).cast("bigint").alias("seq"), F.inline(entries))
    shard = F.lit(0) if max_series else F.pmod(F.xxhash64("metric_index", "label_values"), F.lit(SHARDS))
    # The labels travel as one text, by which Arrow can group.
    series = F.to_json("label_values").alias("series")
    keyed = rows.select(shard.cast("int").alias("shard"), "metric_index", series, F.lit(1).cast("bigint").alias("value"), F.col("seq").alias("first_seq"))
    parts = keyed.mapInArrow(_added_up, _PARTIAL)
    labels = F.from_json("series", "array<string>").alias("label_values")
    added = parts.select("shard", "metric_index", labels, "value", "first_seq")
    return added.groupBy("shard").transformWithStateInPandas(Totals(max_series), _TOTALS, "Update", "None")


def last_totals(written: DataFrame) -> DataFrame:
    """Return the newest total of each series, of the rows that the micro-batches of :func:`running_totals` wrote."""
    return written.groupBy("metric_index", "label_values", "refused").agg(F.max("value").alias("value"))
