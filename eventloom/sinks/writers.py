"""Writers for :func:`~eventloom.operators.routing.route_write` and streams.

A writer takes the canonical events of one sink and the epoch they belong to.
Writers to a folder give each epoch a folder of its own and replace it, so an
epoch that is run again leaves no duplicate.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame

from eventloom.operators.batching import BatchLimits
from eventloom.operators.encode import Identity, json_lines, kafka_records
from eventloom.operators.metrics import Metric, drop_counts
from eventloom.plans.export import export_drops, export_requests
from eventloom.streaming.run import count_limited

Writer = Callable[[DataFrame, int], None]


def _epoch_folder(folder: str, epoch: int) -> str:
    return f"{folder}/epoch={epoch}"


def lines_writer(folder: str, compression: str = "none") -> Writer:
    """Write one canonical JSON line per event."""

    def write(events: DataFrame, epoch: int = 0) -> None:
        json_lines(events).write.mode("overwrite").text(_epoch_folder(folder, epoch), compression=compression)

    return write


def documents_writer(folder: str, document: Callable[[], Column], terminator: str = "\n") -> Writer:
    """Write one encoded document per event, such as GELF with a NUL terminator."""

    def write(events: DataFrame, epoch: int = 0) -> None:
        rows = events.select(document().alias("value"))
        rows.write.mode("overwrite").option("lineSep", terminator).text(_epoch_folder(folder, epoch))

    return write


def kafka_writer(options: Mapping[str, str], key: str = "uid", identity: Identity = Identity()) -> Writer:
    """Write Kafka records; needs Spark's Kafka connector on the class path."""

    def write(events: DataFrame, epoch: int = 0) -> None:
        records = kafka_records(events, key, identity)
        records.write.format("kafka").option("includeHeaders", "true").options(**options).save()

    return write


def requests_writer(
    folder: str, frame: Callable[[], Column], fmt: str, keys: Sequence[str], limits: BatchLimits, sink: str = "", **signing
) -> Writer:
    """Write the composed, optionally signed request bodies as a table, and in ``drops`` the frames that no queue takes."""

    def write(events: DataFrame, epoch: int = 0) -> None:
        requests = export_requests(events, frame(), fmt, keys, limits, epoch=str(epoch), **signing)
        requests.write.mode("overwrite").parquet(_epoch_folder(folder, epoch))
        drops = drop_counts(export_drops(events, frame(), fmt, sink))
        drops.write.mode("overwrite").parquet(_epoch_folder(f"{folder}/drops", epoch))

    return write


def counters_writer(folder: str, metrics: Sequence[Metric], max_series: int = 0, seq: str = "seq") -> Writer:
    """Keep running totals of event counters, one version per epoch."""

    def write(events: DataFrame, epoch: int = 0) -> None:
        count_limited(events.sparkSession, events, epoch, folder, metrics, max_series, seq)

    return write


def console_writer() -> Writer:
    """Print the line of every event on the driver's standard output, a partition at a time."""

    def write(events: DataFrame, epoch: int = 0) -> None:
        for row in json_lines(events).toLocalIterator(prefetchPartitions=True):
            print(row["value"])

    return write
