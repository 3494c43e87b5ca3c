"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from eventloom.session import shared_folder

_KEPT: ContextVar[list[str] | None] = ContextVar("kept", default=None)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def keep(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back.

    What was computed is then read, by however many scans follow, and never
    computed again, also after an executor is lost. The table is deleted with
    the ``scratch`` block around the call, else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    kept = _KEPT.get()
    if kept is None:
        system, place = _file_system(spark, path)
        system.deleteOnExit(place)
    else:
        kept.append(path)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are kept within the block when it ends, as in each epoch of a stream."""
    kept: list[str] = []
    token = _KEPT.set(kept)
    try:
        yield
    finally:
        _KEPT.reset(token)
        for path in kept:
            system, place = _file_system(spark, path)
            system.delete(place, True)
