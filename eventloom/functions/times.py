"""Time texts. The session time zone has to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc3339_micro(time: Column) -> Column:
    """Format with six fraction digits, NULL for an absent time."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def rfc3339_trimmed(time: Column) -> Column:
    """Format with trailing fraction zeros removed."""
    return F.regexp_replace(rfc3339_micro(time), r"\.?0+Z$", "Z")


def occurrence_time() -> Column:
    """Return when an event last occurred: its series' last observation, else its event time."""
    return F.coalesce(F.col("series.lastObservedTime"), F.col("eventTime"))
