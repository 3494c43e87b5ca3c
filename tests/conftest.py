from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
sys.path.insert(0, os.path.dirname(__file__))

from eventloom.schema import EVENT, REFERENCE_FIELDS  # noqa: E402
from eventloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def utc(*parts: int) -> dt.datetime:
    return dt.datetime(*parts, tzinfo=dt.timezone.utc)


def ref(**fields: str) -> dict:
    return {name: fields.get(name, "") for name in REFERENCE_FIELDS}


def event(**fields) -> dict:
    """A canonical event; what is not given is absent."""
    made = {name: "" for name in EVENT.names}
    made |= {
        "labels": {},
        "annotations": {},
        "eventTime": None,
        "series": None,
        "regarding": ref(),
        "related": None,
        "regardingObject": None,
    }
    return made | fields


@pytest.fixture
def events(spark):
    def make(*rows: dict, **extra: str):
        schema = EVENT
        for name, kind in extra.items():
            schema = schema.__class__(list(schema.fields)).add(name, kind)
        return spark.createDataFrame([tuple(row[name] for name in schema.names) for row in rows], schema)

    return make
