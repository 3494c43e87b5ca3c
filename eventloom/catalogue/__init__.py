"""Queries over the star-schema test tables, each with an equivalent SQL where one exists."""

from eventloom.catalogue import counts, encodings, rules, sampling, shapes, sources, streams  # noqa: F401
from eventloom.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
