"""Cluster-event analytics as PySpark DataFrame operators.

The same operators run on batch tables and on Structured Streaming inputs:
normalise, sanitise, enrich, filter, route, encode, batch and count.
"""
