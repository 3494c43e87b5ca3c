"""Definitions of flows, and the checks across them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from eventloom.operators.filters import Rule, RuleError, check_rules
from eventloom.sources.events import ALL_NAMESPACES

_NAME = re.compile(r"[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?")


class BindingError(ValueError):
    """Flows, watches and sinks do not fit together."""


@dataclass(frozen=True)
class Flow:
    """Filter rules between watches and sinks; no watches takes every watch."""

    name: str
    sinks: tuple[str, ...]
    filters: tuple[Rule, ...] = ()
    watches: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if not _NAME.fullmatch(self.name):
            raise BindingError(f"flow name {self.name!r} is invalid")
        if not self.sinks:
            raise BindingError(f"{self.name}: sinks must not be empty")
        if self.watches is not None and not self.watches:
            raise BindingError(f"{self.name}: watches must not be empty")
        for names in (self.sinks, self.watches or ()):
            if len(set(names)) != len(names):
                raise BindingError(f"{self.name}: a name is listed twice")
        for rule in self.filters:
            if isinstance(rule, str) and not rule.strip():
                raise BindingError(f"{self.name}: a filter must not be empty")


def binding_faults(flows: Sequence[Flow], watches: Iterable[str], sinks: Iterable[str]) -> dict[str, set[str]]:
    """Return what keeps flows, watches and sinks from fitting together: the names at fault, by the kind of fault."""
    offered = {"watch": set(watches), "sink": set(sinks)}
    asked = {
        "watch": {watch for flow in flows for watch in flow.watches or ()},
        "sink": {sink for flow in flows for sink in flow.sinks},
    }
    # A flow that asks for no watch gets them all.
    served = asked | ({"watch": offered["watch"]} if any(flow.watches is None for flow in flows) else {})
    times = Counter(flow.name for flow in flows)
    faults = {
        "flow given more than once": {name for name, count in times.items() if count > 1},
        "malformed sink name": {name for name in offered["sink"] if not _NAME.fullmatch(name)},
        "flow that narrows a watch of everything": {
            flow.name for flow in flows if flow.watches and ALL_NAMESPACES in offered["watch"]
        },
    }
    for kind in offered:
        faults[f"{kind} asked for but not there"] = asked[kind] - offered[kind]
        faults[f"{kind} that serves no flow"] = offered[kind] - served[kind]
    return {kind: names for kind, names in faults.items() if names}


def check_bindings(flows: Sequence[Flow], watches: Iterable[str], sinks: Iterable[str]) -> None:
    """Refuse flows, watches and sinks that do not fit together, naming every fault."""
    if faults := binding_faults(flows, watches, sinks):
        raise BindingError("; ".join(f"{kind}: {', '.join(sorted(names))}" for kind, names in faults.items()))


def accepted_flows(spark: SparkSession, flows: Sequence[Flow], next_flows: Sequence[Flow]) -> tuple[list[Flow], bool]:
    """Return the flows with the next filters, or, where one of those is refused, as they are; and which of the two."""
    swapped = swap_filters(flows, next_flows)
    try:
        for flow in swapped:
            check_rules(spark, flow.filters)
    except RuleError:
        return list(flows), False
    return swapped, True


def swap_filters(flows: Sequence[Flow], next_flows: Sequence[Flow]) -> list[Flow]:
    """Take new filters for all flows at once.

    A flow gone from the new definitions keeps its filters. Watches and sinks
    keep the values they started with, and new flows wait for a restart.
    """
    newer = {flow.name: flow for flow in next_flows}
    return [replace(flow, filters=newer[flow.name].filters) if flow.name in newer else flow for flow in flows]
