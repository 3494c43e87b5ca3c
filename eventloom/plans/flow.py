"""The event path as one lazily built plan, for batches and micro-batches alike."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.enrich import Allowlist, Kind, enrich, project_objects, unique_objects
from eventloom.operators.lift import lift
from eventloom.operators.routing import match, route
from eventloom.operators.sanitize import SanitizeSpec, sanitize
from eventloom.plans.spec import Flow, check_bindings
from eventloom.sources.events import Watch, check_watches, deliverable_frames, frame_events


@dataclass(frozen=True)
class EventPath:
    """What happens to an event between a watch and the sinks."""

    watches: Sequence[Watch]
    flows: Sequence[Flow]
    sinks: Sequence[str]
    sanitizers: SanitizeSpec = SanitizeSpec()
    kinds: Sequence[Kind] = ()
    declared: Sequence[Kind] = ()
    labels: Allowlist = Allowlist()
    annotations: Allowlist = field(default_factory=lambda: Allowlist(enabled=False))

    def __post_init__(self) -> None:
        check_watches(self.watches)
        check_bindings(self.flows, [watch.name for watch in self.watches], self.sinks)

    def events(
        self,
        frames: DataFrame,
        ingest_ts: Column | str,
        objects: DataFrame | None = None,
        replay: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """Return the sanitised, enriched events of the deliverable frames; ``replay`` drops lifted ones delivered before."""
        raw = frame_events(deliverable_frames(frames))
        lifted = lift(raw, ingest_ts, carry=("watch", "seq"))
        events = sanitize(lifted if replay is None else replay(lifted), self.sanitizers)
        if objects is None or not self.declared:
            return events
        projected = project_objects(objects, self.kinds, self.labels, self.annotations, self.sanitizers)
        return enrich(events, unique_objects(projected), self.declared)

    def matched(self, events: DataFrame, flows: Sequence[Flow] | None = None) -> DataFrame:
        """Return the events with every flow's verdict."""
        return match(events, self.flows if flows is None else flows)

    def routed(self, frames: DataFrame, ingest_ts: Column | str, objects: DataFrame | None = None) -> DataFrame:
        """Return one row per event and reached sink."""
        return route(self.matched(self.events(frames, ingest_ts, objects)))


def read_time() -> Column:
    """Return the read time of a run: one value for the whole query."""
    return F.current_timestamp()
