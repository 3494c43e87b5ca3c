"""Attaching the metadata of the object an event regards."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import truncate_bytes, valid_utf8
from eventloom.operators.lift import clean_values
from eventloom.operators.sampling import first_seen, with_suppressed
from eventloom.operators.sanitize import SanitizeSpec, sanitize_metadata
from eventloom.operators.segments import SEGMENT, SPAN, before, in_segment, join_carry, rejoin, with_segment
from eventloom.schema import REGARDING_OBJECT, STRING_MAP, reference
from eventloom.scratch import keep

OUTCOMES = ("hit", "miss", "undeclared", "cross_namespace", "skipped")

_OFF_JOIN_SALTS = 1024

_OBJECT_KEY = ["group", "kind", "namespace", "name"]
#: Objects that are spread at most; any other has less than its inverse of all look-ups.
MOST_HOT = 10_000


@dataclass(frozen=True)
class Kind:
    """A resource kind as discovery lists it."""

    resource: str
    group: str
    kind: str
    namespaced: bool

    @property
    def name(self) -> str:
        return f"{self.resource}.{self.group}" if self.group else self.resource


@dataclass(frozen=True)
class Allowlist:
    """Metadata keys to copy; no keys copies all, disabled copies none."""

    enabled: bool = True
    keys: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.keys and not self.enabled:
            raise ValueError("keys have no effect unless the list is enabled")


def load_kinds(kinds: DataFrame, resources: Sequence[str]) -> list[Kind]:
    """Read the kinds that resource names stand for from a discovery table ``resource, group, kind, namespaced``.

    A name that stands for several is refused. At most one row a name is read.
    """
    name = F.when(F.col("group") == "", F.col("resource")).otherwise(F.concat_ws(".", "resource", "group"))
    columns = ("resource", "group", "kind", "namespaced")
    named = kinds.select(*columns, name.alias("name")).filter(F.col("name").isin(list(resources)))
    one = named.groupBy("name").agg(
        F.min(F.struct(*columns)).alias("kind"), F.max(F.struct(*columns)).alias("other")
    )
    rows = one.collect()
    if unclear := sorted(row["name"] for row in rows if row["kind"] != row["other"]):
        raise ValueError(f"names of several kinds: {', '.join(unclear)}")
    return [Kind(*row["kind"]) for row in rows]


def declared_kinds(kinds: Iterable[Kind], resources: Sequence[str]) -> list[Kind]:
    """Resolve declared resource names to kinds.

    A name that resolves to nothing is skipped; two names for one kind are refused.
    """
    by_name = {}
    for kind in kinds:
        by_name.setdefault(kind.name, kind)
    found: dict[tuple[str, str], Kind] = {}
    for name in resources:
        kind = by_name.get(name)
        if kind is None:
            continue
        if (kind.group, kind.kind) in found:
            raise ValueError(f"resource {name!r} resolves to {kind.kind}, which is already declared")
        found[kind.group, kind.kind] = kind
    return list(found.values())


def api_group(api_version: Column) -> Column:
    """Return the group of an apiVersion; one with several slashes is its own group."""
    slashes = F.length(api_version) - F.length(F.replace(api_version, F.lit("/"), F.lit("")))
    return (
        F.when((slashes == 0) | (api_version == "/"), F.lit(""))
        .when(slashes == 1, F.substring_index(api_version, "/", 1))
        .otherwise(api_version)
    )


def _scope(kinds: Iterable[Kind], group: Column, kind: Column) -> Column:
    """Return whether a group and kind is namespaced, NULL when it is not listed."""
    scopes: dict[tuple[str, bool], list[str]] = {}
    for known in kinds:
        scopes.setdefault((known.group, known.namespaced), []).append(known.kind)
    scope = F.lit(None).cast("boolean")
    for (known_group, namespaced), names in sorted(scopes.items()):
        scope = F.when((group == known_group) & kind.isin(sorted(set(names))), F.lit(namespaced)).otherwise(scope)
    return scope


def _allow(entries: Column, allowlist: Allowlist) -> Column:
    if not allowlist.enabled:
        return F.create_map().cast(STRING_MAP)
    entries = F.coalesce(entries, F.create_map().cast(STRING_MAP))
    if not allowlist.keys:
        return entries
    return F.map_filter(entries, lambda key, _: key.isin(list(allowlist.keys)))


def controller_owner(kinds: Iterable[Kind]) -> Column:
    """Return the controlling owner as a reference, namespaced only for a namespaced kind."""
    controllers = F.filter(F.col("ownerReferences"), lambda owner: F.coalesce(owner["controller"], F.lit(False)))
    owner = F.get(controllers, F.lit(0))
    namespaced = _scope(kinds, api_group(owner["apiVersion"]), owner["kind"])
    built = reference(
        kind=valid_utf8(F.coalesce(owner["kind"], F.lit(""))),
        namespace=F.when(namespaced, F.coalesce(F.col("namespace"), F.lit(""))).otherwise(F.lit("")),
        name=valid_utf8(F.coalesce(owner["name"], F.lit(""))),
        uid=valid_utf8(F.coalesce(owner["uid"], F.lit(""))),
        apiVersion=valid_utf8(F.coalesce(owner["apiVersion"], F.lit(""))),
    )
    return F.when(owner.isNotNull(), built)


def project_objects(
    objects: DataFrame,
    kinds: Iterable[Kind],
    labels: Allowlist = Allowlist(),
    annotations: Allowlist = Allowlist(enabled=False),
    spec: SanitizeSpec = SanitizeSpec(),
    carry: Sequence[str] = (),
) -> DataFrame:
    """Reduce objects to the metadata an event carries: keys plus one ``regardingObject`` struct, and the ``carry`` columns."""
    kept_labels = _allow(F.col("labels"), labels)
    kept_annotations = clean_values(_allow(F.col("annotations"), annotations))
    kept_labels, kept_annotations = sanitize_metadata(kept_labels, kept_annotations, spec)
    projected = F.struct(
        kept_labels.alias("labels"),
        kept_annotations.alias("annotations"),
        controller_owner(kinds).alias("owner"),
        F.col("deletionTimestamp").isNotNull().alias("terminating"),
    )
    return objects.select(
        "group",
        "kind",
        F.coalesce("namespace", F.lit("")).alias("namespace"),
        "name",
        "uid",
        projected.cast(REGARDING_OBJECT).alias("regardingObject"),
        *carry,
    )


def unique_objects(objects: DataFrame) -> DataFrame:
    """Keep one projected row per object, that with the least uid, so that an event never becomes two."""
    keys = ["group", "kind", "namespace", "name"]
    one = objects.groupBy(*keys).agg(F.min_by(F.struct("uid", "regardingObject"), "uid").alias("one"))
    return one.select(*keys, "one.*")


def latest_objects(changes: DataFrame) -> DataFrame:
    """Return the newest live state per object from a change log ``seq, change, object columns``.

    The sequence winner is found on the narrow keys; partial aggregation keeps
    an often-changed object from concentrating on one task.
    """
    keys = ["group", "kind", "namespace", "name"]
    state = [name for name in changes.columns if name not in (*keys, "seq")]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*state), "seq").alias("state"))
    return newest.filter(F.col("state.change") != "DELETED").select(
        *keys, *[F.col(f"state.{name}").alias(name) for name in state if name != "change"]
    )


def _lookup(declared: Sequence[Kind]) -> tuple[Column, Column, Column]:
    """Return why an event looks no object up (NULL if it does), and the group and namespace of the object it regards."""
    group = api_group(F.col("regarding.apiVersion"))
    namespaced = _scope(declared, group, F.col("regarding.kind"))
    barred = (
        F.when((F.col("regarding.kind") == "") | (F.col("regarding.name") == ""), F.lit("skipped"))
        .when(namespaced.isNull(), F.lit("undeclared"))
        .when(namespaced & (F.col("regarding.namespace") != F.col("namespace")), F.lit("cross_namespace"))
    )
    return barred, group, F.when(namespaced, F.col("regarding.namespace")).otherwise(F.lit(""))


def enrich(
    events: DataFrame,
    objects: DataFrame,
    declared: Sequence[Kind],
    hot_object_salts: int | Mapping[int, int] = 1,
) -> DataFrame:
    """Attach ``regardingObject`` and ``enrich_result`` to each event.

    ``objects`` comes from :func:`project_objects` and holds one row per object
    (see :func:`unique_objects` and :func:`latest_objects`). The join is an equi left
    join: Spark broadcasts the objects when their measured size allows, and
    shuffles both sides otherwise. Events that look nothing up never share a
    key with an object and are spread over salts of their own. With
    ``hot_object_salts`` above one all objects are replicated that often, and
    the events of a much-regarded object spread over as many tasks; a mapping
    of :func:`object_salts` does so for the objects that need it only, see
    :func:`enrich_spread`.
    """
    if not declared:
        return events
    barred, group, namespace = _lookup(declared)
    spread = F.xxhash64("uid", "resourceVersion", "name")
    keyed = events.drop("regardingObject").withColumns({"_barred": barred, "_group": group, "_namespace": namespace})
    salted = objects
    if isinstance(hot_object_salts, Mapping):
        # At most MOST_HOT rows, see object_salts.
        rows = list(hot_object_salts.items()) or [(0, 1)]
        salts = F.broadcast(events.sparkSession.createDataFrame(rows, "_object bigint, _salts int"))
        named = _object_hash(F.col("_group"), F.col("regarding.kind"), F.col("_namespace"), F.col("regarding.name"))
        keyed = keyed.withColumn("_object", named).join(salts, "_object", "left").drop("_object")
        named = _object_hash(*(F.col(name) for name in _OBJECT_KEY))
        salted = objects.withColumn("_object", named).join(salts, "_object", "left").drop("_object")
        many = F.coalesce("_salts", F.lit(1))
    else:
        many = F.lit(hot_object_salts)
    off_join = F.lit(1 << 20) + F.pmod(spread, F.lit(_OFF_JOIN_SALTS))
    salt = F.when(F.col("_barred").isNull(), F.pmod(spread, many)).otherwise(off_join)
    keyed = keyed.withColumn("_salt", salt.cast("int"))
    found = salted.select(
        F.col("group").alias("_group"),
        F.col("kind").alias("_kind"),
        F.col("namespace").alias("_namespace"),
        F.col("name").alias("_name"),
        F.col("uid").alias("_uid"),
        F.col("regardingObject").alias("_found"),
        F.explode(F.sequence(F.lit(0), many - 1)).alias("_salt"),
    )
    joined = keyed.join(
        found,
        (keyed["_salt"] == found["_salt"])
        & (keyed["_group"] == found["_group"])
        & (keyed["regarding.kind"] == found["_kind"])
        & (keyed["_namespace"] == found["_namespace"])
        & (keyed["regarding.name"] == found["_name"]),
        "left",
    )
    same_uid = (F.col("regarding.uid") == "") | (F.col("regarding.uid") == F.col("_uid"))
    hit = F.col("_barred").isNull() & F.col("_found").isNotNull() & same_uid
    result = F.coalesce(F.col("_barred"), F.when(hit, F.lit("hit")).otherwise(F.lit("miss")))
    kept = [keyed[name] for name in events.columns if name != "regardingObject"]
    return joined.select(
        *kept,
        F.when(hit, F.col("_found")).alias("regardingObject"),
        result.alias("enrich_result"),
    )


def _object_hash(group: Column, kind: Column, namespace: Column, name: Column) -> Column:
    return F.xxhash64(group, kind, namespace, name)


def object_salts(events: DataFrame, declared: Sequence[Kind], tasks: int | None = None) -> dict[int, int]:
    """Find the objects that many events regard, and over how many tasks each has to spread.

    One pass keeps a summary of frequent look-ups, of bounded size and merged
    over tasks by Spark; it reads nothing of an event but what names its
    object. An object with more than half of what one of ``tasks`` (by default
    the shuffle partitions) takes on average is spread so that each part has
    less. At most ``MOST_HOT`` objects come to the driver.
    """
    spark = events.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    barred, group, namespace = _lookup(declared)
    looked_up = events.where(barred.isNull()).select(
        _object_hash(group, F.col("regarding.kind"), namespace, F.col("regarding.name")).alias("object")
    )
    most = min(MOST_HOT, 2 * tasks)
    found = looked_up.agg(F.expr(f"approx_top_k(object, {most}, {10 * most})").alias("top"), F.count("*").alias("all")).first()
    part = max(found["all"] / tasks / 2, 1)
    return {row["item"]: math.ceil(row["count"] / part) for row in found["top"] or [] if row["count"] > part}


def enrich_spread(events: DataFrame, objects: DataFrame, declared: Sequence[Kind]) -> DataFrame:
    """Attach objects like :func:`enrich`, with the events of much-regarded objects spread over tasks.

    For objects too large to broadcast. Which objects are hot is found in a
    pass of its own over the events, so hand in a written table where what is
    above them is dear.
    """
    return enrich(events, objects, declared, object_salts(events, declared)) if declared else events


def enrich_as_of(
    events: DataFrame,
    changes: DataFrame,
    declared: Sequence[Kind],
    at: str = "at",
    event_id: Sequence[str] = ("watch", "seq"),
    span: int = SPAN,
) -> DataFrame:
    """Attach the metadata that the regarded object had when the event was read.

    ``changes`` is a log of object states: ``at``, ``seq``, ``change``, the
    object key and what :func:`project_objects` returns. An event meets the
    last change of its object whose ``at`` is not after its own, among equal
    ones that with the greatest ``seq``; a deletion leaves nothing to meet.
    ``at`` is any ordered type, the same on both sides, and ``event_id`` names
    columns that tell events apart, the last of them ordered.

    Changes and look-ups are merged in one order and cut into segments, and the
    last state is carried over their borders. So it is no range join, and an
    object with a third of all events, or of all changes, spreads over as many
    segments as it has rows for. Only the narrow look-ups are sorted; events
    that look nothing up take no part.
    """
    barred, group, namespace = _lookup(declared)
    *keys, seq = event_id
    ids = [F.col(name).alias(f"_id_{name}") for name in event_id]
    key = [F.col(name).alias(f"_{name}") for name in _OBJECT_KEY]
    lookups = events.where(barred.isNull()).select(
        group.alias("_group"),
        F.col("regarding.kind").alias("_kind"),
        namespace.alias("_namespace"),
        F.col("regarding.name").alias("_name"),
        F.struct(F.col(at).alias("at"), F.lit(1).alias("after"), F.col(seq).cast("bigint").alias("seq")).alias("_at"),
        *ids,
    )
    state = F.struct((F.col("change") == "DELETED").alias("gone"), F.col("uid"), F.col("regardingObject").alias("object"))
    states = changes.select(
        *key, F.struct(F.col(at).alias("at"), F.lit(0).alias("after"), F.col("seq").cast("bigint").alias("seq")).alias("_at"), state.alias("_state")
    )
    names = [f"_{name}" for name in _OBJECT_KEY]
    merged = with_segment(lookups.unionByName(states, allowMissingColumns=True), names, span, "_at")
    window = in_segment(names, "_at")
    latest = F.last("_state", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    running = merged.select("*", latest.alias("_latest"), F.lead("_at").over(window).isNull().alias("_ends"))
    carry = running.where("_ends").select(*names, SEGMENT, F.last("_latest", ignorenulls=True).over(before(names)).alias("_carried"))
    met = join_carry(running.where("_at.after = 1"), carry, names)
    found = met.select(*(F.col(f"_id_{name}").alias(name) for name in event_id), F.coalesce("_latest", "_carried").alias("_met"))
    joined = rejoin(events.drop("regardingObject"), found, keys, seq, "left")
    same_uid = (F.col("regarding.uid") == "") | (F.col("regarding.uid") == F.col("_met.uid"))
    hit = F.coalesce(barred.isNull() & ~F.col("_met.gone") & same_uid, F.lit(False))
    result = F.coalesce(barred, F.when(hit, F.lit("hit")).otherwise(F.lit("miss")))
    kept = [name for name in events.columns if name != "regardingObject"]
    return joined.select(*kept, F.when(hit, F.col("_met.object")).alias("regardingObject"), result.alias("enrich_result"))


def enrich_counts(enriched: DataFrame) -> DataFrame:
    """Count the events per enrichment outcome."""
    return enriched.groupBy("enrich_result").agg(F.count("*").alias("events"))


#: Bytes of a name that a report keys by at most.
REPORT_BYTES = 253


def lookup_reports(enriched: DataFrame, limit: int = 64) -> DataFrame:
    """Return what a run reports of look-ups that its declarations do not cover, each once.

    The rows are ``outcome, subject, detail, seq, suppressed``: of
    ``undeclared`` events the group and kind that no declaration covers, of
    ``cross_namespace`` ones the namespaces of the event and of the object it
    regards; ``seq`` of the event that showed it first, for the first ``limit``
    of each outcome; and how many such events came since the report before.
    Names are cut to ``REPORT_BYTES`` bytes. The parts are those of a
    first-seen gate with the outcome as its gate.
    """
    def cut(value: Column) -> Column:
        return truncate_bytes(value, REPORT_BYTES)

    outcome = F.col("enrich_result")
    undeclared = outcome == "undeclared"
    key = F.struct(
        F.when(undeclared, cut(api_group(F.col("regarding.apiVersion")))).otherwise(cut(F.col("namespace"))).alias("subject"),
        F.when(undeclared, cut(F.col("regarding.kind"))).otherwise(cut(F.col("regarding.namespace"))).alias("detail"),
    )
    rows = enriched.where(outcome.isin("undeclared", "cross_namespace")).select(outcome.alias("gate"), "seq", key.alias("key"))
    reported = with_suppressed(first_seen(keep(rows, "lookups"), limit))
    return reported.select(F.col("gate").alias("outcome"), "key.subject", "key.detail", "seq", "suppressed")
