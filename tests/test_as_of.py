"""Events with the state that their object had when they were read."""

import random

import pytest
from conftest import event, ref
from pyspark.sql import functions as F
from test_shapes import KINDS

from eventloom.operators import enrich as enrichment
from eventloom.schema import EVENT, OBJECT

CHANGE = OBJECT.__class__(list(OBJECT.fields)).add("at", "long").add("seq", "long").add("change", "string")


def log(spark, changes):
    """Rows ``at, seq, change, name, uid, version`` as states of pods."""
    rows = [
        {"group": "", "kind": "Pod", "namespace": "a", "name": name, "uid": uid, "labels": {"version": version}, "annotations": {}}
        | {"deletionTimestamp": None, "ownerReferences": [], "at": at, "seq": seq, "change": change}
        for at, seq, change, name, uid, version in changes
    ]
    table = spark.createDataFrame([tuple(row[n] for n in CHANGE.names) for row in rows], CHANGE)
    return enrichment.project_objects(table, KINDS, carry=("at", "seq", "change"))


def model(changes, name, at, uid):
    known = [c for c in changes if c[3] == name and c[0] <= at]
    if not known:
        return "miss", None
    _, _, change, _, known_uid, version = max(known, key=lambda c: (c[0], c[1]))
    if change == "DELETED" or uid not in ("", known_uid):
        return "miss", None
    return "hit", version


@pytest.mark.parametrize(("span", "coalesce"), [(1, "true"), (7, "false"), (1000, "true")])
def test_state_as_of_the_event(spark, span, coalesce):
    """One hot object, one that comes and goes, one that is never there; several segments and ranges."""
    r = random.Random(span)
    changes = [(r.randrange(200), seq, r.choice(["ADDED", "MODIFIED", "DELETED"]), r.choice(["hot", "hot", "b"]), r.choice(["u", "w"]), f"v{seq}") for seq in range(60)]
    rows = []
    for k in range(300):
        name, uid, at = r.choice(["hot", "hot", "hot", "b", "none"]), r.choice(["", "u"]), r.randrange(-5, 210)
        made = event(uid=f"e{k}", namespace="a", regarding=ref(kind="Pod", namespace="a", name=name, uid=uid, apiVersion="v1"))
        rows.append((made, at, k, model(changes, name, at, uid)))
    rows.append((event(uid="off", namespace="a"), 5, 300, ("skipped", None)))
    rows.append((event(uid="kind", namespace="a", regarding=ref(kind="Job", namespace="a", name="j", apiVersion="v1")), 5, 301, ("undeclared", None)))
    rows.append((event(uid="far", namespace="b", regarding=ref(kind="Pod", namespace="a", name="hot", apiVersion="v1")), 5, 302, ("cross_namespace", None)))
    schema = EVENT.__class__(list(EVENT.fields)).add("at", "long").add("seq", "long").add("watch", "string")
    events = spark.createDataFrame([(*(made[n] for n in EVENT.names), at, k, None if k % 2 else "w") for made, at, k, _ in rows], schema)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        declared = enrichment.declared_kinds(KINDS, ["pods"])
        got = enrichment.enrich_as_of(events.repartition(3), log(spark, changes).repartition(2), declared, span=span).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    found = {row.uid: (row.enrich_result, row.regardingObject and row.regardingObject.labels["version"]) for row in got}
    assert found == {made["uid"]: expected for made, _, _, expected in rows}
    assert {result for result, _ in found.values()} == {"hit", "miss", "skipped", "undeclared", "cross_namespace"}


def test_no_changes_and_no_events(spark, events):
    declared = enrichment.declared_kinds(KINDS, ["pods"])
    none = log(spark, [])
    one = events(event(uid="1", namespace="a", regarding=ref(kind="Pod", namespace="a", name="p", apiVersion="v1"))).withColumns({"at": F.lit(1), "seq": F.lit(1), "watch": F.lit("w")})
    assert [row.enrich_result for row in enrichment.enrich_as_of(one, none, declared).collect()] == ["miss"]
    assert enrichment.enrich_as_of(one.limit(0), none, declared).count() == 0


def test_hot_objects_are_found_and_spread(spark, events):
    """Three tenths of the events on one object: no task has three times what the median one has."""
    declared = enrichment.declared_kinds(KINDS, ["pods"])
    made = spark.range(20_000).select(
        F.concat(F.lit("e"), "id").alias("uid"),
        F.lit("").alias("resourceVersion"),
        F.col("id").cast("string").alias("name"),
        F.lit("a").alias("namespace"),
        F.struct(
            F.lit("Pod").alias("kind"),
            F.lit("a").alias("namespace"),
            F.when(F.col("id") % 10 < 3, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 3000)).alias("name"),
            F.lit("").alias("uid"),
            F.lit("v1").alias("apiVersion"),
        ).alias("regarding"),
        F.lit(None).cast(EVENT["regardingObject"].dataType).alias("regardingObject"),
    )
    names = [("ADDED", "hot")] + [("ADDED", f"p{k}") for k in range(0, 3000, 2)]
    objects = log(spark, [(0, k, change, name, f"u{k}", f"v{k}") for k, (change, name) in enumerate(names)]).drop("at", "seq", "change")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        salts = enrichment.object_salts(made, declared)
        assert len(salts) < 10 and max(salts.values()) >= 8
        found = enrichment.enrich_spread(made, objects, declared)
        assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
        sizes = sorted(row["count"] for row in found.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sizes[-1] < 3 * sizes[len(sizes) // 2]
        plain = enrichment.enrich(made, objects, declared)
        columns = ["uid", "enrich_result", F.col("regardingObject.labels")["version"].alias("v")]
        assert {tuple(r) for r in found.select(*columns).collect()} == {tuple(r) for r in plain.select(*columns).collect()}
        assert found.count() == 20_000
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    none = enrichment.enrich_spread(made.limit(0), objects, declared)
    assert none.count() == 0
