"""Physical plans: what must not be in them, and what must."""

import pytest

from eventloom.catalogue import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(name for name in QUERIES if not name.startswith("stream_")))
def test_no_query_crosses_or_loops(spark, name):
    found = plan(spark, name)
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found
    assert "BatchEvalPython" not in found  # no row-at-a-time Python


@pytest.mark.parametrize("name", ["route_once", "filter_verdicts", "canonical_json", "kafka_rows", "gelf_rows", "field_lookup"])
def test_row_local_queries_do_not_shuffle_by_key(spark, name):
    assert "Exchange hashpartitioning" not in plan(spark, name)


def test_scans_read_only_what_a_query_needs(spark):
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan(spark, "warnings_by_namespace")
    assert "StringContains(props,9)" in plan(spark, "bench_substring")
    assert "Not(EqualTo(event_type,view))" in plan(spark, "field_selector_reason")


def test_only_one_exchange_counts_every_metric(spark):
    assert plan(spark, "metric_counts").count("Exchange hashpartitioning") == 1


def test_objects_are_joined_by_shuffle_beyond_the_broadcast_threshold(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(spark, "enriched_rows")
        assert "SortMergeJoin" in found and "Broadcast" not in found
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranking_keys_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "sample_first_seen")
