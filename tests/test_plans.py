"""Shapes of physical plans that matter at scale."""

import os

import pytest
from pyspark.sql import functions as F

from slotvalue.plans import tables
from slotvalue.plans.queries import QUERIES
from tests.test_queries import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data is not mounted")

BATCH = sorted(name for name in QUERIES if not name.startswith("stream"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_nested_loop_joins(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["capped_detections", "topk_match", "majority_vote", "evidence_fusion"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert text.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["top_report", "review_worst", "search_items"])
def test_reports_use_a_top_n_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, DATA))


@pytest.mark.parametrize(
    "name, absent",
    [("link_certainty", "p_retailprice"), ("asset_digests", "n_chars"), ("exact_dups", "source"), ("version_delta", "l_suppkey")],
)
def test_scans_read_only_needed_columns(spark, name, absent):
    scans = [line for line in plan(QUERIES[name](spark, DATA)).splitlines() if "FileScan" in line]
    assert scans and not any(absent in line for line in scans)


def test_filters_reach_the_scan(spark):
    # The filter of correction_samples, whose ranking writes the filtered rows before its last plan.
    text = plan(tables.line_items(spark, DATA).where(F.col("rf") == "R").groupBy("ok", "pk").agg(F.max("day")))
    assert "EqualTo(l_returnflag,R)" in text


@pytest.mark.parametrize(
    "name", ["keep_ditch", "rank_by_slot", "least_certain", "class_vocab", "dup_groups", "sampled_icons", "balanced_queue", "correction_samples"]
)
def test_nothing_is_ranked_in_one_partition(spark, name):
    assert "SinglePartition" not in plan(QUERIES[name](spark, DATA))


@pytest.mark.parametrize("name, absent", [("identity_agreement", ["p_name", "p_brand", "p_retailprice"]), ("recall_report", ["p_name", "p_brand", "p_retailprice"])])
def test_fusion_carries_only_the_item_columns_it_returns(spark, name, absent):
    text = plan(QUERIES[name](spark, DATA))
    assert "p_partkey" in text and not any(column in text for column in absent)


@pytest.mark.parametrize("name", ["rank_by_slot", "least_certain"])
def test_small_sessions_are_not_written_to_be_ranked(spark, name):
    assert "ExistingRDD" not in plan(QUERIES[name](spark, DATA))


@pytest.mark.parametrize("name", ["identity_agreement", "recall_report", "unidentified", "detections_roundtrip"])
def test_fusion_sends_no_catalog_whole_and_sorts_no_detections(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert text.count("ShuffledHashJoin") >= 2 and "BroadcastHashJoin" not in text and "SortMergeJoin" not in text
