"""Physical plans: what is read, and that no join goes through all pairs of rows."""

import re

import pytest

from fieldloom.plans.catalogue import QUERIES


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["valid_cells", "rolling_mean_15", "neighbours_8_wrap", "edge_distances", "radius_join", "gauss_smooth", "label_smooth", "bilinear_coarsen", "nearest_regrid", "same_cluster_edges", "pair_rms"])
def test_joins_are_on_keys(spark, small_dir, name):
    text = plan(QUERIES[name](spark, small_dir))
    assert "CartesianProduct" not in text
    # the only joins without a key put one row (the grid's step, the list of times) beside every row
    for line in re.findall(r"BroadcastNestedLoopJoin.*", text):
        assert "Cross" in line or "Inner" in line
        assert not re.search(r"BroadcastNestedLoopJoin \w+, \w+, \(.*[<>]", line), line


def test_scans_read_only_what_is_used(spark, small_dir):
    text = plan(QUERIES["valid_cells"](spark, small_dir))
    for schema in re.findall(r"ReadSchema: struct<(.*?)>", text):
        assert {c.split(":")[0] for c in schema.split(",")} <= {"l_suppkey", "l_discount", "l_shipdate"}
    text = plan(QUERIES["empty_cluster_ids"](spark, small_dir))
    assert "embedding:" not in text


def test_aggregates_combine_before_the_shuffle(spark, small_dir):
    for name in ("gaps_by_time", "small_clusters", "cluster_centroids"):
        assert "partial_" in plan(QUERIES[name](spark, small_dir))
