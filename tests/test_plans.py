"""Physical plans: shuffles counted, filters and columns at the scan, no Python where built-ins do."""

from __future__ import annotations

import re

import pytest

from gridloom.catalog import QUERIES

#: Exchanges that the plan may have (a broadcast counts apart).
SHUFFLES = {
    "neighbourhood_edge": 1, "neighbourhood_skip": 1, "neighbourhood_along_axes": 1, "edge_detection": 1, "group_votes": 1, "group_scans": 1, "group_permute_and_select": 1, "reduction_known": 1,
    "reduction_of_a_dimension": 1, "slice_contraction": 3, "map_sine": 0, "map_condition": 0, "transpose": 0, "linear_ids": 0, "allocation_window": 0, "box_of_cells": 0, "even_split": 1, "contrast_stretch": 1, "last_writer": 2, "merge_intervals": 1,
    "dissect_intervals": 2, "joint_algorithms": 0, "index_space_2d": 0, "host_each_item": 0, "fixed_box": 1,
}
PYTHON = {"host_each_item"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_shuffles(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    found = re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single|RoundRobin)\w*", plan)
    assert len(found) <= SHUFFLES[name], plan
    assert bool(re.search("Python|Pandas|Arrow", plan)) == (name in PYTHON)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["box_of_cells"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(vec_id,100\)", plan) and "label" not in plan
    plan = plan_of(QUERIES["map_with_offset"](spark, sf_dir))
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>", plan)


def test_small_sides_are_broadcast_and_large_ones_not(spark, sf_dir):
    assert "BroadcastNestedLoopJoin" not in plan_of(QUERIES["one_to_one"](spark, sf_dir))
    assert "CartesianProduct" not in "".join(plan_of(QUERIES[n](spark, sf_dir)) for n in ("contrast_stretch", "fixed_box", "whole_buffer", "box_intersections"))
    assert "BroadcastNestedLoopJoin" not in "".join(plan_of(QUERIES[n](spark, sf_dir)) for n in ("box_intersections", "region_union", "region_map", "region_values"))
