"""Physical plans are the ones intended."""

import contextlib
import io

import pytest

from folioscan import derive
from folioscan.queries import load

QUERIES, _ = load()
D = "/root/testdata/sf0.001"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan_of(QUERIES[name](spark, D))


@pytest.mark.parametrize("name", ["j1_ending_near", "j2_three_nearest_of_class", "j8_boxes_inside", "j14_viewport_of_point", "a10_nearest_neighbour", "g7_overlaps", "j13_aimed_at", "j28_values_beside"])
def test_range_joins_are_equality_joins(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "NestedLoop" not in plan_of(QUERIES[name](spark, D))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scans_read_only_the_columns_asked_for(spark):
    plan = plan_of(QUERIES["t_first_seen"](spark, D))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(derive.table(spark, D, "lineitem").where("l_orderkey > 100").select("l_quantity"))
    assert "GreaterThan(l_orderkey,100)" in plan
