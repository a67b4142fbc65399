"""Every registered query against its SQL check, on the smallest tables."""

import os

import pytest

import check_queries as check
from latticeworks.catalog.all import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    ok, message, _, _ = check.compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, message


@pytest.mark.parametrize("name", ["cell_feature_table", "regional_table", "point_in_region_join", "nearest_poi"])
def test_plans_stay_equi_joined(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_flagship_reads_only_what_it_needs(spark):
    plan = QUERIES["cell_size_statistics"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_discount)]" in plan
    assert "l_returnflag" not in plan and "l_quantity" not in plan
