"""Plans that the lists and searches must have at any size."""

import pytest

from bidweave.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["k1_profile_match", "o1_current_sled", "a10_agency_activity", "q2_claimed_jobs"])
def test_ranked_lists_are_top_k(spark, name):
    text = plan(spark, name)
    assert "TakeOrderedAndProject" in text and "Python" not in text


@pytest.mark.parametrize("name", ["f4_search_inventory", "a9_agencies_by_state"])
def test_totals_need_no_global_window(spark, name):
    assert "Window" not in plan(spark, name)


def test_state_coverage_is_an_equi_join(spark):
    assert "NestedLoop" not in plan(spark, "a6_state_coverage")


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n[0] in "aekmuq"])
def test_no_python_in_plans(spark, name):
    assert "Python" not in plan(spark, name) and "Pandas" not in plan(spark, name)


def test_scans_read_few_columns(spark):
    text = plan(spark, "a1_document_state")
    assert "l_extendedprice" not in text and "l_comment" not in text
