"""Costly expressions of queries over citations are computed once a row."""

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["x15_x16_shape", "x6_extract_journal", "x7_vol_issue_pages"])
def test_references_are_cleaned_once(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\[online\]") == 1
