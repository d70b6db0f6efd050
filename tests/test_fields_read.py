"""Queries extract the fields they read and no others."""

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "unread"), [("f1_trusted_parsed", "authors"), ("j3_lookup_pmid", "ref_clean"), ("c6_journals_match", "ai_url_flag")])
def test_fields_that_are_not_read_are_not_extracted(spark, name, unread):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert unread not in plan
