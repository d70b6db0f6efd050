"""Queries that once read chosen citations take all that their operator takes."""

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "modes"), [("g4_assemble_notes", {0, 1, 2, 3, 9, 10}), ("j11_ads_discovery", {0, 1, 2, 3, 4, 9})])
def test_all_citations_are_read(spark, name, modes):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("orders", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    assert {ref_id % 12 for ref_id, _ in got} == modes
