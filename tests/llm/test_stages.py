"""Every stage of the pipeline on empty tables, nulls in all columns, and columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA

CLASHING = ("row_id", "node", "label", "component_id", "score", "item_id", "rate", "copies", "size", "key", "cell", "rank", "parts", "steps", "identity", "rest", "copy_no")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, "a benchmark item of seven words altogether"), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_rows(spark, folder, name, stage):
    rows = [(k, f"some clean words number {k} that nobody else has written so far", "s", "en") for k in range(3)] + [(None, None, None, None)] * 2 + [(7, "", None, None), (8, "y" * 3_000_000, "s", None), (7, None, "s", None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in CLASHING}).repartition(2)
    if name == "sharding":
        # The last stage adds these, in place of any that were there.
        docs = docs.drop("size")
    out = stage(spark, docs, folder)
    assert set(docs.columns) <= set(out.columns) and (name == "sharding" or out.columns == docs.columns)
    kept = out.collect()
    if name != "mixing_sources":
        # Nothing here is toxic, a leak or a near copy: all rows stay.
        assert sorted(str(r.doc_id) for r in kept) == sorted(str(r[0]) for r in rows)
    assert all(r[c] == c for r in kept for c in CLASHING if c in docs.columns)
    assert name != "mixing_sources" or {r.doc_id for r in kept} <= {r[0] for r in rows}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_empty_documents(spark, folder, name, stage):
    docs = spark.createDataFrame([], SCHEMA).withColumns({c: F.lit(c) for c in CLASHING})
    assert stage(spark, docs, folder).count() == 0
