"""A validation moves no more than lookups read, and searches only for citations that ask for it."""

from citesieve.operators import candidates, lookup
from citesieve.plans import fixtures as fx
from citesieve.plans import queries

SMALL = "/root/testdata/sf0.001"


def test_no_index_of_titles_is_made_if_no_citation_is_searched(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(candidates, "search_index", refused)
    rows = queries.g5_labels_of_physics_routes(spark, SMALL).groupBy("source").count().collect()
    assert {r.source for r in rows} == {"DataCite (arXiv)", "NASA ADS", ""}


def test_resolver_and_types_are_asked_without_the_reference_and_the_whole_record(spark, monkeypatch):
    seen = []
    for name in ("resolve_doi", "review_lookup"):
        monkeypatch.setattr(lookup, name, lambda df, *rest, own=getattr(lookup, name): seen.append(df) or own(df, *rest))
    queries.validated(spark, SMALL)
    assert len(seen) == 2
    for df in seen:
        assert not {"ref", "reference", "ref_clean", "evidence", "comparison"} & set(df.columns)
        assert set(df.select("record.*").columns) == {"source", "doi", "dois", "title"}


def test_records_of_a_small_table_are_made_by_all_cores(spark):
    """Each of the five kinds of records, from a part table of one row group."""
    assert fx.works(spark, SMALL).rdd.getNumPartitions() >= 5 * spark.sparkContext.defaultParallelism


def test_citations_that_agree_in_full_are_not_searched_further(spark, monkeypatch):
    asked = fx._run(spark, SMALL, "SELECT ref_id, mode, t_title AS title, CAST(t_year AS INT) AS year, array(t_s1, t_s2, s3) AS authors, false AS uses_et_al, t_s1 AS first_author, lower(t_journal) AS journal FROM citations").filter("mode = 0 OR ref_id % 24 = 1")
    works, left = fx.works(spark, SMALL), []
    monkeypatch.setattr(candidates, "_top", lambda weighed, *rest, own=candidates._top: left.append(weighed.count()) or own(weighed, *rest))
    want = {r.ref_id: r.record_id for r in candidates.choose_best_candidate(candidates.scored_candidates(candidates.search_candidates(asked, works), asked)).select("ref_id", "record.record_id").collect()}
    left.clear()
    got = {r.ref_id: r.record_id for r in candidates.best_choices(asked, works).select("ref_id", "choice.record_id").collect()}
    assert got == want
    others = asked.filter("mode = 1").select("title", "year").distinct().count()
    assert left == [others] and others < asked.select("title", "year").distinct().count()
