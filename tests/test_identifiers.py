"""The index of identifiers against one lookup at a time, its plan and its bucketed table; run records; signatures."""

import pytest
from pyspark.sql import functions as F

from citesieve.operators import candidates, identifiers, lookup, report, sinks
from citesieve.sources.catalogue import as_works, crossref_works

WORKS = "source string, record_id string, doi string, pmid string, pmcid string, arxiv_id string, identifiers array<string>, title string"
HELD = [
    ("Crossref", "10.1/B", "10.1/B.", None, None, None, None, "b"), ("Crossref", "10.1/A", "10.1/b", None, None, None, None, "a"), ("Crossref", "x", "", None, None, None, None, "blank"), ("Crossref", "y", None, None, None, None, None, "none"),
    ("PubMed/PMC", "7", None, "7", None, None, None, "seven"), ("PubMed/PMC", "PMC8", None, "7", "pmc8", None, None, "eight"), ("PubMed/PMC", "PMC9", None, None, "PMC9", None, None, "nine"),
    ("arXiv", "2101.1v1", None, None, None, "2101.1v1", None, "first"), ("arXiv", "2101.1v2", None, None, None, "2101.1v2", None, "second"), ("DataCite (arXiv)", "2101.3", None, None, None, "2101.3", None, "kept elsewhere"), ("DataCite (arXiv)", "2101.1", None, None, None, "2101.1", None, "not asked"),
    ("NASA ADS", "bib1", None, None, None, None, ["bib1", "10.1/z", "both", ""], "one"), ("NASA ADS", "bib2", None, None, None, None, ["bib2", "both", "bib2"], "two"),
]
CITED = "ref_id long, route string, doi string, pmid string, pmcid string, arxiv_id string, ads_id string, title string"
ASKED = [
    (1, "doi", "10.1/b;", None, None, None, None, "t"), (2, "doi", "10.1/Z", None, None, None, None, "t"), (3, "doi", "10.1/z", None, None, None, None, None), (4, "doi", "", None, None, None, None, "t"),
    (5, "pmid", None, "7", None, None, None, "t"), (6, "pmid", "10.1/z", "70", None, None, None, "t"), (7, "pmcid", None, None, "PMC8", None, None, "t"), (8, "pmcid", None, None, "pmc9", None, None, "t"),
    (9, "arxiv", None, None, None, "2101.1", None, "t"), (10, "arxiv", None, None, None, "2101.1v2", None, "t"), (11, "arxiv", None, None, None, "2101.1v9", None, "t"), (12, "arxiv", None, None, None, "2101.3", None, "t"), (13, "arxiv", None, None, None, "2101.3v1", None, "t"), (14, "arxiv", None, None, None, None, None, "t"),
    (15, "ads", None, None, None, None, "BIB1", "t"), (16, "ads", None, None, None, None, "both", "t"), (17, "search", None, None, None, None, None, "t"), (18, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def works(spark):
    return as_works(spark.createDataFrame(HELD, WORKS).repartition(3))


@pytest.fixture(scope="module")
def cited(spark):
    return spark.createDataFrame(ASKED, CITED).repartition(2)


def one_by_one(cited, works):
    """{ref_id: (record_id, bridge_pmid)} by the lookups of single routes."""
    at = lambda name: cited.filter(F.col("route") == name)
    arxiv = lookup.lookup_arxiv(at("arxiv"), works)
    found = [lookup.lookup_doi(at("doi"), works), lookup.lookup_pmid(at("pmid"), works), lookup.lookup_pmcid(at("pmcid"), works), arxiv, lookup.lookup_datacite(arxiv, works), lookup.lookup_ads(at("ads"), works)]
    out = {}
    for df in found:
        bridge = F.col("bridge_pmid") if "bridge_pmid" in df.columns else F.lit(None).cast("string")
        for r in df.filter("record IS NOT NULL").select("ref_id", "record.record_id", bridge.alias("bridge")).collect():
            out[r.ref_id] = (r.record_id, r.bridge)
    return out


def test_one_join_finds_what_single_lookups_find(cited, works):
    found = identifiers.lookup_all(cited, identifiers.identifier_index(works)).select("ref_id", "record.record_id", "bridge_pmid", F.col("by_doi.record_id").alias("by_doi")).collect()
    assert {r.ref_id: (r.record_id, r.bridge_pmid) for r in found if r.record_id} == one_by_one(cited, works)
    assert {r.ref_id: r.by_doi for r in found if r.by_doi} == {2: "bib1"}
    assert not any(r.by_doi for r in identifiers.lookup_all(cited, identifiers.identifier_index(works), ads=False).collect())


def test_empty_tables(cited, works):
    assert identifiers.lookup_all(cited, identifiers.identifier_index(works.limit(0))).count() == 0
    assert identifiers.lookup_all(cited.limit(0), identifiers.identifier_index(works)).count() == 0


def test_the_catalogue_is_read_once_and_a_kept_index_is_not_shuffled(spark, cited, works):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(identifiers.identifier_index(works)).count("Scan ExistingRDD") == 1
    table = "identifiers_of_test"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = identifiers.save_index(identifiers.identifier_index(works), table, buckets=4)
        joined = cited.select("ref_id", F.concat(F.lit("doi:"), "doi").alias("key")).join(kept, "key")
        assert plan(joined).count("Exchange hashpartitioning") == 1
        found = identifiers.lookup_all(cited, identifiers.open_index(spark, table))
        assert {r.ref_id: (r.record_id, r.bridge_pmid) for r in found.filter("record IS NOT NULL").select("ref_id", "record.record_id", "bridge_pmid").collect()} == one_by_one(cited, works)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_searches_go_by_the_year_of_print(spark):
    """Without an issue date the year of print decides, not that of the deposit."""
    work = lambda doi, **dates: (f'{{"DOI":"{doi}","title":["Slow rivers of the north"],"author":[{{"family":"Berg"}}],' + ",".join(f'"{k.replace("_", "-")}":{{"date-parts":[[{y}]]}}' for k, y in dates.items()) + "}",)
    rows = [work("10.1/print", published_print=1999, created=2015), work("10.1/issued", issued=1980, published_print=1999, created=2015), work("10.1/late", created=2015)]
    works = crossref_works(spark.createDataFrame(rows, "json string"))
    assert {r.doi: (r.year, r.search_year) for r in works.collect()} == {"10.1/print": (2015, 1999), "10.1/issued": (1980, 1980), "10.1/late": (2015, 2015)}
    cited = spark.createDataFrame([(k, "Slow rivers of the north", y, "Berg", None, ["Berg"], False) for k, y in enumerate((1999, 1980, 2014, 1990))], "ref_id long, title string, year int, first_author string, journal string, authors array<string>, uses_et_al boolean")
    got = {r.ref_id: r.doi for r in candidates.searched(cited, works).select("ref_id", "record.doi").collect()}
    assert got == {0: "10.1/print", 1: "10.1/issued", 2: "10.1/late", 3: None}


def test_runs_are_written_once(spark, tmp_path):
    path = f"{tmp_path}/runs"
    results = spark.createDataFrame([(1, 1, "ref a", "Sufficient", 9, "n"), (1, 2, "ref b", "Major", 1, "n"), (2, 1, "ref c", "Major", 1, "n")], "submission_id long, `Ref #` int, Reference string, `Validation Result` string, Score int, Notes string")
    texts = spark.createDataFrame([(1, "a\nb"), (2, "c")], "submission_id long, text string")
    records = lambda run, r=results: sinks.run_records(r, texts, "app", "S390", "SXB", run=run)
    seen = lambda: sorted((r.run, r.submission_id, len(r.findings)) for r in sinks.read_run_records(spark, path).collect())
    first = [("one", 1, 2), ("one", 2, 1)]
    for _ in range(2):
        sinks.write_run_records(records("one"), path)
        assert seen() == first
    # A job that fails half-way leaves what was complete, and the next try replaces what it left.
    broken = records("two").withColumn("input_text", F.when(F.col("submission_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("input_text")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_run_records(broken, path)
    assert seen() == first
    records("three").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/records")
    assert seen() == first
    sinks.write_run_records(records("three", results.filter("submission_id = 1")), path)
    assert seen() == [*first, ("three", 1, 2)]


def test_signatures_count_repeats_and_keep_values_apart(spark):
    def sign(rows):
        df = spark.createDataFrame(rows, "submission_id long, a string, b string, c array<int>").repartition(3)
        return {r.submission_id: r.signature for r in report.results_signature(df).collect()}

    rows = [(1, "x", "y", [1]), (1, None, "", None), (None, "x", "y", [1]), (2, "x", "y", [1]), (2, "x", "y", [1])]
    own = sign(rows)
    assert own == sign(rows[::-1]) and own[1] != own[2] and own[None] != own[2]
    assert sign([(1, "xy", "", [1])]) != sign([(1, "x", "y", [1])]) and sign([(1, None, "-", None)]) != sign([(1, "-", None, None)])
    assert sign([]) == {}
