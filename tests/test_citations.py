"""Helpers and expressions on cases of the kinds that references come in, and the registered queries against their SQL."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from citesieve.functions import helpers, normalize, text
from citesieve.operators import classify, compare, report, route, sinks, split

SF = "/root/testdata/sf0.001"


def one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "v string").select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(
    ("ref", "names"),
    [
        ("Stern, C.D. and Fraser, S.E. (2001) ‘Tracing’, Nature, 3, pp. 1-2.", ["Stern", "Fraser"]),
        ("1. Bekaii-Saab TS, Yaeger R, Spira AI. Adagrasib. J Clin Oncol. 2023;41:4097-4106.", ["Bekaii-Saab", "Yaeger", "Spira"]),
        ("van der Berg, A., Łukasz, B. & Παπαδόπουλος, Γ. (2010) Title here.", ["van der Berg", "Łukasz", "Παπαδόπουλος"]),
        ("Kim, J., Kim, H. and Bang, D. (2019) Title.", ["Kim", "Kim", "Bang"]),
        ("Smith J et al. (2020) Title", ["Smith"]),
        ("ATLAS Collaboration, Aad, G. (2012) Observation", ["ATLAS Collaboration", "Aad"]),
        ("World Health Organization (2019) Report.", ["World Health Organization"]),
        ("The Open University. Study notes.", ["The Open University"]),
        ("", []),
        (None, []),
    ],
)
def test_surnames(ref, names):
    assert helpers.surnames(ref) == names


def test_lists_are_split():
    wrapped = "Stern, C. (2001) ‘A long title that\nwraps’, Nature, 3(1), pp. 1-2.\nFraser, S. (2002) ‘Another’, Science, 4(2), pp. 3-4."
    assert split.references(wrapped) == ["Stern, C. (2001) ‘A long title that wraps’, Nature, 3(1), pp. 1-2.", "Fraser, S. (2002) ‘Another’, Science, 4(2), pp. 3-4."]
    inline = "1 Bekaii-Saab TS, Yaeger R. Adagrasib. J Clin Oncol 2023;41:4097-4106. 2 Strickler JH, Satake H. Sotorasib. N Engl J Med 2023;388:33-43."
    assert len(split.references(inline)) == 2 and split.references(inline)[1].startswith("Strickler JH")
    assert split.references("\r• Stern, C. (2001) Title. https://x.org/a\r• Fraser, S. (2002) Title.\r") == ["Stern, C. (2001) Title. https://x.org/a", "Fraser, S. (2002) Title."]
    assert split.references(None) == [] and split.references(" \n ") == []


def test_long_references_are_split_in_linear_time():
    import time

    began = time.time()
    lines = ["Stern, C. (2001) A title"] + ["that goes on and on without any end"] * 60_000 + ["10.1000/x", "Fraser, S. (2002) Next."]
    got = split.references("\n".join(lines))
    assert len(got) == 2 and got[1] == "Fraser, S. (2002) Next." and time.time() - began < 20
    parted = "Stern, C. (2001) Title here, pp.\n12-13\nFraser, S. (2002) Next"
    assert len(split.references(parted)) == 2
    parted = "Stern, C. Title here PMID:\n12345\nFraser, S. (2002) Next"
    assert len(split.references(parted)) == 2


@pytest.mark.parametrize(("a", "b", "ratio"), [("abcd", "bcde", 0.75), ("", "", 1.0), ("ABC", "abc", 1.0), ("abc", "", 0.0), (None, None, 1.0), ("private thread", "private threads", 28 / 29), ("aab", "aba", 2 / 3)])
def test_ratios(spark, a, b, ratio):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert abs(df.select(helpers.text_ratio("a", "b")).first()[0] - ratio) < 1e-9


def test_failed_lookups_are_no_mismatch(spark):
    from citesieve.plans import fixtures, queries
    from citesieve.plans.validate import validate_citations

    own = fixtures.citations(spark, SF).filter("mode IN (0, 10) AND ref_id < 300")
    status = own.select("ref_id", F.when(F.col("ref_id") % 24 < 12, 503).otherwise(404).alias("http_status"))
    out = validate_citations(own, fixtures.works(spark, SF), fixtures.registry(spark, SF), lookup_status=status, ads=False)
    got = {r.ref_id: (r["Validation Result"], r["Lookup issue"]) for r in out.collect()}
    assert len(got) == own.count() and queries.QUERIES
    for ref, (label, issue) in got.items():
        if ref % 12 == 0:
            assert label == classify.SUFFICIENT and issue == ""
        else:
            assert label == classify.UNVERIFIED and issue == ("lookup unavailable: HTTP 503" if ref % 24 < 12 else classify.NO_RECORD)


def test_tracking_tags_change_no_verdict(spark):
    from citesieve.plans import fixtures
    from citesieve.plans.validate import validate_citations

    own = fixtures.citations(spark, SF).filter("mode IN (0, 1, 9) AND ref_id < 200")
    tagged = own.withColumn("ref", F.concat("ref", F.lit("?utm_source=chatgpt.com")))
    label = lambda df: {r.ref_id: (r["Validation Result"], r["Extracted DOI"]) for r in validate_citations(df, fixtures.works(spark, SF), fixtures.registry(spark, SF), ads=False).collect()}
    assert label(own) == label(tagged)


def test_altered_citations_of_every_identifier(spark):
    """A PMID, PMCID or arXiv ID whose year is changed needs a look at its details; with another title and author it is a major mismatch."""
    from citesieve.plans import fixtures
    from citesieve.plans.validate import validate_citations

    own = fixtures._run(spark, SF, "SELECT ref_id, mode, ref, title, s1 FROM citations WHERE mode IN (5, 6, 7) AND ref_id < 200 AND ref_id % 24 <> 7")
    other = "replace(replace(ref, title, 'Another topic entirely about slow rivers'), s1, 'Quinn')"
    kinds = {0: "ref", 1: r"regexp_replace(ref, '\\(\\d{4}\\)', '(1971)')", 2: other}
    asked = own.selectExpr("mode", f"explode(array({', '.join(f'struct({k} AS kind, {e} AS ref)' for k, e in kinds.items())})) AS v", "ref_id AS old")
    asked = asked.selectExpr("old * 10 + v.kind AS ref_id", "v.ref", "mode", "v.kind").persist()
    out = validate_citations(asked.select("ref_id", "ref"), fixtures.works(spark, SF), fixtures.registry(spark, SF), ads=False).join(asked.select("ref_id", "mode", "kind"), "ref_id")
    got = {(r.mode, r.kind, r["Validation Result"]) for r in out.collect()}
    labels = {0: classify.SUFFICIENT, 1: classify.DETAILS, 2: classify.MAJOR}
    assert got == {(mode, kind, labels[kind]) for mode in (5, 6, 7) for kind in kinds}


def test_author_lists():
    same = helpers.compared_authors(["Müller", "O’Brien"], ["Muller", "O'Brien"], False)
    assert same["ok"] and same["method"] == "minor surname variant"
    assert helpers.compared_authors(["A", "B"], ["A", "B", "C"], False)["method"] == "incomplete author list"
    assert helpers.compared_authors(["B", "A"], ["A", "B"], False)["order_changed"]
    assert helpers.compared_authors(["A"], ["A", "B", "C"], True)["ok"] and not helpers.compared_authors(["B"], ["A", "B"], True)["ok"]
    assert helpers.compared_authors(["Martin"], ["Martinez"], False)["method"] == "single-author mismatch"
    assert helpers.same_surname("Kowalewski", "Kowaleuski") and not helpers.same_surname("Kowalski", "Nowalski")
    assert helpers.compared_authors([], ["A"], False)["method"] == "no submitted authors extracted"


def test_tracking():
    flag = lambda v: bool(list(filter(helpers._is_chatgpt, [x for t in helpers._layers(v) for x in helpers._query_sources(t)])))
    assert flag("https://a.org/?x=1&amp;utm_source=ChatGPT.com") and flag("https://a.org/?q=https%3A%2F%2Fb.org%3Futm_source%3Dchatgpt.com&utm_source=chatgpt")
    assert not flag("https://a.org/?utm_source=notchatgpt.com") and not flag("https://chatgpt.com/?utm_source=feed")


def test_identifiers(spark):
    v = F.col("v")
    assert one(spark, "doi: 10.7326/M14-0737(Assessed 24 April 2026)", text.extract_doi(v)) == "10.7326/M14-0737"
    assert one(spark, "see https://doi.org/10.1000/a(b)c).", text.extract_doi(v)) == "10.1000/a(b)c"
    assert one(spark, r"10.1000/x%2Fy\ ", text.extract_doi(v)) == "10.1000/x/y"
    assert one(spark, "https://www.sciencedirect.com/science/article/pii/S0140", text.infer_doi_from_url(text.extract_urls(v))) is None
    assert one(spark, "https://arxiv.org/abs/2101.00001v2", text.extract_arxiv_id(v)) == "2101.00001v2"
    assert one(spark, None, text.extract_doi(v), text.extract_title(v), text.extract_journal(v)) == (None, None, None)
    assert one(spark, "", text.extract_urls(v), text.extract_domains(text.extract_urls(v))) == ([], [])
    assert one(spark, "Smith (2001a) “It's a title”, Journal of X, vol. 42 (2001a), pg 7.", text.extract_title(v), text.vol_issue_pages(v)["issue"]) == ("It's a title", None)


def test_rules(spark):
    v = F.col("v")
    assert one(spark, "Sleep Med Rev", normalize.normalize_journal(v)) == "sleep medicine reviews"
    assert one(spark, "Ludwig van der Berg", normalize.preprint_surname(v)) == "van der Berg"
    assert one(spark, "12-18", compare.pages_match(F.lit("15"), F.lit("20"), v), compare.pages_match(F.lit("1"), F.lit("5"), v)) == (True, False)
    assert one(spark, "e123", compare.pages_match(F.lit("e123"), F.lit(None).cast("string"), v)) is True
    assert one(spark, "a.gov.uk", route.trusted_domain(v)) is True and one(spark, None, route.trusted_domain(v)) is False
    assert one(spark, classify.SUFFICIENT, classify.manual_check_status(v)) == ""


def test_exports_are_guarded(spark):
    df = spark.createDataFrame([("x",)], "`Validation Result` string")
    for code, acknowledged in (("", True), ("A-1", False), ("--", True), ("a\tb", True), ("x" * 121, True)):
        with pytest.raises(ValueError):
            sinks.guarded(df, code, acknowledged)
    assert sinks.guarded(df, "A-1", True).first()["Manual check status"] == "Manual check required"
    with pytest.raises(ValueError):
        sinks.module_choice("S390")


def test_signature_follows_content(spark):
    rows = [(1, 1, "a"), (1, 2, None), (2, 1, "a")]
    sign = lambda r: {x.submission_id: x.signature for x in report.results_signature(spark.createDataFrame(r, "submission_id long, n int, t string").repartition(3)).collect()}
    assert sign(rows) == sign(rows[::-1]) and sign(rows)[1] != sign([(1, 1, "a"), (1, 2, "b")])[1]


FAST = ("s2_crossref_works", "s4_arxiv_works", "l4_clean_reference", "x4_extract_title", "x6_extract_journal", "x8_clean_doi", "c8_c9_c10_details", "c10_pages_match", "c13_conflict_list", "g2_classify_evidence", "a3_domain_label_matrix", "k3_run_records", "g5_validate_citations", "g5_labels_of_physics_routes")


@pytest.mark.parametrize("name", FAST)
def test_queries_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = [[str(r[names.index(c)]) for c in columns] for r in found.fetchall()]
    assert sorted([str(r[c]) for c in columns] for r in df.collect()) == sorted(want)
