"""Registered queries of the library's own operators, each with the same result in SQL where SQL can say it.

All read citations and catalogues that Spark derives from the given tables (see ``fixtures``), or the tables
themselves. The SQL takes the expected fields from how each citation was made, not from its text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import helpers, normalize, text
from ..operators import candidates, classify, compare, lookup, report, route, sinks, split
from ..operators.parse import parse_citations
from ..operators.staging import checkpoint_folder, dealt, spread, staged
from ..sources import catalogue
from . import fixtures as fx
from .validate import classified, validate_citations, with_doi_flags

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(oracle: str | None = None, **tables: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = fx.sql(oracle, **tables)
        return f

    return add


def column_query(name: str, columns: Callable[[], dict[str, Column]], oracle: str) -> None:
    """A query that adds columns to the citations' ref_id. They may read ``ref_clean``, which is computed once below them."""
    cited = lambda spark, sf_dir: spread(fx.citations(spark, sf_dir), "ref_id").withColumn("ref_clean", text.clean_reference(F.col("ref")))
    QUERIES[name] = lambda spark, sf_dir: cited(spark, sf_dir).select("ref_id", *[c.alias(n) for n, c in columns().items()])
    ORACLES[name] = fx.sql(oracle)


def body_query(name: str, body: str, columns: Callable[[], dict[str, Column]], oracle: str) -> None:
    """A query over rows that SQL makes from the citations."""
    QUERIES[name] = lambda spark, sf_dir: fx._run(spark, sf_dir, body).select("ref_id", *[c.alias(n) for n, c in columns().items()])
    ORACLES[name] = fx.sql(oracle)


PUBLISHED = "mode NOT IN (7, 8, 11)"
LETTERS = fx._LETTERS.format("ref_id")


def fields(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """ref_id and these fields of all citations. What is not read is not extracted."""
    return parse_citations(spread(fx.citations(spark, sf_dir), "ref_id")).select("ref_id", *columns)


def parsed(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``fields``, staged, so that filters on them read them and are not pushed below the extraction."""
    return staged(fields(spark, sf_dir, *columns))


def parsed_with(spark: SparkSession, sf_dir: str, key: str, *columns: str) -> DataFrame:
    """ref_id, the identifier ``key`` and these fields of the citations that have this identifier.

    The identifier is extracted from all citations and staged, and only those that have it are parsed further.
    """
    own = fx.citations(spark, sf_dir)
    having = staged(parse_citations(spread(own, "ref_id")).select("ref_id", "ref", F.col(key).alias("own"))).filter("own IS NOT NULL")
    return parse_citations(having).withColumn(key, F.col("own")).select("ref_id", *dict.fromkeys((key, *columns)))


# --- splitting and cleaning ---------------------------------------------------------------------


@registered("SELECT doc_id AS submission_id, text FROM documents")
def s1_read_submissions(spark, sf_dir):
    return catalogue.read_submissions(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")


@registered(
    "SELECT submission_id, CAST(row_number() OVER (PARTITION BY submission_id ORDER BY ref_id) AS INT) AS ref_no, ref FROM citations"
)
def l1_split_references(spark, sf_dir):
    return split.split_references(fx.submissions(spark, sf_dir))


body_query(
    "l2_strip_list_marker",
    "SELECT ref_id, concat(CASE ref_id % 5 WHEN 0 THEN '12. ' WHEN 1 THEN '• ' WHEN 2 THEN 'a) ' WHEN 3 THEN ' 7] ' ELSE '' END, t_title) AS v FROM citations",
    lambda: {"stripped": text.strip_list_marker(F.col("v"))},
    "SELECT ref_id, t_title AS stripped FROM citations",
)
body_query(
    "l3_fix_broken_urls",
    f"SELECT ref_id, concat('See https://x.org/abc- ', {LETTERS}, ' and a- b.') AS v FROM citations",
    lambda: {"fixed": text.fix_broken_urls(F.col("v"))},
    f"SELECT ref_id, concat('See https://x.org/abc-', {LETTERS}, ' and a- b.') AS fixed FROM citations",
)
column_query(
    "l4_clean_reference",
    lambda: {"cleaned": text.clean_reference(F.col("ref"))},
    "SELECT ref_id, rtrim(CASE WHEN mode IN (8, 11) THEN split_part(ref, ' Available at', 1) ELSE ref END, ' .') AS cleaned FROM citations",
)


@registered(
    r"""SELECT doc_id AS submission_id, array_to_string(list_filter([
  CASE WHEN years < greatest(1, floor(lines * 0.3)) THEN 'years' END, CASE WHEN numbers AND years = 0 THEN 'numbers' END, CASE WHEN http > years * 2 THEN 'urls' END], lambda w: w IS NOT NULL), ',') AS warnings
FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS lines, len(regexp_extract_all(text, '\b(?:1[89]\d{2}|20\d{2})[a-z]?\b')) AS years,
  regexp_matches(text, '\[\d+\]') AS numbers, (length(text) - length(replace(text, 'http', ''))) / 4 AS http FROM documents)"""
)
def l5_format_warnings(spark, sf_dir):
    short = {split.WARN_YEARS: "years", split.WARN_NUMBERS: "numbers", split.WARN_URLS: "urls"}
    code = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
    df = split.format_warnings(catalogue.read_submissions(spark, f"{sf_dir}/documents.parquet", "doc_id", "text"))
    return df.select("submission_id", F.array_join(F.transform("warnings", lambda w: F.element_at(code, w)), ",").alias("warnings"))


# --- extraction ---------------------------------------------------------------------------------

AUTHORS = "CASE mode WHEN 8 THEN 'World Health Organization' WHEN 11 THEN 'Brook' ELSE concat(t_s1, ', ', t_s2, ', ', s3) END"
JOURNAL = """CASE t_journal WHEN 'Sleep Medicine Reviews' THEN 'sleep' WHEN 'Nature Reviews Neuroscience' THEN 'nature reviews neuroscience' WHEN 'Psychological Bulletin' THEN 'psychological bulletin'
 WHEN 'Journal of Applied Studies' THEN 'journal of applied studies' WHEN 'Annals of Measured Systems' THEN 'annals of measured systems' WHEN 'BMC Pediatrics' THEN 'bmc pediatrics' ELSE lower(t_journal) END"""
TITLE = "CASE mode WHEN 8 THEN 'Annual statistics page' WHEN 11 THEN 'Small notes' ELSE t_title END"
only = lambda expr: f"CASE WHEN {PUBLISHED} THEN {expr} END"
column_query("x1_author_surnames", lambda: {"authors": F.array_join(helpers.author_surnames(F.col("ref")), ", ")}, f"SELECT ref_id, {AUTHORS} AS authors FROM citations")
body_query(
    "x2_uses_et_al",
    "SELECT ref_id, CASE ref_id % 3 WHEN 0 THEN concat(t_s1, ' et al. (2001)') WHEN 1 THEN concat(t_s1, ' ET  AL, 2001') ELSE concat(t_s1, ' et alia 2001') END AS v FROM citations",
    lambda: {"et_al": text.uses_et_al(F.col("v"))},
    "SELECT ref_id, ref_id % 3 <> 2 AS et_al FROM citations",
)
body_query(
    "x3_year",
    "SELECT ref_id, concat(t_s1, ' (', CAST(t_year AS STRING), CASE ref_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'a' ELSE '' END, ') 12345 pages') AS v FROM citations",
    lambda: {"year_token": text.year_token(F.col("v")), "year": text.year_value(F.col("v")), "suffix": text.year_suffix(F.col("v"))},
    "SELECT ref_id, concat(CAST(t_year AS STRING), CASE ref_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'a' ELSE '' END) AS year_token, t_year AS year, CASE ref_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'a' END AS suffix FROM citations",
)
column_query("x4_extract_title", lambda: {"title": text.extract_title(F.col("ref"))}, f"SELECT ref_id, {TITLE} AS title FROM citations")
column_query(
    "x5_publication_tail",
    lambda: {"tail": text.publication_tail(F.col("ref_clean"))},
    f"""SELECT ref_id, CASE WHEN mode = 7 THEN concat('arXiv, arXiv:', arxiv_id) WHEN {PUBLISHED} THEN concat(t_journal, ', ', t_volume, '(', issue, '), pp. ', t_start, '-', t_end,
  CASE WHEN mode = 5 THEN concat('. PMID: ', pmid) WHEN mode = 4 THEN '' ELSE '.' END) END AS tail FROM citations""",
)
column_query(
    "x6_extract_journal", lambda: {"journal": text.extract_journal(F.col("ref_clean"))},
    f"SELECT ref_id, CASE WHEN mode = 7 THEN concat('arxiv, arxiv:', arxiv_id) WHEN {PUBLISHED} THEN {JOURNAL} END AS journal FROM citations",
)
vip = lambda: text.vol_issue_pages(F.col("ref_clean"))
column_query(
    "x7_vol_issue_pages", lambda: {n: vip()[n] for n in ("volume", "issue", "pages", "page_start", "page_end")},
    f"SELECT ref_id, {only('t_volume')} AS volume, {only('issue')} AS issue, {only('concat(t_start, chr(45), t_end)')} AS pages, {only('t_start')} AS page_start, {only('t_end')} AS page_end FROM citations",
)
column_query("x8_extract_doi", lambda: {"doi": text.extract_doi(F.col("ref"))}, "SELECT ref_id, t_doi AS doi FROM citations")
body_query(
    "x8_clean_doi",
    """SELECT ref_id, CASE ref_id % 6 WHEN 0 THEN concat('[', doi, '](https://doi.org/', doi, ')') WHEN 1 THEN concat('doi: ', doi, '.') WHEN 2 THEN concat('(https://dx.doi.org/', doi, '?utm_source=x)')
  WHEN 3 THEN concat('see ', doi, ');') WHEN 4 THEN concat('https://www.cochranelibrary.com/cdsr/doi/10.1002/', pmid, '/full') ELSE concat('https://doi.org/10.1016/S0140(', pmid, ')2-X (Accessed 1 May 2020)') END AS v FROM citations""",
    lambda: {"doi": text.extract_doi(F.col("v"))},
    "SELECT ref_id, CASE WHEN ref_id % 6 < 4 THEN doi WHEN ref_id % 6 = 4 THEN concat('10.1002/', pmid) ELSE concat('10.1016/S0140(', pmid, ')2-X') END AS doi FROM citations",
)
body_query(
    "x9_infer_doi_from_url",
    f"""SELECT ref_id, CASE ref_id % 4 WHEN 0 THEN concat('https://www.nature.com/articles/s41586-020-', {LETTERS}) WHEN 1 THEN concat('https://elifesciences.org/articles/', pmid)
  WHEN 2 THEN concat('https://www.nature.com/articles/', {LETTERS}) ELSE concat('https://www.nature.com/articles/nature.2014.', pmid, ' https://elifesciences.org/articles/1') END AS v FROM citations""",
    lambda: {"doi": text.infer_doi_from_url(text.extract_urls(F.col("v")))},
    f"SELECT ref_id, CASE ref_id % 4 WHEN 0 THEN concat('10.1038/s41586-020-', {LETTERS}) WHEN 1 THEN concat('10.7554/eLife.', pmid) WHEN 3 THEN concat('10.1038/nature.2014.', pmid) END AS doi FROM citations",
)
column_query(
    "x10_pmid_pmcid", lambda: {"pmid": text.extract_pmid(F.col("ref"), text.extract_urls(F.col("ref"))), "pmcid": text.extract_pmcid(F.col("ref"))},
    "SELECT ref_id, t_pmid AS pmid, t_pmcid AS pmcid FROM citations",
)
body_query(
    "x10_pmid_from_url", "SELECT ref_id, concat(t_title, CASE WHEN ref_id % 2 = 0 THEN ' https://pubmed.ncbi.nlm.nih.gov/' ELSE ' https://pubmed.example.org/' END, pmid, '/?x=1') AS v FROM citations",
    lambda: {"pmid": text.extract_pmid(F.col("v"), text.extract_urls(F.col("v")))}, "SELECT ref_id, CASE WHEN ref_id % 2 = 0 THEN pmid END AS pmid FROM citations",
)
body_query(
    "x11_arxiv_ads",
    """SELECT ref_id, CASE ref_id % 4 WHEN 0 THEN concat('arXiv: ', arxiv_id, 'v2.') WHEN 1 THEN concat('https://arxiv.org/pdf/', arxiv_id) WHEN 2 THEN concat('https://ui.adsabs.harvard.edu/abs/', bibcode, '/abstract')
  ELSE 'arXiv:hep-TH/9901001' END AS v FROM citations""",
    lambda: {"arxiv_id": text.extract_arxiv_id(F.col("v")), "ads_id": text.extract_ads_id(F.col("v"))},
    "SELECT ref_id, CASE ref_id % 4 WHEN 0 THEN concat(arxiv_id, 'v2') WHEN 1 THEN arxiv_id WHEN 3 THEN 'hep-th/9901001' END AS arxiv_id, CASE WHEN ref_id % 4 = 2 THEN bibcode END AS ads_id FROM citations",
)
body_query(
    "x12_extract_urls",
    "SELECT ref_id, concat('See (', coalesce(t_url, 'nothing'), ') and ', coalesce(t_url, 'no'), ', also http://b.example.org/', pmid, '(accessed 2020)') AS v FROM citations",
    lambda: {"urls": F.array_join(text.extract_urls(F.col("v")), " "), "source_url": text.first_of(text.extract_urls(F.col("v")))},
    "SELECT ref_id, concat(CASE WHEN t_url IS NULL THEN '' ELSE concat(t_url, ' ') END, 'http://b.example.org/', pmid) AS urls, coalesce(t_url, concat('http://b.example.org/', pmid)) AS source_url FROM citations",
)


@registered("SELECT page_id, replace(regexp_extract(lower(url), '^https?://([^/?#]*)', 1), 'www.', '') AS domain FROM pages")
def x13_extract_domains(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", text.first_of(text.extract_domains(text.extract_urls(F.col("url")))).alias("domain"))


column_query("x14_ai_tracking_flag", lambda: {"flag": helpers.ai_tracking_flag(F.col("ref"))}, "SELECT ref_id, mode = 11 AS flag FROM citations")
column_query(
    "x15_x16_shape", lambda: {"shape": text.bibliographic_shape(F.col("ref_clean")), "scholarly": text.scholarly_like(F.col("ref_clean"))},
    f"SELECT ref_id, {PUBLISHED} AS shape, mode NOT IN (8, 11) AS scholarly FROM citations",
)
body_query(
    "x17_author_extraction_issue", "SELECT ref_id, concat(s1, ', A. and ', s2, ', B. (2001)') AS ref, s1, s2 FROM citations",
    lambda: {"missed": helpers.author_extraction_issue(F.col("ref"), F.when(F.col("ref_id") % 2 == 0, F.array("s1", "s2")).otherwise(F.array("s1"))).isNotNull()},
    "SELECT ref_id, ref_id % 2 = 1 AS missed FROM citations",
)

# --- normal forms -------------------------------------------------------------------------------

body_query(
    "n1_fold_text", "SELECT ref_id, concat(t_title, ' &amp; É-', s1) AS v FROM citations", lambda: {"name": helpers.normalize_author(F.col("v")), "title": helpers.normalize_title(F.col("v"))},
    "SELECT ref_id, concat(replace(lower(t_title), ' ', ''), 'e', lower(s1)) AS name, concat(lower(t_title), ' e ', lower(s1)) AS title FROM citations",
)
body_query(
    "n2_normalize_journal", "SELECT ref_id, CASE WHEN ref_id % 2 = 0 THEN concat('The ', t_journal, ' : official publication of us') ELSE concat(t_journal, ' [Preprint] ') END AS v FROM citations",
    lambda: {"journal": F.trim(normalize.normalize_journal(F.col("v")))}, f"SELECT ref_id, {JOURNAL} AS journal FROM citations",
)
def named():
    """Authors of every kind, as an array of author structs."""
    return F.array(
        F.struct(F.lit("A").alias("given"), F.col("s1").alias("family"), F.lit(None).cast("string").alias("last"), F.lit(None).cast("string").alias("name")),
        F.struct(F.lit(None).cast("string").alias("given"), F.lit("").alias("family"), F.lit(None).cast("string").alias("last"), F.concat("s2", F.lit(" BC")).alias("name")),
        F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("last"), F.lit("The Study Group").alias("name")),
        F.struct(F.when(F.col("ref_id") % 3 == 0, "Professor").otherwise("C.").alias("given"), F.concat("s3", F.lit(", C.")).alias("family"), F.lit(None).cast("string").alias("last"), F.lit(None).cast("string").alias("name")),
    )


body_query(
    "n3_n5_metadata_authors", "SELECT ref_id, s1, s2, s3 FROM citations", lambda: {"surnames": F.array_join(normalize.metadata_surnames(named()), ", "), "unusable": normalize.metadata_author_issue(named()).isNotNull()},
    "SELECT ref_id, concat(s1, ', ', s2, ', ', s3) AS surnames, ref_id % 3 = 0 AS unusable FROM citations",
)
body_query(
    "n4_preprint_surname", "SELECT ref_id, CASE ref_id % 4 WHEN 0 THEN concat('Anna van  der ', s1) WHEN 1 THEN concat(s1, ', Anna') WHEN 2 THEN concat(s1, ' Collaboration') ELSE concat('A. B. ', s1) END AS v FROM citations",
    lambda: {"surname": normalize.preprint_surname(F.col("v"))}, "SELECT ref_id, CASE ref_id % 4 WHEN 0 THEN concat('van der ', s1) WHEN 2 THEN concat(s1, ' Collaboration') ELSE s1 END AS surname FROM citations",
)
body_query(
    "n6_n7_title_rules", "SELECT ref_id, CASE WHEN ref_id % 5 = 0 THEN concat(t_title, ' and peer review') WHEN ref_id % 5 = 1 THEN 'small note' ELSE t_title END AS v FROM citations",
    lambda: {"distinctive": normalize.title_distinctive(helpers.normalize_title(F.col("v"))), "is_review": normalize.review_from_title(F.col("v"))},
    "SELECT ref_id, ref_id % 5 <> 1 AS distinctive, ref_id % 5 > 1 AND t_title LIKE '%review%' AS is_review FROM citations",
)


@registered("SELECT pmid, work_id % 6 = 0 AS is_review, CASE WHEN work_id % 6 = 0 THEN 'pubtype match' ELSE 'pubtypes present but no review label' END AS note FROM articles WHERE work_id % 2 = 0")
def n8_review_from_pub_types(spark, sf_dir):
    return fx.pub_types(spark, sf_dir).select("pmid", normalize.review_from_pub_types(F.col("pub_types")).alias("r")).select("pmid", "r.*")


# --- routes -------------------------------------------------------------------------------------

@registered("SELECT ref_id, mode IN (6, 8) AS trusted FROM citations")
def f1_trusted_parsed(spark, sf_dir):
    return fields(spark, sf_dir, "domain").select("ref_id", route.trusted_domain(F.col("domain")).alias("trusted"))


body_query(
    "f1_trusted_domain", "SELECT ref_id, CASE ref_id % 4 WHEN 0 THEN 'who.int' WHEN 1 THEN 'a.b.nhs.uk' WHEN 2 THEN 'notwho.int' ELSE 'example.com' END AS v FROM citations",
    lambda: {"trusted": route.trusted_domain(F.col("v"))}, "SELECT ref_id, ref_id % 4 < 2 AS trusted FROM citations",
)
ROUTE = "CASE mode WHEN 4 THEN 'search' WHEN 5 THEN 'pmid' WHEN 6 THEN 'pmcid' WHEN 7 THEN 'arxiv' WHEN 8 THEN 'manual_review' WHEN 11 THEN 'web' ELSE 'doi' END"


@registered(f"SELECT ref_id, mode = 8 AS org_web, mode IN (6, 8) AS trusted_web, {ROUTE} AS route FROM citations")
def f2_f3_assign_route(spark, sf_dir):
    return fields(spark, sf_dir, "org_web", "trusted_web", "route")


@registered(
    f"""SELECT ref_id, CASE WHEN mode = 8 THEN '{route.MANUAL_REVIEW}' ELSE '{route.WEB}' END AS label, CASE WHEN mode = 8 THEN '{route.MANUAL_NOTE}' ELSE '{route.WEB_NOTE}' END AS notes, 0 AS score, true AS year_ok, true AS author_ok
  FROM citations WHERE mode IN (8, 11)"""
)
def f4_web_source_rows(spark, sf_dir):
    # Names are extracted from the web pages alone.
    own = parsed(spark, sf_dir, "ref_clean", "route", "trusted_web", "year_token").filter("route IN ('manual_review', 'web')")
    named = own.withColumn("first_author", text.first_of(helpers.author_surnames(F.col("ref_clean"))))
    return route.web_source_rows(named).select("ref_id", "label", "notes", "score", "year_ok", "author_ok")


# --- sources ------------------------------------------------------------------------------------

articles = fx.articles
json_of = lambda df, **fields: df.select("work_id", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("json"))
dates = lambda c: F.struct(F.array(F.array(c)).alias("date-parts"))
flat = lambda works, *cols: works.select(*cols, F.array_join(normalize.metadata_surnames(F.col("authors")), ", ").alias("surnames"))


@registered("SELECT doi, title, year, journal, volume, issue, concat(page_start, '-', page_end) AS pages, concat(s1, ', ', s2) AS surnames FROM articles")
def s2_crossref_works(spark, sf_dir):
    return flat(catalogue.crossref_works(_items(spark, sf_dir)), *CROSSREF_FIELDS)


CROSSREF_FIELDS = ("doi", "title", "year", "journal", "volume", "issue", "pages")


@registered("SELECT doi, year, CASE WHEN work_id % 4 = 0 THEN year - 1 ELSE year END AS search_year FROM articles")
def s2_search_year(spark, sf_dir):
    """The year that lookups compare and the one that searches do, of works some of which have only a print and a deposit date."""
    return catalogue.crossref_works(_items(spark, sf_dir)).select("doi", "year", "search_year")


@registered("SELECT form, doi, title, year, journal, volume, issue, concat(page_start, '-', page_end) AS pages, concat(s1, ', ', s2) AS surnames FROM articles, (VALUES ('lines'), ('lists')) f(form)")
def s2_crossref_files(spark, sf_dir):
    """The same items written as dump files of both forms and read from there."""
    items, path = _items(spark, sf_dir), _shared(spark, "crossref")
    items.select("json").write.text(f"{path}/lines")
    lists = items.groupBy(F.floor(F.col("work_id") / 500).alias("file")).agg(F.concat(F.lit('{"items":[\n'), F.array_join(F.collect_list("json"), ",\n"), F.lit("]}")).alias("value"))
    lists.repartition("file").write.partitionBy("file").text(f"{path}/lists")
    read = lambda form: flat(catalogue.read_crossref(spark, f"{path}/{form}", form == "lists"), F.lit(form).alias("form"), *CROSSREF_FIELDS)
    return read("lines").unionByName(read("lists"))


def _items(spark, sf_dir):
    df = articles(spark, sf_dir)
    people = F.array(*[F.struct(F.lit("A.").alias("given"), F.col(s).alias("family")) for s in ("s1", "s2")])
    odd = F.col("work_id") % 2 == 1
    return json_of(
        df, **{
            "DOI": F.col("doi"), "title": F.array("title", F.lit("other")), "container-title": F.array("journal"), "issued": F.when(odd, dates(F.col("year"))), "published-print": F.when(F.col("work_id") % 4 == 0, dates(F.col("year") - 1)), "created": dates(F.when(odd, F.col("year") + 5).otherwise(F.col("year"))),
            "author": people, "volume": F.col("volume"), "issue": F.when(odd, F.col("issue")), "journal-issue": F.struct(F.col("issue").alias("issue")), "page": F.concat_ws("-", "page_start", "page_end"),
        }
    )

def _summaries(spark, sf_dir, key):
    body = F.struct(
        F.col("title"), F.col("journal").alias("fulljournalname"), F.concat(F.col("year").cast("string"), F.lit(" Mar 3")).alias("pubdate"), F.col("volume"), F.col("issue"), F.concat_ws("-", "page_start", "page_end").alias("pages"),
        F.array(F.struct(F.concat("s1", F.lit(" A")).alias("name")), F.struct(F.concat("s2", F.lit(" BC")).alias("name"))).alias("authors"), F.array(F.struct(F.lit("pmid").alias("idtype"), F.col("pmid").alias("value"))).alias("articleids"),
    )
    df = articles(spark, sf_dir)
    return df.select(F.concat(F.lit('{"result":{"uids":["'), key, F.lit('"],"'), key, F.lit('":'), F.to_json(body), F.lit("}}")).alias("json"))


@registered("SELECT pmid, title, concat(CAST(year AS STRING), ' Mar 3') AS pubdate, journal, volume, issue, concat(page_start, '-', page_end) AS pages, concat(s1, ', ', s2) AS surnames FROM articles")
def s3_pubmed_works(spark, sf_dir):
    return flat(catalogue.pubmed_works(_summaries(spark, sf_dir, F.col("pmid"))), "pmid", "title", "pubdate", "journal", "volume", "issue", "pages")


@registered("SELECT pmcid, pmid, title, journal, concat(s1, ', ', s2) AS surnames FROM articles")
def s3_pmc_works(spark, sf_dir):
    return flat(catalogue.pubmed_works(_summaries(spark, sf_dir, F.substring("pmcid", 4, 20)), pmc=True), "pmcid", "pmid", "title", "journal")


@registered("SELECT concat(arxiv_id, 'v1') AS arxiv_id, concat('10.48550/arXiv.', arxiv_id) AS doi, title, concat(CAST(year AS STRING), ',', CAST(year + 1 AS STRING)) AS years, concat('van ', s1, ', ', s2) AS surnames FROM articles")
def s4_arxiv_works(spark, sf_dir):
    return flat(catalogue.arxiv_works(_entries(spark, sf_dir)), *ARXIV_FIELDS, F.array_join("years", ",").alias("years"))


ARXIV_FIELDS = ("arxiv_id", "doi", "title")


@registered()
def s4_arxiv_feeds(spark, sf_dir):
    """The same entries written as feed files and read from there."""
    path = _shared(spark, "arxiv")
    files = _entries(spark, sf_dir).groupBy(F.floor(F.col("work_id") / 500).alias("file")).agg(F.array_join(F.collect_list("xml"), "\n").alias("entries"))
    feed = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>All</title>\n'), "entries", F.lit("\n</feed>"))
    files.select("file", feed.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return flat(catalogue.read_arxiv_feeds(spark, path), *ARXIV_FIELDS, F.array_join("years", ",").alias("years"))


ORACLES["s4_arxiv_feeds"] = ORACLES["s4_arxiv_works"]


def _entries(spark, sf_dir):
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    author = lambda value: tag("author", tag("name", value))
    entry = F.concat(
        F.lit("<entry>"), tag("id", F.concat(F.lit("http://arxiv.org/abs/"), "arxiv_id", F.lit("v1"))), tag("title", F.concat(F.lit("  "), "title", F.lit("\n"))), tag("published", F.concat(F.col("year").cast("string"), F.lit("-01-02T00:00:00Z"))),
        tag("updated", F.concat((F.col("year") + 1).cast("string"), F.lit("-01-02T00:00:00Z"))), author(F.concat(F.lit("Anna van "), "s1")), author(F.concat(F.lit("B. C. "), "s2")), F.lit("</entry>"),
    )
    return articles(spark, sf_dir).select("work_id", entry.alias("xml"))


@registered("SELECT arxiv_id, title, year, concat(s1, ', ', s2) AS surnames FROM articles WHERE work_id % 3 <> 0")
def s5_datacite_works(spark, sf_dir):
    doi = F.concat(F.lit("10.48550/ARXIV."), F.when(F.col("work_id") % 3 == 0, F.lit("other")).otherwise(F.col("arxiv_id")))
    attributes = F.struct(
        doi.alias("doi"), F.array(F.struct("title")).alias("titles"), F.col("year").cast("string").alias("publicationYear"),
        F.array(F.struct(F.col("s1").alias("familyName"), F.lit("x").alias("name")), F.struct(F.lit("").alias("familyName"), F.concat("s2", F.lit(", B.")).alias("name"))).alias("creators"),
    )
    df = articles(spark, sf_dir).select(F.col("arxiv_id").alias("asked_id"), F.to_json(F.struct(F.struct(attributes.alias("attributes")).alias("data"))).alias("json"))
    return flat(catalogue.datacite_works(df), "arxiv_id", "title", "year")


@registered("SELECT bibcode, doi, title, journal, concat(page_start, '-', page_end) AS pages, concat(lower(bibcode), ' ', lower(doi), ' ', lower(bibcode)) AS identifiers, s1 AS surnames FROM articles")
def s6_ads_works(spark, sf_dir):
    docs = json_of(
        articles(spark, sf_dir), bibcode=F.col("bibcode"), identifier=F.array("bibcode"), doi=F.array("doi"), title=F.array("title"), author=F.array(F.concat("s1", F.lit(", A."))), year=F.col("year").cast("string"), pub=F.col("journal"),
        volume=F.col("volume"), issue=F.col("issue"), page=F.array("page_start", "page_end"),
    )
    return flat(catalogue.ads_works(docs), "bibcode", "doi", "title", "journal", "pages", F.array_join("identifiers", " ").alias("identifiers"))


@registered("SELECT pmid, 'Journal Article, Review' AS pub_types FROM articles")
def s7_pubmed_pub_types(spark, sf_dir):
    types = "<Article><PublicationTypeList><PublicationType UI=\"D1\">Journal Article</PublicationType><PublicationType UI=\"D2\"> Review </PublicationType></PublicationTypeList></Article>"
    xml = F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), "pmid", F.lit(f"</PMID>{types}</MedlineCitation></PubmedArticle>"))
    return catalogue.pubmed_pub_types(articles(spark, sf_dir).select(xml.alias("xml"))).select("pmid", F.array_join("pub_types", ", ").alias("pub_types"))


# --- lookups ------------------------------------------------------------------------------------

found_id = lambda: F.col("record.record_id").alias("record_id")


@registered("SELECT ref_id, CASE WHEN mode <> 10 THEN doi END AS record_id FROM citations WHERE t_doi IS NOT NULL")
def j1_lookup_doi(spark, sf_dir):
    return lookup.lookup_doi(parsed(spark, sf_dir, "doi"), fx.works(spark, sf_dir)).select("ref_id", found_id())


RESOLVES = "CASE WHEN mode = 10 THEN false WHEN work_id % 50 = 0 THEN NULL ELSE work_id % 50 <> 1 END"


@registered(
    f"SELECT ref_id, {RESOLVES} AS resolves, mode <> 10 AND coalesce({RESOLVES}, false) AS doi_explicit_ok, false AS doi_derived_ok, mode = 10 AS doi_invalid FROM citations WHERE t_doi IS NOT NULL"
)
def j2_resolve_doi(spark, sf_dir):
    found = lookup.lookup_doi(parsed(spark, sf_dir, "doi", "cited_doi"), fx.works(spark, sf_dir))
    known = lookup.resolve_doi(found, fx.registry(spark, sf_dir))
    return known.select("ref_id", "resolves", *[c.alias(n) for n, c in lookup.doi_flags().items()])


@registered("SELECT ref_id, pmid AS record_id FROM citations WHERE mode = 5")
def j3_lookup_pmid(spark, sf_dir):
    return lookup.lookup_pmid(parsed(spark, sf_dir, "pmid"), fx.works(spark, sf_dir)).select("ref_id", found_id())


@registered("SELECT ref_id, pmcid AS record_id, pmid AS bridge_pmid FROM citations WHERE mode = 6")
def j4_lookup_pmcid(spark, sf_dir):
    return lookup.lookup_pmcid(parsed(spark, sf_dir, "pmcid"), fx.works(spark, sf_dir)).select("ref_id", found_id(), "bridge_pmid")


def _versions(spark, sf_dir):
    """arXiv has every third article not, every third with version 2, every third without."""
    works = fx.works(spark, sf_dir)
    # The article's number ends its title; identifiers of articles over 99999 are cut and shared.
    number = F.translate(F.substring_index("title", " ", -1), "abcdefghij", "0123456789").cast("long") % 3
    own = works.filter("source = 'arXiv'").filter(number > 0).withColumn("arxiv_id", F.when(number == 1, F.concat("arxiv_id", F.lit("v2"))).otherwise(F.col("arxiv_id"))).withColumn("record_id", F.col("arxiv_id"))
    datacite = works.filter("source = 'arXiv'").withColumn("source", F.lit("DataCite (arXiv)"))
    return own.unionByName(datacite)


def _asked_versions(spark, sf_dir):
    cited = parsed_with(spark, sf_dir, "arxiv_id", "title")
    return cited.withColumn("arxiv_id", F.when(F.col("ref_id") % 24 == 7, F.concat("arxiv_id", F.lit("v2"))).otherwise(F.col("arxiv_id")))


@registered(
    """SELECT ref_id, CASE WHEN ref_id % 24 = 7 THEN CASE WHEN work_id % 3 = 1 THEN concat(arxiv_id, 'v2') END WHEN work_id % 3 = 1 THEN concat(arxiv_id, 'v2') WHEN work_id % 3 = 2 THEN arxiv_id END AS record_id
  FROM citations WHERE mode = 7"""
)
def j5_lookup_arxiv(spark, sf_dir):
    return lookup.lookup_arxiv(_asked_versions(spark, sf_dir), _versions(spark, sf_dir)).select("ref_id", found_id())


@registered("SELECT ref_id, arxiv_id AS record_id FROM citations WHERE mode = 7 AND work_id % 3 = 0 AND ref_id % 24 <> 7")
def j6_lookup_datacite(spark, sf_dir):
    works = _versions(spark, sf_dir)
    return lookup.lookup_datacite(lookup.lookup_arxiv(_asked_versions(spark, sf_dir), works), works).select("ref_id", found_id())


@registered("SELECT ref_id, CASE WHEN work_id % 20 = 3 THEN bibcode END AS record_id FROM citations")
def j7_lookup_ads(spark, sf_dir):
    asked = fx._run(spark, sf_dir, "SELECT ref_id, CASE WHEN ref_id % 2 = 0 THEN bibcode ELSE doi END AS ads_id FROM citations")
    return lookup.lookup_ads(asked, fx.works(spark, sf_dir)).select("ref_id", found_id())


#: Every citation of an article is searched; the two kinds of web page are no articles.
ARTICLE_MODES = "mode NOT IN (8, 11)"
SEARCHED = ("mode", "title", "year", "authors", "uses_et_al", "first_author", "journal")


def searchable(spark, sf_dir):
    """The searched fields of the citations of articles. The mode is known beforehand, so web pages are not parsed for it."""
    return staged(parse_citations(spread(fx.citations(spark, sf_dir).filter(ARTICLE_MODES), "ref_id")).select("ref_id", *SEARCHED))


#: Every candidate of the searches by brute force: shared keys of every citation with every work of its years.
MET = f""", titled AS (SELECT ref_id AS id, t_year AS y, t_journal AS jn, lower(t_title) AS t, lower(t_s1) AS a FROM citations WHERE {ARTICLE_MODES}
  UNION ALL SELECT -1 - work_id, year, journal, lower(title), lower(s1) FROM articles),
keyed AS (SELECT id, y, jn, list_distinct(list_concat(list_transform(string_split(t, ' '), lambda w: 't:' || w),
    list_transform(range(1, len(string_split('^ ' || t || ' $', ' '))), lambda i: 'p:' || string_split('^ ' || t || ' $', ' ')[i] || ' ' || string_split('^ ' || t || ' $', ' ')[i + 1]),
    ['a:' || CASE WHEN length(a) < 8 THEN a ELSE left(a, 3) || right(a, 2) || length(a) END])) AS ks FROM titled),
single AS (SELECT id, y, jn, unnest(ks) AS k FROM keyed),
weights AS (SELECT k, ln((SELECT count(*) FROM articles)::DOUBLE / count(*) + 1) AS idf FROM single WHERE id < 0 GROUP BY k),
met AS (SELECT c.id AS ref_id, w.id AS work, round(sum(idf) + any_value(CASE WHEN c.jn = w.jn THEN {{bonus}} ELSE 0.0 END), 6) AS score
  FROM single c JOIN single w USING (k) JOIN weights USING (k) WHERE c.id >= 0 AND w.id < 0 AND abs(c.y - w.y) <= CASE WHEN c.y <= 1990 THEN 1 ELSE 2 END GROUP BY c.id, w.id)
"""
SEARCH = MET + """, ranked AS (SELECT m.ref_id, doi, row_number() OVER (PARTITION BY m.ref_id ORDER BY score DESC, doi) AS rank FROM met m JOIN articles ON work_id = -1 - work)
SELECT ref_id, CAST(rank AS INT) AS rank, doi FROM ranked WHERE rank <= 5"""


@registered(SEARCH.replace("{bonus}", "0.0"))
def j8_search_candidates(spark, sf_dir):
    return candidates.search_candidates(searchable(spark, sf_dir), fx.works(spark, sf_dir)).select("ref_id", "rank", F.col("record.doi").alias("doi"))


@registered(SEARCH.replace("{bonus}", "1.0"))
def j9_search_fielded(spark, sf_dir):
    return candidates.search_fielded(searchable(spark, sf_dir), fx.works(spark, sf_dir)).select("ref_id", "rank", F.col("record.doi").alias("doi"))


@registered("SELECT ref_id, arxiv_id AS record_id FROM citations WHERE mode IN (0, 3, 4, 5, 6, 7, 9, 10)")
def j10_title_search_unique(spark, sf_dir):
    return candidates.title_search_unique(parsed(spark, sf_dir, "title", "authors", "uses_et_al"), fx.works(spark, sf_dir)).select("ref_id", found_id())


@registered(
    """SELECT ref_id, bibcode AS record_id FROM citations WHERE mode IN (0, 4) AND work_id % 20 = 3
  UNION ALL SELECT ref_id, bibcode AS record_id FROM citations WHERE mode IN (1, 2, 3, 9) AND work_id % 20 = 3"""
)
def j11_ads_discovery(spark, sf_dir):
    missed = parsed(spark, sf_dir, "title", "authors", "uses_et_al", "doi", "pmid", "pmcid", "route").withColumn("record", F.lit(None).cast("string"))
    return candidates.ads_discovery(missed, fx.works(spark, sf_dir)).select("ref_id", found_id())


@registered(
    """SELECT ref_id, CASE WHEN mode IN (5, 6) THEN work_id % 6 = 0 WHEN mode = 2 THEN work_id % 10 = 0 OR work_id % 6 = 0 WHEN mode = 10 THEN t_title LIKE '%review%' ELSE work_id % 10 = 0 OR work_id % 6 = 0 END AS is_review
  FROM citations WHERE mode IN (0, 1, 2, 3, 5, 6, 9, 10)"""
)
def j12_review_lookup(spark, sf_dir):
    works, own = fx.works(spark, sf_dir), parsed(spark, sf_dir, "route", "title", "doi", "pmid", "pmcid")
    at = lambda name: own.filter(F.col("route") == name)
    found = lookup.lookup_doi(at("doi"), works)
    for part in (lookup.lookup_pmid(at("pmid"), works), lookup.lookup_pmcid(at("pmcid"), works)):
        found = found.unionByName(part, allowMissingColumns=True)
    return lookup.review_lookup(found, works, fx.pub_types(spark, sf_dir)).select("ref_id", "is_review")


#: The article's own title and authors, and a year within the tolerance.
FULL = "mode IN (0, 4, 5, 6, 7, 9, 10) OR (mode = 3 AND ref_id % 24 = 3)"


@registered(
    MET.replace("{bonus}", "0.0")
    + f"""SELECT ref_id, had AS had_candidate, CASE WHEN {FULL} THEN doi END AS full_match,
  CASE WHEN mode = 2 THEN CASE WHEN had THEN 'fielded search: no acceptable Crossref match' ELSE 'no Crossref items' END END AS rejected
  FROM (SELECT *, ref_id IN (SELECT ref_id FROM met) AS had FROM citations WHERE {ARTICLE_MODES})"""
)
def w1_choose_best(spark, sf_dir):
    """All citations of articles. Of those whose year is off by three, works of like titles may be accepted, which a test holds against brute force."""
    out = candidates.searched(searchable(spark, sf_dir), fx.works(spark, sf_dir))
    full = F.col("match_reason").contains("title=1.00, year_ok=True, auth_ok=True")
    return out.select("ref_id", "had_candidate", F.when(full, F.col("record.doi")).alias("full_match"), F.when(F.col("mode") == 2, F.col("match_reason")).alias("rejected"))


@registered(
    f"""SELECT ref_id, CASE WHEN {FULL} OR mode = 1 THEN concat('title=1.00, year_ok=True, auth_ok=', CASE WHEN mode = 1 THEN 'False' ELSE 'True' END,
  ', jnl_ok=', CASE WHEN mode IN (7, 9) THEN 'False' ELSE 'True' END, ', tol=', CASE WHEN t_year <= 1990 THEN '1' ELSE '2' END) END AS reason FROM citations WHERE {ARTICLE_MODES}"""
)
def w2_candidate_reason(spark, sf_dir):
    asked = staged(searchable(spark, sf_dir))
    best = candidates.best_choices(asked, fx.works(spark, sf_dir))
    full = best.filter(F.col("reason").startswith("title=1.00")).select("ref_id", "reason")
    return asked.select("ref_id").join(dealt(full), "ref_id", "left")


# --- comparison ---------------------------------------------------------------------------------


@registered()
def c1_text_ratio(spark, sf_dir):
    return fx._run(spark, sf_dir, "SELECT ref_id, title, t_title FROM citations").select("ref_id", F.round(helpers.text_ratio("t_title", "title"), 6).alias("ratio"))


body_query(
    "c2_surname_match",
    "SELECT ref_id, concat('kowalski', translate(CAST(work_id AS STRING), '0123456789', 'abcdefghij'), 'en') AS a, CASE ref_id % 3 WHEN 0 THEN 'kowalsky' WHEN 1 THEN 'kowalski' ELSE 'nowalski' END AS b, translate(CAST(work_id AS STRING), '0123456789', 'abcdefghij') AS k FROM citations",
    lambda: {"same": helpers.surname_match(F.col("a"), F.concat("b", "k", F.lit("en")))}, "SELECT ref_id, ref_id % 3 <> 2 AS same FROM citations",
)


def _compared(spark, sf_dir, *which):
    """All citations with a DOI, those without a record too, with the comparisons of these fields (of all if none is given)."""
    which = which or compare.FIELDS
    cited = parsed_with(spark, sf_dir, "doi", *dict.fromkeys(c for name in which for c in compare.READ[name]))
    return compare.compared(lookup.lookup_doi(cited, fx.works(spark, sf_dir)), which)


@registered(
    """SELECT ref_id, mode NOT IN (1, 2, 10) AS ok, CASE mode WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 10 THEN 0 ELSE 3 END AS matched_count, mode NOT IN (2, 10) AS first_author_ok,
  CASE mode WHEN 1 THEN 'Zimmer' WHEN 2 THEN 'Quinn' ELSE '' END AS wrong_names, CASE WHEN mode IN (1, 2) THEN 'named-author mismatch' WHEN mode = 10 THEN 'no metadata authors' ELSE 'full author list' END AS method
  FROM citations WHERE t_doi IS NOT NULL"""
)
def c3_compare_authors(spark, sf_dir):
    c = F.col("comparison")
    return _compared(spark, sf_dir, "authors").select("ref_id", c["ok"].alias("ok"), c["matched_count"].alias("matched_count"), c["first_author_ok"].alias("first_author_ok"), F.array_join(c["wrong_names"], ", ").alias("wrong_names"), c["method"].alias("method"))


@registered(
    """SELECT ref_id, CASE mode WHEN 1 THEN 'Zimmer is named in the submitted reference but not found in the retrieved author list'
  WHEN 2 THEN concat('Quinn is named in the submitted reference but not found in the retrieved author list; the first named author differs from the retrieved record''s first author, ', s1)
  WHEN 10 THEN array_to_string(list_transform([t_s1, t_s2, s3], lambda n: n || ' is named in the submitted reference but not found in the retrieved author list'), '; ') ELSE '' END AS conflicts
  FROM citations WHERE t_doi IS NOT NULL"""
)
def c4_author_conflicts(spark, sf_dir):
    return _compared(spark, sf_dir, "authors").select("ref_id", F.array_join("comparison.conflicts", "; ").alias("conflicts"))


@registered("SELECT ref_id, mode NOT IN (2, 10) AS title_ok FROM citations WHERE t_doi IS NOT NULL")
def c5_match_title(spark, sf_dir):
    return _compared(spark, sf_dir, "title").select("ref_id", "title_ok")


body_query(
    "c5_title_containment", "SELECT ref_id, t_title, concat(t_title, ' followed by a long second title that nobody cited') AS long FROM citations",
    lambda: {"found": compare.match_title(F.lit("Unrelated words"), F.col("t_title"), F.concat(F.lit("A. B. (2001) "), "long"), 0.75)["method"], "short": compare.match_title(F.lit("x"), F.lit("Short title"), F.lit("A Short title"), 0.75)["ok"]},
    "SELECT ref_id, 'metadata title found in full reference' AS found, false AS short FROM citations",
)


@registered("SELECT ref_id, mode NOT IN (9, 10) AS journal_ok FROM citations WHERE t_doi IS NOT NULL")
def c6_journals_match(spark, sf_dir):
    return _compared(spark, sf_dir, "journal").select("ref_id", "journal_ok")


body_query(
    "c7_journal_abbreviation_issue", "SELECT ref_id, CASE ref_id % 3 WHEN 0 THEN 'Ann Meas Syst' WHEN 1 THEN 'Annals of Measured Systems' ELSE 'Ann Other' END AS v FROM citations",
    lambda: {"uncertain": helpers.journal_abbreviation_issue(F.col("v"), F.lit("Annals of Measured Systems")).isNotNull()}, "SELECT ref_id, ref_id % 3 = 0 AS uncertain FROM citations",
)


@registered(
    """SELECT ref_id, mode <> 10 AND (mode <> 3 OR ref_id % 24 = 3) AS year_ok, mode NOT IN (9, 10) AS volume_ok, mode <> 10 AS issue_ok, mode NOT IN (9, 10) AS pages_ok FROM citations WHERE t_doi IS NOT NULL"""
)
def c8_c9_c10_details(spark, sf_dir):
    return _compared(spark, sf_dir, "year", "volume", "issue", "pages").select("ref_id", "year_ok", "volume_ok", "issue_ok", "pages_ok")


body_query(
    "c10_pages_match", "SELECT ref_id, CAST(ref_id % 40 + 1 AS STRING) AS a, CAST(ref_id % 40 + 5 AS STRING) AS b FROM citations",
    lambda: {"overlap": compare.pages_match(F.col("a"), F.col("b"), F.lit("10-20")), "locator": compare.pages_match(F.concat(F.lit("e"), "a"), F.lit(""), F.lit("e7"))},
    "SELECT ref_id, ref_id % 40 + 1 <= 20 AND ref_id % 40 + 5 >= 10 AS overlap, 'e7' LIKE concat('%e', CAST(ref_id % 40 + 1 AS STRING), '%') AS locator FROM citations",
)


#: What the comparisons and their evidence read.
EVIDENCE = tuple(dict.fromkeys(("doi", "arxiv_id", "ads_id", "author_parse_issue", *(c for name in compare.FIELDS for c in compare.READ[name]))))


def _evidenced(spark, sf_dir):
    found = lookup.lookup_doi(parsed_with(spark, sf_dir, "doi", *EVIDENCE), fx.works(spark, sf_dir))
    return compare.with_evidence(compare.compared(found))


CONFLICTS = "CASE mode WHEN 1 THEN 'authors' WHEN 2 THEN 'authors' WHEN 3 THEN CASE WHEN ref_id % 24 = 3 THEN '' ELSE 'year' END WHEN 9 THEN 'journal, volume, pages' ELSE '' END"


@registered(
    f"""SELECT ref_id, CASE mode WHEN 1 THEN 'conflicting' WHEN 2 THEN 'conflicting' WHEN 10 THEN 'unknown' ELSE 'matched' END AS authors,
  CASE mode WHEN 2 THEN 'conflicting' WHEN 10 THEN 'unknown' ELSE 'matched' END AS title, CASE WHEN mode = 10 THEN 'metadata unavailable' WHEN mode = 9 THEN 'supplied value differs from the retrieved record' ELSE 'comparison matched' END AS volume_reason
  FROM citations WHERE t_doi IS NOT NULL"""
)
def c11_field_evidence(spark, sf_dir):
    e = F.col("evidence")
    return _evidenced(spark, sf_dir).select("ref_id", e["authors"]["status"].alias("authors"), e["title"]["status"].alias("title"), e["volume"]["reason"].alias("volume_reason"))


@registered("SELECT ref_id, CASE WHEN ref_id % 24 = 7 THEN 'conflicting' ELSE 'matched' END AS identifier FROM citations WHERE mode = 7")
def c12_identifier_evidence(spark, sf_dir):
    found = lookup.lookup_arxiv(parsed_with(spark, sf_dir, "arxiv_id", "title", "ads_id"), fx.works(spark, sf_dir))
    cited = F.when(F.col("ref_id") % 24 == 7, F.lit("10.48550/arXiv:2199.99999")).otherwise(F.col("record.doi"))
    done = compare.compared(found.withColumn("doi", cited), ())
    return done.select("ref_id", compare.identifier_evidence()["identifier"]["status"].alias("identifier"))


@registered(f"SELECT ref_id, {CONFLICTS} AS conflicts FROM citations WHERE t_doi IS NOT NULL")
def c13_conflict_list(spark, sf_dir):
    return _evidenced(spark, sf_dir).select("ref_id", F.col("conflict_names").alias("conflicts"))


body_query(
    "c13_confirmed_conflicts", "SELECT ref_id FROM citations",
    lambda: {"names": F.array_join(compare.confirmed_conflicts(F.array(*[F.struct(F.lit(n).alias("field"), (F.col("ref_id") % k > 0).alias("submitted"), F.lit(True).alias("metadata"), (F.col("ref_id") % 5 == 0).alias("matches")) for n, k in (("year", 2), ("pages", 3))])), ",")},
    "SELECT ref_id, CASE WHEN ref_id % 5 = 0 THEN '' ELSE concat_ws(',', CASE WHEN ref_id % 2 > 0 THEN 'year' END, CASE WHEN ref_id % 3 > 0 THEN 'pages' END) END AS names FROM citations",
)

# --- score and label ----------------------------------------------------------------------------

flags = lambda: {n: (F.shiftright(F.col("ref_id").cast("int"), k) % 2 == 1) for k, n in enumerate(classify.POINTS)}
body_query(
    "g1_weighted_score", "SELECT ref_id FROM citations", lambda: {"score": classify.weighted_score(flags())},
    "SELECT ref_id, CAST(" + " + ".join(f"{p} * ((ref_id >> {k}) % 2)" for k, p in enumerate(classify.POINTS.values())) + " AS INT) AS score FROM citations",
)
LABEL = f"""CASE WHEN mode IN (2, 9) THEN '{classify.MAJOR}' WHEN mode = 1 OR (mode = 3 AND ref_id % 24 <> 3) THEN '{classify.DETAILS}' WHEN mode = 10 THEN '{classify.UNVERIFIED}'
  WHEN mode = 8 THEN '{route.MANUAL_REVIEW}' WHEN mode = 11 THEN '{route.WEB}' ELSE '{classify.SUFFICIENT}' END"""


def _verdicts(spark, sf_dir, lookup_status=None):
    """Citations with a DOI, from text to label."""
    also = ("route", "shape_ok", "cited_doi", "inferred_doi", "pmid", "pmcid", "domain", "scholarly_like", "ai_url_flag")
    own = staged(parsed_with(spark, sf_dir, "doi", *EVIDENCE, *also)).filter("route = 'doi'")
    found = with_doi_flags(lookup.lookup_doi(own, fx.works(spark, sf_dir)).withColumn("match_reason", F.lit(None).cast("string")), fx.registry(spark, sf_dir))
    return classified(compare.with_evidence(compare.compared(found)), lookup_status)


@registered(
    f"""SELECT ref_id, {LABEL} AS label, CASE WHEN mode = 10 THEN CASE WHEN ref_id % 24 < 12 THEN 'lookup unavailable: HTTP 503' ELSE '{classify.NO_RECORD}' END END AS issue
  FROM citations WHERE t_doi IS NOT NULL"""
)
def g2_lookup_status(spark, sf_dir):
    """Lookups of half the citations failed: that is an issue of the lookup where no record is known, and never a mismatch."""
    status = fx.citations(spark, sf_dir).select("ref_id", F.when(F.col("ref_id") % 24 < 12, 503).otherwise(404).alias("http_status"))
    return _verdicts(spark, sf_dir, status).select("ref_id", "label", F.col("lookup_issue").alias("issue"))


@registered(f"SELECT ref_id, {LABEL} AS label FROM citations WHERE t_doi IS NOT NULL")
def g2_classify_evidence(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("ref_id", "label")


@registered("SELECT ref_id, CAST(CASE WHEN mode = 10 THEN 1 ELSE 11 + CASE WHEN work_id % 50 > 1 THEN 4 ELSE 0 END - CASE mode WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN CASE WHEN ref_id % 24 = 3 THEN 0 ELSE 2 END WHEN 9 THEN 3 ELSE 0 END END AS INT) AS score FROM citations WHERE t_doi IS NOT NULL")
def g1_scores_of_verdicts(spark, sf_dir):
    """The score of every citation with a DOI, from text and record."""
    return _verdicts(spark, sf_dir).select("ref_id", "score")


@registered(
    f"""SELECT ref_id, CASE WHEN ref_id % 7 = 0 THEN '{route.MANUAL_REVIEW}' WHEN ref_id % 7 = 1 THEN '{classify.DETAILS}' WHEN ref_id % 7 = 2 THEN '{classify.MAJOR}' WHEN ref_id % 7 = 3 THEN '{classify.DETAILS}'
  WHEN ref_id % 7 = 4 THEN '{classify.MAJOR}' WHEN ref_id % 7 = 5 THEN '{classify.SUFFICIENT}' ELSE '{classify.MAJOR}' END AS label,
  CASE ref_id % 7 WHEN 1 THEN 'invalid DOI' WHEN 6 THEN 'no DOI supplied, author mismatch, title mismatch, year mismatch, journal mismatch, volume mismatch, issue mismatch, pages mismatch' WHEN 5 THEN '' END AS reason FROM citations"""
)
def g3_classify_flags(spark, sf_dir):
    k = F.col("ref_id") % 7
    on = lambda *ks: k.isin(*ks)
    rows = fx.citations(spark, sf_dir).select("ref_id").withColumns(
        {
            "manual_review": on(0), "doi_invalid": on(1), "year_ok": on(1, 2, 3, 5), "doi_explicit_ok": on(2, 3), "author_conflict": on(2, 3), "title_ok": on(3, 4, 5), "author_ok": on(4, 5), "journal_ok": on(5),
            "strong_identity": on(4), "volume_ok": on(), "issue_ok": on(), "pages_ok": on(), "shape_ok": on(), "trusted_id": on(), "has_url": on(), "had_candidate": on(),
            "conflicts": F.when(on(4), F.array(F.lit("year"), F.lit("journal"), F.lit("pages"))).otherwise(F.array().cast("array<string>")), "journal": F.lit("j"), "title": F.lit("short"), "first_author": F.lit("A"),
        }
    )
    return classify.classify_flags(rows).select("ref_id", "label", F.when(k.isin(1, 5, 6), F.col("reason")).alias("reason"))


@registered(
    """SELECT ref_id, CASE WHEN mode = 10 THEN 'lookup completed without a usable matching record; supplied DOI was not found; source identity requires review; authors: metadata unavailable; title: metadata unavailable; year: metadata unavailable; journal: metadata unavailable; DOI not found by Crossref or the resolver'
  WHEN work_id % 50 IN (0, 1) THEN 'DOI resolver confirmation unavailable' ELSE '' END AS notes FROM citations WHERE mode IN (0, 10)
  UNION ALL SELECT ref_id, concat_ws('; ', CASE mode WHEN 1 THEN 'author list conflicts' WHEN 2 THEN 'identifier record conflicts with both the submitted author list and title' WHEN 9 THEN 'major metadata conflict: journal, volume, pages'
    WHEN 3 THEN CASE WHEN ref_id % 24 <> 3 THEN 'year mismatch' END END,
    CASE mode WHEN 1 THEN 'Zimmer is named in the submitted reference but not found in the retrieved author list'
      WHEN 2 THEN concat('Quinn is named in the submitted reference but not found in the retrieved author list; the first named author differs from the retrieved record''s first author, ', s1) END,
    CASE WHEN work_id % 50 IN (0, 1) THEN 'DOI resolver confirmation unavailable' END) AS notes FROM citations WHERE mode IN (1, 2, 3, 9)"""
)
def g4_assemble_notes(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("ref_id", "notes")


def validated(spark, sf_dir):
    return validate_citations(fx.citations(spark, sf_dir), fx.works(spark, sf_dir), fx.registry(spark, sf_dir), pub_types=fx.pub_types(spark, sf_dir))


@registered(f"SELECT ref_id, {LABEL} AS label, mode IN (1, 2, 8, 9, 10, 11) OR (mode = 3 AND ref_id % 24 <> 3) AS review_required, {ROUTE} AS route FROM citations")
def g5_validate_citations(spark, sf_dir):
    return validated(spark, sf_dir).select("ref_id", F.col("Validation Result").alias("label"), F.col("Review required").alias("review_required"), "route")


@registered(
    """SELECT ref_id, CASE WHEN mode IN (5, 6) THEN 'PubMed/PMC' WHEN mode = 7 THEN 'arXiv' WHEN mode IN (8, 10, 11) THEN '' ELSE 'Crossref' END AS source, CASE mode WHEN 5 THEN pmid WHEN 6 THEN pmcid ELSE '' END AS pubmed_id,
  coalesce(t_arxiv, '') AS arxiv_id, CASE WHEN mode IN (8, 10, 11) THEN '' WHEN mode = 7 THEN 'arXiv' ELSE journal END AS journal, mode <> 10 AND NOT (mode = 3 AND ref_id % 24 <> 3) AS year_ok, mode NOT IN (1, 2, 10) AS author_ok,
  CAST(CASE WHEN mode IN (8, 11) THEN 0 WHEN mode = 10 THEN 1 WHEN mode = 7 THEN 7 ELSE 11 + CASE WHEN t_doi IS NOT NULL AND work_id % 50 > 1 THEN 4 ELSE 0 END
    - CASE mode WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN CASE WHEN ref_id % 24 = 3 THEN 0 ELSE 2 END WHEN 9 THEN 3 ELSE 0 END END AS INT) AS score FROM citations"""
)
def g5_records_of_routes(spark, sf_dir):
    """What was retrieved for every citation by its route, and its score."""
    names = {"Metadata Source": "source", "PubMed ID": "pubmed_id", "arXiv ID": "arxiv_id", "Metadata Journal": "journal", "year_ok": "year_ok", "author_ok": "author_ok", "Score": "score"}
    return validated(spark, sf_dir).select("ref_id", *[F.col(f"`{n}`").alias(m) for n, m in names.items()])


#: Every citation again by its arXiv identifier (odd ref_id) or its ADS bibcode (even); a third has another year, a third another title and first author.
PHYSICS_REFS = """SELECT ref_id, submission_id, concat(CASE WHEN ref_id % 3 = 2 THEN 'Quinn' ELSE s1 END, ', A., ', s2, ', B. and ', s3, ', C. (', CAST(CASE WHEN ref_id % 3 = 1 THEN 1971 ELSE year END AS STRING), ') ‘',
  CASE WHEN ref_id % 3 = 2 THEN 'Another topic entirely about slow rivers' ELSE title END, '’, ', CASE WHEN ref_id % 2 = 1 THEN concat('arXiv, arXiv:', arxiv_id, '.')
  ELSE concat(journal, ', ', volume, '(', issue, '), pp. ', page_start, '-', page_end, '. https://ui.adsabs.harvard.edu/abs/', bibcode, '/abstract') END) AS ref FROM citations"""


@registered(
    f"""SELECT ref_id, CASE WHEN ref_id % 2 = 1 THEN 'DataCite (arXiv)' WHEN work_id % 20 = 3 THEN 'NASA ADS' ELSE '' END AS source,
  CASE WHEN ref_id % 2 = 0 AND work_id % 20 <> 3 THEN '{classify.UNVERIFIED}' ELSE CASE ref_id % 3 WHEN 0 THEN '{classify.SUFFICIENT}' WHEN 1 THEN '{classify.DETAILS}' ELSE '{classify.MAJOR}' END END AS label,
  CASE WHEN ref_id % 2 = 0 AND work_id % 20 <> 3 THEN '{classify.NO_RECORD}' ELSE '' END AS issue FROM citations"""
)
def g5_labels_of_physics_routes(spark, sf_dir):
    """Citations by preprint and bibcode, where arXiv itself has no record and DataCite has, and ADS has some articles."""
    works = fx.works(spark, sf_dir).withColumn("source", F.when(F.col("source") == "arXiv", "DataCite (arXiv)").otherwise(F.col("source")))
    out = validate_citations(fx._run(spark, sf_dir, PHYSICS_REFS), works, fx.registry(spark, sf_dir))
    return out.select("ref_id", F.col("Metadata Source").alias("source"), F.col("Validation Result").alias("label"), F.col("Lookup issue").alias("issue"))


@registered("SELECT ref_id, CASE ref_id % 4 WHEN 0 THEN 2 WHEN 2 THEN -1 ELSE 0 END AS doi_score, CASE WHEN ref_id % 4 = 0 THEN '' ELSE 'Manual check required' END AS status FROM citations")
def g6_g7_doi_score(spark, sf_dir):
    k = F.col("ref_id") % 4
    rows = fx.citations(spark, sf_dir).select("ref_id").withColumns(
        {"doi_explicit_ok": k == 0, "doi_derived_ok": k == 1, "Extracted DOI": F.when(k < 3, "10.1000/x").otherwise(""), "Crossref DOI": F.lit(""), "Notes": F.lit("Invalid DOI"), "Validation Result": F.when(k == 0, classify.SUFFICIENT).otherwise(classify.DETAILS)}
    )
    return rows.select("ref_id", classify.doi_score().alias("doi_score"), classify.manual_check_status(F.col("Validation Result")).alias("status"))


# --- reports ------------------------------------------------------------------------------------

#: Results as text and label give them, without any lookup, for the reports.
RESULTS = f"""SELECT ref_id, submission_id, CAST(ref_id AS INT) AS `Ref #`, {LABEL} AS `Validation Result`, CAST(mode AS INT) AS Score, ref AS Reference, concat('note ', CAST(mode AS STRING)) AS Notes,
  CASE WHEN t_url IS NULL THEN '' WHEN mode = 8 THEN 'who.int' WHEN mode = 6 THEN 'pmc.ncbi.nlm.nih.gov' WHEN mode = 11 THEN concat('blog', CAST(work_id % 30 AS STRING), '.example.com') ELSE 'doi.org' END AS Domain, mode = 11 AS `AI URL flag`,
  coalesce(t_doi, '') AS `Extracted DOI`, CASE WHEN t_doi IS NOT NULL AND mode <> 10 THEN t_doi ELSE '' END AS `Crossref DOI`, CASE WHEN mode IN (5, 6) THEN 'PubMed/PMC' WHEN mode = 7 THEN 'arXiv' WHEN mode < 4 OR mode = 9 THEN 'Crossref' ELSE '' END AS `Metadata Source`,
  CASE WHEN mode = 7 THEN concat('https://arxiv.org/abs/', arxiv_id) ELSE '' END AS `Metadata Record URL`, '' AS `Metadata DOI`, coalesce(t_pmid, t_pmcid, '') AS `PubMed ID`, coalesce(t_url, '') AS `Source URL`,
  mode IN (0, 1, 2, 3, 9) AS doi_explicit_ok, mode = 4 AS doi_derived_ok FROM citations"""
results = lambda spark, sf_dir: fx._run(spark, sf_dir, RESULTS)
R = RESULTS.replace("`", '"')


@registered(f'SELECT "Validation Result" AS "Category", count(*) AS "Count" FROM ({R}) GROUP BY 1')
def a1_label_counts(spark, sf_dir):
    return report.label_counts(results(spark, sf_dir))


@registered(f"SELECT Domain, count(*) AS \"Count\" FROM ({R}) WHERE Domain <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def a2_top_domains(spark, sf_dir):
    return report.top_domains(results(spark, sf_dir), 20)


@registered("SELECT Domain, " + ", ".join(f"count(*) FILTER (\"Validation Result\" = '{label}') AS \"{label}\"" for label in report.LABELS) + f" FROM ({R}) WHERE Domain <> '' GROUP BY 1")
def a3_domain_label_matrix(spark, sf_dir):
    return report.domain_label_matrix(results(spark, sf_dir))


@registered("SELECT ref_id FROM citations WHERE mode IN (1, 2, 8, 9, 10, 11) OR (mode = 3 AND ref_id % 24 <> 3)")
def a4_issue_rows(spark, sf_dir):
    return report.issue_rows(results(spark, sf_dir)).select("ref_id")


@registered(
    """SELECT submission_id, count(*) AS total, CAST(sum(CASE WHEN mode IN (0, 4, 5, 6, 7) OR ref_id % 24 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS real, CAST(sum(CASE WHEN mode IN (8, 10, 11) THEN 1 ELSE 0 END) AS BIGINT) AS review,
  CAST(sum(CASE WHEN mode = 1 OR (mode = 3 AND ref_id % 24 <> 3) THEN 1 ELSE 0 END) AS BIGINT) AS suspicious, CAST(sum(CASE WHEN mode IN (2, 9) THEN 1 ELSE 0 END) AS BIGINT) AS danger, CAST(sum(CASE WHEN mode = 11 THEN 1 ELSE 0 END) AS BIGINT) AS ai_tracking
  FROM citations GROUP BY 1"""
)
def a5_summary_buckets(spark, sf_dir):
    return report.summary_buckets(results(spark, sf_dir))


@registered(
    """SELECT ref_id, b AS bucket, CASE WHEN mode = 8 OR mode = 1 OR (mode = 3 AND ref_id % 24 <> 3) THEN 'warning' WHEN mode IN (2, 9) THEN 'danger' WHEN mode IN (10, 11) THEN 'review' ELSE 'real' END AS tone
  FROM citations, unnest(['all', 'real', 'review', 'suspicious', 'danger']) u(b)
  WHERE b = 'all' OR b = CASE WHEN mode IN (8, 10, 11) THEN 'review' WHEN mode = 1 OR (mode = 3 AND ref_id % 24 <> 3) THEN 'suspicious' WHEN mode IN (2, 9) THEN 'danger' ELSE 'real' END"""
)
def a6_filter_bucket(spark, sf_dir):
    own = results(spark, sf_dir)
    parts = [report.filter_bucket(own, b).select("ref_id", F.lit(b).alias("bucket"), "tone") for b in ("all", *report.BUCKETS)]
    return functools.reduce(DataFrame.unionByName, parts)


@registered(
    """SELECT ref_id, p AS "Part", CASE
    WHEN mode = 10 THEN 'Not verified'
    WHEN p = 'DOI' THEN CASE WHEN mode IN (0, 1, 2, 3, 9) THEN CASE WHEN work_id % 50 > 1 THEN 'Matched' ELSE 'Not verified' END WHEN mode = 4 AND work_id % 50 > 1 THEN 'Metadata only' ELSE 'Not found' END
    WHEN p = 'Identifier' THEN 'Matched'
    WHEN p = 'Authors' THEN CASE WHEN mode IN (1, 2) THEN 'Different' ELSE 'Matched' END
    WHEN p = 'Title' THEN CASE WHEN mode = 2 THEN 'Different' ELSE 'Matched' END
    WHEN p = 'Year' THEN CASE WHEN mode = 3 AND ref_id % 24 <> 3 THEN 'Different' ELSE 'Matched' END
    WHEN p = 'Journal' THEN CASE WHEN mode = 9 THEN 'Different' ELSE 'Matched' END
    WHEN mode = 7 THEN 'Not verified'
    WHEN p IN ('Volume', 'Pages') AND mode = 9 THEN 'Different' ELSE 'Matched' END AS "Status"
  FROM citations, unnest(['Identifier', 'DOI', 'Authors', 'Year', 'Title', 'Journal', 'Volume', 'Issue', 'Pages']) u(p)
  WHERE mode NOT IN (8, 11) AND (p <> 'Identifier' OR mode = 7)"""
)
def a7_part_by_part(spark, sf_dir):
    return report.part_by_part(validated(spark, sf_dir).filter("route NOT IN ('manual_review', 'web')")).select("ref_id", "Part", "Status")


@registered(
    f"""SELECT ref_id, CASE WHEN mode = 7 THEN "Metadata Record URL" WHEN mode < 4 OR mode = 9 THEN concat('https://doi.org/', "Crossref DOI") WHEN mode = 5 THEN concat('https://pubmed.ncbi.nlm.nih.gov/', "PubMed ID", '/')
  WHEN mode = 6 THEN concat('https://pmc.ncbi.nlm.nih.gov/articles/', "PubMed ID", '/') ELSE '' END AS record_link, CASE WHEN "Extracted DOI" <> '' THEN concat('https://doi.org/', "Extracted DOI") ELSE '' END AS doi_link,
  CASE mode WHEN 5 THEN concat('https://pubmed.ncbi.nlm.nih.gov/', "PubMed ID", '/') WHEN 6 THEN concat('https://www.ncbi.nlm.nih.gov/pmc/articles/', "PubMed ID", '/') ELSE '' END AS pubmed_link, "Source URL" AS source_link
  FROM (SELECT *, Score AS mode FROM ({R}))"""
)
def a8_record_links(spark, sf_dir):
    links = report.record_links(results(spark, sf_dir))
    return links.select("ref_id", *[F.col(n).alias(n.lower().replace(" ", "_")) for n in ("Record link", "DOI link", "PubMed link", "Source link")])


@registered(
    f"""SELECT "Ref #", "Validation Result", Score AS "Score", CASE WHEN doi_explicit_ok THEN 2 ELSE 0 END AS "DOI score", "AI URL flag", '' AS "Manual review", '' AS "AL notes", Notes AS "Notes", "Source URL", Reference AS "Reference" FROM ({R})"""
)
def a9_result_view(spark, sf_dir):
    return report.result_view(results(spark, sf_dir), "condensed", export=True)


@registered(
    f"""SELECT "Ref #", "Validation Result", Score, '' AS "Manual review", "AI URL flag", '' AS "AL notes", Reference, Domain, "Source URL", "Extracted DOI", "Metadata Source", "Metadata Record URL", "Metadata DOI",
  "Crossref DOI", "PubMed ID", Notes, doi_explicit_ok, doi_derived_ok FROM ({R})"""
)
def a9_view_for_export(spark, sf_dir):
    return report.result_view(results(spark, sf_dir), "full", review=True, debug=True, export=True)


@registered(
    f"""SELECT "Ref #", "Validation Result", Score, '' AS "Is Review", CASE WHEN doi_explicit_ok THEN 2 ELSE 0 END AS "DOI score", "AI URL flag", '' AS "AL notes", Notes,
  CASE WHEN Score = 7 THEN "Metadata Record URL" WHEN Score < 4 OR Score = 9 THEN concat('https://doi.org/', "Crossref DOI") WHEN Score = 5 THEN concat('https://pubmed.ncbi.nlm.nih.gov/', "PubMed ID", '/')
    WHEN Score = 6 THEN concat('https://pmc.ncbi.nlm.nih.gov/articles/', "PubMed ID", '/') ELSE '' END AS "Record link",
  "Source URL" AS "Source link", CASE WHEN "Extracted DOI" <> '' THEN concat('https://doi.org/', "Extracted DOI") ELSE '' END AS "DOI link" FROM ({R})"""
)
def a9_view_for_display(spark, sf_dir):
    return report.result_view(results(spark, sf_dir), "condensed", review=True)


def _row_sql(columns):
    """A row as text, as the signature takes it."""
    return " || ".join(f"""coalesce(length(CAST("{c}" AS VARCHAR)) || ':' || CAST("{c}" AS VARCHAR), '-')""" for c in sorted(columns))


RESULT_COLUMNS = ("ref_id", "Ref #", "Validation Result", "Score", "Reference", "Notes", "Domain", "AI URL flag", "Extracted DOI", "Crossref DOI", "Metadata Source", "Metadata Record URL", "Metadata DOI", "PubMed ID", "Source URL", "doi_explicit_ok", "doi_derived_ok")


@registered(
    f""", r AS ({R}), h AS (SELECT submission_id, md5({_row_sql(RESULT_COLUMNS)}) AS hash FROM r)
  SELECT submission_id, sha256(concat_ws(':', count(*), {", ".join(f"CAST(sum(CAST('0x' || substr(hash, {at}, 8) AS BIGINT)) AS VARCHAR)" for at in (1, 9, 17, 25))})) AS signature FROM h GROUP BY 1"""
)
def a10_results_signature(spark, sf_dir):
    return report.results_signature(results(spark, sf_dir))


def _shared(spark, name):
    """A new folder for a written dataset, beside the checkpoints."""
    return f"{checkpoint_folder(spark)}/{name}-{spark.sql('SELECT uuid()').first()[0]}"


@registered(
    f""", r AS ({R}) SELECT 'summary' AS part, "Validation Result" AS name, count(*) AS n FROM r GROUP BY 2
  UNION ALL SELECT 'results', Reference, "Ref #" FROM r
  UNION ALL SELECT 'issues', Reference, "Ref #" FROM r WHERE "Validation Result" IN ({', '.join(f"'{x}'" for x in report.REVIEW_LABELS)}) OR "AI URL flag"
  UNION ALL (SELECT 'top_domains', Domain, count(*) FROM r WHERE Domain <> '' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 50)
  UNION ALL SELECT 'domains', concat(Domain, ' / ', "Validation Result"), count(*) FROM r WHERE Domain <> '' GROUP BY 2"""
)
def k1_write_report(spark, sf_dir):
    """Every table of a written report, read back: names and numbers of all rows."""
    path = _shared(spark, "report")
    sinks.write_report(results(spark, sf_dir), path, "csv")
    read = lambda name: spark.read.option("header", "true").csv(f"{path}/{name}")
    rows = lambda df, part, name, n: df.select(F.lit(part).alias("part"), name.alias("name"), n.cast("long").alias("n"))
    domains = read("domains").select("Domain", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"`{x}`").cast("long").alias("n")) for x in report.LABELS])).alias("c")).filter("c.n > 0")
    parts = [
        rows(read("summary"), "summary", F.col("Category"), F.col("Count")), rows(read("top_domains"), "top_domains", F.col("Domain"), F.col("Count")),
        *[rows(read(name), name, F.col("Reference"), F.col("Ref #")) for name in ("results", "issues")],
        rows(domains, "domains", F.concat_ws(" / ", "Domain", "c.label"), F.col("c.n")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


@registered(f"SELECT ref_id, \"Validation Result\" AS label, CASE WHEN \"Validation Result\" = '{classify.SUFFICIENT}' THEN '' ELSE 'Manual check required' END AS status, 'A-1' AS identifier FROM ({R})")
def k2_guarded_export(spark, sf_dir):
    path = _shared(spark, "export")
    sinks.guarded_export(results(spark, sf_dir), path, " A-1 ", True)
    out = spark.read.parquet(path)
    return out.select("ref_id", F.col("Validation Result").alias("label"), F.col("Manual check status").alias("status"), F.col("File identifier").alias("identifier"))


@registered(f"SELECT submission_id, 'S390' AS module, 'SXB' AS s390_choice, count(*) AS n_refs, count(*) FILTER (\"Validation Result\" = '{classify.MAJOR}') AS n_major FROM ({R}) GROUP BY 1")
def k3_run_records(spark, sf_dir):
    path = _shared(spark, "runs")
    records = sinks.run_records(results(spark, sf_dir), fx.submissions(spark, sf_dir), "app", "S390", "SXB", run="r1")
    for _ in range(2):
        sinks.write_run_records(records, path)
    major = F.coalesce(F.try_element_at("result_counts", F.lit(classify.MAJOR)), F.lit(0))
    return sinks.read_run_records(spark, path).select("submission_id", "module", "s390_choice", F.size("findings").cast("long").alias("n_refs"), major.alias("n_major"))


@registered(f"SELECT label, count(*) AS n FROM (SELECT {LABEL} AS label FROM citations WHERE t_doi IS NOT NULL) GROUP BY 1")
def labels_of_doi_citations(spark, sf_dir):
    """For citations with a DOI: how many get each label."""
    return _verdicts(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
