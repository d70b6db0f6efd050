"""Citations and a catalogue derived from the order and part tables, in SQL that Spark and DuckDB both run.

Every order is a citation of a part's article; its key decides how the citation was altered (``mode``):
0 none, 1 a co-author, 2 title and first author, 3 the year by 1 or 3, 4 no DOI, 5 a PMID, 6 a PMC address,
7 an arXiv identifier, 8 an organisation's page, 9 journal, volume and pages, 10 an unknown DOI, 11 a web
page with a tracked address. What each field should be read as stands beside the text, under a name with t_.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import dealt, spread
from ..sources.catalogue import WORKS, as_works

_LETTERS = "translate(CAST({} AS STRING), '0123456789', 'abcdefghij')"

ARTICLES = f"""
SELECT p_partkey AS work_id, concat('10.', CAST(1000 + p_size AS STRING), '/p', CAST(p_partkey AS STRING)) AS doi,
  CAST(10000000 + p_partkey AS STRING) AS pmid, concat('PMC', CAST(500000 + p_partkey AS STRING)) AS pmcid,
  concat('2101.', lpad(CAST(p_partkey AS STRING), 5, '0')) AS arxiv_id, concat('2001TestJ', CAST(1000000 + p_partkey AS STRING)) AS bibcode,
  concat(CASE WHEN p_partkey % 10 = 0 THEN 'A systematic review of ' ELSE 'Measured ' END, 'effects of ', p_name, ' in ', lower(p_type), ' trials of series ', {_LETTERS.format('p_partkey')}) AS title,
  concat('Kar', {_LETTERS.format('p_partkey')}) AS s1, concat('Bel', {_LETTERS.format('p_partkey % 97')}) AS s2, concat('Dor', {_LETTERS.format('p_size')}) AS s3,
  CAST(1985 + p_partkey % 35 AS INT) AS year,
  CASE p_partkey % 6 WHEN 0 THEN 'Sleep Medicine Reviews' WHEN 1 THEN 'Nature Reviews Neuroscience' WHEN 2 THEN 'Psychological Bulletin'
    WHEN 3 THEN 'Journal of Applied Studies' WHEN 4 THEN 'Annals of Measured Systems' ELSE 'BMC Pediatrics' END AS journal,
  CAST(p_size AS STRING) AS volume, CAST(p_partkey % 12 + 1 AS STRING) AS issue,
  CAST(p_partkey % 500 + 1 AS STRING) AS page_start, CAST(p_partkey % 500 + 10 AS STRING) AS page_end
FROM {{part}}
"""

CITED = f"""
SELECT o.o_orderkey AS ref_id, o.o_custkey AS submission_id, CAST(o.o_orderkey % 12 AS INT) AS mode, a.*,
  CASE WHEN o.o_orderkey % 12 = 2 THEN 'Quinn' ELSE s1 END AS t_s1, CASE WHEN o.o_orderkey % 12 = 1 THEN 'Zimmer' ELSE s2 END AS t_s2,
  CASE WHEN o.o_orderkey % 12 = 2 THEN 'Another topic entirely about slow rivers' ELSE title END AS t_title,
  CASE WHEN o.o_orderkey % 12 = 3 THEN year + CASE WHEN o.o_orderkey % 24 = 3 THEN 1 ELSE 3 END ELSE year END AS t_year,
  CASE o.o_orderkey % 12 WHEN 9 THEN 'Wholly Other Letters' WHEN 7 THEN 'arXiv' ELSE journal END AS t_journal,
  CASE WHEN o.o_orderkey % 12 = 9 THEN '777' ELSE volume END AS t_volume,
  CASE WHEN o.o_orderkey % 12 = 9 THEN '8001' ELSE page_start END AS t_start, CASE WHEN o.o_orderkey % 12 = 9 THEN '8009' ELSE page_end END AS t_end,
  CASE WHEN o.o_orderkey % 12 IN (0, 1, 2, 3, 9) THEN doi WHEN o.o_orderkey % 12 = 10 THEN concat('10.9999/x', CAST(o.o_orderkey AS STRING)) END AS t_doi,
  CASE WHEN o.o_orderkey % 12 = 5 THEN pmid END AS t_pmid, CASE WHEN o.o_orderkey % 12 = 6 THEN pmcid END AS t_pmcid,
  CASE WHEN o.o_orderkey % 12 = 7 THEN arxiv_id END AS t_arxiv,
  CASE WHEN o.o_orderkey % 12 IN (0, 1, 2, 3, 9, 10) THEN concat('https://doi.org/', CASE WHEN o.o_orderkey % 12 = 10 THEN concat('10.9999/x', CAST(o.o_orderkey AS STRING)) ELSE doi END)
    WHEN o.o_orderkey % 12 = 6 THEN concat('https://pmc.ncbi.nlm.nih.gov/articles/', pmcid)
    WHEN o.o_orderkey % 12 = 8 THEN concat('https://www.who.int/pages/', {_LETTERS.format('o.o_orderkey')})
    WHEN o.o_orderkey % 12 = 11 THEN concat('https://blog.example.com/', {_LETTERS.format('o.o_orderkey')}, '?utm_source=chatgpt.com') END AS t_url
FROM {{orders}} o JOIN articles a ON a.work_id = CAST(floor(o.o_orderkey * 2 / 15) AS BIGINT)
"""

CITATIONS = """
SELECT *, CASE
  WHEN mode = 8 THEN concat('World Health Organization (', CAST(year AS STRING), ') Annual statistics page. Available at: ', t_url, ' (Accessed 3 May 2024)')
  WHEN mode = 11 THEN concat('Brook, J. (', CAST(year AS STRING), ') Small notes. Available at: ', t_url)
  WHEN mode = 7 THEN concat(t_s1, ', A., ', t_s2, ', B. and ', s3, ', C. (', CAST(t_year AS STRING), ') ‘', t_title, '’, arXiv, arXiv:', arxiv_id, '.')
  ELSE concat(t_s1, ', A., ', t_s2, ', B. and ', s3, ', C. (', CAST(t_year AS STRING), ') ‘', t_title, '’, ', t_journal, ', ', t_volume, '(', issue, '), pp. ', t_start, '-', t_end, '.',
    CASE WHEN mode = 5 THEN concat(' PMID: ', pmid) WHEN t_url IS NOT NULL THEN concat(' ', t_url) ELSE '' END) END AS ref
FROM cited
"""


def sql(body: str, **tables: str) -> str:
    """A query over the views articles, cited and citations, with the table names put in."""
    text = f"WITH articles AS ({ARTICLES}), cited AS ({CITED}), citations AS ({CITATIONS})\n{body}"
    names = {"part": "part", "orders": "orders"} | tables
    for name, value in names.items():
        text = text.replace("{" + name + "}", value)
    return text


def _run(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(sql(body, part="{part}", orders="{orders}"), part=read("part"), orders=dealt(read("orders")))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, submission_id, mode, ref)."""
    return _run(spark, sf_dir, "SELECT ref_id, submission_id, mode, ref FROM citations")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ARTICLES, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article as Crossref, PubMed, PMC and arXiv have it, and some as ADS has it."""
    # A table of one row group would make every record in one task.
    a = spread(articles(spark, sf_dir), "work_id")
    no = F.lit(None).cast("string")
    person = lambda name, given: F.struct(F.lit(given).alias("given"), F.col(name).alias("family"), no.alias("last"), no.alias("name"))
    people = F.array(person("s1", "A."), person("s2", "B."), person("s3", "C."))
    pages = F.concat_ws("-", "page_start", "page_end")
    own = a.withColumns({"authors": people, "pages": pages, "years": F.array(F.col("year").cast("string")), "dois": F.array("doi")})
    crossref = as_works(own.drop("pmcid", "arxiv_id", "bibcode").withColumns({"source": F.lit("Crossref"), "record_id": F.col("doi"), "type": F.lit("journal-article")}))
    dated = own.withColumn("pubdate", F.concat(F.col("year").cast("string"), F.lit(" Mar")))
    pubmed = as_works(dated.drop("doi", "dois", "pmcid", "arxiv_id", "bibcode", "year", "years").withColumns({"source": F.lit("PubMed/PMC"), "record_id": F.col("pmid")}))
    pmc = as_works(dated.drop("doi", "dois", "arxiv_id", "bibcode", "year", "years").withColumns({"source": F.lit("PubMed/PMC"), "record_id": F.col("pmcid")}))
    preprint = F.concat(F.lit("10.48550/arXiv."), "arxiv_id")
    arxiv = as_works(
        own.drop("pmid", "pmcid", "bibcode", "volume", "issue", "pages").withColumns(
            {"source": F.lit("arXiv"), "record_id": F.col("arxiv_id"), "doi": preprint, "dois": F.array(preprint), "journal": F.lit("arXiv"), "type": F.lit("preprint"), "url": F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id")}
        )
    )
    ads = as_works(
        own.filter("work_id % 20 = 3").drop("pmid", "pmcid", "arxiv_id").withColumns(
            {"source": F.lit("NASA ADS"), "record_id": F.col("bibcode"), "identifiers": F.array(F.lower("bibcode"), F.lower("doi")), "type": F.lit("article"), "url": F.concat(F.lit("https://ui.adsabs.harvard.edu/abs/"), "bibcode", F.lit("/abstract"))}
        )
    )
    out = crossref
    for part in (pubmed, pmc, arxiv, ads):
        out = out.unionByName(part)
    return out


REGISTRY = """
SELECT doi, CASE WHEN work_id % 50 = 0 THEN NULL ELSE work_id % 50 <> 1 END AS resolves FROM articles
UNION ALL SELECT t_doi AS doi, false AS resolves FROM cited WHERE mode = 10
"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doi, resolves): some DOIs do not resolve, of some it is not known."""
    return _run(spark, sf_dir, REGISTRY)


def pub_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, pub_types) of every second article; each third of these is a review."""
    a = articles(spark, sf_dir).filter("work_id % 2 = 0")
    return a.select("pmid", F.when(F.col("work_id") % 3 == 0, F.array(F.lit("Journal Article"), F.lit("Systematic Review"))).otherwise(F.array(F.lit("Journal Article"))).alias("pub_types"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(submission_id, text): each customer's citations as a pasted list, one a line."""
    lines = citations(spark, sf_dir).groupBy("submission_id").agg(F.array_sort(F.collect_list(F.struct("ref_id", "ref"))).alias("refs"))
    return lines.select("submission_id", F.array_join(F.transform("refs", lambda r: r["ref"]), "\n").alias("text"))


__all__ = ["WORKS", "articles", "citations", "pub_types", "registry", "sql", "submissions", "works"]
