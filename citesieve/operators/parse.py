"""All fields of a reference as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import helpers, text
from .route import org_web_source, route_of, trusted_domain

AI_NOTE = "AI tracking parameter detected: utm_source=chatgpt"


def parse_citations(citations: DataFrame) -> DataFrame:
    """citations (ref_id, ref, ...) with every extracted field; other columns are kept. No shuffle.

    Steps are stacked so that a costly expression is computed once for those that read it. Stage the result
    (``staging.staged``) before filtering on extracted fields: Spark would push such filters below the extraction.
    """
    df = citations.withColumn("reference", text.fix_broken_urls(text.strip_list_marker(F.coalesce("ref", F.lit("")))))
    df = df.withColumns({"ref_clean": text.clean_reference(F.col("reference")), "urls": text.extract_urls(F.col("reference"))})
    clean, ref = F.col("ref_clean"), F.col("reference")
    df = df.withColumns({"authors": helpers.author_surnames(clean), "ai_url_flag": helpers.ai_tracking_flag(ref)})
    df = df.withColumns(
        {
            "uses_et_al": text.uses_et_al(clean), "year_token": text.year_token(clean), "year": text.year_value(clean),
            "title": text.extract_title(clean), "shape_ok": text.bibliographic_shape(clean),
            "domains": text.extract_domains(F.col("urls")), "cited_doi": text.extract_doi(ref), "pmid": text.extract_pmid(ref, F.col("urls")),
            "pmcid": text.extract_pmcid(ref), "arxiv_id": text.extract_arxiv_id(ref), "ads_id": text.extract_ads_id(ref),
        }
    )
    df = df.withColumn("tail", text.publication_tail(clean, F.col("title")))
    df = df.withColumns({"found_journal": text.extract_journal(clean, F.col("tail")), "vip": text.vol_issue_pages(clean, F.col("tail"))})
    df = df.withColumns(
        {
            "journal": F.lower("found_journal"), "scholarly_like": text.scholarly_like(clean, *map(F.col, ("year_token", "title", "found_journal", "shape_ok"))),
            **{f: F.col(f"vip.{f}") for f in ("volume", "issue", "pages", "page_start", "page_end")},
            "first_author": text.first_of(F.col("authors")), "source_url": text.first_of(F.col("urls")), "domain": text.first_of(F.col("domains")),
            "inferred_doi": F.when(F.col("cited_doi").isNull(), text.infer_doi_from_url(F.col("urls"))),
            "author_parse_issue": helpers.author_extraction_issue(clean, F.col("authors")),
        }
    ).drop("vip", "tail", "found_journal")
    df = df.withColumns({"doi": F.coalesce("cited_doi", "inferred_doi"), "trusted_web": trusted_domain(F.col("domain"))})
    df = df.withColumn("org_web", org_web_source(F.col("reference")))
    return df.withColumn("route", route_of())
