"""From citations to results: parse, route, look up, compare, score and label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates, classify, compare, identifiers, lookup, route
from ..operators.parse import AI_NOTE, parse_citations
from ..operators.staging import dealt, spread, staged

VERSION = "1"
#: Columns of a result, with the expression that gives each from a classified row.
RESULT = {
    "ref_id": "ref_id", "Ref #": "coalesce(ref_no, 1)", "submission_id": "submission_id", "Reference": "reference", "Validator Version": f"'{VERSION}'",
    "Metadata Source": "coalesce(record.source, '')", "Metadata Record URL": "coalesce(CASE WHEN record.source IN ('arXiv', 'DataCite (arXiv)', 'NASA ADS') THEN record.url END, '')",
    "Metadata DOI": "coalesce(record.doi, '')",
    "Metadata Year": "coalesce(CASE WHEN record.source = 'PubMed/PMC' THEN record.pubdate WHEN record.source = 'Crossref' THEN cast(record.year AS string) ELSE array_join(record.years, ', ') END, '')",
    "Metadata Journal": "coalesce(record.journal, '')", "Source Type": "coalesce(CASE WHEN record.source NOT IN ('Crossref', 'PubMed/PMC') THEN record.type END, '')",
    "arXiv ID": "coalesce(arxiv_id, '')", "ADS ID": "coalesce(ads_id, '')", "Extracted DOI": "coalesce(doi, '')", "DOI Source": "coalesce(doi_source, '')",
    "Crossref DOI": "coalesce(CASE WHEN record.source = 'Crossref' THEN record.doi END, '')", "Crossref Journal": "coalesce(CASE WHEN record.source = 'Crossref' THEN record.journal END, '')",
    "Crossref Year": "coalesce(CASE WHEN record.source = 'Crossref' THEN cast(record.year AS string) END, '')",
    "Extracted Title": "coalesce(title, '')", "Metadata Title": "coalesce(record.title, '')", "Extracted Year": "coalesce(year_token, '')", "Extracted Journal": "coalesce(journal, '')",
    "Extracted Volume": "coalesce(volume, '')", "Extracted Issue": "coalesce(issue, '')", "Extracted Pages": "coalesce(pages, '')",
    "Metadata Volume": "coalesce(record.volume, '')", "Metadata Issue": "coalesce(record.issue, '')", "Metadata Pages": "coalesce(record.pages, '')",
    "PubMed ID": "coalesce(CASE WHEN record.source = 'PubMed/PMC' THEN record.record_id END, '')", "PubMed Journal": "coalesce(CASE WHEN record.source = 'PubMed/PMC' THEN record.journal END, '')",
    "PubMed Year": "coalesce(CASE WHEN record.source = 'PubMed/PMC' THEN record.pubdate END, '')",
    "Score": "score", "Source URL": "coalesce(source_url, '')", "year_ok": "year_ok", "author_ok": "author_ok",
    "Extracted Authors": "array_join(authors, ', ')", "Metadata Authors": "coalesce(array_join(record.surnames, ', '), '')", "Uses et al.": "uses_et_al",
    "Author match method": "comparison.method", "Author match count": "comparison.matched_count", "Submitted author count": "comparison.submitted_count",
    "Metadata author count": "comparison.metadata_count", "Author submitted coverage": "round(comparison.submitted_coverage, 3)",
    "Author metadata coverage": "round(comparison.metadata_coverage, 3)", "First author matches": "comparison.first_author_ok",
    "Omitted author count": "comparison.omitted_count", "Omitted Authors": "array_join(comparison.omitted_names, ', ')", "Wrong author count": "comparison.wrong_count",
    "Author list incomplete": "comparison.incomplete", "Author list contradictory": "comparison.contradictory",
    "journal_ok": "journal_ok", "Validation Result": "label", "Notes": "notes", "AI URL flag": "ai_url_flag", "AL notes": f"CASE WHEN ai_url_flag THEN '{AI_NOTE}' ELSE '' END",
    "Domain": "coalesce(domain, '')", "Domains": "array_join(domains, ', ')", "doi_explicit_ok": "doi_explicit_ok", "doi_derived_ok": "doi_derived_ok", "title_ok": "title_ok",
    "title_similarity": "round(coalesce(title_match.similarity, 0), 3)", "title_match_confidence": "round(coalesce(title_match.confidence, 0), 3)", "title_match_method": "title_match.method",
    "strong_identity_match": "strong_identity", "vol_ok": "volume_ok", "issue_ok": "issue_ok", "pages_ok": "pages_ok", "Comparison evidence": "evidence",
    "Author extraction issue": "coalesce(author_parse_issue, '')", "Metadata author issue": "coalesce(record.author_issue, '')", "Lookup issue": "coalesce(lookup_issue, '')",
    "Review required": f"label <> '{classify.SUFFICIENT}'", "metadata_conflict_count": "conflict_count", "metadata_conflicts": "conflict_names", "route": "route",
    "Is Review": "is_review", "Review Source": "coalesce(review_source, '')", "Review Notes": "coalesce(review_note, '')",
}
#: The routes that need a lookup, and the fields that lookups and searches read; no others are moved for them.
LOOKED_UP = ("arxiv", "doi", "pmid", "pmcid", "ads", "search")
ASKED = (
    "ref_id", "route", "doi", "cited_doi", "inferred_doi", "pmid", "pmcid", "arxiv_id", "ads_id", "title", "year", "authors", "uses_et_al", "first_author", "journal",
)


def looked_up(parsed: DataFrame, works: DataFrame, ads: bool = True, index: DataFrame | None = None) -> DataFrame:
    """Parsed citations that need a lookup, with ``record``, bridge_pmid, match_reason and had_candidate, each by its route.

    All identifiers are looked up in one join with ``index`` (of ``identifiers``; made here if not given). Titles are
    searched for citations without a usable identifier, and (``ads``) in ADS for those that found nothing.
    """
    needed = parsed.filter(F.col("route").isin(*LOOKED_UP))
    found = identifiers.lookup_all(needed, index if index is not None else identifiers.staged_index(works), ads)
    out = needed.drop("record", "bridge_pmid", "match_reason", "had_candidate").join(dealt(found), "ref_id", "left")
    # A search makes an index of its whole catalogue, so it is only made if a citation asks for it.
    asking = needed.filter(F.col("route") == "search")
    if asking.isEmpty():
        out = out.withColumns({"match_reason": F.lit(None).cast("string"), "had_candidate": F.lit(None).cast("boolean")})
    else:
        search = candidates.searched(asking, works).select("ref_id", F.col("record").alias("searched"), "match_reason", "had_candidate")
        out = out.join(dealt(search), "ref_id", "left").withColumn("record", F.coalesce("record", "searched")).drop("searched")
    untold = needed.filter("route = 'arxiv' AND arxiv_id IS NULL")
    if not untold.isEmpty():
        titled = candidates.title_search_unique(untold, works).select("ref_id", F.col("record").alias("unique"))
        out = out.join(dealt(titled), "ref_id", "left").withColumn("record", F.coalesce("record", "unique")).drop("unique")
    # Read more than once: staged, no lookup is planned and made again.
    out = staged(out.withColumn("record", F.coalesce("record", "by_doi")) if ads else out)
    missed = out.filter(candidates.UNFOUND).filter("doi IS NULL").drop("record")
    if ads and not missed.isEmpty():
        found = staged(candidates.title_search_unique(missed, works, "NASA ADS").withColumnRenamed("record", "discovered"))
        out = out.join(dealt(found), "ref_id", "left").withColumn("record", F.coalesce("record", "discovered")).drop("discovered")
    return out.drop("by_doi")


def with_doi_flags(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Where the DOI came from and whether it counts."""
    c = F.col
    derived = F.when((c("route") == "search") & (c("record.source") == "Crossref"), c("record.doi"))
    df = lookup.resolve_doi(df.withColumn("derived_doi", derived), registry)
    flags = lookup.doi_flags()
    physics = F.coalesce(c("record.source").isin(*compare.PHYSICS), F.lit(False))
    listed = F.exists(F.coalesce("record.dois", F.array().cast("array<string>")), lambda d: F.lower(d) == F.lower("doi")) | (F.lower("doi") == F.lower("record.doi"))
    resolved = F.coalesce("resolves", F.lit(False))
    no = F.lit(False)
    by_route = lambda name, other: F.coalesce(F.when(physics, other).when(c("route") == "doi", flags[name]).otherwise(no), no)
    return df.withColumns(
        {
            "doi_explicit_ok": by_route("doi_explicit_ok", listed & resolved),
            "doi_derived_ok": F.coalesce(by_route("doi_derived_ok", no) | (derived.isNotNull() & resolved), no),
            "doi_invalid": by_route("doi_invalid", no),
            "doi_source": F.when(c("cited_doi").isNotNull(), "explicit").when(c("inferred_doi").isNotNull(), "heuristic").when(derived.isNotNull(), "derived"),
        }
    )


def classified(df: DataFrame, lookup_status: DataFrame | None = None) -> DataFrame:
    """Compared rows with score, label, reason and notes.

    ``lookup_status`` (ref_id, http_status) tells which lookups could not be made: "not available" is an
    issue of the lookup, never a mismatch.
    """
    c = F.col
    if lookup_status is not None:
        df = df.join(dealt(lookup_status.select("ref_id", "http_status")), "ref_id", "left")
    down = F.when(~c("http_status").isin(200, 404) & c("record").isNull(), F.concat(F.lit("lookup unavailable: HTTP "), c("http_status").cast("string"))) if "http_status" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("lookup_issue", F.coalesce(down, F.when(~compare.filled(c("record.title")), classify.NO_RECORD)))
    supplied = c("cited_doi").isNotNull() | c("pmid").isNotNull() | c("pmcid").isNotNull() | c("arxiv_id").isNotNull() | c("ads_id").isNotNull()
    trusted = c("pmid").isNotNull() | c("pmcid").isNotNull() | F.coalesce(c("record.source").isin(*compare.PHYSICS), F.lit(False))
    df = df.withColumn("verdict", classify.classify_evidence(c("evidence"), c("strong_identity"), supplied, c("lookup_issue"), c("doi_invalid"), trusted))
    df = df.withColumns({"score": classify.weighted_score(), "label": c("verdict.label"), "reason": c("verdict.reason")}).drop("verdict")
    return df.withColumn("notes", classify.assemble_notes())


def validate_citations(
    citations: DataFrame, works: DataFrame, registry: DataFrame, *, pub_types: DataFrame | None = None, lookup_status: DataFrame | None = None, ads: bool = True
) -> DataFrame:
    """Results of citations (ref_id unique, ref, optionally ref_no and submission_id), one row each, in the columns of ``RESULT``.

    ``works`` is the catalogue, ``registry`` (doi, resolves) the resolver, ``pub_types`` (pmid, pub_types)
    turns the review check on, ``ads`` the last search in ADS. A null reference is an empty one.
    """
    for name, kind in (("ref_no", "int"), ("submission_id", "bigint")):
        if name not in citations.columns:
            citations = citations.withColumn(name, F.lit(None).cast(kind))
    parsed = staged(parse_citations(spread(citations.select("ref_id", "ref_no", "submission_id", "ref"), "ref_id")))
    asked = staged(parsed.filter(F.col("route").isin(*LOOKED_UP)).select(*ASKED))
    found = looked_up(asked, works, ads)
    # The resolver and the publication types are asked with a few fields of the records. Records and other fields meet
    # once, by ref_id, as which they are dealt already.
    brief = F.struct(*[F.col(f"record.{name}") for name in ("source", "doi", "dois", "title")])
    flags = with_doi_flags(found.withColumn("record", F.when(F.col("record").isNotNull(), brief)), registry)
    if pub_types is not None:
        flags = lookup.review_lookup(flags, works, pub_types)
    records = found.drop(*ASKED[1:])
    both = parsed.join(dealt(records), "ref_id").join(dealt(flags.drop(*ASKED[1:], *records.columns[1:])), "ref_id")
    done = classified(compare.with_evidence(compare.compared(both)), lookup_status)
    web = route.web_source_rows(parsed)
    both = done.unionByName(web, allowMissingColumns=True)
    missing = {"is_review": "boolean", "review_source": "string", "review_note": "string"}
    both = both.withColumns({n: F.lit(None).cast(k) for n, k in missing.items() if n not in both.columns})
    return _as_results(both)


def _as_results(df: DataFrame) -> DataFrame:
    kinds = dict(df.selectExpr(*[f"{e} AS `{n}`" for n, e in RESULT.items()]).dtypes)
    known = {"boolean": "false", "int": "0"}
    whole = lambda n, e: f"coalesce({e}, {known[kinds[n]]})" if kinds[n] in known and n != "Ref #" else e
    return df.selectExpr(*[f"{whole(n, e)} AS `{n}`" for n, e in RESULT.items()])
