"""Field-by-field comparison of a parsed citation with the record it was looked up to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import helpers
from ..functions.normalize import journal_key, pubdate_year, title_distinctive
from ..functions.text import arxiv_stem, extract_arxiv_id, let, nonblank, year_value

FIELDS = ("authors", "title", "year", "journal", "volume", "issue", "pages")
#: What the comparison of each field reads of a parsed citation.
READ = {
    "authors": ("authors", "uses_et_al"), "title": ("title", "ref_clean", "year"), "year": ("year",), "journal": ("journal",),
    "volume": ("volume",), "issue": ("issue",), "pages": ("pages", "page_start", "page_end"),
}
PHYSICS = ("arXiv", "DataCite (arXiv)", "NASA ADS")


def filled(col: Column) -> Column:
    return F.coalesce(col != "", F.lit(False))


def journals_match(a: Column, b: Column) -> Column:
    """Of two journal keys one contains the other, or their ratio is above 0.6 (the record's, ``b``, first)."""
    return same_journal(a, b, helpers.text_ratio(b, a))


def same_journal(a: Column, b: Column, ratio: Column) -> Column:
    return F.coalesce(filled(a) & filled(b) & (a.contains(b) | b.contains(a) | (ratio > 0.6)), F.lit(False))


def match_title(title: Column, metadata: Column, reference: Column, threshold: Column | float) -> Column:
    """struct(ok, similarity, method, confidence): by ratio, else by one distinctive title within the other or the reference."""
    return matched_title(title, metadata, helpers.title_similarity(title, metadata), *(F.coalesce(helpers.normalize_title(c), F.lit("")) for c in (title, metadata, reference)), threshold)


def matched_title(title: Column, metadata: Column, similarity: Column, a: Column, b: Column, whole: Column, threshold: Column | float) -> Column:
    """As ``match_title``, from the similarity and the normal forms of title, metadata title and reference."""
    direct = filled(title) & filled(metadata) & (similarity >= threshold)
    part = F.length(a) / F.greatest(F.length(b), F.lit(1))
    is_ = lambda ok, method, confidence: F.struct(F.lit(ok).alias("ok"), similarity.alias("similarity"), F.lit(method).alias("method"), confidence.alias("confidence"))
    return (
        F.when(direct, is_(True, "extracted-title similarity", similarity))
        .when(title_distinctive(b) & a.contains(b), is_(True, "metadata title found in extracted title", F.lit(1.0)))
        .when(title_distinctive(b) & whole.contains(b), is_(True, "metadata title found in full reference", F.lit(1.0)))
        .when(title_distinctive(a) & b.contains(a) & (part >= 0.60), is_(True, "extracted title found in metadata title", F.greatest(F.lit(0.90), part)))
        .otherwise(is_(False, "no title match", similarity))
    )


def pages_match(start: Column, end: Column, metadata: Column) -> Column:
    """Equal first pages or overlapping ranges; locators that are no numbers are compared as text."""
    parts = F.transform(F.split(metadata, r"(?U)[-–]\s*"), lambda p: F.trim(p))
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    number = lambda c: F.trim(c).try_cast("long")
    first, last = F.when(first != "", first), F.when(last != "", last)
    readable = lambda c: ~filled(c) | number(c).isNotNull()
    a, b, c, d = number(start), F.coalesce(number(end), number(start)), number(first), F.coalesce(number(last), number(first))
    numeric = readable(start) & readable(end) & readable(first) & readable(last)
    span = F.concat_ws("-", F.nullif(start, F.lit("")), F.nullif(end, F.lit("")))
    text = (filled(start) & (start == first)) | (filled(span) & metadata.contains(span))
    some = (filled(start) | filled(end)) & (filled(first) | filled(last))
    return F.coalesce(some & F.when(numeric, (a == c) | ~((b < c) | (d < a))).otherwise(text), F.lit(False))


def equal_text(a: Column, b: Column) -> Column:
    return F.coalesce(filled(a) & filled(b) & (a == b), F.lit(False))


def record_year() -> Column:
    """The record's year as number: from its list of years for preprints, its publication date for PubMed, else its year."""
    return F.coalesce(F.when(F.col("record.source") == "PubMed/PMC", pubdate_year(F.col("record.pubdate"))), F.when(F.col("record.source").isin(*PHYSICS), year_value(F.array_join("record.years", ", "))), F.col("record.year"))


def year_match() -> Column:
    """Within 1 year up to 1990, 2 after it, for Crossref; the same year for PubMed; one of the years for preprints."""
    own = F.col("year")
    ok = (
        F.when(F.col("record.source") == "PubMed/PMC", own == pubdate_year(F.col("record.pubdate")))
        .when(F.col("record.source").isin(*PHYSICS), F.array_contains("record.years", own.cast("string")))
        .otherwise(F.abs(F.col("record.year") - own) <= F.when(own <= 1990, 1).otherwise(2))
    )
    return F.coalesce(ok, F.lit(False))


def title_threshold() -> Column:
    return F.when((F.col("record.source") == "Crossref") & (F.col("year") <= 1990), 0.78).otherwise(0.75)


def compared(df: DataFrame, which: Sequence[str] = FIELDS) -> DataFrame:
    """Parsed citations with ``record`` (or null): every comparison of the fields ``which`` as a column. No shuffle."""
    c = F.col
    surnames = F.coalesce("record.surnames", F.array().cast("array<string>"))
    found = c("record").isNotNull()
    titles = {n: F.coalesce(helpers.normalize_title(c(x)), F.lit("")) for n, x in (("title_a", "title"), ("title_b", "record.title"), ("title_ref", "ref_clean"))}
    helped = {
        "authors": {"comparison": helpers.compare_authors(c("authors"), surnames, c("uses_et_al"))},
        "title": {"similarity": helpers.title_similarity(c("title"), c("record.title")), **titles},
        "journal": {"journal_issue": helpers.journal_abbreviation_issue(c("journal"), c("record.journal")), "journal_ratio": helpers.text_ratio(c("record_journal"), c("own_journal"))},
    }
    if "journal" in which:
        df = df.withColumns({"own_journal": journal_key(c("journal")), "record_journal": journal_key(c("record.journal"))})
    df = df.withColumns({n: e for name in which for n, e in helped.get(name, {}).items()})
    if "title" in which:
        df = df.withColumn("title_match", matched_title(c("title"), c("record.title"), c("similarity"), c("title_a"), c("title_b"), c("title_ref"), title_threshold()))
    if "journal" in which:
        df = df.withColumn("journal_ok", same_journal(c("own_journal"), c("record_journal"), c("journal_ratio")))
    df = df.drop("similarity", "title_a", "title_b", "title_ref", "journal_ratio", "own_journal", "record_journal")
    done = {
        "authors": {"author_list_ok": found & c("comparison.ok")}, "title": {"title_ok": found & c("title_match.ok")},
        "year": {"year_ok": found & year_match(), "record_year": record_year()},
        "volume": {"volume_ok": equal_text(c("volume"), c("record.volume"))}, "issue": {"issue_ok": equal_text(c("issue"), c("record.issue"))},
        "pages": {"pages_ok": pages_match(c("page_start"), c("page_end"), c("record.pages"))},
    }
    source = F.when(found, F.concat_ws(" ", "record.source", F.coalesce("record.doi", "record.record_id"))).otherwise("bibliographic lookup")
    return df.withColumns({n: e for name in which for n, e in done.get(name, {}).items()} | {"metadata_source": source})


def evidence(submitted: Column, metadata: Column, matches: Column, issue: Column | None = None) -> Column:
    """struct(status, reason, submitted, metadata, source) of one field."""
    issue = F.lit(None).cast("string") if issue is None else issue
    given = F.struct(nonblank(submitted).alias("submitted"), nonblank(metadata).alias("metadata"), issue.alias("issue"))
    return let(given, lambda g: _evidence(g["submitted"], g["metadata"], matches, g["issue"]))


def _evidence(submitted: Column, metadata: Column, matches: Column, issue: Column) -> Column:
    status = F.when(issue.isNotNull(), "unknown").when(matches, "matched").when(submitted.isNull() | metadata.isNull(), "unknown").otherwise("conflicting")
    reason = (
        F.when(issue.isNotNull(), issue).when(matches, "comparison matched").when(submitted.isNull(), "submitted value not extracted or absent")
        .when(metadata.isNull(), "metadata unavailable").otherwise("supplied value differs from the retrieved record")
    )
    return F.struct(status.alias("status"), reason.alias("reason"), submitted.alias("submitted"), metadata.alias("metadata"), F.col("metadata_source").alias("source"))


def field_evidence() -> Column:
    """The map of the seven fields, read from compared columns."""
    c = F.col
    text = lambda x: x.cast("string")
    journal_issue = F.when(~c("journal_ok"), c("journal_issue"))
    years = F.when(c("record.source").isin(*PHYSICS), F.array_join("record.years", ", ")).otherwise(text(c("record_year")))
    of = {
        "authors": evidence(F.array_join("authors", ", "), F.array_join("record.surnames", ", "), c("author_list_ok"), F.coalesce("author_parse_issue", "record.author_issue")),
        "title": evidence(c("title"), c("record.title"), c("title_ok")),
        "year": evidence(text(c("year")), years, c("year_ok")),
        "journal": evidence(c("journal"), c("record.journal"), c("journal_ok"), journal_issue),
        "volume": evidence(c("volume"), c("record.volume"), c("volume_ok")),
        "issue": evidence(c("issue"), c("record.issue"), c("issue_ok")),
        "pages": evidence(c("pages"), c("record.pages"), c("pages_ok")),
    }
    return F.create_map(*[x for name in FIELDS for x in (F.lit(name), of[name])])


def identifier_evidence() -> Column:
    """A map with the ``identifier`` of a preprint or ADS record, or an empty one."""
    c = F.col
    listed = F.exists(F.coalesce("record.dois", F.array().cast("array<string>")), lambda d: F.lower(d) == F.lower("doi"))
    record_doi = F.when(listed, c("doi")).otherwise(c("record.doi"))
    same = F.coalesce(F.lower("doi") == F.lower(record_doi), F.lit(False))
    cited = extract_arxiv_id(c("doi"))
    other = F.coalesce(cited != arxiv_stem(c("record.record_id")), F.lit(False))
    issue = F.when(~other & ~same, "supplied DOI is not verified by this record")
    by_doi = evidence(c("doi"), record_doi, same, issue)
    by_id = evidence(F.coalesce("arxiv_id", "ads_id"), c("record.record_id"), F.lit(True))
    physics = F.coalesce(c("record.source").isin(*PHYSICS), F.lit(False))
    empty = F.map_filter(F.create_map(F.lit("identifier"), by_id), lambda k, v: F.lit(False))
    return F.when(physics & c("doi").isNotNull(), F.create_map(F.lit("identifier"), by_doi)).when(physics & F.coalesce("arxiv_id", "ads_id").isNotNull(), F.create_map(F.lit("identifier"), by_id)).otherwise(empty)


def with_evidence(df: DataFrame) -> DataFrame:
    """Compared citations with the evidence map and what follows from it."""
    df = df.withColumn("evidence", F.map_concat(field_evidence(), identifier_evidence()))
    status = F.col("evidence")["authors"]["status"]
    df = df.withColumns({"author_ok": F.col("author_list_ok") & (status != "unknown"), "conflicts": conflict_list(F.col("evidence"))})
    strong = F.col("author_ok") & filled(F.col("record.title")) & F.col("title_ok") & (F.col("title_match.confidence") >= 0.90)
    return df.withColumns({"strong_identity": F.coalesce(strong, F.lit(False)), "conflict_count": F.size("conflicts"), "conflict_names": F.array_join("conflicts", ", ")})


def conflict_list(evidence_map: Column) -> Column:
    """The fields in conflict, except the title, in field order."""
    names = F.array(*[F.lit(f) for f in (*FIELDS, "identifier") if f != "title"])
    return F.filter(names, lambda n: F.coalesce(F.try_element_at(evidence_map, n)["status"] == "conflicting", F.lit(False)))


def confirmed_conflicts(checks: Column) -> Column:
    """Names of array<struct<field, submitted, metadata, matches>> that both sides give and that do not match."""
    return F.transform(F.filter(checks, lambda x: x["submitted"] & x["metadata"] & ~x["matches"]), lambda x: x["field"])
