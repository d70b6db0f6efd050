"""Summaries, queues and views of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import DETAILS, ERROR, MAJOR, SUFFICIENT, UNVERIFIED, doi_score
from .compare import filled
from .route import MANUAL_REVIEW, WEB, WEB_TRUSTED

LABELS = (SUFFICIENT, DETAILS, MAJOR, UNVERIFIED, MANUAL_REVIEW, WEB_TRUSTED, WEB, ERROR)
REVIEW_LABELS = (DETAILS, MAJOR, ERROR, MANUAL_REVIEW, UNVERIFIED)
#: Words in a lowered label that put it in a bucket of the summary.
BUCKETS = {
    "real": "sufficient match|^✅ real$",
    "review": "manual review|web source|could not verify|unable to verify",
    "suspicious": "citation details need checking|suspicious",
    "danger": "major mismatch|possible falsification|error",
}
TONES = {"danger": BUCKETS["danger"], "warning": BUCKETS["suspicious"] + "|manual review", "real": BUCKETS["real"]}
LEADING = ("Ref #", "Validation Result", "Score")
EXPORT_FULL = (
    "Manual review", "AI URL flag", "AL notes", "Extracted Authors", "Metadata Authors", "Author match method", "Author match count", "Submitted author count",
    "Metadata author count", "Reference", "Domain", "Domains", "Source URL", "Validator Version", "Validator SHA256", "Extracted DOI", "DOI Source", "Metadata Source",
    "Metadata Record URL", "Metadata DOI", "Metadata Year", "Metadata Journal", "Source Type", "arXiv ID", "ADS ID", "Crossref DOI", "Crossref Journal", "Crossref Year",
    "PubMed ID", "PubMed Journal", "PubMed Year", "Notes",
)
EXPORT_DEBUG = (
    "doi_explicit_ok", "doi_derived_ok", "year_ok", "author_ok", "journal_ok", "Uses et al.", "First author matches", "Author submitted coverage",
    "Author metadata coverage", "title_ok", "title_similarity", "title_match_confidence", "title_match_method", "strong_identity_match", "vol_ok", "issue_ok",
    "pages_ok", "metadata_conflict_count", "metadata_conflicts", "Comparison evidence", "Lookup issue", "Review required",
)
EXPORT_CONDENSED = ("Manual review", "AL notes", "Notes", "Source URL", "Reference", "Validator Version", "Validator SHA256")
DISPLAY_CONDENSED = ("DOI score", "AI URL flag", "AL notes", "Notes", "Record link", "Source link", "DOI link")
DISPLAY_FULL = (
    "DOI score", "AI URL flag", "AL notes", "Extracted Authors", "Metadata Authors", "Author match method", "Omitted Authors", "Author match count",
    "Submitted author count", "Metadata author count", "Is Review", "Review Source", "Reference", "Domain", "Domains", "Source URL", "Extracted DOI", "DOI Source",
    "Metadata Source", "Metadata Record URL", "Metadata DOI", "Metadata Year", "Metadata Journal", "arXiv ID", "ADS ID", "Crossref DOI", "Crossref Journal",
    "Crossref Year", "PubMed ID", "PubMed Journal", "PubMed Year", "Notes", "Record link", "Source link", "DOI link", "PubMed link",
)
DISPLAY_DEBUG = EXPORT_DEBUG[:9]


def label_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(F.col("Validation Result").alias("Category")).agg(F.count("*").alias("Count")).orderBy(F.desc("Count"), "Category")


def top_domains(results: DataFrame, n: int = 50) -> DataFrame:
    """The n domains with most references; blanks are left out, ties go by name."""
    return results.filter("Domain <> ''").groupBy("Domain").agg(F.count("*").alias("Count")).orderBy(F.desc("Count"), "Domain").limit(n)


def domain_label_matrix(results: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Counts of ``Ref #`` by domain and label, 0 where there are none."""
    return results.filter("Domain <> ''").groupBy("Domain").pivot("Validation Result", list(labels)).agg(F.count("Ref #")).fillna(0)


def issue_rows(results: DataFrame) -> DataFrame:
    """Rows to review: a label that asks for it, or a tracked address."""
    return results.filter(F.col("Validation Result").isin(*REVIEW_LABELS) | F.coalesce("AI URL flag", F.lit(False)))


def in_bucket(bucket: str) -> Column:
    label = F.lower(F.coalesce("Validation Result", F.lit("")))
    return F.lit(True) if bucket == "all" else label.rlike(BUCKETS[bucket])


def summary_buckets(results: DataFrame) -> DataFrame:
    """One row per submission: all, real, review, suspicious and danger counts, and tracked addresses."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return results.groupBy("submission_id").agg(F.count("*").alias("total"), *[count(in_bucket(b)).alias(b) for b in BUCKETS], count(F.col("AI URL flag")).alias("ai_tracking"))


def filter_bucket(results: DataFrame, bucket: str) -> DataFrame:
    """The rows of a bucket (all, real, review, suspicious, danger) with the tone of their label."""
    label = F.lower(F.coalesce("Validation Result", F.lit("")))
    tone = F.coalesce(*[F.when(label.rlike(words), name) for name, words in TONES.items()], F.lit("review"))
    return results.filter(in_bucket(bucket)).withColumn("tone", tone)


def _part_status(matches: Column, submitted: Column, metadata: Column) -> Column:
    return (
        F.when(~filled(submitted) & ~filled(metadata), "Not available").when(~filled(metadata), "Not found").when(~filled(submitted), "Metadata only")
        .when(matches, "Matched").otherwise("Different")
    )


# What the parts of a reference say, as outputs must match.
DOI_MEANINGS = {
    "resolves": "The DOI supplied in the reference resolves.",
    "found": "The DOI was found by the lookup; it did not add points to the score.",
    "unconfirmed": "The supplied DOI could not be confirmed; this alone does not establish fabrication.",
    "none": "No DOI was supplied or recovered.",
}
PART_MEANINGS = {
    "Year": "Letter suffixes such as 2025a use the four-digit year.",
    "Journal": "Common abbreviations and punctuation are normalized.",
    "Volume": "Compared when both records provide a volume.",
    "Issue": "Compared when both records provide an issue.",
    "Pages": "Page ranges and article locators are accepted.",
    "Identifier": "Checked using the cited database identifier.",
}
NO_METHOD, NOT_CHECKED = "No comparison available", "Not checked"


def part_by_part(results: DataFrame) -> DataFrame:
    """One row per reference and field: ref_id, part_no, Part, Submitted reference, Trusted record, Status, What this means.

    Evidence, where a row has it, overrides the status and its meaning. Preprint and ADS references have an
    Identifier row before the others.
    """
    c = F.col
    first = lambda *names: F.coalesce(*[F.nullif(c(n), F.lit("")) for n in names])
    shown = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("—"))
    doi, record_doi = first("Extracted DOI"), first("Metadata DOI", "Crossref DOI")
    doi_status = F.when(c("doi_explicit_ok"), "Matched").when(c("doi_derived_ok"), "Metadata only").when(doi.isNotNull(), "Not verified").otherwise("Not found")
    doi_meaning = (
        F.when(c("doi_explicit_ok"), DOI_MEANINGS["resolves"]).when(c("doi_derived_ok"), DOI_MEANINGS["found"])
        .when(doi.isNotNull(), DOI_MEANINGS["unconfirmed"]).otherwise(DOI_MEANINGS["none"])
    )
    number = lambda n: F.coalesce(c(n), F.lit(0)).cast("string")
    authors_meaning = F.concat(number("Author match count"), F.lit(" of "), number("Submitted author count"), F.lit(" named authors matched. Method: "), F.coalesce(first("Author match method"), F.lit(NO_METHOD)), F.lit("."))
    confidence = F.coalesce(F.format_string("%.3f", "title_match_confidence"), F.lit("—"))
    title_meaning = F.concat(F.lit("Method: "), F.coalesce("title_match_method", F.lit(NOT_CHECKED)), F.lit(". Confidence: "), confidence, F.lit("."))
    meaning_of = lambda name: F.lit(PART_MEANINGS[name])
    parts = [
        ("DOI", doi, record_doi, doi_status, doi_meaning),
        ("Authors", c("Extracted Authors"), c("Metadata Authors"), c("author_ok"), authors_meaning),
        ("Year", c("Extracted Year"), first("Metadata Year", "Crossref Year", "PubMed Year"), c("year_ok"), meaning_of("Year")),
        ("Title", c("Extracted Title"), c("Metadata Title"), c("title_ok"), title_meaning),
        ("Journal", c("Extracted Journal"), first("Metadata Journal", "Crossref Journal", "PubMed Journal"), c("journal_ok"), meaning_of("Journal")),
        ("Volume", c("Extracted Volume"), c("Metadata Volume"), c("vol_ok"), meaning_of("Volume")),
        ("Issue", c("Extracted Issue"), c("Metadata Issue"), c("issue_ok"), meaning_of("Issue")),
        ("Pages", c("Extracted Pages"), c("Metadata Pages"), c("pages_ok"), meaning_of("Pages")),
    ]
    cited = first("arXiv ID", "ADS ID")
    identifier = F.when(cited.isNotNull(), _part(0, "Identifier", cited, c("Metadata Record URL"), F.lit("Not verified"), meaning_of("Identifier"), shown))
    rows = [identifier]
    for k, (name, submitted, metadata, status, meaning) in enumerate(parts, 1):
        status = status if name == "DOI" else _part_status(status, submitted, metadata)
        rows.append(_part(k, name, submitted, metadata, status, meaning, shown))
    return results.select("ref_id", F.explode(F.array_compact(F.array(*rows))).alias("p")).select("ref_id", "p.*")


def _part(k, name, submitted, metadata, status, meaning, shown) -> Column:
    own = F.try_element_at("Comparison evidence", F.lit(name.lower()))
    said = F.when(own["status"] == "matched", "Matched").when(own["status"] == "conflicting", "Different").when(own["status"] == "unknown", "Not verified")
    return F.struct(
        F.lit(k).alias("part_no"), F.lit(name).alias("Part"), shown(submitted).alias("Submitted reference"), shown(metadata).alias("Trusted record"),
        F.coalesce(said, status).alias("Status"), F.coalesce(own["reason"], meaning).alias("What this means"),
    )


def record_links(results: DataFrame) -> DataFrame:
    """Results with ``Record link`` (only where a record was retrieved), ``DOI link``, ``PubMed link`` and ``Source link``; "" without one."""
    c = F.col
    tidy = lambda d: F.regexp_replace(F.trim(d), r"[.,;:)]+$", "")
    pathed = lambda d: F.replace(F.replace(F.url_encode(tidy(d)), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    record_doi, pubmed = F.coalesce(F.nullif("Metadata DOI", F.lit("")), F.nullif("Crossref DOI", F.lit(""))), F.trim(F.coalesce("PubMed ID", F.lit("")))
    from_pubmed = c("Metadata Source") == "PubMed/PMC"
    doi = F.coalesce(F.nullif("Extracted DOI", F.lit("")), F.nullif("Crossref DOI", F.lit("")))
    record = (
        F.when(c("Metadata Record URL").rlike("^https?:"), c("Metadata Record URL"))
        .when((c("Metadata Source") == "Crossref") & record_doi.isNotNull(), F.concat(F.lit("https://doi.org/"), pathed(record_doi)))
        .when(from_pubmed & pubmed.rlike(r"^\d+$"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pubmed, F.lit("/")))
        .when(from_pubmed & pubmed.rlike(r"(?i)^PMC\d+$"), F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), F.upper(pubmed), F.lit("/")))
        .otherwise("")
    )
    return results.withColumns(
        {
            "Record link": record,
            "DOI link": F.coalesce(F.concat(F.lit("https://doi.org/"), tidy(doi)), F.lit("")),
            "PubMed link": F.when(pubmed.rlike("(?i)^PMC"), F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), pubmed, F.lit("/")))
            .when(pubmed.rlike(r"^\d+$"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pubmed, F.lit("/"))).otherwise(""),
            "Source link": F.trim(F.coalesce("Source URL", F.lit(""))),
        }
    )


def with_doi_score(results: DataFrame) -> DataFrame:
    return results.withColumn("DOI score", doi_score())


def result_view(results: DataFrame, view: str = "full", review: bool = False, debug: bool = False, export: bool = False) -> DataFrame:
    """An ordered choice of columns. For display, missing columns are added empty; for export they are left out.

    Null text is shown as an empty one.
    """
    results = with_doi_score(results)
    if export:
        reviewed = ("Is Review", "Review Source", "Review Notes") if review else ()
        wanted = [*LEADING, "DOI score", "AI URL flag", *reviewed[:1], *EXPORT_CONDENSED] if view == "condensed" else [*LEADING, *reviewed, *EXPORT_FULL, *(EXPORT_DEBUG if debug else ())]
        own = [n for n in ("Manual review", "AL notes", "Source URL") if n not in results.columns]
        results = results.withColumns({n: F.lit("") for n in own})
        return results.select(*[F.col(f"`{n}`") for n in wanted if n in results.columns])
    results = record_links(results)
    if view == "condensed":
        wanted = [*LEADING, *(("Is Review",) if review else ()), *DISPLAY_CONDENSED]
    else:
        wanted = [*LEADING, *(n for n in DISPLAY_FULL if review or n not in ("Is Review", "Review Source")), *(DISPLAY_DEBUG if debug else ())]
    return results.select(*[(F.col(f"`{n}`") if n in results.columns else F.lit("")).alias(n) for n in wanted])


def row_text(results: DataFrame, *left_out: str) -> Column:
    """All values of a row in one string, by column name, each with its length before it, null as a dash; lists and structs as JSON."""
    kinds = {f.name: f.dataType.typeName() for f in results.schema.fields}
    plain = lambda n: F.to_json(F.col(f"`{n}`")) if kinds[n] in ("array", "map", "struct", "variant") else F.col(f"`{n}`").cast("string")
    said = lambda v: F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.concat(F.lit(""), *[said(plain(n)) for n in sorted(results.columns) if n not in left_out])


def results_signature(results: DataFrame) -> DataFrame:
    """(submission_id, signature): changes if and only if the submission's results do, whatever their order.

    The 128-bit hash of each row is added up in four parts of 32 bits, with the number of rows: sums of any parts of a
    submission can be added, so no list of its rows is made, however many they are. Repeated rows count as
    often as they come. Rows without submission_id are one submission.
    """
    hashed = results.select("submission_id", F.md5(row_text(results, "submission_id").cast("binary")).alias("hash"))
    sums = [F.sum(F.conv(F.substring("hash", at, 8), 16, 10).cast("bigint")).cast("string") for at in (1, 9, 17, 25)]
    return hashed.groupBy("submission_id").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("signature"))
