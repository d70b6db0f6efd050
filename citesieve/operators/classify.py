"""Score, label and notes of a compared citation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compare import filled
from .parse import AI_NOTE
from .route import MANUAL_REVIEW

# Labels and points.
SUFFICIENT = "✅ Sufficient match"
DETAILS = "🟠 Citation details need checking"
MAJOR = "🔴 Major mismatch"
UNVERIFIED = "🟡 Could not verify"
ERROR = "❌ Error"
POINTS = {"doi_explicit_ok": 4, "author_ok": 2, "title_ok": 2, "year_ok": 2, "journal_ok": 1, "volume_ok": 1, "issue_ok": 1, "pages_ok": 1, "shape_ok": 1}
PUBLICATION = ("year", "journal", "volume", "issue", "pages")
NO_RECORD = "lookup completed without a usable matching record"


def weighted_score(flags: dict[str, Column] | None = None) -> Column:
    """Points of the flags that hold, 0 to 15; a DOI that was only derived gives none."""
    flags = flags or {name: F.col(name) for name in POINTS}
    score = F.lit(0)
    for name, points in POINTS.items():
        score = score + F.when(flags[name], points).otherwise(0)
    return score


def _joined(*clauses: Column, sep: str = "; ") -> Column:
    return F.array_join(F.array_compact(F.array(*[F.nullif(c, F.lit("")) for c in clauses])), sep)


def classify_evidence(evidence: Column, strong: Column, supplied: Column, lookup_issue: Column, doi_invalid: Column, trusted_id: Column) -> Column:
    """struct(label, reason) of an evidence map. The first rule that holds decides; see the order of the branches."""
    state = lambda name: F.try_element_at(evidence, F.lit(name))["status"]
    is_ = lambda name, what: F.coalesce(state(name) == what, F.lit(False))
    of = lambda names, what: F.filter(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.try_element_at(evidence, n)["status"] == what, F.lit(False)))
    record_found = filled(F.try_element_at(evidence, F.lit("title"))["metadata"])
    anchored = strong | (supplied & record_found)
    publication, identity = of(PUBLICATION, "conflicting"), of(("authors", "title", "year", "journal"), "conflicting")
    both = is_("authors", "conflicting") & is_("title", "conflicting")
    forgiven = (supplied | trusted_id) & is_("title", "matched") & ~filled(F.try_element_at(evidence, F.lit("journal"))["submitted"])
    unknown = F.filter(of(("authors", "title", "year", "journal", "identifier"), "unknown"), lambda n: ~(forgiven & (n == "journal")))
    unknown_reasons = F.array_join(F.transform(unknown, lambda n: F.concat(n, F.lit(": "), F.try_element_at(evidence, n)["reason"])), "; ")
    names = F.transform(identity, lambda n: F.when(n == "authors", "author list conflicts").otherwise(F.concat(n, F.lit(" mismatch"))))
    differs = F.array_join(F.transform(publication, lambda n: F.concat(n, F.lit(" differs; check citation details"))), "; ")
    out = lambda label, reason: F.struct(F.lit(label).alias("label"), reason.alias("reason"))
    return (
        F.when(anchored & both, out(MAJOR, F.lit("identifier record conflicts with both the submitted author list and title")))
        .when(anchored & (F.size(publication) >= 3), out(MAJOR, F.concat(F.lit("major metadata conflict: "), F.array_join(publication, ", "))))
        .when(anchored & (F.size(publication) >= 2), out(DETAILS, F.concat(F.lit("multiple metadata conflicts: "), F.array_join(publication, ", "))))
        .when(is_("identifier", "conflicting"), out(MAJOR, F.lit("supplied identifiers refer to different records")))
        .when(record_found & (F.size(identity) > 0), out(DETAILS, F.array_join(names, ", ")))
        .when((F.size(unknown) > 0) | doi_invalid, out(UNVERIFIED, _joined(lookup_issue, F.when(doi_invalid, "supplied DOI was not found; source identity requires review"), unknown_reasons)))
        .otherwise(out(SUFFICIENT, _joined(differs, lookup_issue)))
    )


def classify_flags(df: DataFrame) -> DataFrame:
    """``label`` and ``reason`` for rows without field evidence.

    Reads boolean columns year_ok, author_ok, journal_ok, doi_explicit_ok, shape_ok, has_url, had_candidate,
    title_ok, volume_ok, issue_ok, pages_ok, doi_invalid, manual_review, strong_identity, author_conflict,
    trusted_id, and conflicts (array), journal, title, first_author.
    """
    c = F.col
    parts = ("year_ok", "journal_ok", "volume_ok", "issue_ok", "pages_ok")
    any_of = lambda names: F.greatest(*[c(n) for n in names])
    score = weighted_score()
    reasons = _joined(
        F.when(~c("doi_explicit_ok"), "no DOI supplied"),
        *[F.when(~c(f"{n}_ok"), f"{n} mismatch") for n in ("author", "title", "year", "journal", "volume", "issue", "pages")],
        sep=", ",
    )
    listed = lambda sep: F.array_join("conflicts", sep)
    known = F.lit("title and author identify the work, but ")
    title_length = F.coalesce(F.length("title"), F.lit(0))
    formed = c("shape_ok") & c("first_author").isNotNull() & (title_length >= F.when(c("has_url") | c("had_candidate"), 35).otherwise(25))
    journal_or_title = c("journal_ok") | (c("trusted_id") & c("journal").isNull() & c("title_ok"))
    derived = ~c("doi_explicit_ok")
    out = lambda label, reason: F.struct(F.lit(label).alias("label"), reason.alias("reason"))
    verdict = (
        F.when(c("manual_review"), out(MANUAL_REVIEW, F.lit("organisational/report/dataset-style web source with URL")))
        .when(c("doi_invalid") & (any_of((*parts, "author_ok", "title_ok")) | c("shape_ok")), out(DETAILS, F.lit("invalid DOI")))
        .when(c("doi_invalid"), out(MAJOR, F.lit("invalid DOI")))
        .when(c("doi_explicit_ok") & c("author_conflict") & ~c("title_ok"), out(MAJOR, F.lit("DOI resolves but both the submitted author list and title mismatch (check whether the identifier belongs to this citation)")))
        .when(c("doi_explicit_ok") & c("author_conflict"), out(DETAILS, F.lit("DOI resolves but the submitted author list conflicts with trusted metadata")))
        .when(derived & c("strong_identity") & (F.size("conflicts") >= 3), out(MAJOR, F.concat(F.lit("major metadata conflict: "), known, listed(", "), F.lit(" contradict the trusted record"))))
        .when(derived & c("strong_identity") & (F.size("conflicts") == 2), out(DETAILS, F.concat(F.lit("multiple metadata conflicts: "), known, listed(" and "), F.lit(" contradict the trusted record"))))
        .when(c("doi_explicit_ok") & c("title_ok") & any_of(parts), out(SUFFICIENT, F.lit("")))
        .when(derived & c("year_ok") & c("author_ok") & journal_or_title, out(SUFFICIENT, F.lit("")))
        .when(score >= 4, out(DETAILS, reasons))
        .when(formed, out(DETAILS, reasons))
        .otherwise(out(MAJOR, F.when(reasons == "", "failed most checks").otherwise(reasons)))
    )
    return df.withColumn("verdict", verdict).withColumns({"label": c("verdict.label"), "reason": c("verdict.reason"), "score": score}).drop("verdict")


def assemble_notes() -> Column:
    """The reason and the optional clauses after it, in order. Reads classified columns."""
    c = F.col
    authors = F.col("evidence")["authors"]["status"]
    omitted = F.array_join("comparison.omitted_names", ", ")
    no_id = c("doi").isNull() & c("pmid").isNull()
    doubtful = c("label").isin(DETAILS, MAJOR)
    return _joined(
        c("reason"),
        F.when(
            c("comparison.incomplete") & ~c("uses_et_al"),
            F.concat(F.lit("author list incomplete: "), c("comparison.omitted_count").cast("string"), F.lit(" metadata author(s) omitted"), F.when(omitted != "", F.concat(F.lit(" ("), omitted, F.lit(")"))).otherwise("")),
        ),
        F.when(authors == "conflicting", F.array_join("comparison.conflicts", "; ")),
        F.when((authors == "matched") & (F.size("comparison.variant_names") > 0), F.concat(F.lit("minor author spelling variant: "), F.array_join("comparison.variant_names", ", "))),
        F.when(c("doi_invalid"), "DOI not found by Crossref or the resolver"),
        F.when(c("doi").isNotNull() & ~c("doi_explicit_ok") & ~c("doi_derived_ok") & ~c("doi_invalid"), "DOI resolver confirmation unavailable"),
        F.when(c("doi_derived_ok"), "derived DOI used for metadata only; no DOI points awarded"),
        F.when(no_id, c("match_reason")),
        F.when(no_id & c("domain").isNotNull() & c("scholarly_like") & doubtful, "journal-like reference requires review; see comparison evidence"),
        F.when(no_id & c("domain").isNull() & doubtful, "no DOI/PMID/URL present; manual review recommended"),
        F.when(c("ai_url_flag"), AI_NOTE),
        F.when(c("record.source").isin("arXiv", "DataCite (arXiv)", "NASA ADS"), F.concat(F.lit("Checked against "), c("metadata_source"))),
    )


def doi_score() -> Column:
    """2 for a DOI that was given and resolves, -1 for one that the notes call invalid, else 0."""
    c = F.col
    present = filled(c("Extracted DOI")) | filled(c("Crossref DOI"))
    return (
        F.when(c("doi_explicit_ok"), 2).when(c("doi_derived_ok"), 0).when(present & F.coalesce(F.lower("Notes").contains("invalid doi"), F.lit(False)), -1).otherwise(0)
    )


def manual_check_status(label: Column) -> Column:
    return F.when(F.coalesce(label, F.lit("")) == SUFFICIENT, "").otherwise("Manual check required")
