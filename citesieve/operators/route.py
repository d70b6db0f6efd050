"""Which lookup a reference takes, and the rows that need none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
TRUSTED_BASES = (
    "who.int", "un.org", "unicef.org", "worldbank.org", "oecd.org",
    "cdc.gov", "nih.gov", "ncbi.nlm.nih.gov", "epa.gov", "data.gov",
    "gov.uk", "nhs.uk", "digital.nhs.uk", "ukhsa.gov.uk",
    "europa.eu", "ecdc.europa.eu",
    "openstax.org", "open.edu", "coursera.org", "edx.org",
    "ukbiobank.ac.uk",
    "unaids.org", "saude.gov.br", "bvsms.saude.gov.br",
)
ORGANISATION_HINTS = (
    "world health organization", "who", "unaids", "ministry", "department",
    "government", "gov", "national", "programme", "program", "report",
    "reports", "repository", "data repository", "dataset", "data",
    "fact sheet", "statistics", "observatory", "health observatory",
    "agency", "organisation", "organization", "office for", "nhs", "ukhsa",
)
MANUAL_REVIEW = "🟡 Manual review — web source"
WEB_TRUSTED, WEB = "📄 Web Source (trusted)", "📄 Web Source"
MANUAL_NOTE = "URL detected; organisational/report/dataset-style source; manual review recommended"
WEB_NOTE = "URL detected; treated as non-academic web source"


def trusted_domain(domain: Column) -> Column:
    """A listed domain or one below it."""
    d = F.lower(domain)
    return F.coalesce(d.isin(*TRUSTED_BASES) | d.rlike(r"\.(?:" + "|".join(b.replace(".", r"\.") for b in TRUSTED_BASES) + ")$"), F.lit(False))


def hint_hit(ref: Column) -> Column:
    return F.coalesce(F.lower(ref).rlike("|".join(ORGANISATION_HINTS)), F.lit(False))


def org_web_source(ref: Column) -> Column:
    """An address of an organisation, without identifier and without the details of a journal article. Reads parsed columns."""
    c = F.col
    structured = c("journal").isNotNull() & (c("volume").isNotNull() | c("issue").isNotNull() | c("pages").isNotNull() | c("shape_ok"))
    identified = c("cited_doi").isNotNull() | c("pmid").isNotNull() | c("pmcid").isNotNull()
    return F.coalesce((F.size("urls") > 0) & ~identified & (hint_hit(ref) | c("trusted_web")) & ~structured, F.lit(False))


def route_of() -> Column:
    """manual_review, web, arxiv, ads, doi, pmid, pmcid or search. Reads parsed columns."""
    c = F.col
    arxiv = c("arxiv_id").isNotNull() | F.coalesce(c("journal").rlike(r"(?iU)\barxiv\b"), F.lit(False))
    physics = arxiv | c("ads_id").isNotNull()
    plain_web = ~physics & c("doi").isNull() & c("pmid").isNull() & c("pmcid").isNull() & c("domain").isNotNull() & ~c("scholarly_like")
    return (
        F.when(c("org_web") & ~physics, "manual_review").when(plain_web, "web").when(arxiv, "arxiv").when(c("ads_id").isNotNull(), "ads")
        .when(c("doi").isNotNull(), "doi").when(c("pmid").isNotNull(), "pmid").when(c("pmcid").isNotNull(), "pmcid").otherwise("search")
    )


def web_source_rows(parsed: DataFrame) -> DataFrame:
    """The rows that stop before any lookup: label, notes, score 0."""
    manual = F.col("route") == "manual_review"
    return parsed.filter(F.col("route").isin("manual_review", "web")).withColumns(
        {
            "label": F.when(manual, MANUAL_REVIEW).when(F.col("trusted_web"), WEB_TRUSTED).otherwise(WEB),
            "notes": F.when(manual, MANUAL_NOTE).otherwise(WEB_NOTE), "score": F.lit(0),
            "year_ok": F.col("year_token").isNotNull(), "author_ok": F.col("first_author").isNotNull(),
        }
    )
