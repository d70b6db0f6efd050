"""Lookups by identifier as equi-joins with the catalogue. Blank identifiers never reach a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import metadata_author_issue, metadata_surnames, review_from_pub_types, review_from_title, title_key
from ..functions.text import arxiv_stem, trimmed_of
from .staging import dealt

#: A record as lookups return it, in one nullable struct. ``search_year`` is what a candidate search compares, if it differs from ``year``.
RECORD = ("source", "record_id", "doi", "dois", "title", "year", "years", "pubdate", "journal", "volume", "issue", "pages", "type", "url", "search_year")


def doi_key(col: Column) -> Column:
    return F.lower(trimmed_of(col, ".,;:)", "right"))


def as_record() -> Column:
    """The record struct of a works row, with comparable surnames and a note on unusable authors."""
    return F.struct(*RECORD, metadata_surnames(F.col("authors")).alias("surnames"), metadata_author_issue(F.col("authors")).alias("author_issue"))


def one_record(works: DataFrame, key: Column) -> DataFrame:
    """(key, record): for each key that is not blank the record with the smallest record_id."""
    keyed = works.withColumn("key", key).filter("key IS NOT NULL AND key <> ''")
    return keyed.groupBy("key").agg(F.min_by(as_record(), F.col("record_id")).alias("record"))


def _joined(citations: DataFrame, key: Column, records: DataFrame) -> DataFrame:
    return citations.drop("record").withColumn("key", key).join(dealt(records), "key", "left").drop("key")


def lookup_doi(citations: DataFrame, works: DataFrame) -> DataFrame:
    """Citations with a doi, and the Crossref record of it, if any, as ``record``."""
    return _joined(citations.filter("doi IS NOT NULL"), doi_key(F.col("doi")), one_record(works.filter("source = 'Crossref'"), doi_key(F.col("doi"))))


def lookup_pmid(citations: DataFrame, works: DataFrame) -> DataFrame:
    return _joined(citations.filter("pmid IS NOT NULL"), F.col("pmid"), one_record(works.filter("source = 'PubMed/PMC' AND pmid IS NOT NULL AND pmcid IS NULL"), F.col("pmid")))


def lookup_pmcid(citations: DataFrame, works: DataFrame) -> DataFrame:
    """Citations with a pmcid, its record, and the PMID that the record carries as ``bridge_pmid``."""
    own = works.filter("source = 'PubMed/PMC' AND pmcid IS NOT NULL").withColumn("key", F.upper("pmcid"))
    records = own.groupBy("key").agg(F.min_by(as_record(), F.col("record_id")).alias("record"), F.min_by("pmid", F.col("record_id")).alias("bridge_pmid"))
    return _joined(citations.drop("bridge_pmid").filter("pmcid IS NOT NULL"), F.upper("pmcid"), records)


def first_records(held: DataFrame) -> DataFrame:
    """(key, n, record, pmid, shared) of ``held`` (key, version, t, record_id, record, pmid): of each key the record with the smallest record_id.

    ``shared``: works of different titles (``t``) have the very identifier (``version``) of that record, so it does not
    tell which of them is meant.
    """
    first = lambda c: F.min_by(c, F.col("record_id")).alias(c)
    shared = F.coalesce(F.min("t") != F.max("t"), F.lit(False)).alias("shared")
    versions = held.repartition("key").groupBy("key", "version").agg(F.count("*").alias("n"), first("record"), first("pmid"), F.min("record_id").alias("record_id"), shared)
    return versions.groupBy("key").agg(F.sum("n").alias("n"), first("record"), first("pmid"), first("shared"))


def titled_key(key: Column, title: Column) -> Column:
    """An identifier with the title of its work, as one key; null without either."""
    return F.concat(key, F.lit(" "), title_key(title))


def _by_preprint(citations: DataFrame, works: DataFrame, asked: Column, held: Column, name: str) -> DataFrame:
    """Citations with ``<name>_titled``, the record of the key and the citation's title, and ``<name>_first``, struct(record, shared) of the key alone."""
    keys = lambda key, title: F.when(key != "", F.array(key, titled_key(key, title)))
    rows = works.select(F.explode(keys(held, F.col("title"))).alias("key"), F.lower("arxiv_id").alias("version"), title_key(F.col("title")).alias("t"), "record_id", as_record().alias("record"), "pmid")
    records = first_records(rows.filter("key IS NOT NULL")).select("key", F.struct("record", "shared").alias("found"))
    title = F.col("title") if "title" in citations.columns else F.lit(None).cast("string")
    for kind, key in (("titled", titled_key(asked, title)), ("first", asked)):
        citations = citations.withColumn("key", key).join(dealt(records.withColumnRenamed("found", f"{name}_{kind}")), "key", "left").drop("key")
    return citations.withColumn(f"{name}_titled", F.col(f"{name}_titled.record"))


def lookup_arxiv(citations: DataFrame, works: DataFrame) -> DataFrame:
    """Citations with an arxiv_id: the record of that very version, or without a version asked for, of any; the first by id.

    Where works of different titles share an identifier, the title decides, and if it is none of theirs there is no record.
    """
    own = works.filter("source = 'arXiv' AND arxiv_id IS NOT NULL")
    asked = citations.drop("record").filter("arxiv_id IS NOT NULL")
    plain = F.when(~F.col("arxiv_id").rlike(r"v\d+$"), F.col("arxiv_id"))
    both = _by_preprint(asked, own, F.col("arxiv_id"), F.lower("arxiv_id"), "exact")
    both = _by_preprint(both, own, plain, arxiv_stem(F.lower("arxiv_id")), "stem")
    sole = lambda name: F.when(~F.col(f"{name}.shared"), F.col(f"{name}.record"))
    record = F.coalesce("exact_titled", sole("exact_first"), "stem_titled", sole("stem_first"))
    return both.withColumn("record", record).drop("exact_titled", "exact_first", "stem_titled", "stem_first")


def lookup_datacite(unmatched: DataFrame, works: DataFrame) -> DataFrame:
    """Of citations that arXiv has no record of, those without a version, with DataCite's record: the one of their title, else the first by id."""
    asked = unmatched.filter("arxiv_id IS NOT NULL AND record IS NULL").filter(~F.col("arxiv_id").rlike(r"v\d+$"))
    both = _by_preprint(asked.drop("record"), works.filter("source = 'DataCite (arXiv)'"), F.col("arxiv_id"), F.lower("arxiv_id"), "own")
    return both.withColumn("record", F.coalesce("own_titled", "own_first.record")).drop("own_titled", "own_first")


def lookup_ads(citations: DataFrame, works: DataFrame, key: Column | None = None) -> DataFrame:
    """Citations with an ads_id (or another key) that is among a record's identifiers; the record must be the only one."""
    asked = (F.lower("ads_id") if key is None else F.lower(key))
    named = works.filter("source = 'NASA ADS'").withColumn("key", F.explode(F.array_distinct("identifiers"))).filter("key <> ''")
    only = named.groupBy("key").agg(F.count("*").alias("n"), F.min_by(as_record(), F.col("record_id")).alias("record")).filter("n = 1").drop("n")
    return _joined(citations.withColumn("asked", asked).filter("asked IS NOT NULL"), F.col("asked"), only).drop("asked")


def resolve_doi(citations: DataFrame, registry: DataFrame) -> DataFrame:
    """``resolves``: true, false, or null where the registry does not know. Rows without a doi stay, with null."""
    known = registry.filter("doi IS NOT NULL").groupBy(doi_key(F.col("doi")).alias("key")).agg(F.max("resolves").alias("resolves"))
    return citations.drop("resolves").withColumn("key", doi_key(F.coalesce("doi", "derived_doi") if "derived_doi" in citations.columns else F.col("doi"))).join(dealt(known), "key", "left").drop("key")


def doi_flags() -> dict[str, Column]:
    """Flags of citations on the DOI route, from record, resolves and cited_doi."""
    hit, cited = F.col("record").isNotNull(), F.col("cited_doi").isNotNull()
    resolved = hit & F.coalesce("resolves", F.lit(False))
    return {
        "doi_explicit_ok": resolved & cited,
        "doi_derived_ok": resolved & ~cited,
        "doi_invalid": ~hit & cited & F.coalesce(~F.col("resolves"), F.lit(False)),
    }


def review_lookup(df: DataFrame, works: DataFrame, pub_types: DataFrame) -> DataFrame:
    """``is_review``, ``review_source``, ``review_note``: by title, or by the publication types of the article's PMID.

    ``pub_types`` is (pmid, pub_types). Titles decide first for DOIs and searches, the types for PMIDs, and
    for PMC identifiers the types where the record carries a PMID, else the title.
    """
    types = pub_types.groupBy(F.col("pmid").alias("asked")).agg(F.min("pub_types").alias("pub_types"))
    by_doi = works.filter("doi IS NOT NULL AND pmid IS NOT NULL").groupBy(doi_key(F.col("doi")).alias("key")).agg(F.min("pmid").alias("doi_pmid"))
    if "bridge_pmid" not in df.columns:
        df = df.withColumn("bridge_pmid", F.lit(None).cast("string"))
    df = df.withColumn("key", doi_key(F.col("doi"))).join(dealt(by_doi), "key", "left").drop("key")
    df = df.withColumn("asked", F.expr("CASE route WHEN 'pmid' THEN pmid WHEN 'pmcid' THEN bridge_pmid WHEN 'doi' THEN doi_pmid END")).join(dealt(types), "asked", "left")
    by_title = review_from_title(F.col("record.title")) | review_from_title(F.col("title"))
    found = review_from_pub_types(F.col("pub_types"))
    known = F.col("pub_types").isNotNull()
    titled = F.col("route").isin("doi", "search") & by_title
    untyped = (F.col("route") == "pmcid") & F.col("asked").isNull() & review_from_title(F.col("title"))
    typed = known & F.col("route").isin("doi", "pmid", "pmcid") & ~titled
    note = F.concat(found["note"], F.when(F.size("pub_types") > 0, F.concat(F.lit("; pubtypes="), F.array_join(F.slice("pub_types", 1, 6), ", "))).otherwise(""))
    source = F.expr("CASE route WHEN 'pmid' THEN 'PubMed publication types' WHEN 'pmcid' THEN 'PubMed publication types (via PMCID)' ELSE 'PubMed publication types (via DOI)' END")
    return df.withColumns(
        {
            "is_review": titled | untyped | (typed & found["is_review"]),
            "review_source": F.when(titled, "Crossref/title heuristic").when(untyped, "Title heuristic (no PMID found)").when(typed & (found["is_review"] | (F.col("route") != "doi")), source),
            "review_note": F.when(titled | untyped, "title pattern matched").when(typed & (found["is_review"] | (F.col("route") != "doi")), note),
        }
    ).drop("asked", "doi_pmid", "pub_types")

