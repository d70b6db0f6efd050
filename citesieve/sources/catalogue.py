"""Readers of submissions and of bibliographic dumps; every catalogue becomes rows of ``WORKS``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import preprint_surname
from ..functions.text import arxiv_stem, extract_arxiv_id, squeezed, stripped

AUTHORS = "array<struct<given:string,family:string,last:string,name:string>>"
#: The columns of a catalogue, by type.
WORKS = {
    "source": "string", "record_id": "string", "doi": "string", "dois": "array<string>", "pmid": "string", "pmcid": "string", "arxiv_id": "string", "bibcode": "string",
    "identifiers": "array<string>", "title": "string", "authors": AUTHORS, "year": "int", "years": "array<string>", "pubdate": "string", "journal": "string", "volume": "string",
    "issue": "string", "pages": "string", "type": "string", "pub_types": "array<string>", "url": "string", "search_year": "int",
}
_DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF = (
    f"struct<DOI:string,title:array<string>,`container-title`:array<string>,issued:{_DATE},`published-print`:{_DATE},created:{_DATE},"
    "author:array<struct<given:string,family:string,name:string>>,volume:string,issue:string,`journal-issue`:struct<issue:string>,page:string,type:string>"
)
SUMMARY = (
    "struct<fulljournalname:string,source:string,pubdate:string,epubdate:string,sortpubdate:string,title:string,authors:array<struct<name:string>>,"
    "volume:string,issue:string,pages:string,elocationid:string,articleids:array<struct<idtype:string,value:string>>>"
)
DATACITE = (
    "struct<data:struct<attributes:struct<doi:string,titles:array<struct<title:string>>,publicationYear:string,"
    "creators:array<struct<name:string,givenName:string,familyName:string>>>>>"
)
ADS = (
    "struct<bibcode:string,identifier:array<string>,doi:array<string>,title:array<string>,author:array<string>,year:string,pub:string,"
    "volume:string,issue:string,page:array<string>,doctype:string>"
)
ATOM_COLUMNS = "id string, title string, published string, updated string, author array<struct<name:string>>"
ATOM = f"struct<{ATOM_COLUMNS}>"


def read_submissions(spark: SparkSession, path: str, id_column: str = "submission_id", text_column: str = "text") -> DataFrame:
    """(submission_id, text): the two columns of a parquet dataset, or one row per text file under a path that is none."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select(F.col(id_column).alias("submission_id"), F.col(text_column).alias("text"))
    lists = spark.read.text(path, wholetext=True)
    return lists.select(F.xxhash64(F.input_file_name()).alias("submission_id"), F.col("value").alias("text"))


def as_works(df: DataFrame) -> DataFrame:
    """All columns of ``WORKS`` in order; those not given are null."""
    given = set(df.columns)
    return df.select(*[(F.col(name) if name in given else F.lit(None)).cast(kind).alias(name) for name, kind in WORKS.items()])


def _filled(*cols: Column) -> Column:
    """The first that is neither null nor empty, without white space around it."""
    return F.coalesce(*[F.nullif(stripped(c), F.lit("")) for c in cols])


def _people(array: Column, **fields: str) -> Column:
    take = lambda a, f: (a[fields[f]] if f in fields else F.lit(None).cast("string")).alias(f)
    return F.transform(array, lambda a: F.struct(*[take(a, f) for f in ("given", "family", "last", "name")]))


def date_year(item: Column, *names: str) -> Column:
    """The first year among date fields of an item, in the order given."""
    return F.coalesce(*[F.get(F.get(item[n]["date-parts"], F.lit(0)), F.lit(0)) for n in names])


def crossref_works(df_json: DataFrame) -> DataFrame:
    """Works from rows (json) that each hold one Crossref item."""
    return _of_items(df_json.select(F.from_json("json", CROSSREF).alias("it")).filter("it IS NOT NULL"))


def read_crossref(spark: SparkSession, path: str, listed: bool = False) -> DataFrame:
    """Works of Crossref dump files: one item a line, or (``listed``) a JSON object a file with its items in a list."""
    if listed:
        held = spark.read.schema(f"items array<{CROSSREF}>").option("multiLine", "true").json(path)
        return _of_items(held.select(F.explode("items").alias("it")).filter("it IS NOT NULL"))
    return crossref_works(spark.read.text(path).select(F.col("value").alias("json")))


def _of_items(items: DataFrame) -> DataFrame:
    it = F.col("it")
    return as_works(
        items.select(
            F.lit("Crossref").alias("source"), it["DOI"].alias("record_id"), it["DOI"].alias("doi"), F.array(it["DOI"]).alias("dois"),
            F.get(it["title"], F.lit(0)).alias("title"), _people(it["author"], given="given", family="family", name="name").alias("authors"),
            date_year(it, "issued", "created").alias("year"), date_year(it, "issued", "published-print", "created").alias("search_year"), F.get(it["container-title"], F.lit(0)).alias("journal"),
            _filled(it["volume"]).alias("volume"), _filled(it["issue"], it["journal-issue"]["issue"]).alias("issue"), _filled(it["page"]).alias("pages"), it["type"].alias("type"),
        )
    )


def pubmed_works(df_json: DataFrame, pmc: bool = False) -> DataFrame:
    """Works from rows (json) of summaries keyed by their uid; the PMC form falls back along more fields and carries a PMID."""
    # The uids list stands in the same object as the summaries, so the values are read as text first.
    held = df_json.select(F.explode(F.from_json("json", "struct<result:map<string,string>>")["result"]).alias("uid", "body")).filter("uid <> 'uids'")
    held = held.select("uid", F.from_json("body", SUMMARY).alias("s")).filter("s IS NOT NULL")
    s = F.col("s")
    common = [
        s["title"].alias("title"), _people(s["authors"], name="name").alias("authors"), _filled(s["volume"]).alias("volume"),
        _filled(s["issue"]).alias("issue"), _filled(s["pages"], s["elocationid"]).alias("pages"),
    ]
    if not pmc:
        return as_works(held.select(F.lit("PubMed/PMC").alias("source"), F.col("uid").alias("record_id"), F.col("uid").alias("pmid"), s["fulljournalname"].alias("journal"), s["pubdate"].alias("pubdate"), *common))
    pmid = F.get(F.filter(s["articleids"], lambda a: F.lower(a["idtype"]) == "pmid"), F.lit(0))["value"]
    pmcid = F.concat(F.lit("PMC"), F.regexp_replace("uid", "(?i)^PMC", ""))
    return as_works(
        held.select(
            F.lit("PubMed/PMC").alias("source"), pmcid.alias("record_id"), pmcid.alias("pmcid"), F.trim(pmid).alias("pmid"), _filled(s["fulljournalname"], s["source"]).alias("journal"),
            _filled(s["pubdate"], s["epubdate"], s["sortpubdate"]).alias("pubdate"), *common,
        )
    )


def arxiv_works(df_xml: DataFrame) -> DataFrame:
    """Works from rows (xml) that each hold one Atom entry; entries without an arXiv identifier are left out."""
    return _of_entries(df_xml.select(F.from_xml(F.col("xml"), ATOM).alias("e")))


def read_arxiv_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Works of Atom feed files, with any number of entries each; large files are split among tasks at their entries."""
    feeds = spark.read.format("xml").option("rowTag", "entry").schema(ATOM_COLUMNS).load(path)
    return _of_entries(feeds.select(F.struct("id", "title", "published", "updated", "author").alias("e")))


def _of_entries(read: DataFrame) -> DataFrame:
    e = F.col("e")
    entries = read.withColumn("arxiv_id", extract_arxiv_id(e["id"])).filter("arxiv_id IS NOT NULL")
    years = F.array_distinct(F.filter(F.array(F.left(e["published"], F.lit(4)), F.left(e["updated"], F.lit(4))), lambda y: y != ""))
    doi = F.concat(F.lit("10.48550/arXiv."), arxiv_stem(F.col("arxiv_id")))
    names = F.transform(e["author"], lambda a: F.struct(F.lit(None).cast("string").alias("given"), preprint_surname(a["name"]).alias("family"), F.lit(None).cast("string").alias("last"), a["name"].alias("name")))
    return as_works(
        entries.select(
            F.lit("arXiv").alias("source"), F.col("arxiv_id").alias("record_id"), "arxiv_id", doi.alias("doi"), F.array(doi).alias("dois"), squeezed(e["title"]).alias("title"),
            names.alias("authors"), F.try_element_at(years, F.lit(1)).cast("int").alias("year"), years.alias("years"), F.lit("arXiv").alias("journal"), F.lit("preprint").alias("type"),
            F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id").alias("url"),
        )
    )


def datacite_works(df_json: DataFrame) -> DataFrame:
    """Works from rows (asked_id, json): DataCite's record of an arXiv identifier, left out if it is of another DOI."""
    a = F.col("r.data.attributes")
    doi = F.concat(F.lit("10.48550/arXiv."), "asked_id")
    own = df_json.select("asked_id", F.from_json("json", DATACITE).alias("r")).filter(F.lower(a["doi"]) == F.lower(doi))
    people = F.transform(
        a["creators"],
        lambda p: F.struct(p["givenName"].alias("given"), F.coalesce(F.nullif(p["familyName"], F.lit("")), preprint_surname(p["name"])).alias("family"), F.lit(None).cast("string").alias("last"), p["name"].alias("name")),
    )
    year = a["publicationYear"]
    return as_works(
        own.select(
            F.lit("DataCite (arXiv)").alias("source"), F.col("asked_id").alias("record_id"), F.col("asked_id").alias("arxiv_id"), doi.alias("doi"), F.array(doi).alias("dois"),
            F.get(a["titles"], F.lit(0))["title"].alias("title"), people.alias("authors"), year.cast("int").alias("year"), F.array(year).alias("years"), F.lit("arXiv").alias("journal"),
            F.lit("preprint").alias("type"), F.concat(F.lit("https://arxiv.org/abs/"), "asked_id").alias("url"),
        )
    )


def ads_works(df_json: DataFrame) -> DataFrame:
    """Works from rows (json) that each hold one ADS document."""
    d = F.col("d")
    docs = df_json.select(F.from_json("json", ADS).alias("d")).filter("d IS NOT NULL")
    none = F.array().cast("array<string>")
    ids = F.transform(F.concat(F.coalesce(d["identifier"], none), F.coalesce(d["doi"], none), F.array(F.coalesce(d["bibcode"], F.lit("")))), F.lower)
    people = F.transform(d["author"], lambda n: F.struct(F.lit(None).cast("string").alias("given"), preprint_surname(n).alias("family"), F.lit(None).cast("string").alias("last"), n.alias("name")))
    return as_works(
        docs.select(
            F.lit("NASA ADS").alias("source"), d["bibcode"].alias("record_id"), d["bibcode"].alias("bibcode"), ids.alias("identifiers"), F.get(d["doi"], F.lit(0)).alias("doi"), d["doi"].alias("dois"),
            F.get(d["title"], F.lit(0)).alias("title"), people.alias("authors"), d["year"].cast("int").alias("year"), F.array(d["year"]).alias("years"), d["pub"].alias("journal"), d["volume"].alias("volume"),
            d["issue"].alias("issue"), F.array_join(d["page"], "-").alias("pages"), F.coalesce(d["doctype"], F.lit("article")).alias("type"),
            F.concat(F.lit("https://ui.adsabs.harvard.edu/abs/"), d["bibcode"], F.lit("/abstract")).alias("url"),
        )
    )


def pubmed_pub_types(df_xml: DataFrame) -> DataFrame:
    """(pmid, pub_types) from rows (xml) that each hold one PubmedArticle."""
    schema = "struct<MedlineCitation:struct<PMID:string,Article:struct<PublicationTypeList:struct<PublicationType:array<string>>>>>"
    c = F.col("r.MedlineCitation")
    types = F.filter(F.transform(c["Article"]["PublicationTypeList"]["PublicationType"], stripped), lambda t: t != "")
    return df_xml.select(F.from_xml(F.col("xml"), schema).alias("r")).select(c["PMID"].alias("pmid"), F.coalesce(types, F.array().cast("array<string>")).alias("pub_types"))
