"""One index of all identifiers of a catalogue, and one join that answers every kind of lookup.

The catalogue is read once: each work gives its identifiers as keys, by what kind of lookup may ask for them, and a
key keeps the record that the lookup would return. Kept in buckets, sorted by key, the index is not shuffled by
later joins. Citations send nothing but ref_id and the keys they ask for; what comes back is joined by ref_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import title_key
from ..functions.text import arxiv_stem
from .lookup import as_record, doi_key, first_records, titled_key
from .staging import dealt, staged

#: Asked for only where nothing else was found: an ADS record of the citation's DOI.
DISCOVERED = 99
#: Added to the place of a record whose identifier works of different titles share: it counts where no other answers.
SHARED = 10


def _key(kind: str, value: Column) -> Column:
    """The key of an identifier, null if that is blank."""
    return F.when(value != "", F.concat(F.lit(f"{kind}:"), value))


def _titled(kind: str, value: Column, title: Column) -> Column:
    """The key of an identifier with a title, null if either is blank."""
    return titled_key(_key(f"{kind}+title", value), title)


def work_identifiers(works: DataFrame) -> DataFrame:
    """(key, version, t, record_id, record, pmid): every key of every work; preprints are also known by identifier and title."""
    arxiv = F.lower("arxiv_id")
    both = lambda kind, value: (_key(kind, value), _titled(kind, value, F.col("title")))
    named = F.transform(F.array_distinct(F.coalesce("identifiers", F.array().cast("array<string>"))), lambda i: _key("ads", i))
    keys = (
        F.when(F.col("source") == "Crossref", F.array(_key("doi", doi_key(F.col("doi")))))
        .when((F.col("source") == "PubMed/PMC") & F.col("pmcid").isNull(), F.array(_key("pmid", F.col("pmid"))))
        .when(F.col("source") == "PubMed/PMC", F.array(_key("pmcid", F.upper("pmcid"))))
        .when(F.col("source") == "arXiv", F.array(*both("arxiv", arxiv), *both("stem", arxiv_stem(arxiv))))
        .when(F.col("source") == "DataCite (arXiv)", F.array(*both("datacite", arxiv)))
        .when(F.col("source") == "NASA ADS", named)
    )
    preprint = F.col("source").isin("arXiv", "DataCite (arXiv)")
    held = works.select(keys.alias("keys"), F.when(preprint, arxiv).alias("version"), F.when(preprint, title_key(F.col("title"))).alias("t"), "record_id", as_record().alias("record"), "pmid")
    return held.select(F.explode("keys").alias("key"), "version", "t", "record_id", "record", "pmid").filter("key IS NOT NULL")


def identifier_index(works: DataFrame) -> DataFrame:
    """(key, record, pmid, shared): of the works with a key the one with the smallest record_id; an ADS identifier counts only if one work has it."""
    held = first_records(work_identifiers(works))
    return held.filter(~F.startswith("key", F.lit("ads:")) | (F.col("n") == 1)).drop("n")


def save_index(index: DataFrame, table: str, buckets: int = 200) -> DataFrame:
    """Keep an index as a table, bucketed and sorted by key, in place of any of that name; later runs ``open_index`` it."""
    index.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").mode("overwrite").saveAsTable(table)
    return open_index(index.sparkSession, table)


def open_index(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def staged_index(works: DataFrame) -> DataFrame:
    """An index for one run, in the shared folder, dealt by key."""
    spark = works.sparkSession
    return staged(identifier_index(works).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key"))


def _asked(citations: DataFrame, ads: bool) -> DataFrame:
    """(ref_id, place, key): what each citation asks for by its route; the first place that is answered counts."""
    route = lambda name: F.col("route") == name
    ask = lambda place, key: F.struct(F.lit(place).alias("place"), key.alias("key"))
    plain = F.when(~F.col("arxiv_id").rlike(r"v\d+$"), F.col("arxiv_id"))
    asks = [
        ask(0, F.when(route("doi"), _key("doi", doi_key(F.col("doi")))).when(route("pmid"), _key("pmid", F.col("pmid"))).when(route("pmcid"), _key("pmcid", F.upper("pmcid")))
            .when(route("arxiv"), _key("arxiv", F.col("arxiv_id"))).when(route("ads"), _key("ads", F.lower("ads_id")))),
        ask(2, F.when(route("arxiv"), _key("stem", plain))),
        ask(4, F.when(route("arxiv"), _key("datacite", plain))),
        *[ask(place, F.when(route("arxiv"), _titled(kind, value, F.col("title")))) for place, kind, value in ((-1, "arxiv", F.col("arxiv_id")), (1, "stem", plain), (3, "datacite", plain))],
    ]
    if ads:
        free = ~F.col("route").isin("arxiv", "ads") & F.col("title").isNotNull() & F.col("pmid").isNull() & F.col("pmcid").isNull()
        asks.append(ask(DISCOVERED, F.when(free, _key("ads", F.lower("doi")))))
    return citations.select("ref_id", F.explode(F.array(*asks)).alias("ask")).select("ref_id", "ask.*").filter("key IS NOT NULL")


def lookup_all(citations: DataFrame, index: DataFrame, ads: bool = True) -> DataFrame:
    """(ref_id, record, bridge_pmid, by_doi): what the identifiers of parsed citations find, a row for each citation that finds anything.

    ``record`` follows the route: DOI, PMID, PMCID (with the PMID that the record carries), ADS identifier, or for
    arXiv that very version, without a version asked for any, then DataCite; works of different titles that share an
    identifier are told apart by the citation's title, and if that is none of theirs the first counts. ``by_doi`` is the ADS record of the
    DOI, for citations that may be looked for there.
    """
    met = _asked(citations, ads).join(dealt(index), "key")
    own = F.col("place") < DISCOVERED
    met = met.withColumn("place", F.col("place") + F.when(own & F.col("shared"), SHARED).otherwise(0))
    bridge = F.when(F.startswith("key", F.lit("pmcid:")), F.col("pmid"))
    return met.groupBy("ref_id").agg(
        F.min_by(F.when(own, F.col("record")), F.when(own, F.col("place"))).alias("record"), F.max(bridge).alias("bridge_pmid"), F.min_by(F.when(~own, F.col("record")), F.when(~own, F.col("place"))).alias("by_doi")
    )
