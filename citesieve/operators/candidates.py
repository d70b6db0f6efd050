"""Candidate search for citations without a usable identifier, by an inverted index, and the choice of the best.

The author key loses no list that agrees: their first surnames are equal, or of one length with equal first three and
last two letters. Of titles every word and every pair of neighbours counts, however short or common. The rank is the
sum of the idf of all shared keys, ties by source and record_id, and is exact; a title without one whole word in
common is only met by its author. Any accepted candidate needs a year within the tolerance, so no others are met.

A key that few works have (``RARE_WORKS``) is visited work by work, and what meets there is scored in full. Of the works
that share only common title keys, those of one year with the same such keys, their *shape*, have one score: of a shape's works
in a year the first k will do, and citations with the same year and shape are searched once. A common author key is the
third route: works of one year, shape and author are a class too, posted under the author with each of the shape's keys.
A work that has more in common than its route counts is met by the other routes as well, where it scores higher; its
score counts once, the highest. A work that belongs to the first k has less than k works of its class before it, so none is lost.
Thus lists of common keys grow with the number of shapes and not with the works, and a citation visits few of them: keys
are visited rarest first, and the k-th best score found so far is a threshold that ends the visits when the keys to come weigh less.

A bonus for the same journal is a second search, among the works of the citation's journal alone: a work that gets no
bonus is among the first k only if it is among the first k without any, whose k-th score is the threshold of the second search.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import helpers
from ..functions.normalize import journal_key, metadata_surnames, normalize_journal
from ..functions.text import squeezed
from .compare import same_journal
from .lookup import as_record
from .staging import dealt, spread, staged

#: Weights of keys of more than this share of the works (and this many) are broadcast, so that no join is dealt by them.
COMMON_SHARE, LEAST_COMMON = 0.005, 20.0
#: Citations that may be looked for in ADS.
UNFOUND = "record IS NULL AND title IS NOT NULL AND pmid IS NULL AND pmcid IS NULL AND route NOT IN ('arxiv', 'ads')"
#: In the first round of a search by shapes keys are visited while the works of all keys so far are at most so many.
FIRST_POSTINGS = 100
#: A key of at most so many works is rare: all its works are met.
RARE_WORKS = 200
#: The name that the free and the fielded search ask for, and the bonus of the same journal.
FREE, FIELDED = ("first_author", 0.0), ("substring_index(first_author, ' ', 1)", 1.0)


def author_key(name: Column) -> Column:
    """The blocking key of a folded surname."""
    long = F.concat(F.left(name, F.lit(3)), F.right(name, F.lit(2)), F.length(name).cast("string"))
    return F.concat(F.lit("a:"), F.when(F.length(name) < 8, name).otherwise(long))


def surname_keys(name: Column) -> Column:
    """Blocking keys of a folded surname: surnames that are the same (``helpers.same_surname``) have one in common.

    Long ones differ in one letter between the first three and the last two at most, so one half of these letters is equal.
    """
    size, head = F.length(name), surname_head(name)
    whole = F.concat(F.lit("1:"), head, F.lit(":"), F.right(name, F.lit(2)), size.cast("string"))
    other = F.concat(F.lit("2:"), F.left(name, F.lit(3)), F.lit(":"), F.right(name, size - F.length(head)), size.cast("string"))
    return F.when(size < 8, F.array(name)).otherwise(F.array(whole, other))


def surname_head(name: Column) -> Column:
    """The first three letters of a long surname and the first half of those before its last two."""
    return F.left(name, F.floor((F.length(name) + 1) / 2).cast("int"))


def year_tolerance(year: Column) -> Column:
    return F.when(year <= 1990, 1).otherwise(2)


def _title_words(title: Column) -> Column:
    """Every word, and every two that follow each other, with the title's ends as words."""
    ends = F.split(F.concat(F.lit("^ "), title, F.lit(" $")), " ")
    pairs = F.zip_with(F.slice(ends, F.lit(1), F.size(ends) - 1), F.slice(ends, F.lit(2), F.size(ends) - 1), lambda a, b: F.concat(F.lit("p:"), a, F.lit(" "), b))
    keys = F.concat(F.transform(F.split(title, " "), lambda w: F.concat(F.lit("t:"), w)), pairs)
    return F.when(title != "", F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def _coded(keys: Column) -> Column:
    """Keys as 64-bit hashes."""
    return F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))


def _author_code(name: Column) -> Column:
    return F.when(name != "", F.xxhash64(author_key(name)))


def work_keys(works: DataFrame) -> DataFrame:
    """(work, record_id, source, year, journal_key, author, keys): the keys of every work that has one, that of its author among them."""
    named = works.select("record_id", "source", F.coalesce("search_year", "year").alias("year"), normalize_journal(F.col("journal")).alias("journal_key"), helpers.normalize_title("title").alias("t"), helpers.normalize_authors(metadata_surnames(F.col("authors"))).alias("names"))
    keys = F.concat(_title_words(F.coalesce("t", F.lit(""))), F.when(F.size("names") > 0, F.array(author_key(F.get("names", F.lit(0))))).otherwise(F.array().cast("array<string>")))
    author = F.when(F.size("names") > 0, F.xxhash64(author_key(F.get("names", F.lit(0)))))
    return named.select(F.monotonically_increasing_id().alias("work"), "record_id", "source", "year", "journal_key", author.alias("author"), _coded(keys).alias("keys")).filter("size(keys) > 0")


def key_weights(keys: DataFrame) -> DataFrame:
    """(key, df, idf, common) of all keys."""
    total = F.lit(float(max(1, keys.select("source", "record_id").distinct().count())))
    counted = keys.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("df"))
    return counted.select("key", "df", F.log(total / F.col("df") + 1).alias("idf"), (F.col("df") > F.greatest(total * COMMON_SHARE, F.lit(LEAST_COMMON))).alias("common"))


def search_index(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All Crossref works with their rare keys, shape and common author, and the keys' weights, staged; every search over these works can share them."""
    keys = staged(work_keys(spread(works.filter("source = 'Crossref'"), "record_id")))
    weights = staged(key_weights(keys))
    single = _known(keys.select("work", "author", F.explode("keys").alias("key")), weights)
    rare, own = F.col("df") <= RARE_WORKS, F.coalesce(F.col("key") == F.col("author"), F.lit(False))
    parts = single.groupBy("work").agg(
        F.collect_list(F.when(rare, F.col("key"))).alias("rare"), F.sort_array(F.collect_list(F.when(~rare & ~own, F.col("key")))).alias("shape"), F.max(F.when(~rare & own, F.col("key"))).alias("author")
    )
    return staged(keys.drop("author").join(dealt(parts), "work")), weights


def _known(single: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows with a ``key`` that works have, and its weight."""
    return single.join(F.broadcast(weights.filter("common")), "key").unionByName(single.join(dealt(weights.filter("NOT common")), "key"))


def _weighed(asked: DataFrame, weights: DataFrame) -> DataFrame:
    """(ref_id, year, own, shape, author) of ``asked`` (ref_id, year, author, keys) with any key that works have.

    ``own`` are these keys with their idf and number of works, rarest first; ``shape`` are the common ones of the title.
    ``author`` is null unless it is common.
    """
    known = _known(asked.select("ref_id", F.explode("keys").alias("key")), weights)
    own = known.groupBy("ref_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("idf")).alias("rank"), "key", "df"))).alias("own"))
    often = F.filter("own", lambda x: x["df"] > RARE_WORKS)
    author = F.when(F.exists(often, lambda x: x["key"] == F.col("author")), F.col("author"))
    named = asked.drop("keys").join(dealt(own), "ref_id").withColumn("author", author)
    return named.withColumn("shape", F.filter(often, lambda x: ~x["key"].eqNullSafe(F.col("author"))))


def _told_apart(weighed: DataFrame) -> DataFrame:
    """``weighed`` with shape_id and author_id, which tell what is searched once."""
    shape = F.xxhash64("year", "journal_key", F.transform("shape", lambda x: x["key"]))
    return weighed.withColumn("shape_id", F.when(F.size("shape") > 0, shape)).withColumn("author_id", F.when(F.col("author").isNotNull(), F.xxhash64(shape, "author")))


def _codes(own: Column) -> dict[str, Column]:
    codes = F.transform(own, lambda x: x["key"])
    return {"codes": codes, "gains": F.map_from_arrays(codes, F.transform(own, lambda x: -x["rank"]))}


def _steps(own: Column) -> Column:
    """The keys with the number of works that those before have (``behind``) and what they and all after weigh together (``ahead``)."""
    so_far = lambda part, value: F.aggregate(part, F.lit(0.0), lambda n, x: n + value(x))
    return F.transform(own, lambda x, i: F.struct(
        x["key"].alias("mark"), i.alias("at"), so_far(F.slice(own, F.lit(1), i), lambda y: y["df"]).alias("behind"), so_far(F.slice(own, i + 1, F.size(own)), lambda y: -y["rank"]).alias("ahead")
    ))


def _between_years(visits: DataFrame) -> DataFrame:
    tolerance = year_tolerance(F.col("year"))
    return visits.withColumns({"low": F.col("year") - tolerance, "high": F.col("year") + tolerance}).drop("year")


def _score(bonus: float) -> Column:
    score = F.aggregate("shared", F.lit(0.0), lambda n, k: n + F.col("gains")[k])
    return F.round(score + bonus if bonus else score, 6)


def _within(bonus: float) -> list[str]:
    """What a search with a bonus meets by, besides its keys: all it meets has the citation's journal."""
    return ["journal_key"] if bonus else []


def _met_works(visits: DataFrame, index: DataFrame, bonus: float) -> DataFrame:
    """(id, work, source, record_id, rank_score) of the works met at rare keys: at the rarest that both have, and so once."""
    held = index.select("work", "source", "record_id", F.col("year").alias("work_year"), *_within(bonus), F.col("keys").alias("work_keys"), F.explode("rare").alias("mark"))
    met = _between_years(visits).join(dealt(held), ["mark", *_within(bonus)]).filter("work_year BETWEEN low AND high")
    met = met.withColumn("shared", F.array_intersect("codes", "work_keys")).filter(F.get("shared", F.lit(0)) == F.col("mark"))
    return met.select("id", "work", "source", "record_id", _score(bonus).alias("rank_score"))


def _classes(index: DataFrame, k: int, bonus: float, *more: str) -> DataFrame:
    """(work_year, journal_key, shape, author, members): the first k works of each year, shape and ``more``, and of each journal if there is a bonus for it."""
    kinds = ["year", *_within(bonus), "shape", *more]
    place = F.row_number().over(Window.partitionBy(*kinds).orderBy("source", "record_id"))
    own = index.withColumn("place", place).filter(F.col("place") <= k).groupBy(*kinds).agg(F.collect_list(F.struct("work", "source", "record_id")).alias("members"))
    return own.select(F.col("year").alias("work_year"), *_within(bonus), "shape", *more, "members")


def _met_classes(visits: DataFrame, held: DataFrame, bonus: float) -> DataFrame:
    """(id, work, source, record_id, rank_score) of the members of the classes met: at the rarest title key that both have, or by the author if they have none."""
    asked = _between_years(visits).withColumn("work_year", F.explode(F.sequence("low", "high"))).drop("low", "high")
    held = held.join(dealt(visits.select("key", *_within(bonus)).distinct()), ["key", *_within(bonus)], "left_semi")
    met = asked.join(dealt(held), ["key", "work_year", *_within(bonus)]).withColumn("shared", F.array_intersect("codes", "work_codes"))
    titled = F.filter("shared", lambda x: ~x.eqNullSafe(F.col("author")))
    met = met.filter(F.get(titled, F.lit(0)).eqNullSafe(F.col("mark"))).withColumn("rank_score", _score(bonus))
    least = F.coalesce(F.col("rank_score") >= F.col("least"), F.lit(True))
    return met.filter(least).select("id", F.explode("members").alias("member"), "rank_score").select("id", "member.*", "rank_score")


def _best(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("rank_score"), "source", "record_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _least(best: DataFrame, k: int) -> DataFrame:
    """(id, found): the k-th best score, of those with so many."""
    return best.filter(F.col("rank") == k).select("id", F.col("rank_score").alias("found"))


def _by_shape(weighed: DataFrame, index: DataFrame, k: int, bonus: float) -> tuple[DataFrame, DataFrame]:
    """The first k by the shape alone, for each shape_id (``id``), and (id, least), a score that the first k of its citations reach, if there is one."""
    shapes = weighed.filter("shape_id IS NOT NULL").groupBy(F.col("shape_id").alias("id")).agg(*[F.first(c).alias(c) for c in ("year", "journal_key", "shape")], _floor())
    steps = shapes.select("id", "year", "journal_key", "least", F.lit(None).cast("bigint").alias("author"), F.col("shape").alias("own"), F.explode(_steps(F.col("shape"))).alias("step"))
    steps = staged(steps.select("id", "year", "journal_key", "least", "author", "step.*", *[c.alias(n) for n, c in _codes(F.col("own")).items()]).withColumn("key", F.col("mark")))
    classes = _classes(index.filter("size(shape) > 0"), k, bonus)
    held = staged(classes.select("*", F.col("shape").alias("work_codes"), F.explode("shape").alias("key")).drop("shape"))
    # A sum in another order may differ in its last digits, so keys are visited a little beyond the threshold.
    open_ = F.coalesce(F.col("ahead") + bonus + 1e-5 >= F.col("least"), F.lit(True))
    early = (F.col("at") == 0) | (F.col("behind") <= FIRST_POSTINGS)
    first = staged(_best(_met_classes(steps.filter(early & open_), held, bonus), k))
    known = lambda df: df.join(dealt(_least(first, k)), "id", "left").withColumn("least", F.greatest("least", "found")).drop("found")
    more = _met_classes(known(steps.filter(~early)).filter(open_), held, bonus)
    top = staged(_best(first.drop("rank").unionByName(more), k))
    least = shapes.select("id", "least").join(dealt(_least(top, k)), "id", "left").select("id", F.greatest("least", "found").alias("least"))
    return top, least


def _floor() -> Column:
    """The least score of the first k, if all rows have so many."""
    return F.when(F.count("found") == F.count("*"), F.min("found")).alias("least")


def _by_author(weighed: DataFrame, index: DataFrame, k: int, bonus: float, least: DataFrame) -> DataFrame:
    """The first k by author and shape, for each author_id (``id``)."""
    named = weighed.filter("author_id IS NOT NULL").groupBy(F.col("author_id").alias("id")).agg(*[F.first(c).alias(c) for c in ("shape_id", "year", "journal_key", "author", "own", "shape")], _floor())
    named = named.join(dealt(least.select(F.col("id").alias("shape_id"), F.col("least").alias("found"))), "shape_id", "left").withColumn("least", F.greatest("least", "found"))
    often = F.filter("own", lambda x: x["df"] > RARE_WORKS)
    steps = F.concat(F.transform(_steps(F.col("shape")), lambda x: F.struct(x["mark"].alias("mark"), x["ahead"].alias("ahead"))), F.array(F.struct(F.lit(None).cast("bigint").alias("mark"), F.lit(0.0).alias("ahead"))))
    codes = _codes(often)
    visits = named.select("id", "year", "journal_key", "author", "least", *[c.alias(n) for n, c in codes.items()], F.explode(steps).alias("step")).select("*", "step.*").drop("step")
    visits = visits.filter(F.coalesce(F.col("ahead") + F.col("gains")[F.col("author")] + bonus + 1e-5 >= F.col("least"), F.lit(True))).drop("ahead")
    visits = staged(visits.withColumn("key", F.xxhash64("author", "mark")))
    classes = _classes(index.filter("author IS NOT NULL"), k, bonus, "author")
    marks = F.concat("shape", F.array(F.lit(None).cast("bigint")))
    held = classes.select("work_year", *_within(bonus), "author", "members", F.concat("shape", F.array("author")).alias("work_codes"), F.explode(marks).alias("mark"))
    held = held.select("work_year", *_within(bonus), "members", "work_codes", F.xxhash64("author", "mark").alias("key"))
    return _best(_met_classes(visits, held, bonus), k)


def _by_rare_keys(weighed: DataFrame, index: DataFrame, k: int, bonus: float) -> DataFrame:
    """The first k by rare keys alone, for each ref_id (``id``)."""
    rare = weighed.select(F.col("ref_id").alias("id"), "year", "journal_key", *[c.alias(n) for n, c in _codes(F.col("own")).items()], F.explode(F.filter("own", lambda x: x["df"] <= RARE_WORKS)).alias("step"))
    rare = rare.withColumn("mark", F.col("step.key")).drop("step", *([] if bonus else ["journal_key"]))
    return staged(_best(_met_works(rare, index, bonus), k))


def _top(weighed: DataFrame, index: DataFrame, k: int, bonus: float, single: DataFrame | None = None) -> DataFrame:
    """The first k works (id, work, source, record_id, rank_score, rank) for each ref_id of ``weighed`` (ref_id, year, journal_key, own, shape, author, floor): with a bonus, those of its journal.

    Works under ``floor``, if it is not null, may be left out. ``single`` is the first k by rare keys, if at hand.
    """
    single = single or _by_rare_keys(weighed, index, k, bonus)
    weighed = _told_apart(weighed).join(dealt(_least(single, k).withColumnRenamed("id", "ref_id")), "ref_id", "left")
    weighed = staged(weighed.withColumn("found", F.greatest("found", "floor")).drop("floor"))
    shaped, least = _by_shape(weighed, index, k, bonus)
    authored = _by_author(weighed, index, k, bonus, least)
    to_leads = lambda df, own: weighed.select("ref_id", F.col(own).alias("id")).join(dealt(df), "id").drop("id").withColumnRenamed("ref_id", "id")
    return _merged([single, to_leads(shaped, "shape_id"), to_leads(authored, "author_id")], k)


def _merged(parts: list[DataFrame], k: int) -> DataFrame:
    """The first k of what several searches met; a work's score counts once, the highest."""
    met = functools.reduce(DataFrame.unionByName, [p.select("id", "work", "source", "record_id", "rank_score") for p in parts])
    return _best(met.groupBy("id", "work").agg(F.first("source").alias("source"), F.first("record_id").alias("record_id"), F.max("rank_score").alias("rank_score")), k)


def _begun(asked: DataFrame, index: tuple[DataFrame, DataFrame], bonus: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``asked`` (ref_id, year, asked_title, asked_name, asked_journal, ...) with the ``lead`` of each, the leads, and their weighed keys.

    What many citations ask alike is read and searched once, by the smallest of their ref_ids, the lead.
    """
    texts = ["asked_title", "asked_name", *(["asked_journal"] if bonus else [])]
    owners = staged(asked.withColumn("lead", F.min("ref_id").over(Window.partitionBy("year", *texts))))
    # The smallest of those that ask alike when folded, too; with a bonus also whatever their journal (``plain``).
    alike = lambda *kinds: F.min("ref_id").over(Window.partitionBy("year", "keys", *kinds))
    leads = _keyed(owners.filter("ref_id = lead").select("ref_id", "year", *texts))
    leads = staged(leads.withColumns({"plain": alike(), "first": alike("journal_key") if bonus else alike()}))
    owners = owners.drop("asked_title", "asked_name", "asked_journal").join(dealt(leads.select(F.col("ref_id").alias("lead"), "first")), "lead").drop("lead").withColumnRenamed("first", "lead")
    weighed = _weighed(leads.filter("ref_id = plain").select("ref_id", "year", "author", "keys"), index[1])
    return owners, leads, staged(weighed.withColumns({"journal_key": F.lit(""), "floor": F.lit(None).cast("double")}))


def _first(asked: DataFrame, works: DataFrame, k: int, bonus: float, index: tuple[DataFrame, DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    """``asked`` with the ``lead`` of each, and the top k works of each lead (lead, rank, rank_score, source, record_id). ``bonus`` is for the same journal."""
    index = index or search_index(works)
    owners, leads, weighed = _begun(asked, index, bonus)
    index, _ = index
    top = _top(weighed, index, k, 0.0)
    if bonus:
        top = staged(top)
        # Journals that no work has give no bonus.
        own = leads.filter("ref_id = first").select("ref_id", "plain", "journal_key")
        held = own.join(dealt(index.select("journal_key").distinct()), "journal_key")
        floors = weighed.drop("journal_key", "floor").withColumnRenamed("ref_id", "plain").join(dealt(_least(top, k).select(F.col("id").alias("plain"), F.col("found").alias("floor"))), "plain", "left")
        within = _top(staged(held.join(dealt(floors), "plain").drop("plain")), index, k, bonus)
        top = _merged([within, own.select(F.col("ref_id").alias("lead"), F.col("plain").alias("id")).join(dealt(top), "id").drop("id").withColumnRenamed("lead", "id")], k)
    return owners, top.withColumnRenamed("id", "lead")


def _in_whole(single: DataFrame, weighed: DataFrame) -> DataFrame:
    """(lead, source, record_id) of the works that are first because they have all keys of the lead, a rare one among them.

    Another work has a key less, or has the rare one too and was ranked with it.
    """
    total = weighed.select(F.col("ref_id").alias("id"), F.round(F.aggregate("own", F.lit(0.0), lambda n, x: n - x["rank"]), 6).alias("total"))
    return single.filter("rank = 1").join(dealt(total), "id").filter("rank_score = total").select(F.col("id").alias("lead"), "source", "record_id")


def _records(works: DataFrame) -> DataFrame:
    """(s, r, record) of the works that searches find."""
    return works.filter("source = 'Crossref'").select(F.col("source").alias("s"), F.col("record_id").alias("r"), as_record().alias("record"))


def _ranked(asked: DataFrame, works: DataFrame, k: int, bonus: float, index: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """(ref_id, rank, rank_score, record): the top k works for each ref_id of ``asked``."""
    owners, top = _first(asked, works, k, bonus, index)
    top = owners.select("ref_id", "lead").join(dealt(top), "lead")
    return top.join(dealt(_records(works)), F.expr("source = s AND record_id = r")).select("ref_id", "rank", "rank_score", "record")


def _asked(citations: DataFrame, author: str, *more: str | Column) -> DataFrame:
    """(ref_id, year, asked_title, asked_name, asked_journal) and ``more`` of the citations that are searched."""
    return citations.filter("year IS NOT NULL").select("ref_id", "year", F.col("title").alias("asked_title"), F.expr(author).alias("asked_name"), F.col("journal").alias("asked_journal"), *more)


def _keyed(asked: DataFrame) -> DataFrame:
    """(ref_id, year, journal_key, author, keys) of what is asked; without a journal its key is empty."""
    journal = F.coalesce(normalize_journal(F.col("asked_journal")), F.lit("")) if "asked_journal" in asked.columns else F.lit("")
    named = asked.select("ref_id", "year", journal.alias("journal_key"), helpers.normalize_title("asked_title").alias("t"), helpers.normalize_author("asked_name").alias("a"))
    keys = F.concat(_title_words(F.coalesce("t", F.lit(""))), F.when(F.col("a") != "", F.array(author_key(F.col("a")))).otherwise(F.array().cast("array<string>")))
    return named.withColumns({"author": _author_code(F.col("a")), "keys": _coded(keys)}).drop("t", "a")


def search_candidates(citations: DataFrame, works: DataFrame, k: int = 5, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(ref_id, rank from 1, rank_score, record) of parsed citations. Without a year nothing can be accepted, so nothing is searched."""
    return _ranked(_asked(citations, FREE[0]), works, k, FREE[1], index)


def search_fielded(citations: DataFrame, works: DataFrame, k: int = 5, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """As ``search_candidates``, with the first word of the first author, and a bonus of 1 for the same journal."""
    return _ranked(_asked(citations, FIELDED[0]), works, k, FIELDED[1], index)


def scored_candidates(candidates: DataFrame, citations: DataFrame) -> DataFrame:
    """Candidates with title_sim, year_ok, auth_ok, jnl_ok, accepted and candidate_score."""
    fields = citations.select("ref_id", "title", "year", "authors", "uses_et_al", "first_author", "journal")
    df = candidates.join(dealt(fields), "ref_id")
    both = F.col("title").isNotNull() & (F.coalesce("record.title", F.lit("")) != "")
    df = df.withColumns({"own_journal": journal_key(F.col("journal")), "record_journal": journal_key(F.col("record.journal"))})
    df = df.withColumns({"list": helpers.compare_authors(F.col("authors"), F.col("record.surnames"), F.col("uses_et_al")), "sim": helpers.text_ratio(F.col("title"), F.col("record.title")), "jnl": helpers.text_ratio(F.col("record_journal"), F.col("own_journal"))})
    df = df.withColumns(
        {
            "title_sim": F.when(both, F.col("sim")).otherwise(0.0), "auth_ok": F.col("list.ok"), "jnl_ok": same_journal(F.col("own_journal"), F.col("record_journal"), F.col("jnl")),
            "tol": year_tolerance(F.col("year")), "year_ok": F.coalesce(F.abs(F.coalesce("record.search_year", "record.year") - F.col("year")) <= year_tolerance(F.col("year")), F.lit(False)),
        }
    )
    enough = F.col("title_sim") >= F.when(F.col("year") <= 1990, 0.80).otherwise(0.75)
    score = F.col("title_sim") * 0.7 + F.when(F.col("auth_ok"), 0.2).otherwise(0.0) + F.when(F.col("jnl_ok"), 0.1).otherwise(0.0)
    return df.withColumns({"accepted": F.col("year_ok") & (enough | F.col("auth_ok")), "candidate_score": score}).drop("list", "sim", "jnl", "own_journal", "record_journal", *[c for c in fields.columns if c != "ref_id"])


def choose_best_candidate(scored: DataFrame) -> DataFrame:
    """Of each ref_id's first five candidates the accepted one with the best score; of equal ones the first."""
    order = Window.partitionBy("ref_id").orderBy(F.desc("candidate_score"), "rank")
    return scored.filter("accepted AND rank <= 5").withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place").withColumn("reason", candidate_reason())


def candidate_reason() -> Column:
    """How an accepted candidate met the rule."""
    flag = lambda c: F.when(F.col(c), "True").otherwise("False")
    return F.format_string("title=%.2f, year_ok=%s, auth_ok=%s, jnl_ok=%s, tol=%d", "title_sim", flag("year_ok"), flag("auth_ok"), flag("jnl_ok"), "tol")


def _judged() -> Column:
    """What of a ``record`` decides whether it is accepted."""
    return F.struct("record.title", "record.surnames", journal_key(F.col("record.journal")).alias("journal"), F.coalesce("record.search_year", "record.year").alias("year"))


def _agrees_in_full(first: Column) -> Column:
    """The first record has the citation's very title, names, journal and a year within the tolerance, so none has a better score. A plain first name is one that folding leaves."""
    filled, named = (F.col("title") != "") & (F.col("own_journal") != ""), F.get("authors", F.lit(0)).rlike("^[A-Za-z][^&]*$")
    same = (F.col("title") == first["title"]) & (F.col("authors") == first["surnames"]) & (F.col("own_journal") == first["journal"])
    return F.coalesce(filled & named & same & (F.abs(first["year"] - F.col("year")) <= year_tolerance(F.col("year"))), F.lit(False))


def best_choices(citations: DataFrame, works: DataFrame, fielded: bool = False, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(ref_id, choice, reason) of the citations with a candidate: the one that ``choose_best_candidate`` takes of the ``scored_candidates`` of a search, both null if none is accepted.

    The fields that are judged move once for each lead, and a citation's five are judged together: ratios are worked
    out only while their bounds leave the choice open. ``with_records`` gives the records of choices.
    """
    author, bonus = FIELDED if fielded else FREE
    asked = _asked(citations, author, "title", "authors", "uses_et_al", journal_key(F.col("journal")).alias("own_journal"))
    held = _records(works).select("s", "r", _judged().alias("judged"))
    choice = F.struct("source", "record_id", F.xxhash64("judged").alias("mark")).alias("choice")
    judged_of = lambda df: df.join(dealt(held), F.expr("source = s AND record_id = r"))
    if bonus:
        owners, top = _first(asked, works, 5, bonus, index)
        settled = None
    else:
        # Where the first work has all keys and agrees in full, the other four make no difference and are not searched.
        index = index or search_index(works)
        owners, _, weighed = _begun(asked, index, bonus)
        single = _by_rare_keys(weighed, index[0], 5, bonus)
        firsts = judged_of(_in_whole(single, weighed)).groupBy("lead").agg(F.min(F.struct(choice, "judged")).alias("offer"))
        settled = staged(owners.join(dealt(firsts), "lead").filter(_agrees_in_full(F.col("offer.judged"))).select("ref_id", "offer.choice.*", year_tolerance(F.col("year")).alias("tol")))
        owners = staged(owners.join(dealt(settled.select("ref_id")), "ref_id", "left_anti"))
        left = lambda df, name: df.join(dealt(owners.select(F.col("lead").alias(name)).distinct()), name, "left_semi")
        top = _top(left(weighed, "ref_id"), index[0], 5, bonus, left(single, "id")).withColumnRenamed("id", "lead")
    offers = judged_of(top).groupBy("lead").agg(F.sort_array(F.collect_list(F.struct("rank", choice, "judged"))).alias("offers"))
    asked = owners.join(dealt(offers), "lead").withColumn("sure", _agrees_in_full(F.get("offers", F.lit(0))["judged"]))
    judged = helpers.best_candidate("title", "authors", "uses_et_al", "year", "own_journal", F.when(~F.col("sure"), F.transform("offers", lambda o: o["judged"])))
    out = asked.withColumn("best", F.when(F.col("sure"), F.struct(*_in_full())).otherwise(judged)).select("ref_id", F.get("offers.choice", F.col("best.at")).alias("choice"), "best.*", year_tolerance(F.col("year")).alias("tol"))
    if settled is not None:
        out = out.unionByName(settled.select("ref_id", F.struct("source", "record_id", "mark").alias("choice"), *_in_full(), "tol"))
    return out.withColumn("year_ok", F.lit(True)).select("ref_id", "choice", F.when(F.col("at").isNotNull(), candidate_reason()).alias("reason"))


def _in_full() -> list[Column]:
    """What ``helpers.best_candidate`` gives for a first record that agrees in full."""
    return [F.lit(0).alias("at"), F.lit(1.0).alias("title_sim"), F.lit(True).alias("auth_ok"), F.lit(True).alias("jnl_ok")]


def with_records(chosen: DataFrame, works: DataFrame) -> DataFrame:
    """``chosen`` with the ``record`` of each choice; without one a row is left out."""
    # Records of one identifier that are judged alike are one.
    records = _records(works).select(F.struct("s", "r", F.xxhash64(_judged()).alias("mark")).alias("held"), "record").selectExpr("held.*", "record").dropDuplicates(["s", "r", "mark"])
    keyed = chosen.filter("choice IS NOT NULL").select("*", "choice.*").drop("choice").withColumnRenamed("mark", "own")
    return keyed.join(dealt(records), F.expr("source = s AND record_id = r AND own = mark")).drop("source", "record_id", "own", "s", "r", "mark")


def searched(citations: DataFrame, works: DataFrame) -> DataFrame:
    """Citations with ``record`` (or null), had_candidate and match_reason: the free search, then the fielded one for the rest."""
    index = search_index(works)
    first = staged(best_choices(citations, works, index=index))
    rest = citations.join(dealt(first.filter("choice IS NOT NULL").select("ref_id")), "ref_id", "left_anti")
    second = staged(best_choices(rest, works, fielded=True, index=index))
    named = lambda df, how: df.select("ref_id", "choice", F.concat(F.lit(how), "reason").alias("match_reason"))
    best = with_records(named(first, "accepted: ").unionByName(named(second, "accepted (fielded): ")), works)
    seen = lambda df, name: df.select("ref_id").distinct().withColumn(name, F.lit(True))
    out = citations.drop("record", "match_reason").join(dealt(best), "ref_id", "left")
    out = out.join(dealt(seen(first, "seen_first")), "ref_id", "left").join(dealt(seen(second, "seen_second")), "ref_id", "left")
    reason = F.coalesce(
        "match_reason",
        F.when(F.col("seen_second"), "fielded search: no acceptable Crossref match"),
        F.when(F.col("seen_first"), "no acceptable Crossref match (rejected loose hits)"),
        F.lit("no Crossref items"),
    )
    return out.withColumns({"match_reason": reason, "had_candidate": F.coalesce("seen_first", "seen_second", F.lit(False))}).drop("seen_first", "seen_second")


def title_pairs(citations: DataFrame, works: DataFrame, source: str = "arXiv") -> DataFrame:
    """(ref_id, title, authors, uses_et_al, record_id, record): the works of a source that a citation has to be compared with.

    Lists that agree agree in their first surnames, which are equal or long and one letter apart, and the second name of a citation that has one is among the names of
    the record, so works stand under their first surname with each of the others, and with none for citations of one
    name: a common surname is no block of its own. Titles of a ratio of 0.9 differ in length by a fifth at most, so
    both are dealt by classes of length too, and no more than a tenth of both lengths need be put in or left out to
    turn one into the other, which ``levenshtein`` tells before the ratio is worked out.
    """
    works = works.filter(F.col("source") == source)
    plain = lambda c: F.lower(squeezed(c))
    of_length = lambda n: F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1.1)))
    first, alone = F.get("names", F.lit(0)), F.array(F.lit(""))
    asked = citations.filter("title IS NOT NULL").select("ref_id", "title", "authors", "uses_et_al", helpers.normalize_authors("authors").alias("names"), plain(F.col("title")).alias("plain"))
    held = works.select("record_id", as_record().alias("record")).withColumns({"names": helpers.normalize_authors("record.surnames"), "other": plain(F.coalesce("record.title", F.lit("")))})
    asked = asked.filter("size(names) > 0").select("ref_id", "title", "authors", "uses_et_al", "plain", first.alias("asked_name"), F.coalesce(author_key(F.get("names", F.lit(1))), F.lit("")).alias("second"))
    others = F.array_distinct(F.concat(alone, F.transform(F.slice("names", F.lit(2), F.size("names")), author_key)))
    held = held.filter("size(names) > 0").select("record_id", "record", "other", first.alias("held_name"), others.alias("others")).withColumn("second", F.explode("others")).drop("others")
    size = F.length("plain")
    # A class more on either side, as lowering can change the length of a few letters.
    asked = asked.withColumn("class", F.explode(F.sequence(of_length(size / 1.23) - 1, of_length(size * 1.23) + 1)))
    asked = asked.withColumn("key", F.explode(surname_keys(F.col("asked_name"))))
    held = held.withColumns({"class": of_length(F.length("other")), "key": F.explode(surname_keys(F.col("held_name")))})
    met = asked.join(dealt(held), ["key", "second", "class"])
    # A pair with the first half in common has met by that key already.
    again = F.col("key").startswith("2:") & (surname_head(F.col("asked_name")) == surname_head(F.col("held_name")))
    met = met.filter(~again & (F.levenshtein("asked_name", "held_name") <= 1))
    return met.filter(F.levenshtein("plain", "other") <= 0.1 * (F.length("plain") + F.length("other")) + 2).select("ref_id", "title", "authors", "uses_et_al", "record_id", "record")


def title_search_unique(citations: DataFrame, works: DataFrame, source: str = "arXiv") -> DataFrame:
    """(ref_id, record): the one work of a source with a title ratio of 0.9 or more and an agreeing author list. Citations with more than one such work get none."""
    met = title_pairs(citations, works, source)
    met = met.withColumns({"sim": helpers.title_similarity(F.col("title"), F.col("record.title")), "list": helpers.compare_authors(F.col("authors"), F.col("record.surnames"), F.col("uses_et_al"))})
    return met.filter("sim >= 0.9 AND list.ok").groupBy("ref_id").agg(F.count("*").alias("n"), F.min_by("record", F.col("record_id")).alias("record")).filter("n = 1").select("ref_id", "record")


def ads_discovery(unmatched: DataFrame, works: DataFrame) -> DataFrame:
    """(ref_id, record) from ADS for citations without record, PMID, PMCID and physics route: by DOI if they have one, else by title."""
    from .lookup import lookup_ads

    asked = unmatched.filter(UNFOUND).drop("record")
    by_doi = lookup_ads(asked.filter("doi IS NOT NULL"), works, F.col("doi")).filter("record IS NOT NULL").select("ref_id", "record")
    return by_doi.unionByName(title_search_unique(asked.filter("doi IS NULL"), works, "NASA ADS"))
