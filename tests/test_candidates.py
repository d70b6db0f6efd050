"""Candidate search against brute force, on titles whose words are all common."""

import collections
import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from citesieve.functions import helpers
from citesieve.operators import candidates
from citesieve.sources.catalogue import as_works

WORDS = ("on", "the", "of", "effects", "trials", "sleep", "in", "growth", "small", "rivers", "a", "steel")


@pytest.fixture(scope="module")
def titles():
    rng = random.Random(8)
    return {f"w{k:03}": (" ".join(rng.sample(WORDS, rng.randint(3, 6))), 2000 + rng.randint(0, 4), f"Author{'abcde'[k % 5]}", f"Journal {k % 3}") for k in range(300)}


@pytest.fixture(scope="module")
def works(spark, titles):
    df = spark.createDataFrame([(k, *v) for k, v in titles.items()], "record_id string, title string, year int, name string, journal string").repartition(3)
    no = F.lit(None).cast("string")
    person = F.struct(F.lit("A.").alias("given"), F.col("name").alias("family"), no.alias("last"), no.alias("name"))
    return as_works(df.withColumns({"source": F.lit("Crossref"), "authors": F.array(person), "doi": F.col("record_id")}).drop("name"))


def cited(spark, rows):
    return spark.createDataFrame(rows, "ref_id long, title string, year int, first_author string, journal string")


@pytest.mark.parametrize("postings", [0, 120, 1000])
def test_first_five_are_those_of_brute_force(spark, works, titles, monkeypatch, postings):
    monkeypatch.setattr(candidates, "FIRST_POSTINGS", postings)
    rng = random.Random(9)
    asked = [(k, t, y, "Authorb" if k % 2 else "Wrong", j) for k, (t, y, _, j) in enumerate(rng.sample(sorted(titles.values()), 40))]
    asked += [(90, "nothing shared", 2001, "Wrong", None), (91, None, 2001, "Authora", None), (92, "the steel", None, "Authora", None)]
    pairs = lambda words: {f"p:{a} {b}" for a, b in zip(["^", *words], [*words, "$"], strict=True) if words}
    of = lambda title, author: {f"t:{w}" for w in (title or "").split()} | pairs((title or "").split()) | {f"a:{author}"}
    held = {k: (of(t, a.lower()), y, j) for k, (t, y, a, j) in titles.items()}
    df = collections.Counter(key for keys, _, _ in held.values() for key in keys)
    for search, bonus in ((candidates.search_candidates, 0.0), (candidates.search_fielded, 1.0)):
        want = {}
        for ref, title, year, author, journal in asked:
            shared = {k: (of(title, author.lower()) & keys, j) for k, (keys, y, j) in held.items() if year and abs(y - year) <= 2}
            scores = {k: round(sum(math.log(300 / df[x] + 1) for x in keys) + bonus * (j == journal), 6) for k, (keys, j) in shared.items() if keys}
            want |= {(ref, n + 1): (k, s) for n, (k, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5])}
        rows = search(cited(spark, asked), works).select("ref_id", "rank", "rank_score", "record.record_id").collect()
        got = {(r.ref_id, r.rank): (r.record_id, r.rank_score) for r in rows}
        assert got.keys() == want.keys() and all(abs(got[x][1] - want[x][1]) < 2e-6 for x in want)
        assert sum(got[x][0] != want[x][0] for x in want) == 0


def test_searched_against_brute_force(spark, works, titles):
    """Every choice of ``searched``, accepted or rejected, by difflib over the first five of the free and then of the fielded search."""
    rng = random.Random(4)
    asked = []
    for k, (t, y, a, j) in enumerate(rng.sample(sorted(titles.values()), 40)):
        words = t.split()
        asked.append((k, " ".join(words if k % 4 else words[:1] + ["other", "words", "entirely"]), y + (3 if k % 5 == 0 else 0), a if k % 3 else "Wrong", j))
    df = cited(spark, asked).withColumns({"authors": F.array("first_author"), "uses_et_al": F.lit(False)})
    records = {k: v for k, v in titles.items()}
    tops = [{}, {}]
    for found, search in zip(tops, (candidates.search_candidates, candidates.search_fielded), strict=True):
        for r in search(df, works).select("ref_id", "rank", "record.record_id").collect():
            found.setdefault(r.ref_id, []).append((r["rank"], r.record_id))
    want = {}
    for ref, title, year, author, journal in asked:
        for found in tops:
            best = None
            for rank, work in sorted(found.get(ref, [])):
                t, y, a, j = records[work]
                sim = 1.0 if title == t else difflib.SequenceMatcher(None, title, t).ratio()
                if abs(y - year) <= 2 and (sim >= 0.75 or a == author):
                    jnl = j.lower() == journal.lower() or difflib.SequenceMatcher(None, j.lower(), journal.lower()).ratio() > 0.6
                    best = max([x for x in (best, (sim * 0.7 + 0.2 * (a == author) + 0.1 * jnl, -rank, work)) if x])
            if best:
                want[ref] = best[2]
                break
    got = {r.ref_id: r.record_id for r in candidates.searched(df, works).select("ref_id", "record.record_id").collect()}
    assert len(got) == len(asked) and {k: v for k, v in got.items() if v} == want and 0 < len(want) < len(asked)


def test_like_titles_of_one_surname_are_found(spark):
    """A tenth of the works share one surname: what is found is what comparing all with all finds."""
    rng = random.Random(6)
    title = lambda: " ".join(rng.choice(WORDS) + str(rng.randint(1, 9)) for _ in range(9))
    held = [(f"x{k:04}", title(), "Wang" if k % 10 == 0 else f"Author{'abcdefgh'[k % 8]}") for k in range(600)]
    no = F.lit(None).cast("string")
    person = F.struct(F.lit("A.").alias("given"), F.col("name").alias("family"), no.alias("last"), no.alias("name"))
    works = as_works(spark.createDataFrame(held, "record_id string, title string, name string").withColumns({"source": F.lit("arXiv"), "authors": F.array(person)}).drop("name"))
    asked = []
    for k, (_, t, name) in enumerate(held[:200]):
        cut = "".join(c for c in t if rng.random() > (0.02, 0.1, 0.25)[k % 3])
        asked.append((k, f"  {cut.upper()} ", name))
    df = spark.createDataFrame(asked, "ref_id long, title string, name string").select("ref_id", "title", F.array("name").alias("authors"), F.lit(False).alias("uses_et_al"))
    want = {}
    for ref, t, name in asked:
        like = [w for w, other, n in held if n == name and helpers.title_ratio(t, other) >= 0.9]
        if len(like) == 1:
            want[ref] = like[0]
    got = {r.ref_id: r.record_id for r in candidates.title_search_unique(df, works).select("ref_id", "record.record_id").collect()}
    assert got == want and 50 < len(want) < 200


def test_co_authors_part_the_works_of_one_surname(spark):
    """600 titles of one surname: what is found is what comparing all with all finds, and few pairs are compared."""
    rng = random.Random(16)
    title = lambda: " ".join(rng.choice(WORDS) + str(rng.randint(1, 9)) for _ in range(9))
    others = [a + b for a in ("Mora", "Beck", "Ibsen", "Castellanos") for b in ("", "son", "berg", "mann", "ova")]
    held = [(f"x{k:04}", title(), ["Wang", *rng.sample(others, rng.randint(0, 4))]) for k in range(600)]
    no = F.lit(None).cast("string")
    people = F.transform("names", lambda n: F.struct(F.lit("A.").alias("given"), n.alias("family"), no.alias("last"), no.alias("name")))
    works = as_works(spark.createDataFrame(held, "record_id string, title string, names array<string>").withColumns({"source": F.lit("arXiv"), "authors": people}).drop("names"))
    asked = []
    for k, (_, t, names) in enumerate(held):
        cut = "".join(c for c in t if rng.random() > (0.02, 0.1, 0.25)[k % 3])
        own = {0: names, 1: names[:1], 2: [names[0], *names[2:]], 3: [*names[:1], "Nobody"], 4: names[::-1]}[k % 5]
        asked.append((k, cut, own, k % 7 == 0))
    df = spark.createDataFrame(asked, "ref_id long, title string, authors array<string>, uses_et_al boolean")
    want = {}
    for ref, t, names, et_al in asked:
        near = [(w, n) for w, other, n in held if difflib.SequenceMatcher(None, t, other).quick_ratio() >= 0.9 and helpers.title_ratio(t, other) >= 0.9]
        like = [w for w, n in near if helpers.compared_authors(names, n, et_al)["ok"]]
        if len(like) == 1:
            want[ref] = like[0]
    got = {r.ref_id: r.record_id for r in candidates.title_search_unique(df, works).select("ref_id", "record.record_id").collect()}
    assert got == want and 150 < len(want) < 500
    assert candidates.title_pairs(df, works).count() < 600 * 600 / 50


def test_common_words_and_a_wrong_author_still_find_the_work(spark, works, titles):
    asked = cited(spark, [(k, t, y, "Wrong", j) for k, (t, y, _, j) in enumerate(titles.values())]).withColumns({"authors": F.array(F.lit("Wrong")), "uses_et_al": F.lit(False)})
    best = candidates.choose_best_candidate(candidates.scored_candidates(candidates.search_candidates(asked, works), asked))
    found = {r.ref_id: r.title for r in best.select("ref_id", "record.title").collect()}
    assert found == {k: t for k, (t, *_) in enumerate(titles.values())}
