"""Searches where most works share their title's words: the classes of like works lose none of the first five, and what meets does not grow with the works."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from citesieve.operators import candidates
from tests.test_candidates import as_works, cited

TITLES = ("effects of sleep in trials", "effects of steel in trials", "effects of sleep on rivers", "a review of steel", "growth of small rivers in spring", "small trials")


def catalogue(spark, n):
    """n works (record_id, title, year, author, journal) of the few titles, with a rare word each in every seventh, and as ``works``."""
    rng = random.Random(12)
    held = [(f"w{k:05}", rng.choice(TITLES) + (f" series{k}" if k % 7 == 0 else ""), 2000 + rng.randint(0, 4), f"Author{'abcd'[rng.randrange(4)]}", f"Journal {rng.randrange(3)}") for k in range(n)]
    no = F.lit(None).cast("string")
    person = F.struct(F.lit("A.").alias("given"), F.col("name").alias("family"), no.alias("last"), no.alias("name"))
    df = spark.createDataFrame(held, "record_id string, title string, year int, name string, journal string").repartition(3)
    return held, as_works(df.withColumns({"source": F.lit("Crossref"), "authors": F.array(person), "doi": F.col("record_id")}).drop("name"))


def keys_of(title, author):
    words = title.split()
    return {f"t:{w}" for w in words} | {f"p:{a} {b}" for a, b in zip(["^", *words], [*words, "$"], strict=True) if words} | {f"a:{author.lower()}"}


@pytest.mark.parametrize("rare", [0, 12, 90])
def test_first_five_by_classes_are_those_of_brute_force(spark, monkeypatch, rare):
    monkeypatch.setattr(candidates, "RARE_WORKS", rare)
    held, works = catalogue(spark, 400)
    rng = random.Random(13)
    asked = [(k, t, y + rng.randint(-2, 2), a if k % 3 else "Wrong", j) for k, (_, t, y, a, j) in enumerate(rng.sample(held, 40))]
    asked += [(90, "nothing shared", 2001, "Wrong", "Journal 1"), (91, "", 2001, "Authora", "Journal 1"), (92, "small", 2003, "Authorb", None), (93, "review of sleep in spring", 2004, "Authorc", "Journal 0"), (94, held[0][1], 2030, "Authora", None)]
    asked += [(100 + k, *row[1:]) for k, row in enumerate(asked[:5])]
    keys = {w: keys_of(t, a) for w, t, _, a, _ in held}
    df = collections.Counter(key for own in keys.values() for key in own)
    for search, bonus in ((candidates.search_candidates, 0.0), (candidates.search_fielded, 1.0)):
        want = {}
        for ref, title, year, author, journal in asked:
            own, scores = keys_of(title, author), {}
            for work, _, y, _, j in held:
                shared = own & keys[work]
                if shared and abs(y - year) <= 2:
                    scores[work] = round(sum(math.log(400 / df[x] + 1) for x in sorted(shared, key=lambda x: df[x])) + bonus * (j == journal), 6)
            want |= {(ref, n + 1): (w, s) for n, (w, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5])}
        got = {(r.ref_id, r.rank): (r.record_id, r.rank_score) for r in search(cited(spark, asked), works).select("ref_id", "rank", "rank_score", "record.record_id").collect()}
        assert got.keys() == want.keys() and all(abs(got[x][1] - want[x][1]) < 2e-6 for x in want)
        # Other orders of a sum may round otherwise; ties of equal keys are told apart by the record.
        assert {x: w for x, (w, _) in got.items()} == {x: w for x, (w, _) in want.items()}


def test_pairs_that_meet_do_not_grow_with_the_works(spark, monkeypatch):
    monkeypatch.setattr(candidates, "RARE_WORKS", 12)
    met = []
    for name in ("_met_works", "_met_classes"):
        monkeypatch.setattr(candidates, name, lambda *rest, own=getattr(candidates, name): met.append(df := own(*rest)) or df)
    counts = []
    for n in (1500, 6000):
        held, works = catalogue(spark, n)
        asked = [(k, t, y, a, j) for k, (_, t, y, a, j) in enumerate(random.Random(14).sample([x for x in held if "series" not in x[1]], 30))]
        met.clear()
        candidates.search_candidates(cited(spark, asked), works).count()
        counts.append(sum(df.count() for df in met))
    assert 0 < counts[1] <= 1.2 * counts[0]
