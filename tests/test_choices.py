"""The best candidate is the one that judging all in full gives, and few ratios are worked out for it."""

import difflib
import random

import pyarrow as pa

from citesieve.functions import helpers
from citesieve.operators import candidates
from tests.test_search_shapes import catalogue

WORDS = ("effects", "of", "sleep", "steel", "in", "on", "trials", "rivers", "series")


def in_full(title, authors, et_al, year, journal, records):
    """Place, ratio, authors and journal of the best of all records by the rule itself."""
    least, tolerance = (0.80, 1) if year <= 1990 else (0.75, 2)
    best, found = None, None
    for at, r in enumerate(records):
        sim = helpers.ratio(title, r["title"]) if title is not None and r["title"] else 0.0
        auth = helpers.compared_authors(authors, r["surnames"] or [], et_al)["ok"]
        own, other = journal or "", r["journal"] or ""
        jnl = bool(own and other) and (own in other or other in own or helpers.ratio(other, own) > 0.6)
        score = sim * 0.7 + (0.2 if auth else 0.0) + (0.1 if jnl else 0.0)
        if r["year"] is not None and abs(r["year"] - year) <= tolerance and (sim >= least or auth) and (best is None or score > best):
            best, found = score, {"at": at, "title_sim": sim, "auth_ok": auth, "jnl_ok": jnl}
    return found


def test_choices_are_those_of_judging_all_in_full():
    rng = random.Random(21)
    title = lambda: rng.choice([None, ""] if rng.random() < 0.1 else [" ".join(rng.choices(WORDS, k=rng.randint(1, 9)))])
    names = lambda: [rng.choice(("Karabcdefg", "Karabxdefg", "Bel", "Dor", "", "-")) for _ in range(rng.randint(0, 3))]
    journal = lambda: rng.choice((None, "", "sleep", "sleep medicine", "annals of steel", "annals of steels"))
    taken = set()
    for _ in range(4000):
        own = (title(), names(), rng.random() < 0.2, rng.randint(1988, 1994), journal())
        records = [{"title": title(), "surnames": rng.choice((None, names())), "journal": journal(), "year": rng.choice((None, own[3], own[3] + 1, own[3] - 2, own[3] + 3))} for _ in range(rng.randint(0, 5))]
        for r in records:
            if own[0] and rng.random() < 0.6:
                r["title"] = "".join(c for c in own[0].upper() if rng.random() > rng.choice((0, 0.05, 0.25)))
            if rng.random() < 0.3:
                r["surnames"] = list(own[1])
        want = in_full(*own, records)
        assert helpers.best_of(*own, records) == want
        taken.add(want and (want["at"], want["auth_ok"], want["jnl_ok"]))
    assert len(taken) > 15 and None in taken


def test_a_record_that_agrees_in_full_needs_no_ratio(monkeypatch):
    made = []
    monkeypatch.setattr(helpers, "SequenceMatcher", lambda *rest: made.append(rest) or difflib.SequenceMatcher(*rest))
    records = [{"title": f"Effects of steel in trials of series {x}", "surnames": [f"Kar{x}", "Bel"], "journal": "sleep", "year": 2001} for x in "cabde"]
    got = helpers.best_of("Effects of steel in trials of series b", ["Karb", "Bel"], False, 2001, "sleep", records)
    assert got == {"at": 2, "title_sim": 1.0, "auth_ok": True, "jnl_ok": True} and not made


def test_lists_from_flat_columns_are_those_of_to_pylist():
    kind = pa.list_(pa.struct([("title", pa.string()), ("surnames", pa.list_(pa.string())), ("year", pa.int32())]))
    rows = [[{"title": "a", "surnames": ["x", None], "year": 1}, {"title": None, "surnames": None, "year": None}], None, [], [{"title": "é", "surnames": [], "year": 2}]]
    for array in (pa.array(rows, kind), pa.array([None, *rows, None], kind)[1:5], pa.array(rows, kind)[1:]):
        want = [[dict(r, surnames=r["surnames"] or []) for r in row or []] for row in array.to_pylist()]
        assert helpers._lists(array) == want


def test_a_citation_keeps_its_choice_and_not_its_candidates(spark, monkeypatch):
    """Nothing staged by a search holds records, and the choice is one row a citation."""
    kept = []
    monkeypatch.setattr(candidates, "staged", lambda df, own=candidates.staged: kept.append(own(df)) or kept[-1])
    held, works = catalogue(spark, 60)
    asked = [(k, t, y, a, j, [a], False) for k, (_, t, y, a, j) in enumerate(held[:12])]
    df = spark.createDataFrame(asked, "ref_id long, title string, year int, first_author string, journal string, authors array<string>, uses_et_al boolean")
    got = {r.ref_id: (r.title, r.match_reason) for r in candidates.searched(df, works).select("ref_id", "record.title", "match_reason").collect()}
    assert got == {k: (row[1], "accepted: title=1.00, year_ok=True, auth_ok=True, jnl_ok=True, tol=2") for k, row in enumerate(asked)}
    choices = [df for df in kept if "choice" in df.columns]
    assert [df.count() for df in choices] == [12, 0] and not any("record" in df.columns for df in kept)
