"""The fielded search is the free one and one among the works of the citation's journal: no shape is met once for each journal."""

import random

from citesieve.operators import candidates
from tests.test_candidates import cited
from tests.test_search_shapes import TITLES, catalogue


def test_journals_that_no_work_has_are_not_searched_again(spark, monkeypatch):
    """Pairs that meet: citations of unknown journals meet as many as one of none."""
    monkeypatch.setattr(candidates, "RARE_WORKS", 12)
    met = []
    for name in ("_met_works", "_met_classes"):
        monkeypatch.setattr(candidates, name, lambda *rest, own=getattr(candidates, name): met.append(df := own(*rest)) or df)
    held, works = catalogue(spark, 600)
    rng, counts, found = random.Random(15), [], []
    rows = [(rng.choice(TITLES), 2000 + rng.randint(0, 4), "Wrong") for _ in range(10)]
    for journals in ((None,), tuple(f"Unknown letters {n}" for n in range(8))):
        met.clear()
        asked = cited(spark, [(100 * k + n, *row, journal) for k, row in enumerate(rows) for n, journal in enumerate(journals)])
        found.append({(r.ref_id, r["rank"]): (r.record_id, r.rank_score) for r in candidates.search_fielded(asked, works).select("ref_id", "rank", "rank_score", "record.record_id").collect()})
        counts.append(sum(df.count() for df in met))
    assert 0 < counts[1] <= counts[0]
    assert found[1] == {(ref + n, rank): work for (ref, rank), work in found[0].items() for n in range(8)}
