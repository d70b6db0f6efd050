"""Near duplicates by signatures: the pigeonhole's promise, all pairs by brute force, hot keys, and odd rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citesieve.llm import hamming_join, set_links
from tests.llm.test_near_copies import near_rows
from tests.llm.test_operators import SCHEMA, brute_components, ordered, sentence, word


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_within_the_distance_share_keys_of_two_chunks(percent):
    chunks, distance = hamming_join.distance_for(percent)
    rng = np.random.default_rng(percent)
    for _ in range(300):
        one = rng.integers(0, 1 << 60, chunks, dtype=np.uint64)
        other = one.copy()
        for slot in rng.choice(5 * chunks, distance, replace=False).tolist():
            other[slot // 5] ^= np.uint64(1 + rng.integers(4095)) << np.uint64(12 * (slot % 5))
        keys = hamming_join.chunk_keys(np.stack([one, other]))
        shared = {k // 5 for k in np.flatnonzero(keys[0] == keys[1])}
        assert len(shared) >= 2


def brute_kept(rows, n, percent):
    return [(d, s, c, d == c) for d, s, c in brute_components(rows, n, percent)]


@pytest.mark.parametrize("hot", [2, 1 << 24])
def test_all_links_count(spark, monkeypatch, hot):
    monkeypatch.setattr(set_links, "HOT_PAIRS", hot)
    rows = near_rows(90, 7) + [(1000 + k, t, None, None) for k, (_, t, _, _) in enumerate(near_rows(40, 7, 20))]
    got = hamming_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, 85)
    assert ordered(got.collect()) == ordered(brute_kept(rows, 3, 85))


def test_candidates_hold_all_similar_pairs(spark):
    rng = random.Random(2)
    rows, sets = [], {}
    for k in range(120):
        own = random.Random(k % 15)
        words = sentence(own, 80).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(80)] = word(rng)
        rows.append((k, " ".join(words)))
        sets[k] = {tuple(words[i : i + 4]) for i in range(77)}
    got = {tuple(r) for r in hamming_join.candidates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    close = {(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    lowest = {k: min(j for j in sets if sets[j] == sets[k]) for k in sets}
    assert {(lowest[a], lowest[b]) for a, b in close} <= got | {(b, a) for a, b in got} and close


def test_odd_rows(spark):
    rng = random.Random(3)
    long = sentence(rng, 200_000)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "One Two"), (5, "one\ttwo"), (6, "one"), (7, long), (8, long + " and more"), (9, long[: len(long) // 2]), (10, "x" * 2_000_000), (11, "X" * 2_000_000), (None, "one two"), (None, None), (5, "one two"), (None, "only here"), (None, "only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "id", "row", "token", "weight", "label")})
    got = sorted((str(r.doc_id), r.n_shingles > 0, str(r.component_id), r.kept) for r in hamming_join.near_duplicates(df).collect())
    assert got == sorted([
        ("1", False, "1", True), ("2", False, "2", True), ("3", False, "3", True), ("4", True, "4", True), ("5", True, "4", False), ("6", True, "6", True), ("7", True, "7", True), ("8", True, "7", False),
        ("9", True, "9", True), ("10", True, "10", True), ("11", True, "10", False), ("None", True, "4", False), ("None", False, "None", True), ("5", True, "4", False), ("None", True, "None", True), ("None", True, "None", True),
    ])
    assert hamming_join.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        hamming_join.distance_for(50)


def test_long_signatures_are_not_kept_for_each_key(spark, monkeypatch):
    kept, copies = [], []
    across = set_links._across

    def counted(df):
        kept.append(set(df.columns))
        return checkpoint(df)

    def seen(entries, labels, percent, finer, marked, close):
        bounds = lambda n: [math.floor(math.log(x) / math.log(set_links.MARKED_BASE)) for x in (math.ceil(n * percent / 100), n * 100 // percent)]
        copies.extend(b - a + 1 for a, b in (bounds(n) for n in range(10, 3000)))
        return across(entries, labels, percent, finer, marked, close)

    checkpoint = set_links.checkpointed
    monkeypatch.setattr(set_links, "checkpointed", counted)
    monkeypatch.setattr(set_links, "_across", seen)
    rows = near_rows(60, 5)
    got = hamming_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, 85)
    assert ordered(got.collect()) == ordered(brute_kept(rows, 3, 85))
    assert not [columns for columns in kept if {"mark", "token"} <= columns] and max(copies) <= 4
