"""The n-gram join: words that polynomial hashes confuse, filters under several orders, hot tokens, very long texts."""

import random

from pyspark.sql import functions as F

from citesieve.llm import ngram_join, set_links
from tests.llm.test_operators import SCHEMA, brute_components, ordered, sentence, word


def thue_morse(letters, n):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_words_of_thue_morse_are_told_apart(spark):
    rows = [(1, thue_morse("ab", 2048), None, None), (2, thue_morse("ba", 2048), None, None), (3, thue_morse("ab", 128), None, None), (4, thue_morse("ba", 128), None, None)]
    got = ngram_join.similar_components(spark.createDataFrame(rows, SCHEMA), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k for k in (1, 2, 3, 4)}


def near_rows(count, seed, most=8):
    rng = random.Random(seed)
    passage = sentence(rng, 25)
    rows = []
    for k in range(count):
        # Groups of near copies, all with one passage in common, which alone links nothing.
        own = random.Random(seed + k % 12)
        words = sentence(own, 70).split()
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = word(rng)
        rows.append((k, " ".join(words) + " " + passage, None, None))
    return rows


def test_more_orders_leave_fewer_candidates(spark):
    """Words that many others have too: pairs meet by a rare one, but seldom under orders that do not know it is rare."""
    rng = random.Random(31)
    pool = [word(rng) + str(k) for k in range(150)]
    rows = [(k, " ".join(rng.sample(pool, 40)), None, None) for k in range(250)]
    counts = ngram_join.candidate_counts(spark.createDataFrame(rows, SCHEMA).repartition(4), 1, 85)
    assert counts[0] > counts[1] > counts[2]


def test_no_order_leaves_out_a_similar_pair(spark):
    """Here only similar texts meet at all, so the orders have nothing to cut."""
    rows = near_rows(150, 31, 40)
    counts = ngram_join.candidate_counts(spark.createDataFrame(rows, SCHEMA).repartition(4), 3, 70)
    assert counts[0] >= counts[1] >= counts[2]
    linked = {c for d, _, c in brute_components(rows, 3, 70) if d != c}
    assert counts[2] >= len(linked)


def test_hot_tokens_are_cut_by_the_next_order(spark, monkeypatch):
    monkeypatch.setattr(set_links, "HOT_PAIRS", 2)
    rows = near_rows(90, 7)
    got = ngram_join.similar_components(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, 70)
    assert ordered(got.collect()) == ordered(brute_components(rows, 3, 70))


def test_long_texts(spark):
    rng = random.Random(3)
    long = sentence(rng, 300_000)
    rows = [(1, long, None, None), (2, long + " and more", None, None), (3, long[: len(long) // 2], None, None), (4, "x" * 3_000_000, None, None), (5, "x" * 3_000_000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("label", F.lit("clash"))
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(df, 5, 80).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(12)
    text, other = sentence(rng, 60), sentence(rng, 60)
    rows = [(4, text), (None, text + " end"), (7, text), (4, text), (5, other), (None, other), (None, None), (None, ""), (None, "  "), (8, "alone"), (None, "twice null"), (None, "twice null")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS row", "'x' AS lowest")
    left = ngram_join.without_near_copies(df, 5, 80)
    assert left.columns == df.columns
    assert ordered(left.select("doc_id", "text").collect()) == ordered([(4, text), (5, other), (None, None), (None, ""), (None, "  "), (8, "alone"), (None, "twice null")])
    assert ngram_join.without_near_copies(df.limit(0)).count() == 0
