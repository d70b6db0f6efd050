"""Rows that a checksum confuses, shares of a sample that are small, and a lexicon that is too large."""

import random
import zlib

import pytest

from citesieve.llm import repeated_bytes, toxicity
from citesieve.llm.jobs import hashed_share
from tests.llm.test_operators import SCHEMA, sentence, word


def confused(rng):
    """Two texts of one CRC32: the second stands in a third text too, the first nowhere."""
    seen = {}
    while True:
        text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=238))
        if other := seen.setdefault(zlib.crc32(text.encode()), text):
            if other != text:
                return other, text


@pytest.mark.parametrize("doc_id", [None, 5])
def test_texts_of_one_checksum_are_two_rows(spark, doc_id):
    alone, shared = confused(random.Random(1))
    rows = [(doc_id, alone, None, None), (doc_id, shared, None, None), (9, "before " + shared + " after", None, None)]
    got = sorted((r.n_bytes, r.n_removed) for r in repeated_bytes.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), 64).collect())
    assert got == [(238, 0), (238, 238), (251, 238)]


def test_small_shares_are_not_none(spark):
    assert 5 < spark.range(40_000_000).filter(hashed_share("id") < 5e-7).count() < 45
    assert spark.range(10_000).filter((hashed_share("id") < 0) | (hashed_share("id") >= 1)).count() == 0


def test_a_lexicon_that_is_too_large_is_refused(spark, monkeypatch):
    rng = random.Random(2)
    bad = [word(rng) + "x" for _ in range(12)]
    rows = [(k, sentence(rng, 30) + (" " + " ".join(bad) if k % 2 else ""), None, None) for k in range(60)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    assert len(toxicity.trained(docs, labels).lexicon) >= 12
    monkeypatch.setattr(toxicity, "MOST_WORDS", 5)
    with pytest.raises(ValueError, match="5 words"):
        toxicity.trained(docs, labels)
