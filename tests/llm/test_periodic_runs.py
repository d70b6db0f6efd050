"""Periodic runs: against all periods by brute force, tile by tile, and on odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from citesieve.llm import periodic_runs, queries

SCHEMA = "doc_id long, text string"
SPACE = "[\\x20\\x09-\\x0D]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def brute_runs(w, least=24, times=3):
    """(start, period, length) of all runs, by start, then period."""
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            root = w[i : i + q]
            if j > i and j - i + q >= max(least, times * q) and not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q)):
                found.append((i, q, j - i + q))
            i = j + 1
    return sorted(found)


def collapse(w, runs):
    dropped = {k for s, q, n in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in dropped)


def texts(count, seed, longest=400):
    rng = random.Random(seed)
    for _ in range(count):
        n = rng.randint(0, longest)
        w = [f"w{rng.randrange(rng.choice((1, 2, 3, 30, 900)))}" for _ in range(n)]
        for _ in range(rng.randint(0, 4)):
            if n > 30:
                a, p = rng.randrange(n), rng.randint(1, n // 3)
                for k in range(a + p, min(n, a + rng.randint(2 * p, 5 * p + 30))):
                    w[k] = w[k - p]
        yield rng.choice((" ", "\n", " \t ")).join(w) + rng.choice(("", " ", "\n"))


@pytest.mark.parametrize("tile", [64, 200, 1 << 16])
def test_all_runs_are_found(spark, tile):
    rows = [(k, t) for k, t in enumerate(texts(150, 11))]
    got = periodic_runs.collapsed(spark.createDataFrame(rows, SCHEMA).repartition(3), tile=tile).collect()
    for r in got:
        w = words(rows[r.doc_id][1])
        expected = brute_runs(w)
        assert [(x.start, x.period, x.length) for x in r.runs] == expected
        assert r.collapsed == collapse(w, expected)
    assert len(got) == len(rows)


def test_odd_rows(spark):
    word = "é" * 40
    rows = [(1, None), (2, ""), (3, " \n "), (None, "a b"), (None, None), (4, " ".join([word] * 23)), (5, " ".join([word] * 24)), (5, " ".join([word] * 24)), (6, "x" * 3_000_000), (7, "A a " * 20), (8, "a " * 24 + "b " * 24), (9, "z z " * 24)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("text_key", "runs", "period", "start", "key")})
    got = {}
    for r in periodic_runs.collapsed(df).collect():
        got.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[3] == [([], "")]
    assert sorted(got[None]) == [([], ""), ([], "a b")]
    assert got[4] == [([], " ".join([word] * 23))]
    assert got[5] == [([(0, 1, 24)], word)] * 2
    assert got[6] == [([], "x" * 3_000_000)]
    assert got[7] == [([(0, 2, 40)], "A a")]
    assert got[8] == [([(0, 1, 24), (24, 1, 24)], "a b")]
    assert got[9] == [([(0, 1, 24)], "z z")]
    assert periodic_runs.collapsed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, least_words=8)


def test_long_text_of_many_tiles(spark):
    """One period that runs through all tiles, and Thue-Morse words, which no run may be read into."""
    rng = random.Random(4)
    cycle = [f"w{rng.randrange(10**6)}" for _ in range(9_000)]
    w = ["start", *(cycle * 4), *(f"t{bin(k).count('1') % 2}" for k in range(30_000))]
    got = periodic_runs.periodic_runs(spark.createDataFrame([(1, " ".join(w))], SCHEMA), tile=2048).collect()
    assert [(r.start, r.period, r.length) for r in got] == [(1, 9_000, 36_000)]


def test_query_repeats_words_and_reports_the_strongest_run(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, t) for k, t in enumerate(texts(60, 5, 200))] + [(None, "a " * 30), (10**9, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc_id, text in rows:
        w, h = words(text), zlib.crc32(str(doc_id).encode())
        n, g = len(w), h // 10
        if doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, r = brute_runs(w), got[doc_id]
        assert r.n_runs == len(runs)
        best = None
        for s, q, k in runs:
            if best is None or k * best[1] > best[2] * q:
                best = (s, q, k)
        assert (r.start, r.period, r.length) == (best or (None,) * 3) and r.exponent_milli == (1000 * best[2] // best[1] if best else None)
        assert r.runs_sha256 == sha("".join(f"{s},{k},{q}\n" for s, q, k in runs)) and r.collapsed_sha256 == sha(collapse(w, runs))
    assert any(r.n_runs for r in got.values()) and rng
