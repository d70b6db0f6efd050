"""Words one edit apart: against all pairs, with crowded chunks, and on odd rows."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from citesieve.llm import queries, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(counts):
    near = {a: [b for b in counts if one_edit(a, b)] for a in counts}
    forms = {}
    for a, all_near in near.items():
        if all_near and counts[best := min(all_near, key=lambda b: (-counts[b], b))] >= 2 * counts[a]:
            forms[a] = best
    out = []
    for a in counts:
        root = a
        while root in forms:
            root = forms[root]
        out.append((a, forms.get(a), root, counts[a], len(near[a]), counts[forms[a]] if a in forms else None))
    return sorted(out, key=str)


def plain(found):
    return sorted(map(tuple, found.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def vocabulary(count, seed, letters="abé", longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))): rng.randint(1, 40) for _ in range(count)}


@pytest.mark.parametrize("hot", [0, 3, 1 << 12])
def test_all_near_words_are_found(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling_variants, "HOT_PAIRS", hot)
    counts = vocabulary(500, 2) | {"prefix" + w: n for w, n in vocabulary(150, 3, "xyzé", 4).items()} | {w + "ending": n for w, n in vocabulary(150, 4, "xyz", 4).items()}
    assert plain(spelling_variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))) == brute(counts)


def test_paths_of_forms_lead_to_roots(spark):
    """Each word is twice as frequent as the one before and one letter longer; all lead to the last."""
    counts = {"a" * k: 3 * 2**k for k in range(1, 30)}
    assert plain(spelling_variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_odd_rows(spark):
    long = "q" * 1_000_000
    counts = {long: 3, long + "q": 9, "é" * 70: 5, "é" * 69 + "è": 6, "é" * 30 + "a" + "é" * 40: 7, "ties": 4, "tiea": 8, "tieb": 8, "x": 3, "y": 6, "": 1}
    df = spark.createDataFrame([*counts.items(), (None, 4)], "word string, n long").withColumns({c: F.lit(1) for c in ("key", "form", "near", "root", "more")})
    got = {r.word: r for r in spelling_variants.variants(df).collect()}
    assert (got[long].root, got[long].n_near) == (long + "q", 1) and got["ties"].form == "tiea" and got["x"].form == "y" and got[""].n_near == 2
    assert got["é" * 70].n_near == 2 and got["é" * 69 + "è"].n_near == 1
    assert got[None].root is None and got[None].n_near == 0
    assert spelling_variants.variants(df.limit(0)).count() == 0


def test_query_counts_words_of_whole_texts(spark, tmp_path):
    rng = random.Random(6)
    base = [*vocabulary(40, 9, "abcÀ×", 9), "Straße", "STRASSE"]
    rows = [(k, rng.choice((" ", ", ", "1", "_")).join(rng.choice(base).title() for _ in range(rng.randint(0, 300)))) for k in range(60)]
    rows += [(3, rows[4][1]), (None, "abcab abcab abcab"), (61, None), (62, ""), (63, "İ ſ K 漢字 абв")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    counts = collections.Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    expected = brute({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    assert plain(queries.op11_spelling_variants(spark, str(tmp_path))) == expected and len(expected) > 20
