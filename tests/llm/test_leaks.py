"""Parts of benchmark items, and items with words put in or left out, are found; short or thin overlaps are not."""

import random

from citesieve.llm import decontaminate


def test_parts_and_gaps(spark):
    rng = random.Random(5)
    text = lambda n: ["".join(rng.choice("abcdefghijklmnopqr") for _ in range(rng.randint(5, 8))) for _ in range(n)]
    long, middle, short = text(300), text(38), text(12)
    items = [(0, " ".join(long)), (1, " ".join(middle)), (2, " ".join(short))]
    docs = [
        (0, text(9) + long[50:250] + text(9)), (1, middle[:19] + ["inserted"] + middle[19:]), (2, middle[:18] + middle[19:]), (3, short[:6] + ["x"] + short[6:]),
        (4, text(5) + long[90:110] + text(5)), (5, text(5) + long[90:105] + text(5)), (6, text(60)), (7, text(3) + long[:50] + text(40)),
        # Over two shorter rows of one document nothing is united.
        (8, middle[:15]), (8, middle[23:]),
    ]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 0): 200, (1, 1): 38, (2, 1): 37, (3, 2): 12, (4, 0): 20, (7, 0): 50}


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqr") for _ in range(rng.randint(5, 8))) for _ in range(n)]


def test_aligner_finds_what_brute_force_finds(spark):
    """Items of 5 to 600 words with exchanges in one stretch, spread, or at random; the answer is by comparing all in place."""
    rng = random.Random(21)
    items, docs, want = [], [], set()
    for k in range(150):
        n = rng.choice((*range(5, 40), 80, 128, 129, 130, 200, 257, 300, 450, 600))
        item = words(rng, n)
        gone = rng.choice((n // 5, n // 5 + 1, n // 4, n // 3, n))
        at = rng.randrange(n)
        lost = {(at + i) % n for i in range(gone)} if k % 3 == 0 else set(rng.sample(range(n), gone)) if k % 3 == 1 else set(range(0, n, max(1, n // max(1, gone))))
        kept = [x not in lost for x in range(n)]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(words(rng, 7) + [w if ok else "Z" + w for w, ok in zip(item, kept, strict=True)] + words(rng, 6))))
        size = decontaminate.LEAST_OVERLAP
        if sum(kept) >= 0.8 * n or any(sum(kept[i : i + size]) >= 0.8 * size for i in range(n - size + 1)):
            want.add((k, k))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and 30 < len(want) < 140


def test_short_items_and_texts_without_spaces(spark):
    chinese = "一个没有空格的基准题目也必须原样出现"
    items = [(0, "alpha beta gamma delta longer"), (1, "the quick brownish foxes"), (2, "yes"), (3, chinese), (4, None), (5, "...")]
    docs = [(0, "we saw the quick brownish foxes again"), (1, "the quick brown foxes"), (2, "oh yes indeed"), (3, "YES!"), (4, f"见 {chinese} 。"), (5, chinese + "了"), (6, None), (7, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 1), (3, 2), (4, 3)}


def test_clean_goes_by_text(spark):
    rng = random.Random(2)
    item = " ".join(words(rng, 30))
    rows = [(1, item), (1, "harmless words"), (None, "x " + item), (None, "also harmless"), (2, item), (2, item), (3, " ".join(words(rng, 400_000)) + " " + item)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS leaking", "2 AS text_key")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    left = decontaminate.clean(df, bench)
    assert sorted(r.text for r in left.collect()) == ["also harmless", "harmless words"] and left.columns == df.columns
    assert decontaminate.clean(df.limit(0), bench).count() == 0 and decontaminate.clean(df, bench.limit(0)).count() == len(rows)


def test_long_document_full_of_hits(spark):
    """Parts of items stand so close that a document's hits are one stretch, cut many times; whole items are found at every place."""
    rng = random.Random(8)
    items = [words(rng, 30) for _ in range(40)] + [words(rng, 400)]
    # Six words of an item are a hit but no leak.
    text = []
    for _ in range(2000):
        at = rng.randrange(390)
        text += [*words(rng, 14), *items[40][at : at + 6]]
    for k, item in enumerate(items[:40]):
        text[977 * k + 3 : 977 * k + 3] = item
    df = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {r.item_id: r.n_matched for r in decontaminate.contaminated(df, bench).collect() if r.item_id < 40}
    assert got == dict.fromkeys(range(40), 30)
