"""Long pre-tokens: counts are the library's, and twice the length takes no more than some twice the time."""

import random
import time

import pytest

from citesieve.llm import token_counts

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def merges():
    return token_counts.Merges(PATH)


def test_one_by_one_is_as_all_at_once(merges):
    rng = random.Random(4)
    pieces = ["".join(rng.choices(letters, k=n)).encode() for letters in ("a", "ab", "bet", "thein", "éß日a") for n in (*range(1, 40), 700)]
    assert [token_counts.count_long(p, merges) for p in pieces] == token_counts.count_symbols(pieces, merges).tolist()


def test_long_texts_are_counted_as_the_library_does(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices(letters, k=n)) for letters in ("acgt", "abcdefghijklmnopqrstuvwxyz", "x", "éàß") for n in (token_counts.LONG, token_counts.LONG + 1, 60_000)]
    texts += [" ".join(texts), "<|endoftext|>".join(texts[:4])]
    library = tokenizers.Tokenizer.from_file(PATH)
    want = {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, PATH).collect()} == want


def test_time_grows_with_length(merges):
    letters = "abcdefghijklmnopqrstuvwxyz"
    seconds = []
    for n in (400_000, 3_200_000):
        piece = "".join(random.Random(n).choices(letters, k=n)).encode()
        begin = time.perf_counter()
        token_counts.count_long(piece, merges)
        seconds.append(time.perf_counter() - begin)
    # Eight times the length; a square would take 64 times.
    assert seconds[1] < 20 * seconds[0]


def test_a_file_whose_merges_are_out_of_order_is_refused():
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    # "abc" made by the last merge is used by an earlier one: all places of a rank at once would be wrong.
    spec["model"]["merges"] = [["abc", "d"], ["a", "b"], ["ab", "c"]]
    with pytest.raises(ValueError):
        token_counts.checked(spec)
