"""Words that differ by one letter, and the more frequent form of each, by asymmetric q-chunks.

Of two words one edit apart, the shorter (or either, if they are of one length) gives two disjoint chunks, its
first and its last q letters, q being half its length. One edit spares one of them: it stands in the other word
at its own place, or shifted by one where a letter was added before it. Of all positional grams of the other word
only those within that shift can meet a chunk, so only these are joined, by the length of the chunks' word, the place
and the letters. Then the pairs are verified.

What stands outside the spared chunk differs by one edit too, so a chunk that too many words share is followed by a
chunk of what is left: half of that, and half of the rest, until few words meet or one letter is left, where all that
meet are near. A frequent beginning or ending so costs a few rounds, and never all its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import checkpointed

#: ASCII letters and the upper half of Latin-1.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: A chunk that more pairs of words share is cut further.
HOT_PAIRS = 1 << 12
#: Up to so many letters the edit distance is computed in full.
MOST_LETTERS = 64
_UPPER = "".join(map(chr, range(65, 91)))


def words(documents: DataFrame) -> DataFrame:
    """(doc_id, word): every occurrence of a word in ``documents`` (doc_id, text), A-Z lowered. A null text has none."""
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    return documents.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("word"))


def without_letter(word: Column, at: Column) -> Column:
    """The word without its letter at a place counted from 0."""
    return F.concat(F.substring(word, F.lit(1), at.cast("int")), F.substring(word, (at + 2).cast("int"), F.length(word)))


def word_counts(occurrences: DataFrame, least_letters: int = 5, least_times: int = 3) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences; counts are added up before the shuffle."""
    long = occurrences.filter(F.length("word") >= least_letters)
    return long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_times)


def _part(word: Column, begin: Column, stop: Column) -> Column:
    return F.substring(word, (begin + 1).cast("int"), (stop - begin).cast("int"))


def _narrowed(entries: DataFrame) -> DataFrame:
    """Each entry twice: once if the first half of the open letters is spared, once if the last half is.

    ``low`` to ``high`` are the letters still open, in places of the word that gives chunks; ``more`` says how
    many letters the other word has beyond it, 0 or 1, and ``gram`` that this is the other word: the last chunk
    then stands ``more`` places on.
    """
    half = F.floor((F.col("high") - F.col("low")) / 2)
    shift = F.when(F.col("gram"), F.col("more")).otherwise(0)
    first = F.struct(F.lit(0).alias("side"), _part(F.col("word"), F.col("low"), F.col("low") + half).alias("chunk"), (F.col("low") + half).alias("low"), F.col("high").alias("high"))
    last = F.struct(F.lit(1).alias("side"), _part(F.col("word"), F.col("high") - half + shift, F.col("high") + shift).alias("chunk"), F.col("low").alias("low"), (F.col("high") - half).alias("high"))
    both = entries.withColumn("part", F.explode(F.array(first, last)))
    key = F.xxhash64("key", "part.side", "part.chunk")
    return both.select(key.alias("key"), "more", "gram", "word", "n", F.col("part.low").alias("low"), F.col("part.high").alias("high"))


def _entries(vocabulary: DataFrame) -> DataFrame:
    """A row for each word and part it takes: with words of its own length, as the shorter and as the longer word."""
    size = F.length("word")
    role = lambda more, gram, letters: F.struct(F.lit(more).alias("more"), F.lit(gram).alias("gram"), letters.cast("long").alias("high"))
    roles = F.array(role(0, False, size), role(1, False, size), role(1, True, size - 1))
    parts = vocabulary.withColumn("role", F.explode(roles)).select("word", "n", "role.*").withColumn("low", F.lit(0).cast("long"))
    return _narrowed(parts.withColumn("key", F.xxhash64("more", "high")))


def _crowded(entries: DataFrame) -> DataFrame:
    """The keys whose words make too many pairs while letters are still open to cut."""
    chunks, grams = F.sum((~F.col("gram")).cast("long")), F.sum(F.col("gram").cast("long"))
    kept = entries.groupBy("key").agg(F.max("more").alias("more"), chunks.alias("chunks"), grams.alias("grams"), F.max(F.col("high") - F.col("low")).alias("open"))
    pairs = F.when(F.col("more") == 0, F.col("chunks") * (F.col("chunks") - 1) / 2).otherwise(F.col("chunks").cast("double") * F.col("grams"))
    return kept.filter((pairs > HOT_PAIRS) & (F.col("open") > 1)).select("key")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether the second word, as long or a letter longer, is one edit away. Long words are compared in linear time, by the letters they begin with."""
    powers = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    fits = lambda n, step: (n + step <= F.length(a)) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step))
    same = F.aggregate(powers, F.lit(0), lambda n, step: F.when(fits(n, step), n + step).otherwise(n))
    rest = lambda word, at: F.substring(word, at + 1, F.length(word))
    long = (a != b) & (rest(a, same + F.length(a) + 1 - F.length(b)) == rest(b, same + 1))
    return F.when(F.length(a) > MOST_LETTERS, long).otherwise(F.levenshtein(a, b, 1) == 1)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n): every two words of ``vocabulary`` (word, n) that exactly one inserted, deleted or replaced letter tells apart, once."""
    open_, settled = checkpointed(_entries(vocabulary)), None
    while True:
        crowded = checkpointed(_crowded(open_))
        if crowded.isEmpty():
            break
        rest = open_.join(crowded, "key", "left_anti")
        settled = rest if settled is None else settled.unionByName(rest)
        open_ = checkpointed(_narrowed(open_.join(crowded, "key")))
    entries = open_ if settled is None else checkpointed(settled.unionByName(open_))
    chunk = entries.filter("NOT gram").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    same = entries.filter("more = 0").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    longer = entries.filter("gram").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = chunk.join(same, "key").filter("a < b").unionByName(chunk.join(longer, "key"))
    return met.filter(_one_edit(F.col("a"), F.col("b"))).drop("key").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form that following forms reaches. A form is at least twice as frequent, so paths are short."""
    paths = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = checkpointed(paths.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        paths = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return paths


def variants(vocabulary: DataFrame) -> DataFrame:
    """One row per row of ``vocabulary`` (distinct word, n): word, form, root, n, n_near, form_n.

    ``form`` is the most frequent word one edit away (of equal ones the smallest in code-point order) if it comes at
    least twice as often, else null, with ``form_n`` its n; ``root`` is where forms lead in the end, the word
    itself without a form; ``n_near`` counts the words one edit away. Empty tables give empty results. Words of one
    letter and of millions are allowed. A null word, which is near nothing, comes back alone as its root.
    """
    pairs = checkpointed(near_pairs(vocabulary.filter("word IS NOT NULL").select("word", "n")))
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    near = pairs.select(F.explode(ways).alias("w")).select("w.*").groupBy("word")
    near = near.agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    joined = vocabulary.select("word", "n").join(near, "word", "left")
    often = -F.col("best.rank") >= 2 * F.col("n")
    known = checkpointed(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.rank")).alias("form_n")))
    roots = _roots(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
