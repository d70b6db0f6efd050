"""Language identification with n-gram filters that answer for all languages at once.

A bit-sliced Bloom filter holds a bit for each language in every cell. The cells of an n-gram, combined by
AND, give the mask of all languages that contain it. The bits are counted for each language over the n-grams
of a text, corrected for the share of false positives that the filter's fill predicts, and the largest
count decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import hashed_share
from .text import NO_ALNUM, U64, mix, slices, utf8

#: Lengths of n-grams in bytes of lowered UTF-8, with all that is no letter as a space.
LENGTHS = (3, 5)
#: An n-gram is a language's if it is at least so frequent there, and so near to its rate where it is most frequent.
LEAST_RATE, LEAST_RATIO = 1e-5, 0.1
#: Training takes at most about this many labelled documents, dealt evenly among the languages and chosen by a hash of doc_id.
MOST_TRAINING = 12_000
#: More labelled languages than this are refused: each needs a bit in every cell.
MOST_LANGUAGES = 256
CELL_BITS, PROBES = 21, 2
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_BLANK = np.where(NO_ALNUM | np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8)), 32, np.arange(256)).astype(np.uint8)


def _grams(column):
    """For each length: the n-grams of all texts as numbers, and the text each is from."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    data = _BLANK[data].astype(np.uint64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in LENGTHS:
        if len(data) < n:
            continue
        grams = np.full(len(data) - n + 1, n << 56, np.uint64)
        for k in range(n):
            grams |= data[k : len(data) - n + 1 + k] << U64(8 * k)
        whole = owner[: len(grams)] == owner[n - 1 :]
        # Two spaces in a row say nothing about a language.
        blank = data == 32
        double = np.zeros(len(data) + 1, np.int32)
        np.cumsum(blank[1:] & blank[:-1], out=double[1:-1]) if len(data) > 1 else None
        double[-1] = double[-2]
        whole &= double[n - 1 : n - 1 + len(grams)] == double[: len(grams)]
        yield grams[whole], owner[: len(grams)][whole]


def _places(grams: np.ndarray) -> list[np.ndarray]:
    h = mix(grams * U64(0x9E3779B97F4A7C15))
    return [((h >> U64(32 * k)) & U64((1 << CELL_BITS) - 1)).astype(np.int64) for k in range(PROBES)]


def _count_grams(batches):
    for part in slices(batches):
        langs = part.column("lang").to_pylist()
        kinds = sorted(set(langs))
        code = np.array([kinds.index(x) for x in langs])
        for grams, owner in _grams(part.column("text")):
            for k, lang in enumerate(kinds):
                own, n = np.unique(grams[code[owner] == k], return_counts=True)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(own.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])


class Filters:
    """The languages and the cells of masks, eight languages a byte."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray]):
        self.languages = languages
        self.cells = np.zeros((max(1, -(-len(languages) // 8)), 1 << CELL_BITS), np.uint8)
        for k, lang in enumerate(languages):
            for place in _places(grams[lang]):
                self.cells[k // 8, place] |= np.uint8(1 << k % 8)
        fill = [np.mean((self.cells[k // 8] >> (k % 8)) & 1) for k in range(len(languages))]
        self.false = np.array(fill) ** PROBES
        self.bits = (np.arange(256)[:, None] >> np.arange(8)) & 1

    def scores(self, column) -> np.ndarray:
        """For each text and language, the n-grams that are the language's, without the expected false ones."""
        texts, count = len(column), len(self.languages)
        hits, total = np.zeros((texts, count)), np.zeros(texts)
        for grams, owner in _grams(column):
            total += np.bincount(owner, minlength=texts)
            places = _places(grams)
            for b, cells in enumerate(self.cells):
                mask = cells[places[0]]
                for place in places[1:]:
                    mask &= cells[place]
                table = np.bincount(owner * 256 + mask, minlength=texts * 256).reshape(texts, 256)
                hits[:, 8 * b : 8 * b + 8] += (table @ self.bits)[:, : count - 8 * b]
        return np.maximum(0, (hits - total[:, None] * self.false) / (1 - self.false))


def shares(totals: list[int], most: int) -> list[int]:
    """How many rows each language may give so that all give ``most`` at most: small ones all they have, the others as much as each other."""
    left, out = most, [0] * len(totals)
    for done, k in enumerate(sorted(range(len(totals)), key=totals.__getitem__)):
        out[k] = min(totals[k], left // (len(totals) - done))
        left -= out[k]
    return out


def trained(documents: DataFrame, most: int = MOST_TRAINING) -> Filters | None:
    """Filters of the languages in the rows with lang and text (at most about ``most`` of them), or None without such rows.

    More than ``MOST_LANGUAGES`` languages raise a ValueError.
    """
    rows = documents.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if sum(r.n for r in sizes) > most:
        cuts = F.create_map(*[F.lit(x) for r, n in zip(sizes, shares([r.n for r in sizes], most), strict=True) for x in (r.lang, n / r.n)])
        rows = rows.filter(hashed_share("doc_id") < F.element_at(cuts, F.col("lang")))
    counts = rows.select("text", "lang").mapInArrow(_count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("length", F.shiftrightunsigned("gram", 56))
    sums = {(r.lang, r.length): r.total for r in counts.groupBy("lang", "length").agg(F.sum("n").alias("total")).collect()}
    if not sums:
        return None
    totals = F.create_map(*[x for (lang, length), n in sums.items() for x in (F.lit(f"{length}{lang}"), F.lit(float(n)))])
    rated = counts.withColumn("rate", F.col("n") / F.element_at(totals, F.concat(F.col("length").cast("string"), "lang"))).filter(F.col("rate") >= LEAST_RATE)
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    # At most 1 / LEAST_RATE n-grams of each length can be so frequent in a language: the model has a bound.
    found = rated.join(top, "gram").filter(F.col("rate") >= LEAST_RATIO * F.col("top")).select("lang", "gram").toArrow()
    languages = sorted({lang for lang, _ in sums})
    return Filters(languages, {x: found.filter(pc.equal(found.column("lang"), x)).column("gram").to_numpy().view(np.uint64) for x in languages})


def predicted(documents: DataFrame, model: Filters | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``documents`` (doc_id, text).

    A null text, or one without a letter, is ``und`` with score 0. A text whose n-grams no language knows
    gets the first language, by name, and score 0. The score is the chosen language's part of all corrected
    counts. Without a model all is ``und``. Repeated rows stay; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for part in slices(batches):
            known = np.array([t is not None and _LETTER.search(t) is not None for t in part.column("text").to_pylist()], bool)
            if model is None:
                names, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            else:
                scores = model.scores(part.column("text"))
                best, all_ = scores.argmax(1), scores.sum(1)
                score = np.where(known & (all_ > 0), scores.max(1) / np.where(all_ > 0, all_, 1), 0.0)
                names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
