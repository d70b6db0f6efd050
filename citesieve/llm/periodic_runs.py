"""Runs of periodically repeated words, found octave by octave of the period in overlapping tiles.

A run with period q is a stretch of words each of which equals the word q places on. Periods of one octave,
step to 2 * step - 1, are looked for at boundaries ``step`` words apart. A run of three periods holds ``step``
words after one boundary at least which come again q words later, so only boundaries whose next ``step`` words come
again within the octave are solved: Z-functions forwards and backwards from the boundary tell for all its periods
at once how far the words agree, up to two steps forwards and one back. What agrees is a fragment of a run;
neighbouring fragments overlap, so they are stitched by document and period wherever boundaries or tiles cut a run.
Whatever cannot become a run, or has a period that is itself a repetition, is left out there: each boundary gives
a few fragments at most, even of a text of one repeated word.

A text of at most ``tile`` words is one tile with all its octaves and is solved where it is read. A longer one
is exploded into tiles, those of short periods together and one set for each octave above, which are dealt to all
tasks: a tile reaches one step before its first boundary and four after its last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import checkpointed, small
from .text import _BASE, U64, mix, ragged, slices, span_hashes, utf8, word_spans

#: Boundaries are so many words apart at least; periods below twice that are the first octave.
FINEST = 8
#: A run has so many words at least, and so many periods: with less, it might miss all boundaries.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Texts of more words are exploded into tiles.
TILE_WORDS = 1 << 16
#: So many pairs of a boundary and a period are looked at together.
_PAIRS = 1 << 20

_FRAGMENT = "text_key binary, period bigint, start bigint, stop bigint"
_TILE = "text_key binary, base bigint, first bigint, last bigint, least bigint, most bigint, words binary"
RUN = "struct<start:bigint,period:bigint,length:bigint>"


def z_function(words: list, upto: int) -> list[int]:
    """For each place below ``upto``, how many words from there on are those the list begins with."""
    n = len(words)
    z, left, right = [0] * min(upto, n), 0, 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _at_boundary(words: np.ndarray, begin: int, end: int, at: int, step: int, periods: list[int], least_words: int, least_times: int):
    """(period, start, stop) of the fragments at one boundary: words start to stop - 1 equal those a period on."""
    forth = z_function(words[at : min(at + 4 * step, end)].tolist(), 2 * step)
    low, high = max(begin, at - step), min(at + 2 * step - 1, end)
    before = words[low:at][::-1].tolist()
    back = z_function([*before, None, *words[low:high][::-1].tolist()], len(before) + 1 + high - low)
    # The least period of the next two steps: a longer one of them is a repetition only of this.
    basic = next((d for d in range(1, step) if forth[d] + d >= 2 * step), 0) if len(forth) == 2 * step else 0
    for q in periods:
        after, ahead = min(forth[q], 2 * step), back[len(before) + 1 + high - at - q]
        if after < 2 * step and ahead < step and after + ahead < max((least_times - 1) * q, least_words - q):
            continue
        roots = (basic,) if q >= FINEST else range(1, q // 2 + 1)
        if not any(0 < d < q and q % d == 0 and forth[d] >= q - d for d in roots):
            yield q, at - ahead, at + after


def fragments(words: np.ndarray, begin, end, first, last, least, most, least_words: int, least_times: int):
    """(tile, period, start, stop) of all tiles, whose words stand in one array from ``begin`` to ``end``.

    Boundaries stand from ``first`` on, before ``last``; octaves go from ``least`` to ``most``.
    """
    found = []
    same, step = words, 1
    while True:
        if step >= FINEST:
            periods = np.arange(1 if step == FINEST else step, 2 * step)
            stop = np.minimum(last, end - step - periods[0] + 1)
            count = np.where((least <= step) & (step <= most), np.maximum(0, -(-(stop - first) // step)), 0)
            tile = np.repeat(np.arange(len(begin)), count)
            at = first[tile] + step * (np.arange(len(tile)) - np.repeat(np.cumsum(count) - count, count))
            rows = max(1, _PAIRS // len(periods))
            for k in range(0, len(at), rows):
                t, a = tile[k : k + rows], at[k : k + rows]
                again = a[:, None] + periods
                hit = (same[np.minimum(again, len(same) - 1)] == same[a][:, None]) & (again + step <= end[t][:, None])
                for row in np.flatnonzero(hit.any(axis=1)).tolist():
                    i = int(t[row])
                    for q, start, till in _at_boundary(words, int(begin[i]), int(end[i]), int(a[row]), step, periods[hit[row]].tolist(), least_words, least_times):
                        found.append((i, q, start - int(begin[i]), till - int(begin[i])))
        if len(same) <= step or step >= FINEST and not ((most >= 2 * step) & (end - first >= 4 * step)).any():
            return np.array(found, np.int64).reshape(-1, 4)
        same = mix(same[:-step] * _BASE + same[step:])  # names of twice as many words
        step *= 2


def tiles(n: int, size: int):
    """(base, stop, first, last, least, most) of the tiles of a text of n words; all are places in the text."""
    def cut(least, most, span):
        for first in range(0, n, span):
            yield max(0, first - most), min(n, first + span + 4 * most), first, min(n, first + span), least, most

    fine = FINEST
    while 16 * fine <= size:
        fine *= 2
    yield from cut(FINEST, fine, max(size // fine, 1) * fine)
    step = 2 * fine
    while LEAST_TIMES * step <= n:
        yield from cut(step, step, 8 * step)
        step *= 2


def _batch(keys: pa.Array, found: np.ndarray, base: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(found[:, 1]), *(pa.array(found[:, k] + base[found[:, 0]]) for k in (2, 3))]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(found[:, 0])), *columns], ["text_key", "period", "start", "stop"])


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(part.column("text"))
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def _in_place(least_words: int, least_times: int, tile: int):
    """Fragments of the texts that are one tile."""

    def solve(batches):
        for part in slices(batches):
            words, bounds = _words(part)
            n = np.diff(bounds)
            if len(words) < LEAST_WORDS:
                continue
            most = np.where(n <= tile, n // LEAST_TIMES, 0)
            yield _batch(part.column("text_key"), fragments(words, bounds[:-1], bounds[1:], bounds[:-1], bounds[1:], np.zeros(len(n), int), most, least_words, least_times), np.zeros(len(n), np.int64))

    return solve


def _exploded(tile: int):
    """The tiles of the texts that are longer than one."""

    def explode(batches):
        for part in slices(batches):
            words, bounds = _words(part)
            for k in np.flatnonzero(np.diff(bounds) > tile).tolist():
                own = words[bounds[k] : bounds[k + 1]]
                for base, stop, *rest in tiles(len(own), tile):
                    values = [[part.column("text_key")[k].as_py()], *([int(x)] for x in (base, *rest)), [own[base:stop].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.binary(), *[pa.int64()] * 5, pa.binary()], strict=True)], ["text_key", "base", "first", "last", "least", "most", "words"])

    return explode


def _of_tiles(least_words: int, least_times: int):
    def solve(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                base, first, last, least, most = (np.array([batch.column(c)[k].as_py()]) for c in ("base", "first", "last", "least", "most"))
                words = np.frombuffer(batch.column("words")[k].as_buffer(), np.uint64)
                found = fragments(words, np.zeros(1, int), np.array([len(words)]), first - base, last - base, least, most, least_words, least_times)
                yield _batch(batch.column("text_key").slice(k, 1), found, base)

    return solve


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def stitched(found: DataFrame, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(text_key, start, period, length) of the runs that fragments (text_key, period, start, stop) make up.

    Copies of a text give equal fragments; these are taken together before the shuffle. A window has the
    fragments of one text and period.
    """
    own = Window.partitionBy("text_key", "period").orderBy("start")
    before = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.groupBy("text_key", "period", "start").agg(F.max("stop").alias("stop"))
    parts = parts.withColumn("parted", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int"))
    parts = parts.withColumn("island", F.sum("parted").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("text_key", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = whole.select("text_key", "start", "period", (F.col("stop") - F.col("start") + F.col("period")).alias("length"))
    return runs.filter((F.col("length") >= least_words) & (F.col("length") >= least_times * F.col("period")))


def periodic_runs(documents: DataFrame, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES, tile: int = TILE_WORDS) -> DataFrame:
    """(text_key, start, period, length) of every run in the texts of ``documents`` (text), in words from 0.

    A run is as long as it can be, has ``least_words`` words and ``least_times`` of its smallest period at
    least (24 and 3 are the least allowed). Words are runs of bytes other than ASCII white space. ``text_key`` is
    the MD5 of the text, so equal texts share their runs; null counts as empty, and such a text has none. Runs of
    different periods may overlap; all are given. Other columns are ignored. Words are told apart by 64-bit hashes.
    """
    if least_words < LEAST_WORDS or least_times < LEAST_TIMES:
        raise ValueError(f"a run has {LEAST_WORDS} words and {LEAST_TIMES} periods at least")
    keyed = documents.select(text_key(F.col("text")).alias("text_key"), "text")
    solved = keyed.mapInArrow(_in_place(least_words, least_times, tile), _FRAGMENT)
    # A text of more words than a tile has bytes for them and the spaces between them.
    dealt = keyed.filter(F.octet_length("text") >= 2 * tile).mapInArrow(_exploded(tile), _TILE).repartition("text_key", "least", "first")
    return stitched(solved.unionByName(dealt.mapInArrow(_of_tiles(least_words, least_times), _FRAGMENT)), least_words, least_times)


def _collapse(batches):
    """Each text with its runs cut to their first period, words joined by single spaces."""
    for part in slices(batches):
        data, offsets = utf8(part.column("text"))
        starts, ends, first = word_spans(data, offsets)
        runs = pa.concat_arrays([part.column("runs")])
        counts = np.diff(runs.offsets.to_numpy())
        inner = runs.values.slice(runs.offsets[0].as_py(), int(counts.sum()))
        base = np.repeat(first[:-1], counts)
        start, period, length = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "period", "length"))
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, base + start + period, 1)
        np.add.at(change, base + start + length, -1)
        kept = np.cumsum(change)[:-1] == 0
        owner = np.repeat(np.arange(part.num_rows), np.diff(first))[kept]
        # The byte after a word is white space, the next text's or none: it becomes the space, but for a text's last word.
        size = ends[kept] - starts[kept] + 1
        if len(size):
            size[np.append(owner[1:] != owner[:-1], True)] -= 1
        begins = starts[kept]
        take = ragged(np.arange(len(data) + 1), begins, size).values.to_numpy()
        body = np.append(data, np.uint8(0x20))[take]
        space = np.cumsum(size)[np.append(owner[1:] == owner[:-1], False)] - 1 if len(size) else np.zeros(0, int)
        body[space] = 0x20
        sizes = np.bincount(owner, weights=size, minlength=part.num_rows).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        texts = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes()))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("runs"), texts.cast(pa.string())], ["doc_id", "runs", "collapsed"])


def collapsed(documents: DataFrame, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES, tile: int = TILE_WORDS) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, runs, collapsed.

    ``runs`` lists (start, period, length) by start, then period; ``collapsed`` is the text without the words that
    any run repeats after its first period, its words joined by single spaces. A null, empty or blank text gives no
    runs and an empty string. Repeated rows and rows without doc_id stay. Other columns are ignored.
    ``documents`` is read more than once. Runs are broadcast while they are few, and else joined by a shuffle.
    """
    listed = periodic_runs(documents, least_words, least_times, tile).groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    found = small(checkpointed(listed))
    own = documents.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).join(found, "text_key", "left")
    none = F.array().cast(f"array<{RUN}>")
    return own.select("doc_id", "text", F.coalesce("runs", none).alias("runs")).mapInArrow(_collapse, f"doc_id bigint, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period, of equal ones the first; null without runs. The quotients are compared exactly."""
    longer = lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x)
    return F.aggregate(runs, F.get(runs, F.lit(0)), longer)
