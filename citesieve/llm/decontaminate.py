"""Benchmark decontamination by spaced-seed hashing.

Words of the benchmark items and of the documents are hashed under fixed masks that ignore some positions, so
a hit survives words that were exchanged. Hits are joined by hash, each gives an alignment of an item with a
document, and the alignment is compared word by word. Positions that agree are united over all alignments of an
item with a document, so words put in or left out cost only themselves; a long part of an item counts by itself.
Items too short for a mask are found where all their words stand in a row.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import checkpointed, small
from .text import _BASE, LOWER, NO_ALNUM, U64, mix, slices, span_hashes, utf8, word_spans

#: Where a mask has 1 the words must agree. Whatever fifth of an item's words is exchanged, one of them still fits.
MASKS = ("1111", "11011", "110101", "1100101", "10100011", "111")
#: The last mask is only needed, and only used, for items of fewer words than this.
SHORT_ITEM = 19
#: Items are compared in pieces of up to this many words, so what a hit carries along is bounded.
PIECE_WORDS = 128
#: An item of fewer words is too short for a share of them to tell anything: all must stand in a row, unchanged.
LEAST_WORDS = 5
#: And if it has fewer bytes, as a lone "yes" has, only a document of these words and no others holds it.
LEAST_BYTES = 24
#: So many words of an item in a row, of which the share agrees, are a leak whatever the rest of the item.
LEAST_OVERLAP = 20
#: Hits of a document are sent in stretches of so many times the longest piece, so that long documents stay linear.
STRETCH = 4
#: Numbers of the masks of short items, by their words: anywhere in a document, or as all of it.
IN_A_ROW, ALONE = 100, 200
#: Bits of the filter that documents' hashes must pass before they are sent to the join; at most 16 MB.
MOST_FILTER_BITS = 27


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, NO_ALNUM)
    return span_hashes(data, starts, ends), first


def _seeds(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of each place where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number + 1, np.uint64)
    for at, bit in enumerate(mask):
        if bit == "1":
            out = mix(out * _BASE + words[at : at + n])
    return out


def _piece_bounds(n: int) -> np.ndarray:
    pieces = -(-n // PIECE_WORDS)
    return n * np.arange(pieces + 1) // pieces


def _cut_items(batches):
    """Pieces of the items, each with up to ``LEAST_OVERLAP`` words before and after it, and the seeds that begin in it."""
    for part in slices(batches):
        words, first = _words(part.column("text"))
        sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).to_pylist()
        rows = zip(part.column("item_id").to_pylist(), part.column("item_row").to_pylist(), first[:-1].tolist(), first[1:].tolist(), sizes, strict=True)
        for item, item_row, low, high, size in rows:
            n = high - low
            if not n:
                continue
            bounds = _piece_bounds(n).tolist()
            for k, (begin, end) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                start = max(0, begin - LEAST_OVERLAP)
                own = words[low + start : low + min(n, end + LEAST_OVERLAP)]
                masks = enumerate(MASKS if n < SHORT_ITEM else MASKS[:-1])
                if n < LEAST_WORDS:
                    masks = [((IN_A_ROW if size >= LEAST_BYTES else ALONE) + n, "1" * n)]
                found = [(h, p) for number, mask in masks for p, h in enumerate(_seeds(own, mask, number).view(np.int64).tolist()) if begin <= start + p < end]
                yield pa.RecordBatch.from_pylist(
                    [{"item_id": item, "item_row": item_row, "item_words": n, "piece": k, "start": start, "words": own.view(np.int64).tolist(), "seeds": [{"h": h, "at": p} for h, p in found]}],
                    pa.schema([("item_id", pa.int64()), ("item_row", pa.int64()), ("item_words", pa.int32()), ("piece", pa.int32()), ("start", pa.int32()), ("words", pa.list_(pa.int64())), ("seeds", pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())])))]),
                )


def _within(agree: np.ndarray, size: int, share: float) -> np.ndarray:
    """The positions in windows of ``size`` words of which ``share`` agree."""
    sums = np.append(0, np.cumsum(agree))
    good = np.flatnonzero(sums[size:] - sums[:-size] >= share * size - 1e-9) if len(agree) >= size else np.zeros(0, int)
    edge = np.zeros(len(agree) + 1, int)
    np.add.at(edge, good, 1)
    np.add.at(edge, good + size, -1)
    return np.cumsum(edge[:-1]) > 0


_OWN = ("text_key", "doc_id", "item_row", "item_id", "item_words")
_COMPARED = "text_key string, doc_id bigint, item_row bigint, item_id bigint, item_words int, piece int, matched int, low bigint, high bigint, overlap boolean"


def _compared(share: float):
    """For each alignment and piece: the words that agree in the piece, and as bits those in windows of ``LEAST_WORDS`` that agree."""

    def compare(batches):
        for batch in batches:
            rows = {name: [] for name in (*_OWN, "piece", "matched", "low", "high", "overlap")}
            for r in zip(*(batch.column(c).to_pylist() for c in _OWN), *(batch.column(c).to_pylist() for c in ("piece", "start", "at")), range(batch.num_rows), strict=True):
                *own, piece, start, at, k = r
                item, doc = (batch.column(c)[k].values.to_numpy() for c in ("words", "doc_words"))
                agree = np.zeros(len(item), bool)
                begin, end = max(0, -at), min(len(item), len(doc) - at)
                if begin < end:
                    agree[begin:end] = item[begin:end] == doc[at + begin : at + end]
                places = start + np.flatnonzero(agree)
                near = start + np.flatnonzero(agree & _within(agree, LEAST_WORDS, share))
                overlap = bool(_within(agree, LEAST_OVERLAP, share).any())
                bounds = _piece_bounds(own[-1])
                for part in sorted({piece, *(np.searchsorted(bounds, near, "right") - 1).tolist()}):
                    inside = lambda p: p[(p >= bounds[part]) & (p < bounds[part + 1])] - bounds[part]  # noqa: B023, E731
                    bits = sum(1 << b for b in inside(near).tolist())
                    signed = [x - (1 << 64) if x >> 63 else x for x in (bits & (1 << 64) - 1, bits >> 64)]
                    for name, value in zip(rows, (*own, part, len(inside(places)) if part == piece else 0, *signed, overlap), strict=True):
                        rows[name].append(value)
            kinds = [pa.string()] + [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))

    return compare


def _filter(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A Bloom filter of two bits a hash."""
    out = np.zeros(1 << bits >> 3, np.uint8)
    for place in _places(hashes, bits):
        np.bitwise_or.at(out, (place >> U64(3)).astype(np.int64), np.uint8(1) << (place & U64(7)).astype(np.uint8))
    return out


def _places(hashes: np.ndarray, bits: int):
    yield hashes >> U64(64 - bits)
    yield mix(hashes) >> U64(64 - bits)


def _passing(hashes: np.ndarray, shared: np.ndarray, bits: int) -> np.ndarray:
    at = np.arange(len(hashes))
    for k in range(2):
        place = list(_places(hashes[at], bits))[k] if k else hashes >> U64(64 - bits)
        at = at[(shared[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8) & 1).astype(bool)]
    return at


_HITS = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))


def _regions(shared, bits: int, reach: int, short: list[int]):
    """For each document the stretches of words around hits, with the hits; ``short`` has the lengths of short items.

    A stretch reaches as far past its first and last hit as a piece is long, so all of an alignment is seen from any
    of its hits. Hits on both sides of a cut give the same alignment twice, with the same result.
    """
    masks = [*enumerate(MASKS), *((IN_A_ROW + n, "1" * n) for n in short), *((ALONE + n, "1" * n) for n in short)]

    def scan(batches):
        for part in slices(batches):
            words, first = _words(part.column("text"))
            counts = np.diff(first)
            places, hashes = [], []
            for number, mask in masks:
                found = _seeds(words, mask, number)
                at = _passing(found, shared.value, bits)
                owner = np.searchsorted(first, at, "right") - 1
                whole = at + len(mask) <= first[owner + 1]
                if number > ALONE:
                    whole &= counts[owner] == len(mask)
                places.append(at[whole])
                hashes.append(found[at[whole]])
            places, hashes = np.concatenate(places), np.concatenate(hashes)
            order = np.argsort(places, kind="stable")
            places, hashes = places[order], hashes[order]
            owner = np.searchsorted(first, places, "right") - 1
            new = np.ones(len(places), bool)
            new[1:] = (np.diff(places) > reach) | (np.diff(owner) > 0) | (np.diff((places - first[owner]) // (STRETCH * reach)) > 0)
            cuts = np.append(np.flatnonzero(new), len(places))
            rows = {"doc_id": [], "text_key": [], "base": [], "words": [], "hits": []}
            ids, texts, keys = part.column("doc_id"), part.column("text"), {}
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                doc = int(owner[low])
                begin = max(int(first[doc]), int(places[low]) - reach)
                end = min(int(first[doc + 1]), int(places[high - 1]) + reach + 1)
                if doc not in keys:
                    keys = {doc: hashlib.md5(texts[doc].as_py().encode()).hexdigest()}
                rows["doc_id"].append(ids[doc].as_py())
                rows["text_key"].append(keys[doc])
                rows["base"].append(begin - int(first[doc]))
                rows["words"].append(words[begin:end].view(np.int64))
                rows["hits"].append([{"h": h, "at": p} for h, p in zip(hashes[low:high].view(np.int64).tolist(), (places[low:high] - first[doc]).tolist(), strict=True)])
            if rows["doc_id"]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["text_key"], pa.string()), pa.array(rows["base"], pa.int64()), pa.array(rows["words"], pa.list_(pa.int64())), pa.array(rows["hits"], _HITS)],
                    ["doc_id", "text_key", "base", "words", "hits"],
                )

    return scan


def _leaks(documents: DataFrame, benchmark: DataFrame, share: float) -> DataFrame:
    """(text_key, doc_id, item_row, item_id, item_words, n_matched) of texts that hold items; the key is the text's MD5."""
    numbered = benchmark.select("item_id", "text").withColumn("item_row", F.monotonically_increasing_id())
    pieces = checkpointed(
        numbered.mapInArrow(_cut_items, "item_id bigint, item_row bigint, item_words int, piece int, start int, words array<bigint>, seeds array<struct<h: bigint, at: int>>").withColumn("piece_id", F.monotonically_increasing_id())
    )
    seeds = pieces.select("piece_id", F.explode("seeds").alias("seed")).select("piece_id", F.col("seed.h").alias("h"), F.col("seed.at").alias("item_at"))
    sizes = pieces.agg(
        F.coalesce(F.sum(F.size("seeds")), F.lit(0)).alias("n"), F.coalesce(F.max(F.size("words")), F.lit(1)).alias("reach"),
        F.sort_array(F.collect_set(F.when(F.col("item_words") < LEAST_WORDS, F.col("item_words")))).alias("short"),
    ).first()
    bits = min(MOST_FILTER_BITS, max(16, math.ceil(math.log2(64 * max(1, sizes.n)))))
    shared = documents.sparkSession.sparkContext.broadcast(_gathered_filter(seeds, bits))
    regions = documents.select("doc_id", "text").mapInArrow(_regions(shared, bits, sizes.reach, list(sizes.short)), "doc_id bigint, text_key string, base bigint, words array<bigint>, hits array<struct<h: bigint, at: int>>")
    regions = checkpointed(regions.withColumn("region_id", F.monotonically_increasing_id()))
    shared.destroy()
    hits = regions.select("region_id", F.explode("hits").alias("hit")).select("region_id", F.col("hit.h").alias("h"), F.col("hit.at").alias("at"))
    aligned = hits.join(seeds, "h").select("region_id", "piece_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    held = regions.select("region_id", "text_key", "doc_id", "base", F.col("words").alias("region_words"))
    # An alignment takes along the words beside its piece, not all of the stretch.
    place = F.col("shift") - F.col("base")
    aligned = aligned.join(held, "region_id").select(
        "piece_id", "text_key", "doc_id", F.least(place, F.lit(0)).alias("at"), F.slice("region_words", F.greatest(place, F.lit(0)).cast("int") + 1, F.lit(sizes.reach)).alias("doc_words")
    )
    aligned = aligned.join(pieces.drop("seeds"), "piece_id")
    compared = aligned.select(*_OWN, "piece", "start", "at", "words", "doc_words").mapInArrow(_compared(share), _COMPARED)
    best = compared.groupBy(*_OWN, "piece").agg(F.max("matched").alias("matched"), F.bit_or("low").alias("low"), F.bit_or("high").alias("high"), F.max("overlap").alias("overlap"))
    each = F.greatest(F.col("matched"), F.bit_count("low") + F.bit_count("high"))
    found = best.groupBy(*_OWN).agg(F.sum(each).alias("n_matched"), F.max("overlap").alias("overlap"))
    return found.filter((F.col("n_matched") >= share * F.col("item_words")) | F.col("overlap")).drop("overlap")


def contaminated(documents: DataFrame, benchmark: DataFrame, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_words, n_matched, similarity): documents that hold at least ``share`` of an item's words, or a long part of it.

    Words are runs of ASCII letters and digits and of bytes above ASCII, with A-Z lowered. Wherever a hit aligns an
    item with a document, words are compared in place; those that differ, or lie outside the document, do not
    match. ``n_matched`` counts the item's words in windows of ``LEAST_WORDS`` with ``share`` agreeing, united over
    all alignments, or those of the best alignment of each piece (of up to ``PIECE_WORDS``) if they are more. A
    window of ``LEAST_OVERLAP`` words with ``share`` agreeing is a leak however long the item. An item under
    ``LEAST_WORDS`` words must stand there unchanged, and one under ``LEAST_BYTES`` bytes be all of the document.
    Null and empty texts match nothing. Rows that repeat a doc_id (or an item_id) count as one document (item): the
    best of them counts; so do all rows without doc_id. Other columns are ignored.
    """
    found = _leaks(documents, benchmark, share).groupBy("doc_id", "item_id").agg(F.max_by(F.struct("item_words", "n_matched"), F.col("n_matched") / F.col("item_words")).alias("top"))
    return found.select(
        "doc_id", "item_id", F.col("top.item_words").cast("long").alias("n_words"), F.col("top.n_matched").alias("n_matched"), F.round(F.col("top.n_matched") / F.col("top.item_words"), 4).alias("similarity")
    )


def _gathered_filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """The filter of all seeds; made in tasks and joined here, so the driver holds filters of fixed size and no seeds."""

    def fill(batches):
        own = np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            own |= _filter(batch.column("h").to_numpy().view(np.uint64), bits)
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(1 << bits >> 3, np.uint8)
    for (own,) in seeds.select("h").coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        out |= np.frombuffer(bytes(own), np.uint8)
    return out


def clean(documents: DataFrame, benchmark: DataFrame, share: float = 0.8) -> DataFrame:
    """The rows of ``documents`` whose text holds no benchmark item, with all their columns. What counts is the text, so doc_ids may be null or repeat."""
    keys = checkpointed(_leaks(documents, benchmark, share).select(F.col("text_key").alias("_leaking_text")).distinct())
    return documents.join(small(keys), F.expr("md5(cast(text AS binary)) = _leaking_text"), "left_anti")
