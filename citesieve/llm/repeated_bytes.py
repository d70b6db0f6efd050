"""Remove bytes that stand in strings repeated anywhere in the corpus, by prefix-free parsing.

A rolling hash over the bytes sets triggers: the smallest hash among the places where a window may begin its
first half. Triggers depend on nothing outside the window, so equal windows have the same one, and they
cut a text into phrases: runs of windows with one trigger, with the bytes these cover. The parse of a corpus
is its sequence of phrases; the dictionary is the distinct phrases.

Phrases overlap by a window, so where a window begins in a phrase it also ends there, and its place in the
corpus order, to a window's depth, follows from two things. The parse tells how often the phrase comes: windows of
equal phrases are equal one by one, so a phrase that comes twice is settled whole. The suffix array of the dictionary
tells which windows of different phrases are equal: the suffixes of distinct phrases are ranked by their bytes, by
prefix doubling, and two that are neighbours with a common prefix of a window's length have one rank. Equal windows
share the bytes after the trigger, the core, so only phrases of one core are ranked together, and a core with one
phrase needs no ranks. A core with very many phrases is not ranked in one task: its windows are dealt in blocks of
neighbours by the bytes that all windows of a block share, so each block meets only those it can equal. Should still
very many have these bytes in common, the windows themselves are counted by 128-bit names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import checkpointed, let_go, small
from .text import _BASE, _BASE_INVERSE, _BYTE, U64, _power, mix, slices, utf8

#: Places of a window among which its trigger is; the hash there is of TRIGGER_BYTES bytes.
FIRST_HALF, TRIGGER_BYTES = 81, 32
#: A core, or a block, of more distinct phrases than this is not ranked within one task.
MOST_KINDS = 512
#: So many neighbouring windows are a block.
BLOCK = 9
#: Phrases of about so many bytes are ranked at once.
RANKED_BYTES = 2 << 20
#: Hashes modulo 2^64 of longer strings can be made to collide, so longer ones are refused.
LENGTHS = range(16, 801)
#: A text longer than this is parsed in overlapping parts.
PART_BYTES = 1 << 20
_PLACE_BITS = 22


class Rolling:
    """Hashes of any spans of some bytes."""

    def __init__(self, data: np.ndarray):
        self.down = _power("down", _BASE_INVERSE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power("up", _BASE, len(data) + 1)[:-1], out=self.sums[1:])

    def __call__(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[begins]) * self.down[begins] + (ends - begins).astype(np.uint64))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def phrases(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first window, last window, trigger, text, rolling hash) of every phrase; windows are named by their first byte."""
    half, wide = min(FIRST_HALF, length // 2 + 1), min(TRIGGER_BYTES, length - length // 2)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, None
    rolling = Rolling(data)
    at = np.arange(len(data) - wide + 1)
    hashes = rolling(at, at + wide)
    least = _sliding_least((hashes & ~U64((1 << _PLACE_BITS) - 1)) | at.astype(np.uint64), half)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    windows = np.arange(len(data) - length + 1)
    windows = windows[owner[: len(windows)] == owner[length - 1 :]]
    trigger = (least[windows] & U64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (np.diff(trigger) != 0) | (np.diff(windows) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1 if len(first) else first
    return windows[first], windows[last], trigger[first], owner[windows[first]], rolling


def _parts(data: np.ndarray, offsets: np.ndarray, length: int):
    """The texts as they are, or one long text in parts that share all but one byte of a window: (bytes, offsets, base)."""
    if len(data) <= PART_BYTES + 2 * length or len(offsets) > 2:
        yield data, offsets, 0
        return
    for base in range(0, len(data) - length + 1, PART_BYTES):
        part = data[base : base + PART_BYTES + length - 1]
        yield part, np.array([0, len(part)]), base


def _parse(length: int):
    """Each phrase: hash of what every window with the trigger holds, hash of the whole phrase, and its place."""
    half = min(FIRST_HALF, length // 2 + 1)

    def run(batches):
        for part in slices(batches, limit=PART_BYTES):
            whole, offsets = utf8(part.column("text"))
            for data, cuts, base in _parts(whole, offsets, length):
                first, last, trigger, owner, rolling = phrases(data, cuts, length)
                if not len(first):
                    continue
                core = rolling(trigger, trigger + length - half + 1)
                full = mix(rolling(first, last + length) + mix((trigger - first).astype(np.uint64)))
                begins = first - cuts[owner] + base
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), part.column("doc_id").take(pa.array(owner)), part.column("tag").take(pa.array(owner)), pa.array(begins, pa.int32()), pa.array(begins + (last - first), pa.int32())],
                    ["core", "phrase", "doc_id", "tag", "first", "last"],
                )

    return run


_OPENED = "core bigint, heavy boolean, doc_id bigint, tag bigint, first int, body binary"


def _opened(length: int):
    """The bytes of the phrases listed with each text."""

    def run(batches):
        for part in slices(batches, limit=PART_BYTES):
            whole, offsets = utf8(part.column("text"))
            lists = part.column("phrases")
            at = lists.offsets.to_numpy()
            # Arrow keeps the lists of a sliced batch in one array; the offsets say which part is ours.
            own = lists.values.slice(at[0], at[-1] - at[0])
            core, heavy, first, last = (own.field(k) for k in ("core", "heavy", "first", "last"))
            row = np.repeat(np.arange(part.num_rows), np.diff(at))
            begins = offsets[row] + first.to_numpy()
            ends = offsets[row] + last.to_numpy() + length
            body = [whole[b:e].tobytes() for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([core, heavy, part.column("doc_id").take(take), part.column("tag").take(take), first, pa.array(body, pa.binary())], ["core", "heavy", "doc_id", "tag", "first", "body"])

    return run


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The rank of every suffix by its first ``length`` bytes (zeros follow the end); equal ranks mean equal bytes."""
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    value = np.ndarray(len(data), ">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    have = 8
    while True:
        rank = np.unique(value, return_inverse=True)[1].astype(np.uint64)
        if have == length:
            return rank
        step = min(have, length - have)
        after = np.zeros_like(rank)
        after[: max(0, len(rank) - step)] = rank[step:] + U64(1)
        value = rank * U64(len(rank) + 1) + after
        have += step


def _runs(rows: pa.Table, length: int) -> pa.RecordBatch:
    """The runs of windows of these phrases that another of them has too."""
    data, offsets = utf8(rows.column("body"))
    n = np.diff(offsets) - length + 1
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ranks = suffix_ranks(data, length)[offsets[:-1][owner] + at]
    hit = np.flatnonzero((np.bincount(ranks.astype(np.int64)) > 1)[ranks.astype(np.int64)])
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0)
    begin = hit[new]
    end = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1] if len(hit) else hit
    take, first = pa.array(owner[begin]), rows.column("first").to_numpy()[owner[begin]]
    return pa.RecordBatch.from_arrays(
        [*(rows.column(c).combine_chunks().take(take) for c in ("doc_id", "tag")), pa.array(first + at[begin], pa.int32()), pa.array(first + at[end], pa.int32())],
        ["doc_id", "tag", "first", "last"],
    )


def _ranked(length: int):
    """Runs of windows that are repeated within a core (or the core of a block); rows come core by core."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < RANKED_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            same = pc.equal(rows.column("core"), rows.column("core")[-1]).to_numpy()
            cut = rows.num_rows - int(np.count_nonzero(np.cumprod(same[::-1])))
            if cut:
                yield _runs(rows.slice(0, cut), length)
            held = rows.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
        if held:
            yield _runs(pa.Table.from_batches(held), length)

    return run


def _blocks(length: int):
    """The windows of phrases in blocks by their distance to the trigger; the core of a block is a name of the bytes that all windows share."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data, offsets = utf8(part.column("body"))
                first, last, trigger, owner, _ = phrases(data, offsets, length)
                rows = {"core": [], "row": [], "first": [], "body": []}
                for low, high, t, k in zip(first.tolist(), last.tolist(), trigger.tolist(), owner.tolist(), strict=True):
                    for j in range((t - high) // BLOCK, (t - low) // BLOCK + 1):
                        near, far = max(j * BLOCK, t - high), min(j * BLOCK + BLOCK - 1, t - low)
                        shared = data[t - j * BLOCK : t - j * BLOCK - BLOCK + 1 + length].tobytes()
                        rows["core"].append(hashlib.blake2b(shared, digest_size=16, salt=j.to_bytes(8, "big")).digest())
                        rows["row"].append(k)
                        rows["first"].append(t - far - int(offsets[k]))
                        rows["body"].append(data[t - far : t - near + length].tobytes())
                take = pa.array(rows["row"], pa.int64())
                begins = pc.add(part.column("first").take(take), pa.array(rows["first"], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(rows["core"], pa.binary()), part.column("doc_id").take(take), part.column("tag").take(take), begins, pa.array(rows["body"], pa.binary())], ["core", "doc_id", "tag", "first", "body"])

    return run


def _named(length: int):
    """Every window of the phrases by a name of 128 bits."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = {"name": [], "row": [], "first": []}
                for k, (body, first) in enumerate(zip(part.column("body").to_pylist(), part.column("first").to_pylist(), strict=True)):
                    for i in range(len(body) - length + 1):
                        rows["name"].append(hashlib.blake2b(body[i : i + length], digest_size=16).digest())
                        rows["row"].append(k)
                        rows["first"].append(first + i)
                take = pa.array(rows["row"], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows["name"], pa.binary()), part.column("doc_id").take(take), part.column("tag").take(take), pa.array(rows["first"], pa.int32())], ["name", "doc_id", "tag", "first"])

    return run


def _removed(length: int):
    def run(batches):
        for part in slices(batches, limit=PART_BYTES):
            whole, offsets = utf8(part.column("text"))
            lists = part.column("spans")
            rows = {"n_removed": [], "kept": [], "removed": [], "kept_sha256": []}
            for k in range(part.num_rows):
                data = whole[offsets[k] : offsets[k + 1]]
                found = lists[k].values
                spans = []
                if found is not None and len(found):
                    first, last = (found.field(c).to_numpy().astype(np.int64) for c in ("first", "last"))
                    order = np.argsort(first, kind="stable")
                    first, ends = first[order], np.maximum.accumulate(last[order] + length)
                    new = np.append(True, first[1:] > ends[:-1])
                    cut = np.flatnonzero(new)
                    spans = list(zip(first[cut].tolist(), ends[np.append(cut[1:], len(first)) - 1].tolist(), strict=True))
                edges = [0, *(x for span in spans for x in span), len(data)]
                kept = b"".join(data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows["n_removed"].append(len(data) - len(kept))
                rows["removed"].append([{"from": a, "to": b} for a, b in spans])
                rows["kept"].append(kept)
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(rows["n_removed"], pa.int64()), pa.array([len(r) for r in rows["removed"]], pa.int64()), pa.array(rows["kept_sha256"], pa.string()), pa.array(rows["removed"], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(rows["kept"], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"],
            )

    return run


def _keyed(documents: DataFrame) -> DataFrame:
    """Rows known by doc_id and tag, a 64-bit hash of the text; a second such hash stands for a null doc_id."""
    text, none = F.coalesce("text", F.lit("")), F.col("doc_id").isNull()
    return documents.select(F.col("doc_id").alias("own_id"), F.when(none, F.xxhash64(F.lit("none"), text)).otherwise(F.col("doc_id")).alias("doc_id"), F.xxhash64(none, text).alias("tag"), "text")


def repeated_windows(documents: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, tag, spans): for each row the runs (first, last) of windows of ``length`` bytes that start somewhere else too.

    Rows are known as in ``_keyed``; rows that share doc_id and text are found at the same places. A list is
    as long as its own text at most.
    """
    if length not in LENGTHS:
        raise ValueError(f"strings have {LENGTHS.start} to {LENGTHS.stop - 1} bytes")
    texts = _keyed(documents).select("doc_id", "tag", "text").filter(F.octet_length("text") >= length)
    parse = texts.mapInArrow(_parse(length), "core bigint, phrase bigint, doc_id bigint, tag bigint, first int, last int")
    cores = parse.groupBy("core").agg(F.count("*").alias("times")).filter("times > 1").select("core")
    parse = checkpointed(parse.join(cores, "core"))
    dictionary = checkpointed(parse.groupBy("core", "phrase").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("doc_id", "tag", "first", "last")]))
    settled = parse.join(dictionary.filter("times > 1").select("core", "phrase"), ["core", "phrase"])
    settled = checkpointed(settled.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first", "last")).alias("spans")))
    several = dictionary.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("core", (F.col("kinds") > MOST_KINDS).alias("heavy"))
    listed = dictionary.join(several, "core").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("core", "heavy", "first", "last")).alias("phrases"))
    listed = checkpointed(listed)
    del parse, cores, dictionary, several  # their copies can go before the next step
    asked = texts.join(small(listed.select("doc_id", "tag")), ["doc_id", "tag"], "left_semi")
    # A row that comes twice is opened twice; all it has is repeated, so ranking it with itself says nothing wrong.
    opened = checkpointed(asked.join(listed, ["doc_id", "tag"]).mapInArrow(_opened(length), _OPENED))
    place = "doc_id bigint, tag bigint, first int"
    ranked = lambda df: df.repartition("core").sortWithinPartitions("core").mapInArrow(_ranked(length), place + ", last int")
    blocks = opened.filter("heavy").mapInArrow(_blocks(length), f"core binary, {place}, body binary")
    met = checkpointed(blocks.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("core", (F.col("kinds") > MOST_KINDS).alias("heavy")))
    blocks = checkpointed(blocks.join(met, "core"))
    found = ranked(opened.filter("NOT heavy")).unionByName(ranked(blocks.filter("NOT heavy")))
    windows = blocks.filter("heavy").mapInArrow(_named(length), f"name binary, {place}")
    again = windows.groupBy("name").agg(F.count("*").alias("times")).filter("times > 1").select("name")
    found = found.unionByName(windows.join(again, "name").select("doc_id", "tag", "first", F.col("first").alias("last")))
    found = checkpointed(found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    del opened, blocks, met, windows, again, asked, listed
    let_go(documents.sparkSession)
    return settled.union(found).groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_repeats(documents: DataFrame, length: int = 200) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed, kept.

    ``length`` is 16 to 800, else a ValueError is raised.

    A byte is removed if any string of ``length`` bytes that covers it starts anywhere else in the corpus
    too, in the same text or another; strings never cross texts and are judged on the input. ``removed``
    lists the maximal removed runs (from, to), ``kept`` is the remaining bytes, which need not be UTF-8. Null
    and empty texts have no bytes. Repeated rows stay, and remove one another's bytes. Other columns are ignored.
    """
    joined = _keyed(documents).join(repeated_windows(documents, length), ["doc_id", "tag"], "left").select(F.col("own_id").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(_removed(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<from: bigint, to: bigint>>, kept binary")
