"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures, verified on whole sets.

A signature has one slot for each of several hash functions: 12 bits that tell which shingle of the text has the
smallest hash. Two texts of Jaccard similarity s differ in each slot with probability 1 - s at most, so a bound on
the number of slots that differ, the signature distance, holds for all but a stated share of the pairs that are similar
enough. The join finds every pair within the distance: signatures are split into chunks of five slots, and by the
pigeonhole principle two signatures within the distance have a chunk with one wrong slot at most. Leaving out each
slot of each chunk in turn enumerates these errors: both have a key, the other four slots, in common. The distance
allows for one chunk more than that, so pairs that share a key share one of any other chunk too; a key that too many
texts share is cut by these.

Pairs that share a key are then held to the distance by their signatures alone, and verified by their whole sets.
Texts that are alike but not enough are many within the distance, as a short signature leaves room for chance. So where
texts of several groups share keys, their pairs are held to long signatures of single bits, of which similar texts
differ in half of what they do not share at most. Bits are compared inside the join, and a pair leaves it by the first
key it shares alone, so only close pairs do, and once.
"""

from __future__ import annotations

from functools import reduce
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import checkpointed
from .set_links import as_binary, grouped, of_nodes, set_names
from .text import U64, mix, ragged, shingle_sets, slices

#: Slots to a chunk, and how many of them may be wrong.
CHUNK, ERRORS = 5, 1
#: Bits to a slot: a chunk is one number of 60 bits.
SLOT = 12
#: Of each slot of a chunk all bits but the highest, and the highest.
_LOW = sum(((1 << (SLOT - 1)) - 1) << (SLOT * k) for k in range(CHUNK))
_HIGH = sum(1 << (SLOT * k + SLOT - 1) for k in range(CHUNK))
#: A pair that is just similar enough is outside the distance with this probability at most.
MISSED = 1e-7
#: Bits of the long signatures, and how many of them are compared first.
BITS, FIRST_BITS = 2048, 256
#: Signatures for less similar texts would be long.
LEAST_PERCENT = 70


def beyond(slots: int, differ: float, distance: int) -> float:
    """The probability that more than ``distance`` of the slots differ if each does with probability ``differ``."""
    ways = lambda k: lgamma(slots + 1) - lgamma(k + 1) - lgamma(slots - k + 1)
    return sum(exp(ways(k) + k * log(differ) + (slots - k) * log(1 - differ)) for k in range(distance + 1, slots + 1))


def distance_for(percent: int, missed: float = MISSED) -> tuple[int, int]:
    """(chunks, distance): the shortest signature, and the slots that may differ so that all but ``missed`` of the pairs are within."""
    if not LEAST_PERCENT <= percent <= 99:
        raise ValueError(f"percent goes from {LEAST_PERCENT} to 99")
    chunks = 3
    # With one chunk left out, the others still have one that holds ERRORS at most.
    while beyond(CHUNK * chunks, 1 - percent / 100, (ERRORS + 1) * (chunks - 1) - 1) > missed:
        chunks += 1
    return chunks, (ERRORS + 1) * (chunks - 1) - 1


def bits_for(percent: int, bits: int = BITS, missed: float = MISSED) -> int:
    """How many of so many bits may differ so that all but ``missed`` of the pairs that are similar enough are within."""
    distance = 0
    while beyond(bits, (1 - percent / 100) / 2, distance) > missed:
        distance += 1
    return distance


def _least(tokens: np.ndarray, begins: np.ndarray, slots: int, seed: int):
    """For each of so many hash functions, a hash of the token with the smallest one in each set (set after set, none empty)."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, (2, slots), dtype=np.uint64) | U64(1)
    for k in range(slots):
        yield mix(np.minimum.reduceat((tokens ^ factors[0, k]) * factors[1, k], begins))


def signatures(tokens: np.ndarray, begins: np.ndarray, chunks: int) -> np.ndarray:
    """A row of chunks for each set of 64-bit tokens (set after set); zeros for an empty one."""
    out = np.zeros((len(begins) - 1, chunks), np.uint64)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        for k, least in enumerate(_least(tokens, begins[full], CHUNK * chunks, 20260112)):
            out[full, k // CHUNK] |= (least >> U64(64 - SLOT)) << U64(SLOT * (k % CHUNK))
    return out


def _lists(rows: np.ndarray) -> pa.ListArray:
    return ragged(rows.reshape(-1), np.arange(0, rows.size, rows.shape[1]), np.full(len(rows), rows.shape[1]))


def _bits(n: int):
    """Long signatures, as lists of 64-bit numbers."""

    def sign(batches):
        for part in slices(batches):
            tokens, begins = shingle_sets(part.column("text"), n)
            out = np.zeros((part.num_rows, BITS // 64), np.uint64)
            full = np.flatnonzero(np.diff(begins))
            if len(full):
                for k, least in enumerate(_least(tokens, begins[full], BITS, 20260113)):
                    out[full, k // 64] |= (least & U64(1)) << U64(k % 64)
            yield pa.RecordBatch.from_arrays([as_binary(set_names(tokens, begins)), _lists(out)], ["node", "mark"])

    return sign


def _wrong(x: Column, y: Column) -> Column:
    """How many slots of two chunks differ: those that have any bit in which they do."""
    bits = x.bitwiseXOR(y)
    return F.bit_count((bits.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(bits).bitwiseAND(F.lit(_HIGH)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda n, x: n + x)


def _close(percent: int) -> Column:
    """Whether the long signatures a.mark and b.mark are near enough, a part of them first, then all, and no key before theirs is shared."""
    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    part = [differ(F.get("a.mark", F.lit(k)), F.get("b.mark", F.lit(k))) for k in range(FIRST_BITS // 64)]
    near = _sum(F.zip_with("a.mark", "b.mark", differ)) <= bits_for(percent)
    at, left = F.floor(F.col("a.key") / CHUNK).cast("int"), F.col("a.key") % CHUNK
    wrong = lambda k: _wrong(F.get("a.signature", k), F.get("b.signature", k))
    before = F.exists(F.slice(F.zip_with("a.signature", "b.signature", _wrong), F.lit(1), at), lambda n: n <= ERRORS)
    # A key cut by another is told from it by no place, and a chunk without an error has all its keys in common.
    first = F.col("a.key").isNull() | (((left == 0) | (wrong(at) > 0)) & ~before)
    return F.when(reduce(lambda x, y: x + y, part) <= bits_for(percent, FIRST_BITS), near & first).otherwise(False)


def chunk_keys(rows: np.ndarray) -> np.ndarray:
    """The keys of each signature, chunk by chunk: the slots of a chunk but one, named with their places."""
    keys = []
    for at in range(rows.shape[1]):
        for k in range(CHUNK):
            kept = rows[:, at] & ~U64(((1 << SLOT) - 1) << (SLOT * k))
            keys.append(mix(kept ^ mix(np.full(1, len(keys) + 1, np.uint64))))
    return np.stack(keys, axis=1)


def _signed(n: int, chunks: int):
    def sign(batches):
        for part in slices(batches):
            tokens, begins = shingle_sets(part.column("text"), n)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), pa.array(np.diff(begins), pa.int64()), as_binary(set_names(tokens, begins)), _lists(signatures(tokens, begins, chunks))],
                ["doc_id", "row", "n_shingles", "node", "signature"],
            )

    return sign


def _keyed(batches):
    for batch in batches:
        if batch.num_rows:
            rows = pa.concat_arrays([batch.column("signature")]).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), _lists(chunk_keys(rows))], ["id", "n", "keys"])


def _nodes(documents: DataFrame, n: int, chunks: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n_shingles, node) of ``documents`` (doc_id, text, row), and one row per distinct token set with its signature."""
    rows = checkpointed(documents.mapInArrow(_signed(n, chunks), "doc_id bigint, row bigint, n_shingles bigint, node binary, signature array<bigint>"))
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("lowest")
    nodes = rows.filter("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("n"), lowest, F.first("signature").alias("signature"))
    return rows.select("doc_id", "row", "n_shingles", "node"), checkpointed(nodes.withColumn("id", F.monotonically_increasing_id()))


def _key_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "n", "signature").mapInArrow(_keyed, "id bigint, n bigint, keys array<bigint>").select("id", "n", F.posexplode("keys").alias("key", "token"))


def _entries(nodes: DataFrame) -> DataFrame:
    """(token, id, n, key, place, times): the keys that at least two nodes have, with their numbers. Sets have no order here, so the place is 0."""
    keys = _key_rows(nodes).select("token", "id", "n", "key", F.lit(0).alias("place"))
    often = keys.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1")
    return checkpointed(keys.join(often, "token"))


def _finer(nodes: DataFrame):
    """Cuts hot keys once, by the keys of the other chunks."""

    def cut(k: int, held: DataFrame) -> DataFrame | None:
        if k > 1:
            return None
        keys = _key_rows(nodes).select("id", F.col("token").alias("other"), F.floor(F.col("key") / CHUNK).alias("chunk"))
        both = held.join(keys, "id").filter(F.col("chunk") != F.floor(F.col("key") / CHUNK))
        return both.withColumns({"token": F.xxhash64(F.least("token", "other"), F.greatest("token", "other")), "key": F.lit(None).cast("int")}).drop("other", "chunk")

    return cut


def _near(nodes: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """The pairs whose signatures differ in at most so many slots."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("signature").alias(f"{x}_signature"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_sum(F.zip_with("a_signature", "b_signature", _wrong)) <= distance).select("a", "b")


def candidates(documents: DataFrame, n: int = 5, percent: int = 85) -> DataFrame:
    """(a, b): the rows' doc_ids of all pairs of different sets within the signature distance. Grows with the square of a group; for tests and small tables."""
    chunks, distance = distance_for(percent)
    _, nodes = _nodes(documents.select("doc_id", "text", F.lit(0).cast("long").alias("row")), n, chunks)
    entries = _entries(nodes)
    pairs = entries.alias("x").join(entries.alias("y"), "token").filter("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    of = lambda x: nodes.select(F.col("id").alias(x), F.col("lowest.doc_id").alias(f"{x}_doc"))
    met = _near(nodes, pairs, distance).join(of("a"), "a").join(of("b"), "b")
    return met.select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b"))


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id that links of at least ``percent`` percent Jaccard similarity of the sets
    of n-word shingles reach, through any number of links; ``kept`` is true for that document. Words are runs of
    bytes other than ASCII white space, with A-Z lowered. A text of 1 to n - 1 words has one shingle; a null or
    empty one has none and links with nothing. Repeated rows stay, and so all rows with the kept doc_id are kept;
    rows without doc_id take part, and are kept only where a component has no other rows (its id is null then).
    Other columns are ignored. A link just at ``percent`` is missed with a probability of ``MISSED``, a closer one less.
    """
    chunks, distance = distance_for(percent)
    numbered = documents.select("doc_id", "text", F.lit(0).cast("long").alias("row"))
    rows, nodes = _nodes(numbered, n, chunks)
    entries = _entries(nodes)
    # The text whose keys most others share is nearest to the middle of its group, and makes the best hub.
    shared = entries.groupBy("id").agg(F.sum("times").cast("double").alias("weight"))
    weighed = checkpointed(nodes.join(shared, "id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))))

    def marked(ids: DataFrame) -> DataFrame:
        return of_nodes(numbered, nodes, ids, _bits(n), "mark", "array<bigint>").join(nodes.select("id", "signature"), "id")

    rows, lowest = grouped(numbered, rows, weighed, entries.drop("times"), n, percent, lambda pairs: _near(nodes, pairs, distance), _finer(nodes), marked, _close(percent))
    own = F.when(F.col("n_shingles") > 0, F.col("lowest.doc_id")).otherwise(F.col("doc_id"))
    return rows.join(lowest, "node", "left").select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
