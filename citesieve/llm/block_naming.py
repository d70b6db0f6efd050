"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Every text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and numbered; then
adjacent numbers are paired, distinct pairs are sorted and numbered, and so on, until each document has one
number. Equal numbers (of the same level) mean equal texts and the other way round: nothing rests on a hash
being free of collisions. A 64-bit hash only routes blocks to their numbers, and the dictionary of distinct
blocks shows whether two blocks share a hash; if any do, the join compares those blocks themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import checkpointed

BLOCK_BYTES = 4096
#: Sorted ranges of names. A name is the range's number, then the place within it.
RANGES = 4096
_PLACE_BITS, _NAME_BITS = 44, 56


def _numbered(keys: DataFrame, range_of, *order: str) -> DataFrame:
    """Number distinct keys: sorted within ``RANGES`` even ranges."""
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)).cast("long")
    return keys.withColumn("range", range_of).withColumn("name", F.shiftleft(F.col("range"), _PLACE_BITS) + place).drop("range")


def identities(documents: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """(row_id, doc_id, text_sha256, identity), one row per row of ``documents``; equal texts have equal identities.

    ``hash_bits`` below 64 makes block hashes collide, for tests.
    """
    body = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")).withColumn("row_id", F.monotonically_increasing_id())
    blocks = body.select(
        "row_id", "doc_id", F.unhex(F.sha2("body", 256)).alias("sha"),
        F.posexplode(F.expr(f"transform(sequence(0, greatest(ceil(octet_length(body) / {block_bytes}), 1) - 1), i -> substring(body, cast(i * {block_bytes} + 1 as int), {block_bytes}))")).alias("i", "block"),
    ).withColumn("h", F.shiftrightunsigned(F.xxhash64("block"), 64 - hash_bits) if hash_bits < 64 else F.xxhash64("block"))
    distinct = blocks.groupBy("h", "block").agg(F.count("*").alias("times"))
    dictionary = checkpointed(distinct.groupBy("h").agg(F.count("*").alias("kinds")))
    high = F.shiftrightunsigned(F.xxhash64("h"), 52)
    if dictionary.filter("kinds > 1").isEmpty():
        names = _numbered(dictionary.select("h"), high, "h")
        named = blocks.drop("block").join(names, "h")
    else:
        names = _numbered(distinct.select("h", "block"), high, "h", "block")
        named = blocks.join(names, ["h", "block"])
    texts = _gathered(named)
    level, done = 0, None
    while True:
        texts = checkpointed(texts)
        ready = texts.filter(F.size("names") == 1).select("row_id", "doc_id", "sha", (F.lit(level << _NAME_BITS) + F.col("names")[0]).alias("identity"))
        done = ready if done is None else done.unionByName(ready)
        texts = texts.filter(F.size("names") > 1)
        if texts.isEmpty():
            break
        pairs = texts.select(
            "row_id", "doc_id", "sha",
            F.posexplode(F.expr("transform(sequence(0, cast((size(names) - 1) / 2 as int)), i -> struct(names[2 * i] as a, coalesce(get(names, 2 * i + 1), 0L) as b))")).alias("i", "pair"),
        ).select("row_id", "doc_id", "sha", "i", "pair.a", "pair.b")
        numbers = _numbered(pairs.select("a", "b").distinct(), F.shiftrightunsigned(F.xxhash64("a", "b"), 52), "a", "b")
        texts = _gathered(pairs.join(numbers, ["a", "b"]))
        level += 1
    return done.select("row_id", "doc_id", F.lower(F.hex("sha")).alias("text_sha256"), "identity")


def _gathered(named: DataFrame) -> DataFrame:
    """Each text's names in order; a list is as long as its own text."""
    return named.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"), F.first("sha").alias("sha"), F.expr("transform(array_sort(collect_list(struct(i, name))), x -> x.name)").alias("names")
    )


def exact_groups(documents: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the
    largest doc_id stays (a null doc_id is smaller than any), and of rows that repeat a doc_id too, one.
    Other columns are ignored. Whatever the size of a group, its largest doc_id and count are combined
    before the shuffle and joined back by a join that Spark can split.
    """
    rows = checkpointed(identities(documents, block_bytes, hash_bits))
    groups = rows.groupBy("identity").agg(F.max(F.struct("doc_id", "row_id")).alias("top"), F.count("*").alias("group_size"))
    return rows.join(groups, "identity").select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("top.row_id")).alias("kept"), "text_sha256"
    )


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
