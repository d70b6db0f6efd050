"""Shards of near-equal bytes by longest-processing-time scheduling.

Documents with equal texts stay together. Their groups, the largest first, go to the least-loaded shard
through a heap. Groups of one size are interchangeable, so the heap only needs how many groups there are of
each size: sizes that differ add up to the corpus, so there are at most sqrt(2 x bytes) of them, however
many groups. Spark counts the sizes, the heap splits each count among the shards, and Spark ranks the groups
of each size, in cells whose counts are added up in Spark too, and gives every group the shard of its rank.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import checkpointed, small

#: Groups of one size, and rows of one shard, are ranked in cells of about this many.
CELL_ROWS = 20_000


def schedule(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """Split runs (size, count) among the shards: (size, running totals of the count by shard).

    The runs must come by falling size. Each item of a run goes to the least-loaded shard, the lowest number
    of equal ones. Whole rounds are given at once to the shards within one item of the least, as long as none
    of them reaches a fuller one; so the steps of a run follow the shards, not the count.
    """
    heap = [(0, k) for k in range(shards)]
    out = []
    for size, count in runs:
        given = [0] * shards
        while count:
            if not size:
                given[heap[0][1]] += count
                break
            ranked = sorted(heap)
            level = [x for x in ranked if x[0] - ranked[0][0] <= size]
            rounds = count // len(level)
            if len(level) < shards:
                rounds = min(rounds, (ranked[len(level)][0] - 1 - level[-1][0]) // size + 1)
            if rounds > 0:
                heap = [(load + rounds * size, k) for load, k in level] + ranked[len(level) :]
                heapq.heapify(heap)
                for _, k in level:
                    given[k] += rounds
                count -= rounds * len(level)
                continue
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            given[k] += 1
            count -= 1
        out.append((size, [sum(given[: k + 1]) for k in range(shards)]))
    return out


def ranked(rows: DataFrame, group: str, by: str) -> DataFrame:
    """``rank`` from 0, without gaps, of the rows of each ``group``: by hashed cells of about CELL_ROWS rows, then by ``by`` (distinct in a group)."""
    counts = checkpointed(rows.groupBy(group).agg(F.ceil(F.count("*") / CELL_ROWS).alias("cells")))
    held = rows.join(small(counts), group).withColumn("cell", F.pmod(F.xxhash64(by), F.col("cells"))).drop("cells")
    sums = held.groupBy(group, "cell").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpointed(sums.select(group, "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    place = F.row_number().over(Window.partitionBy(group, "cell").orderBy(by))
    return held.withColumn("place", place).join(small(starts), [group, "cell"]).withColumn("rank", F.col("before") + F.col("place") - 1).drop("cell", "before", "place")


def sharded(documents: DataFrame, shards: int = 8, keep_text: bool = True) -> DataFrame:
    """All columns of ``documents`` (doc_id, text, ...) and size, text_crc32, shard, slot.

    ``size`` is the UTF-8 bytes of the text (none for null) plus 1, ``slot`` counts a shard's rows from 0
    without gaps. Null and empty texts are one group. Rows that repeat a doc_id, or all they have, are rows of
    their own. Columns of the input with the new names are replaced. An empty table gives an empty one. Groups
    and ranks are worked out on thin rows; without ``keep_text`` the text is left out of all shuffles.
    """
    documents = documents.drop("size", "text_crc32", "shard", "slot")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.withColumns({"size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body.cast("binary")), "_key": F.unhex(F.sha2(body, 256)), "_row": F.monotonically_increasing_id()})
    rows = checkpointed(rows if keep_text else rows.drop("text"))
    groups = checkpointed(rows.groupBy("_key").agg(F.sum("size").alias("bytes")))
    runs = sorted(((r.bytes, r.n) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).toLocalIterator()), reverse=True)
    plan = documents.sparkSession.createDataFrame(schedule(runs, shards), "bytes long, totals array<long>")
    dealt = ranked(groups, "bytes", "_key").join(small(plan), "bytes")
    dealt = dealt.select("_key", F.size(F.filter("totals", lambda t: t <= F.col("rank"))).alias("shard"))
    thin = checkpointed(rows.select("_row", "_key").join(dealt, "_key").select("_row", "shard"))
    placed = ranked(thin, "shard", "_row").select("_row", "shard", F.col("rank").alias("slot"))
    return rows.drop("_key").join(placed, "_row").drop("_row")
