"""Similarity self-join of texts on their word n-grams, filtered under several global token orders.

Two texts with Jaccard similarity of at least p percent must share a token among the first
n - ceil(p n / 100) + 1 tokens of both, whatever global order of the tokens is taken. The first order puts
rare tokens first; the others go by hashes and do not depend on it or on each other, so a pair that met by one
rare passage has to meet by chance again. A pair is a candidate only if it shares prefix tokens under every
order. The prefixes under the other orders are compared for the pairs that the first one leaves, before any
whole set is moved. What is left is verified exactly and joined to components, hub by hub (``set_links``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import checkpointed, small
from .set_links import as_binary, grouped, set_names, to_hubs
from .text import U64, mix, ragged, shingle_sets, slices

#: Token counts are kept in 2 ** COUNT_BITS cells at every size of corpus (4 MB); several tokens may share a cell.
COUNT_BITS = 19
CELLS_A_ROW = 1 << 13
#: Salts of the second, third, ... token order.
ORDER_SALTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def _count_cells(n: int):
    def count(batches):
        cells = np.zeros(1 << COUNT_BITS, np.int64)
        for part in slices(batches):
            tokens, _ = shingle_sets(part.column("text"), n)
            cells += np.bincount((tokens >> U64(64 - COUNT_BITS)).astype(np.int64), minlength=len(cells))
        for at in range(0, len(cells), CELLS_A_ROW):
            row = cells[at : at + CELLS_A_ROW]
            if row.any():
                yield pa.RecordBatch.from_pydict({"row": pa.array([at // CELLS_A_ROW], pa.int32()), "cells": pa.array([row.tobytes()], pa.binary())})

    return count


def _add_cells(group: pa.Table) -> pa.Table:
    total = np.zeros(CELLS_A_ROW, np.int64)
    for cells in group.column("cells"):
        total += np.frombuffer(cells.as_buffer(), np.int64)
    return pa.table({"row": group.column("row").slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})


def token_counts(documents: DataFrame, n: int) -> np.ndarray:
    """Counts of all tokens of all texts in a table of fixed size, added up in two steps of bounded fan-in."""
    parts = documents.select("text").mapInArrow(_count_cells(n), "row int, cells binary").withColumn("deal", F.spark_partition_id() % 256)
    schema = "row int, cells binary"
    summed = parts.groupBy("row", "deal").applyInArrow(_add_cells, schema).groupBy("row").applyInArrow(_add_cells, schema)
    cells = np.zeros(1 << COUNT_BITS, np.int64)
    for row, body in summed.toLocalIterator():
        cells[row * CELLS_A_ROW : (row + 1) * CELLS_A_ROW] = np.frombuffer(bytes(body), np.int64)
    return cells


def _ranked(tokens: np.ndarray, begins: np.ndarray, count: np.ndarray, order: int) -> np.ndarray:
    """The places of the tokens (each text's ascending), text after text, under global order 0, 1 or 2."""
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    return np.lexsort((count if order == 0 else mix(tokens ^ U64(ORDER_SALTS[order - 1])), owner))


def prefix_length(size, percent: int):
    """How many first tokens of a set of this size any partner must meet."""
    return size - -(-percent * size // 100) + 1


def _prefixes(n: int, percent: int, shared, orders: int):
    def prefix(batches):
        counts = shared.value
        for part in slices(batches):
            tokens, begins = shingle_sets(part.column("text"), n)
            sizes, count = np.diff(begins), counts[(tokens >> U64(64 - COUNT_BITS)).astype(np.int64)]
            lengths = np.where(sizes > 0, prefix_length(sizes, percent), 0)
            weight = np.zeros(len(sizes))
            if len(tokens):
                weight[sizes > 0] = np.add.reduceat(np.log2(1.0 + count), begins[:-1][sizes > 0]) / sizes[sizes > 0]
            first = ragged(tokens[_ranked(tokens, begins, count, 0)], begins[:-1], lengths)
            # Under the other orders 32 bits of a token will do: a filter may let more through, never less.
            others = [ragged((tokens[_ranked(tokens, begins, count, k)] >> U64(8)).astype(np.uint32), begins[:-1], lengths) for k in range(1, orders)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), pa.array(sizes, pa.int64()), as_binary(set_names(tokens, begins)), pa.array(weight), first, *others],
                ["doc_id", "row", "n_shingles", "node", "weight", "prefix", *(f"prefix{k}" for k in range(1, orders))],
            )

    return prefix


def _met_under_all(nodes: DataFrame, pairs: DataFrame, orders: int) -> DataFrame:
    """The pairs of nodes that share prefix tokens under the other orders too. Prefixes alone are moved, no whole set."""
    for k in range(1, orders):
        side = lambda x: nodes.select(F.col("id").alias(x), F.col(f"prefix{k}").alias(f"{x}_prefix"))  # noqa: B023, E731
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.arrays_overlap("a_prefix", "b_prefix")).select("a", "b")
    return pairs


def _nodes(documents: DataFrame, n: int, percent: int, orders: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n_shingles, node) of ``documents`` (doc_id, text, row), and one row per distinct token set with its prefixes."""
    shared = documents.sparkSession.sparkContext.broadcast(token_counts(documents, n))
    others = [f"prefix{k}" for k in range(1, orders)]
    schema = "doc_id bigint, row bigint, n_shingles bigint, node binary, weight double, prefix array<bigint>" + "".join(f", {c} array<int>" for c in others)
    rows = checkpointed(documents.mapInArrow(_prefixes(n, percent, shared, orders), schema))
    shared.destroy()
    kept = [F.first(c).alias(c) for c in ("weight", "prefix", *others)]
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("lowest")
    nodes = rows.filter("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("n"), lowest, *kept)
    nodes = checkpointed(nodes.withColumn("id", F.monotonically_increasing_id()))
    return rows.select("doc_id", "row", "n_shingles", "node"), nodes


def _entries(nodes: DataFrame) -> DataFrame:
    """(token, id, n, place): prefix tokens under the first order that at least two nodes have."""
    entries = nodes.select("id", "n", F.posexplode("prefix").alias("place", "token"))
    often = entries.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1").select("token")
    return checkpointed(entries.join(often, "token"))


def _finer(nodes: DataFrame, orders: int):
    """Cuts hot tokens by the prefix tokens of the next order."""

    def cut(k: int, held: DataFrame) -> DataFrame | None:
        if k >= orders:
            return None
        other = nodes.select("id", F.explode(f"prefix{k}").alias("other"))
        return held.join(other, "id").withColumn("token", F.xxhash64("token", "other")).drop("other")

    return cut


def _grouped(documents: DataFrame, n: int, percent: int, orders: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, row, n_shingles, node) of ``documents`` (doc_id, text, row), and for each node the lowest of its component."""
    rows, nodes = _nodes(documents, n, percent, orders)
    return grouped(documents, rows, nodes, _entries(nodes), n, percent, lambda pairs: _met_under_all(nodes, pairs, orders), _finer(nodes, orders))


def candidate_counts(documents: DataFrame, n: int = 5, percent: int = 80, orders: int = 3) -> list[int]:
    """How many pairs of a node and a hub are left under the first order, the first two, and so on."""
    _, nodes = _nodes(documents.select("doc_id", "text", F.lit(0).cast("long").alias("row")), n, percent, orders)
    pairs = checkpointed(to_hubs(_entries(nodes), nodes, percent))
    return [_met_under_all(nodes, pairs, k).count() for k in range(1, orders + 1)]


def similar_components(documents: DataFrame, n: int = 5, percent: int = 80, orders: int = 3) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id that links of at least ``percent`` percent Jaccard similarity
    reach, through any number of links. Words are runs of bytes other than ASCII white space, with A-Z
    lowered. A text of 1 to n - 1 words has one shingle; a null or empty one has none and links with nothing.
    Repeated rows stay, each with its component; rows without doc_id take part, and a component of such
    rows alone has a null id. Other columns are ignored. Tokens are 64-bit hashes.
    """
    rows, lowest = _grouped(documents.select("doc_id", "text", F.lit(0).cast("long").alias("row")), n, percent, orders)
    return rows.join(lowest, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("lowest.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_copies(documents: DataFrame, n: int = 5, percent: int = 80, orders: int = 3) -> DataFrame:
    """The rows of ``documents`` (doc_id, text, ...), of each component one: that with the smallest doc_id, those without one last.

    Rows are told apart even if they share doc_id and text. ``documents`` is read more than once and must then
    have its rows in the same order, as a table or a checkpoint has. Texts without words all stay.
    """
    numbered = documents.withColumn("_row", F.monotonically_increasing_id())
    rows, lowest = _grouped(numbered.select("doc_id", "text", F.col("_row").alias("row")), n, percent, orders)
    dropped = rows.filter("n_shingles > 0").join(lowest, "node").filter("row <> lowest.row").select(F.col("row").alias("_dropped"))
    return numbered.join(small(checkpointed(dropped)), F.expr("_row = _dropped"), "left_anti").drop("_row")


