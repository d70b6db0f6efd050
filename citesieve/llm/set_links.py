"""Links between token sets from candidate keys: verified by whole sets, joined to components, no pair lost.

Texts with the same token set are one node. An entry (token, id, n, place) says that a node of n tokens has a key,
``token``, that every similar enough partner has too under one of its keys. Many near copies share the same
keys, so all pairs would be quadratic: first each node is paired with one hub for each key it shares, and what verifies
is joined into components; then only pairs across components are left to try. A pair inside a component cannot
change the components, so none that matters is left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import checkpointed, components, small
from .text import U64, mix, ragged, shingle_sets, slices

#: Set sizes within 4 percent are of one class; only classes that can link are joined.
CLASS_BASE = 1.04
#: Rows with marks are wide, so their classes are coarser, and a row is dealt to three or four of them.
MARKED_BASE = 1.18
#: A key with more pairs to try across components is cut by further keys.
HOT_PAIRS = 1 << 24


def set_names(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """128 bits for each token set."""
    out = np.zeros((len(begins) - 1, 2), np.uint64)
    full = np.diff(begins) > 0
    if full.any():
        at = begins[:-1][full]
        out[full, 0] = np.add.reduceat(mix(tokens), at)
        out[full, 1] = np.add.reduceat(mix(tokens ^ U64(0xD6E8FEB86659FD93)), at)
    return out


def as_binary(names: np.ndarray) -> pa.Array:
    body = np.ascontiguousarray(names.astype(">u8")).view("S16").reshape(-1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(body), [None, pa.py_buffer(body.tobytes())]).cast(pa.binary())


def _sets(n: int):
    def read(batches):
        for part in slices(batches):
            tokens, begins = shingle_sets(part.column("text"), n)
            yield pa.RecordBatch.from_arrays([as_binary(set_names(tokens, begins)), ragged(tokens, begins[:-1], np.diff(begins))], ["node", "tokens"])

    return read


def _verified(percent: int):
    def lists(column):
        return column.values.to_numpy().view(np.uint64), np.diff(column.offsets.to_numpy().astype(np.int64))

    def verify(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = pa.RecordBatch.from_struct_array(pa.concat_arrays([batch.slice(at, 256).to_struct_array()]))
                (x, x_sizes), (y, y_sizes) = (lists(part.column(c)) for c in ("a_tokens", "b_tokens"))
                row = np.arange(part.num_rows)
                both, owner = np.concatenate([x, y]), np.concatenate([np.repeat(row, x_sizes), np.repeat(row, y_sizes)])
                order = np.lexsort((both, owner))
                both, owner = both[order], owner[order]
                met = np.bincount(owner[1:][(both[1:] == both[:-1]) & (owner[1:] == owner[:-1])], minlength=part.num_rows)
                keep = 100 * met >= percent * (x_sizes + y_sizes - met)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))

    return verify


def of_nodes(documents: DataFrame, nodes: DataFrame, wanted: DataFrame, read: Callable, column: str, kind: str) -> DataFrame:
    """(id, column) of the nodes ``wanted`` (id): what ``read`` makes of the texts of ``documents``, as (node, column)."""
    asked = checkpointed(nodes.select("id", "node", F.col("lowest.doc_id").alias("doc_id")).join(wanted, "id"))
    ids = asked.select(F.col("doc_id").alias("wanted_id")).distinct()
    texts = documents.select("doc_id", "text").join(small(ids), F.expr("doc_id <=> wanted_id"), "left_semi")
    made = texts.select("text").mapInArrow(read, f"node binary, {column} {kind}").groupBy("node").agg(F.first(column).alias(column))
    return checkpointed(made.join(asked.select("id", "node"), "node").select("id", column))


def exact_links(documents: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The candidates (a, b) that are similar enough, by their whole sets."""
    sets = of_nodes(documents, nodes, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), _sets(n), "tokens", "array<bigint>")
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("a_tokens"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("b_tokens"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "a_tokens", "b_tokens")
    return checkpointed(met.mapInArrow(_verified(percent), "a bigint, b bigint"))


def to_hubs(entries: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Each node with the hub of each of its prefix tokens, if places and sizes leave room for enough shared tokens."""
    hubs = entries.join(nodes.select("id", "weight"), "id").groupBy("token").agg(F.max(F.struct("weight", "n", "id", "place")).alias("hub"))
    return entries.join(hubs, "token").filter(
        f"hub.id <> id AND {100 + percent} * least(n - place, hub.n - hub.place) >= {percent} * (n + hub.n)"
    ).select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct()


def grouped(documents: DataFrame, rows: DataFrame, nodes: DataFrame, entries: DataFrame, n: int, percent: int, met: Callable, finer: Callable, marked: Callable | None = None, close: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, row, n_shingles, node) of ``documents`` (doc_id, text, row), and for each node the lowest of its component.

    ``nodes`` has id, node, weight (the largest makes a hub) and lowest; ``met(pairs)`` keeps the pairs (a, b) that a
    cheap test lets pass, and ``finer(k, entries)`` gives entries under the k-th further key, or None. Pairs across
    components are met under ``close`` alone, a condition on entries a and b with the columns that ``marked(ids)`` adds by id.
    """
    pairs = checkpointed(met(checkpointed(to_hubs(entries, nodes, percent))))
    labels = components(exact_links(documents, nodes, pairs, n, percent))
    rest = checkpointed(met(_across(entries, labels, percent, finer, marked, close)))
    if not rest.isEmpty():
        links = exact_links(documents, nodes, rest, n, percent)
        # Only links between components are new: these are the nodes of a much smaller graph.
        of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
        between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
        merged = components(between).select(F.col("node").alias("label"), F.col("label").alias("lower"))
        labels = nodes.select(F.col("id").alias("node")).join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        labels = labels.join(merged, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    labelled = nodes.select("id", "node", "lowest").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    lowest = labelled.groupBy("label").agg(F.min("lowest").alias("lowest"))
    return rows, labelled.select("node", "label").join(lowest, "label").select("node", "lowest")


def _mixed(entries: DataFrame) -> DataFrame:
    """(token, main, pairs) of the tokens that stand in several components: the one with most entries, and how many pairs are to be tried."""
    sums = entries.groupBy("token", "label").agg(F.count("*").alias("times")).groupBy("token")
    sums = sums.agg(F.max(F.struct("times", "label")).alias("most"), F.count("*").alias("kinds"), F.sum("times").alias("all")).filter("kinds > 1")
    return sums.select("token", F.col("most.label").alias("main"), (F.col("all").cast("double") * (F.col("all") - F.col("most.times"))).alias("pairs"))


def _across(entries: DataFrame, labels: DataFrame, percent: int, finer: Callable, marked: Callable | None = None, close: Column | None = None) -> DataFrame:
    """Pairs that share keys, could still be similar enough, and stand in different components.

    For each token the component with most entries is not joined with itself: the other entries meet all
    entries. They are dealt by the token and a narrow class of set size, to the classes that can link. A
    token with too many pairs gives way to the pairs of it and a further key, one of which a similar partner
    must share as well, so it is cut into smaller parts and loses nothing.
    """
    held = checkpointed(entries.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id")))
    tokens = checkpointed(_mixed(held))
    for k in itertools.count(1):
        hot = tokens.filter(F.col("pairs") > HOT_PAIRS).select("token")
        if hot.isEmpty() or (cut := finer(k, held.join(hot, "token"))) is None:
            break
        held = checkpointed(held.join(hot, "token", "left_anti").unionByName(cut))
        tokens = checkpointed(_mixed(held))
    as_class = lambda c: F.floor(F.log(F.greatest(c, F.lit(1)).cast("double")) / F.log(F.lit(CLASS_BASE if marked is None else MARKED_BASE)))
    held = checkpointed(held.join(tokens.drop("pairs"), "token").withColumn("class", as_class(F.col("n"))))
    # Marks are joined to the entries where these meet, and no copy of them is kept for each key.
    marks = None if marked is None else marked(held.select("id").distinct())
    wide = lambda df: df if marks is None else df.join(marks, "id")
    # A partner of b tokens needs min(n - place, ...) >= percent (n + b) / (100 + percent), so b has an upper and a lower bound.
    high = F.floor((100 + percent) * (F.col("n") - F.col("place")) / percent - F.col("n"))
    low = F.ceil(F.col("n") * percent / 100)
    side = held.filter("label <> main").withColumn("high", F.least(high, F.floor(F.col("n") * 100 / percent))).withColumn("low", low).filter("high >= low")
    left = wide(side).withColumn("class", F.explode(F.sequence(as_class(F.col("low")), as_class(F.col("high"))))).alias("a")
    enough = F.expr(f"a.label <> b.label and {100 + percent} * least(a.n - a.place, b.n - b.place) >= {percent} * (a.n + b.n)")
    pairs = left.join(wide(held).alias("b"), ["token", "class"]).filter(enough if close is None else enough & close)
    return checkpointed(pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct())
