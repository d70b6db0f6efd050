"""Small helpers that several of the operators share: shared folders, checked broadcasts and linked groups."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.staging import staged

#: Side tables up to this many bytes may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: What a value takes beside its bytes, and what a number takes.
_EACH = 16


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and copies that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder. Shuffle files and copies that only earlier steps needed are let go first."""
    let_go(df.sparkSession)
    return staged(df)


def _width(kind: T.DataType, value: Column) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.lit(_EACH) + F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(0).cast("long"), lambda n, x: n + _width(kind.elementType, x))
    if isinstance(kind, T.StructType):
        out = F.lit(_EACH).cast("long")
        for field in kind.fields:
            out = out + _width(field.dataType, value[field.name])
        return out
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(_EACH).cast("long") + F.coalesce(F.octet_length(value), F.lit(0))
    return F.lit(_EACH).cast("long")


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a (checkpointed) side table for broadcast if it takes at most ``limit`` bytes; else leave the join to shuffles."""
    width = F.lit(_EACH).cast("long")
    for field in df.schema.fields:
        width = width + _width(field.dataType, F.col(f"`{field.name}`"))
    taken = df.limit(limit // _EACH + 1).agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first().bytes
    return F.broadcast(df) if taken <= limit else df


def hashed_share(*columns: str) -> Column:
    """A number from 0 to 1 by the hash of some columns, for samples of any share, however small."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b); label is the smallest node reachable.

    Labels spread to neighbours and then jump to the label of the label, so long chains take few rounds.
    Every sum over a node's edges is combined before the shuffle and joins can be split, so one node may
    hold most edges. Each round is checkpointed.
    """
    both = checkpointed(edges.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = checkpointed(lower.join(of, "label").select("node", "old", F.least("label", "far").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels
