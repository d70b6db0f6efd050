"""Intermediate results that several branches read, kept where every executor can read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which all executors must see.

    It is the one the cluster names in spark.checkpoint.dir. Only a local master, whose executors share the
    driver's disk, may do without; then a new local folder is taken.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
        if not shared and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the catalogue or the citations: never broadcast, so never gathered by the driver.

    Spark guesses sizes from compressed files, and records built from a small file are a hundred times larger.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by their keys to as many partitions as the session shuffles into, and to two for each core at least.

    For small rows that costly expressions follow: a table of one file part would else be one task's.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)
