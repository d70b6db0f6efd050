"""A training corpus in five stages: drop toxic and near-duplicate documents and benchmark leaks, mix sources, shard.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns all
columns of ``documents``; the last adds the shard and the slot in it. ``run`` applies them in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citesieve.llm import decontaminate, lpt_shards, ngram_join, poisson_mix, toxicity
from citesieve.llm.jobs import checkpointed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what scores under 0.3 with a model fitted on labelled documents (not on those held out, crc32 mod 4 = 2)."""
    labels = table(spark, sf_dir, "labels").filter("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) <> 2")
    return toxicity.kept(docs, toxicity.trained(docs, labels), threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by five-word shingles (Jaccard 0.8 or more) the one with the smallest doc_id stays."""
    return ngram_join.without_near_copies(docs, n=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose text holds 80 percent or more of a benchmark item, or 20 words in a row of which 80 percent are its."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), share=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet weights of the square root of their sizes."""
    return poisson_mix.replicated(docs, temperature=0.5, seed=7)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the copies to eight shards of near-equal bytes; equal texts share a shard."""
    return lpt_shards.sharded(docs, shards=8)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mixing_sources", mix_sources),
    ("sharding", shard),
]

#: Fitted models and linked groups have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
