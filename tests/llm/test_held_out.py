"""Learned operators on the held-out documents of the given tables, by their registered queries."""

import zlib

from pyspark.sql import functions as F

from citesieve.llm import queries

SF = "/root/testdata/sf0.01"


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_toxicity_ranks_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic IS NOT NULL").select("doc_id", "toxic")
    got = queries.op6_toxicity(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    scores = {True: [], False: []}
    for r in got:
        if r.held_out and r.doc_id in truth:
            scores[truth[r.doc_id] == 1].append(r.score)
    above = sum((a > b) + (a == b) / 2 for a in scores[True] for b in scores[False])
    assert above / (len(scores[True]) * len(scores[False])) > 0.75
    assert sum(s >= 0.3 for s in scores[False]) <= 0.02 * len(scores[False])
    assert sum(s >= 0.3 for s in scores[True]) >= 0.5 * len(scores[True])


def test_labels_of_held_out_documents_change_nothing(spark, tmp_path):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = lambda m: F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(m)) == (2 if m == 4 else 0)
    labels.withColumn("toxic", F.when(out(4), 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    documents.withColumns({"lang": F.when(out(5), "zz").otherwise(F.col("lang")), "source": F.lit("other")}).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda df: sorted((r.doc_id, *[round(x, 9) if isinstance(x, float) else x for x in r[1:]]) for r in df.collect())
    for query in (queries.op6_toxicity, queries.op8_language_id):
        assert key(query(spark, SF)) == key(query(spark, str(tmp_path)))


def test_languages_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang IS NOT NULL").collect()}
    got = queries.op8_language_id(spark, SF).collect()
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)
    asked = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(asked) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in asked) >= 0.98 * len(asked)
