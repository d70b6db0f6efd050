"""Surnames of one shape are no block: works meet citations of the same surname or of one a letter apart."""

from pyspark.sql import functions as F

from citesieve.functions import helpers
from citesieve.operators import candidates
from citesieve.sources.catalogue import as_works

LETTERS = str.maketrans("0123456789", "abcdefghij")


def test_surnames_of_one_shape_are_not_compared(spark):
    names = [f"Kar{100000 + 100 * k}".translate(LETTERS) for k in range(400)] + ["Wang", "Weng", "Castello", "Castillo", "Lindqvist", "Lindqwist"]
    held = [(f"x{k:04}", f"Measured effects of rings in trials of series {n}", n) for k, n in enumerate(names)]
    no = F.lit(None).cast("string")
    person = F.struct(F.lit("A.").alias("given"), F.col("name").alias("family"), no.alias("last"), no.alias("name"))
    works = as_works(spark.createDataFrame(held, "record_id string, title string, name string").withColumns({"source": F.lit("arXiv"), "authors": F.array(person)}).drop("name"))
    asked = [(k, t, n) for k, (_, t, n) in enumerate(held)]
    df = spark.createDataFrame(asked, "ref_id long, title string, name string").select("ref_id", "title", F.array("name").alias("authors"), F.lit(False).alias("uses_et_al"))
    same = {(k, w) for k, _, n in asked for w, _, m in held if helpers.same_surname(n, m)}
    met = [(r.ref_id, r.record_id) for r in candidates.title_pairs(df, works).select("ref_id", "record_id").collect()]
    assert len(met) == len(set(met)) and set(met) == same
    like = {k: [w for j, w in same if j == k and helpers.title_ratio(asked[k][1], held[int(w[1:])][1]) >= 0.9] for k, *_ in asked}
    got = {r.ref_id: r.record_id for r in candidates.title_search_unique(df, works).select("ref_id", "record.record_id").collect()}
    assert got == {k: w[0] for k, w in like.items() if len(w) == 1}
