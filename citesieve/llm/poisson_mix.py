"""Mix sources to target weights by Poisson replication, in DataFrame operations only.

Each source gets a mean repetition rate (its target share of all rows over its own rows). A document's count
is the inverse of the Poisson distribution function at a uniform number hashed from a seed and its doc_id,
so a run can be repeated and a lost task gives the same rows again. Documents are exploded by their counts,
dealt to partitions by another hash and sorted by it there, which shuffles the whole corpus in one exchange:
sorting all of it by ranges would draw every document a second time, to find the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import checkpointed, small

#: A rate above this is drawn as the sum of several equal parts; 64 steps then reach past the last bit of a double.
PART_RATE, STEPS = 16, 64


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """(source, rate): target share times all rows over the source's rows.

    Shares come from ``weights`` (sources without one get none), or else each source's row count to the
    power ``temperature``. Rows without a source are a source of their own, under the null.
    """
    counts = documents.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        wanted = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.expr("map('', 0.0D)")
        wanted = F.when(F.col("source").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_element_at(known, F.col("source")).cast("double"), F.lit(0.0)))
    counts = checkpointed(counts.withColumn("wanted", wanted))
    total = counts.agg(F.sum("n").alias("rows"), F.sum("wanted").alias("wanted")).first()
    if not total.wanted:
        return counts.select("source", F.lit(0.0).alias("rate"))
    return counts.select("source", (F.col("wanted") / F.lit(float(total.wanted)) * F.lit(total.rows) / F.col("n")).alias("rate"))


ADDED = ("rate", "copies", "copy_no", "shuffle_key")


def _drawn(documents: DataFrame, weights: dict[str, float] | None, temperature: float, seed: int) -> DataFrame:
    """(doc_id, text, source, rest, the columns added): the copies, shuffled; ``rest`` holds the other columns, whatever their names."""
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text", "source")]
    documents = documents.select("doc_id", "text", "source", (F.struct(*others) if others else F.lit(None)).alias("rest"))
    rates = source_rates(documents, weights, temperature).withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)))
    rates = rates.withColumn("mean", F.col("rate") / F.col("parts")).withColumn(
        "steps",
        F.expr(
            f"aggregate(sequence(1, {STEPS - 1}), struct(exp(-mean) as term, array(exp(-mean)) as sums), "
            "(s, k) -> struct(s.term * mean / k as term, concat(s.sums, array(element_at(s.sums, -1) + s.term * mean / k)) as sums)).sums"
        ),
    )
    rates = checkpointed(rates.select(F.col("source").alias("rate_source"), "rate", "parts", "steps"))
    identity = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    drawn = documents.join(small(rates), F.expr("source <=> rate_source")).withColumn("identity", identity)
    draw = lambda part: F.size(F.filter("steps", lambda s: s <= uniform(F.lit(str(seed)), F.col("identity"), part.cast("string"))))
    drawn = drawn.withColumn("copies", F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("parts")), F.lit(0), lambda n, part: n + draw(part)))
    out = drawn.filter("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), "identity", F.col("copy_no").cast("string"))))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select("doc_id", "text", "source", "rest", *ADDED)


def _own(documents: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``documents`` in their order, taken from what ``_drawn`` returns."""
    return [F.col(c) if c in ("doc_id", "text", "source") else F.col("rest").getField(c).alias(c) for c in documents.columns if c not in without]


def mixed(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, seed: int = 7) -> DataFrame:
    """All columns of ``documents`` and rate, copies, copy_no, shuffle_key; one row per copy, in shuffled order:
    which partition a copy is in, and where, follows from a hash alone.

    A document comes ``copies`` times, 0 or more, with copy_no from 1. Rows that repeat a doc_id get the
    same count; a row without doc_id draws by its text. Columns of the input with the new names are
    replaced. An empty table gives an empty one.
    """
    return _drawn(documents, weights, temperature, seed).select(*_own(documents, ADDED), *ADDED)


def replicated(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, seed: int = 7) -> DataFrame:
    """The rows of ``mixed`` with the columns of ``documents`` alone, each as it was."""
    return _drawn(documents, weights, temperature, seed).select(*_own(documents))


def oracle_sql(temperature: float = 0.5, seed: int = 7) -> str:
    return f"""
WITH counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {temperature}) AS wanted FROM documents GROUP BY source),
total AS (SELECT sum(n) AS all_rows, sum(wanted) AS all_wanted FROM counts),
rates AS (SELECT source, wanted / all_wanted * all_rows / n AS rate, greatest(ceil(wanted / all_wanted * all_rows / n / {PART_RATE}), 1)::BIGINT AS parts FROM counts, total),
steps AS (SELECT source, rate, parts, list_transform(range(0, {STEPS}), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-rate / parts) * pow(rate / parts, i) / gamma(i + 1)))) AS sums FROM rates),
drawn AS (
  SELECT d.doc_id, d.source, d.text, s.rate,
         list_sum(list_transform(range(1, s.parts + 1), lambda j: len(list_filter(s.sums, lambda c: c <= (('0x' || substr(md5('{seed}|' || d.doc_id || '|' || j), 1, 13))::BIGINT)::DOUBLE / {float(1 << 52)}))))::INTEGER AS copies
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, round(rate, 6) AS rate, copies, c::INTEGER AS copy_no, md5('{seed}-order|' || doc_id || '|' || c) AS shuffle_key, md5(coalesce(text, '')) AS text_md5
FROM drawn, unnest(range(1, copies + 1)) AS u(c)
"""
