"""Perspective rotation of many-party dialogues.

For every participant of a conversation the dialogue is rendered once, with that participant as the
assistant, all others as named users and the system turns as they are. Only the assistant's own words, and
the mark that ends them, are trained on. Marks begin with ``<|``, which in words and names is written ``<||``,
so no text can pass for a turn and every text can be had back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation are summed in cells of so many turn numbers, so a long one is not one task.
CELL_TURNS = 256
BEGIN, END = "<|turn|>", "<|end|>"


def escaped(col: Column) -> Column:
    return F.replace(col, F.lit("<|"), F.lit("<||"))


def rotated(conversations: DataFrame) -> DataFrame:
    """One row per participant and turn: conv_id, speaker, turn, role, name, segment, start, trained_from, trained_to.

    The segments of one conv_id and speaker, by ``start``, are the rendered dialogue; ``start`` is the
    segment's first character in it. ``trained_from`` and ``trained_to`` bound the characters of the dialogue
    to train on, and are null in segments of others. Turns are ordered by turn (null first), then role, then
    text; rows that repeat stay, one after the other. A null role is a participant named unknown, a null text
    is empty. A row without conv_id is a conversation of one turn, so strangers never meet. A conversation with
    system turns alone has no participant and gives no row. Names are on one line. Other columns are ignored.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("by"), F.coalesce("text", F.lit("")).alias("said"))
    known = turns.filter("conv_id IS NOT NULL")
    speakers = known.filter("by <> 'system'").select("conv_id", F.col("by").alias("speaker")).distinct()
    views = _segments(known.join(speakers, "conv_id")).withColumn("cell", F.floor(F.coalesce("turn", F.lit(-1)) / CELL_TURNS))
    within = Window.partitionBy("conv_id", "speaker", "cell").orderBy(F.asc_nulls_first("turn"), "by", "said").rowsBetween(Window.unboundedPreceding, -1)
    cells = views.groupBy("conv_id", "speaker", "cell").agg(F.sum(F.length("segment")).alias("chars"))
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = cells.select("conv_id", "speaker", "cell", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("base"))
    views = views.withColumn("before", F.coalesce(F.sum(F.length("segment")).over(within), F.lit(0)))
    views = views.join(begins, ["conv_id", "speaker", "cell"]).withColumn("start", F.col("base") + F.col("before"))
    alone = _segments(turns.filter("conv_id IS NULL AND by <> 'system'").withColumn("speaker", F.col("by"))).withColumn("start", F.lit(0).cast("long"))
    columns = [
        "conv_id", "speaker", "turn", "role", "name", "segment", "start",
        F.when(F.col("own"), F.col("start") + F.length("head")).alias("trained_from"),
        F.when(F.col("own"), F.col("start") + F.length("segment") - 1).alias("trained_to"),
    ]
    return views.select(*columns).unionByName(alone.select(*columns))


def _segments(views: DataFrame) -> DataFrame:
    """Turns (by, said) as a ``speaker`` sees them: own, role, name, head, segment."""
    views = views.withColumn("own", F.expr("by = speaker"))
    views = views.withColumn("role", F.expr("CASE WHEN own THEN 'assistant' WHEN by = 'system' THEN 'system' ELSE 'user' END"))
    views = views.withColumn("name", F.when(F.col("role") == "user", F.translate(escaped(F.col("by")), "\n\r", "  ")))
    views = views.withColumn("head", F.concat(F.lit(BEGIN), "role", F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), "name")).otherwise(F.lit("")), F.lit("\n")))
    return views.withColumn("segment", F.concat("head", escaped(F.col("said")), F.lit(END + "\n")))


def dialogues(views: DataFrame) -> DataFrame:
    """One row per conv_id and speaker: the rendered text and the (from, to) spans to train on. A row is one dialogue.

    Turns without conv_id, each a dialogue of its own, are rendered by ``rotated`` alone and left out here.
    """
    views = views.filter("conv_id IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("start", "segment", "trained_from", "trained_to")))
    return views.groupBy("conv_id", "speaker").agg(parts.alias("parts")).select(
        "conv_id", "speaker",
        F.expr("array_join(transform(parts, p -> p.segment), '')").alias("text"),
        F.expr("transform(filter(parts, p -> p.trained_from IS NOT NULL), p -> struct(p.trained_from AS `from`, p.trained_to AS `to`))").alias("trained"),
    )


VIEWS_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS by_, coalesce(text, '') AS said, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations),
speakers AS (SELECT DISTINCT conv_id, lone, by_ AS speaker FROM turns WHERE by_ <> 'system'),
views AS (
  SELECT t.conv_id, t.lone, s.speaker, t.turn, t.by_, t.said, t.by_ = s.speaker AS own,
         CASE WHEN t.by_ = s.speaker THEN 'assistant' WHEN t.by_ = 'system' THEN 'system' ELSE 'user' END AS role
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.lone IS NOT DISTINCT FROM s.lone),
named AS (SELECT *, CASE WHEN role = 'user' THEN translate(replace(by_, '<|', '<||'), chr(10) || chr(13), '  ') END AS name FROM views),
heads AS (SELECT *, '{BEGIN}' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM named),
segments AS (SELECT *, head || replace(said, '<|', '<||') || '{END}' || chr(10) AS segment FROM heads),
placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, lone, speaker ORDER BY turn NULLS FIRST, by_, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM segments)
"""
ORACLE_SQL = f"""{VIEWS_SQL}
SELECT conv_id, speaker, turn, role, name, md5(segment) AS segment_md5, start,
       CASE WHEN own THEN start + length(head) END AS trained_from, CASE WHEN own THEN start + length(segment) - 1 END AS trained_to
FROM placed
"""
DIALOGUES_SQL = f"""{VIEWS_SQL}
SELECT conv_id, speaker, md5(string_agg(segment, '' ORDER BY start)) AS text_md5,
       coalesce(string_agg(CASE WHEN own THEN (start + length(head)) || '-' || (start + length(segment) - 1) END, ',' ORDER BY start), '') AS trained
FROM placed WHERE conv_id IS NOT NULL GROUP BY conv_id, speaker
"""
