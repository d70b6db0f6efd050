"""The registered queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_naming, chat_views, decontaminate, hamming_join, language_id, lpt_shards, ngram_join, periodic_runs, poisson_mix, repeated_bytes, spelling_variants, token_counts, toxicity
from .jobs import checkpointed, table


def _crc(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def op1_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat_views.rotated(table(spark, sf_dir, "conversations"))
    return views.select("conv_id", "speaker", "turn", "role", "name", F.md5("segment").alias("segment_md5"), "start", "trained_from", "trained_to")


def chat_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered dialogue of every conversation and speaker, and where it is trained on."""
    whole = chat_views.dialogues(chat_views.rotated(table(spark, sf_dir, "conversations")))
    spans = F.array_join(F.transform("trained", lambda t: F.concat_ws("-", t["from"].cast("string"), t["to"].cast("string"))), ",")
    return whole.select("conv_id", "speaker", F.md5("text").alias("text_md5"), spans.alias("trained"))


def op2_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.without_repeats(table(spark, sf_dir, "documents"), length=200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op4_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = lpt_shards.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8, keep_text=False)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = toxicity.scored(documents, toxicity.trained(documents, labels.filter(_crc(4) != 2)))
    return scores.select("doc_id", F.coalesce(_crc(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix.mixed(table(spark, sf_dir, "documents"), temperature=0.5, seed=7)
    return mixed.select("doc_id", "source", F.round("rate", 6).alias("rate"), "copies", "copy_no", "shuffle_key", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.trained(documents.filter(_crc(5) != 0))
    return language_id.predicted(documents, model).select("doc_id", F.coalesce(_crc(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_groups(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def altered_words(documents: DataFrame) -> DataFrame:
    """The words of whole texts, of which one in 97, by the CRC32 of doc_id and word, loses a letter. Rows without doc_id are not altered."""
    word = F.col("word")
    found = spelling_variants.words(documents).filter(F.length("word") >= 5)
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), word).cast("binary"))
    return found.select(F.when(h % 97 == 0, spelling_variants.without_letter(word, h % F.length(word))).otherwise(word).alias("word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = spelling_variants.word_counts(altered_words(table(spark, sf_dir, "documents")), least_letters=5, least_times=3)
    return spelling_variants.variants(checkpointed(vocabulary))


def op12_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_join.near_duplicates(table(spark, sf_dir, "documents"), n=5, percent=85)


def repeating(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) in which one in ten, by the CRC32 of its doc_id, repeats its words from some place on with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = documents.withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    placed = chosen.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("times", (g % 8 + 3).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((n - F.col("a")) / F.col("times"))).cast("int"))
    cycle = F.slice("words", F.col("a") + 1, F.col("p"))
    changed = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(F.array_repeat(cycle, F.col("times"))), F.lit(1), n - F.col("a")))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapsed(repeating(table(spark, sf_dir, "documents"))).withColumn("best", periodic_runs.strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_chat_views, op2_repeated_bytes, op3_token_counts, op4_lpt_shards, op5_decontaminate, op6_toxicity, op7_poisson_mix,
            op8_language_id, op9_block_naming, op10_ngram_join, op11_spelling_variants, op12_hamming_join, op13_periodic_runs, pipeline, chat_dialogues,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_views": chat_views.ORACLE_SQL, "chat_dialogues": chat_views.DIALOGUES_SQL, "op7_poisson_mix": poisson_mix.oracle_sql(0.5, 7), "op9_block_naming": block_naming.ORACLE_SQL}
