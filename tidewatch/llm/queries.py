"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    alignment,
    conversations,
    decontaminate,
    embedding_dedup,
    html_text,
    language,
    line_dedup,
    mixing,
    quality,
    ring_shards,
    simhash,
    token_blocks,
    toxicity,
)
from tidewatch.llm.common import crc_mod, table

def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(n: int, rest: int):
    return F.coalesce(crc_mod("doc_id", n) == rest, F.lit(False))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that later occurrences of three-line windows cover."""
    found = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "text", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed_lines")
    )


def op1_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with windows of one and two lines of 50 words and more."""
    found = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"), passage_words=50)
    return found.select(
        F.col("id").alias("doc_id"), "text", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed_lines")
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from positive and unlabelled texts."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, crc_mod("doc_id", 5) != 0)
    scored = docs.select("doc_id", _held_out(5, 0).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def ratings(labels: DataFrame) -> DataFrame:
    """Graded ratings from the two labels: 0 poor, 1 sound but toxic, 2 sound and clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade")).where(
        "grade IS NOT NULL"
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document, and whether it is probably better than poor."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rated = ratings(labels.where("quality IS NOT NULL")).where(crc_mod("doc_id", 5) != 0)
    model = quality.learn(docs.select(F.col("doc_id").alias("id"), "text"), rated.withColumnRenamed("doc_id", "id"))
    graded = docs.select("doc_id", _held_out(5, 0).alias("held_out"), quality.grade(F.col("text"), model).alias("g"))
    return graded.select(
        "doc_id",
        "held_out",
        F.col("g.expected").alias("expected_grade"),
        F.col("g.tails")[0].alias("p_sound"),
        F.coalesce(F.col("g.tails")[0] >= 0.5, F.lit(True)).alias("kept"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings by label."""
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)
    return found.withColumnRenamed("id", "vec_id")


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to packed blocks and read back."""
    path = token_blocks.block_path(spark)
    token_blocks.write_blocks(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), path, end_id=1)
    return token_blocks.read_documents(spark, path).withColumnRenamed("id", "doc_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    found = mixing.epochs(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by code length."""
    docs = table(spark, sf_dir, "documents")
    rated = docs.where(crc_mod("doc_id", 4) != 2).select(F.col("doc_id").alias("id"), "text", "lang")
    model = language.train(rated)
    told = docs.select("doc_id", _held_out(4, 2).alias("held_out"), language.predict(F.col("text"), model).alias("p"))
    return told.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; counts are at most one apart."""
    keys = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    return ring_shards.assign(keys, 16).select(
        F.col("key").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap with benchmark items, by item."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "overlap_words", "best_equal")


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the winning paths of its host."""
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every damaged conversation."""
    return conversations.audit(table(spark, sf_dir, "conversations"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups of two tokenizers for every document, and how usual their links are in the corpus."""
    paths = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    aligned = alignment.align(table(spark, sf_dir, "documents"), *paths)
    digests = aligned.withColumn("groups_sha256", F.coalesce(F.sha2("groups", 256), F.lit(""))).drop("groups")
    return alignment.score(alignment.store(digests)).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op1_line_passages,
        op2_toxicity,
        op3_simhash,
        op4_quality,
        op5_embedding_dedup,
        op6_token_blocks,
        op7_mixing,
        op8_language,
        op9_ring_shards,
        op10_decontamination,
        op11_html_text,
        op12_conversations,
        op13_alignment,
    )
}
