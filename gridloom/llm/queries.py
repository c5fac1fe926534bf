"""Registered queries of the text operators: thin digests over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontamination as overlap
from gridloom.llm import jaccard_join as jaccard
from gridloom.llm import personal_data as personal
from gridloom.llm import quality_rules as rules
from gridloom.llm.common import table

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).drop("failed_rule")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.digest(overlap.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.quality_model import quality_posteriors

    found = quality_posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("p_bad", 6).alias("p_bad"), F.round("p_toxic", 6).alias("p_toxic"), "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90)


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.line_templates import clean_lines

    rows, text, n_lines, n_dropped = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), F.col(text).alias("text"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.secret_scan import digest, secret_spans

    return digest(secret_spans(table(spark, sf_dir, "documents")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.token_counts import token_counts

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), TOKEN_LIMIT)
    return counts.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_chars"
    )


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.page_text import main_text

    text = main_text(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(personal.personal_spans(table(spark, sf_dir, "documents")))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.substring_dedup import digest

    return digest(table(spark, sf_dir, "documents"))


def op12_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.heap_clusters import clusters, digest

    return digest(*clusters(table(spark, sf_dir, "embeddings")))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.conversation_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_decontamination, op3_quality_model, op4_mixing, op5_jaccard_join, op6_line_templates, op7_secret_scan, op8_token_counts, op9_page_text, op10_personal_data, op11_substring_dedup, op12_heap_clusters, op13_conversation_trie)}
ORACLES: dict[str, str] = {"op1_quality_rules": rules.SQL, "op2_decontamination": overlap.SQL, "op5_jaccard_join": jaccard.SQL}
