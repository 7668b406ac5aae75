"""The registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chat, decontaminate, divergence, hard_negatives, katz, langid, licenses, minhash, mixing, multi_index, suffix_dedup, token_counts, urls
from quillon.llm.common import crc_bucket, table


def op1_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_bucket("doc_id", 7) != 2).alias("train"))
    return katz.score(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_bucket("doc_id", 3) == 1).alias("held_out"))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs, model, keep=["doc_id", "held_out"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # repeated passages of over fifty words can be under 400 bytes: they are counted (49: a word at each end may differ by what it touches), not removed
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), keep=["doc_id"], passage=49)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "host string, path string, allow boolean")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_katz_score, op2_language_id, op3_token_counts, op4_suffix_dedup, op5_chat_format, op6_license_scan, op7_embedding_near_duplicates,
            op8_near_duplicates, op9_mix_sources, op10_decontaminate, op11_url_filter, op12_hard_negatives, op13_source_divergence,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": chat.SQL, "op9_mix_sources": mixing.SQL, "op10_decontaminate": decontaminate.SQL, "op11_url_filter": urls.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_source_divergence": divergence.SQL}
