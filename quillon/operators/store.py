"""Stored tables: schemas, upserts, deletes, statistics, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Declared tables, as DDL.
SCHEMAS = {
    "documents": "id string, filename string, file_path string, source string, language string, doc_type string, institution string, jurisdiction string, version string, date_document string, ocr_used boolean, status string, ingested_at timestamp, updated_at timestamp, extra_metadata string",
    "chunks": "id string, doc_id string, content string, chunk_index int, page int, token_count int, language string, chunk_strategy string, article_ref string, ingested_at timestamp, extra_metadata string",
    "sessions": "id string, user_id string, language string, profile_type string, created_at timestamp, last_active timestamp, extra_data string",
    "query_logs": "id string, session_id string, user_id string, query string, language string, profile string, intent string, plan string, retrieved string, response string, citations string, score_conf double, latency_ms double, model_used string, safety_flags array<string>, created_at timestamp",
    "audit_events": "id string, event_type string, session_id string, user_id string, payload_json string, is_flagged boolean, created_at timestamp",
}


def create(spark: SparkSession, prefix: str = "") -> None:
    for name, ddl in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({ddl}) USING parquet")


def drop(spark: SparkSession, prefix: str = "") -> None:
    for name in SCHEMAS:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}{name}")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with their key; of repeats in new the last by the other columns stays."""
    rest = [c for c in new.columns if c != key]
    last = new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in rest]))).filter("_n = 1").drop("_n")
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def delete(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def cascade(tables: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """The same documents gone from every table that knows them."""
    return {name: delete(df, ids, key) for name, df in tables.items()}


def dedup(files: DataFrame, content: str, id_: str) -> DataFrame:
    """One row for each content hash, with the smallest id and the number of copies."""
    return files.groupBy(F.sha2(F.col(content), 256).alias("content_hash")).agg(F.min(id_).alias(id_), F.count("*").alias("copies"))


def stats(files: DataFrame, folder: str, size: str) -> DataFrame:
    return files.agg(F.count_distinct(folder).alias("n_folders"), F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"))


def health(checks: DataFrame) -> DataFrame:
    """checks: name, status."""
    return checks.agg(F.when(F.bool_and(F.col("status") == "ok"), "ok").otherwise("degraded").alias("status"), F.count("*").alias("n_checks"))


def publish(df: DataFrame, path: str) -> None:
    """Written beside the place and renamed into it; the old table is renamed aside first and comes back if that fails.

    Between the two renames readers find no table; they never find a part of one.
    A table left aside by a writer that died in between is put back by the next call.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    staged, aside, final = (jvm.org.apache.hadoop.fs.Path(path + x) for x in (".staged", ".aside", ""))
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(aside) and not fs.exists(final):
        fs.rename(aside, final)
    df.write.mode("overwrite").parquet(f"{path}.staged")
    fs.delete(aside, True)
    had = fs.exists(final)
    if had and not fs.rename(final, aside):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(staged, final):
        if had:
            fs.rename(aside, final)
        raise OSError(f"{path} could not be replaced")
    fs.delete(aside, True)
