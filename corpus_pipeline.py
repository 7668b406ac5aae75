"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents.

In every stage: null and empty texts, repeated rows and null or repeated ids are
rows like others; ties go to the smallest id, then to the first row; very long texts
are whole; an empty table gives no rows.  docs may have further columns, also ones
that are named like an operator's results: they come out as they went in (all but
the last stage, which returns what the mix says and none of them).  n_chars follows
the text where docs has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, langid, minhash, mixing, suffix_dedup
from quillon.llm.common import checkpoint, table

LEAST_POSTERIOR = 0.3  # under this share no language is told from the others
LEAST_EXPLAINED = 0.5  # under this share of known words and n-grams the text is in none of the languages
PASSAGE_WORDS = 49  # passages of over fifty words, and those of which a word at each end differs by what it touches
ROW = "_row"  # key of a row within a stage
HIT_WORDS = 50  # longer benchmark passages go whatever their share
OWN = ["doc_id", "text", "lang", "source", "n_chars"]


def _apart(stage: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """stage of docs with columns beyond those of documents under names that no operator uses; the same columns come back."""
    aside = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
    back = {v: k for k, v in aside.items()}
    return stage(docs.withColumnsRenamed(aside)).select([aside.get(c, c) for c in docs.columns]).withColumnsRenamed(back)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the language found; documents without a language go: no letters (null and empty texts too), none told apart, or a script of none of them.

    The model learns from the rows that have a lang; where none has, all documents go.
    """

    def stage(df: DataFrame) -> DataFrame:
        found = langid.identify(df, langid.fit(df))
        kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_POSTERIOR) & (F.col("explained") >= LEAST_EXPLAINED))
        return kept.withColumn("lang", F.col("lang_pred"))

    return _apart(stage, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one row stays: that of the smallest id, null ids last.

    Rows, not ids, are grouped, so repeated and null ids count like others; texts
    without words are in no group and stay.  Row keys need docs that read the same
    each time: the pipeline checkpoints them.
    """
    keyed = docs.withColumn(ROW, F.monotonically_increasing_id())
    found = minhash.near_duplicates(keyed.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
    # sums of what each task has meet, not the rows of a group
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", ROW)
    stays = found.join(keyed.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return keyed.join(stays, ROW, "left_semi").select(docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words that stand elsewhere too are cut out, all copies of them; documents of which nothing is left go."""

    def stage(df: DataFrame) -> DataFrame:
        cut = suffix_dedup.dedup(df, length=PASSAGE_WORDS, out="text", unit="word")
        left = cut.filter((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
        return _with_text(left, F.col("n_removed") > 0, F.col("kept"))

    return _apart(stage, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of contaminated documents and of those with more than HIT_WORDS hit words; documents of which no word is left go."""

    def stage(df: DataFrame) -> DataFrame:
        found = decontaminate.decontaminate(df, table(spark, sf_dir, "benchmark"))
        left = decontaminate.remove_spans(found, max_words=HIT_WORDS)
        return _with_text(left, F.col("n_hit") > 0, F.col("text"))

    return _apart(stage, docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes and how many of their words, repeats counted."""
    return mixing.mix(docs).filter("taken > 0")


def _with_text(df: DataFrame, changed: F.Column, text: F.Column) -> DataFrame:
    if "n_chars" in df.columns:
        df = df.withColumn("n_chars", F.when(changed, F.length(text).cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.withColumn("text", F.when(changed, text).otherwise(F.col("text")))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing_sources),
]

# Near-duplicates and repeated passages have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
