"""Ingestion that persists: documents, chunks, vectors and postings of a batch, visible together, and search over them.

All tables live in one versioned store (``versions``): a batch adds segments and takes
older rows of its documents away, so its bytes follow the batch, not the store.  Chunks
are known by dense numbers, given in order of document and place; vectors, postings and
chunks meet by them, and the chunks table is the dictionary between numbers and keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import models
from quillon.functions import text as t
from quillon.operators import chunking, retrieval, versions

TABLES = ("documents", "chunks", "vectors", "postings")
ORDER = {"documents": ["doc_id"], "chunks": ["chunk_no"], "vectors": ["chunk_no"], "postings": ["term", "chunk_no"]}


def version(spark: SparkSession, root: str) -> int | None:
    return versions.version(spark, root)


def read(spark: SparkSession, root: str, name: str, at: int | None = None) -> DataFrame:
    return versions.read(spark, root, name, at)


def expire(spark: SparkSession, root: str, keep: int = 1) -> int:
    return versions.expire(spark, root, keep)


def compact(spark: SparkSession, root: str, least: int = 2) -> list[int]:
    """Makes one segment of each table that has least of them; returns the versions that did."""
    return [n for name in TABLES if (n := versions.compact(spark, root, name, least, ORDER[name])) is not None]


def persist(docs: DataFrame, root: str, strategy: str = "hybrid", load: Callable | None = None) -> int:
    """Cleans, describes and cuts docs (doc_id, text, lang) and commits four tables; documents ingested before are replaced.

    documents: metadata, ingested_at.  chunks: chunk_no, chunk_id, doc_id, content and
    place, n_terms, ingested_at.  vectors: chunk_no, doc_id, embedding (none for chunks
    without words).  postings: chunk_no, doc_id, dl, term, tf.  Vectors and postings are
    made from the chunks as numbered.  Blank and null texts leave no document.  Returns
    the version.  Any number of writers may commit at once; of two batches with one
    document the later version's stays.
    """
    spark = docs.sparkSession
    now = F.current_timestamp().alias("ingested_at")
    with versions.staged(chunking.cleaned(docs), root) as clean:  # cleaning is the dearest step and done once
        about = versions.write(chunking.described(clean).withColumn("ingested_at", now), root, "documents")
        cut = chunking.chunks(clean, strategy).withColumn("ingested_at", now)
        # in an order that a rerun would give too; the low bits of the row's id count a task's rows
        cut = cut.repartitionByRange("doc_id", "chunk_index").sortWithinPartitions("doc_id", "chunk_index").withColumn("row", F.monotonically_increasing_id())
        with versions.staged(cut.withColumn("w", t.terms(F.col("content"))), root) as rows:
            rows = rows.withColumn("task", F.shiftright("row", 33)).withColumn("n_terms", F.size("w"))
            sizes = rows.groupBy("task").agg(F.count("*").alias("n"))  # a row for each task
            first = versions.reserve(spark, root, "chunks", sizes.agg(F.sum("n")).first()[0] or 0)
            before = sizes.select("task", (F.sum("n").over(W.orderBy("task")) - F.col("n") + first).alias("first"))
            numbered = rows.join(F.broadcast(before), "task").withColumn("chunk_no", F.col("first") + F.col("row").bitwiseAND((1 << 33) - 1)).drop("row", "task", "first")
            chunks = versions.write(numbered.drop("w"), root, "chunks")
            vectors = numbered.select("chunk_no", "doc_id", models.embed(F.col("content"), load).alias("embedding")).filter("embedding is not null")
            vectors = versions.write(vectors, root, "vectors")
            posted = retrieval.in_place(numbered.select("chunk_no", "doc_id", F.col("n_terms").alias("dl"), "w"), ["chunk_no", "doc_id", "dl"])
            posted = versions.write(posted.sortWithinPartitions("term", "chunk_no"), root, "postings")
    return versions.commit(spark, root, [about, chunks, vectors, posted], docs.select("doc_id"))


def forget(spark: SparkSession, root: str, ids: DataFrame) -> int:
    """Commits a version without the documents ids (doc_id) in any table."""
    return versions.commit(spark, root, [], ids)


def search(spark: SparkSession, root: str, queries: DataFrame, k: int = K.TOP_K, candidates: int = K.CANDIDATES, filters: dict | None = None, load: Callable | None = None, at: int | None = None) -> DataFrame:
    """Hybrid search over what was ingested: the columns of retrieval.hybrid with chunk_no as its id, and of the chunk doc_id, chunk_id, chunk_index, content.

    queries: query_id, text.  filters: on the documents' columns, for both rankings.
    load: the embedder that persist() was given.  at: a version, else the latest.
    """
    at = version(spark, root) if at is None else at
    terms = t.terms(F.col("text"))
    documents, chunks, vectors = (read(spark, root, name, at) for name in TABLES[:3])
    # other terms go before deletes and filters are looked up
    postings = versions.read(spark, root, "postings", at, where=lambda df: retrieval.with_terms(df, queries, terms))
    if filters:
        ids = retrieval.matching(documents, filters).select("doc_id")
        chunks, vectors, postings = (df.join(ids, "doc_id", "left_semi") for df in (chunks, vectors, postings))
    tf = postings.select(F.col("chunk_no").alias("doc_id"), "dl", "term", "tf")
    sparse = retrieval.posted_top(tf, chunks.select(F.col("n_terms").alias("dl")), retrieval.asked_terms(queries, terms), candidates)
    asked = queries.select("query_id", models.embed(F.col("text"), load).alias("embedding"))
    dense = retrieval.dense_top(vectors.select(F.col("chunk_no").alias("vec_id"), "embedding"), asked, candidates)
    found = versions.kept(retrieval.confident(retrieval.fuse(dense, sparse, candidates), k).withColumnRenamed("doc_id", "chunk_no"))
    few = F.broadcast(found) if found.count() <= 100_000 else found
    # of the chunks, whose texts are wide, only those found are read on
    hit = versions.read(spark, root, "chunks", at, where=lambda df: df.join(few.select("chunk_no"), "chunk_no", "left_semi"))
    return few.join(hit.select("chunk_no", "doc_id", "chunk_id", "chunk_index", "content"), "chunk_no")


def lexical_index(docs: DataFrame, root: str, id_: str = "doc_id") -> int:
    """Commits postings (doc_id, row, dl, term, tf) and lengths (doc_id, dl of every document, without terms too); what had the same ids is replaced.  Texts are cut into terms once."""
    spark = docs.sparkSession
    with versions.staged(docs.select(F.col(id_).alias("doc_id"), F.monotonically_increasing_id().alias("row"), t.terms(F.col("text")).alias("w")), root) as rows:
        sized = rows.select("doc_id", "row", F.size("w").alias("dl"), "w")
        posted = retrieval.in_place(sized, ["doc_id", "row", "dl"])
        segments = [versions.write(sized.select("doc_id", "dl"), root, "lengths"), versions.write(posted.sortWithinPartitions("term"), root, "postings")]
    return versions.commit(spark, root, segments, docs.select(F.col(id_).alias("doc_id")))


def lexical_top(spark: SparkSession, root: str, queries: DataFrame, k: int) -> DataFrame:
    """retrieval.lexical_top from a stored index: only the questions' terms are read from it."""
    terms, at = t.terms(F.col("text")), version(spark, root)
    postings = versions.read(spark, root, "postings", at, where=lambda df: retrieval.with_terms(df, queries, terms))
    return retrieval.posted_top(postings, read(spark, root, "lengths", at).select("dl"), retrieval.asked_terms(queries, terms), k)


def save_files(files: DataFrame, root: str) -> DataFrame:
    """A file store: commits doc_id, filename, content with sizes and hashes, and returns doc_id, filename, path, size, content_hash.

    path is the stored file that holds the content.  A save writes its own files only; a
    file of the same document and name is replaced, of several in one batch the one with
    the greatest hash stays.  Null documents or names are names like others.
    """
    spark = files.sparkSession
    new = files.select("doc_id", "filename", "content", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("content_hash"), _file_key().alias("file_key"))
    best = new.select("file_key", "content_hash").groupBy("file_key").agg(F.max("content_hash").alias("content_hash"))
    one = new.join(best, ["file_key", "content_hash"], "left_semi").dropDuplicates(["file_key"])
    part = versions.write(one, root, "files")
    versions.commit(spark, root, [part], files.select(_file_key().alias("file_key")), "file_key")
    return versions.rows(spark, root, part, path=True).select("doc_id", "filename", "path", "size", "content_hash")


def _file_key() -> F.Column:
    return F.sha2(F.to_json(F.struct(F.col("doc_id").cast("string").alias("d"), F.col("filename").alias("f"))), 256)


def locate_files(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """doc_id, filename, path of the wanted (doc_id, filename); path, the stored file with the content, is null where there is no such file."""
    there = versions.read(spark, root, "files", path=True).select("file_key", "path")
    return wanted.select("doc_id", "filename").withColumn("file_key", _file_key()).join(there, "file_key", "left").drop("file_key")


def delete_files(spark: SparkSession, root: str, ids: DataFrame) -> int:
    """Commits a version without the files of the documents ids (doc_id)."""
    gone = read(spark, root, "files").select("doc_id", "file_key").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return versions.commit(spark, root, [], gone, "file_key")
