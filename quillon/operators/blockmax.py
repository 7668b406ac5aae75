"""BM25 over stored block-max postings: blocks that cannot hold a top document are not read.

``build`` commits postings clustered by term and cut into blocks of documents in order,
packed, each with the most that its term adds to a score of any of its documents, but
for the term's weight in a question.

``top`` looks at the bounds first.  The shards of documents with the highest bounds give
every question a score that its k-th hit reaches at least.  Then, for each question and shard
of documents, the blocks of its terms cut the shard into stretches; a stretch whose
bounds sum to less than that score is passed over, and only blocks with a stretch left
are fetched and scored.  The answer is that of ``retrieval.lexical_top``.

Every row is a document; doc_ids should be unique, else rows rank by themselves.  Null
and empty texts are documents without words; nulls do not count in the mean length.  Ties: smaller doc_id.  No rows: no
hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as t
from quillon.operators import retrieval, versions
from quillon.operators.versions import staged

SHARD_BITS = 14  # documents of a shard: what a task holds of one question
SLACK = 2e-6  # more than scores lose when they are rounded
BLOCKS = "term string, shard long, block int, n int, first long, last long, gain double, docs binary, tfs binary, dls binary"


def build(docs: DataFrame, root: str, block: int = 128) -> int:
    """Commits an index of docs (doc_id, text) to root, in place of one that is there; returns the version."""
    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("doc_no", F.monotonically_increasing_id())
    with staged(ordered.select("doc_no", "doc_id", t.terms(F.col("text")).alias("w")), root) as rows:
        ids = versions.write(rows.select("doc_no", "doc_id", F.size("w").alias("dl")), root, "ids")
        avgdl = float(versions.rows(spark, root, ids).agg(F.avg("dl")).first()[0] or 1.0)
        shard = F.shiftright("doc_no", SHARD_BITS)
        posted = retrieval.in_place(rows.filter(F.size("w") > 0).select(shard.alias("shard"), "doc_no", F.size("w").alias("dl"), "w"), ["shard", "doc_no", "dl"]).withColumn("tf", F.col("tf").cast("int"))
        # a term of many documents is as many groups as shards
        cut = posted.repartition("term", "shard").sortWithinPartitions("term", "shard", "doc_no").mapInArrow(_blocks(block, avgdl), BLOCKS)
        blocks = versions.write(cut, root, "blocks")  # in that order
    return versions.replace(spark, root, [ids, blocks])


def _blocks(block: int, avgdl: float):
    """Rows of BLOCKS from postings in order of term, shard and document, all blocks of a batch at once."""
    names = [x.split(" ")[0] for x in BLOCKS.split(", ")]
    packed = lambda x, edge: pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])

    def rows(batch: pa.RecordBatch, edge: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        """Blocks from each edge to the next."""
        batch, at = batch.slice(0, int(edge[-1])), edge[:-1]
        doc, tf, dl = (batch.column(c).to_numpy() for c in ("doc_no", "tf", "dl"))
        gain = np.maximum.reduceat(_gain(tf.astype(np.float64), dl, avgdl), at)
        n = np.diff(edge)
        values = [batch.column("term").take(pa.array(at)), batch.column("shard").take(pa.array(at)), pa.array(k.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(doc[at]), pa.array(doc[edge[1:] - 1]), pa.array(gain)]
        return pa.RecordBatch.from_arrays([*values, *(packed(x, edge) for x in (doc, tf, dl))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, done = None, 0  # the last term's postings that are in no block yet, one at least, and its blocks before
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            term, shard = batch.column("term"), batch.column("shard").to_numpy()
            new = np.asarray(pc.not_equal(term.slice(1), term.slice(0, len(term) - 1))) | (shard[1:] != shard[:-1])
            start = np.concatenate(([0], np.flatnonzero(new) + 1))
            size = np.diff(np.append(start, len(shard)))
            blocks = -(-size // block)
            blocks[-1] -= 1  # its last one may go on in the next batch
            of = np.repeat(np.arange(len(start)), blocks)
            k = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            end = start[-1] + blocks[-1] * block
            if len(of):
                yield rows(batch, np.append(start[of] + k * block, end), k + np.where(of == 0, done, 0))
            done = int(blocks[-1]) + (done if len(start) == 1 else 0)
            rest = batch.slice(int(end))
        if rest is not None:
            yield rows(rest, np.array([0, rest.num_rows]), np.array([done]))

    return run


def top(spark: SparkSession, root: str, queries: DataFrame, k: int = K.CANDIDATES, at: int | None = None, first: int = 2) -> DataFrame:
    """query_id, doc_id, score, rank of the k best documents of each question (query_id, text).

    first: shards with the highest bounds that give the least score.
    """
    at = versions.version(spark, root) if at is None else at
    ids, blocks = versions.read(spark, root, "ids", at), versions.read(spark, root, "blocks", at)
    bounds = versions.kept(bounded(blocks, ids, queries))  # looked at twice
    left = surviving(bounds, least(blocks, bounds, k, first))
    best = scored(blocks, left, k)
    named = best.join(ids.select("doc_no", "doc_id"), "doc_no").select("query_id", "doc_id", "score")
    return retrieval.top(named, k, F.desc("score"), F.asc("doc_id"))


def bounded(blocks: DataFrame, ids: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, term, shard, block, first, last, n, bound, weight, avgdl: the blocks of each question's terms, without what they hold."""
    asked = queries.select("query_id", F.explode(t.terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    meta = blocks.select("term", "shard", "block", "n", "first", "last", "gain").join(asked.select("term").distinct(), "term", "left_semi")
    stats = ids.agg(F.count("*").alias("all"), F.avg("dl").alias("avgdl"))
    df = meta.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (F.col("qtf") * idf).alias("weight"), "avgdl")  # stats: one row
    return meta.join(asked, "term").select("query_id", "term", "shard", "block", "n", "first", "last", (F.col("weight") * F.col("gain")).alias("bound"), "weight", "avgdl")


def _gain(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (K.K1 + 1) / (tf + K.K1 * (1 - K.B + K.B * dl / avgdl))


def least(blocks: DataFrame, bounds: DataFrame, k: int, first: int) -> DataFrame:
    """query_id, least: a score that k documents reach, from the first shards by their bounds; zero if these hold fewer documents."""
    high = bounds.groupBy("query_id", "shard", "term").agg(F.max("bound").alias("bound")).groupBy("query_id", "shard").agg(F.sum("bound").alias("bound"))
    high = high.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "shard"))).filter(F.col("_n") <= first)
    hits = scored(blocks, bounds.join(high.select("query_id", "shard"), ["query_id", "shard"], "left_semi"), k)
    return hits.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("least"))


def _fetched(blocks: DataFrame, some: DataFrame) -> DataFrame:
    return some.select("query_id", "term", "shard", "block", "weight", "avgdl").join(blocks.select("term", "shard", "block", "docs", "tfs", "dls"), ["term", "shard", "block"])


def _held(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    doc = np.frombuffer(batch.column("docs")[i].as_py(), np.int64)
    tf, dl = (np.frombuffer(batch.column(c)[i].as_py(), np.int32).astype(np.float64) for c in ("tfs", "dls"))
    return doc, batch.column("weight")[i].as_py() * _gain(tf, dl, batch.column("avgdl")[i].as_py())


def surviving(bounds: DataFrame, least_: DataFrame) -> DataFrame:
    """The rows of bounds whose block has a stretch that can hold a document with the question's least score."""
    rows = bounds.join(least_, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    fields = bounds.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            query, shard = batch.column("query_id").to_pylist(), batch.column("shard").to_pylist()
            i = 0
            while i < batch.num_rows:
                j = i + 1
                while j < batch.num_rows and query[j] == query[i] and shard[j] == shard[i]:
                    j += 1
                if (query[i], shard[i]) != at and held:
                    yield _kept(held)
                    held = []
                at = query[i], shard[i]
                held.append(batch.slice(i, j - i))
                i = j
        if held:
            yield _kept(held)

    def _kept(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        first, last, bound = (rows.column(c).to_numpy() for c in ("first", "last", "bound"))
        # a term's blocks lie apart: the sum over all blocks that cover a place is the bound there
        edge = np.unique(np.concatenate((first, last + 1)))
        rise = np.zeros(len(edge))
        a, b = np.searchsorted(edge, first), np.searchsorted(edge, last + 1)
        np.add.at(rise, a, bound)
        np.add.at(rise, b, -bound)
        good = np.cumsum(rise) >= rows.column("least")[0].as_py() - SLACK
        before = np.concatenate(([0], np.cumsum(good)))
        return rows.filter(pa.array(before[b] > before[a])).select(fields)

    schema = bounds.schema
    return rows.repartition("query_id", "shard").sortWithinPartitions("query_id", "shard").select(*fields, "least").mapInArrow(run, schema)


def scored(blocks: DataFrame, left: DataFrame, k: int) -> DataFrame:
    """query_id, doc_no, score: of each question and shard the k best documents of the blocks that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def best() -> pa.RecordBatch:
            doc, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            score = np.round(np.bincount(where, weights=np.concatenate([h[1] for h in held])), 6)
            order = np.lexsort((doc, -score))[:k]
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(order), kind), pa.array(doc[order]), pa.array(score[order])], names=["query_id", "doc_no", "score"])

        for batch in batches:
            query, shard = batch.column("query_id").to_pylist(), batch.column("shard").to_pylist()
            kind = batch.schema.field("query_id").type
            for i in range(batch.num_rows):
                if (query[i], shard[i]) != at and held:
                    yield best()
                    held = []
                at = query[i], shard[i]
                held.append(_held(batch, i))
        if held:
            yield best()

    name = left.schema["query_id"].dataType.simpleString()
    rows = _fetched(blocks, left).repartition("query_id", "shard").sortWithinPartitions("query_id", "shard", "term", "block")
    return retrieval.top(rows.mapInArrow(run, f"query_id {name}, doc_no long, score double"), k, F.desc("score"), F.asc("doc_no")).drop("rank")
