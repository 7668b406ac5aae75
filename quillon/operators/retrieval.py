"""Set-based retrieval: lexical and dense top-k, fusion, reranking, filters.

Every operator takes all questions at once, keyed by query_id, and returns explicit
ranks; row order never carries meaning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import constants as K
from quillon.functions import questions as q
from quillon.functions import text as t
from quillon.operators import versions


def matching(df: DataFrame, filters: dict | None) -> DataFrame:
    """Scalars by equality, lists by membership, all of them; reaches the scan."""
    cond = F.lit(True)
    for name, value in (filters or {}).items():
        cond = cond & (F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df.filter(cond) if filters else df


def top(df: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """Rows of rank 1 to k; Spark cuts each partition to k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


# ---------------------------------------------------------------- lexical


def postings(docs: DataFrame, terms: Column, id_: str = "doc_id") -> DataFrame:
    """doc_id, row, dl, term, tf: the index, a row for each distinct term of a document.  Rows with one doc_id are documents of their own, told apart by row."""
    return counted(_exploded(docs, terms, id_))


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "row", "dl", "term").agg(F.count("*").alias("tf"))


def in_place(rows: DataFrame, keep: list[str], words: str = "w") -> DataFrame:
    """The columns keep, term, tf: a row for each distinct term of rows, counted where the rows stand; rows without terms give none."""
    out = T.StructType([rows.schema[c] for c in keep] + list(T.StructType.fromDDL("term string, tf long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                w = part.column(words)
                flat = w.flatten().dictionary_encode()
                size = np.asarray(pc.fill_null(pc.list_value_length(w), 0)).astype(np.int64)
                n = max(len(flat.dictionary), 1)
                key, tf = np.unique(np.repeat(np.arange(part.num_rows), size) * n + np.asarray(flat.indices).astype(np.int64), return_counts=True)
                of = pa.array(key // n)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(of) for c in keep), flat.dictionary.take(pa.array(key % n)), pa.array(tf)], names=out.fieldNames())

    return rows.select(*keep, words).mapInArrow(run, out)


def _exploded(docs: DataFrame, terms: Column, id_: str) -> DataFrame:
    """doc_id, row, dl, term; the length is settled before the terms are dealt out, not once for each of them."""
    d = docs.select(F.col(id_).alias("doc_id"), F.monotonically_increasing_id().alias("row"), terms.alias("w")).select("doc_id", "row", F.size("w").alias("dl"), "w")
    return d.select("doc_id", "row", "dl", F.explode("w").alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, doc_terms: Column, query_terms: Column, k1: float = K.K1, b: float = K.B, id_: str = "doc_id") -> DataFrame:
    """query_id, doc_id, score of all pairs that share a term; of a repeated doc_id its best row's score.

    Terms that no question has go before anything is shuffled wide; document
    frequencies are counted on what is left, lengths on all documents.
    """
    tf = counted(with_terms(_exploded(docs, doc_terms, id_), queries, query_terms))
    return weighed(tf, docs.select(F.size(doc_terms).alias("dl")), asked_terms(queries, query_terms), k1, b)


def asked_terms(queries: DataFrame, query_terms: Column) -> DataFrame:
    """query_id, term, qtf."""
    return queries.select("query_id", F.explode(query_terms).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def with_terms(rows: DataFrame, queries: DataFrame, query_terms: Column) -> DataFrame:
    """Rows of the terms that some question has."""
    return rows.join(queries.select(F.explode(query_terms).alias("term")).distinct(), "term", "left_semi")


def weighed(tf: DataFrame, lengths: DataFrame, asked: DataFrame, k1: float = K.K1, b: float = K.B) -> DataFrame:
    """query_id, doc_id, score from postings of the questions' terms (doc_id, dl, term, tf; and row, if ids may repeat), the lengths of all documents (dl) and asked_terms()."""
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    rows = ["query_id", "doc_id", *(["row"] if "row" in tf.columns else [])]
    scores = tf.join(asked.join(df, "term"), "term").crossJoin(F.broadcast(stats)).groupBy(*rows).agg(F.sum(gain).alias("score"))  # stats: one row
    return scores.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")) if "row" in rows else scores


def ranked(scores: DataFrame, k: int) -> DataFrame:
    return top(scores.withColumn("score", F.round("score", 6)), k, F.desc("score"), F.asc("doc_id"))


def posted_top(tf: DataFrame, lengths: DataFrame, asked: DataFrame, k: int, boosts: dict[str, float] | None = None, most_bytes: int | None = None) -> DataFrame:
    """query_id, doc_id, score, rank by BM25 from postings; of several fields each document has its best field's score times the field's boost.

    tf: postings of the questions' terms (doc_id, dl, term, tf; and row, if ids may repeat).
    lengths: dl of all documents.  asked: query_id, term, qtf.  With boosts (field: factor) all
    three have a column field too.  If the questions' weights (terms x questions) take most_bytes
    (HELD) at most, they are broadcast, the postings of a document come together once, as
    numbers, and a task passes on its k best alone: pairs of question and document are never
    shuffled, and no task holds a term.  Larger sets of questions go by the join of weighed().
    """
    if boosts is None:
        boosts = {"": 1.0}
        tf, lengths, asked = (x.withColumn("field", F.lit("")) for x in (tf, lengths, asked))
    size = asked.agg(F.count_distinct("query_id").alias("q"), F.count_distinct("field", "term").alias("t")).first()
    if size.q * size.t * 8 > (HELD if most_bytes is None else most_bytes):
        scores = None
        for name, factor in boosts.items():
            own = lambda x: x.filter(F.col("field") == name).drop("field")  # noqa: B023, E731
            s = weighed(own(tf), own(lengths), own(asked)).withColumn("score", F.col("score") * factor)
            scores = s if scores is None else scores.unionByName(s)
        return ranked(scores.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)
    spark = tf.sparkSession
    held = asked.select("query_id", "field", "term", "qtf").collect()  # of checked size
    vocab = {x: i for i, x in enumerate(dict.fromkeys((r.field, r.term) for r in held))}
    place = {x: i for i, x in enumerate(dict.fromkeys(r.query_id for r in held))}
    ids = pa.array(list(place))
    about = {r.field: r for r in lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).collect()}  # a row for each field
    mean = F.create_map(*[F.lit(x) for f in boosts for x in (f, float((about[f].avgdl if f in about else None) or 1.0))])[F.col("field")]
    words = spark.createDataFrame([(f, t_, i) for (f, t_), i in vocab.items()], "field string, term string, t long")
    keys = ["doc_id", *(["row"] if "row" in tf.columns else []), "field", "dl"]
    # a posting is one number: place of the term, and how often it stands there
    rows = tf.join(F.broadcast(words), ["field", "term"]).groupBy(*keys).agg(F.collect_list(F.shiftleft("t", 32) + F.col("tf")).alias("p"))
    rows = versions.kept(rows.select("doc_id", (F.col("dl") / mean).alias("length"), "p"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocab), np.int64)
        for batch in batches:
            df += np.bincount(batch.column("p").flatten().to_numpy() >> 32, minlength=len(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], names=["term", "df"])

    df = np.zeros(len(vocab))
    for r in rows.select("p").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r.term] = r.df
    n = np.array([about[f].n if f in about else 0 for f, _ in vocab], dtype=float)
    weight = np.zeros((len(vocab), len(place)))
    for r in held:
        weight[vocab[r.field, r.term], place[r.query_id]] = r.qtf * boosts[r.field]
    weight *= np.log(1 + (n - df + 0.5) / (df + 0.5))[:, None]
    shared = spark.sparkContext.broadcast(weight)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                p = part.column("p").flatten().to_numpy()
                doc = np.repeat(np.arange(part.num_rows), part.column("p").value_lengths().to_numpy())
                tf_, length = (p & 0xFFFFFFFF).astype(np.float64), part.column("length").to_numpy()
                used, col = np.unique(p >> 32, return_inverse=True)
                g = np.zeros((part.num_rows, len(used)))
                g[doc, col] = tf_ * (K.K1 + 1) / (tf_ + K.K1 * (1 - K.B + K.B * length[doc]))
                best.add(part.column("doc_id"), (g @ shared.value[used]).T)
        yield from best.rows(ids)

    kind = lambda frame, c: frame.schema[c].dataType.simpleString()
    found = rows.mapInArrow(score, f"query_id {kind(asked, 'query_id')}, doc_id {kind(tf, 'doc_id')}, score double")
    return top(found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k, F.desc("score"), F.asc("doc_id"))


def lexical_top(docs: DataFrame, queries: DataFrame, k: int = K.CANDIDATES, filters: dict | None = None, most_bytes: int | None = None) -> DataFrame:
    """query_id, doc_id, score, rank by BM25 over lower-cased letter and digit runs.

    Every row of docs is a document; an id that stands in several is ranked once, by its
    best row.  Pairs that share a term are ranked even where the score rounds to zero.
    If the questions' weights (terms x questions) take most_bytes (HELD) at most, they
    are broadcast, documents are scored where they stand, and a task passes on its k
    best alone; what is shuffled does not grow with the pairs that share a term.
    Larger sets of questions go by the join of bm25(), to the same answer.
    """
    terms = t.terms(F.col("text"))
    docs = matching(docs, filters)
    asked = queries.select("query_id", F.explode(terms).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    size = asked.agg(F.count_distinct("query_id").alias("q"), F.count_distinct("term").alias("t")).first()
    if size.q * size.t * 8 > (HELD if most_bytes is None else most_bytes):
        return ranked(bm25(docs, queries, terms, terms), k)
    held = asked.toArrow()  # of checked size
    ids, vocab = (pc.unique(held.column(c).combine_chunks()) for c in ("query_id", "term"))
    rows = docs.select("doc_id", terms.alias("w"))
    count, texts, words = (len(vocab) + i for i in range(3))  # places after the frequencies: documents, those with a text, and their words

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocab) + 3, np.int64)
        for batch, doc, term, length in _counts(batches, vocab):
            df[:count] += np.bincount(np.unique(doc * len(vocab) + term) % max(len(vocab), 1), minlength=len(vocab))[:count]
            df[count] += batch.num_rows
            df[texts] += batch.num_rows - batch.column("w").null_count
            df[words] += length.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], names=["term", "df"])

    df = np.zeros(len(vocab) + 3)
    for r in rows.mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r.term] = r.df
    weight = np.zeros((len(vocab), len(ids)))
    weight[np.asarray(pc.index_in(held.column("term"), vocab)), np.asarray(pc.index_in(held.column("query_id"), ids))] = held.column("qtf").to_numpy()
    weight *= np.log(1 + (df[count] - df[:count] + 0.5) / (df[:count] + 0.5))[:, None]
    shared = docs.sparkSession.sparkContext.broadcast(weight)
    avgdl = df[words] / df[texts] if df[words] else 1.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch, doc, term, length in _counts(batches, vocab):
            key, tf = np.unique(doc * max(len(vocab), 1) + term, return_counts=True)
            doc, term = key // max(len(vocab), 1), key % max(len(vocab), 1)
            gain = tf * (K.K1 + 1) / (tf + K.K1 * (1 - K.B + K.B * length[doc] / avgdl))
            for at in range(0, batch.num_rows, 256):
                i, j = np.searchsorted(doc, [at, at + 256])
                used, col = np.unique(term[i:j], return_inverse=True)
                g = np.zeros((min(256, batch.num_rows - at), len(used)))
                g[doc[i:j] - at, col] = gain[i:j]
                best.add(batch.column("doc_id").slice(at, 256), (g @ shared.value[used]).T)
        yield from best.rows(ids)

    kind = lambda frame, c: frame.schema[c].dataType.simpleString()
    found = rows.filter(F.size("w") > 0).mapInArrow(score, f"query_id {kind(queries, 'query_id')}, doc_id {kind(docs, 'doc_id')}, score double")
    return top(found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k, F.desc("score"), F.asc("doc_id"))


class Best:
    """The k best ids of each question among all that a task adds: at most some blocks of candidates are held."""

    def __init__(self, k: int):
        self.k, self.held, self.n = k, [], 0

    def add(self, own: pa.Array, scores: np.ndarray) -> None:
        """scores: questions x rows; the ids own may repeat.  Scores of zero are no hits."""
        value = np.round(scores, 6)
        first = np.lexsort((np.broadcast_to(_ranks(own), value.shape), -value), axis=1)
        if len(pc.unique(own)) == len(own):
            first = first[:, : self.k]
        q, d = np.nonzero(np.take_along_axis(scores, first, 1) > 0)
        d = first[q, d]
        self.held.append((q, own.take(pa.array(d)), value[q, d]))
        self.n += len(q)
        if self.n > max(1 << 18, 4 * self.k * len(scores)):
            self._cut()

    def _cut(self) -> None:
        q, value = (np.concatenate([h[c] for h in self.held]) for c in (0, 2))
        own = pa.concat_arrays([h[1] for h in self.held])
        rank = _ranks(own)
        order = np.lexsort((rank, -value, q))
        pair = np.unique(np.stack([q[order], rank[order]]), axis=1, return_index=True)[1]  # the first, so the best, of each question and id
        order = order[np.sort(pair)]
        order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < self.k]
        self.held, self.n = [(q[order], own.take(pa.array(order)), value[order])], len(order)

    def rows(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.n:
            self._cut()
            q, own, value = self.held[0]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), own, pa.array(value)], names=["query_id", "doc_id", "score"])


def _ranks(own: pa.Array) -> np.ndarray:
    """The same for equal values, in their order; nulls first, as in an ascending order."""
    return pc.rank(own, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch], vocab: pa.Array) -> Iterator[tuple]:
    """(some rows of a batch, row and place in vocab of each of their words that is there, words of each row)."""
    for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
        w = batch.column("w")
        length = np.asarray(pc.fill_null(pc.list_value_length(w), 0)).astype(np.int64)
        term = pc.fill_null(pc.index_in(w.flatten(), vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(batch.num_rows), length)
        yield batch, doc[term >= 0], term[term >= 0], length


def best_fields(docs: DataFrame, queries: DataFrame, analyze, k: int = K.CANDIDATES, boost: float = 0.5) -> DataFrame:
    """Larger of BM25 over the analysed field of the text's language and boost times BM25 over the folded field.

    docs and queries: an id, text, lang.  Both fields of the documents are cut into terms in
    one scan; what is kept of it are lengths and the postings of the questions' terms.
    """
    spark = docs.sparkSession
    fields = lambda df: df.withColumns({"analysed": analyze(F.col("text"), F.col("lang")), "folded": t.terms(t.deaccent(F.col("text")))})
    asked = versions.kept(fields(queries).select("query_id", "analysed", "folded"))
    names = {"analysed": 1.0, "folded": boost}
    wanted = asked.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("w")) for n in names])).alias("f")).select("f.field", F.explode("f.w").alias("term")).distinct().withColumn("asked", F.lit(True))
    # a term that no text has stands in every row of a field, so that lengths come with the same scan
    mark = spark.createDataFrame([(n, "", True) for n in names], "field string, term string, asked boolean")
    size = wanted.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    wanted = wanted.union(mark.select(wanted.columns))
    cut = fields(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("w")) for n in names])).alias("f"))
    cut = cut.select("f.field", "doc_id", "row", F.size("f.w").alias("dl"), F.concat(F.coalesce("f.w", F.array().cast("array<string>")), F.array(F.lit(""))).alias("w"))
    # terms that no question has go where the texts stand, if the questions' are few enough to be everywhere
    held = versions.kept(in_place(cut, ["field", "doc_id", "row", "dl"]).join(F.broadcast(wanted) if size <= HELD else wanted, ["field", "term"]))
    asked = asked.select("query_id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("w")) for n in names])).alias("f")).select("query_id", "f.field", F.explode("f.w").alias("term"))
    asked = asked.groupBy("query_id", "field", "term").agg(F.count("*").alias("qtf"))
    return posted_top(held.filter("term <> ''").select("field", "doc_id", "row", "dl", "term", "tf"), held.filter("term = ''").select("field", "dl"), asked, k, names)


# ---------------------------------------------------------------- dense

HELD = 64 << 20  # bytes of questions that may be broadcast
AT_ONCE = 128  # questions of a block that a batch is scored for at a time

def dense_top(vectors: DataFrame, queries: DataFrame, k: int = K.CANDIDATES, filters: dict | None = None, block: int = 1024, other: bool = False, most_bytes: int = HELD) -> DataFrame:
    """query_id, doc_id, score, rank by cosine in double precision.

    Questions come in blocks, each one matrix that is multiplied with batches of
    vectors; a batch passes on its k best alone.  All blocks are broadcast if their
    numbers take most_bytes at most (counted first); else blocks and batches meet as
    rows of two tables, a pair of them at a time, and the driver sees none.
    vectors: vec_id, embedding; queries: query_id, embedding.  other: not the
    question's own vector.  Null and zero vectors, those with a null component and
    those of another length than the questions' match nothing.
    """

    def best(qid: np.ndarray, ids: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
        value = np.take_along_axis(s, order, 1)
        keep = value > -2.0
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, order.shape[1])[keep.ravel()]), pa.array(ids[order][keep]), pa.array(value[keep])], names=["query_id", "doc_id", "score"])

    rows = usable(matching(vectors, filters)).select("vec_id", "embedding")
    n, dim = _extent(queries)
    out = "query_id long, doc_id long, score double"
    rows = rows.filter(F.size("embedding") == dim)
    if n * dim * 8 <= most_bytes:
        blocks = _blocks(queries, block, dim)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for qid, ids, s, _ in _scored(batches, blocks, other):
                yield best(qid, ids, s)

        return top(rows.mapInArrow(search, out), k, F.desc("score"), "doc_id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qids, m, ids, x in zip(*(batch.column(c).to_pylist() for c in ("a_ids", "a", "b_ids", "b")), strict=True):
                qid, v = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                yield best(qid, v, _scores(qid, np.frombuffer(m, np.float64).reshape(len(qid), -1), v, np.frombuffer(x, np.float64).reshape(len(v), -1), other))

    asked = _matrices(usable(queries).filter(F.size("embedding") == dim).select("query_id", "embedding"), block, "a")
    stored = _matrices(rows, 4 * block, "b")
    return top(stored.crossJoin(asked).mapInArrow(meet, out), k, F.desc("score"), "doc_id")


def dense_rerank(vectors: DataFrame, queries: DataFrame, k: int = K.TOP_K, alpha: float = K.ALPHA, beta: float = K.BETA, block: int = 1024, most_bytes: int = HELD) -> DataFrame:
    """rerank over all vectors but the question's own: no candidates are drawn by score first.

    vectors: vec_id, embedding, doc_type, institution.  A batch passes on whatever
    may be among its k best; SLACK is more than the rounding of two final scores.
    Questions are broadcast up to most_bytes, beyond that as in dense_top.
    """
    n, dim = _extent(queries)
    w = q.metadata_weight(F.col("doc_type"), F.col("institution")).cast("double").alias("w")
    rows = usable(vectors).filter(F.size("embedding") == dim).select("vec_id", "embedding", "doc_type", "institution", w)
    out = "query_id long, doc_id long, score double, doc_type string, institution string"

    def best(qid: np.ndarray, ids: np.ndarray, s: np.ndarray, w: np.ndarray, kinds: pa.Array, houses: pa.Array) -> pa.RecordBatch:
        v = np.where(s > -2.0, alpha * s + beta * w, -np.inf)
        at = max(0, v.shape[1] - k)
        i, j = np.nonzero((v >= np.partition(v, at, axis=1)[:, at, None] - SLACK) & (s > -2.0))
        return pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(ids[j]), pa.array(s[i, j]), kinds.take(pa.array(j)), houses.take(pa.array(j))], names=["query_id", "doc_id", "score", "doc_type", "institution"])

    if n * dim * 8 <= most_bytes:
        blocks = _blocks(queries, block, dim)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for qid, ids, s, batch in _scored(batches, blocks, True):
                yield best(qid, ids, s, batch.column("w").to_numpy(), batch.column("doc_type"), batch.column("institution"))

        return rerank(rows.mapInArrow(search, out), F.col("score"), k, alpha, beta)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qid, ids = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["b_ids"], np.int64)
                s = _scores(qid, np.frombuffer(r["a"], np.float64).reshape(len(qid), -1), ids, np.frombuffer(r["b"], np.float64).reshape(len(ids), -1), True)
                yield best(qid, ids, s, np.array(r["w"]), pa.array(r["doc_type"], pa.string()), pa.array(r["institution"], pa.string()))

    asked = _matrices(usable(queries).filter(F.size("embedding") == dim).select("query_id", "embedding"), block, "a")
    stored = _matrices(rows, 4 * block, "b", {"w": "double", "doc_type": "string", "institution": "string"})
    return rerank(stored.crossJoin(asked).mapInArrow(meet, out), F.col("score"), k, alpha, beta)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, to six places."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: p.cast("double") * r.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.round(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 6)


SLACK = 2e-6


def usable(df: DataFrame) -> DataFrame:
    return df.filter("embedding is not null and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x))")


def _extent(queries: DataFrame) -> tuple[int, int]:
    """(number of questions, their most common length)."""
    sizes = usable(queries).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    row = sizes.agg(F.sum("n").alias("n"), F.max_by("dim", F.struct("n", -F.col("dim"))).alias("dim")).first()
    return (row.n or 0, row.dim or 0)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _blocks(queries: DataFrame, block: int, dim: int) -> list:
    """Broadcasts of (ids, matrix of unit rows)."""
    sc = queries.sparkSession.sparkContext
    blocks, held = [], []

    def close():
        if held:
            blocks.append(sc.broadcast((np.array([r[0] for r in held]), _unit(np.array([r[1] for r in held], dtype=np.float64)))))
            held.clear()

    for r in usable(queries).filter(F.size("embedding") == dim).select("query_id", "embedding").toLocalIterator():
        held.append((r.query_id, r.embedding))
        if len(held) == block:
            close()
    close()
    return blocks


def _matrices(rows: DataFrame, block: int, name: str, more: dict[str, str] | None = None) -> DataFrame:
    """Blocks of (id, embedding) as rows of two binaries: ids, and unit vectors; and arrays of further columns (name: type)."""
    more = more or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1))
                rest = [pa.array([part.column(c).to_pylist()], pa.list_(part.column(c).type)) for c in more]
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()]), pa.array([x.tobytes()]), *rest], names=[f"{name}_ids", name, *more])

    return rows.mapInArrow(run, ", ".join([f"{name}_ids binary", f"{name} binary", *(f"{c} array<{t_}>" for c, t_ in more.items())]))


def _scores(qid: np.ndarray, m: np.ndarray, ids: np.ndarray, x: np.ndarray, other: bool) -> np.ndarray:
    s = np.round(m @ x.T, 6)
    if other:
        s[qid[:, None] == ids[None]] = -2.0
    return s


def _scored(batches: Iterator[pa.RecordBatch], blocks: list, other: bool) -> Iterator[tuple]:
    """(query ids, vector ids, scores, batch) of each batch and block; -2: the question's own vector, if other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("vec_id").to_numpy()
        x = _unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
        for part in blocks:
            for at in range(0, len(part.value[0]), AT_ONCE):  # a matrix of scores has at most so many rows, however many questions and vectors meet
                qid, m = (v[at : at + AT_ONCE] for v in part.value)
                yield qid, ids, _scores(qid, m, ids, x, other), batch


# ---------------------------------------------------------------- fusion and reranking


def fuse(dense: DataFrame, sparse: DataFrame, k: int = K.CANDIDATES, rrf_k: int = K.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (query_id, doc_id, score, rank) by a full outer join.

    Ties: dense rank, then sparse rank, then id.
    """
    d = dense.select("query_id", "doc_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "doc_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    both = d.join(s, ["query_id", "doc_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf_score", F.round(part("dense_rank") + part("sparse_rank"), 9)).withColumn("sparse_score", F.coalesce("sparse_score", F.lit(0.0)))
    return top(both, k, F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc("doc_id"))


def fuse_many(lists: list[DataFrame], rrf_k: int = K.RRF_K) -> DataFrame:
    """query_id, doc_id, rrf_score over any number of rankings; an id that stands twice in one adds twice."""
    rows = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("query_id", "doc_id", "rank"))
    return rows.filter("doc_id is not null").groupBy("query_id", "doc_id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("rrf_score"))


def rerank(candidates: DataFrame, score: Column, k: int = K.TOP_K, alpha: float = K.ALPHA, beta: float = K.BETA) -> DataFrame:
    """Adds w_meta, final_score and the final rank; needs doc_type and institution."""
    w = q.metadata_weight(F.col("doc_type"), F.col("institution"))
    out = candidates.drop("rank").withColumn("w_meta", w).withColumn("final_score", F.round(alpha * score + beta * F.col("w_meta"), 6))
    return top(out, k, F.desc("final_score"), F.asc("doc_id"))


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = K.TOP_K, candidates: int = K.CANDIDATES, filters: dict | None = None) -> DataFrame:
    """The two-stage funnel without a cross-encoder; queries: query_id, text, embedding.

    filters hold for both rankings: vectors that lack the columns are cut to the
    documents (doc_id = vec_id) that pass.
    """
    if filters and set(filters) <= set(vectors.columns):
        vectors = matching(vectors, filters)
    elif filters:
        vectors = vectors.join(matching(docs, filters).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    sparse = lexical_top(docs, queries, candidates, filters)
    dense = dense_top(vectors, queries, candidates)
    return confident(fuse(dense, sparse, candidates), k)


def confident(fused: DataFrame, k: int) -> DataFrame:
    """The first k of fuse()'s rows with the question's confidence: the first hit's dense score, else its fused score, within 0 and 1."""
    first = F.max(F.when(F.col("rank") == 1, F.least(F.greatest(F.coalesce("dense_score", "rrf_score"), F.lit(0.0)), F.lit(1.0)))).over(W.partitionBy("query_id"))
    return fused.withColumn("confidence", first).filter(F.col("rank") <= k)
