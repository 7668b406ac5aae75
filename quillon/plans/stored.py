"""Registered queries: stored tables and indexes, sessions, token streams, audit of runs."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import questions as q
from quillon.operators import ann, answers, blockmax, detector, ingest, metrics, versions
from quillon.plans.inputs import LAWS, laws, table, terms_sql
from quillon.plans.retrieval import BM25, FUSED, TOP, query
from quillon.plans.texts import CLEAN, SEGMENTS, STRIP
from quillon.operators.versions import kept
from quillon.sources import files


@contextmanager
def scratch(spark):
    """A new folder that all nodes share, gone afterwards."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
    path = f"{shared or tempfile.gettempdir()}/quillon-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        versions.remove(spark, path)


@query(f"WITH {BM25} {TOP.format('SELECT * FROM bm', 20)}")
def bm25_stored(spark, sf_dir):
    """The ranking of bm25_topk from a stored index."""
    with scratch(spark) as root:
        ingest.lexical_index(table(spark, sf_dir, "documents"), root)
        return kept(ingest.lexical_top(spark, root, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), K.CANDIDATES))


@query(f"WITH {BM25} {TOP.format('SELECT * FROM bm', 20)}")
def bm25_blockmax(spark, sf_dir):
    """The ranking of bm25_topk from block-max postings."""
    with scratch(spark) as root:
        blockmax.build(table(spark, sf_dir, "documents"), root)
        return kept(blockmax.top(spark, root, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")))


@query()
def lang_detect_trained(spark, sf_dir):
    """Languages and switches of all documents by a model of two thirds of them."""
    d = table(spark, sf_dir, "documents")
    with scratch(spark) as root:
        detector.fit(d.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"), root)
        return detector.detect(d, detector.load(spark, root), ["doc_id"])


@query()
def ann_topk(spark, sf_dir):
    """dense_topk from a stored vector index, half of the vectors committed after it was built."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    with scratch(spark) as root:
        ann.build(e.filter("vec_id % 2 = 0"), root)
        ann.add(e.filter("vec_id % 2 = 1"), root)
        return kept(ann.top(spark, root, e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")))


INGESTED = f"WITH RECURSIVE {LAWS}, o AS (SELECT doc_id, lang, {CLEAN} AS text FROM l WHERE {STRIP.format(CLEAN)} <> ''), {SEGMENTS}"


@query(f"""{INGESTED}, x AS (SELECT doc_id, chunk_index, content, {terms_sql('content')} AS w FROM h)
SELECT doc_id, chunk_index, sha256(doc_id || '||' || chunk_index || '|' || content) AS chunk_id, len(w)::INT AS n_terms, len(list_distinct(w)) AS n_postings, len(w) > 0 AS has_vector, 1 AS copies FROM x""")
def persist_ingest(spark, sf_dir):
    """Two commits, the second of documents that the first has too: every chunk with its postings and its vector."""
    docs = laws(spark, sf_dir)
    with scratch(spark) as root:
        ingest.persist(docs.filter("doc_id % 2 = 0"), root)
        ingest.persist(docs.filter("doc_id % 2 = 1 or doc_id % 10 = 0"), root)
        c, v, p = (ingest.read(spark, root, x) for x in ("chunks", "vectors", "postings"))
        n = p.groupBy("chunk_no").agg(F.count("*").alias("n_postings"))
        copies = c.groupBy("doc_id", "chunk_index").agg(F.count("*").cast("int").alias("copies"))
        out = c.join(n, "chunk_no", "left").join(v.select("chunk_no", F.lit(True).alias("has_vector")), "chunk_no", "left").join(copies, ["doc_id", "chunk_index"])
        return kept(out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", "n_terms", F.coalesce("n_postings", F.lit(0)).alias("n_postings"), F.coalesce("has_vector", F.lit(False)).alias("has_vector"), "copies"))


def letters():
    """An embedder: how often a text has each letter from a to z."""

    def embed(texts):
        return np.array([[x.lower().count(chr(97 + i)) for i in range(26)] for x in texts], dtype=float).reshape(-1, 26)

    return embed


def _letters_sql(c: str) -> str:
    counts = f"list_transform(range(26), lambda i: (length(lower({c})) - length(replace(lower({c}), chr((97 + i)::INT), '')))::DOUBLE)"
    return f"list_transform({counts}, lambda x: (x / sqrt(list_sum(list_transform({counts}, lambda y: y * y))))::FLOAT)"


def _search_sql(where: str) -> str:
    """Search over chunks; a chunk's number follows its commit, document and place."""
    return f"""{INGESTED},
n AS (SELECT h.doc_id, chunk_index, content, sha256(h.doc_id || '||' || chunk_index || '|' || content) AS chunk_id, row_number() OVER (ORDER BY NOT (h.doc_id % 2 = 0 AND h.doc_id % 10 <> 0), h.doc_id, chunk_index) AS no FROM h JOIN o USING (doc_id) WHERE h.doc_id % 9 <> 0 AND ({where})),
e AS (SELECT no, v FROM (SELECT no, {_letters_sql('content')} AS v FROM n WHERE regexp_matches(lower(content), '[a-z]'))),
b AS (SELECT item_id AS query_id, text FROM benchmark), qe AS (SELECT query_id, {_letters_sql('text')} AS v FROM b WHERE regexp_matches(lower(text), '[a-z]')),
dt AS (SELECT no AS doc_id, {terms_sql('content')} AS w FROM n), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM dt),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({terms_sql('text')}) AS term FROM b) GROUP BY ALL),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM dt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM qt JOIN df USING (term) JOIN tf USING (term), st GROUP BY ALL),
s AS ({TOP.format('SELECT * FROM bm', 20)}),
d AS ({TOP.format('SELECT query_id, no AS doc_id, round(list_cosine_similarity(qe.v::DOUBLE[], e.v::DOUBLE[]), 6) AS score FROM qe, e', 20)}), {FUSED.replace('g AS (', 'hits AS (')}
SELECT query_id, n.doc_id, chunk_index, chunk_id, dense_score, dense_rank, sparse_score, sparse_rank, rrf_score, rank, confidence FROM (
  SELECT *, max(CASE WHEN rank = 1 THEN least(greatest(coalesce(dense_score, rrf_score), 0.0), 1.0) END) OVER (PARTITION BY query_id) AS confidence FROM hits QUALIFY rank <= 5) g JOIN n ON n.no = g.doc_id"""


def _persisted_search(spark, sf_dir, filters=None):
    docs, asked = laws(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    with scratch(spark) as root:
        ingest.persist(docs.filter("doc_id % 2 = 0"), root, load=letters)
        ingest.persist(docs.filter("doc_id % 2 = 1 or doc_id % 10 = 0"), root, load=letters)
        ingest.forget(spark, root, docs.filter("doc_id % 9 = 0"))
        found = ingest.search(spark, root, asked, filters=filters, load=letters)
        return kept(found.withColumn("chunk_index", F.col("chunk_index").cast("long")).drop("chunk_no", "content"))


@query(_search_sql("true"))
def persist_hybrid(spark, sf_dir):
    """Hybrid search over the chunks of two commits, one of which replaces documents of the other, without forgotten ones."""
    return _persisted_search(spark, sf_dir)


@query(_search_sql("lang IN ('fr', 'en')"))
def persist_hybrid_filtered(spark, sf_dir):
    return _persisted_search(spark, sf_dir, {"lang": ["fr", "en"]})


@query("SELECT s.conv_id AS session_id, count(l.turn) AS n_queries, max(l.turn)::INT AS last FROM (SELECT DISTINCT conv_id FROM conversations) s LEFT JOIN (SELECT * FROM conversations WHERE role = 'user' AND conv_id % 7 <> 0) l USING (conv_id) GROUP BY 1")
def session_logs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    logs = c.filter("role = 'user'").select(F.when(F.col("conv_id") % 7 != 0, F.col("conv_id")).alias("session_id"), F.col("turn").cast("int").alias("turn"))
    return answers.session_logs(c.select(F.col("conv_id").alias("session_id")).distinct(), logs, at="turn")


@query(f"SELECT page_id, strlen(html) * 30000 <= {K.MAX_UPLOAD} AS valid FROM pages")
def upload_size(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", q.valid_upload(F.octet_length("html").cast("long") * 30000).alias("valid"))


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '\S+\s*') AS w FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, i::INT AS idx, 'data: ' || CASE WHEN i < len(w) THEN to_json(w[i + 1])::VARCHAR ELSE '[DONE]' END || chr(10) || chr(10) AS event FROM (SELECT *, unnest(range(0, len(w) + 1)) AS i FROM w)""")
def stream_tokens(spark, sf_dir):
    return answers.token_events(table(spark, sf_dir, "conversations").filter("role = 'assistant'"), ["conv_id", "turn"], "text")


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE event_id % 3 <> 0")
def ndjson_lines(spark, sf_dir):
    """Every third line is cut off and so skipped."""
    e = table(spark, sf_dir, "events")
    return files.ndjson(e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props")).alias("value")), "k long")


@query("""WITH r AS (SELECT event_type AS baseline, 0.9 + (min(event_id) % 10) / 100.0 AS citation_precision, (min(event_id) % 10) / 100.0 AS hallucination_rate, 0.8 + (min(event_id) % 10) / 50.0 AS isb, quantile_cont(value * 300, 0.5) AS p50_ms, quantile_cont(value * 300, 0.95) AS p95_ms FROM events GROUP BY 1)
SELECT baseline, citation_precision >= 0.95 AS citation_precision_ok, hallucination_rate <= 0.05 AS hallucination_ok, isb >= 0.85 AS isb_ok, p50_ms <= 5000 AS p50_ok, p95_ms <= 15000 AS p95_ok, round(p50_ms * 0.6, 6) AS retrieval_ms, round(p50_ms * 0.4, 6) AS generation_ms FROM r""")
def run_constraints(spark, sf_dir):
    least = F.min("event_id") % 10
    p = F.percentile(F.col("value") * 300, F.array(F.lit(0.5), F.lit(0.95)))
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("baseline")).agg((0.9 + least / 100.0).alias("citation_precision"), (least / 100.0).alias("hallucination_rate"), (0.8 + least / 50.0).alias("isb"), p.alias("p"))
    runs = metrics.constraints(runs.withColumn("p50_ms", F.col("p")[0]).withColumn("p95_ms", F.col("p")[1]))
    split = metrics.latency_split(runs, "p50_ms")
    return split.select("baseline", "constraints_met.*", F.round("retrieval_ms", 6).alias("retrieval_ms"), F.round("generation_ms", 6).alias("generation_ms"))


@query("SELECT doc_id, CASE WHEN n > 0 THEN 'success' ELSE 'empty' END AS status, n AS chunks_created, lang AS language, false AS ocr_used FROM (SELECT d.doc_id, d.lang, count(l.doc_id) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL)")
def api_rows(spark, sf_dir):
    """Labels stand in for chunks."""
    return answers.api_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
