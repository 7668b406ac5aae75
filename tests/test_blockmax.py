import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.operators import blockmax, retrieval


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    near = lambda i: [1 / (k + 1) + 20 * (k % 15 == i // 100) for k in range(60)]  # documents in a row have words in common
    rows = [(i, " ".join(r.choices(words, near(i), k=r.randrange(1, 40)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "w59 " * 50)]
    asked = [(q, " ".join(r.choices(words if q % 3 == 0 else words[q::15], k=r.randrange(1, 5)))) for q in range(12)] + [(100, None), (101, "unknown"), (102, "w1 w1 w59")]
    return rows, asked


def test_equal_plain_bm25_and_blocks_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blockmax, "SHARD_BITS", 8)
    rows, asked = corpus(1, 1500)
    docs, q = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")
    root = f"file://{tmp_path}/index"
    blockmax.build(docs, root, block=8)
    want = sorted(map(tuple, retrieval.lexical_top(docs, q, 10).collect()))
    assert sorted(map(tuple, blockmax.top(spark, root, q, 10).collect())) == want and len(want) > 100
    ids, blocks = (blockmax.versions.read(spark, root, x) for x in ("ids", "blocks"))
    bounds = blockmax.bounded(blocks, ids, q)
    count = lambda k: blockmax.surviving(bounds, blockmax.least(blocks, bounds, k, 2)).count()
    assert 0 < count(3) < 0.7 * bounds.count() and count(3) < count(10)  # blocks of the questions' terms that are read
    plan = blockmax.top(spark, root, q, 10)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("Scan")[0] and "NestedLoop" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    # an index built again takes the place of the one before
    blockmax.build(docs.filter("doc_id < 50"), root, block=8)
    assert {r.doc_id for r in blockmax.top(spark, root, q, 10).collect()} <= set(range(50))


def test_string_ids_ties_and_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i:02d}", "same words") for i in range(40)], "doc_id string, text string")
    q = spark.createDataFrame([("a", "words same"), ("b", "other")], "query_id string, text string")
    root = f"file://{tmp_path}/index"
    blockmax.build(docs.repartition(4), root, block=4)
    assert [(r.query_id, r.doc_id) for r in blockmax.top(spark, root, q, 5).orderBy("rank").collect()] == [("a", f"d{i:02d}") for i in range(5)]
    blockmax.build(docs.filter(F.lit(False)), root)
    assert blockmax.top(spark, root, q, 5).collect() == []


def postings(rows):
    term, shard, doc = zip(*rows, strict=True)
    kinds = {"term": pa.array(term), "shard": pa.array(shard, pa.int64()), "doc_no": pa.array(doc, pa.int64()), "tf": pa.array([d % 3 + 1 for d in doc], pa.int32()), "dl": pa.array([d % 7 + 5 for d in doc], pa.int32())}
    return pa.RecordBatch.from_arrays(list(kinds.values()), names=list(kinds))


def test_blocks_across_batches():
    r = random.Random(2)
    rows = [(t, s, d) for t in ("a", "b", "c", "é") for s in (0, 1) for d in sorted(r.sample(range(100), r.choice([1, 4, 8, 9, 40])))]
    for size in (1, 3, 4, 7, 1000):
        got = [x for b in blockmax._blocks(4, 6.0)(postings(rows[i : i + size]) for i in range(0, len(rows), size)) for x in b.to_pylist()]
        want = [(t, s, k, [x[2] for x in rows if x[:2] == (t, s)][4 * k : 4 * k + 4]) for t, s in sorted({x[:2] for x in rows}) for k in range(-(-sum(x[:2] == (t, s) for x in rows) // 4))]
        assert [(x["term"], x["shard"], x["block"], np.frombuffer(x["docs"], np.int64).tolist()) for x in got] == want
        for x in got:
            doc, tf, dl = (np.frombuffer(x[c], kind) for c, kind in (("docs", np.int64), ("tfs", np.int32), ("dls", np.int32)))
            assert (x["n"], x["first"], x["last"]) == (len(doc), doc[0], doc[-1]) and (tf == doc % 3 + 1).all() and (dl == doc % 7 + 5).all()
            assert x["gain"] == blockmax._gain(tf.astype(float), dl, 6.0).max()
    assert list(blockmax._blocks(4, 6.0)(iter([]))) == []


def test_blocks_of_rare_terms_are_made_together():
    batches = [postings([(f"t{b:02d}{i:05d}", 0, i) for i in range(10_000)]) for b in range(60)]
    began = time.perf_counter()
    assert sum(x.num_rows for x in blockmax._blocks(128, 6.0)(iter(batches))) == 600_000
    assert time.perf_counter() - began < 4
