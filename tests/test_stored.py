from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import models
from quillon.functions import questions as q
from quillon.operators import answers, ingest, retrieval, store, versions
from quillon.sources import files

DOCS = "doc_id long, text string, lang string"


def tables(spark, root, at=None):
    return {n: {r.doc_id for r in ingest.read(spark, root, n, at).select("doc_id").collect()} for n in ingest.TABLES}


def test_ingestion_replaces_forgets_compacts_and_expires(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert ingest.version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        ingest.read(spark, root, "chunks")
    first = ingest.persist(spark.createDataFrame([(1, "Article 1 the law", "en"), (2, "la loi", "fr"), (3, None, "fr"), (4, " ", "en")], DOCS), root)
    assert all(ids == {1, 2} for ids in tables(spark, root).values())
    ingest.persist(spark.createDataFrame([(2, "une autre loi", "fr"), (5, "--", "en")], DOCS), root)
    now = {"documents": {1, 2, 5}, "chunks": {1, 2, 5}, "vectors": {1, 2}, "postings": {1, 2}}
    assert tables(spark, root) == now
    assert {r.content for r in ingest.read(spark, root, "chunks").filter("doc_id = 2").collect()} == {"une autre loi"}
    assert {r.content for r in ingest.read(spark, root, "chunks", first).filter("doc_id = 2").collect()} == {"la loi"}  # readers of the version before
    assert ingest.read(spark, root, "documents").filter("ingested_at is null").isEmpty()
    assert sorted(r.chunk_no for r in ingest.read(spark, root, "chunks").collect()) == [0, 2, 3]  # dense; 1 was replaced
    ingest.forget(spark, root, spark.createDataFrame([(1,), (None,)], "doc_id long"))
    assert all(1 not in ids for ids in tables(spark, root).values()) and tables(spark, root, first)["documents"] == {1, 2}
    left = tables(spark, root)
    assert len(ingest.compact(spark, root)) == 4 and ingest.compact(spark, root) == [] and tables(spark, root) == left
    m = versions.manifest(spark, root)
    assert m["deletes"] == [] and all(len(x) == 1 for x in m["tables"].values())
    assert ingest.expire(spark, root) == 6 and tables(spark, root) == left
    with pytest.raises(FileNotFoundError):
        ingest.read(spark, root, "chunks", first)
    assert len(list(tmp_path.glob("store/data/chunks/segment=*"))) == 1 and not list(tmp_path.glob("store/staged/*"))


def test_words_that_cancel_out_have_a_vector(spark, tmp_path):
    import zlib

    h = {}
    for i in range(10_000):  # two words of one place and opposite signs
        v = zlib.crc32(f"mot{i}".encode())
        h.setdefault((v % 64, v >> 31), f"mot{i}")
    place = next(p for p, _ in h if (p, 0) in h and (p, 1) in h)
    root = f"file://{tmp_path}/store"
    ingest.persist(spark.createDataFrame([(1, f"{h[place, 0]} {h[place, 1]}", "fr"), (2, "--", "fr")], DOCS), root)
    assert [r.doc_id for r in ingest.read(spark, root, "vectors").collect()] == [1]


def test_a_failed_commit_leaves_the_version_before(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    versions.commit(spark, root, [versions.write(spark.range(3), root, "t")])
    with pytest.raises(Exception, match="boom"):
        versions.write(spark.range(2).select(F.raise_error(F.lit("boom")).cast("long").alias("id")), root, "t")
    assert versions.read(spark, root, "t").count() == 3 and versions.version(spark, root) == 1


def test_writers_at_once_all_come_in(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    segments = [versions.write(spark.range(i, i + 2).withColumnRenamed("id", "doc_id"), root, "t") for i in range(8)]
    firsts = []

    def work(s):
        firsts.append(versions.reserve(spark, root, "n", 10))
        return versions.commit(spark, root, [s], spark.createDataFrame([(100,)], "doc_id long"))

    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(work, segments)) == list(range(1, 9))
    assert sorted(firsts) == list(range(0, 80, 10))
    assert sorted(r.doc_id for r in versions.read(spark, root, "t").collect()) == sorted([*range(8), *range(1, 9)])
    # a version that comes between a compaction's reading and its commit stays, and so do its deletes
    put, once = versions._put, []

    def late(*args):
        if not once and args[2] == "log":
            once.append(versions.commit)
            versions._put = put
            versions.commit(spark, root, [versions.write(spark.createDataFrame([(50,)], "doc_id long"), root, "t")], spark.createDataFrame([(3,)], "doc_id long"))
        return put(*args)

    versions._put = late
    try:
        versions.compact(spark, root, "t")
    finally:
        versions._put = put
    assert sorted(r.doc_id for r in versions.read(spark, root, "t").collect()) == sorted([x for x in [*range(8), *range(1, 9)] if x != 3] + [50])
    assert len(versions.manifest(spark, root)["tables"]["t"]) == 2


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


def test_bytes_of_a_commit_follow_its_rows(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    docs = [(i, f"Article {i} " + " ".join(f"word{i}x{k}" for k in range(400)), "en") for i in range(400)]
    ingest.persist(spark.createDataFrame(docs, DOCS), root)
    before = size(tmp_path)
    ingest.persist(spark.createDataFrame([(7, "another text", "en")], DOCS), root)
    assert size(tmp_path) - before < 0.05 * before
    assert {r.content for r in ingest.read(spark, root, "chunks").filter("doc_id = 7").collect()} == {"another text"}


def test_search_over_what_was_ingested(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    old = ingest.persist(spark.createDataFrame([(i, f"loi numéro{i} commune", "fr") for i in range(6)] + [(i, f"law number{i} common", "en") for i in range(6, 12)], DOCS), root)
    ingest.persist(spark.createDataFrame([(3, "commune commune nouveau", "fr"), (20, None, "en")], DOCS), root)
    ingest.forget(spark, root, spark.createDataFrame([(5,)], "doc_id long"))
    asked = spark.createDataFrame([(1, "commune"), (2, "number7"), (3, None)], "query_id long, text string")
    got = {}
    for r in ingest.search(spark, root, asked).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.content))
    assert sorted(got[1])[0][1:] == (3, "commune commune nouveau") and 5 not in {d for _, d, _ in got[1]} and sorted(got[2])[0][1] == 7
    assert {r.doc_id for r in ingest.search(spark, root, asked, filters={"lang": "en"}).collect()} <= set(range(6, 12))
    assert "numéro3" in {w for r in ingest.search(spark, root, asked, k=20, at=old).collect() for w in r.content.split()}


def test_publish_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    store.publish(spark.range(3), path)
    store.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t.aside").exists()
    (tmp_path / "t").rename(tmp_path / "t.aside")  # a writer died between its renames
    with pytest.raises(Exception, match="boom"):
        store.publish(spark.range(2).select(F.raise_error(F.lit("boom")).alias("x")), path)
    assert spark.read.parquet(path).count() == 5


def test_many_questions(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 6), (62, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (63, [1.0] * 5)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = v.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    got = [sorted(map(tuple, retrieval.dense_top(v, asked, 4, block=7, most_bytes=b, other=True).collect())) for b in (1 << 20, 0)]
    assert got[0] == got[1] and len(got[0]) == 20 * 4
    told = v.withColumn("doc_type", F.when(F.col("vec_id") % 4 == 0, "loi")).withColumn("institution", F.when(F.col("vec_id") % 5 == 0, "presidence"))
    got = [sorted(map(str, retrieval.dense_rerank(told, asked, 3, block=7, most_bytes=b).collect())) for b in (1 << 20, 0)]
    assert got[0] == got[1] and len(got[0]) == 20 * 3


def test_hybrid_filters_hold_on_both_sides(spark):
    docs = spark.createDataFrame([(i, f"word{i} common", "en" if i % 2 else "fr") for i in range(20)], DOCS)
    v = spark.createDataFrame([(i, [1.0, i / 20]) for i in range(20)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, "common", [1.0, 0.1])], "query_id long, text string, embedding array<double>")
    got = [r.doc_id for r in retrieval.hybrid(docs, v, asked, filters={"lang": "en"}).collect()]
    assert len(got) == 5 and all(i % 2 for i in got)


def test_file_store(spark, tmp_path):
    root = f"file://{tmp_path}/files"
    schema = "doc_id long, filename string, content binary"
    one = spark.createDataFrame([(1, "a.txt", bytearray(b"x")), (2, "b.txt", bytearray(b"yy")), (1, "c.txt", bytearray(b"1")), (1, "c.txt", bytearray(b"2"))], schema)
    saved = {(r.doc_id, r.filename): r for r in ingest.save_files(one, root).collect()}
    assert len(saved) == 3 and all(spark.read.parquet(r.path).filter(F.col("content_hash") == r.content_hash).count() == 1 for r in saved.values())
    before = size(tmp_path)
    ingest.save_files(spark.createDataFrame([(1, "a.txt", bytearray(b"new"))], schema), root)
    assert size(tmp_path) - before < 12_000  # whatever the store holds
    wanted = spark.createDataFrame([(1, "a.txt"), (1, "z.txt"), (2, "a.txt")], "doc_id long, filename string")
    found = {(r.doc_id, r.filename): r.path for r in ingest.locate_files(spark, root, wanted).collect()}
    assert found[1, "z.txt"] is None and found[2, "a.txt"] is None
    assert bytes(spark.read.parquet(found[1, "a.txt"]).filter("filename = 'a.txt'").first().content) == b"new"
    assert {(r.doc_id, r.filename): r.size for r in ingest.read(spark, root, "files").collect()} == {(1, "a.txt"): 3, (1, "c.txt"): 1, (2, "b.txt"): 2}
    ingest.delete_files(spark, root, wanted.filter("doc_id = 1"))
    assert [r.doc_id for r in ingest.read(spark, root, "files").collect()] == [2]


def test_adapters_and_small_functions(spark, tmp_path):
    def load():
        def answer(prompts):
            if "bad" in prompts:
                raise ValueError
            return [p.upper() if p != "none" else None for p in prompts]

        return answer

    df = spark.createDataFrame([("a",), ("bad",), ("none",), (None,)], "p string").coalesce(1)
    assert [r.x for r in df.select(models.generate(F.col("p"), load, F.lit("?"), batch=1).alias("x")).collect()] == ["A", "?", "?", "?"]
    assert spark.range(1).select(q.valid_upload(F.lit(50 << 20)), q.valid_upload(F.lit((50 << 20) + 1)), q.valid_upload(F.lit(None))).first()[:] == (True, False, False)
    events = answers.token_events(spark.createDataFrame([(1, 'a "b"\nc'), (2, None)], "id long, answer string"), ["id"]).collect()
    assert [(r.id, r.idx, r.event) for r in events] == [(1, 0, 'data: "a "\n\n'), (1, 1, 'data: "\\"b\\"\\n"\n\n'), (1, 2, 'data: "c"\n\n'), (1, 3, "data: [DONE]\n\n"), (2, 0, "data: [DONE]\n\n")]
    lines = spark.createDataFrame([('{"a": 1}',), ("{bad",), ("",), (None,)], "value string")
    assert [r.a for r in files.ndjson(lines, "a int").collect()] == [1]
    assert spark.range(1).select(files.cached_text(files.cache_json(F.lit('x "y"\n')))).first()[0] == 'x "y"\n'
    flat = np.full((4, 5), 7, np.uint8)
    assert (files.sharpen(flat) == flat).all() and files.grey(np.full((2, 2, 3), 9, np.uint8)).tolist() == [[9, 9], [9, 9]]
    spot = flat.copy()
    spot[1, 2] = 107
    assert files.sharpen(spot)[1, 2] == 207 and files.sharpen(spot)[2, 2] == 0
    (tmp_path / "g.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        files.gold(spark, str(tmp_path / "g.json"))
    path = files.report(spark.createDataFrame([(0.5,)], "mrr double"), f"{tmp_path}/reports", "B2")
    assert spark.read.json(path).first().baseline == "B2" and "B2-20" in path


def test_first_hit_of_a_document_is_cited(spark):
    hits = spark.createDataFrame([(1, 5, "src", "second", 0.9, 2), (1, 5, "src", "first", 0.7, 1), (1, 6, "other", "x", 0.1, 3)], "query_id long, doc_id long, source string, content string, final_score double, rank int").withColumn("dense_score", F.lit(None).cast("double"))
    got = answers.citations(spark.createDataFrame([(1, "[Source: src, p. 1]")], "query_id long, answer string"), hits).collect()
    assert [(r.doc_id, r.excerpt) for r in got] == [(5, "first")]
