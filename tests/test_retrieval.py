import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import analyzers
from quillon.functions import text as t
from quillon.operators import retrieval

RANKED = "query_id long, doc_id string, score double, rank int"


def ranked(spark, ids, scores=None):
    return spark.createDataFrame([(0, d, s, i) for i, (d, s) in enumerate(zip(ids, scores or [0.5] * len(ids), strict=True), 1)], RANKED)


def test_fusion_order_and_scores(spark):
    got = retrieval.fuse(ranked(spark, ["c1", "c2", "c3", "c4"], [0.95, 0.88, 0.75, 0.6]), ranked(spark, ["c2", "c5", "c1", "c3"], [0.9, 0.82, 0.77, 0.55])).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["c2", "c1", "c3", "c5", "c4"]
    assert got[0].rrf_score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and got[3].sparse_score == 0.82 and got[4].sparse_score == 0.0


def test_fusion_ties_and_empty_sides(spark):
    a, b, none = ranked(spark, ["A", "B"]), ranked(spark, ["B", "A"]), ranked(spark, [])
    assert [r.doc_id for r in retrieval.fuse(a, b).orderBy("rank").collect()] == ["A", "B"]
    assert [r.doc_id for r in retrieval.fuse(none, b).orderBy("rank").collect()] == ["B", "A"]
    assert retrieval.fuse(none, none).collect() == []
    twice = {r.doc_id: r.rrf_score for r in retrieval.fuse_many([ranked(spark, ["A", "A"]), b]).collect()}
    assert twice["A"] == pytest.approx(1 / 61 + 1 / 62 + 1 / 62)


def test_bm25_equals_definition(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choices("abcdefg", k=r.randrange(0, 12)))) for i in range(30)]
    got = {x.doc_id: x.score for x in retrieval.lexical_top(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, "a a B z")], "query_id long, text string"), 100).collect()}
    tf = {i: Counter(t.split()) for i, t in docs}
    avg = sum(sum(c.values()) for c in tf.values()) / len(docs)
    for i, c in tf.items():
        s = 0
        for term, q in (("a", 2), ("b", 1)):
            n = sum(term in x for x in tf.values())
            if c[term]:
                s += q * math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg))
        assert got.get(i, 0) == pytest.approx(s, abs=1e-6)


def test_dense_top_in_blocks(spark):
    x = np.random.default_rng(2).normal(size=(60, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.filter("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    got = retrieval.dense_top(v, q, 5, block=3, other=True).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u[:7] @ u.T, 6)
    np.fill_diagonal(s, -2)
    for i in range(7):
        want = sorted(range(60), key=lambda j: (-s[i, j], j))[:5]
        assert [r.doc_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == want


def test_filters_and_weights(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", False)], "x int, y string, z boolean")
    assert [r.x for r in retrieval.matching(df, {"y": ["a", "b"], "z": False}).collect()] == [2]
    c = spark.createDataFrame([(0, "1", "constitution", "Presidence", 0.5), (0, "2", "loi", None, 0.5), (0, "3", None, "primature", 0.5)], "query_id long, doc_id string, doc_type string, institution string, s double")
    got = retrieval.rerank(c, F.col("s")).orderBy("rank").collect()
    assert [(r.doc_id, round(r.w_meta, 6)) for r in got] == [("1", 1.0), ("2", 0.8), ("3", 0.6)]


def test_lexical_top_by_broadcast_equals_join(spark):
    r = random.Random(4)
    line = lambda n: " ".join(r.choices("abcdefghij", weights=range(1, 11), k=n))
    docs = spark.createDataFrame([(f"d{i}", line(r.randrange(0, 40))) for i in range(400)] + [("null", None)], "doc_id string, text string").repartition(3)
    asked = spark.createDataFrame([(i, line(5)) for i in range(12)] + [(90, "zz"), (91, None)], "query_id int, text string")
    got = [sorted(map(tuple, retrieval.lexical_top(docs, asked, 7, most_bytes=b).collect())) for b in (None, 0)]
    assert got[0] == got[1] and len(got[0]) == 84
    assert retrieval.lexical_top(docs.limit(0), asked, 7).collect() == [] and retrieval.lexical_top(docs, asked.limit(0), 7).collect() == []


@pytest.mark.parametrize("kind", ["long", "string"])
def test_one_lexical_answer_at_any_size(spark, kind):
    r = random.Random(4)
    rows = [(r.choice([None, *range(12)]), " ".join(["all", *r.choices("abcdefg", k=r.randrange(0, 9))])) for _ in range(60)] + [(3, ""), (4, None), (99, "all")]
    rows = [(i if i is None or kind == "long" else f"d{i}", x) for i, x in rows]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)
    asked = spark.createDataFrame([(0, "a b all"), (1, "c c d"), (2, "none"), (3, None), (4, "all")], "query_id long, text string")
    got = [sorted(map(tuple, retrieval.lexical_top(docs, asked, 5, most_bytes=b).collect()), key=str) for b in (1 << 20, 0)]
    assert got[0] == got[1] and len({x[:2] for x in got[0]}) == len(got[0])
    n, avg = len(rows), sum(len((x or "").split()) for _, x in rows) / sum(x is not None for _, x in rows)
    df = {t: sum(t in (x or "").split() for _, x in rows) for t in "abcdefg"} | {"all": sum("all" in (x or "").split() for _, x in rows)}
    best = {}
    for i, x in rows:
        c = Counter((x or "").split())
        s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) for t in ("a", "b", "all") if c[t])
        best[i] = max(best.get(i, 0), round(s, 6))
    want = sorted(best.items(), key=lambda x: (-x[1], x[0] is not None, x[0]))[:5]
    mine = [(x[1], x[2]) for x in sorted((x for x in got[0] if x[0] == 0), key=lambda x: x[3])]
    assert mine == [(i, pytest.approx(s, abs=2e-6)) for i, s in want]


def test_scores_that_round_to_zero_are_ranked_on_both_paths(spark):
    docs = spark.range(1_200_000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    asked = spark.createDataFrame([(0, "same")], "query_id long, text string")
    got = [[tuple(x) for x in retrieval.lexical_top(docs, asked, 3, most_bytes=b).orderBy("rank").collect()] for b in (1 << 20, 0)]
    assert got[0] == got[1] == [(0, i, got[0][0][2], i + 1) for i in range(3)] and got[0][0][2] == 0.0


def test_analysed_terms_equal_their_definition(spark):
    texts = ["L'article de la loi n’est pas applicable aux décisions", "The laws' sections were amended; nations", None, "", "d'eau Straße ÉTÉ’s o'clock _x_ 12b", "Gesetze und Verordnungen", "mot"]
    rows = [(i, x, lang) for i, x in enumerate(texts) for lang in ("fr", "en", "de", None)]
    got = {(r.i, r.lang): r.w for r in spark.createDataFrame(rows, "i int, text string, lang string").coalesce(2).select("i", "lang", analyzers.analyze(F.col("text"), F.col("lang")).alias("w")).collect()}
    assert got == {(i, lang): analyzers.tokens(x, lang) for i, x, lang in rows}


@pytest.mark.parametrize("rows", [True, False])  # ids that repeat, ids that do not
def test_scores_from_postings_equal_the_join_and_pass_on_the_best_alone(spark, rows):
    r = random.Random(5)
    text = lambda n: " ".join(r.choices("abcdefgh", k=n))
    docs = spark.createDataFrame([(i % 90, text(r.randrange(12))) for i in range(100 if rows else 90)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, text(4)) for i in range(12)], "query_id long, text string")
    words = t.terms(F.col("text"))
    tf = retrieval.postings(docs, words) if rows else retrieval.postings(docs, words).drop("row")
    lengths, terms = docs.select(F.size(words).alias("dl")), retrieval.asked_terms(asked, words)
    found = [retrieval.posted_top(retrieval.with_terms(tf, asked, words), lengths, terms, 7, most_bytes=m) for m in (None, 0)]
    few, all_ = ([tuple(x) for x in f.select("query_id", "doc_id", "score", "rank").orderBy("query_id", "rank").collect()] for f in found)
    assert few == all_ and len(few) > 50
    assert "Join" not in found[0]._jdf.queryExecution().executedPlan().toString()  # no pairs of questions and documents


def test_batches_of_any_size_are_scored_in_bounded_pieces():
    import pyarrow as pa

    class Block:
        value = (np.arange(1000), np.ones((1000, 4)))

    n = 3000
    vectors = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([[1.0] * 4] * n)], names=["vec_id", "embedding"])
    got = [(len(qid), s.shape) for qid, _, s, _ in retrieval._scored([vectors], [Block()], False)]
    assert sum(q for q, _ in got) == 1000 and max(s[0] * s[1] for _, s in got) <= retrieval.AT_ONCE * n
    texts = pa.RecordBatch.from_arrays([pa.array([["a", "b", "a"], None, []] * 1000)], names=["w"])
    parts = list(retrieval._counts([texts], pa.array(["a"])))
    assert max(b.num_rows for b, *_ in parts) <= 512 and sum(b.num_rows for b, *_ in parts) == n
    assert sum(len(term) for _, _, term, _ in parts) == 2000 and sum(length.sum() for *_, length in parts) == 3000


def test_best_fields_equals_brute_force(spark):
    r = random.Random(7)
    words = ["lois", "loi", "décisions", "decision", "laws", "law", "the", "de", "sections", "nation"]
    docs = [(i, r.choice([None, " ".join(r.choices(words, k=r.randrange(0, 9)))]) if i % 9 == 0 else " ".join(r.choices(words, k=r.randrange(1, 9))), r.choice(["fr", "en", "de", None])) for i in range(50)]
    asked = [(0, "the law decision", "en"), (1, "lois de nation", "fr"), (2, "", "en"), (3, None, None)]
    df = lambda x, i: spark.createDataFrame(x, f"{i} long, text string, lang string")
    got = [(x.query_id, x.doc_id, x.score) for x in retrieval.best_fields(df(docs, "doc_id"), df(asked, "query_id"), analyzers.analyze, 10).orderBy("query_id", "rank").collect()]
    plain = lambda x: ["".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)) for w in (x or "").lower().split()]

    def bm25(cut, none):
        d = {i: cut(x, lang) for i, x, lang in docs}
        lengths = [len(w) for i, w in d.items() if not (none and docs[i][1] is None)]
        avg, n = sum(lengths) / len(lengths), len(docs)
        out = {}
        for q, x, lang in asked:
            for term, times in Counter(cut(x, lang)).items():
                df_ = sum(term in w for w in d.values())
                for i, w in d.items():
                    tf = w.count(term)
                    if tf:
                        out[q, i] = out.get((q, i), 0) + times * math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        return out

    a, b = bm25(analyzers.tokens, False), bm25(lambda x, _: plain(x), True)
    best = {p: round(max(a.get(p, 0), 0.5 * b.get(p, 0)), 6) for p in {*a, *b}}
    want = [(q, i, s) for q, *_ in asked for (_, i), s in sorted(((p, s) for p, s in best.items() if p[0] == q), key=lambda x: (-x[1], x[0][1]))[:10]]
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)
