import math

import pytest
from pyspark.sql import functions as F

from quillon.operators import metrics


def run(spark, ranked, relevant, k):
    runs = spark.createDataFrame([(0, d, i) for i, d in enumerate(ranked, 1)], "query_id long, doc_id string, rank int")
    qrels = spark.createDataFrame([(0, d, r) for d, r in relevant.items()], "query_id long, doc_id string, rel double")
    return metrics.at_k(runs, qrels, spark.createDataFrame([(0,)], "query_id long"), [k]).first()


@pytest.mark.parametrize(
    ("metric", "ranked", "relevant", "k", "want"),
    [
        ("precision", "abc", "abc", 3, 1.0), ("precision", "abc", "de", 3, 0.0), ("precision", "abc", "ab", 3, 2 / 3), ("precision", "abcd", "cd", 2, 0.0), ("precision", "", "a", 5, 0.0),
        ("recall", "ab", "ab", 2, 1.0), ("recall", "cd", "ab", 2, 0.0), ("recall", "ac", "ab", 2, 0.5), ("recall", "a", "", 1, 0.0),
        ("hit", "abc", "b", 3, 1.0), ("hit", "abc", "c", 2, 0.0), ("rr", "abc", "a", 3, 1.0), ("rr", "bac", "a", 3, 0.5), ("rr", "bc", "a", 3, 0.0),
    ],
)
def test_cut_offs(spark, metric, ranked, relevant, k, want):
    assert run(spark, ranked, dict.fromkeys(relevant, 1.0), k)[metric] == pytest.approx(want)


def test_ndcg(spark):
    assert run(spark, "ab", {"a": 1.0, "b": 0.5}, 2).ndcg == pytest.approx(1)
    swapped = (0.5 / math.log2(2) + 1 / math.log2(3)) / (1 / math.log2(2) + 0.5 / math.log2(3))
    assert run(spark, "ba", {"a": 1.0, "b": 0.5}, 2).ndcg == pytest.approx(swapped)
    assert run(spark, "cd", {"a": 1.0}, 2).ndcg == 0


def test_answers(spark):
    df = spark.createDataFrame([("A long enough sentence stands here. Short. Another sentence that nobody knows at all.", "a long enough sentence stands here", ["Doc1", ""])], "answer string, context string, names array<string>")
    r = df.select(metrics.faithfulness(F.col("answer"), F.col("context")).alias("f"), metrics.faithfulness(F.lit("Short."), F.col("context")).alias("none"), metrics.citation_precision(F.lit("x [Source: doc1, p. 2] [Ref: zzz]"), F.col("names")).alias("p"), metrics.citation_precision(F.lit("x"), F.col("names")).alias("no")).first()
    assert tuple(r) == (0.5, 1.0, 0.5, 0.0)


def test_latency_and_error_rate(spark):
    s = metrics.latency(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double"), "v").first()
    assert (s.p50, s.p75, s.mean, s.n) == (2.5, 3.25, 2.5, 4)
    e = spark.createDataFrame([("", ""), ("", "x"), ("abcd", "abxd")], "r string, h string").select(metrics.character_error_rate(F.col("r"), F.col("h")).alias("c")).collect()
    assert [x.c for x in e] == [0.0, 1.0, 0.25]


def test_generation_summary_leaves_refusals_out(spark):
    rows = spark.createDataFrame([("fr", False, 1.0, 0.8), ("en", False, 0.5, 1.0), ("en", True, 0.0, 0.0)], "lang string, is_refusal boolean, citation_precision double, faithfulness double")
    s = metrics.generation_summary(rows).first()
    assert (round(s.refusal_rate, 3), s.citation_precision, s.faithfulness, s.isb, s.meets) == (0.333, 0.75, 0.9, 0.8, False)
