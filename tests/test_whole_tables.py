"""Queries over vectors against brute force over all pairs; neighbours and relevant rows lie in any block of ids."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

import __spark_entry__ as entry

N = 460


def rounded(x):
    return float(Decimal(repr(float(x))).quantize(Decimal("0.000001"), ROUND_HALF_UP))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)], r.choice([0, 1, 2, None])) for i in range(N)]
    path = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path), rows


@pytest.fixture(scope="module")
def brute(tables):
    """query: {doc: (score, second, final, rel)} over all other vectors."""
    x = np.array([r[1] for r in tables[1]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s, label = np.round(x @ x.T, 6), [r[2] for r in tables[1]]
    w = [min(1.0, [1.0, 0.8, 0.7, 0.5, 0.5][d % 5] + (0.1 if d % 3 != 1 else 0.0)) for d in range(N)]
    same = lambda a, b: label[a] is not None and label[a] == label[b]
    return {q: {d: (s[q, d], (d * 7919 + q) % 1009, rounded(0.85 * s[q, d] + 0.15 * w[d]), 1.0 + d % 2 if same(q, d) else 0.0) for d in range(N) if d != q} for q in range(0, N, 20)}


def best(docs, k, value):
    return sorted(docs, key=lambda d: (-value(docs[d]), d))[:k]


def measures(ranked, docs, k):
    rel = [docs[d][3] for d in ranked]
    ideal = sorted((v[3] for v in docs.values() if v[3]), reverse=True)
    dcg = lambda g: sum(x / math.log2(i + 2) for i, x in enumerate(g[:k]))
    hits = sum(x > 0 for x in rel[:k])
    first = next((i for i, x in enumerate(rel, 1) if x), None)
    return hits / k, hits / len(ideal) if ideal else 0.0, float(hits > 0), dcg(rel) / dcg(ideal) if ideal else 0.0, 1 / first if first else 0.0


def rows(spark, tables, name):
    return entry.queries()[name](spark, tables[0]).collect()


def test_metrics(spark, tables, brute):
    want = {(q, k): measures(best(d, 10, lambda v: v[0]), d, k) for q, d in brute.items() for k in (1, 3, 5, 10)}
    for name, at in (("precision_recall_at_k", (0, 1)), ("ndcg_at_k", (3,)), ("hit_rate_at_k", (2,))):
        got = {(r.query_id, r.k): tuple(r)[2:] for r in rows(spark, tables, name)}
        assert got == {key: pytest.approx([m[i] for i in at], abs=1e-6) for key, m in want.items()}
    mean = lambda i, k: sum(want[q, k][i] for q in brute) / len(brute)
    assert rows(spark, tables, "mrr")[0].mrr == pytest.approx(mean(4, 10), abs=1e-6)
    for r in rows(spark, tables, "aggregate_metrics"):
        assert [r.precision, r.recall, r.hit, r.ndcg, r.mrr] == pytest.approx([mean(i, r.k) for i in range(5)], abs=1e-4)
    gain = {q: measures(best(d, 10, lambda v: v[2]), d, 5)[3] - measures(best(d, 10, lambda v: v[0]), d, 5)[3] for q, d in brute.items()}
    assert {r.query_id: r.gain for r in rows(spark, tables, "reranker_gain")} == pytest.approx(gain, abs=2e-6)


def test_rankings(spark, tables, brute):
    got = rows(spark, tables, "rerank_meta")
    assert sorted((r.query_id, r["rank"], r.doc_id, r.final_score) for r in got) == [(q, i, x, d[x][2]) for q, d in brute.items() for i, x in enumerate(best(d, 5, lambda v: v[2]), 1)]
    fused, many = {}, {}
    for q, d in brute.items():
        for by, k in ((lambda v: v[0], 20), (lambda v: v[1], 20)):
            for i, x in enumerate(best(d, k, by), 1):
                fused[q, x] = fused.get((q, x), 0) + 1 / (60 + i)
        for by in (lambda v: v[0], lambda v: v[1], lambda v: v[1] % 97):
            for i, x in enumerate(best(d, 10, by), 1):
                many[q, x] = many.get((q, x), 0) + 1 / (60 + i)
    assert {(r.query_id, r.doc_id): r.rrf_score for r in rows(spark, tables, "rrf_many")} == pytest.approx(many, abs=1e-8)
    got = rows(spark, tables, "rrf_fusion")
    assert len(got) == 20 * len(brute) and all(r.rrf_score == pytest.approx(fused[r.query_id, r.doc_id], abs=1e-8) for r in got)
    for q in brute:
        assert sorted((r.rrf_score for r in got if r.query_id == q), reverse=True) == pytest.approx(sorted((v for (a, _), v in fused.items() if a == q), reverse=True)[:20], abs=1e-8)


def test_ablations_and_levels(spark, tables, brute):
    runs = {b: {} for b in ("B0", "B1", "B2", "B3", "B4")}
    for q, d in brute.items():
        sparse, dense = best(d, 20, lambda v: v[1]), best(d, 20, lambda v: v[0])
        at = lambda l, x: l.index(x) + 1 if x in l else 10**6
        part = lambda l, x: 1 / (60 + at(l, x)) if x in l else 0.0
        fused = sorted({*sparse, *dense}, key=lambda x: (-round(part(dense, x) + part(sparse, x), 9), at(dense, x), at(sparse, x), x))[:20]
        some = {x: d[x] for x in fused}
        for b, ranked in (("B0", sparse), ("B1", dense), ("B2", fused), ("B3", best(some, 10, lambda v: v[0])), ("B4", best(some, 10, lambda v: v[2]))):
            runs[b][q] = ranked
    for r in rows(spark, tables, "ablations"):
        m = [measures(runs[r.baseline][q], d, r.k) for q, d in brute.items()]
        assert [r.precision, r.recall, r.hit, r.ndcg, r.mrr] == pytest.approx([sum(x) / len(m) for x in zip(*m, strict=True)], abs=1e-4)
    most = {q: max(v[0] for v in d.values()) for q, d in brute.items()}
    assert {r.query_id: r.score for r in rows(spark, tables, "confidence_level")} == pytest.approx(most, abs=1e-6)
    low = lambda q: most[q] < 0.6 or q % 40 != 0
    assert {r.query_id: "low_confidence" in r.flags for r in rows(spark, tables, "verify_flags")} == {q: low(q) for q in brute}
