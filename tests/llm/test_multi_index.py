import os

import numpy as np
import pytest

from quillon.llm import multi_index


def brute(ids, x, least=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= least
    np.fill_diagonal(hit, False)
    comp = np.array(ids)
    while True:
        new = np.minimum(comp, np.where(hit, comp[None], np.iinfo(np.int64).max).min(1))
        if (new == comp).all():
            return hit.sum(1), comp
        comp = new


def clustered(seed, n, dim=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 6, dim))
    x = centres[r.integers(0, len(centres), n)] + r.normal(size=(n, dim)) * r.choice([0.02, 0.1, 0.3], (n, 1))
    x[n // 2 : n // 2 + n // 20] = x[0]
    return x.astype(np.float32)


def test_recall_and_no_false_links(spark):
    x = clustered(1, 900)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), words=8, block=64).collect()}
    n, comp = brute(range(len(x)), x.astype(np.float64))
    mine = np.array([got[i].n_links for i in range(len(x))])
    assert (mine <= n).all() and mine.sum() >= 0.9 * n.sum()
    assert np.mean([got[i].component_id == comp[i] for i in range(len(x))]) > 0.9
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_unusable_vectors_repeats_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int, n_links string"
    assert multi_index.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    v = [1.0, 0.0, 0.0, 0.0]
    rows = [(0, None, 1, "x"), (1, [], 1, "x"), (2, [0.0] * 4, 1, "x"), (3, [1.0, None, 0.0, 0.0], 1, "x"), (4, [float("nan"), 0.0, 0.0, 1.0], 1, "x"), (5, [float("inf"), 0.0, 0.0, 1.0], 1, "x")]
    rows += [(6, v, 1, None), (7, v, 2, None), (8, [2.0, 0.0, -0.0, 0.0], 3, None), (9, [0.0, 1.0, 0.0, 0.0], None, None), (None, v, None, None)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multi_index.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert {i: got[i] for i in range(6)} == {i: (0, i, True) for i in range(6)}
    assert got[6] == (2, 6, True) and got[7] == (2, 6, False) and got[8] == (2, 6, False) and got[9] == (0, 9, True)
    assert got[None][1:] == (None, False)


def test_repeated_ids_keep_links_of_their_own(spark):
    e = np.eye(8)
    near = lambda i: (e[i] + 0.1 * e[7]).tolist()
    rows = [(1, e[0].tolist()), (1, e[1].tolist()), (2, near(0)), (3, near(1)), (4, (e[1] - 0.05 * e[7]).tolist()), (5, e[5].tolist())]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), words=3).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (5, 0, 5)]


def test_vectors_of_every_length_are_linked(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(2, 300, 8))] + [(1000 + i, v.tolist()) for i, v in enumerate(clustered(3, 260, 6))]
    rows += [(2000, [1.0, 2.0]), (2001, [1.0, 2.0]), (2002, [2.0, 4.1]), (2003, [3.0]), (2004, [5.0]), (2005, [-5.0]), (2006, [0.1] * 3000), (2007, [0.1] * 2999 + [0.2])]
    got = {r.vec_id: r for r in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), words=4, block=100).collect()}
    for dim in {len(v) for _, v in rows}:
        mine = [(i, v) for i, v in rows if len(v) == dim]
        n, comp = brute([i for i, _ in mine], np.array([v for _, v in mine], np.float32).astype(np.float64))
        found = np.array([got[i].n_links for i, _ in mine])
        assert (found <= n).all() and found.sum() >= 0.9 * n.sum()
        if dim not in (8, 6):
            assert found.tolist() == n.tolist() and [got[i].component_id for i, _ in mine] == comp.tolist()


def test_threshold_is_inclusive(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0, 1.0]), (3, [0.0, 0.0, -1.0, 0.0])]  # a cosine of one half, exact in binary
    got = {r.vec_id: r.component_id for r in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least=0.5, words=1).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_recall_with_production_parameters(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {r.vec_id: r for r in multi_index.near_duplicates(df).collect()}
    rows = df.orderBy("vec_id").collect()
    usable = [r for r in rows if r.embedding and np.isfinite(np.array(r.embedding, float)).all() and np.any(r.embedding)]
    n, _ = brute([r.vec_id for r in usable], np.array([r.embedding for r in usable], np.float64))
    mine = np.array([got[r.vec_id].n_links for r in usable])
    assert (mine <= n).all() and mine.sum() >= 0.9 * n.sum() and len(got) == len(rows)
