import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import hard_negatives

ROWS = "vec_id long, embedding array<float>, label int, row string, score int, v string"


def brute(rows, every=3):
    ok = [(i, np.floor(256 * np.asarray(v, np.float32).astype(float)), lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, lab) in enumerate(ok):
        if i % every:
            continue
        others = [(-int(v @ w), j, m) for b, (j, w, m) in enumerate(ok) if b != a and len(w) == len(v)]
        for ps, p, _ in sorted(x for x in others if x[2] == lab)[:5]:
            fit = sorted((s, j) for s, j, m in others if m != lab and -50 * ps <= -100 * s <= -95 * ps)[:3]
            out += [(i, p, rank, j, -ps, -s) for rank, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, every=3, **more):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], ROWS)
    return sorted(map(tuple, hard_negatives.mine(df.repartition(3) if rows else df, F.col("vec_id") % every == 0, **more).collect()))


def clustered(seed, n, dim=6):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    return [(i, [x + r.gauss(0, 0.2) for x in r.choice(centres)], r.randrange(3)) for i in range(n)]


@pytest.mark.parametrize(("seed", "block"), [(1, 7), (2, 40)])
def test_equal_brute_force_in_many_small_annuli(spark, seed, block):
    rows = clustered(seed, 400)
    assert run(spark, rows, block=block, anchors_a_task=10) == brute(rows)


def test_annuli_of_several_parts(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "DIRECTORY", 4)
    rows = clustered(3, 300)
    assert run(spark, rows, block=10, every=7) == brute(rows, 7)


def test_copies_ties_lengths_and_rows_without_part(spark):
    rows = clustered(4, 60) + [(1000 + i, [1.0] * 6, i % 2) for i in range(60)] + [(2000 + i, [0.5 * (i % 4), 1.0], i % 3) for i in range(40)]
    rows += rows[:20] + [(3000, [], 1), (3003, [], 1), (3006, [], 2), (None, [1.0] * 6, 1), (3009, None, 1), (3012, [1.0, None], 1), (3015, [float("nan")] * 6, 1), (3018, [float("inf")] * 6, 0), (3021, [1.0] * 6, None), (3024, [3e38] * 6, 1)]
    rows += [(4000 + i, [0.0] * 6, i % 2) for i in range(6)] + [(5001, [0.1] * 5000, 1), (5004, [0.2] * 5000, 1), (5007, [0.15] * 5000, 2)]
    got = run(spark, rows, block=16)
    assert got == brute([r for r in rows if r[0] != 3024])
    assert run(spark, []) == [] and run(spark, [(None, None, None)]) == [] and run(spark, [(3, [1.0], 1)]) == []


def test_bounds_hold_and_spare_annuli(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 8)) * 300
    x = np.floor(centres[r.integers(0, 20, 3000)] + r.normal(size=(3000, 8)) * 10).astype(np.int32)
    own = (x.astype(np.int64) ** 2).sum(1)
    length2 = float(own.max())
    lifted = hard_negatives._lifted([y.tobytes() for y in x], own, length2)
    books = hard_negatives.lloyd(lifted, 20, r)
    d = np.sqrt(hard_negatives.distances(lifted, books))
    pivot, key = d.argmin(1), d.min(1)
    order = np.lexsort((key, pivot))
    cut = [c for p in range(20) for c in np.array_split(order[pivot[order] == p], 4) if len(c)]
    space = hard_negatives.Space(books, np.sqrt(hard_negatives.distances(books, books)), length2, np.arange(len(cut)), np.array([pivot[c[0]] for c in cut]), np.array([key[c].min() for c in cut]), np.array([key[c].max() for c in cut]), np.array([len(c) for c in cut]), np.ones(len(cut), int))
    spared = 0
    for q in range(0, 3000, 100):
        at = hard_negatives.view(space, x[q].tobytes())
        true = np.sqrt(own[q] + length2 - 2.0 * (x.astype(np.int64) @ x[q].astype(np.int64)))
        assert all(at.low[i] <= true[c].min() + 1e-9 and true[c].max() <= at.high[i] + 1e-9 for i, c in enumerate(cut))
        fifth = np.sort(true)[5]
        spared += sum(at.low > fifth)
    assert spared > 0.5 * 30 * len(cut)


def test_scores_beyond_floating_point_are_exact(spark):
    big = [2.0**20 + 1.0 / 8, 2.0**20 + 1.0 / 4]
    rows = [(0, big, 0), (3, [2.0**20, 2.0**20 + 0.5], 0), (4, [2.0**20, 2.0**19], 1), (5, [2.0**19, 2.0**20], 1)]
    ints = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(ints[a], ints[b], strict=True))
    got = run(spark, rows)
    assert got and all(ps == dot(a, p) and ns == dot(a, n) for a, p, _, n, ps, ns in got)
