import hashlib
import random
import re

import pytest

from quillon.llm import mixing


def brute(rows, weights=(3, 1, 2), share=1.5, cap=2.0):
    """{doc_id: (size, taken)}; targets by resharing the excess until none is above."""
    size = {i: len([x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]) for i, t, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, pool, open_ = dict.fromkeys(names, 0.0), share * sum(total.values()), list(names)
    while open_:
        level = pool / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > cap * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = cap * total[s]
            pool -= target[s]
            open_.remove(s)
    out = {}
    for s in names:
        budget, n = int(target[s] + 1e-9), total[s]
        epochs = budget // n if n else 0
        left = budget - epochs * n
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest()):
            more = min(max(left, 0), size[i])
            left -= size[i]
            out[i] = (size[i], epochs * size[i] + more)
    return out


def rows_of(seed, n=300):
    r = random.Random(seed)
    return [(i, r.choice([None, "", "a b\tc", "w " * r.randrange(200)]), r.choices(["b", "a", "é", "Z", None, ""], [9, 3, 1, 1, 1, 0.3])[0]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_brute_force(spark, seed):
    rows = rows_of(seed)
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), digits=1).collect()
    assert {r.doc_id: (r.size, r.taken) for r in got} == brute(rows)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
        assert all(r.taken <= 2 * r.size for r in mine)


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string, source string, size string, target int"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    assert [(r.size, r.taken, r.target) for r in mixing.mix(spark.createDataFrame([(None, None, None, "x", 1)], schema)).collect()] == [(0, 0, 0.0)]
    got = mixing.mix(spark.createDataFrame([(1, "a b", "s", "x", 1)] * 2, schema)).collect()
    assert sum(r.taken for r in got) == 6


def test_very_long_text_is_cut_at_the_budget(spark):
    rows = [(1, "word " * 400_000, "a"), (2, "one two", "b")]
    got = {r.doc_id: (r.size, r.taken) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1][0] == 400_000 and got[2] == (2, 4) and got[1][1] == 599_999
