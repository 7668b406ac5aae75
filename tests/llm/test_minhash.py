import random
import re

import numpy as np

from quillon.llm import minhash


def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def rows_of(n=150, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "x y"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "one two"), (6, "ONE  two\n")]
    while len(rows) < n:
        base = [r.choice(vocab) for _ in range(r.choice((2, 5, 40, 120)))]
        for _ in range(r.choice((1, 1, 3, 40))):
            w = list(base)
            for _ in range(r.choice((0, 1, 2, 4))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    return rows


def test_components_equal_brute_force(spark):
    for k in (2, 5):
        rows = rows_of()
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_region_loses_no_component(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):  # all alike, links at the edge of the threshold
        w = list(base)
        for _ in range(r.choice((1, 2, 3, 4, 5))):
            w[r.randrange(60)] = f"n{r.random()}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2, small=8, near=1).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows, 2)


def test_empty_table_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, component_id string, n_shingles int, a int"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e f", "x", 1, 1), (1, "a b c d e f", "x", 1, 1), (None, "a b c d e f", None, None, None), (2, "a b c d e f", "y", 2, 2)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, False)]


def test_large_regions_in_blocks_and_deep_orders(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(x if r.random() > 0.04 else f"n{r.random()}" for x in base)) for i in range(90)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2, small=6, leaf=2, near=1, deep=3, block=10).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows, 2)


def test_parts_descend_on_their_own():
    region = np.array([1] * 6 + [2] * 2)
    tail = np.array([[0, 0], [0, 1], [0, 2], [5, 0], [5, 0], [5, 0], [9, 9], [9, 8]])
    wide, part, whole = minhash.descend(region, tail, small=4, leaf=2)
    assert wide.tolist() == [True] * 6 + [False] * 2
    assert part.tolist() == [1, 2, 3, 4, 4, 4, 5, 5]
    assert whole.tolist() == [True] * 3 + [False] * 3 + [True] * 2


def test_repeated_ids_with_other_texts_link_both(spark):
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "x"])), (3, " ".join([*b[:-1], "y"])), (4, "alone")]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_threshold_is_exact(spark):
    same = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join([*same, *(f"a{i}" for i in range(10))])), (2, " ".join([*same, *(f"b{i}" for i in range(10))])), (3, " ".join([*(f"v{i}" for i in range(79)), *(f"c{i}" for i in range(10))])), (4, " ".join([*(f"v{i}" for i in range(79)), *(f"d{i}" for i in range(11))]))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}  # 80 of 100, and 79 of 100


def test_very_long_text(spark):
    long = " ".join(f"w{i % 9973}x{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " more"), (3, "short one")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (199_996, 1), 2: (199_997, 1), 3: (1, 3)}
