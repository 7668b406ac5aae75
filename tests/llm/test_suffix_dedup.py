import hashlib
import random
import re
from collections import Counter

import numpy as np

from quillon.llm import suffix_dedup


def brute_kept(rows, length):
    seen = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, kept))
    return out


def brute_words(rows, length):
    """{id: what is left} without the windows of length words that stand more than once; texts of which no word is left are not there."""
    placed = {i: [(m.start(), m.end(), re.sub("[A-Z]", lambda x: x[0].lower(), m[0])) for m in re.finditer("[^\x20\x09-\x0d]+", t or "")] for i, t in rows}
    seen = Counter(tuple(x[2] for x in w[k : k + length]) for w in placed.values() for k in range(len(w) - length + 1))
    out = {}
    for i, t in rows:
        w, gone = placed[i], set()
        for k in range(len(w) - length + 1):
            if seen[tuple(x[2] for x in w[k : k + length])] > 1:
                gone.update(range(w[k][0], w[k + length - 1][1]))
        left = "".join(c for k, c in enumerate(t or "") if k not in gone)
        if left.strip("\x20\x09\x0a\x0b\x0c\x0d") or not gone:
            out[i] = left
    return out


def brute(rows, length):
    return sorted(((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute_kept(rows, length)), key=str)


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé\n ") for _ in range(r.randrange(1, 8)))
    passages = ["".join(word() for _ in range(30)) for _ in range(6)]
    out = [None, "", "short", "a" * 900, "ab" * 400, "a" * 300]
    for _ in range(40):
        t = "".join(word() for _ in range(r.randrange(5, 120)))
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            p = p[r.randrange(0, 30) : len(p) - r.randrange(0, 30)]
            at = r.randrange(len(t) + 1)
            t = t[:at] + p + t[at:]
        out.append(t)
    copy = list(out[10])
    for _ in range(3):
        out.append("".join(copy))
        copy[r.randrange(len(copy))] = "Z"
    return list(enumerate(out))


def check(spark, rows, length, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.dedup(df, length=length, keep=["doc_id"], **more).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(i, (t or "").encode()) for i, t in rows], length)


def test_equal_brute_force(spark):
    check(spark, texts(1), 60, gram=16)
    check(spark, [*texts(2), *texts(2)[:12]], 100, gram=32)


def test_large_buckets_have_shorter_chunks(spark):
    for most in (1, 2, 5):
        check(spark, texts(3), 60, gram=16, most=most)


def test_cores_with_many_chunks_are_parted(spark):
    r = random.Random(9)
    passage = "".join(r.choice("abcd") for _ in range(70))
    around = lambda: "".join(r.choice("xy") for _ in range(40))
    rows = [*texts(4), *enumerate((around() + passage[r.randrange(8) :] + around() for _ in range(80)), 1000)]
    for batch in (1, 2, 3, 20):
        check(spark, rows, 60, gram=16, batch=batch)


def test_no_collection_is_larger_than_its_bound():
    # a passage that 4,000 texts go on from in ways of their own: before, one collection of all of them
    r = random.Random(10)
    group = {(r.randbytes(60), r.randbytes(60)): None for _ in range(4000)}
    parts = list(suffix_dedup.narrow(66, [(a, b, (0, b"", 0)) for a, b in group], 50))
    assert max(len(p) for _, p, _ in parts) <= 50


def test_least_of_long_ranges_takes_no_memory_for_them():
    import tracemalloc

    a = np.arange(200_000, dtype=np.int32)[::-1].copy()
    lo = np.random.default_rng(1).integers(0, 1000, 2000)
    hi = np.random.default_rng(2).integers(199_000, 200_001, 2000)
    tracemalloc.start()
    got = suffix_dedup.least(a, lo, hi)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [int(a[i:j].min()) for i, j in zip(lo, hi, strict=True)]
    assert peak < 4e6  # before, 8 bytes for each place of each range: 3 GB


def test_passages_under_the_length_are_counted(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 5)))
    passages = [" ".join(word() for _ in range(52)) for _ in range(3)]
    rows = [(i, " ".join([*(word() for _ in range(r.randrange(80))), *r.sample(passages, i % 3), word(), word()])) for i in range(12)]
    rows += [(20, None), (21, ""), (22, "one"), (23, rows[1][1])]
    words = {i: (t or "").split() for i, t in rows}
    seen = Counter(tuple(w[k : k + 49]) for w in words.values() for k in range(len(w) - 48))
    want = {i: len({j for k in range(len(w) - 48) if seen[tuple(w[k : k + 49])] > 1 for j in range(k, k + 49)}) for i, w in words.items()}
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"], passage=49).collect()
    assert {x.doc_id: x.n_passage_words for x in got} == want and 0 < sum(n > 0 for n in want.values()) < 13
    assert sorted(map(str, (tuple(x)[:5] for x in got))) == sorted(map(str, brute([(i, (t or "").encode()) for i, t in rows], 400)))


def test_one_hot_bucket(spark):
    r = random.Random(6)
    hot = "=" * 40  # the same bytes in every text, other ones around them
    rows = [(i, "".join(r.choices("abc", k=r.randrange(20, 60))) + hot + "".join(r.choices("xy", k=r.randrange(0, 30)))) for i in range(150)]
    check(spark, [*rows, *((1000 + i, t) for i, t in rows[:20])], 60, gram=16, most=10, batch=30)


def test_very_long_text(spark):
    r = random.Random(2)
    long = "".join(r.choices("abcdefghij ", k=2_300_000))
    rows = [(1, long), (2, "start#" + long[1_048_300:1_049_000] + "#end"), (3, "z" * 300)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect()}
    assert got == {1: (2_300_000, 700, 1), 2: (710, 700, 1), 3: (300, 0, 0)}


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, kept string, n int, bucket string"
    assert suffix_dedup.dedup(spark.createDataFrame([], schema), keep=["doc_id"]).collect() == []
    rows = [(1, "x" * 500, "k", 1, "b"), (None, None, None, None, None)]
    got = {r.doc_id: (r.bucket, r.n_removed) for r in suffix_dedup.dedup(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("b", 500), None: (None, 0)}


def test_column_construction_sorts_suffixes():
    r = random.Random(9)
    docs = [bytes(r.choice(b"ab") for _ in range(r.randrange(5, 40))) for _ in range(12)]
    rows = np.zeros((12, 40), np.uint16)
    for row, d in zip(rows, docs, strict=True):
        row[40 - len(d) :] = np.frombuffer(d, np.uint8).astype(np.uint16) + 1
    c = suffix_dedup.Columns(rows)
    order = [docs[o][len(docs[o]) - s :] for o, s in zip(c.owner.tolist(), c.size.tolist(), strict=True)]
    assert order == sorted(order)
    for x, y, l in zip(order, order[1:], c.lcp[1:].tolist(), strict=False):
        assert l == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_repeated_words_equal_brute_force(spark):
    rows = [(i, (t or "").replace("\n", " \n") if i % 5 else t) for i, t in texts(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.kept for x in suffix_dedup.dedup(df, length=9, keep=["doc_id"], unit="word", out="text").collect()}
    want = brute_words(rows, 9)
    assert {i: t for i, t in got.items() if i in want} == want and all(not t.strip() for i, t in got.items() if i not in want)
    assert sum(want.get(i) != (t or "") for i, t in rows) > 5
