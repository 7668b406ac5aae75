import hashlib
import random
import re
import time

from quillon.llm import decontaminate


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1) if w else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(x) for x in wins}
    out = {}
    for i, t in docs:
        w, hit, seen = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                names = wins.get(tuple(w[k : k + n]))
                if names:
                    hit.update(range(k, k + n))
                    seen |= names
        out[i] = (len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def cases(seed, short):
    r = random.Random(seed)
    vocab = [f"W{i}" for i in range(12)] + ["é", "x-y"]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, line(r.choice((1, 2, 4, 13, 14, 30) if short else (13, 20, 40)))) for i in range(25)] + [(90, None), (91, " .,"), (10, line(15))]
    docs = [(0, None), (1, ""), (2, "...")]
    for i in range(3, 120):
        t = line(r.randrange(1, 80))
        if r.random() < 0.6:
            x = r.choice(items)[1] or ""
            w = x.split()
            t = f"{t}, {' '.join(w[r.randrange(3):])}. {line(r.randrange(0, 50))}"
        docs.append((i, t))
    return docs, items


def test_equal_brute_force(spark):
    for seed, short, block, held in ((1, False, 10_000, 10_000), (2, True, 10_000, 10_000), (3, True, 20, 10_000), (5, False, 20, 150), (6, True, 20, 150)):
        docs, items = cases(seed, short)
        got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block, held_words=held).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute(docs, items)


def test_spans_and_removal(spark):
    docs, items = cases(4, False)
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    text = dict(docs)
    for r in found.collect():
        raw = (text[r.doc_id] or "").encode()
        assert sum(len(words(raw[s.start : s.end].decode())) for s in r.spans) == r.n_hit
    left = {r.doc_id: r.text for r in decontaminate.remove_spans(found).collect()}
    want = brute(docs, items)
    assert all(left[i] == t for i, t in docs if not want[i][4])
    assert all(not want[i][4] or words(t) for i, t in left.items())


def test_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, n_hit string, spans int"
    no = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(spark.createDataFrame([], schema), no).collect() == []
    got = decontaminate.decontaminate(spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 1), (None, None, None, None)], schema), no).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit) for r in got), key=str) == [(1, 2, 0), (1, 2, 0), (None, 0, 0)]


def test_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(1, "filler " * 300_000 + item + " filler" * 50_000), (2, item)]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got} == {1: (350_020, 20, 1, False), 2: (20, 20, 1, True)}


def test_pieces_that_hit_items_of_many_blocks_stay_fast(spark):
    r = random.Random(12)
    common = [f"c{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(common, k=5) + [f"u{i}x{k}" for k in range(40)] + r.choices(common, k=100))) for i in range(4000)]
    docs = [(d, " ".join(items[(d * 37 + k * 211) % 4000][1][:250] for k in range(20))) for d in range(40)]
    group = decontaminate.Group([(str(i), decontaminate.tx.word_hashes(decontaminate.tx.words(decontaminate.pa.array([t]), decontaminate.tx.ALNUM))) for i, t in items], 13, 50_000)
    began = time.perf_counter()
    for _, t in docs:
        w = decontaminate.tx.words(decontaminate.pa.array([t]), decontaminate.tx.ALNUM)
        assert len({x for *_, names in group.find(decontaminate.tx.word_hashes(w), w.first) for x in names}) == 20
    assert time.perf_counter() - began < 8  # 600,000 words of items are twelve blocks, and every text has items of most of them
    got = decontaminate.decontaminate(spark.createDataFrame(docs[:8], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), held_words=150_000).collect()
    assert {x.n_items for x in got} == {20}


def test_columns_named_as_what_passes_hand_on(spark):
    docs, items = cases(7, True)
    df = spark.createDataFrame([(*d, "mine") for d in docs], "doc_id long, text string, __windows_found string")
    got = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_words=20, held_words=150).collect()
    assert {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got} == brute(docs, items)
    assert {x["__windows_found"] for x in got} == {"mine"}
