import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, value int, rank int, term string"


def brute(docs, least=30, top=50):
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        g = lang or "", source or ""
        groups.add(g)
        n[g].update(words)
        df[g[0]].update(set(words))
    kept = {lang: {t for t, k in c.items() if k >= least} for lang, c in df.items()}

    def shares(count, lang):
        words = kept.get(lang, set())
        below = sum(count[t] for t in words) + 5 * len(words)
        return {t: 1 + 1_000_000_000 * (count[t] + 5) // below for t in words}

    p = {g: shares(n[g], g[0]) for g in groups}
    whole = {lang: shares(sum((n[g] for g in groups if g[0] == lang), Counter()), lang) for lang in {g[0] for g in groups}}
    out = []
    for g in groups:
        pair = [(h[1], sum(abs(p[g][t] - p[h][t]) for t in p[g])) for h in groups if h[0] == g[0] and h != g]
        term = [(t, p[g][t] - whole[g[0]][t]) for t in p[g] if n[g][t] and p[g][t] > whole[g[0]][t]]
        for part, rows, most in (("pair", pair, None), ("term", term, top)):
            rows.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(*g, part, item, value, rank) for rank, (item, value) in enumerate(rows[:most], 1)]
    return sorted(out)


def run(spark, docs, **more):
    df = spark.createDataFrame([(i, *d, 1, 2, "x") for i, d in enumerate(docs)], DOCS)
    return sorted(tuple(r) for r in divergence.audit(df.repartition(5) if docs else df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def some(seed, n, langs, sources, words):
    r = random.Random(seed)
    vocab = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(words)] + ["é", "Éa", "字", "a"]
    return [(r.choice([None, "", " ".join(r.choices(vocab, [1 / (k + 1) for k in range(len(vocab))], k=r.randrange(60))) + "1A-b"]), r.choice(langs), r.choices(sources, [20] + [1] * (len(sources) - 1))[0]) for _ in range(n)]


@pytest.mark.parametrize(("seed", "bits"), [(1, 12), (2, 3)])
def test_equal_brute_force(spark, monkeypatch, seed, bits):
    monkeypatch.setattr(divergence, "CHUNK_BITS", bits)  # few terms a chunk: several chunks and slabs
    docs = some(seed, 600, ["a", None, "é", ""], ["s0", *(f"s{k}" for k in range(9)), None, "Z", "é"], 200)
    assert run(spark, docs, least=4, groups_a_block=3, chunks_a_slab=2, top=7) == brute(docs, 4, 7)


def test_defaults_hot_source_and_ties(spark):
    docs = some(3, 900, ["fr"], ["hot", "x", "y"], 60) + [("same words here", "de", s) for s in ("b", "a", "é", "B") for _ in range(10)]
    docs += [("only " * 5, "en", "s")] * 29 + [("few", "es", "s"), (None, "es", "t")]
    got = run(spark, docs)
    assert got == brute(docs)
    assert [r for r in got if r[0] == "es"] == [("es", "s", "pair", "t", 0, 1), ("es", "t", "pair", "s", 0, 1)] and not [r for r in got if r[0] == "en"]


def test_very_long_text_and_no_rows(spark):
    docs = [("Ab " * 700_000 + "z" * 100_000, "en", "long"), *[("ab cd", "en", "s")] * 40]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []


def test_shares_are_exact_for_large_counts():
    r = random.Random(4)
    n = np.array([r.randrange(10 ** r.randrange(1, 15)) for _ in range(500)], np.int64)
    total = n + np.array([r.randrange(10 ** r.randrange(1, 15)) for _ in range(500)], np.int64)
    assert divergence.shares(n, total, 7).tolist() == [1 + 1_000_000_000 * (a + 5) // (b + 35) for a, b in zip(n.tolist(), total.tolist(), strict=True)]
