import math
import random
import re
import unicodedata
from collections import Counter

import pytest

from quillon.llm import langid

LEX = {"de": "abdefghß", "en": "eioustrn", "fr": "aeiléèmp"}


def corpus(n, seed):
    r = random.Random(seed)
    lex = {x: ["".join(r.choices(s, k=r.randrange(1, 9))) for _ in range(120)] for x, s in LEX.items()}
    rows = []
    for i in range(n):
        lang = r.choice(list(lex))
        w = [x if r.random() < 0.8 else "".join(r.choices(LEX[lang], k=6)) for x in r.choices(lex[lang], k=r.randrange(1, 40))]
        rows.append((i, " ".join(w).title() if r.random() < 0.2 else ", ".join(w), lang))
    return rows


def fold(text):
    return "".join(c.lower() if c.isascii() or ("À" <= c <= "Þ" and c != "×") else c for c in text)


def brute(train, texts, longest=5, least=3, penalty=1.5):
    """The same scores by dictionaries."""
    words = lambda t: re.findall("[a-z\x80-\U0010ffff]+", fold(t))
    counts = [Counter() for _ in range(longest + 1)]
    for _, t, lang in train:
        for w in words(t):
            counts[0][w, lang] += 1
            for n in range(1, longest + 1):
                counts[n].update((w[i : i + n], lang) for i in range(len(w) - n + 1))
    langs = sorted({x for *_, x in train})
    tables = []
    for c in counts:
        total = Counter()
        for (g, _), k in c.items():
            total[g] += k
        keys = [g for g, k in total.items() if k >= least]
        size = {x: sum(c[g, x] for g in keys) for x in langs}
        tables.append({g: [math.log((c[g, x] + 0.5) / (size[x] + 0.5 * len(keys) + 1)) for x in langs] for g in keys})

    def word(w):
        if w in tables[0]:
            return tables[0][w]
        out = [0.0] * len(langs)
        for i in range(len(w)):
            for n in range(longest, 0, -1):
                g = w[i : i + n]
                if len(g) == n and g in tables[n]:
                    out = [o + s - penalty * (longest - n) for o, s in zip(out, tables[n][g], strict=True)]
                    break
        return [o / len(w) for o in out]

    got = []
    for t in texts:
        s = [sum(x) for x in zip(*map(word, words(t)), strict=True)]
        best = max(range(len(langs)), key=lambda k: (s[k], -k))
        got.append((langs[best], 1 / sum(math.exp(x - s[best]) for x in s)))
    return got


def test_equal_brute_force_and_accurate(spark):
    rows = corpus(400, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id < 250"), max_rows=10_000)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    want = brute(rows[:250], [t for _, t, _ in rows])
    for (i, _, _), (lang, score) in zip(rows, want, strict=True):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-4)
    held = [got[i].lang_pred == lang for i, _, lang in rows[250:]]
    assert sum(held) / len(held) > 0.97


def test_sample_is_bounded(spark):
    df = spark.createDataFrame(corpus(600, 3), "doc_id long, text string, lang string")
    small, large = langid.fit(df, max_rows=20), langid.fit(df, max_rows=10_000)
    assert len(small.words) < len(large.words) and small.langs == large.langs


def test_texts_without_letters_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, score string"
    df = spark.createDataFrame([(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 — 3!", None, "x"), (4, "été", "fr", "x"), (4, "été", "fr", "x"), (5, "日本", None, None)], schema)
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(df, langid.fit(df)).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "fr"), (4, "fr"), (5, got[-1][1])] and got[-1][1] != "und"
    none = spark.createDataFrame([], schema)
    assert langid.identify(none, langid.fit(none)).collect() == []
    assert {r.lang_pred for r in langid.identify(df, langid.fit(none)).collect()} == {"und"}
    assert unicodedata.category("日") == "Lo"


def test_capitals_of_three_scripts():
    import pyarrow as pa

    both = ["École ÑANDÚ Ω", "ΑΒΓ ΠΡΣ Ωμέγα", "ЁЖ ПРИВЕТ Яблоко ЩУКА"]
    got = langid.letter_words(pa.array(both))
    want = langid.letter_words(pa.array([x.lower().replace("ς", "σ") for x in both]))
    assert got.data.tobytes() == want.data.tobytes()


def test_very_long_text(spark):
    rows = [(i, "alpha beta gamma " * 5 if i % 2 else "uno dos tres " * 5, "x" if i % 2 else "y") for i in range(20)]
    df = spark.createDataFrame([*rows, (99, "uno dos " * 500_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.explained) for r in langid.identify(df, langid.fit(df)).collect()}
    assert got[99] == ("y", 1.0)
