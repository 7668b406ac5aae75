import math
import os
import random
from collections import Counter

import pytest

from quillon.operators import detector
from quillon.plans import stored


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return [[f" {w} "[i : i + 3] for i in range(len(w))] for w in words]


def test_equal_brute_force(spark, tmp_path):
    r = random.Random(2)
    letters = {"fr": "abcdeé", "en": "cdefgh", "de": "efghßx"}
    text = lambda x, n: " ".join("".join(r.choices(letters[x], k=r.randrange(1, 7))) for _ in range(n))
    docs = [(i, text(x, r.randrange(1, 40)) + r.choice(["", "!", " 12"]), x) for i in range(120) for x in [r.choice(list(letters))]] + [(900, None, "fr"), (901, "", "en"), (902, "abc", None)]
    root = f"file://{tmp_path}/model"
    detector.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), root, most=150)
    counts = {x: Counter(g for _, t, y in docs if y == x for w in grams(t) for g in w) for x in letters}
    every = sum(counts.values(), Counter())
    kept = sorted(every, key=lambda g: (-every[g], [ord(c) for c in g]))[:150]
    total = {x: sum(c[g] for g in kept) for x, c in counts.items()}
    log = lambda x, g: math.log((counts[x][g] + 0.5) / (total[x] + 0.5 * 151))
    asked = [*((i, t, "clash") for i, t, _ in docs), (950, text("fr", 40) + " " + text("en", 40), "clash"), (951, "日本 12 ???" * 9, "x"), (952, text("en", 3000), "x")]
    got = {x.doc_id: x for x in detector.detect(spark.createDataFrame(asked, "doc_id long, text string, language string"), detector.load(spark, root), ["doc_id", "language"]).collect()}
    for i, t, _ in asked:
        words = [[g for g in w if g in kept] for w in grams(t)]
        parts = [[sum(log(x, g) for w in words[k : k + 8] for g in w) for x in sorted(letters)] for k in range(0, len(words), 8) if any(words[k : k + 8])]
        x = got[i]
        if len((t or "").strip()) < 20 or not parts:
            assert (x.language, x.detected, x.confidence, x.bilingual) == ("fr", None, 0.0, False)
            continue
        whole = [sum(p[k] for p in parts) + math.log(total[y] / sum(total.values())) for k, y in enumerate(sorted(letters))]
        best = sorted(letters)[whole.index(max(whole))]
        shares = Counter(sorted(letters)[p.index(max(p))] for p in parts)
        assert (x.detected, x.language) == (best, "en" if best == "en" else "fr")
        assert (x.share_fr, x.share_en) == pytest.approx((shares["fr"] / len(parts), shares["en"] / len(parts)))
        assert x.confidence == pytest.approx(1 / sum(math.exp(w - max(whole)) for w in whole), rel=1e-6)
    assert got[950].bilingual and not got[952].bilingual


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_accuracy_on_held_out_documents(spark):
    held = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null and length(trim(text)) >= 20 and crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").select("doc_id", "lang")
    rows = stored.lang_detect_trained(spark, SF).join(held, "doc_id").collect()
    right = sum(r.detected == r.lang for r in rows)
    assert len(rows) > 200 and right >= 0.99 * len(rows) and all(r.language == ("en" if r.detected == "en" else "fr") for r in rows)
