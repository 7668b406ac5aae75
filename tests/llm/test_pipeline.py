import random

import corpus_pipeline
from tests.llm import test_decontaminate, test_minhash, test_mixing, test_suffix_dedup


def fixture():
    r = random.Random(8)
    lexicon = {x: ["".join(r.choices(s, k=r.randrange(2, 9))) for _ in range(250)] for x, s in (("en", "abcdefgh"), ("fr", "ijklmnéè"), ("de", "opqrstuß"))}
    item = " ".join(r.choices(lexicon["en"], k=30))
    passage = " ".join(r.choices(lexicon["fr"], k=80))
    rows = [(0, None, "en", "a", 0), (1, "123 -- 4", "en", "a", 8), (2, "", None, None, 0)]
    for i in range(3, 90):
        lang = r.choice(list(lexicon))
        w = r.choices(lexicon[lang], k=r.randrange(40, 160))
        if i % 9 == 0:
            w[5:5] = passage.split()
            lang = lang if len(w) > 150 else "fr"
        if i % 11 == 0:
            w[3:3] = item.split()
        t = " ".join(w)
        if i % 7 == 0:
            t = rows[-1][1] + " tail" if rows[-1][1] else t
            lang = rows[-1][2]
        rows.append((i, t, lang, r.choice(["a", "b", None]), len(t)))
    return rows, [(0, item), (1, None)]


def test_stages_equal_brute_force(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
    language, near, suffix, clean, mixed = kept.values()
    assert {r.doc_id for r in language} == {r[0] for r in rows} - {0, 1, 2}

    comp = test_minhash.brute([(r.doc_id, r.text) for r in language], 5)
    assert {r.doc_id for r in near} == {i for i, (_, c) in comp.items() if i == c}
    assert len(near) < len(language)

    left = test_suffix_dedup.brute_words([(r.doc_id, r.text) for r in near], corpus_pipeline.PASSAGE_WORDS)
    assert sum(left[r.doc_id] != r.text for r in near) > 0
    assert {r.doc_id: r.text for r in suffix} == {i: t for i, t in left.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in suffix)

    hits = test_decontaminate.brute([(r.doc_id, r.text) for r in suffix], items)
    for before in suffix:
        after = [r.text for r in clean if r.doc_id == before.doc_id]
        n, h, *_, bad = hits[before.doc_id]
        assert after == [before.text] if not bad else all(test_decontaminate.brute([(0, t)], items)[0][1] == 0 for t in after)

    want = test_mixing.brute([(r.doc_id, r.text, r.source) for r in clean])
    assert {r.doc_id: (r.size, r.taken) for r in mixed} == {i: x for i, x in want.items() if x[1]}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, mixed))


def test_one_row_of_each_group_stays_whatever_its_id(spark, tmp_path):
    r = random.Random(9)
    texts = [" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(4)]
    ids = [(7, 0), (7, 0), (None, 1), (None, 1), (None, 2), (5, 2), (9, 2), (3, 3), (3, 0)]  # id 3: two texts
    rows = [(i, texts[t], "en", "a", len(texts[t])) for i, t in ids]
    path = f"{tmp_path}/d.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    near = corpus_pipeline.checkpoint(corpus_pipeline.near_dedup(spark, spark.read.parquet(path), str(tmp_path)))
    want = sorted([(3, texts[0]), (0, texts[1]), (5, texts[2]), (3, texts[3])])
    assert sorted((x.doc_id or 0, x.text) for x in near.collect()) == want
    left = corpus_pipeline.suffix_array_dedup(spark, near, str(tmp_path))
    assert sorted((x.doc_id or 0, x.text) for x in left.collect()) == want


def test_other_columns_come_out_as_they_went_in(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["score", "kept", "n_words", "lang_pred", "component_id", "id", "spans", "_hit", "_key", "_row2", "explained", "stamp"]
    wide = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in names]) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == wide.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = docs.collect()
        assert got and all(x[n] == f"{n}{x.doc_id}" for x in got for n in names)
    assert corpus_pipeline.mixing_sources(spark, docs, str(tmp_path)).count() > 0


def test_empty_tables_and_only_the_columns_needed(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_script_of_no_learned_language_goes(spark, tmp_path):
    r = random.Random(3)
    words = {"en": "abcdefgh", "fr": "ijklmnop"}
    rows = [(i, " ".join("".join(r.choices(words[x], k=5)) for _ in range(40)), x, "a", 0) for i in range(40) for x in ["en" if i % 2 else "fr"]]
    rows += [(100, "это совсем другой язык и другое письмо", None, "a", 0), (101, "日本語のテキスト", None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.lang for x in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()}
    assert got == {i: x for i, _, x, *_ in rows[:40]}


def test_passages_are_counted_in_words(spark, tmp_path):
    r = random.Random(10)
    own = lambda n: " ".join("".join(r.choices("klmnop", k=9)) for _ in range(n))
    short = " ".join(r.choice("abcdefghij") + r.choice(["", "x"]) for _ in range(51))  # some 130 bytes
    long = " ".join("".join(r.choices("qrstuv", k=12)) for _ in range(40))  # over 500 bytes
    rows = [(i, f"{own(30)} {'([' [i % 2]}{p}{')]' [i % 2]} {own(30)}", "en", "a", 0) for i, p in enumerate([short, short, long, long])]
    left = {x.doc_id: x.text for x in corpus_pipeline.suffix_array_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path)).collect()}
    assert all(short[3:-3] not in left[i] and len(left[i].split()) == 62 for i in (0, 1)) and all(left[i] == rows[i][1] for i in (2, 3))


def test_very_long_text(spark, tmp_path):
    r = random.Random(11)
    lexicon = ["".join(r.choices("abcdefgh", k=6)) for _ in range(5000)]
    long = " ".join(r.choices(lexicon, k=200_000))
    passage = " ".join(r.choices(lexicon, k=60))
    rows = [(1, f"{long} {passage} end", "en", "a", 0), (2, f"{' '.join(r.choices(lexicon, k=50))} {passage} other", "en", "b", 0)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    left = {x.doc_id: x.text for x in corpus_pipeline.suffix_array_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert {i: len(t.split()) for i, t in left.items()} == {1: 200_001, 2: 51}
    assert {x.doc_id: x.size for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1: 200_001, 2: 51}
