"""cer and prompt_context take all documents and whole texts."""

import hashlib
import random

import pytest

import __spark_entry__ as entry
from quillon.operators import answers, metrics


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    r = random.Random(3)
    assert [metrics.edit_distance(a, b) for a, b in (("", ""), ("", "ab"), ("abc", ""), ("kitten", "sitting"))] == [0, 2, 3, 3]
    for _ in range(150):
        a, b = ("".join(r.choices("aeé😀\n", k=r.randrange(150))) for _ in "ab")
        assert metrics.edit_distance(a, b) == brute(a, b)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    r = random.Random(4)
    texts = ["", "e", "plain text here", "é" * 30 + "e tab\t", None] + ["".join(r.choices("aceé \t", k=700)) for _ in range(5)]
    path = tmp_path_factory.mktemp("texts")
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path), texts


def test_cer(spark, docs):
    got = {r.doc_id: r.cer for r in entry.queries()["cer"](spark, docs[0]).collect()}
    want = {i: None if t is None else brute(t, t[2:].replace("e", "c")) / len(t) if t else 0.0 for i, t in enumerate(docs[1])}
    assert set(got) == set(want) and got[4] is None
    assert {i: v for i, v in got.items() if i != 4} == pytest.approx({i: v for i, v in want.items() if i != 4}, abs=1e-6)


def test_prompt_context(spark, docs):
    got = {r.query_id: r.context for r in entry.queries()["prompt_context"](spark, docs[0]).collect()}
    block = lambda i, t: f"\n[DOCUMENT {i % 5 + 1}] Source: s" + (f", p. {i % 7}" if i % 3 and i % 7 else "") + (" [loi]" if i % 4 == 0 else "") + f"\nScore: {i / 1000:.3f}\n{t}"
    want = answers.HEADS["fr"][0] + "\n" + "\n".join(block(i, docs[1][i]) for i in range(5, 10))
    assert got[1] == hashlib.md5(want.encode()).hexdigest()
