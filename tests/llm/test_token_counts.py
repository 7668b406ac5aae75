import math
import random

import pytest

from quillon.llm import token_counts


def brute(text, scores, byte):
    n, total = 0, 0.0
    for w in "".join(c if c not in " \t\n\x0b\f\r" else " " for c in text or "").split(" "):
        if not w:
            continue
        w = token_counts.MARK + w
        best = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            options = [(best[j][0] + scores[w[j:i]], -(best[j][1] + 1)) for j in range(i) if w[j:i] in scores]
            if w[i - 1] not in scores:
                k = len(w[i - 1].encode())
                options.append((best[i - 1][0] + k * byte, -(best[i - 1][1] + k)))
            s, k = max(options)
            best.append((s, -k))
        total += best[-1][0]
        n += best[-1][1]
    return n, total


@pytest.mark.parametrize("held", [40, 200_000])
def test_equal_viterbi(spark, held):
    r = random.Random(4)
    scores, byte = token_counts.vocabulary(token_counts.default_path())
    pieces = [p for p in scores if len(p) > 2][:3000]
    common = ["".join(r.choices(pieces, k=2)).replace(token_counts.MARK, "") or "x" for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "日本語 \U0001f600 naïve"), (4, "x" * 5000)]
    rows += [(i, " ".join("".join(r.choices(pieces, k=2)).replace(token_counts.MARK, "") if r.random() < 0.5 else r.choice(common) for _ in range(r.randrange(1, 40)))) for i in range(5, 60)]
    df = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string")
    df = df.repartition(4)
    got = token_counts.count_tokens(df, held=held).collect()
    assert len(got) == len(rows) + 1
    texts = dict(rows)
    for x in got:
        n, s = brute(texts[x.doc_id], scores, byte)
        assert x.n_tokens == n and x.score == pytest.approx(s) and x.n_pretokens == len((texts[x.doc_id] or "").split())
    assert math.isclose(sum(map(math.exp, scores.values())) + math.exp(byte), 1, rel_tol=1e-9)


def test_ties_take_fewer_tokens():
    assert token_counts.forward(["ab"], {"a": -1.0, "b": -1.0, "ab": -2.0}, -9.0) == ([-2.0], [1])
    assert token_counts.forward([], {}, -1.0) == ([], [])


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, n_tokens string"
    assert token_counts.count_tokens(spark.createDataFrame([], schema)).collect() == []
    assert token_counts.count_tokens(spark.createDataFrame([(None, "a", "x")], schema)).first().n_pretokens == 1


def test_stored_terminals(spark):
    rows = [(i, "the cat" if i % 2 else "the dog zz%d" % i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shared = spark.sparkContext.broadcast(token_counts.vocabulary(token_counts.default_path()))
    got = token_counts.terminals(docs, shared, 100).to_pylist()
    words = sorted(r["word"] for r in got)
    assert words == [token_counts.MARK + w for w in ("cat", "dog", "the")]
    assert {r["word"]: r["n_tokens"] for r in got} == {w: brute(w[1:], *shared.value)[0] for w in words}
    assert token_counts.terminals(docs, shared, 0).num_rows == 0


def test_very_long_text(spark):
    long = " ".join(f"word{i}" for i in range(300_000))
    got = token_counts.count_tokens(spark.createDataFrame([(1, long), (2, "word1 word2")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_pretokens for r in got} == {1: 300_000, 2: 2}
