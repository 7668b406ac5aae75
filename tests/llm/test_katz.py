import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import katz
from quillon.llm.common import bundle, integers, numbers, planes, unbundle


def words(t):
    return [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]


class Brute:
    """The same model by dictionaries."""

    def __init__(self, rows, k, order):
        self.k, self.order = k, order
        self.uni, self.after = Counter(), [defaultdict(Counter) for _ in range(order + 1)]
        for _, t, train in rows:
            if train:
                seq = ["<s>"] * (order - 1) + [*words(t), "</s>"]
                for i in range(order - 1, len(seq)):
                    self.uni[seq[i]] += 1
                    for n in range(2, order + 1):
                        self.after[n][tuple(seq[i - n + 1 : i])][seq[i]] += 1
        self.n = sum(self.uni.values())
        count = lambda c: np.array([sum(x == r for x in c) for r in range(1, k + 2)])
        self.d = {1: katz.discounts(count(self.uni.values()), k)}
        self.d |= {n: katz.discounts(count([x for c in self.after[n].values() for x in c.values()]), k) for n in range(2, order + 1)}
        self.den = self.n + (min(self.uni.values(), default=1) > k)
        self.unk = 1 - sum(self.disc(1, c) for c in self.uni.values()) / self.den if self.n else 1.0

    def disc(self, n, c):
        return c * (self.d[n][c - 1] if c <= self.k else 1)

    def p(self, h, w):
        if not h:
            return self.disc(1, self.uni[w]) / self.den if self.uni[w] else self.unk
        n = len(h) + 1
        c = self.after[n].get(h)
        if not c:
            return self.p(h[1:], w)
        den = sum(c.values()) + (min(c.values()) > self.k)
        if c.get(w):
            return self.disc(n, c[w]) / den
        left = 1 - sum(self.disc(n, x) for x in c.values()) / den
        return left / (1 - sum(self.p(h[1:], x) for x in c)) * self.p(h[1:], w)

    def score(self, t):
        seq = ["<s>"] * (self.order - 1) + [*words(t), "</s>"]
        return sum(math.log10(self.p(tuple(seq[i - self.order + 1 : i]), seq[i])) for i in range(self.order - 1, len(seq)))


def corpus(n, vocab, seed):
    r = random.Random(seed)
    v = [f"Word{i}" for i in range(vocab)] + ["é", "x.", "\x0b"]
    weights = [1 / (i + 1) for i in range(len(v))]
    rows = [(0, None, True), (1, "", False), (2, " \n", True)]
    return rows + [(i, " ".join(r.choices(v, weights, k=r.randrange(1, 60))), r.random() < 0.8) for i in range(3, n)]


@pytest.mark.parametrize(("hot", "order"), [(2000, 2), (8, 2), (2000, 3), (20, 3), (50, 4)])
def test_scores_equal_brute_force(spark, monkeypatch, hot, order):
    monkeypatch.setattr(katz, "HOT", hot)
    rows = corpus(200, 300, 4)
    got = {r.doc_id: r for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), order=order, block_bytes=4000, tokens_a_part=500).collect()}
    b = Brute(rows, 5, order)
    assert len(got) == len(rows)
    for i, t, train in rows:
        seq = [*words(t), "</s>"]
        r = got[i]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (train, len(seq), sum(b.uni[w] > 0 for w in seq), b.n)
        assert r.base_score == pytest.approx(sum(math.log10((b.uni[w] + 1) / (b.n + len(b.uni) + 1)) for w in seq))
        assert r.score == pytest.approx(b.score(t), rel=1e-9, abs=1e-9)


def test_probabilities_sum_to_one():
    rows = corpus(120, 40, 6)
    b = Brute(rows, 5, 3)
    seen = [w for w in b.uni if b.uni[w]]
    assert sum(b.p((), w) for w in seen) + b.unk == pytest.approx(1)
    for h in [*b.after[2], *list(b.after[3])[:300], ("never",), ("never", "never")]:
        assert sum(b.p(h, w) for w in seen) + b.p(h, "never") == pytest.approx(1)


def test_nothing_to_learn_from_and_empty(spark):
    schema = "doc_id long, text string, train boolean, block int"
    assert katz.score(spark.createDataFrame([], schema)).collect() == []
    got = katz.score(spark.createDataFrame([(1, "a b", False, 1), (1, "a b", None, 1), (None, None, False, None)], schema)).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=str) == [(1, 3, 0, 0.0, 0.0), (1, 3, 0, 0.0, 0.0), (None, 1, 0, 0.0, 0.0)]


def test_very_long_text_and_words_of_one_key(spark):
    long = " ".join(f"w{i % 7919}" for i in range(400_000))
    rows = [(1, long, True), (2, "w1 w2 w3 new w4", False), (3, "x" * 3_000_000, True)]
    got = {r.doc_id: r for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).collect()}
    assert (got[1].n_tokens, got[2].n_known, got[3].n_tokens) == (400_001, 5, 2)
    b = Brute(rows, 5, 3)
    assert got[2].score == pytest.approx(b.score(rows[1][1]))


def test_keys_of_different_words_are_told_apart():
    key = np.array([7, 7, 7, 7, 3], np.uint64)
    by, new = katz.ordered(key, np.array([2, 1, 2, 1, 5]))
    assert new.sum() == 3 and by[0] == 4


def test_ngrams_are_ordered_in_less_time_than_an_argsort_takes():
    """The sort is most of the operator's CPU time.  Keys as contexts give them: many n-grams with equal upper bits."""
    r = np.random.default_rng(1)
    word = r.integers(0, 1 << 30, 600_000)
    key = (r.integers(0, 20_000, len(word)).astype(np.uint64) << np.uint64(49)) | katz.tx.mix(word.view(np.uint64)) >> np.uint64(15)

    def cpu(f):
        took = []
        for _ in range(7):
            t = time.process_time()
            f()
            took.append(time.process_time() - t)
        return min(took)

    assert cpu(lambda: katz.ordered(key, word)) < cpu(lambda: np.argsort(key))
    by, new = katz.ordered(key, word)
    want = np.lexsort((word, key))
    assert (key[by] == key[want]).all() and (word[by] == word[want]).all()
    assert new.sum() == len(np.unique(np.stack([key.view(np.int64), word]), axis=1).T)


def test_different_ngrams_with_equal_upper_bits_are_told_apart():
    r = np.random.default_rng(2)
    key, word = r.integers(0, 40, 5000).astype(np.uint64), r.integers(0, 30, 5000)
    by, new = katz.ordered(key, word)
    want = np.lexsort((word, key))
    assert (key[by] == key[want]).all() and (word[by] == word[want]).all() and new.sum() == len(set(zip(key.tolist(), word.tolist(), strict=True)))


@pytest.mark.parametrize("hot", [0, 3])
def test_a_block_too_large_for_one_number_finds_the_same_ngrams(monkeypatch, hot):
    r = np.random.default_rng(3)
    n, often, count = np.array([700, 1, 299]), np.arange(50)[::-1], np.append(r.integers(1, 9, 49), 0)
    rank = r.integers(0, 50, n.sum())
    rows = [{"level": 0, "ids": [1, 2, 3], "a": bundle(*map(planes, (np.array([True, False, True]), n, rank, often)))}, {"level": 1, "part": 0, "a": bundle(planes(count), planes(np.arange(50) + 2))}]
    got = []
    for room in (63, 0):
        monkeypatch.setattr(katz, "ROOM", room)
        t = katz.Texts(rows, katz.Unigram(int(count.sum()), 49, np.ones(6, np.int64), 5), 3)
        t.climb(2, np.sort(t.hash[:hot]), 7)
        got.append([t.gram.tolist(), t.context.tolist(), t.last.tolist(), t.cut.tolist(), t.edge.tolist(), sorted(t.messages(9, 2))])
    assert got[0] == got[1]
    context = [katz.BEGIN, *t.name[t.word][:-1]]
    context[700] = context[701] = katz.BEGIN
    pairs = [(context[i], t.name[t.word[i]]) for i in t.at]
    assert len(set(zip(pairs, t.gram, strict=True))) == len(set(pairs)) == len(t.last)


def test_bundles_hold_what_they_were_given():
    for size in (0, 3, 9000):
        a, b, c = np.arange(size) * 70_001, np.linspace(-1, 1, size), np.ones(size, bool)
        x, y, z = unbundle(bundle(planes(a), planes(b), planes(c)[:, : size // 2]))
        assert integers([x, x]).tolist() == [*a, *a] and numbers([y]).view(np.float64).tolist() == b.tolist() and integers([z]).tolist() == [1] * (size // 2)
