"""Language identification by word-first backoff.

A known word scores by its log frequency in each language.  An unseen word falls
back to character n-grams: at each of its characters the longest known n-gram
that starts there scores, progressively shorter ones at a penalty each, and the
word's score is the mean over its characters.  The language with the largest sum
over a text's words wins (ties: first by code point); the score is its share of
the posterior under a uniform prior.

The model is fitted on a bounded sample of the labelled rows: ``max_rows`` rows a
language, chosen by hash of id and text, whole texts.  The bound is on rows alone;
words seen fewer than ``min_count`` times there score by n-grams.

Besides the score, ``explained`` is the share of a text that the model has seen
something of: known words count whole, unseen ones by their characters that start a
known n-gram.  It is near 0 for a script that no learned language uses.

Null texts and texts without a letter: ``und``, score 0, explained 0.  Null
languages: not learned from.  Nothing learned: ``und`` for all.  No rows: no rows.
Repeated rows: each counts and is predicted; equal rows are drawn together.  Ties:
the first language by code point.  Very long texts: whole, a piece by themselves.
Other columns are kept, or ignored where keep leaves them out; those with the names
of results give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import text as tx
from quillon.llm.common import append, checkpoint

# Bytes of words: a-z after lower-casing, and all of non-ASCII.
LETTERS = tx.ALNUM.copy()
LETTERS[0x30:0x3A] = False
# First byte of a capital, range of its second, first byte of the small letter, distance of its second.
CAPITALS = [
    (0xC3, 0x80, 0x96, 0xC3, 0x20), (0xC3, 0x98, 0x9E, 0xC3, 0x20),  # U+00C0 to U+00DE
    (0xCE, 0x91, 0x9F, 0xCE, 0x20), (0xCE, 0xA0, 0xA9, 0xCF, -0x20),  # Greek
    (0xD0, 0x80, 0x8F, 0xD1, 0x10), (0xD0, 0x90, 0x9F, 0xD0, 0x20), (0xD0, 0xA0, 0xAF, 0xD1, -0x20),  # Cyrillic
]
# So many languages' row counts are broadcast; more are joined by a shuffle.
MANY = 10_000


def letter_words(texts: pa.Array) -> tx.Words:
    """Words of letters, lower-cased: A-Z and, in UTF-8, the capitals of two bytes in CAPITALS."""
    w = tx.words(texts, LETTERS)
    d = w.data
    lead = np.flatnonzero((d[:-1] == 0xC3) | (d[:-1] == 0xCE) | (d[:-1] == 0xD0))
    first, second = d[lead].copy(), d[lead + 1].copy()
    for byte, least, most, to, shift in CAPITALS:
        at = lead[(first == byte) & (second >= least) & (second <= most)]
        d[at] = to
        d[at + 1] += np.uint8(shift % 256)
    return w


def grams(w: tx.Words, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, index into word, place among all characters) of the n-grams of characters of the given words."""
    lens = w.end[word] - w.start[word]
    of = np.repeat(np.arange(len(word)), lens)
    at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + w.start[word][of]
    heads = (w.data[at] & 0xC0) != 0x80
    at, of = at[heads], of[heads]
    stop = w.end[word][of]
    ends = np.concatenate((at[1:], stop[-1:]))  # of one character: the next one's start, or the word's end
    ends = np.where(np.concatenate((of[1:] != of[:-1], [True])), stop, ends)
    place = np.arange(len(at))
    whole = place + n - 1 < len(at)
    whole[whole] = of[place[whole] + n - 1] == of[whole]
    return at[whole], ends[place[whole] + n - 1], of[whole], place[whole]


class Model(NamedTuple):
    langs: list[str]
    words: np.ndarray  # sorted hashes
    word_scores: np.ndarray  # words x langs
    grams: list[np.ndarray]  # by length less one, sorted hashes
    gram_scores: list[np.ndarray]
    penalty: float


def fit(rows: DataFrame, max_rows: int = 2000, min_count: int = 3, longest: int = 5, penalty: float = 1.5, seed: int = 7) -> Model:
    """rows: doc_id, text, lang to learn from; null ones are left out.  Draws at most about max_rows a language by hash."""
    rows = rows.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = checkpoint(rows.groupBy("lang").agg(F.count("*").alias("n_rows")))
    if sizes.count() <= MANY:  # a row of two numbers for each language: no text is shuffled by language
        sizes = F.broadcast(sizes)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.join(sizes, "lang").filter(draw < F.lit(float(max_rows)) / F.col("n_rows")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch, "text"):
                lang = piece.column("lang").to_pylist()
                w = letter_words(piece.column("text"))
                h = tx.word_hashes(w)
                doc = np.repeat(np.arange(piece.num_rows), np.diff(w.first))
                codes = {x: i for i, x in enumerate(sorted(set(lang)))}
                of_doc = np.array([codes[x] for x in lang])
                u, first, inv = np.unique(h, return_index=True, return_inverse=True)
                n = np.zeros((len(u), len(codes)), np.int64)
                np.add.at(n, (inv, of_doc[doc]), 1)
                names = np.array(list(codes))
                out = [(np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, str), np.zeros(0, np.int64))]
                for size in range(longest + 1):
                    if size == 0:
                        key, m = u, n
                    elif len(first):
                        a, b, of, _ = grams(w, first, size)
                        key, where = np.unique(tx.spans_hash(w.data, a, b), return_inverse=True)
                        m = np.zeros((len(key), len(codes)), np.int64)
                        np.add.at(m, where, n[of])
                    else:
                        continue
                    i, j = np.nonzero(m)
                    out.append((np.full(len(i), size, np.int32), key[i], names[j], m[i, j]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]).view(np.int64)), pa.array(np.concatenate([o[2].astype(object) for o in out]), pa.string()), pa.array(np.concatenate([o[3] for o in out]))],
                    names=["size", "key", "lang", "n"],
                )

    counts = sample.mapInArrow(count, "size int, key long, lang string, n long").groupBy("size", "key", "lang").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(_by("size", "key"))
    got = counts.withColumn("total", total).filter(F.col("total") >= min_count).drop("total").toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    code = {x: i for i, x in enumerate(langs)}
    size, key, n = (got.column(c).to_numpy() for c in ("size", "key", "n"))
    lang = np.array([code[x] for x in got.column("lang").to_pylist()], dtype=np.int64)
    tables = []
    for s in range(longest + 1):
        pick = size == s
        u, inv = np.unique(key[pick].view(np.uint64), return_inverse=True)
        m = np.zeros((len(u), max(1, len(langs))))
        np.add.at(m, (inv, lang[pick]), n[pick].astype(float))
        tables.append((u, np.log((m + 0.5) / (m.sum(0) + 0.5 * len(u) + 1.0)).astype(np.float32)))
    return Model(langs, *tables[0], [t[0] for t in tables[1:]], [t[1] for t in tables[1:]], penalty)


def _by(*c):
    from pyspark.sql import Window

    return Window.partitionBy(*c)


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in the sorted table, -1 for those that are not there."""
    if not len(table):
        return np.full(len(keys), -1)
    p = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[p] == keys, p, -1)


def scores(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts x languages: sums of log scores, words of each text, share of them that the model explains)."""
    w = letter_words(texts)
    h = tx.word_hashes(w)
    n_lang = len(model.langs)
    u, first, inv = np.unique(h, return_index=True, return_inverse=True)
    at = find(model.words, u)
    by_word = np.zeros((len(u), n_lang), np.float32)
    by_word[at >= 0] = model.word_scores[at[at >= 0]]
    new = np.flatnonzero(at < 0)
    share = np.ones(len(u))
    if len(new):
        a1, _, of1, _ = grams(w, first[new], 1)
        open_ = np.ones(len(a1), bool)
        acc = np.zeros((len(new), n_lang), np.float64)
        for n in range(len(model.grams), 0, -1):
            a, b, of, place = grams(w, first[new], n)
            todo = open_[place]
            a, b, of, place = a[todo], b[todo], of[todo], place[todo]
            got = find(model.grams[n - 1], tx.spans_hash(w.data, a, b))
            ok = got >= 0
            open_[place[ok]] = False
            s = model.gram_scores[n - 1][got[ok]] - model.penalty * (len(model.grams) - n)
            for k in range(n_lang):
                acc[:, k] += np.bincount(of[ok], weights=s[:, k], minlength=len(new))
        chars = np.maximum(np.bincount(of1, minlength=len(new)), 1)
        by_word[new] = acc / chars[:, None]
        share[new] = 1 - np.bincount(of1, weights=open_, minlength=len(new)) / chars
    out = np.zeros((len(texts), n_lang))
    for k in range(n_lang):
        c = np.concatenate(([0.0], np.cumsum(by_word[inv, k], dtype=np.float64)))
        out[:, k] = c[w.first[1:]] - c[w.first[:-1]]
    n = np.diff(w.first)
    c = np.concatenate(([0.0], np.cumsum(share[inv])))
    return out, n, (c[w.first[1:]] - c[w.first[:-1]]) / np.maximum(n, 1)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all: None), lang_pred, score and explained."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's rows

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        m, texts = shared.value, batch.column("text")
        n = len(texts)
        if not m.langs:
            return [pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n))]
        s, _, explained = scores(m, texts)
        best = s.argmax(1)
        p = 1.0 / np.exp(s - s.max(1, keepdims=True)).sum(1)
        data, offs = tx.buffer(texts)
        plain = np.concatenate(([0], np.cumsum(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A))))
        letter = plain[offs[1:]] > plain[offs[:-1]]
        for i in np.flatnonzero(~letter):  # few: texts without an ASCII letter
            letter[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
        return [pa.array([m.langs[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]), pa.array(np.where(letter, p, 0.0)), pa.array(np.where(letter, explained, 0.0))]

    return append(docs, "lang_pred string, score double, explained double", make, docs.columns if keep is None else keep)
