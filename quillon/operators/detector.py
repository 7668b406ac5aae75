"""A trained language detector: naive Bayes over character trigrams, and the languages that a text switches between.

``fit`` counts trigrams of the labelled texts in a job and commits the most frequent as a
table; the model that tasks get is at most ``most`` trigrams for each language.
``detect`` scores segments of some words: their sum names the text's language, and the
share of segments in each language tells mixed texts.

The answer is French or English: other languages that were learned, texts of fewer than
``least`` characters and texts without a known trigram are French.  Texts are whole.
Ties go to the language whose name comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import versions

PIECE = 1 << 20  # characters that are worked on at once, as far as texts are shorter


class Model(NamedTuple):
    langs: list[str]
    grams: np.ndarray  # sorted
    score: np.ndarray  # grams and, in the last row, others x languages: log probabilities
    prior: np.ndarray


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigrams as numbers, place of the word of each, text of each word) of lower-cased letters, with a space at both ends of a word."""
    low = [(x or "").lower() for x in texts]
    a = np.frombuffer(" ".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(low) + 1), [*(len(x) + 1 for x in low), 1])  # a text with the space before it, and the last space
    inside = _letters()[np.minimum(a, 0xFFFF)] & (a < 0x10000)
    a = np.where(inside, a, 32)
    keep = inside | np.concatenate(([True], inside[:-1]))  # of several spaces the first
    a, inside, text = a[keep], inside[keep], text[keep]
    middle = np.flatnonzero(inside[1:-1]) + 1
    word = np.cumsum(inside & ~np.concatenate(([False], inside[:-1]))) - 1
    first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    return a[middle - 1] << 32 | a[middle] << 16 | a[middle + 1], word[middle], text[first]


def _pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    size, at = 0, 0
    for i, n in enumerate(batch.column(column).to_pylist()):
        size += len(n or "")
        if size >= PIECE:
            yield batch.slice(at, i + 1 - at)
            size, at = 0, i + 1
    if at < batch.num_rows:
        yield batch.slice(at)


def fit(docs: DataFrame, root: str, most: int = 50_000) -> int:
    """Commits the counts of the most frequent trigrams of docs (text, lang) by language to root, in place of a model that is there; returns the version."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                gram, word, text = trigrams(piece.column("text").to_pylist())
                lang = piece.column("lang").dictionary_encode()
                names, of = lang.dictionary, np.asarray(lang.indices)
                for k in range(len(names)):
                    mine, n = np.unique(gram[of[text[word]] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(mine), k))), pa.array(mine), pa.array(n)], names=["lang", "gram", "n"])

    spark = docs.sparkSession
    counts = versions.kept(docs.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    frequent = counts.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(most).select("gram")
    return versions.replace(spark, root, [versions.write(counts.join(frequent, "gram", "left_semi").coalesce(1), root, "trigrams")])


def load(spark: SparkSession, root: str, at: int | None = None) -> Model:
    rows = versions.read(spark, root, "trigrams", at).toArrow()  # most rows for each language at most
    lang, n = rows.column("lang").to_pylist(), rows.column("n").to_numpy()
    langs = sorted(set(lang))
    grams, where = np.unique(rows.column("gram").to_numpy(), return_inverse=True)
    counts = np.zeros((len(grams) + 1, len(langs)))
    counts[where, [langs.index(x) for x in lang]] = n
    total = counts.sum(0)
    return Model(langs, grams, np.log((counts + 0.5) / (total + 0.5 * len(counts))), np.log(total / max(total.sum(), 1) if len(langs) else total))


def detect(docs: DataFrame, model: Model, keep: list[str], least: int = 20, segment: int = 8, mixed: float = 0.3) -> DataFrame:
    """The columns keep of docs and language (fr or en), detected (a learned language, null without a known trigram), confidence, share_fr, share_en (of the segments), bilingual."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("language", "detected", "confidence", "share_fr", "share_en", "bilingual")]
    out = T.StructType([docs.schema[c] for c in keep] + list(T.StructType.fromDDL("language string, detected string, confidence double, share_fr double, share_en double, bilingual boolean")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                texts = piece.column("text").to_pylist()
                found = scores(shared.value, texts, segment)
                rows = [answer(shared.value, x, f, least, mixed) for x, f in zip(texts, found, strict=True)]
                columns = zip(*rows, strict=True)
                types = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=out.fieldNames())

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, out)


def scores(model: Model, texts: list[str | None], segment: int) -> list[np.ndarray]:
    """Of each text its segments' sums of log probabilities (segments x languages); segments without a known trigram are left out."""
    gram, word, text = trigrams(texts)
    at = np.minimum(np.searchsorted(model.grams, gram), max(len(model.grams) - 1, 0))
    known = model.grams[at] == gram if len(model.grams) else np.zeros(len(gram), bool)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    part = (np.arange(len(text)) - first[text]) // segment
    # segments are numbered through all texts
    size = -(-np.diff(first) // segment)
    base = np.concatenate(([0], np.cumsum(size)))
    of = (base[text] + part)[word]
    out = np.zeros((int(base[-1]), len(model.langs)))
    for k in range(len(model.langs)):
        out[:, k] = np.bincount(of[known], weights=model.score[at[known], k], minlength=len(out))[: len(out)]
    some = np.bincount(of[known], minlength=len(out))[: len(out)] > 0
    return [out[a:b][some[a:b]] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def answer(model: Model, text: str | None, found: np.ndarray, least: int, mixed: float) -> tuple:
    if len((text or "").strip()) < least or not len(found) or not model.langs:
        return "fr", None, 0.0, 0.0, 0.0, False
    whole = found.sum(0) + model.prior
    best = int(whole.argmax())
    share = np.bincount(found.argmax(1), minlength=len(model.langs)) / len(found)
    fr, en = (float(share[model.langs.index(x)]) if x in model.langs else 0.0 for x in ("fr", "en"))
    confidence = float(1 / np.exp(whole - whole[best]).sum())
    return "en" if model.langs[best] == "en" else "fr", model.langs[best], confidence, fr, en, fr >= mixed and en >= mixed
