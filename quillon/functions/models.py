"""Model boundaries: embedders, pair scorers, generators as Arrow functions, with defaults that need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embed = Callable[[list[str]], np.ndarray]
Score = Callable[[list[tuple[str, str]]], list[float]]
Generate = Callable[[list[str]], list[str | None]]


def hashing_embedder(dim: int = 64) -> Callable[[], Embed]:
    """Signed word hashing: the same text has the same vector anywhere.  Where a text's words cancel out, they are counted without signs, so every text with a word has a direction."""

    def load() -> Embed:
        import re
        import zlib

        word = re.compile(r"[^\W_]+")

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for row, text in zip(out, texts, strict=True):
                hashes = [zlib.crc32(w.encode()) for w in word.findall(text.lower())]
                for h in hashes:
                    row[h % dim] += 1.0 if h >> 31 else -1.0
                if not row.any():
                    for h in hashes:
                        row[h % dim] += 1.0
            return out

        return embed

    return load


def normalised(v: Column) -> Column:
    """Unit length; null for null and zero vectors."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: (x / norm).cast("float")))


def embed(text: Column, load: Callable[[], Embed] | None = None, batch: int = 32) -> Column:
    """Vectors of unit length; the model is loaded once for each worker and sees batches of at most batch texts.

    A vector of zeros has no direction and is null; a model that gives an empty vector, or none, for a text is an error.
    """
    load = load or hashing_embedder()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            texts = s.fillna("").tolist()
            rows = [v for i in range(0, len(texts), batch) for v in np.asarray(model(texts[i : i + batch]), dtype=float)]
            if len(rows) != len(texts) or any(not len(v) for v in rows):
                raise ValueError("the embedder gave no vector for some text")
            yield pd.Series([(v / n).tolist() if (n := np.linalg.norm(v)) > 0 else None for v in rows])

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(text)


def pair_score(question: Column, passage: Column, load: Callable[[], Score], fallback: Column) -> Column:
    """A cross-encoder's scores; where it fails or gives none, the fallback."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            try:
                yield pd.Series(model(list(zip(a, b, strict=True))), dtype=float)
            except Exception:  # scoring is optional; ranks fall back
                yield pd.Series([None] * len(a), dtype=float)

    return F.coalesce(F.nanvl(F.pandas_udf(run, T.DoubleType())(question, passage), F.lit(None).cast("double")), fallback)


def generate(prompt: Column, load: Callable[[], Generate], fallback: Column, batch: int = 8) -> Column:
    """A generator's answers; where it fails or gives none, the fallback.  Null prompts are not asked."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            out: list[str | None] = [None] * len(s)
            asked = [i for i, x in enumerate(s) if x is not None]
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                try:
                    for i, answer in zip(part, model([s.iloc[i] for i in part]), strict=True):
                        out[i] = answer or None
                except Exception:  # one failing batch must not end the job; its rows fall back
                    continue
            yield pd.Series(out, dtype=object)

    return F.coalesce(F.pandas_udf(run, T.StringType())(prompt), fallback)
