"""Analysed terms: stop words, elisions and stems of French and English, in an Arrow function.

The stemmers follow the published outlines of the light French stemmer and of
Porter's first steps; ranks, not the stems of some server, are the contract.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import constants as K

# Stop words of both languages.
STOP = {
    "en": set("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()),
    "fr": set("au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y est sont".split()),
}
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
FRENCH = [("issement", ""), ("issant", ""), ("ements", ""), ("ement", ""), ("ations", ""), ("ation", ""), ("ateurs", ""), ("ateur", ""), ("ments", ""), ("ment", ""), ("euses", "eu"), ("euse", "eu"), ("ives", "if"), ("ive", "if"), ("aux", "al"), ("eux", "eu"), ("ées", "e"), ("ée", "e"), ("és", "e"), ("er", "e"), ("es", "e"), ("s", ""), ("x", "")]
ENGLISH = [("sses", "ss"), ("ies", "i"), ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("ement", ""), ("ments", ""), ("ment", ""), ("ness", ""), ("ings", ""), ("ing", ""), ("edly", ""), ("ed", ""), ("ly", ""), ("ss", "ss"), ("s", "")]


@lru_cache(100_000)
def stem(word: str, lang: str) -> str:
    for end, to in FRENCH if lang == "fr" else ENGLISH:
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)] + to
    return word


def term(word: str, lang: str | None) -> str | None:
    """What a word is indexed as; None for a stop word."""
    head, _, tail = word.replace("’", "'").partition("'")
    if tail:
        word = tail if lang == "fr" and head in K.ELISIONS else head if tail == "s" else head + tail
    if lang not in STOP:
        return word
    return None if word in STOP[lang] else stem(word, lang)


def tokens(text: str | None, lang: str | None) -> list[str]:
    """The terms of one text: the definition that analyze() is tested against."""
    return [x for w in WORD.findall((text or "").lower()) if (x := term(w, lang)) is not None]


def _terms(words: pa.Array, langs: pa.Array) -> pa.Array:
    """Each distinct word of a batch is analysed once; all else is done on arrays."""
    flat, size = words.flatten().dictionary_encode(), np.asarray(pc.fill_null(pc.list_value_length(words), 0)).astype(np.int64)
    names = langs.dictionary_encode()
    kinds = [*names.dictionary.to_pylist(), None]
    lang = np.repeat(np.asarray(pc.fill_null(names.indices, len(kinds) - 1)).astype(np.int64), size)
    pair, where = np.unique(np.asarray(flat.indices).astype(np.int64) * len(kinds) + lang, return_inverse=True)
    held = flat.dictionary.to_pylist()
    found = pa.array([term(held[p // len(kinds)], kinds[p % len(kinds)]) for p in pair.tolist()], pa.string()).take(pa.array(where))
    some = np.asarray(found.is_valid())
    ends = np.concatenate(([0], np.cumsum(some)))[np.concatenate(([0], np.cumsum(size)))]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found.filter(pa.array(some)))


def analyze(text: Column, lang: Column) -> Column:
    """Terms of texts; words are cut in the JVM, null texts have none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"), F.lit(0))
    return F.arrow_udf(_terms, "array<string>")(words, lang)
