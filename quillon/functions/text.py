"""Column functions on text.  Null in, null out, unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import constants as K


def strip(c: Column) -> Column:
    """White space at both ends, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


def drop_controls(c: Column) -> Column:
    """Without characters of the categories C, but for newline and tab."""
    return F.regexp_replace(c, r"[\p{C}&&[^\n\t]]", "")


def fix_pdf(c: Column) -> Column:
    """Ligatures spelt out, words joined over line ends, lines of a lone number blanked."""
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, r"(?U)-\n(\w)", "$1")
    return F.regexp_replace(c, r"(?mdU)^\s*\d+\s*$", "")


def drop_page_numbers(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~strip(x).rlike(r"(?U)^-?\s*\d+\s*-?$")), "\n")


def plain_punctuation(c: Column, lang: Column) -> Column:
    c = F.replace(F.translate(c, "«»“”–—", '""""--'), F.lit("…"), F.lit("..."))
    return F.when(lang == "fr", F.regexp_replace(c, r"(?U)\bArt\.\s+", "Article ")).otherwise(c)


def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Only texts with a character from U+0300 on, which alone can change, leave the JVM."""
    changed = F.pandas_udf(_nfc, T.StringType())(F.when(c.rlike(r"[\x{300}-\x{10FFFF}]"), c))
    return F.coalesce(changed, c)


def clean(c: Column, lang: Column, normalise: bool = True) -> Column:
    """The cleaning pipeline in its fixed order; normalise=False for texts known to be NFC stays within the JVM."""
    c = drop_controls(nfc(c) if normalise else c)
    return squeeze(plain_punctuation(drop_page_numbers(fix_pdf(c)), lang))


def token_count(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / K.CHARS_A_TOKEN).cast("int"))


def truncate(c: Column, n: int, suffix: str = "...") -> Column:
    cut = F.regexp_replace(F.substring(c, 1, n - len(suffix)), r"(?U)\s+$", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(cut, F.lit(suffix)))


def sufficient(c: Column, least: int = 50) -> Column:
    s = strip(c)
    return (F.length(s) >= least) & ~s.rlike(r"(?U)^[\W\d\s]+$")


def _bases() -> tuple[str, str]:
    """Letters with marks and their bases, of the Latin blocks, and after them the marks by themselves, which have none."""
    whole = [chr(i) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    parts = [(x, unicodedata.normalize("NFD", x)) for x in whole]
    pairs = [(x, d[0]) for x, d in parts if len(d) > 1 and all(unicodedata.category(m) == "Mn" for m in d[1:])]
    return "".join(x for x, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


WITH_MARKS, WITHOUT = _bases()


def deaccent(c: Column) -> Column:
    """Lower-cased, letters without their marks: canonical decomposition less the marks, for Latin letters."""
    return F.translate(F.lower(c), WITH_MARKS, WITHOUT)


def percent(c: Column, places: int = 1) -> Column:
    """A share as text, 0.123 as 12.3%; a dash for null."""
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f%%", F.round(c * 100, places))).otherwise("—")


def sanitize(c: Column) -> Column:
    """A query without control characters and script openings, on one line."""
    c = F.regexp_replace(nfc(c), r"[\p{Cc}&&[^\n\t]]", "")
    c = F.regexp_replace(c, f"(?iuU){K.INJECTIONS['xss']}", "")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def query_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def terms(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")


def any_of(c: Column, words: list[str]) -> Column:
    """Some of the words is a substring."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def first_of(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """Name of the first pattern found between word boundaries."""
    out = F.lit(None).cast("string")
    for name, p in reversed(patterns):
        out = F.when(c.rlike(rf"(?iuU)\b(?:{p.replace(K.EDGE, chr(92) + 'b')})\b"), F.lit(name)).otherwise(out)
    return out


def doc_type(c: Column) -> Column:
    return first_of(F.substring(c, 1, 500), K.DOC_TYPES)


def institution(c: Column) -> Column:
    return first_of(F.substring(c, 1, 1000), K.INSTITUTIONS)


def jurisdiction(c: Column) -> Column:
    """Common-law regions, then the trade treaty, then civil-law regions, as substrings of the first 2000 characters."""
    s = F.lower(F.substring(c, 1, 2000))
    return F.when(any_of(s, K.COMMON_LAW), "common_law").when(s.contains("ohada"), "ohada").when(any_of(s, K.CIVIL_LAW), "civil_law")


def document_date(c: Column) -> Column:
    """yyyy-mm-dd of the first numeric date, else of the first month (in the year's order) that has one; not validated."""
    part = lambda i: F.regexp_extract(c, r"(?U)\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b", i)
    out = F.lit(None).cast("string")
    for m, name in reversed(list(enumerate(K.MONTHS, 1))):
        p = rf"(?iuU)\b(\d{{1,2}})\s+{name}\s+(\d{{4}})\b"
        out = F.when(c.rlike(p), F.concat_ws("-", F.regexp_extract(c, p, 2), F.lit(f"{m:02d}"), F.lpad(F.regexp_extract(c, p, 1), 2, "0"))).otherwise(out)
    return F.when(part(3) != "", F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))).otherwise(out)


def article_number(c: Column) -> Column:
    s = strip(c)
    return F.coalesce(*[F.nullif(F.regexp_extract(s, f"(?iuU){p}", 1), F.lit("")) for p in K.ARTICLE_PATTERNS])


def is_separator(c: Column) -> Column:
    return strip(c).rlike(rf"(?iuU)^{K.STRUCTURE}")


def language_heuristic(c: Column) -> Column:
    return F.when(c.rlike(f"[{K.ACCENTED}]"), "fr").otherwise("en")


def metadata(text: Column, doc_type_: Column, institution_: Column, jurisdiction_: Column) -> Column:
    """Given values win over detected ones; only the first 5000 characters are looked at."""
    head = F.substring(text, 1, 5000)
    given = lambda g, d: F.coalesce(F.nullif(g, F.lit("")), d)
    return F.struct(
        given(doc_type_, doc_type(head)).alias("doc_type"), given(institution_, institution(head)).alias("institution"), given(jurisdiction_, jurisdiction(head)).alias("jurisdiction"),
        document_date(head).alias("date_document"), F.try_to_date(document_date(head), "yyyy-MM-dd").alias("date_valid"), F.length(head).alias("char_count"),
    )


# Frequent function words that tell the two languages apart.
FUNCTION_WORDS = {"fr": ["le", "la", "les", "des", "du", "et", "un", "une", "dans", "pour", "que", "qui", "sur", "au", "est", "par"], "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "on", "as", "by", "was", "are", "this", "be"]}


def detect_language(c: Column, least: int = 20) -> Column:
    """language, confidence, bilingual by shares of function words; short texts and ties are French."""
    w = terms(c)
    n = {x: F.size(F.filter(w, lambda v: v.isin(FUNCTION_WORDS["fr"]))) if x == "fr" else F.size(F.filter(w, lambda v: v.isin(FUNCTION_WORDS["en"]))) for x in FUNCTION_WORDS}
    total = n["fr"] + n["en"]
    fr, en = (F.when(total > 0, n[x] / F.greatest(total, F.lit(1))).otherwise(0.0) for x in ("fr", "en"))
    long = F.coalesce(F.length(c) >= least, F.lit(False))
    return F.struct(F.when(long & (en > fr), "en").otherwise("fr").alias("language"), F.when(long, F.greatest(fr, en)).otherwise(0.0).alias("confidence"), (long & (fr >= 0.3) & (en >= 0.3)).alias("bilingual"))
