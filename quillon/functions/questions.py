"""Column functions that understand and gate questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as t


def injections(c: Column) -> Column:
    """Names of the kinds of injection found, in fixed order."""
    return F.filter(F.array(*[F.when(c.rlike(f"(?iuU){p}"), F.lit(n)) for n, p in K.INJECTIONS.items()]), lambda x: x.isNotNull())


def gate(c: Column, strict: bool = False) -> Column:
    return c.rlike(f"(?iuU)({K.GATE_STRICT if strict else K.GATE})")


def out_of_scope(c: Column) -> Column:
    return c.rlike(rf"(?iuU)\b({'|'.join(K.OUT_OF_SCOPE)})\b")


def intent(c: Column, lang: Column, word_boundary: bool = False) -> Column:
    """Out of scope, else the intent with most keywords (ties: the first of the list), else factual.

    The plain text and the counts are bound to lambda variables, so each is computed
    once however often it is used, and generated code stays small.
    """
    once = lambda value, f: F.transform(F.array(value), f)[0]

    def best(table: dict[str, list[str]], s: Column) -> Column:
        hit = lambda w: s.rlike(rf"(?U)\b{w}\b") if word_boundary else s.contains(w)
        counts = F.array(*[sum((hit(_plain(w)).cast("int") for w in words), F.lit(0)) for words in table.values()])
        names = F.array(*map(F.lit, table))
        return once(counts, lambda n: F.when(F.array_max(n) > 0, F.get(names, F.array_position(n, F.array_max(n)).cast("int") - 1)).otherwise("factual_query"))

    found = once(t.deaccent(c), lambda s: F.when(lang == "en", best(K.INTENTS_EN, s)).otherwise(best(K.INTENTS_FR, s)))
    return F.when(out_of_scope(c), "out_of_scope").otherwise(F.coalesce(found, F.lit("factual_query")))


def _plain(word: str) -> str:
    return word.translate(str.maketrans(K.MARKED, K.PLAIN))


def entities(c: Column, most: int = 10) -> Column:
    """Legal references and regions, distinct, sorted, the first ten."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(f"(?iu){p}"), F.lit(1)) for p in K.ENTITY_PATTERNS])
    return F.slice(F.array_sort(F.array_distinct(found)), 1, most)


def expand(c: Column) -> Column:
    """The question with the expansion of the first term it has, unless it has that already."""
    s, out = F.lower(c), c
    for term, more in reversed(K.EXPANSIONS):
        out = F.when(s.contains(term) & ~s.contains(more), F.concat(c, F.lit(f" {more}"))).otherwise(out)
    return out


def valid_length(c: Column, least: int = 3, most: int = 2000) -> Column:
    n = F.length(c)
    return F.struct(n.between(least, most).alias("valid"), F.when(n < least, "too short").when(n > most, "too long").otherwise("").alias("reason"))


def valid_filename(c: Column) -> Column:
    """First failing check: traversal, extension, length."""
    ext = F.lower(F.regexp_extract(c, r"\.([^.]*)$", 1))
    bad = F.when(c.rlike(f"(?i){K.INJECTIONS['path_traversal']}"), "traversal").when(~ext.isin(K.EXTENSIONS), "extension").when(F.length(c) > 255, "length")
    return F.struct(bad.isNull().alias("valid"), F.coalesce(bad, F.lit("")).alias("reason"))


def valid_upload(size: Column, most: int = K.MAX_UPLOAD) -> Column:
    """A file of known size that is not over the limit."""
    return F.coalesce(size <= most, F.lit(False))


def plan(injected: Column, scope: Column) -> Column:
    return F.when(injected, "REFUSE_INJECTION").when(scope, "REFUSE_OUT_OF_SCOPE").otherwise("HYBRID_RAG")


def confidence_level(score: Column) -> Column:
    return F.when(score >= K.HIGH, "high").when(score >= K.CONFIDENT, "medium").when(score >= K.ESCALATE, "low").otherwise("insufficient")


def verify(score: Column, *flags: Column) -> Column:
    """Sorted distinct flags of all arrays and of the confidence."""
    own = F.filter(F.array(F.when(score < K.ESCALATE, "escalation_recommended"), F.when(score < K.CONFIDENT, "low_confidence")), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(own, *flags)))


def metadata_weight(doc_type: Column, institution: Column) -> Column:
    by_type = F.create_map(*[F.lit(x) for kv in K.TYPE_WEIGHTS.items() for x in kv])
    w = F.greatest(F.lit(0.5), F.coalesce(F.element_at(by_type, F.lower(F.coalesce(doc_type, F.lit("")))), F.lit(0.5)))
    return F.least(F.lit(1.0), w + F.when(t.any_of(F.lower(F.coalesce(institution, F.lit(""))), K.OFFICIAL), 0.1).otherwise(0.0))


def parity(fr: Column, en: Column) -> Column:
    """Smaller over larger of two scores; 1 where neither is positive, 0 where one is not."""
    return F.when((fr <= 0) & (en <= 0), 1.0).when((fr <= 0) | (en <= 0), 0.0).otherwise(F.least(fr, en) / F.greatest(fr, en))
