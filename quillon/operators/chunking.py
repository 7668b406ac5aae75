"""Text chunks: fixed-size overlapping windows, structural segments, and their mixture.

Cutting points depend on the text and on the cut before, so a document is cut in
an Arrow function; documents are independent of each other and nothing is
shuffled.  A window always moves on: where the only white space stands at the
overlap's end, the window is cut hard.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import constants as K
from quillon.functions import text as t
from quillon.operators import versions

_HEADS = re.compile(rf"^{K.STRUCTURE}", re.I | re.M)
_REF = re.compile(r"^(Article|Section)\s+(\d+)", re.I)


def fixed(text: str, most: int, overlap: int) -> list[str]:
    """Windows of at most ``most`` characters; ends at the last space or line end after the overlap."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + most
        if end < len(text):
            cut = max(text.rfind(" ", start + overlap, end), text.rfind("\n", start + overlap, end))
            if cut > start + overlap:
                end = cut
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def structural(text: str, most: int, overlap: int) -> list[tuple[str, str, str | None]]:
    """(content, strategy, article) of the segments between headings; long ones cut by windows."""
    heads = [m.start() for m in _HEADS.finditer(text) if m.start() > 0]
    if not heads:
        return [(c, "fixed_size", _ref(c)) for c in fixed(text, most, overlap)]
    out: list[tuple[str, str, str | None]] = []
    for i, j in zip([0, *heads], [*heads, len(text)], strict=True):
        segment = text[i:j].strip()
        if segment and len(segment) // K.CHARS_A_TOKEN * K.CHARS_A_TOKEN <= most:
            out.append((segment, "structural", _ref(segment)))
        elif segment:
            out += [(c, "hybrid", _ref(segment)) for c in fixed(segment, most, overlap)]
    return out


def _ref(segment: str) -> str | None:
    m = _REF.match(segment)
    return f"{m[1].capitalize()} {m[2]}" if m else None


def pieces(batches: Iterator[pa.RecordBatch], cut: Callable[[str], list[tuple]], at_once: int = 64) -> Iterator[pa.RecordBatch]:
    """doc_id, page, local, content, strategy, article_ref of batches of (doc_id, page, text); at most at_once texts are held cut."""
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            part = batch.slice(at, at_once)
            found = [(i, local, *c) for i, x in enumerate(part.column(2).to_pylist()) if x is not None and x.strip() for local, c in enumerate(cut(x))]
            of, local, content, strategy, ref = zip(*found, strict=True) if found else ((),) * 5
            of = pa.array(of, pa.int64())
            columns = [part.column(0).take(of), part.column(1).take(of), pa.array(local, pa.int32()), *(pa.array(c, pa.string()) for c in (content, strategy, ref))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "page", "local", "content", "strategy", "article_ref"])


def chunks(docs: DataFrame, strategy: str = "hybrid", max_tokens: int = K.CHUNK_TOKENS, overlap_tokens: int = K.OVERLAP_TOKENS, page: str | None = None) -> DataFrame:
    """doc_id, page, chunk_index (over all pages), chunk_id, content, strategy, article_ref, token_count.

    Blank or null texts have no chunk.  Unknown strategies are hybrid.
    """
    if overlap_tokens >= max_tokens:
        raise ValueError("the overlap must be smaller than a chunk")
    most, overlap = max_tokens * K.CHARS_A_TOKEN, overlap_tokens * K.CHARS_A_TOKEN
    plain = strategy.lower() == "fixed_size"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pieces(batches, lambda x: [(c, "fixed_size", None) for c in fixed(x, most, overlap)] if plain else structural(x, most, overlap))

    at = F.col(page) if page else F.lit(None).cast("int")
    rows = docs.select("doc_id", at.alias("page"), "text")
    out = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL("local int, content string, strategy string, article_ref string").fields])
    rows = rows.mapInArrow(cut, out)
    # without pages the place in the document is the place in its list, and nothing is shuffled
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "local")) - 1 if page else F.col("local")
    rows = rows.select("doc_id", "page", index.alias("chunk_index"), "content", "strategy", "article_ref")
    return rows.withColumn("token_count", t.token_count(F.col("content"))).withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("page"), F.col("chunk_index"), F.col("content")))


def chunk_id(doc_id: Column, page: Column, index: Column, content: Column) -> Column:
    """The same for the same text at the same place, however often it is ingested."""
    return F.sha2(F.concat_ws("|", doc_id.cast("string"), F.coalesce(page.cast("string"), F.lit("")), index.cast("string"), content), 256)


def cleaned(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) with clean texts, without blank ones."""
    return docs.select("doc_id", "lang", t.clean(F.col("text"), F.col("lang")).alias("text")).filter(t.strip(F.col("text")) != "")


def described(clean: DataFrame) -> DataFrame:
    """doc_id, lang and the metadata of clean texts."""
    none = F.lit(None).cast("string")
    return clean.select("doc_id", "lang", t.metadata(F.col("text"), none, none, none).alias("m")).select("doc_id", "lang", "m.*")


def ingest(docs: DataFrame, strategy: str = "hybrid") -> tuple[DataFrame, DataFrame]:
    """(documents with metadata, chunks) of raw texts (doc_id, text, lang): clean, gate, describe, cut.  Cleaning is the dearest step and done once for both."""
    clean = versions.kept(cleaned(docs))
    return described(clean), chunks(clean, strategy)
