"""Scans: folders of texts and PDFs, gold sets, OCR with a cache; sinks of reports."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as t

GOLD = "id string, language string, profile string, domain string, query string, relevant_chunk_ids array<string>, relevant_sources array<string>, gold_answer_keywords array<string>, difficulty string, juridical_system string, note string"


def texts(spark: SparkSession, folder: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """path, text of the files below folder; bytes that are not UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)

    @F.pandas_udf("string")
    def decode(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in raw:
            yield s.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return files.select("path", "length", decode("content").alias("text"))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length: what a scan would read, without reading it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def pdf_pages(spark: SparkSession, folder: str, images: bool = False) -> DataFrame:
    """path, page_number, text, needs_ocr, image of PDF files; needs the optional PyMuPDF."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise RuntimeError("PDF files need PyMuPDF, which is not installed") from e
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(folder)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for b in batches:
            for path, raw in zip(b.path, b.content, strict=True):
                doc = fitz.open(stream=bytes(raw), filetype="pdf")
                yield pd.DataFrame([(path, i, p.get_text(), p.get_pixmap(dpi=300).tobytes("png") if images else None) for i, p in enumerate(doc, 1)], columns=["path", "page_number", "text", "image"])

    return scanned(files.select("path", "content").mapInPandas(pages, "path string, page_number int, text string, image binary"))


def scanned(pages: DataFrame, least: int = 50) -> DataFrame:
    """Pages of under least characters need OCR and lose their text."""
    need = F.length(t.strip(F.coalesce("text", F.lit("")))) < least
    return pages.withColumn("needs_ocr", need).withColumn("text", F.when(need, "").otherwise(F.col("text")))


def whole(pages: DataFrame, key: str = "path") -> DataFrame:
    """key, text, ocr: non-blank pages joined in order; one scanned page sends the whole document to OCR."""
    rows = pages.groupBy(key).agg(F.bool_or("needs_ocr").alias("ocr"), F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    return rows.select(key, "ocr", F.array_join(F.filter("p.text", lambda x: t.strip(x) != ""), "\n\n").alias("text"))


def ocr(images: DataFrame, cache: DataFrame, engine) -> tuple[DataFrame, DataFrame]:
    """(image_key, text of every image; new rows for the cache).  engine: bytes to text; a failure gives an empty text and is not cached."""
    keyed = images.withColumn("image_key", F.substring(F.sha2("image", 256), 1, 16))
    new = keyed.dropDuplicates(["image_key"]).join(cache, "image_key", "left_anti")

    @F.pandas_udf("string")
    def read(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(b):
            try:
                return engine(bytes(b))
            except Exception:  # an unreadable image must not end the scan
                return None

        for s in raw:
            yield s.map(one)

    fresh = new.select("image_key", read("image").alias("text")).filter("text is not null")
    known = cache.select("image_key", "text").unionByName(fresh)
    return keyed.drop("image").join(known, "image_key", "left").withColumn("text", F.coalesce("text", F.lit(""))), fresh


def ndjson(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The rows with the fields of their JSON line; lines that do not parse are skipped."""
    parsed = F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.filter(F.trim(F.coalesce(column, F.lit(""))) != "").withColumn("_j", parsed).filter("_j is not null and _j._bad is null").select(*[c for c in lines.columns if c != column], "_j.*").drop("_bad")


def cache_json(text: Column) -> Column:
    """The content of a cached OCR result."""
    return F.to_json(F.struct(text.alias("text")))


def cached_text(json: Column) -> Column:
    return F.get_json_object(json, "$.text")


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of an image (rows x columns x 3) by the usual weights of 299, 587 and 114 thousandths."""
    return np.round(rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def sharpen(image: np.ndarray) -> np.ndarray:
    """Each inner pixel twice itself less the mean of its eight neighbours; the border stays."""
    x = image.astype(np.float64)
    if min(x.shape) < 3:
        return image
    around = sum(x[i : x.shape[0] - 2 + i, j : x.shape[1] - 2 + j] for i in range(3) for j in range(3)) - x[1:-1, 1:-1]
    out = image.copy()
    out[1:-1, 1:-1] = np.clip(np.round(2 * x[1:-1, 1:-1] - around / 8), 0, 255).astype(np.uint8)
    return out


def preprocessed(images: Column) -> Column:
    """PNG bytes of the grey, sharpened images; needs the optional Pillow."""
    try:
        import PIL  # noqa: F401
    except ImportError as e:
        raise RuntimeError("images need Pillow, which is not installed") from e

    @F.pandas_udf("binary")
    def run(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import io

        from PIL import Image

        def one(b):
            out = io.BytesIO()
            Image.fromarray(sharpen(grey(np.asarray(Image.open(io.BytesIO(bytes(b))).convert("RGB"))))).save(out, "PNG")
            return out.getvalue()

        for s in raw:
            yield s.map(one)

    return run(images)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a gold set, {"queries": [...]} or [...]; a file that is neither raises ValueError."""
    raw = spark.read.option("multiLine", "true").schema(f"queries array<struct<{GOLD.replace(' string', ': string').replace(' array', ': array')}>>, {GOLD}").json(path)
    if raw.filter("queries is not null or id is not null").isEmpty():
        raise ValueError(f"{path} holds no gold set")
    nested = raw.filter("queries is not null").select(F.explode("queries").alias("q")).select("q.*")
    flat = raw.filter("queries is null and id is not null").drop("queries")
    return nested.unionByName(flat)


def qrels(questions: DataFrame) -> DataFrame:
    return questions.select(F.col("id").alias("query_id"), F.explode("relevant_chunk_ids").alias("doc_id")).distinct().withColumn("rel", F.lit(1.0))


def report(summary: DataFrame, folder: str, baseline: str) -> str:
    """Writes a report (a few rows of means) as one JSON file into a folder named for the baseline and the time, UTC; returns its path."""
    path = f"{folder}/{baseline}-{datetime.now(UTC):%Y%m%dT%H%M%S%fZ}"
    summary.withColumn("baseline", F.lit(baseline)).coalesce(1).write.json(path)
    return path
