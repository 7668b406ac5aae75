"""What the operators share: reading tables, cutting lineage, Arrow maps, packing."""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Shuffle files of an action go when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder of the session and reads it from there: survives lost executors.

    The folder is the one the cluster names in spark.checkpoint.dir; only a local
    session where that is unset (tests) gets a temporary one.  The shuffle files
    that the write needed are removed with it, so cut lineage holds no disk.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def release(*frames: DataFrame) -> None:
    """Deletes the checkpoint files of frames that nothing will read again; what else was made from them must be written by then."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(column: str, m: int) -> F.Column:
    """crc32 of the column as text, modulo m (of a null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def append(df: DataFrame, fields: str, make: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str], column: str = "text", limit: int = tx.PIECE, also: list[str] | None = None) -> DataFrame:
    """mapInArrow: of each row the columns keep and what make adds (fields, as DDL); make gets pieces of about limit bytes of text.

    also: further columns that make reads.
    An input column with the name of an added one gives way to it.
    """
    fields = T.StructType.fromDDL(fields)
    names = set(fields.fieldNames())
    keep = [c for c in keep if c not in names]
    need = list(dict.fromkeys([*keep, column, *(also or [])]))
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    out_names = [*keep, *fields.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch, column, limit):
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *make(piece)], names=out_names)

    return df.select(*need).mapInArrow(run, schema)


_packer: dict[str, object] = {}


def compress(b: bytes) -> bytes:
    c = _packer.get("c") or _packer.setdefault("c", zstandard.ZstdCompressor(level=1))
    return c.compress(b)


def decompress(b: bytes) -> bytes:
    d = _packer.get("d") or _packer.setdefault("d", zstandard.ZstdDecompressor())
    return d.decompress(b)


def pack(a: np.ndarray) -> bytes:
    return compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(decompress(b), dtype=dtype)


def varint(n: np.ndarray) -> bytes:
    """Non-negative integers, each as the planes of its bytes: small ones compress to little."""
    n = np.asarray(n, dtype=np.uint64)
    planes = max(1, (int(n.max()).bit_length() + 7) // 8) if len(n) else 1
    return bytes([planes]) + pack(np.ascontiguousarray(n.view(np.uint8).reshape(-1, 8)[:, :planes].T))


def unvarint(b: bytes) -> np.ndarray:
    planes = b[0]
    raw = unpack(b[1:], np.uint8).reshape(planes, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :planes] = raw.T
    return out.view(np.uint64).ravel()


SMALL = 1 << 12  # bytes of a bundle that are compressed as one


def planes(a: np.ndarray) -> np.ndarray:
    """Numbers of 8 bytes (or fewer; integers not negative) as the planes of their bytes: small ones compress to little, and planes can be cut."""
    a = np.ascontiguousarray(a)
    a = a.view(np.uint64) if a.dtype.itemsize == 8 else a.astype(np.uint64)
    wide = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :wide].T)


def bundle(*parts: np.ndarray) -> bytes:
    """The planes of several arrays as one value; short ones are compressed together."""
    if sum(p.size for p in parts) <= SMALL:
        raw = [compress(b"".join([p.tobytes() for p in parts]))]
    else:
        raw = [compress(b"".join([plane.tobytes() for plane in p])) for p in parts]  # a plane is copied at once, a cut table byte by byte
    return struct.pack(f"<BB{2 * len(parts) + len(raw)}I", len(parts), len(raw), *(n for p in parts for n in p.shape), *map(len, raw)) + b"".join(raw)


def unbundle(b: bytes) -> list[np.ndarray]:
    """The planes of each array of a bundle."""
    n, frames = b[0], b[1]
    form = f"<{2 * n + frames}I"
    sizes, at, raw = struct.unpack_from(form, b, 2), 2 + struct.calcsize(form), []
    for size in sizes[2 * n :]:
        raw.append(decompress(b[at : at + size]))
        at += size
    raw, at, out = b"".join(raw), 0, []
    for wide, long in zip(sizes[: 2 * n : 2], sizes[1 : 2 * n : 2], strict=True):
        out.append(np.frombuffer(raw, np.uint8, wide * long, at).reshape(wide, long))
        at += wide * long
    return out


def numbers(parts: Sequence[np.ndarray]) -> np.ndarray:
    """The numbers that planes stand for, one array's after the other's."""
    joined = [np.concatenate([p[i] if i < len(p) else np.zeros(p.shape[1], np.uint8) for p in parts]) for i in range(max(map(len, parts), default=0))]
    if len(joined) > 4:
        out = np.zeros((len(joined[0]), 8), np.uint8)
        for i, plane in enumerate(joined):
            out[:, i] = plane
        return out.view(np.uint64).ravel()
    out = joined[0].astype(np.uint64) if joined else np.zeros(0, np.uint64)
    for i, plane in enumerate(joined[1:], 1):
        out |= plane.astype(np.uint64) << np.uint64(8 * i)
    return out


def integers(parts: Sequence[np.ndarray]) -> np.ndarray:
    return numbers(parts).view(np.int64)


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[object, list[dict]]]:
    """(key, or tuple of several keys; rows) of stretches of rows with equal keys, of few and heavy rows."""
    at, rows = None, []
    for batch in batches:
        names, columns = batch.schema.names, batch.columns
        for i in range(batch.num_rows):
            row = {name: c[i].as_py() for name, c in zip(names, columns, strict=True)}
            key = row[keys[0]] if len(keys) == 1 else tuple(row[k] for k in keys)
            if rows and key != at:
                yield at, rows
                rows = []
            at = key
            rows.append(row)
    if rows:
        yield at, rows
