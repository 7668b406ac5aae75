"""A stored vector index: coarse cells as table partitions, residual product codes, exact scores of survivors.

``build`` fits coarse centroids and the codebooks of residuals on a bounded sample,
finds on it how many cells a question must probe, and commits the vectors with their
codes to a versioned store, a folder for each cell.  ``add`` commits more vectors to the
same cells and takes older ones of their ids away; it writes its own rows only.
``top`` gives each question its nearest cells, reads the codes of the probed cells alone
(a partition filter on the scan), ranks by code, and scores the best again with the
vectors themselves.

What goes to the driver and to all tasks is the centroids and the codebooks: at most
MOST_CELLS + 256 vectors.  Questions meet cells by an equal key, in blocks.

Vectors that are null, zero, broken or of another length than the index's are not
indexed, and such questions find nothing.  Repeated ids in one batch are vectors of their
own.  Ties: smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.operators import retrieval, versions

MOST_CELLS = 4096
CODES = 256  # codewords of a part of a vector: a byte each


class Index(NamedTuple):
    centroids: np.ndarray
    books: np.ndarray  # parts x CODES x numbers of a part, of residuals filled up with zeros
    probes: int


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k-means; an empty mean moves to the point that is worst off."""
    c = x[rng.permutation(len(x))[:k]].astype(np.float64)
    for _ in range(rounds):
        d = _square(x, c)
        near, far = d.argmin(1), d.min(1)
        total, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        lost = np.flatnonzero(n == 0)
        c[lost] = x[far.argsort()[::-1][: len(lost)]]
    return c


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T), 0)


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    """rows x parts x numbers, filled up with zeros."""
    wide = -(-x.shape[1] // parts) * parts
    return np.pad(x, ((0, 0), (0, wide - x.shape[1]))).reshape(len(x), parts, -1)


def fit(sample: np.ndarray, n: int, parts: int, k: int, recall: float, seed: int) -> Index:
    """sample: unit vectors.  About a root of n cells; enough probes that the cells hold the share recall of the sample's k nearest neighbours, which lie farther off than the table's."""
    rng = np.random.default_rng(seed)
    c = _means(sample, max(1, min(MOST_CELLS, math.isqrt(n), len(sample) // 8)), rng)
    home = _square(sample, c).argmin(1)
    rest = _parts(sample - c[home], parts)
    books = np.stack([np.resize(_means(rest[:, j], min(CODES, len(rest)), rng), (CODES, rest.shape[2])) for j in range(parts)])
    asked = rng.permutation(len(sample))[:500]
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -2
    m = min(k, len(sample) - 1)
    near = home[np.argpartition(-scores, m - 1, axis=1)[:, :m]] if m > 0 else np.zeros((len(asked), 1), int)
    place = _square(sample[asked], c).argsort(1).argsort(1)  # of each cell in the question's order
    reached = np.bincount(np.take_along_axis(place, near, 1).ravel(), minlength=len(c)).cumsum() / near.size
    return Index(c, books, int(np.searchsorted(reached, recall) + 1))


def build(vectors: DataFrame, root: str, parts: int = 8, k: int = K.CANDIDATES, recall: float = 0.97, sample_bytes: int = 1 << 26, seed: int = 3) -> int:
    """Commits an index of vectors (vec_id, embedding) to root, which holds none yet; returns the version."""
    spark = vectors.sparkSession
    sizes = retrieval.usable(vectors).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))  # a row for each length
    n, dim = sizes.agg(F.max("n"), F.max_by("dim", F.struct("n", -F.col("dim")))).first()
    rows = retrieval.usable(vectors).filter(F.size("embedding") == (dim or 0)).select("vec_id", "embedding")
    most = max(1, sample_bytes // (8 * (dim or 1)))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, most / (n or 1))))).select("embedding").limit(most).toArrow().column(0).combine_chunks()
    sample = retrieval._unit(drawn.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(drawn), -1)) if len(drawn) else np.zeros((1, dim or 1))
    index = fit(sample, n or 1, min(parts, sample.shape[1]), k, recall, seed)
    small = lambda name, a: (name, list(a.shape), a.astype(np.float64).tobytes())
    stored = spark.createDataFrame([small("centroids", index.centroids), small("books", index.books), ("probes", [index.probes], b"")], "name string, shape array<int>, data binary")
    return versions.commit(spark, root, [versions.write(stored.coalesce(1), root, "index"), _coded(rows, root, index)])


def load(spark: SparkSession, root: str, at: int | None = None) -> Index:
    got = {r.name: (r.shape, bytes(r.data)) for r in versions.read(spark, root, "index", at).collect()}  # three rows
    return Index(*(np.frombuffer(got[x][1]).reshape(got[x][0]) for x in ("centroids", "books")), got["probes"][0][0])


def add(vectors: DataFrame, root: str) -> int:
    """Commits more vectors (vec_id, embedding); those with the same ids go."""
    spark = vectors.sparkSession
    index = load(spark, root)
    rows = retrieval.usable(vectors).filter(F.size("embedding") == index.centroids.shape[1]).select("vec_id", "embedding")
    return versions.commit(spark, root, [_coded(rows, root, index)], vectors, "vec_id")


def forget(spark: SparkSession, root: str, ids: DataFrame) -> int:
    return versions.commit(spark, root, [], ids, "vec_id")


def _coded(rows: DataFrame, root: str, index: Index) -> dict:
    """A segment with the rows' cells and codes, in a folder for each cell."""
    kind = rows.schema["embedding"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = retrieval._unit(part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1))
                cell, code = encode(shared.value, x)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell.astype(np.int32))], names=["vec_id", "embedding", "code", "cell"])

    coded = rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, embedding {kind}, code binary, cell int")
    # a hot cell is several files: rows are dealt by cell and a hash, and Spark splits what is large
    return versions.write(coded.hint("rebalance", "cell").sortWithinPartitions("cell", "vec_id"), root, "codes", by=["cell"])


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, code) of unit vectors."""
    cell = _square(x, index.centroids).argmin(1)
    rest = _parts(x - index.centroids[cell], len(index.books))
    return cell, np.stack([_square(rest[:, j], book).argmin(1) for j, book in enumerate(index.books)], 1).astype(np.uint8)


def top(spark: SparkSession, root: str, queries: DataFrame, k: int = K.CANDIDATES, probes: int | None = None, survivors: int | None = None, other: bool = False, block: int = 1024, at: int | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: of each question (query_id, embedding) the k nearest found, by cosine.

    probes: cells that a question looks into (the index's own number); survivors: rows
    that are scored by their vectors (ten times k).  other: not the question's own id.
    block: questions of a part; a task holds the survivors of one part at a time.
    """
    at = versions.version(spark, root) if at is None else at
    index = load(spark, root, at)
    dim, probes, survivors = index.centroids.shape[1], min(probes or index.probes, len(index.centroids)), survivors or 10 * k
    shared = spark.sparkContext.broadcast(index)
    asked = retrieval.usable(queries).filter(F.size("embedding") == dim).select("query_id", F.col("embedding").cast("array<double>").alias("question"))
    parts = max(1, -(-asked.count() // block))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = retrieval._unit(batch.column("question").flatten().to_numpy().reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, dim))
            near = _square(q, shared.value.centroids).argsort(1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(len(q)), near.shape[1])
            for s in range(0, len(row), 4096):
                some = row[s : s + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()[s : s + 4096].astype(np.int32)), batch.column("query_id").take(pa.array(some)), batch.column("question").take(pa.array(some))], names=["cell", "query_id", "question"])

    qid, vid = queries.schema["query_id"].dataType.simpleString(), versions.read(spark, root, "codes", at).schema["vec_id"].dataType.simpleString()
    wanted = asked.mapInArrow(probe, f"cell int, query_id {qid}, question array<double>")
    cells = sorted(r.cell for r in wanted.select("cell").distinct().collect())  # MOST_CELLS at most
    stored = versions.read(spark, root, "codes", at).filter(F.col("cell").isin(cells) if cells else F.lit(False))
    # questions are dealt into parts by hash, and each cell's codes meet one part after another
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
    blocks = wanted.select("cell", part, "query_id", "question").groupBy("part", "cell").agg(F.collect_list(F.struct("query_id", "question")).alias("asked"))
    codes = stored.select("cell", "vec_id", "code").mapInArrow(_packed(vid), f"cell int, ids array<{vid}>, codes binary").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = codes.join(blocks, ["part", "cell"]).sortWithinPartitions("part", "cell").select("part", "cell", "ids", "codes", "asked")
    # the question's own vector may be among them
    met = rows.mapInArrow(_ranked(shared, survivors + other), f"query_id {qid}, cell int, vec_id {vid}, distance double")
    if other:
        met = met.filter("query_id <> vec_id")
    best = retrieval.top(met, survivors, F.asc("distance"), F.asc("vec_id")).select("query_id", "cell", "vec_id")
    exact = best.join(stored.select("cell", "vec_id", "embedding"), ["cell", "vec_id"]).join(asked, "query_id")
    scored = exact.select("query_id", F.col("vec_id").alias("doc_id"), retrieval.cosine(F.col("embedding"), F.col("question")).alias("score"))
    return retrieval.top(scored, k, F.desc("score"), F.asc("doc_id"))


def _packed(vid: str, most: int = 16_384):
    """Stretches of one cell's codes as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edge = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(cell)], strict=True):
                for s in range(i, j, most):
                    part = batch.slice(s, min(most, j - s))
                    ids = part.column("vec_id")
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[i])], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([b"".join(part.column("code").to_pylist())], pa.binary())], names=["cell", "ids", "codes"])

    return run


def _ranked(shared: Broadcast, most: int):
    """The nearest codes of all that a task meets, for each question.  A part's go on before the next part's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at, cell, packed = (batch.column(c)[i].as_py() for c in ("part", "cell", "codes"))
                if at != part:
                    if best is not None:
                        yield from best.rows()
                    part, best = at, _Survivors(most)
                best.add(shared.value, cell, batch.column("ids")[i].values, packed, batch.column("asked")[i].values)
        if best is not None:
            yield from best.rows()

    return run


class _Survivors:
    """The nearest of all codes that a task meets, for each question: so many at most, and some more until they are sorted out."""

    def __init__(self, most: int):
        self.most, self.held, self.size = most, [], 0
        self.place: dict = {}  # of each question
        self.ids: list = []
        self.reach = np.zeros(0)  # beyond it a question has enough

    def add(self, index: Index, cell: int, ids: pa.Array, packed: bytes, asked: pa.StructArray) -> None:
        """One cell's codes; a code's distance is a sum over its parts, looked up in a table of the question's."""
        code = np.frombuffer(packed, np.uint8).reshape(len(ids), len(index.books))
        q = retrieval._unit(asked.field("question").flatten().to_numpy().reshape(len(asked), -1))
        rest = _parts(q - index.centroids[cell], len(index.books))
        for i, name in enumerate(asked.field("query_id").to_pylist()):
            at = self.place.setdefault(name, len(self.place))
            if at == len(self.ids):
                self.ids.append(name)
                if at >= len(self.reach):
                    self.reach = np.concatenate((self.reach, np.full(max(64, at), np.inf)))
            table = ((rest[i][:, None] - index.books) ** 2).sum(2)
            d = table[np.arange(len(table)), code].sum(1)
            near = np.flatnonzero(d <= self.reach[at])
            if len(near) > self.most:
                near = near[d[near] <= np.partition(d[near], self.most - 1)[self.most - 1]]
            if len(near):
                self.held.append((np.full(len(near), at), np.full(len(near), cell, np.int32), ids.take(pa.array(near)), d[near]))
                self.size += len(near)
        self.kind = asked.field("query_id").type
        if self.size > max(1 << 18, 3 * self.most * len(self.ids)):
            self._cut()

    def _cut(self) -> None:
        q, cell, d = (np.concatenate([h[c] for h in self.held]) for c in (0, 1, 3))
        ids = pa.concat_arrays([h[2] for h in self.held])
        order = np.lexsort((d, q))
        place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        last = order[place == self.most - 1]
        self.reach[q[last]] = d[last]
        order = order[d[order] <= self.reach[q[order]]]  # equal distances stay, ids tell them apart later
        self.held, self.size = [(q[order], cell[order], ids.take(pa.array(order)), d[order])], len(order)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._cut()
            q, cell, ids, d = self.held[0]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids, self.kind).take(pa.array(q)), pa.array(cell), ids, pa.array(d)], names=["query_id", "cell", "vec_id", "distance"])
