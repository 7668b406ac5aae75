"""Embedding near-duplicates with an inverted multi-index.

Two codebooks, fitted on a bounded sample, quantise the halves of the unit
vectors; a vector's cell is a pair of codewords.  Every distinct vector is
indexed and is a query: the multi-sequence traversal visits cells in the order of
the sum of both halves' distances.  How far it goes is calibrated on the sample:
planted neighbours at the threshold must be reached at ``recall``; the traversal
is then bounded by that excess over the nearest cell's distance, with no cap on
cells or candidates.  Candidates are verified by cosine in double precision.

The number of codewords grows with the root of the number of vectors, so cells keep
their size, up to ``most`` in each half.  Vectors of each length have an index of their
own; those of a length with ``block`` distinct vectors at most are one cell and all
compared, so there are as many indexes as one for each ``block`` vectors at most.

Equal vectors are one indexed vector with a count and a number of its own.  Vectors that are null, empty,
zero, or hold null or non-finite components link with nothing, and vectors of different
lengths with each other.  Null ids: rows of their own, not kept.
Repeated ids: rows count as vectors of their own, each with its links; one node.  No rows: no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint, release
from quillon.llm.components import components


CELL_BITS = 24  # words**2 cells of a length at most


class Index(NamedTuple):
    books: tuple[np.ndarray, np.ndarray]
    slack: float  # visited cells cost the nearest one's distance and this at most


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        for d in range(x.shape[1]):
            s = np.bincount(near, weights=x[:, d], minlength=len(c))
            c[n > 0, d] = s[n > 0] / n[n > 0]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2.0 * (x @ c.T), 0.0)


def cell_costs(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = x.shape[1] // 2
    return distances(x[:, :h], index.books[0]), distances(x[:, h:], index.books[1])


def visit(index: Index, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Multi-sequence traversal for each vector: (vector, codeword of each half) of visited cells.

    Both halves' codewords are sorted by distance; step i of the first sequence is
    paired with the prefix of the second that keeps the sum within the bound, which
    is the set that taking cells in order of the sum would visit.
    """
    d1, d2 = cell_costs(index, x)
    o1, o2 = d1.argsort(1), d2.argsort(1)
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    bound = s1[:, 0] + s2[:, 0] + index.slack
    for i in range(s1.shape[1]):
        open_ = np.flatnonzero(s1[:, i] + s2[:, 0] <= bound)
        if not len(open_):
            return
        reach = (s2[open_] <= (bound[open_] - s1[open_, i])[:, None]).sum(1)
        row = np.repeat(open_, reach)
        j = np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach)
        yield row, o1[row, i], o2[row, j]


def fit(sample: np.ndarray, words: int, least: float, recall: float, seed: int) -> Index:
    """sample: unit vectors.  Calibrates on neighbours of sample vectors turned to a cosine of least, the hardest that must be found."""
    rng = np.random.default_rng(seed)
    h = sample.shape[1] // 2
    index = Index((lloyd(sample[:, :h], words, rng), lloyd(sample[:, h:], words, rng)), 0.0)
    x = sample[rng.choice(len(sample), min(2000, len(sample)), replace=False)]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    norm = np.linalg.norm(noise, axis=1, keepdims=True)
    y = least * x + np.sqrt(1 - least**2) * noise / np.where(norm > 0, norm, 1)
    d1, d2 = cell_costs(index, x)
    e1, e2 = cell_costs(index, y)
    at = np.arange(len(x))
    excess = d1[at, e1.argmin(1)] + d2[at, e2.argmin(1)] - d1.min(1) - d2.min(1)
    return index._replace(slack=float(np.quantile(excess, recall)) + 1e-9)


def near_duplicates(vectors: DataFrame, least: float = 0.95, recall: float = 0.98, words: int = 48, most: int = 2048, sample_rows: int = 20_000, sample_bytes: int = 1 << 27, block: int = 2048, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding).

    words: codewords of each half (words**2 cells), at least; a fifth of the root of
    the number of distinct vectors if that is more, ``most`` at most.  The codebooks
    are fitted on about sample_rows distinct vectors, chosen by hash, or 32 for each
    codeword if that is more, sample_bytes of them at most.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    # -0.0 and 0.0 are the same component
    usable = F.when(F.coalesce(finite & some, F.lit(False)), F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind)))
    rows = rows.select("vec_id", usable.alias("v"))
    rows = checkpoint(rows.withColumn("same", F.when(F.col("v").isNotNull(), F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary")))))
    classes = rows.filter("same is not null and vec_id is not null").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("v").alias("v"))
    # a class is known by a number of its own, not by an id that other vectors may have too
    classes = checkpoint(classes.select(F.monotonically_increasing_id().alias("id"), "same", "rep", "copies", "v"))
    named = checkpoint(rows.select("vec_id", "same").join(classes.select("same", "id"), "same", "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("id")).alias("id")))
    release(rows)
    indexes: dict[int, Index] = {}
    for dim, n in sorted(map(tuple, classes.groupBy(F.size("v")).count().filter(F.col("count") > block).collect())):
        k = min(max(words, math.isqrt(n) // 5), most)
        take = min(max(sample_rows, 32 * k), sample_bytes // (dim * (4 if kind == "float" else 8)))
        draw = F.pmod(F.xxhash64(F.lit(seed), "same"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, take / n)))
        drawn = classes.filter((F.size("v") == dim) & draw).select("v").limit(2 * take).toArrow().column("v").combine_chunks()
        sample = drawn.flatten().to_numpy().reshape(len(drawn), dim)
        if len(sample) >= 2 and dim >= 2:
            indexes[dim] = fit(unit(sample), min(k, len(sample)), least, recall, seed)
    links = checkpoint(_links(classes, indexes, least, block, np.float32 if kind == "float" else np.float64))
    held = named.filter("id is not null")
    several = held.groupBy("vec_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a < last")
    same_id = held.join(several, "vec_id").filter("a <> id").select("a", F.col("id").alias("b"))
    comps = checkpoint(components(links.select("a", "b").union(same_id)))
    smallest = comps.join(classes.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("smallest"))
    counts = links.groupBy("a").agg(F.sum("n").alias("n"))
    of = classes.select("id", "rep", "copies").join(comps, "id", "left").join(smallest, "component", "left").join(counts, F.col("id") == F.col("a"), "left")
    of = of.select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "rep").alias("component_id"))
    out = named.join(of, "id", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _links(classes: DataFrame, indexes: dict[int, Index], least: float, block: int, kind: type) -> DataFrame:
    """a, b, n: b connects a with what a is linked with in one block, or is a itself; n: vectors (with copies) linked with a there.

    A pair is looked at once: in one cell the larger id is the query, across cells
    the one whose own cell comes later.  A cell's block of queries meets a block of
    its members in one matrix product; what leaves is a row for each linked vector,
    not the pairs.
    """
    shared = classes.sparkSession.sparkContext.broadcast(indexes)  # of each length words * dim numbers
    member, own, other = 0, 1, 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                size = part.column("v").value_lengths().to_numpy()
                for dim in np.unique(size).tolist():
                    yield from of_length(part.take(pa.array(np.flatnonzero(size == dim))), dim)

    def of_length(part: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
        ids, copies = part.column("id").to_numpy(), part.column("copies").to_numpy()
        raw = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
        v = np.array([r.tobytes() for r in raw.astype(kind)], dtype=object)
        base, index = dim << CELL_BITS, shared.value.get(dim)  # cells of one length are apart from those of others
        if index is None:
            home = np.full(len(ids), base)
        else:
            x, k = unit(raw), len(index.books[1])
            d1, d2 = cell_costs(index, x)
            home = base + d1.argmin(1) * k + d2.argmin(1)
        yield _rows(home, member, ids, copies, v)
        yield _rows(home, own, ids, copies, v)
        if index is not None:
            for row, i, j in visit(index, x):
                cell = base + i * k + j
                before = cell < home[row]
                row, cell = row[before], cell[before]
                yield _rows(cell, other, ids[row], copies[row], v[row])

    placed = classes.select("id", "copies", "v").mapInArrow(place, "cell long, role int, id long, copies long, v binary")
    # a cell's members are cut into blocks of bounded size, dealt by hash; its queries go to each block
    size = placed.filter(F.col("role") == member).groupBy("cell").agg(F.count("*").alias("size"))
    parts = size.select("cell", F.ceil(F.col("size") / block).cast("int").alias("parts"))
    one = F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = placed.join(parts, "cell").withColumn("part", F.explode(F.when(F.col("role") == member, one).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, seen = None, [], None
        for batch in batches:
            cell, part, role = (batch.column(c).to_numpy() for c in ("cell", "part", "role"))
            ids, copies, raw = batch.column("id").to_numpy(), batch.column("copies").to_numpy(), batch.column("v").to_pylist()
            edge = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(cell)], strict=True):
                if i == j:
                    continue
                if (cell[i], part[i]) != at:
                    at, held, seen = (cell[i], part[i]), [], None
                if role[i] == member:
                    held.append((ids[i:j], copies[i:j], raw[i:j]))
                elif held:
                    if seen is None:
                        v = b"".join(b"".join(h[2]) for h in held)
                        n = sum(len(h[0]) for h in held)
                        seen = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), unit(np.frombuffer(v, kind).reshape(n, -1))
                    for s in range(i, j, 512):
                        e = min(s + 512, j)
                        hit = unit(np.frombuffer(b"".join(raw[s:e]), kind).reshape(e - s, -1)) @ seen[2].T >= least
                        if role[i] == own:
                            hit &= seen[0][None] < ids[s:e, None]
                        if hit.any():
                            yield _connected(ids[s:e], copies[s:e], seen[0], seen[1], hit)

    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "role").select("cell", "part", "role", "id", "copies", "v").mapInArrow(verify, "a long, b long, n long")


def _connected(q: np.ndarray, q_copies: np.ndarray, m: np.ndarray, m_copies: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """Of one product: each linked vector, the root of what it is connected with, and how many vectors it is linked with."""
    root: dict[int, int] = {}

    def up(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in zip(*np.nonzero(hit), strict=True):
        a, b = up(int(q[x])), up(int(m[y]))
        root[max(a, b)] = min(a, b)
    left, right = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    a = np.concatenate((q[left], m[right]))
    n = np.concatenate((hit[left] @ m_copies, q_copies @ hit[:, right]))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array([up(i) for i in a.tolist()], pa.int64()), pa.array(n)], names=["a", "b", "n"])


def _rows(cell: np.ndarray, role: int, ids: np.ndarray, copies: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(np.full(len(ids), role, np.int32)), pa.array(ids), pa.array(copies), pa.array(v, pa.binary())], names=["cell", "role", "id", "copies", "v"])
