"""Connected components of a link table: contraction within tasks, then alternating large and small stars.

Each task first replaces the links that it holds (links_a_task, so its memory is
bounded) by links of every node to the smallest one it reaches there.  A table that
one task can hold is done then.  Else rounds replace links by links to smaller
neighbours until only stars remain; they grow with the logarithm of the graph.
Every round is cut off with a checkpoint; the driver sees two numbers a round, no
links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint, release


def components(links: DataFrame, links_a_task: int = 200_000) -> DataFrame:
    """id, component (smallest id reachable) of the ids that have a link; links: a, b.  Null ends and loops are no links."""
    edges = checkpoint(links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = -(-edges.count() // links_a_task)
    if tasks:
        before, edges = edges, checkpoint(edges.coalesce(tasks).mapInArrow(_contracted, "u long, v long"))
        release(before)
    seen = _mark(edges) if tasks > 1 else (0,)
    while seen[0]:
        k = -(-seen[0] // links_a_task)
        before, edges = edges, checkpoint(_small(_large(edges.coalesce(k)).coalesce(k)).coalesce(k).mapInArrow(_contracted, "u long, v long").distinct())
        release(before)
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every node to the smallest that it reaches by the links of these batches."""
    root: dict[int, int] = {}

    def up(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = up(u), up(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(i, up(i)) for i in list(root)]
    pairs = [p for p in pairs if p[0] != p[1]]
    for at in range(0, len(pairs), 50_000):
        u, v = zip(*pairs[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
