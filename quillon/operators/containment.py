"""Which names contain, or are contained in, some of many other names.

``related`` sorts names among the ends of the others (a name from each of its places
on), cut to the longest name that is looked up.  All that starts with a name follows it
at once in that order, so a name stands in some other if the next end starts with it,
and no name meets candidates: the work grows with the characters.  What a task can't tell
is at its first and last rows; one row of each partition settles that.

``pairs`` goes by rare character grams, verified.  A name that stands in another brings
all its grams along.  Each shorter side is looked up by one gram only, its rarest among
the longer side's; names shorter than a gram are grams of their own length.  All joins
are on equal grams, so no name meets all others, and a common gram decides only for names
that have no rarer one.

Names are compared lower-cased; null and empty ones are related to nothing.  Repeated
names count once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.versions import kept

GRAM = 3


def _names(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lower(name).alias("name")).filter("name <> ''").distinct()


def _grams(c: Column, size: int) -> Column:
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: F.substring(c, i, F.lit(size)))))


def _inverted(names: DataFrame, inner: DataFrame) -> DataFrame:
    """gram, name: all grams of the sizes by which the inner names are looked up."""
    sizes = sorted(r.n for r in inner.select(F.least(F.length("name"), F.lit(GRAM)).alias("n")).distinct().collect())  # GRAM values at most
    every = F.concat(F.array().cast("array<string>"), *[F.coalesce(_grams(F.col("name"), n), F.array().cast("array<string>")) for n in sizes])
    return names.select(F.explode(every).alias("gram"), "name")


def _rarest(names: DataFrame, inverted: DataFrame) -> DataFrame:
    """gram, name: of each name that can stand in an inverted one the gram that fewest of those have."""
    size = F.least(F.length("name"), F.lit(GRAM))
    own = F.coalesce(*[F.when(size == n, _grams(F.col("name"), n)) for n in range(1, GRAM + 1)])
    many = inverted.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that none has: the name stands in none
    of = names.select("name", F.size(own).alias("all"), F.explode(own).alias("gram")).join(many, "gram")
    best = of.groupBy("name", "all").agg(F.count("*").alias("found"), F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return best.filter("found = all").select("gram", "name")


def related(names: DataFrame, others: DataFrame, name: str = "name", other: str = "name") -> DataFrame:
    """name: the distinct lower-cased names that contain, or are contained in, one of others."""
    a, b = kept(_names(names, name)), kept(_names(others, other))  # looked at often
    return _within(a, b).union(_around(a, b)).distinct()


def _lengths(names: DataFrame) -> tuple[int, int]:
    """The shortest and the longest; (1, 0) without names."""
    least, most = names.agg(F.min(F.length("name")), F.max(F.length("name"))).first()
    return (least, most) if least else (1, 0)


def _ends(least: int, most: int):
    """s: the ends of names that have least characters, cut to most; each once in a batch, so that what many names share is few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                ends = {x[i : i + most] for x in batch.column("name").slice(at, 4096).to_pylist() for i in range(len(x) - least + 1)}
                yield pa.RecordBatch.from_arrays([pa.array(list(ends), pa.string())], names=["s"])

    return run


def _owned_ends(least: int, most: int):
    """s, owner: the same with the name that each is an end of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                ends = [(x[i : i + most], x) for x in batch.column("name").slice(at, 4096).to_pylist() for i in range(len(x) - least + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.string()) for k in (0, 1)], names=["s", "owner"])

    return run


def _within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """name: those of inner that stand in one of outer.  The next end in order starts with them."""
    least, most = _lengths(inner)
    ends = outer.mapInArrow(_ends(least, most), "s string").select("s", F.lit(True).alias("end"))
    rows = inner.select(F.col("name").alias("s"), F.lit(False).alias("end")).union(ends).repartitionByRange("s", "end").sortWithinPartitions("s", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, waiting = TaskContext.get().partitionId(), None, []

        def out(names: list[str], known: bool, end: str | None = None) -> pa.RecordBatch:
            n = len(names)
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(names, pa.string()), pa.array([known] * n), pa.array([end] * n, pa.string())], names=["part", "name", "known", "first"])

        for batch in batches:
            s, end = batch.column("s"), np.asarray(batch.column("end"))
            at, asked = np.flatnonzero(end), np.flatnonzero(~end)
            if not len(at):
                waiting += s.to_pylist()
                continue
            follows = np.searchsorted(at, asked)
            next_ = s.take(pa.array(at[np.minimum(follows, len(at) - 1)])).to_pylist()
            own = s.take(pa.array(asked)).to_pylist()
            e = s[int(at[0])].as_py()
            first = e if first is None else first
            good = [x for x in waiting if e.startswith(x)] + [x for x, y, f in zip(own, next_, follows.tolist(), strict=True) if f < len(at) and y.startswith(x)]
            waiting = [x for x, f in zip(own, follows.tolist(), strict=True) if f == len(at)]
            if good:
                yield out(good, True)
        if waiting:
            yield out(waiting, False)
        yield out([None], False, first)

    found = kept(rows.mapInArrow(run, "part int, name string, known boolean, first string"))
    # a row of each partition: the first end of those after it
    after = found.filter("name is null").select("part", F.first("first", ignorenulls=True).over(W.orderBy("part").rowsBetween(1, W.unboundedFollowing)).alias("after"))
    late = found.filter("name is not null and not known").join(after, "part").filter(F.startswith("after", "name"))
    return found.filter("known").select("name").union(late.select("name"))


def _around(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """name: those of outer in which one of inner stands.  Of the inner names that start with one another the shortest is held while ends follow that start with it."""
    (least, _), most = _lengths(inner), _lengths(outer)[1]
    ends = outer.mapInArrow(_owned_ends(least, most), "s string, owner string")
    asked = inner.filter(F.length("name") <= most)
    rows = asked.select(F.col("name").alias("s"), F.lit(None).cast("string").alias("owner")).union(ends).repartitionByRange("s").sortWithinPartitions("s", "owner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held = TaskContext.get().partitionId(), None, None

        def out(names: list[str | None], shared: list[int | None], s: str | None = None) -> pa.RecordBatch:
            n = len(names)
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(names, pa.string()), pa.array(shared, pa.int32()), pa.array([s] * n, pa.string())], names=["part", "name", "shared", "first"])

        for batch in batches:
            names, shared = [], []
            for s, owner in zip(batch.column("s").to_pylist(), batch.column("owner").to_pylist(), strict=True):
                if first is None:
                    first = s
                    yield out([None], [None], first)
                if owner is None:
                    if held is None or not s.startswith(held):
                        held = s
                elif held is not None and s.startswith(held):
                    names.append(owner)
                    shared.append(None)
                elif s[:least] == first[:least]:  # an inner name of a partition before can start it as it starts this one's first row
                    names.append(owner)
                    shared.append(len(os.path.commonprefix((s, first))))
            if names:
                yield out(names, shared)

    found = kept(rows.mapInArrow(run, "part int, name string, shared int, first string"))
    starts = found.filter("first is not null").select("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda i: F.substring("first", F.lit(1), i))).alias("name"))
    before = asked.join(starts, "name").groupBy("part").agg(F.min(F.length("name")).alias("least"))
    late = found.filter("shared is not null").join(before, "part").filter("shared >= least")
    return found.filter("name is not null and shared is null").select("name").union(late.select("name"))


def pairs(names: DataFrame, others: DataFrame, name: str = "name", other: str = "name") -> DataFrame:
    """name, other: the distinct lower-cased pairs of which one contains the other."""
    a, b = _names(names, name), _names(others, other)
    a_grams, b_grams = _inverted(a, b), _inverted(b, a)
    flip = lambda df: df.withColumnRenamed("name", "other")
    inner = _rarest(a, b_grams).join(flip(b_grams), "gram").filter(F.col("other").contains(F.col("name")))
    outer = a_grams.join(flip(_rarest(b, a_grams)), "gram").filter(F.col("name").contains(F.col("other")))
    return inner.select("name", "other").union(outer.select("name", "other")).distinct()
