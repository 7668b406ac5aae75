"""Near-duplicate detection with a MinHash LSH forest.

Documents with equal shingle sets form a class, and classes are compared.  A
class has a MinHash signature; each tree is an order of the classes by the
signature, read from another place on and around its end.  Classes that share the
first ``head`` values of a tree are a region.  Small regions are compared whole.
Larger ones descend, value by value, each part to the depth at which ``leaf``
classes are left or ``deep`` more values are used up; those that share the longest
prefixes are candidates, and so are next neighbours in the order.  A candidate
whose signatures agree enough is confirmed on the full shingle sets; first one
smaller partner for each class, then whatever lies across the components found.
Large regions that still hold several components are compared across components,
a pair of blocks of bounded size in a task, so descending loses no link.

Null texts and texts without words: an empty set, linked with nothing, a component
of their own.  Fewer words than a shingle has: the whole sequence is one.  Null
ids: linked with nothing, not kept.  Repeated ids: one node, linked with what any of
its texts is linked with.  Very long texts: whole; a set takes 8 bytes a shingle.
No rows: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm import text as tx
from quillon.llm.common import append, checkpoint, release, runs
from quillon.llm.components import components


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, text by text; first of each text and one past the last)."""
    w = tx.words(texts)
    h, doc = tx.shingles(tx.word_hashes(w), w.first, k)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(h: np.ndarray, first: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Texts x n MinHash values; of an empty set the largest."""
    odd = np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.full((len(first) - 1, n), 0xFFFFFFFF, np.uint32)
    if len(full):
        starts = first[full]
        for j in range(n):
            out[full, j] = np.minimum.reduceat(((h * odd[j]) ^ (h >> np.uint64(29))) >> np.uint64(32), starts)
    return out


def _set_key(h: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    full = np.flatnonzero(np.diff(first) > 0)
    out: list[bytes | None] = [None] * (len(first) - 1)
    if len(full):
        a = np.add.reduceat(tx.mix(h ^ np.uint64(0x1234567)), first[full])
        b = np.add.reduceat(tx.mix(h + np.uint64(0x9E3779B97F4A7C15)), first[full])
        for i, d in enumerate(full):
            out[d] = a[i].tobytes() + b[i].tobytes()
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 24, depth: int = 6, head: int = 5, deep: int = 8, small: int = 24, leaf: int = 8, near: int = 3, slack: float = 0.16, block: int = 4096, seed: int = 11) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: of every row of docs (doc_id, text).

    Links: 100 * intersection >= percent * union of k-word shingle sets.  A pair at
    the threshold shares head values in some tree with 1 - (1 - 0.8**5)**24 > 0.9999.
    slack: signatures that agree in less than the threshold less slack (over four
    standard errors) are not compared further.
    """
    n = trees * depth
    stamped = docs.select("doc_id", "text", F.xxhash64("text").alias("stamp"))

    def sign(batch: pa.RecordBatch) -> list[pa.Array]:
        h, first = shingle_sets(batch.column("text"), k)
        sig = signatures(h, first, n, seed)
        return [pa.array(np.diff(first).astype(np.int64)), pa.array(_set_key(h, first), pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())]

    signed = checkpoint(append(stamped, "n_shingles long, set_key binary, sig binary", sign, ["doc_id", "stamp"]))
    whole = signed.filter("set_key is not null and doc_id is not null")
    # a class is known by a number of its own, not by a doc_id that other texts may have too
    grouped = whole.groupBy("set_key").agg(F.min(F.struct("doc_id", "stamp")).alias("of"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sig").alias("sig"))
    classes = checkpoint(grouped.select(F.monotonically_increasing_id().alias("id"), "set_key", F.col("of.doc_id").alias("rep"), F.col("of.stamp").alias("stamp"), "n_shingles", "sig"))
    of_row = F.when(F.col("doc_id").isNotNull(), F.col("id")).alias("id")
    rows = checkpoint(signed.select("doc_id", "n_shingles", "set_key").join(classes.select("id", "set_key"), "set_key", "left").select("doc_id", "n_shingles", of_row))
    release(signed)

    sig = classes.select("id", "sig")
    found = checkpoint(candidates(classes.select("id", "n_shingles", "sig"), percent, trees, depth, head, deep, small, leaf, near))
    regions = found.filter("b is null").select(F.col("a").alias("id"), "region")
    pairs = checkpoint(_agreeing(found.filter("b is not null").select("a", "b").distinct(), sig, n, percent / 100 - slack))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(regions.select("id")).distinct()
    texts = stamped.join(classes.join(wanted, "id", "left_semi").select("id", F.col("rep").alias("doc_id"), "stamp"), ["doc_id", "stamp"])
    sets = checkpoint(_sets(texts, k))

    best = pairs.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy(F.desc("agree"), "a"))).filter("r = 1").select("a", "b")
    links = checkpoint(_confirm(best, sets, percent))
    comps = checkpoint(components(links))
    across = _confirm(_across(pairs, comps), sets, percent).union(_regions_across(regions, comps, sig, sets, n, percent, percent / 100 - slack, block))
    comps = checkpoint(components(links.union(across).union(_same_id(rows))))
    release(found, pairs, sets, links)

    least = comps.join(classes.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
    of_class = classes.select("id", "rep").join(comps, "id", "left").join(least, "component", "left").select("id", F.coalesce("least", "rep").alias("component_id"))
    out = rows.join(of_class, "id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _same_id(rows: DataFrame) -> DataFrame:
    """Links between the classes of one doc_id."""
    held = rows.filter("id is not null")
    several = held.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a < last")
    return held.join(several, "doc_id").filter("a <> id").select("a", F.col("id").alias("b"))


def candidates(reps: DataFrame, percent: int, trees: int, depth: int, head: int, deep: int, small: int, leaf: int, near: int) -> DataFrame:
    """a, b (a < b): candidates; or a, null, region: members of regions over small, of which not all pairs are candidates."""
    n = trees * depth

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beyond = (np.arange(trees)[:, None] * depth + head + np.arange(deep)[None]) % n
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(m, n)
            acc = np.zeros((m, trees), np.uint64) + np.arange(trees, dtype=np.uint64)
            for j in range(head):
                acc = acc * np.uint64(0xD6E8FEB86659FD93) + sig[:, j::depth] + np.uint64(1)
            tail = np.ascontiguousarray((sig[:, beyond] & np.uint32(0xFFFF)).astype(">u2"))
            tails = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * deep), m * trees, [None, pa.py_buffer(tail.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(tx.mix(acc).view(np.int64).ravel()), tails, pa.array(np.repeat(batch.column("id").to_numpy(), trees)), pa.array(np.repeat(batch.column("n_shingles").to_numpy(), trees))], names=["region", "tail", "id", "n"])

    def emit(ids: np.ndarray, sizes: np.ndarray, region: np.ndarray, tail: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of one batch of complete regions, members in the order of their labels."""
        wide, part, whole = descend(region, tail, small, leaf)
        left, right = [], []
        for gap in range(1, small):
            i = np.flatnonzero(((part[:-gap] == part[gap:]) & whole[:-gap]) | ((region[:-gap] == region[gap:]) & (gap <= near))) if gap < len(region) else []
            if not len(i):
                break
            x, y = sizes[i], sizes[i + gap]
            i = i[100 * np.minimum(x, y) >= percent * np.maximum(x, y)]
            left.append(ids[i])
            right.append(ids[i + gap])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.nulls(len(lo), pa.int64())], names=["a", "b", "region"])
        if wide.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[wide]), pa.nulls(int(wide.sum()), pa.int64()), pa.array(region[wide])], names=["a", "b", "region"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        joined = lambda: [np.concatenate([h[j] for h in held]) for j in range(4)]
        for batch in batches:
            if not batch.num_rows:
                continue
            tail = np.frombuffer(b"".join(batch.column("tail").to_pylist()), ">u2").reshape(-1, deep)
            cols = (*(batch.column(c).to_numpy() for c in ("id", "n", "region")), tail)
            held.append(cols)
            if held[0][2][0] == cols[2][-1]:  # one region as yet
                continue
            ids, sizes, region, tail = joined()
            cut = int(len(region) - np.argmax(region[::-1] != region[-1]))
            yield from emit(ids[:cut], sizes[:cut], region[:cut], tail[:cut])
            held = [(ids[cut:], sizes[cut:], region[cut:], tail[cut:])]
        if held:
            yield from emit(*joined())

    labels = reps.mapInArrow(label, "region long, tail binary, id long, n long")
    return labels.repartition("region").sortWithinPartitions("region", "tail", "id").mapInArrow(neighbours, "a long, b long, region long")


def descend(region: np.ndarray, tail: np.ndarray, small: int, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(in a region over small; number of the part that each member ends in; whether that part is compared whole) of sorted members.

    A region over small is parted by one more value at a time, as long as the part
    has over leaf members: its depth is its own.
    """
    new = np.ones(len(region), bool)
    new[1:] = region[1:] != region[:-1]

    def size() -> np.ndarray:
        edge = np.flatnonzero(np.append(new, True))
        return np.repeat(np.diff(edge), np.diff(edge))

    wide = size() > small
    for value in tail.T:
        over = wide & (size() > leaf)
        if not over.any():
            break
        new[1:] |= over[1:] & (value[1:] != value[:-1])
    return wide, np.cumsum(new), ~wide | (size() <= leaf)


def _agreeing(pairs: DataFrame, sig: DataFrame, n: int, least: float) -> DataFrame:
    """Pairs whose signatures agree in the share least of their n values at least; agree: the number."""
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, n) for c in "xy")
            same = (x == y).sum(1)
            ok = pa.array(same >= least * n)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(same.astype(np.int64)).filter(ok)], names=["a", "b", "agree"])

    return both.select("a", "b", "x", "y").mapInArrow(agree, "a long, b long, agree long")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        h, first = shingle_sets(batch.column("text"), k)
        raw, at = h.tobytes(), first.tolist()
        return [pa.array([raw[8 * i : 8 * j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())]

    return append(docs, "shingles binary", make, ["id"]).dropDuplicates(["id"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs a, b those whose full sets link."""
    ends = pairs.select(F.col("a").alias("id"), "a", "b").union(pairs.select(F.col("b").alias("id"), "a", "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for a, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "shingles")), strict=True):
                if last is not None and last[:2] == (a, b):
                    x, y = np.frombuffer(last[2], np.uint64), np.frombuffer(s, np.uint64)
                    both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        out[0].append(a)
                        out[1].append(b)
                    last = None
                else:
                    last = (a, b, s)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return ends.join(sets, "id").select("a", "b", "shingles").repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(check, "a long, b long")


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    c = comps.select(F.col("id"), "component")
    both = pairs.join(c.withColumnsRenamed({"id": "a", "component": "x"}), "a", "left").join(c.withColumnsRenamed({"id": "b", "component": "y"}), "b", "left")
    return both.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def _regions_across(regions: DataFrame, comps: DataFrame, sig: DataFrame, sets: DataFrame, n: int, percent: int, least: float, block: int) -> DataFrame:
    """Links across the components of large regions, enough to join what they join.

    A region's members are dealt into blocks of about ``block``; each pair of blocks
    is a task.  Pairs whose signatures agree, that share no earlier region and that
    no link found there has joined yet are confirmed on the full sets, so no pair
    but a joining link leaves.
    """
    of = regions.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = of.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / block).cast("int").alias("parts")).filter("lo <> hi").select("region", "parts")
    every = of.join(mixed, "region").groupBy("id", "component").agg(F.collect_list(F.struct("region", "parts")).alias("open"))
    every = every.select("id", "component", F.col("open.region").alias("regions"), F.explode("open").alias("o"))
    every = every.select("id", "component", "regions", "o.region", F.pmod(F.xxhash64("id"), "o.parts").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("o.parts") - 1)).alias("other"))
    rows = every.join(sig, "id").join(sets, "id").withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")

    def cross(region: int, i: int, j: int, members: list[dict]) -> tuple[list[int], list[int]]:
        members.sort(key=lambda r: r["component"])
        comp = np.array([r["component"] for r in members])
        own = np.array([r["own"] for r in members])
        sigs = np.frombuffer(b"".join(r["sig"] for r in members), np.uint32).reshape(-1, n)
        full = [np.frombuffer(r["shingles"], np.uint64) for r in members]
        shared = [set(r["regions"]) for r in members]
        ends = np.searchsorted(comp, comp, side="right")
        root: dict[int, int] = {}

        def up(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        left, right = [], []
        for x in range(len(members)):
            e = int(ends[x])  # those of later components
            ok = e + np.flatnonzero(((sigs[e:] == sigs[x]).sum(1) >= least * n) & ((own[e:] != own[x]) | (i == j)))
            ok = [y for y in ok.tolist() if up(int(comp[x])) != up(int(comp[y])) and min(shared[x] & shared[y]) == region]
            if not ok:
                continue
            sizes = np.array([len(full[y]) for y in ok])
            them = np.concatenate([full[y] for y in ok])
            p = np.minimum(np.searchsorted(full[x], them), len(full[x]) - 1)
            both = np.add.reduceat((full[x][p] == them).astype(np.int64), np.cumsum(sizes) - sizes)
            for y in np.array(ok)[100 * both >= percent * (len(full[x]) + sizes - both)].tolist():
                a, b = up(int(comp[x])), up(int(comp[y]))
                if a != b:
                    root[b] = a
                    left.append(min(members[x]["id"], members[y]["id"]))
                    right.append(max(members[x]["id"], members[y]["id"]))
        return left, right

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (region, i, j), members in runs(batches, "region", "i", "j"):
            a, b = cross(region, i, j, members)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j").mapInArrow(join, "a long, b long")
