"""Hard-negative mining over one-dimensional distance keys.

Vectors become integers; one coordinate more brings all to the same length, so the
highest inner product is the smallest distance.  Each vector is keyed by its nearest
pivot and the distance to it, and the table is stored sorted by (pivot, distance), cut
into annuli of at most ``block`` rows a part.  For an anchor the triangle inequality
bounds the distance of all that an annulus holds.  A search goes out from the anchor,
round by round, to the annuli within a growing radius, and ends once the bound on what
is left certifies its answers.  It is exact, whatever the pivots.

Two searches share the index: the best rows of the anchor's label, then for each such
positive the best rows of other labels in a band of scores.  Annuli that lie wholly
above a band are passed over, so the second search begins where the band does.  Work
falls with how far vectors cluster; where the bounds say nothing a search ends up with
all rows, block by block.

Only a directory of annuli goes to the driver and to the tasks (DIRECTORY entries at
most, for pivots and partitions a few more); beyond it annuli have several parts.  An
annulus that many anchors ask for is dealt to several tasks, each with some of them.

Rows without label, vector or id, and vectors with a null or non-finite component, take
no part; nor do those whose integers' squared length is 2**62 or more, as scores must
fit a long.  Vectors meet those of equal length only, empty ones too.  Ties: smaller
vec_id.  Repeated ids: rows of their own; each is an anchor.  No rows: no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint, partitions, release
from quillon.llm.multi_index import distances, lloyd

DIRECTORY = 1 << 16
MOST, LEAST = np.iinfo(np.int64).max // 4, np.iinfo(np.int64).min // 4  # ends of an open band
STATE = "q long, anchor long, label long, v binary, positives binary, wants binary, best binary, radius double, next double, open boolean"


class Space(NamedTuple):
    """What all tasks know: the pivots and the directory of annuli."""

    pivots: np.ndarray  # with the further coordinate in the last column
    apart: np.ndarray  # distances between pivots
    length2: float  # squared length of all stored vectors
    annulus: np.ndarray
    pivot: np.ndarray
    nearest: np.ndarray  # smallest and largest distance to the pivot
    farthest: np.ndarray
    rows: np.ndarray
    parts: np.ndarray


def mine(
    vectors: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    pivots: int = 8, most_pivots: int = 512, block: int = 2048, anchors_a_task: int = 8192, sample_bytes: int = 1 << 25, seed: int = 5,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label; anchor: which rows are anchors.  low and high: a
    negative's score in hundredths of the positive's.  The number of pivots is a quarter
    of the root of the number of rows, within pivots and most_pivots; they are fitted on
    at most sample_bytes of vectors chosen by hash.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    rows = rows.filter("vec_id is not null and label is not null and embedding is not null").filter(finite).withColumn("row", F.monotonically_increasing_id())
    rows = checkpoint(rows.mapInArrow(_integers(scale), "row long, vec_id long, label long, asks boolean, v binary, length2 long"))
    n, length2, longest = rows.agg(F.count("*"), F.max("length2"), F.max(F.length("v"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    k = min(max(pivots, math.isqrt(n) // 4), most_pivots)
    least_rows = min(n, max(2 * k, sample_bytes // (2 * (longest or 4))))
    draw = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, 32 * k / n)))
    sample = rows.filter(draw).select("v", "length2").limit(least_rows).toArrow()
    if not sample.num_rows:
        sample = rows.select("v", "length2").limit(k).toArrow()
    points = _lifted(sample.column("v").to_pylist(), sample.column("length2").to_numpy(), float(length2))
    books = lloyd(points, k, np.random.default_rng(seed))
    shared = rows.sparkSession.sparkContext.broadcast((books, float(length2)))
    placed = rows.mapInArrow(_key(shared), "pivot int, distance double, row long, vec_id long, label long, v binary")
    placed = placed.repartitionByRange(partitions(rows), "pivot", "distance", "row").sortWithinPartitions("pivot", "distance", "row")
    parts = -(-n // (block * DIRECTORY))
    index = checkpoint(placed.mapInArrow(_number(block, parts), "annulus long, part int, pivot int, distance double, row long, vec_id long, label long, v binary"))
    directory = index.groupBy("annulus").agg(F.first("pivot").alias("pivot"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest"), F.count("*").alias("rows"), (F.max("part") + 1).alias("parts")).toArrow()
    apart = np.sqrt(distances(books, books))
    space = Space(books, apart, float(length2), *(directory.column(c).to_numpy() for c in ("annulus", "pivot", "nearest", "farthest", "rows", "parts")))
    search = _Search(index, rows.sparkSession.sparkContext.broadcast(space), block, anchors_a_task)
    asks = rows.filter("asks").select(F.col("row").alias("q"), F.col("vec_id").alias("anchor"), "label", "v")
    found = search.run(asks.mapInArrow(_first(search, positives), STATE), positives, same=True)
    bands = found.mapInArrow(_bands(search, negatives, low, high), STATE)
    done = search.run(bands, negatives, same=False)
    release(found, index, rows)
    return done.mapInArrow(_answers, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("embedding")
            ends = np.cumsum(np.asarray(pc.list_value_length(rows), np.int64))
            flat = np.floor(scale * rows.flatten().to_numpy(zero_copy_only=False))
            v = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]
            length2 = np.array([float(x @ x) for x in v])
            ok = np.flatnonzero(length2 < 2.0**62)
            v = [v[i].astype(np.int32) for i in ok]
            exact = [int(x.astype(np.int64) @ x.astype(np.int64)) for x in v]
            kept = batch.take(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("row", "vec_id", "label", "asks")), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(exact, pa.int64())], names=["row", "vec_id", "label", "asks", "v", "length2"])

    return run


def _lifted(v: list[bytes], own: np.ndarray, length2: float) -> np.ndarray:
    """Vectors with zeros up to the longest, and the coordinate that brings each to the same length."""
    x = [np.frombuffer(b, np.int32) for b in v]
    out = np.zeros((len(x), max((len(y) for y in x), default=0) + 1))
    for i, y in enumerate(x):
        out[i, : len(y)] = y
    out[:, -1] = np.sqrt(np.maximum(length2 - own.astype(np.float64), 0))
    return out


def _to_pivots(pivots: np.ndarray, v: list[bytes], further: np.ndarray, length2: np.ndarray) -> np.ndarray:
    """Distances of vectors (with the coordinate further, of whole squared length length2) to all pivots."""
    dim = pivots.shape[1] - 1
    x = np.zeros((len(v), dim + 1))
    for i, b in enumerate(v):
        y = np.frombuffer(b, np.int32)[:dim]
        x[i, : len(y)] = y
    x[:, -1] = further
    return np.sqrt(np.maximum(length2[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T), 0))


def _key(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, length2 = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = part.column("length2").to_numpy().astype(np.float64)
                d = _to_pivots(pivots, part.column("v").to_pylist(), np.sqrt(np.maximum(length2 - own, 0)), np.full(len(own), length2))
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), *(part.column(c) for c in ("row", "vec_id", "label", "v"))], names=["pivot", "distance", "row", "vec_id", "label", "v"])

    return run


def _number(block: int, parts: int):
    """annulus and part of sorted rows: stretches of one pivot, block rows a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, annulus, seen, pivot = TaskContext.get().partitionId() << 32, -1, 0, None
        for batch in batches:
            p = batch.column("pivot").to_numpy()
            annuli, at = np.empty(len(p), np.int64), np.empty(len(p), np.int32)
            edge = np.flatnonzero(p[1:] != p[:-1]) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(p)], strict=True):
                if i == j:
                    continue
                if p[i] != pivot:
                    pivot, seen, annulus = p[i], 0, annulus + 1
                place = seen + np.arange(j - i)
                first = annulus - (seen // (block * parts))
                annuli[i:j], at[i:j] = base + first + place // (block * parts), place // block % parts
                seen += j - i
                annulus = first + (seen - 1) // (block * parts)
            yield pa.RecordBatch.from_arrays([pa.array(annuli), pa.array(at), *(batch.column(c) for c in ("pivot", "distance", "row", "vec_id", "label", "v"))], names=["annulus", "part", "pivot", "distance", "row", "vec_id", "label", "v"])

    return run


class View(NamedTuple):
    """An anchor's view of the annuli."""

    own: float  # squared length
    margin: float  # of distances
    low: np.ndarray  # no row of the annulus is nearer
    high: np.ndarray  # none is farther


def view(space: Space, v: bytes) -> View:
    x = np.frombuffer(v, np.int32).astype(np.float64)
    own = float(x @ x)
    d = _to_pivots(space.pivots, [v], np.zeros(1), np.array([own]))[0]
    margin = 1e-6 * (math.sqrt(space.length2) + math.sqrt(own) + 1)
    here = d[space.pivot]
    low = np.maximum(here - space.farthest, space.nearest - here)
    # rows are nearest to their own pivot: they lie beyond the plane between it and the anchor's
    home = int(d.argmin())
    between = space.apart[home][space.pivot]
    plane = np.where(between > margin, (here * here - d[home] ** 2) / (2 * np.maximum(between, margin)), 0)
    return View(own, margin, np.maximum(np.maximum(low, plane) - margin, 0), here + space.farthest + margin)


def best_score(space: Space, own: float, distance: float | np.ndarray) -> float | np.ndarray:
    """No row farther than distance has a higher score."""
    return (own + space.length2 - distance * distance) / 2 + 1e-12 * (own + space.length2)


def radius_of(space: Space, at: View, score: int) -> float:
    """All rows of at least this score are within."""
    return math.sqrt(max(at.own + space.length2 - 2.0 * score, 0)) + at.margin


class _Search(NamedTuple):
    """Searches over an index.  A state row is an anchor with its wants (no, ceiling, floor), the best rows of each (no, score, vec_id) and how far it has looked."""

    index: DataFrame
    space: object  # broadcast Space
    block: int
    anchors_a_task: int

    def state(self, q, anchor, label, v, positives: bytes, wants: np.ndarray, best: np.ndarray, radius: float, k: int) -> tuple:
        """The row, with the radius to look within next."""
        space = self.space.value
        at = view(space, v)
        open_ = [w for w in wants.tolist() if not _certain(space, at, w, best, radius, k)] if radius < math.inf else []
        next_ = radius
        if open_:
            wanted = _worth(space, at, max(w[1] for w in open_))
            ahead = wanted & (at.low > radius)
            order = np.flatnonzero(ahead)[at.low[ahead].argsort()]
            seen = int(space.rows[wanted & ~ahead].sum())
            enough = np.searchsorted(np.cumsum(space.rows[order]), max(4 * self.block, 3 * seen))
            need = max(_needed(space, at, w, best, k) for w in open_)
            next_ = min(float(at.low[order[enough]]) if enough < len(order) else math.inf, need)
            if not len(order) or next_ >= at.low[order[-1]]:
                next_ = math.inf
        return q, anchor, label, v, positives, wants.tobytes(), best.tobytes(), radius, next_, bool(open_)

    def run(self, state: DataFrame, k: int, same: bool) -> DataFrame:
        """State rows with the best k of each want, of the anchor's label or of others."""
        state = checkpoint(state)
        while state.filter("open").limit(1).count():
            asked = checkpoint(state.filter("open").mapInArrow(_ask(self.space, k), "annulus long, parts int, q long, label long, v binary, wants binary"))
            # a row for each annulus of the directory at most
            busy = asked.groupBy("annulus").agg(F.ceil(F.count("*") / self.anchors_a_task).cast("int").alias("tasks"))
            fields = ["annulus", "part", "task", "role", "id", "key", "label", "v", "wants"]
            members = self.index.join(F.broadcast(busy), "annulus").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
            members = members.select("annulus", "part", "task", F.lit(0).alias("role"), F.col("row").alias("id"), F.col("vec_id").alias("key"), "label", "v", F.lit(None).cast("binary").alias("wants"))
            asks = asked.join(F.broadcast(busy), "annulus").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("task", F.pmod(F.xxhash64("q"), F.col("tasks")).cast("int"))
            asks = asks.select("annulus", "part", "task", F.lit(1).alias("role"), F.col("q").alias("id"), F.lit(0).cast("long").alias("key"), "label", "v", "wants")
            met = members.union(asks).select(*fields).repartition(partitions(asked), "annulus", "part", "task").sortWithinPartitions("annulus", "part", "task", "role")
            hits = met.mapInArrow(_score(k, same), "q long, best binary")
            none = [F.lit(None).cast(t).alias(c) for c, t in (x.rsplit(" ", 1) for x in STATE.split(", ")) if c not in ("q", "best")]
            names = [x.split(" ")[0] for x in STATE.split(", ")]
            rows = state.withColumn("role", F.lit(0)).union(hits.select("q", "best", *none).select(*names).withColumn("role", F.lit(1)))
            after = checkpoint(rows.repartition(partitions(state), "q").sortWithinPartitions("q", "role").mapInArrow(_merge(self, k), STATE))
            release(state, asked)
            state = after
        return state

    def broadcast_only(self) -> _Search:
        """Without the table, for tasks."""
        return self._replace(index=None)


def _of(best: np.ndarray, no: int) -> np.ndarray:
    return best[best[:, 0] == no]


def _certain(space: Space, at: View, want: list[int], best: np.ndarray, radius: float, k: int) -> bool:
    """No row beyond the radius can change what was found for the want."""
    if want[2] > want[1]:
        return True
    if radius < 0:
        return False
    bound = best_score(space, at.own, radius)
    mine = _of(best, want[0])
    return bound < want[2] or (len(mine) >= k and mine[k - 1, 1] > bound)


def _needed(space: Space, at: View, want: list[int], best: np.ndarray, k: int) -> float:
    mine = _of(best, want[0])
    least = int(mine[k - 1, 1]) if len(mine) >= k else want[2]
    return radius_of(space, at, least) if least > LEAST else math.inf


def _worth(space: Space, at: View, ceiling: int) -> np.ndarray:
    """Annuli that are not wholly above the ceiling."""
    return (at.own + space.length2 - at.high**2) / 2 - 1e-12 * (at.own + space.length2) <= ceiling


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split(" ") for x in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])


def _table(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int64).reshape(-1, 3)


NO_ROWS = np.zeros((0, 3), np.int64)


def _first(search: _Search, k: int):
    """State of anchors that look for rows of their label."""
    search = search.broadcast_only()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [search.state(r["q"], r["anchor"], r["label"], r["v"], b"", np.array([[0, MOST, LEAST]], np.int64), NO_ROWS, -1.0, k) for r in batch.to_pylist()]
            if rows:
                yield _batch(rows)

    return run


def _bands(search: _Search, k: int, low: int, high: int):
    """State of anchors that look below each of their positives."""
    search = search.broadcast_only()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                scores = sorted(set(_table(r["best"])[:, 1].tolist()))
                wants = np.array([[s, high * s // 100, -(-low * s // 100)] for s in scores], np.int64).reshape(-1, 3)
                rows.append(search.state(r["q"], r["anchor"], r["label"], r["v"], r["best"], wants, NO_ROWS, -1.0, k))
            if rows:
                yield _batch(rows)

    return run


def _ask(space, k: int):
    """A row for each annulus between the radius and the next, with what the anchor still wants and the least score that helps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, wants, best = view(space.value, r["v"]), _table(r["wants"]).copy(), _table(r["best"])
                wants = wants[[not _certain(space.value, at, w, best, r["radius"], k) for w in wants.tolist()]]
                for w in wants:
                    mine = _of(best, w[0])
                    if len(mine) >= k:
                        w[2] = max(w[2], mine[k - 1, 1])
                hit = np.flatnonzero(_worth(space.value, at, int(wants[:, 1].max())) & (at.low > r["radius"]) & (at.low <= r["next"]))
                m = len(hit)
                if m:
                    columns = [pa.array(space.value.annulus[hit]), pa.array(space.value.parts[hit].astype(np.int32)), pa.array([r["q"]] * m, pa.int64()), pa.array([r["label"]] * m, pa.int64()), pa.array([r["v"]] * m, pa.binary()), pa.array([wants.tobytes()] * m, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["annulus", "parts", "q", "label", "v", "wants"])

    return run


class _Held(NamedTuple):
    """Rows of one part, of one vector length, by vec_id."""

    row: np.ndarray
    key: np.ndarray
    label: np.ndarray
    v: np.ndarray


def _score(k: int, same: bool):
    """The best k rows of a part for each want of each anchor that asks; a part's rows come before the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for batch in batches:
            annulus, part, task, role = (batch.column(c).to_numpy() for c in ("annulus", "part", "task", "role"))
            row, key, label = (batch.column(c).to_numpy() for c in ("id", "key", "label"))
            v, wants = batch.column("v").to_pylist(), batch.column("wants").to_pylist()
            edge = np.flatnonzero((annulus[1:] != annulus[:-1]) | (part[1:] != part[:-1]) | (task[1:] != task[:-1]) | (role[1:] != role[:-1])) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(row)], strict=True):
                if i == j:
                    continue
                if (annulus[i], part[i], task[i]) != at:
                    at, parts, held = (annulus[i], part[i], task[i]), [], None
                if role[i] == 0:
                    parts.append((row[i:j], key[i:j], label[i:j], v[i:j]))
                    continue
                if held is None:
                    held = _by_length(parts)
                for s in range(i, j, 256):
                    e = min(s + 256, j)
                    yield from _asked(held, row[s:e], label[s:e], v[s:e], wants[s:e], k, same)

    return run


def _by_length(parts: list[tuple]) -> dict[int, _Held]:
    row, key, label = (np.concatenate([p[c] for p in parts]) for c in range(3))
    v = [b for p in parts for b in p[3]]
    size = np.array([len(b) for b in v])
    out = {}
    for n in np.unique(size).tolist():
        of = np.flatnonzero(size == n)
        of = of[key[of].argsort(kind="stable")]
        out[n] = _Held(row[of], key[of], label[of], np.frombuffer(b"".join(v[i] for i in of), np.int32).reshape(len(of), n // 4))
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as integers: by floating point where that is exact."""
    reach = max((float((x.astype(np.float64) ** 2).sum(1).max()) for x in (a, b) if x.size), default=0.0)
    kind = np.float64 if reach < 2.0**52 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _asked(held: dict[int, _Held], q: np.ndarray, label: np.ndarray, v: list[bytes], wants: list[bytes], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    out: tuple[list, list] = ([], [])
    size = np.array([len(b) for b in v])
    for n in np.unique(size).tolist():
        if n not in held:
            continue
        h, of = held[n], np.flatnonzero(size == n)
        s = _products(np.frombuffer(b"".join(v[i] for i in of), np.int32).reshape(len(of), n // 4), h.v)
        fit = (h.label[None] == label[of][:, None]) == same
        fit &= h.row[None] != q[of][:, None]
        for r, i in enumerate(of):
            found = []
            for no, ceiling, floor in _table(wants[i]).tolist():
                hit = np.flatnonzero(fit[r] & (s[r] <= ceiling) & (s[r] >= floor))
                if len(hit):
                    score = s[r][hit]
                    top = (-score).argsort(kind="stable")[:k]
                    found.append(np.stack([np.full(len(top), no), score[top], h.key[hit[top]]], 1))
            if found:
                out[0].append(int(q[i]))
                out[1].append(np.concatenate(found).astype(np.int64).tobytes())
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["q", "best"])


def _merge(search: _Search, k: int):
    """State after a round: an anchor's row comes first, then what was found for it."""
    search = search.broadcast_only()

    def best_of(best: np.ndarray) -> np.ndarray:
        best = best[np.lexsort((best[:, 2], -best[:, 1], best[:, 0]))]
        first = np.searchsorted(best[:, 0], best[:, 0])
        return best[np.arange(len(best)) - first < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, NO_ROWS

        def row() -> tuple:
            if not at["open"]:
                return tuple(at[x.split(" ")[0]] for x in STATE.split(", "))
            return search.state(at["q"], at["anchor"], at["label"], at["v"], at["positives"], _table(at["wants"]), best, at["next"], k)

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["role"] == 0:
                    if at is not None:
                        rows.append(row())
                    at, best = r, _table(r["best"])
                else:
                    best = best_of(np.concatenate((best, _table(r["best"]))))
            if rows:
                yield _batch(rows)
        if at is not None:
            yield _batch([row()])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            best = _table(r["best"])
            for _, score, positive in _table(r["positives"]).tolist():
                rows += [(r["anchor"], positive, rank, negative, score, s) for rank, (_, s, negative) in enumerate(_of(best, score).tolist(), 1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "rank" else pa.int64()) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)


SQL = """
WITH r AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM r a JOIN r b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (SELECT r, anchor_id, other AS positive, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.r, positive ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score) WHERE rank <= 3
"""
