"""Exact substring dedup: column-wise construction of a suffix order over regions.

A text is cut into regions by minimisers: all ``length``-byte windows whose
smallest ``gram``-byte hash stands at the same place.  Equal windows have the same
minimiser at the same offset, so they meet in the same bucket, and only buckets
with two regions or more can hold a repeat.  Regions with equal bytes are counted
(pre-aggregated) and stand for each other.  The windows
of a region are dealt into chunks by the minimiser's offset; the windows of a
chunk share a core, so equal windows meet again by core, and chunks with equal
bytes stand for each other once more.  The distinct chunks are the documents of a
column-wise multi-document construction, the shared core standing as one symbol:
each round inserts one more symbol of every document, from the ends, and updates
the collection's Burrows-Wheeler transform and its longest common prefixes in one
sequential sweep; windows whose common prefix with a neighbour spans a window
repeat.  A collection holds about ``batch`` documents, so the sequential files of the
method are arrays.  The more distinct regions a bucket has (over ``most``), the
shorter its chunks are cut and the longer, and so the rarer, are their cores, down
to cores of a whole window; chunks with equal bytes are told as they stream by.  A core
that still has over ``batch`` distinct chunks is parted in the same way, so no
collection grows with a bucket.

Null and empty texts: no bytes, nothing removed.  Ties: windows are equal or not.  Texts shorter than length: kept
whole.  Repeated rows: every row counts as a document of its own.  Null ids: rows
like others.  Very long texts: whole; memory grows with one text.  No rows: no
rows.  Other columns are ignored, or kept where asked for.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import text as tx
from quillon.llm.common import append, checkpoint, release

REGION = np.dtype([("bucket", "<i8"), ("content", "S16"), ("s0", "<u4"), ("n", "<u4"), ("a", "<u4")])
_GRAM_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram bytes (a power of two) at each place, by doubling."""
    h = tx._SEED[data]
    size, base = 1, _GRAM_BASE
    while size < gram:
        h = h[:-size] * base + h[size:] if len(h) > size else h[:0]
        size, base = size * 2, base * base
    return tx.mix(h)


def regions(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(structured regions of all texts, first region of each text and one past the last's)."""
    n = len(data)
    if n < length:
        return np.zeros(0, REGION), np.zeros(len(offsets), np.int64)
    if n > 2 * tx.PIECE and len(offsets) == 2:  # a very long text: windows that start in one piece after another; a region may end at a border
        parts = []
        for at in range(0, n - length + 1, tx.PIECE):
            part = regions(data[at : at + tx.PIECE + length - 1], np.array([0, min(tx.PIECE + length - 1, n - at)]), length, gram)[0]
            part["s0"] += np.uint32(at)
            parts.append(part)
        out = np.concatenate(parts)
        return out, np.array([0, len(out)])
    with np.errstate(over="ignore"):
        full = gram_hashes(data, gram)
    packed = (full >> np.uint64(32) << np.uint64(32)) | np.arange(len(full), dtype=np.uint64)
    w, size = length - gram + 1, 1
    while 2 * size <= w:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    if w > size:
        packed = np.minimum(packed[: len(packed) - (w - size)], packed[w - size :])
    place = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the minimiser of the window at each start
    lens = np.diff(offsets)
    ok = np.zeros(len(place) + 1, np.int8)
    has = np.flatnonzero(lens >= length)
    np.add.at(ok, offsets[has], 1)
    np.add.at(ok, offsets[has] + lens[has] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    doc = np.searchsorted(offsets, start, side="right") - 1
    pos = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(start)))
    s0, p, d = start[at], pos[at], doc[at]
    out = np.zeros(len(at), REGION)
    out["bucket"] = full[p].view(np.int64)
    out["s0"], out["n"], out["a"] = s0 - offsets[d], count, p - s0
    view, key = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    # 128 bits of the region's bytes, salted with its shape; S16 would drop zero bytes at the end, so the last is set
    content = bytearray(b"".join([key(view[i : i + c + length - 1], seed=(c << 20) ^ a) for i, c, a in zip(s0.tolist(), count.tolist(), (p - s0).tolist(), strict=True)]))
    flat = np.frombuffer(content, np.uint8).reshape(-1, 16)
    flat[:, 15] |= 1
    out["content"] = flat.copy().view("S16").ravel()
    return out, np.searchsorted(d, np.arange(len(offsets)))


def least(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of a[lo:hi] for each pair (lo < hi), in place: the ranges may overlap and be long."""
    order = np.argsort(lo)
    out = np.empty(len(lo), a.dtype)
    # between two ranges stands what parts them, or one value; the last range may end with a
    out[order] = np.minimum.reduceat(np.append(a, a[:1]), np.column_stack((lo[order], hi[order])).ravel())[::2]
    return out


class Columns:
    """Burrows-Wheeler transform and longest common prefixes of many texts, grown by one symbol of each text a round.

    rows: a text's symbols (from 1), right-aligned, after zeros.
    """

    def __init__(self, rows: np.ndarray):
        m = len(rows)
        self.rows, self.lens = rows, (rows > 0).sum(1)
        self.bwt = np.zeros(m, rows.dtype)  # of the empty suffixes, text by text
        self.lcp = np.zeros(m, np.int32)  # with the suffix before
        self.owner = np.arange(m, dtype=np.int32)  # text of each suffix
        self.size = np.zeros(m, np.int32)  # its length
        self.at = np.arange(m)  # place of each text's longest suffix
        for j in range(1, rows.shape[1] + 1):
            self._round(j)

    def _round(self, j: int) -> None:
        c = self.rows[:, -j]
        live = np.flatnonzero(c)
        q, c = self.at[live], c[live]
        self.bwt[q] = c
        n = len(self.bwt)
        perm = np.argsort(self.bwt, kind="stable")
        keys = self.bwt[perm].astype(np.int64) * n + perm  # sorted
        spot = np.searchsorted(keys, c.astype(np.int64) * n + q)  # of each in the order of (symbol, suffix after it)
        ended = int(np.searchsorted(keys, n))  # suffixes with nothing before them yet: whole texts
        m = len(self.rows)
        final = spot - ended + m  # place after this round: m empty suffixes stand first
        # common prefix with the neighbour before, and of the neighbour after: one more than the least between the suffixes behind them
        ends = np.concatenate((spot, spot + 1))
        ok = (ends < n) & (ends > ended)
        e = np.where(ok, ends, min(ended + 1, n - 1))
        hi, lo = perm[e], perm[e - 1]
        same = ok & (self.bwt[hi] == self.bwt[lo])
        value = np.zeros(len(ends), np.int32)
        if same.any():
            value[same] = least(self.lcp, lo[same] + 1, hi[same] + 1) + 1
        mine, after = value[: len(live)], value[len(live) :]
        order = np.argsort(final)
        dest = final[order]
        size = n + len(live)
        old = np.ones(size, bool)
        old[dest] = False
        for name, new in (("bwt", np.zeros(len(live), self.rows.dtype)), ("lcp", mine[order]), ("owner", live[order].astype(np.int32)), ("size", np.full(len(live), j, np.int32))):
            have = getattr(self, name)
            out = np.empty(size, have.dtype)
            out[old] = have
            out[dest] = new
            setattr(self, name, out)
        behind = dest + 1
        good = behind < size
        self.lcp[behind[good]] = after[order][good]
        self.at = self.at.copy()
        self.at[live[order]] = dest

    def repeats(self, length: int) -> list[np.ndarray]:
        """Of each text the starts of windows that another start shares."""
        long = self.lcp >= length
        hit = long.copy()
        hit[:-1] |= long[1:]
        i = np.flatnonzero(hit)
        owner, start = self.owner[i], self.lens[self.owner[i]] - self.size[i]
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        return np.split(start, np.searchsorted(owner, np.arange(1, len(self.lens))))


def ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, last) of sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True))


RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
RANGES_DDL = "array<struct<lo: int, hi: int>>"


def dedup(docs: DataFrame, length: int = 400, gram: int = 32, keep: list[str] | None = None, most: int = 20_000, batch: int = 2000, out: str = "", unit: str = "byte", passage: int = 0) -> DataFrame:
    """The columns keep of docs (all: None), n_bytes, n_removed, n_spans, kept_sha256; and kept, the remaining bytes (out "bytes") or their text without broken characters ("text").

    unit "word": length counts words (A-Z as a-z, parted by whitespace) instead of bytes,
    and what is removed are runs of words.  A text's words then stand for it as codes of
    CODE bytes; counts and what is kept are still bytes of the text.

    passage: adds n_passage_words, the words of a text in runs of so many words (of the
    kind above) that also start elsewhere; nothing is removed for them.
    """
    keep = docs.columns if keep is None else keep
    by_word = unit == "word"
    seen = codes if by_word else tx.buffer
    length *= CODE if by_word else 1
    keyed = docs.withColumn("_key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))))
    hit = _repeats(keyed, seen, length, gram, most, batch)
    if passage:
        again = _repeats(keyed, codes, passage * CODE, gram, most, batch).withColumnRenamed("_hit", "_passages")
        hit = hit.join(again, "_key", "full")

    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + {"": "", "bytes": ", kept binary", "text": ", kept string"}[out] + ", n_passage_words long" * bool(passage)

    def finish(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        w = tx.words(batch.column("text")) if by_word else None
        for d, (t, r) in enumerate(zip(batch.column("text").to_pylist(), batch.column("_hit").to_pylist(), strict=True)):
            raw = (t or "").encode()
            parts, end, at, removed, spans = [], -1, 0, 0, 0
            hits = [(x["lo"], x["hi"] + length) for x in r or ()]
            if by_word:
                hits = _of_words(hits, w, d, length)
            for lo, hi in sorted(hits):
                if lo > end:
                    if spans:
                        removed += end - begin
                        parts.append(raw[at:begin])
                        at = end
                    begin, spans = lo, spans + 1
                end = max(end, hi)
            if spans:
                removed += end - begin
                parts.append(raw[at:begin])
                at = end
            parts.append(raw[at:])
            kept = b"".join(parts)
            rows.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if out == "text" else kept))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if out == "text" else pa.binary())[: 4 + bool(out)]
        made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
        return made + ([pa.array([_covered(r or (), passage) for r in batch.column("_passages").to_pylist()], pa.int64())] if passage else [])

    joined = keyed.select(*dict.fromkeys([*keep, "text", "_key"])).join(hit, "_key", "left")
    return _append_hit(joined, fields, finish, keep)


def _repeats(keyed: DataFrame, seen: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], length: int, gram: int, most: int, batch: int) -> DataFrame:
    """_key, _hit: of texts (_key, text), as bytes by seen, the runs (lo, hi) of starts of windows that stand elsewhere too; texts without any are not there."""

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        out, first = regions(*seen(batch.column("text")), length, gram)
        raw, at = out.tobytes(), (first * REGION.itemsize).tolist()
        return [pa.array([raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())]

    packed = checkpoint(append(keyed, "_regions binary", cut, ["_key"]).filter(F.octet_length("_regions") > 0))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                blobs = batch.column("_regions").slice(at, 256).to_pylist()
                r = np.frombuffer(b"".join(blobs), REGION)
                key = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(blobs), dtype=np.int32), [len(b) // REGION.itemsize for b in blobs])), batch.column("_key").slice(at, 256)).dictionary_decode()
                content = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(r), [None, pa.py_buffer(np.ascontiguousarray(r["content"]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(r["bucket"]), content, key, *(pa.array(r[c].astype(np.int32)) for c in ("s0", "n", "a"))], names=["bucket", "content", "_key", "s0", "n", "a"])

    places = packed.mapInArrow(spread, "bucket long, content binary, _key binary, s0 int, n int, a int")
    # most buckets have one region: they go first, by counts that are summed before they move.
    # Counts are written before they are joined, so that both sides of a join are plain exchanges and a hot bucket's side is split.
    several = checkpoint(places.groupBy("bucket").agg(F.count("*").alias("all")).filter("all > 1").select("bucket"))
    shared = checkpoint(places.join(several, "bucket", "left_semi"))
    release(packed, several)
    kinds = shared.groupBy("bucket", "content").agg(F.count("*").alias("copies"))
    whole = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), (F.min("copies") == 1).alias("ones"))
    kinds = checkpoint(kinds.join(whole, "bucket").select("bucket", "content", "copies", "kinds", (F.col("ones") & (F.col("kinds") > 1)).alias("open")).filter("copies > 1 or open"))
    found = checkpoint(shared.join(kinds, ["bucket", "content"]))
    release(shared, kinds)

    some = found.filter("open").dropDuplicates(["bucket", "content"])
    asked = some.groupBy("_key").agg(F.collect_list(F.struct("bucket", "content", "s0", "n", "a", "copies", "kinds")).alias("_asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch, "text"):
                out = []
                data, at = seen(piece.column("text"))
                for i, j, want in zip(at[:-1].tolist(), at[1:].tolist(), piece.column("_asked").to_pylist(), strict=True):
                    raw = data[i:j].tobytes()
                    out += [(x["bucket"], x["content"], x["copies"], x["kinds"], x["a"], raw[x["s0"] : x["s0"] + x["n"] + length - 1]) for x in want]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "content", "copies", "kinds", "a", "region"])

    fetched = checkpoint(keyed.select("_key", "text").join(asked, "_key").dropDuplicates(["_key"]).select("text", "_asked").mapInArrow(fetch, "bucket long, content binary, copies long, kinds long, a int, region binary"))
    marks = checkpoint(_constructed(fetched, length, most, batch))
    release(fetched)

    # a region that stands more than once repeats whole; only single ones, unique by content, meet the marks
    whole_ = found.filter("copies > 1").select("_key", F.col("s0").alias("lo"), (F.col("s0") + F.col("n") - 1).alias("hi"))
    single = found.filter("copies = 1").join(marks, ["bucket", "content"]).select("_key", "s0", F.explode("marks").alias("m"))
    single = single.select("_key", (F.col("m.lo") + F.col("s0")).alias("lo"), (F.col("m.hi") + F.col("s0")).alias("hi"))
    hit = whole_.union(single).select("_key", F.struct("lo", "hi").alias("r"))
    return hit.distinct().groupBy("_key").agg(F.collect_list("r").alias("_hit"))


CODE = 4  # bytes that a word is known by


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts as codes of their words: 24 bits of a word's hash, by six bits, the first byte unlike the others."""
    w = tx.words(texts)
    h = tx.word_hashes(w)
    out = np.empty((len(h), CODE), np.uint8)
    for k in range(CODE):
        out[:, k] = (h >> np.uint64(58 - 6 * k)).astype(np.uint8) & 0x3F | (0x80 if k else 0x40)
    return out.ravel(), w.first.astype(np.int64) * CODE


def _of_words(hits: list[tuple[int, int]], w: tx.Words, d: int, length: int) -> list[tuple[int, int]]:
    """Ranges of the text's bytes for ranges of its codes (of windows of length) that begin with a word."""
    out = []
    for lo, hi in hits:
        a, b = -(-lo // CODE), (hi - length) // CODE  # first and last window that begin with a word
        if a <= b:
            base, off = int(w.first[d]), int(w.offsets[d])
            out.append((int(w.start[base + a]) - off, int(w.end[base + b + length // CODE - 1]) - off))
    return out


def _covered(hits: list[dict], passage: int) -> int:
    """Words in the windows of passage words that hits (of codes) have."""
    end = n = 0
    for lo, hi in sorted((-(-x["lo"] // CODE), x["hi"] // CODE + passage) for x in hits):
        if lo + passage <= hi:  # a window begins with a word
            n += max(0, hi - max(lo, end))
            end = max(end, hi)
    return n


def _append_hit(joined: DataFrame, fields: str, finish, keep: list[str]) -> DataFrame:
    added = T.StructType.fromDDL(fields)
    keep = [c for c in keep if c not in added.fieldNames()]
    schema = T.StructType([joined.schema[c] for c in keep] + list(added))
    names = [*keep, *added.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *finish(piece)], names=names)

    return joined.select(*dict.fromkeys([*keep, "text", "_hit", *(["_passages"] if "_passages" in joined.columns else [])])).mapInArrow(run, schema)


def narrow(chunk: int, group: list[tuple], most: int) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
    """(chunk, members, windows that repeat) of groups of at most ``most`` distinct members, for a group of equal core that has more.

    A member: left, right, and (bucket, content, first window) if single.  Its windows
    are halved by how much of the left they hold: those of a half share a longer core,
    so a group falls apart by it, and members that are equal then repeat whole.
    """
    if len(group) <= most:
        yield chunk, group, []
        return
    h = (chunk + 1) // 2
    for more in (True, False):  # windows with h symbols of the left or more; with fewer
        parts: dict[bytes, dict[tuple[bytes, bytes], list]] = {}
        for left, right, single in group:
            if more and len(left) >= h:
                core, rest, skip = left[-h:], (left[:-h], right[: chunk - 1 - h]), 0
            elif not more and len(right) >= chunk - h:
                skip = max(0, len(left) - h + 1)
                core, rest = right[: chunk - h], (left[skip:], right[chunk - h :])
            else:
                continue
            parts.setdefault(core, {}).setdefault(rest, []).append(single and (*single[:2], single[2] + skip))
        size = chunk - h if more else h
        while parts:
            members, equal = [], []
            for (left, right), singles in parts.popitem()[1].items():
                alone = len(singles) == 1
                members.append((left, right, singles[0] if alone else None))
                last = len(left) + len(right) + 1 - size
                equal += [] if alone else [(*x[:2], x[2], x[2] + last) for x in singles if x]
            if equal:
                yield size, [], equal
            yield from narrow(size, members, most)


def _constructed(fetched: DataFrame, length: int, most: int, batch_: int) -> DataFrame:
    """bucket, content, marks: repeated windows of each region that stands once, by the column-wise construction over chunks of equal core."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = xxhash.xxh3_128_digest
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for bucket, content, copies, kinds, a, r in zip(*(batch.column(c).slice(at, 500).to_pylist() for c in ("bucket", "content", "copies", "kinds", "a", "region")), strict=True):
                    chunk = max(1, length // 6 >> max(0, (kinds - 1) // most).bit_length())
                    core, last, i = length - chunk + 1, len(r) - length, 0
                    while i <= last:
                        q = (a - i) // chunk  # the windows i to j have the minimiser at offsets of one chunk
                        j = min(last, a - q * chunk)
                        c = a - q * chunk
                        out.append((chunk, key(r[c : c + core], seed=q), r[i:c], r[c + core : j + length], bucket, content, copies, i))
                        i = j + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32()), strict=True)], names=["chunk", "core", "left", "right", "bucket", "content", "copies", "first"])

    def build(chunk: int, groups: list[list[tuple]]) -> Iterator[tuple[int, bytes, int, int]]:
        """(bucket, content, first and last repeated window) of the single members of groups of equal core; a member: left, right, (bucket, content, first) if single."""
        open_ = [(g, *m) for g, members in enumerate(groups) for m in members]
        rows = np.zeros((len(open_), max(len(x) + len(y) for _, x, y, _ in open_) + 1), np.uint16 if len(groups) < 60_000 else np.uint32)  # two bytes sort much faster
        for row, (g, left, right, _) in zip(rows, open_, strict=True):
            row[len(row) - len(right) :] = np.frombuffer(right, np.uint8).astype(rows.dtype) + 1
            row[len(row) - len(right) - 1] = 257 + g
            row[len(row) - len(right) - 1 - len(left) : len(row) - len(right) - 1] = np.frombuffer(left, np.uint8).astype(rows.dtype) + 1
        for (*_, single), starts in zip(open_, Columns(rows).repeats(chunk), strict=True):
            if single:
                yield from ((single[0], single[1], single[2] + i, single[2] + j) for i, j in ranges(starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = []  # complete groups of two distinct members or more
        group: list[tuple] = []  # distinct members of the core at hand
        size = 0
        at = last = None  # (chunk, core), and the member before: left, right, bucket, content, copies, first, whether it repeats
        out: list[tuple] = []

        def hold(chunk: int) -> Iterator[pa.RecordBatch]:
            """The group is complete: it waits for others of its chunk, or is parted and built."""
            nonlocal held, size
            if len(group) > batch_:
                if held:
                    yield flush(chunk)
                waiting: dict[int, list[list[tuple]]] = {}
                sizes: Counter[int] = Counter()
                for c, part, equal in narrow(chunk, group, batch_):
                    out.extend(equal)
                    if len(part) > 1:
                        if c in waiting and sizes[c] + len(part) > batch_:
                            held = waiting.pop(c)
                            sizes[c] = 0
                            yield flush(c)
                        waiting.setdefault(c, []).append(part)
                        sizes[c] += len(part)
                for c, held in waiting.items():
                    yield flush(c)
            elif len(group) > 1:
                if held and size + len(group) > batch_:
                    yield flush(chunk)
                held.append(group)
                size += len(group)

        def close(single: bool) -> None:
            """The member before is complete."""
            if last is not None:
                group.append((last[0], last[1], (last[2], last[3], last[5]) if single and last[4] == 1 else None))

        def flush(chunk: int) -> pa.RecordBatch:
            nonlocal held, size, out
            rows, held, size, out = [*out, *(build(chunk, held) if held else ())], [], 0, []
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["bucket", "content", "lo", "hi"])

        single = True
        for batch in batches:
            for chunk, core, left, right, *member in zip(*(batch.column(c).to_pylist() for c in ("chunk", "core", "left", "right", "bucket", "content", "copies", "first")), strict=True):
                if at == (chunk, core) and last[:2] == (left, right):
                    # equal chunks: all their windows repeat
                    end = len(left) + len(right) + 1 - chunk
                    out += [(m[0], m[1], m[3], m[3] + end) for m in ((last[2:], member) if single else (member,)) if m[2] == 1]
                    single = False
                    continue
                close(single)
                if at != (chunk, core):
                    if group:
                        yield from hold(at[0])
                    group = []
                    if held and at[0] != chunk:
                        yield flush(at[0])
                    at = (chunk, core)
                last, single = (left, right, *member), True
            if len(out) > 10_000:
                yield flush(at[0])
        close(single)
        if group:
            yield from hold(at[0])
        yield flush(at[0] if at else 0)

    dealt = fetched.mapInArrow(deal, "chunk int, core binary, left binary, right binary, bucket long, content binary, copies long, first int")
    found = dealt.repartition("core").sortWithinPartitions("chunk", "core", "left", "right").mapInArrow(run, "bucket long, content binary, lo int, hi int")
    return found.groupBy("bucket", "content").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
