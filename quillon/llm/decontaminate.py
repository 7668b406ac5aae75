"""Benchmark decontamination with a generalised suffix automaton.

Training texts stream through an automaton of the normalised words of the test items,
and the longest match ending at each word tells which windows end there.  A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one
window.  Only stretches whose neighbouring words are neighbours in some item can hold a
window of two or more words, so a vectorised look-up of word pairs skips the rest
exactly.  The rarest pairs of a stretch name the items that may have a window in it;
the automaton that a piece of text goes through holds those items, block_words of words
at once.

What is broadcast is word hashes and places of word pairs, of so many items at once as
have ``held_words`` words; more items take more passes over the texts, and each pass
drops the items of the one before.

Null or empty texts: no words, no hits, not contaminated.  Items without words:
no window.  Repeated items or documents: each counts by itself.  Ties: windows that
overlap count their words once.  Very long texts: whole, a piece by themselves.  No
items or no documents: no hits, or no rows.  Other columns are kept, or ignored where
keep leaves them out; those with the names of results give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import text as tx
from quillon.llm.common import append, checkpoint, release

FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: long, end: long>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Automaton:
    """Suffix automaton of many word sequences; states know the items that hold their strings."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, seq in items:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for name, seq in items:
            self._mark(name, seq, window)
        self.up: list[int] = []  # nearest state, itself included, with short windows
        if self.short:
            self.up = [-1] * len(self.next)
            for v in sorted(range(len(self.next)), key=self.length.__getitem__):
                self.up[v] = v if v in self.short else self.up[self.link[v]] if v else -1
        self.window = window

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._state({}, length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        new = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _state(self, nxt: dict[int, int], length: int) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _mark(self, name: str, seq: list[int], window: int) -> None:
        for _, v, l in self.walk(seq):
            if l >= window:
                self.items.setdefault(self._at(v, window), set()).add(name)
        if 0 < len(seq) < window:
            self.short.setdefault(self._at(v, len(seq)), {}).setdefault(len(seq), set()).add(name)

    def _at(self, v: int, n: int) -> int:
        """The state of the last n words of v's match."""
        while self.length[self.link[v]] >= n:
            v = self.link[v]
        return v

    def walk(self, seq: Iterable[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length of the longest match ending there)."""
        v = l = 0
        for i, c in enumerate(seq):
            while v and c not in self.next[v]:
                v = self.link[v]
                l = self.length[v]
            v, l = (self.next[v][c], l + 1) if c in self.next[v] else (0, 0)
            yield i, v, l

    def windows(self, seq: Iterable[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, one past the last, items) of each window occurring in seq."""
        for i, v, l in self.walk(seq):
            if l >= self.window:
                yield i + 1 - self.window, i + 1, self.items[self._at(v, self.window)]
            u = self.up[v] if self.up else -1
            while u >= 0:
                for n, names in self.short[u].items():
                    if n <= l:
                        yield i + 1 - n, i + 1, names
                u = self.up[self.link[u]] if u else -1


def among(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _stretches(near: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of words (begin, end) within a text of which each next to another is near; near: of each pair of neighbours."""
    heads = first[1:-1]
    near = near.copy()
    near[heads[(heads > 0) & (heads <= len(near))] - 1] = False
    edge = np.diff(np.concatenate(([0], near.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1


def _runs(known: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of known words within a text."""
    cut = np.zeros(len(known) + 1, bool)
    cut[first] = True
    begin = np.flatnonzero(known & np.concatenate(([True], ~known[:-1] | cut[1:-1])))
    return begin, np.flatnonzero(known & np.concatenate((~known[1:] | cut[1:-1], [True]))) + 1


def _pair(h: np.ndarray) -> np.ndarray:
    return tx.mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])


class Part:
    """Items whose windows have like lengths, and where their units stand: neighbouring words, or single words if a window may be one.

    A window of ``least`` words or more holds any least - 1 units in a row, so an item
    with a window in a stretch has the rarest unit of one of the stretch's runs of so
    many.  Only those items come into an automaton, some block_words words of them at a
    time, so neither its size nor the work on a text grows with the number of items.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int, block_words: int):
        self.names = [name for name, _ in items]
        self.words = np.concatenate([h for _, h in items])
        self.first = np.concatenate(([0], np.cumsum([len(h) for _, h in items])))
        self.window, self.block_words = window, block_words
        self.least = min(min(len(h), window) for _, h in items)
        units = [self._units(h) for _, h in items]
        of = np.repeat(np.arange(len(items), dtype=np.int32), [len(u) for u in units])
        units = np.concatenate(units)
        order = np.lexsort((of, units))
        units, of = units[order], of[order]
        new = np.concatenate(([True], (units[1:] != units[:-1]) | (of[1:] != of[:-1])))
        units, self.of = units[new], of[new]
        self.units, at = np.unique(units, return_index=True)
        self.at = np.append(at, len(units))

    def _units(self, h: np.ndarray) -> np.ndarray:
        return _pair(h) if self.least > 1 else h

    def find(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, set[str]]]:
        """(text, first word, one past the last, items) of all windows."""
        if not len(hashes):
            return
        units = self._units(hashes)
        known = among(self.units, units)
        begin, end = _stretches(known, first) if self.least > 1 else _runs(known, first)
        long = end - begin >= self.least
        begin, end = begin[long], end[long]
        docs = np.searchsorted(first, begin, side="right") - 1
        step = max(self.least - 1, 1)
        asked = []
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            at = np.searchsorted(self.units, units[b : e - (self.least > 1)])
            size = self.at[at + 1] - self.at[at]
            rare = np.unique(np.lib.stride_tricks.sliding_window_view(size, step).argmin(1) + np.arange(len(size) - step + 1))
            asked.append(np.unique(np.concatenate([self.of[self.at[u] : self.at[u + 1]] for u in np.unique(at[rare])])))
        if not asked:
            return
        items = np.unique(np.concatenate(asked))
        blocks = np.cumsum(self.first[items + 1] - self.first[items]) // self.block_words
        for k in np.unique(blocks):
            some = items[blocks == k]
            held = Automaton([(self.names[i], self.words[self.first[i] : self.first[i + 1]].tolist()) for i in some.tolist()], self.window)
            for d, b, e, want in zip(docs.tolist(), begin.tolist(), end.tolist(), asked, strict=True):
                if among(some, want).any():
                    off = int(first[d])
                    for i, j, names in held.windows(hashes[b:e].tolist()):
                        yield d, b + i - off, b + j - off, names


class Group:
    """Items that are looked for in one pass: those of whole windows, and the shorter ones by themselves, as a short window says little."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int, block_words: int):
        kinds = [x for x in items if len(x[1]) >= window], [x for x in items if len(x[1]) < window]
        self.parts = [Part(x, window, block_words) for x in kinds if x]

    def find(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, set[str]]]:
        for part in self.parts:
            yield from part.find(hashes, first)


def groups(items: DataFrame, window: int, block_words: int, held_words: int) -> Iterator[Group]:
    """Groups of about held_words words at most, or of one item; tasks hash the items, which come to the driver one after another."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch, "text"):
                w = tx.words(piece.column("text"), tx.ALNUM)
                h = tx.word_hashes(w)
                yield pa.RecordBatch.from_arrays([piece.column("item"), pa.array([h[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)], pa.binary())], names=["item", "words"])

    held: list[tuple[str, np.ndarray]] = []
    total = 0
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").filter("text is not null")
    for row in named.mapInArrow(hashed, "item string, words binary").filter(F.length("words") > 0).toLocalIterator():
        held.append((row.item, np.frombuffer(bytes(row.words), np.uint64)))
        total += len(held[-1][1])
        if total >= held_words:
            yield Group(held, window, block_words)
            held, total = [], 0
    if held:
        yield Group(held, window, block_words)


FOUND = "array<struct<start: long, end: long, item: string>>"


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, coverage: float = 0.05, keep: list[str] | None = None, block_words: int = 50_000, held_words: int = 4_000_000) -> DataFrame:
    """The columns keep of docs (all: None) and n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans: byte ranges of the text that windows cover, merged.  contaminated: some
    word is hit and the share of hit words is at least coverage.
    """
    per = round(1 / coverage)
    sc = docs.sparkSession.sparkContext
    keep = docs.columns if keep is None else keep
    before = "__windows_found"  # windows found in earlier passes, under a name that no column has
    while before in docs.columns:
        before += "_"

    def search(shared, batch: pa.RecordBatch) -> tuple[tx.Words, list[list[tuple[int, int, str]]]]:
        w = tx.words(batch.column("text"), tx.ALNUM)
        found = [[(x["start"], x["end"], x["item"]) for x in rows or ()] for rows in batch.column(before).to_pylist()] if before in batch.schema.names else [[] for _ in range(batch.num_rows)]
        for d, i, j, names in shared.value.find(tx.word_hashes(w), w.first):
            found[d] += [(i, j, name) for name in names]
        return w, found

    def gather(shared):
        return lambda batch: [pa.array([[{"start": i, "end": j, "item": name} for i, j, name in f] for f in search(shared, batch)[1]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item", pa.string())])))]

    def conclude(shared):
        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            w, found = search(shared, batch)
            total = np.diff(w.first)
            hit, n_items = np.zeros(len(total), np.int64), np.zeros(len(total), np.int64)
            sha, spans = [hashlib.sha256(b"").hexdigest()] * len(total), [[] for _ in total]
            for d, rows in enumerate(found):
                if not rows:
                    continue
                merged: list[list[int]] = []
                for i, j in sorted({(i, j) for i, j, _ in rows}):
                    if merged and i <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], j)
                    else:
                        merged.append([i, j])
                seen = {name for *_, name in rows}
                hit[d] = sum(j - i for i, j in merged)
                n_items[d] = len(seen)
                sha[d] = hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest()
                base, off = int(w.first[d]), int(w.offsets[d])
                spans[d] = [{"start": int(w.start[base + i]) - off, "end": int(w.end[base + j - 1]) - off} for i, j in merged]
            bad = (hit > 0) & (per * hit >= total)
            return [pa.array(total.astype(np.int64)), pa.array(hit), pa.array(n_items), pa.array(sha), pa.array(bad), pa.array(spans, SPANS)]

        return make

    rest = groups(items, window, block_words, held_words)
    group, after = next(rest, Group([], window, block_words)), next(rest, None)
    more: list[str] = []
    while after is not None:
        shared = sc.broadcast(group)
        last, docs = docs, checkpoint(append(docs, f"{before} {FOUND}", gather(shared), list(dict.fromkeys([*keep, "text"])), also=more))
        shared.destroy()
        if more:
            release(last)
        more, group, after = [before], after, next(rest, None)
    return append(docs, FIELDS, conclude(sc.broadcast(group)), keep, also=more)


def remove_spans(found: DataFrame, max_words: int | None = None) -> DataFrame:
    """Of decontaminate()'s rows with all columns: the text of contaminated ones without its spans; contaminated texts of which no word is left go.

    max_words: texts with more hit words than this lose their spans too, whatever their share.
    """
    over = F.col("contaminated") if max_words is None else F.col("contaminated") | (F.col("n_hit") > max_words)
    found = found.withColumn("_cut", over)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for text, cut, spans in zip(batch.column("text").to_pylist(), batch.column("_cut").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if cut:
                raw, at, parts = text.encode(), 0, []
                for s in spans:
                    parts.append(raw[at : s["start"]])
                    at = s["end"]
                text = b"".join([*parts, raw[at:]]).decode("utf-8", "ignore")
            out.append(text)
        return [pa.array(out, pa.string())]

    left = append(found, "_left string", make, found.columns)
    rest = F.col("_left").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")
    return left.filter(~F.col("_cut") | rest).withColumn("text", F.col("_left")).drop("_cut", "_left")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM (SELECT DISTINCT doc_id, n, i FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
