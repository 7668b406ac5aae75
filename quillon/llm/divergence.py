"""Source divergence audit by two-dimensional tiling of groups.

Terms are counted in each (lang, source) group; a lang keeps the terms that stand in
enough of its documents.  A group's smoothed shares of the kept terms, in whole parts
of a billion, are compared with those of every other source of the lang (part pair) and
with the lang's own (part term).

Groups of a lang are dealt into blocks.  Each block's counts of a chunk of the
vocabulary are packed into one row; rows go to every tile (block by block) that has
their block, and a tile computes the pair submatrix over the chunks one after the other.
The chunks of a tile are spread over slabs, so a lang of few sources and many terms is
many tasks too.  A term that neither group has adds the difference of their empty
shares: that is added once for the whole vocabulary, so a tile reads only counts that
are not zero.  All arithmetic is in integers.

Null text, lang and source are the empty text.  Empty texts have no terms, their group
counts; very long texts are whole, one to a piece.  Ties: by item in the order of its
UTF-8 bytes.  doc_id is not read: repeated rows are documents of their own.  No rows: no
rows.  Other columns are ignored.  Exact while a group's terms number under 9e15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm import text as tx
from quillon.llm.common import checkpoint, partitions, release, unvarint, varint

LETTERS = np.ones(256, dtype=bool)  # bytes of terms, after A-Z were lower-cased
LETTERS[:0x80] = False
LETTERS[0x61:0x7B] = True
SCALE, PRIOR = 1_000_000_000, 5
CHUNK_BITS = 12  # about so many terms a chunk, at most 2**16 with the worst hashing


def audit(docs: DataFrame, least: int = 30, top: int = 50, groups_a_block: int = 32, chunks_a_slab: int = 16) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source)."""
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    counts = checkpoint(docs.mapInArrow(_terms, "lang string, source string, term string, docs long, n long").groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
    # an empty text's row has a null term and keeps its group in the table
    groups = counts.select("lang", "source").distinct()
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least).drop("docs")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    chunks = size.select("lang", F.shiftright(F.col("v"), CHUNK_BITS).alias("last"))
    kept = kept.join(chunks, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("last") + 1)).drop("last")
    # a chunk has some thousand terms, whatever the table's size; it is dealt by itself, not with its lang
    kept = kept.repartition(partitions(docs), "lang", "chunk")
    kept = checkpoint(kept.withColumn("at", F.row_number().over(W.partitionBy("lang", "chunk").orderBy("term")) - 1))
    held = checkpoint(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "chunk", "at"))
    total = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(total, ["lang", "source"], "left").join(size, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / groups_a_block).cast("long").alias("blocks"))
    groups = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    groups = checkpoint(groups.withColumn("member", F.row_number().over(W.partitionBy("lang", "block").orderBy("source")) - 1))
    release(counts, kept)
    pairs = _pairs(held, groups, chunks_a_slab)
    words = _words(held, groups, top)
    return pairs.unionByName(words)


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * v)), exact."""
    wide = "decimal(19,0)"
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast(wide), (total + PRIOR * v).cast(wide))).cast("long")


def shares(n: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """share of int64 arrays: long division by three digits at a time, so nothing overflows."""
    below = total + PRIOR * v
    rest, out = n + PRIOR, np.zeros(np.broadcast_shapes(n.shape, below.shape), np.int64)
    out += rest // below
    rest = rest % below
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest %= below
    return out + 1


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, documents with it and occurrences, of each piece of texts."""
    for batch in batches:
        for piece in tx.slices(batch, "text", 2 * tx.PIECE):
            w = tx.words(piece.column("text"), LETTERS)
            doc = np.repeat(np.arange(piece.num_rows), np.diff(w.first))
            # the terms' bytes without what stands between them are an array of strings
            offsets = np.concatenate(([0], np.cumsum(w.end - w.start)))
            inside = LETTERS[w.data]
            terms = pa.LargeStringArray.from_buffers(len(doc), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(w.data[inside]))).dictionary_encode()
            code, names = terms.indices.to_numpy().astype(np.int64), terms.dictionary.cast(pa.string())
            key = pa.StructArray.from_arrays([piece.column("lang"), piece.column("source")], ["lang", "source"]).to_pylist()
            known: dict[tuple, int] = {}
            group = np.array([known.setdefault((k["lang"], k["source"]), len(known)) for k in key], np.int64)
            m = max(len(names), 1)
            in_doc, n = np.unique(doc * m + code, return_counts=True)
            in_group, where = np.unique(group[in_doc // m] * m + in_doc % m, return_inverse=True)
            docs, times = np.bincount(where, minlength=len(in_group)), np.bincount(where, weights=n, minlength=len(in_group))
            g, t = in_group // m, in_group % m
            # and a row without a term for each group, which may have none
            g, t = np.concatenate((g, np.arange(len(known)))), pa.array(np.concatenate((t, np.zeros(len(known), np.int64))), mask=np.arange(len(t) + len(known)) >= len(t))
            none = np.zeros(len(known))
            langs, sources = ([k[i] for k in known] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()).take(pa.array(g)), pa.array(sources, pa.string()).take(pa.array(g)), names.take(t), pa.array(np.concatenate((docs, none)).astype(np.int64)), pa.array(np.concatenate((times, none)).astype(np.int64))],
                names=["lang", "source", "term", "docs", "n"],
            )


def _pairs(held: DataFrame, groups: DataFrame, chunks_a_slab: int) -> DataFrame:
    """Part pair."""
    parts = partitions(held)
    place = groups.select("lang", "source", "block", "member")
    cells = held.join(place, ["lang", "source"]).select("lang", "block", "chunk", F.col("member").cast("int").alias("member"), F.col("at").cast("int").alias("at"), "n")
    packed = cells.repartition(parts, "lang", "block", "chunk").sortWithinPartitions("lang", "block", "chunk").mapInArrow(_pack, "lang string, block long, chunk long, cells binary")
    packed = checkpoint(packed)
    # what a tile knows of a block's groups: their totals, in the order of members
    totals = F.transform(F.array_sort(F.collect_list(F.struct("member", "total"))), lambda x: x["total"])
    heads = groups.groupBy("lang", "block", "blocks", "v").agg(totals.alias("totals"))
    slabs = F.floor((F.shiftright(F.col("v"), CHUNK_BITS) + chunks_a_slab) / chunks_a_slab).cast("long")
    heads = heads.withColumn("slabs", slabs)
    rows = packed.join(heads.select("lang", "block", "blocks", "slabs"), ["lang", "block"]).select("lang", "block", "blocks", F.floor(F.col("chunk") / chunks_a_slab).alias("slab"), "chunk", "cells", F.lit(None).cast("array<bigint>").alias("totals"), F.lit(0).cast("long").alias("v"))
    ahead = heads.withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slabs") - 1))).select("lang", "block", "blocks", "slab", F.lit(-1).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("cells"), "totals", "v")
    # block b goes to the tiles (b, j) for j >= b and (i, b) for i < b
    tiles = rows.union(ahead).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "slab", "chunk", "block", "cells", "totals", "v")
    sums = tiles.repartition(parts, "lang", "i", "j", "slab").sortWithinPartitions("lang", "i", "j", "slab", "chunk", "block").mapInArrow(_tile, "lang string, i long, a int, j long, b int, value long")
    sums = sums.groupBy("lang", "i", "a", "j", "b").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", "j", "b", "i", "a", "value"))
    left = place.withColumnsRenamed({"block": "i", "member": "a"})
    right = place.withColumnsRenamed({"block": "j", "member": "b", "source": "item"})
    out = both.join(left, ["lang", "i", "a"]).join(right, ["lang", "j", "b"])
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return out.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (lang, block, chunk) of sorted rows; its columns are packed one after the other."""
    at, held = None, []

    def row() -> pa.RecordBatch:
        # place and count of all cells, each as planes of bytes
        keys = np.concatenate([h[0] for h in held])
        order = keys.argsort(kind="stable")
        a, b = varint(keys[order]), varint(np.concatenate([h[1] for h in held])[order])
        cells = len(a).to_bytes(4, "little") + a + b
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int64()), pa.array([at[2]], pa.int64()), pa.array([cells], pa.binary())], names=["lang", "block", "chunk", "cells"])

    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        code, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
        block, chunk = batch.column("block").to_numpy(), batch.column("chunk").to_numpy()
        key = batch.column("member").to_numpy().astype(np.int64) << 16 | batch.column("at").to_numpy()
        n = batch.column("n").to_numpy()
        edge = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(n)], strict=True):
            if i == j:
                continue
            here = names[code[i]], int(block[i]), int(chunk[i])
            if held and here != at:
                yield row()
                held = []
            at = here
            held.append((key[i:j], n[i:j]))
    if held:
        yield row()


def _cells(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """member, place in the chunk, count."""
    k = int.from_bytes(packed[:4], "little")
    key = unvarint(packed[4 : 4 + k]).astype(np.int64)
    return key >> 16, key & 0xFFFF, unvarint(packed[4 + k :]).astype(np.int64)


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a tile's slab.  Sorted rows: the one or two blocks' heads, then chunk by chunk what its blocks have."""
    at, heads, sums, v, empty = None, [], None, 0, None
    chunk, waiting = None, {}

    def add() -> None:
        nonlocal sums
        cells = {b: _cells(c) for b, c in waiting.items()}
        seen = np.unique(np.concatenate([c[1] for c in cells.values()]))
        p = {}
        for block, totals in heads:
            n = np.zeros((len(totals), len(seen)), np.int64)
            if block in cells:
                member, place, count = cells[block]
                n[member, np.searchsorted(seen, place)] = count
            p[block] = shares(n, totals[:, None], v)
        left, right = p[at[1]], p[at[2]]
        for a in range(len(left)):
            sums[a] += np.abs(left[a][None] - right).sum(1) - len(seen) * empty[a]

    def done() -> pa.RecordBatch:
        value = sums + v * empty if at[3] == 0 else sums
        a, b = np.triu_indices(len(value), 1) if at[1] == at[2] else np.indices(value.shape).reshape(2, -1)
        k = len(a)
        columns = [pa.array([at[0]] * k, pa.string()), pa.array([at[1]] * k, pa.int64()), pa.array(a.astype(np.int32)), pa.array([at[2]] * k, pa.int64()), pa.array(b.astype(np.int32)), pa.array(value[a, b], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "i", "a", "j", "b", "value"])

    for batch in batches:
        for x in (y for k in range(batch.num_rows) for y in batch.slice(k, 1).to_pylist()):
            here = x["lang"], x["i"], x["j"], x["slab"]
            if waiting and (here != at or x["chunk"] != chunk):
                add()
                waiting = {}
            if here != at:
                if at is not None:
                    yield done()
                at, heads = here, []
            if x["chunk"] < 0:
                heads.append((x["block"], np.array(x["totals"], np.int64)))
                v = x["v"]
                left, right = heads[0][1], heads[-1][1]
                none = [shares(np.zeros(len(t), np.int64), t, v) if v else np.zeros(len(t), np.int64) for t in (left, right)]
                empty = np.abs(none[0][:, None] - none[1][None])
                sums = np.zeros_like(empty)
            else:
                chunk, waiting[x["block"]] = x["chunk"], x["cells"]
    if waiting:
        add()
    if at is not None:
        yield done()


def _words(held: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Part term: the window's limit cuts every partition before rows move."""
    rows = held.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"]).filter("n > 0")
    value = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), value.alias("value")).filter("value > 0")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT o.lang, source, term, count(*)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS m FROM k GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS m FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.m + 5 * s.v) AS p, 1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (s.m + 5 * s.v) AS q
      FROM t JOIN s USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pair AS (SELECT x.lang, x.source, y.source AS item, (SELECT coalesce(sum(abs(a.p - b.p)), 0) FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term WHERE a.lang = x.lang AND a.source = x.source AND b.source = y.source) AS value
         FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pair
           UNION ALL SELECT * FROM (SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, encode(term)) AS rank FROM p WHERE n > 0 AND p > q) WHERE rank <= 50)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
"""
