"""Token counts by trie-shared dynamic programming.

Pre-tokens are runs of non-space characters, each with the word mark in front.
The distinct pre-tokens of the whole table are counted by the number of pieces of
text that they stand in; those of the most pieces, ``held`` of them at most, are
dealt by range and inserted into a trie in sorted order, so that only the path at
hand is held: the best unigram score of every prefix, and its number of tokens, is
computed once where prefixes are shared.  The terminals' counts are stored, and
every worker gets them (some bytes for each of ``held`` pre-tokens).  A piece looks its
pre-tokens up; what is not stored, rare by definition, goes through a trie of the
piece's own.  No text is shuffled, and a common pre-token is scored once.

Null or empty text: no tokens, score 0.  Characters without a piece: their UTF-8
bytes, one token each.  Ties in score: fewer tokens.  Repeated rows: each is
counted.  Very long texts: whole, a piece by themselves; a very long pre-token takes
some bytes for each of its characters.  No rows: no rows.  Other columns are kept,
or ignored where keep leaves them out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import text as tx
from quillon.llm.common import append, checkpoint, partitions, release

MARK = "▁"


def vocabulary(path: str) -> tuple[dict[str, float], float]:
    """(log probability of each piece, of a byte) from a sentencepiece file.

    The file ranks its pieces but has no probabilities; a piece's is taken from its
    rank by Zipf's law.  Control pieces and bytes are left out; a byte has the
    probability of the last rank.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1.0 / (r + 1) for r in range(len(pieces) + 1)))
    scores: dict[str, float] = {}
    for r, p in enumerate(pieces):
        scores.setdefault(p, -math.log(r + 1) - total)
    return scores, -math.log(len(pieces) + 1) - total


def forward(words: list[str], scores: dict[str, float], byte: float) -> tuple[list[float], list[int]]:
    """Best score and number of tokens of each of the sorted words."""
    longest = max(map(len, scores), default=0)
    get = scores.get
    best, count = [0.0], [0]  # of each prefix of the path
    out_s, out_n, before = [], [], ""
    for w in words:
        d, most = 0, min(len(w), len(before))
        while d < most and w[d] == before[d]:
            d += 1
        del best[d + 1 :], count[d + 1 :]
        for i in range(d + 1, len(w) + 1):
            s, n = -math.inf, 0
            for j in range(max(0, i - longest), i):
                p = get(w[j:i])
                if p is not None:
                    c = best[j] + p
                    if c > s or (c == s and count[j] + 1 < n):
                        s, n = c, count[j] + 1
            if w[i - 1] not in scores:
                k = len(w[i - 1].encode())
                c = best[i - 1] + k * byte
                if c > s or (c == s and count[i - 1] + k < n):
                    s, n = c, count[i - 1] + k
            best.append(s)
            count.append(n)
        out_s.append(best[-1])
        out_n.append(count[-1])
        before = w
    return out_s, out_n


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _marked(w: tx.Words, which: np.ndarray) -> list[str]:
    """The pre-tokens at the places which, with their mark."""
    raw = w.data.tobytes()
    return [MARK + raw[i:j].decode() for i, j in zip(w.start[which].tolist(), w.end[which].tolist(), strict=True)]


def _spaced(texts: pa.Array) -> tx.Words:
    """Pre-tokens as they stand, not lower-cased."""
    return tx.words(texts)._replace(data=tx.buffer(texts)[0])


def score_words(words: list[str], scores: dict[str, float], byte: float) -> tuple[np.ndarray, np.ndarray]:
    """forward() of words in any order."""
    order = sorted(range(len(words)), key=words.__getitem__)
    score, number = np.zeros(len(words)), np.zeros(len(words), np.int64)
    score[order], number[order] = forward([words[i] for i in order], scores, byte)
    return score, number


def distinct_words(docs: DataFrame) -> DataFrame:
    """word (with its mark), pieces: the number of pieces of text that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch, "text", 4 * tx.PIECE):
                w = _spaced(piece.column("text"))
                words = _marked(w, np.unique(tx.word_hashes(w), return_index=True)[1])
                for at in range(0, len(words), 20_000):
                    part = words[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.ones(len(part), np.int64))], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("pieces"))


def terminals(docs: DataFrame, shared, held: int) -> pa.Table:
    """word, n_tokens, score of the pre-tokens in the most pieces (two at least), as many whole classes of equal numbers as held has room for."""
    counted = checkpoint(distinct_words(docs).filter("pieces > 1"))
    least, room = 1 << 62, held
    for r in counted.groupBy("pieces").agg(F.count("*").alias("n")).orderBy(F.desc("pieces")).toLocalIterator():
        room -= r.n
        if room < 0:
            break
        least = r.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for batch in batches for w in batch.column("word").to_pylist()]  # in order, held of them at most
        score, number = score_words(words, *shared.value)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(number), pa.array(score)], names=["word", "n_tokens", "score"])

    dealt = counted.filter(F.col("pieces") >= least).select("word").repartitionByRange(partitions(docs), "word").sortWithinPartitions("word")
    stored = checkpoint(dealt.mapInArrow(run, "word string, n_tokens long, score double"))
    release(counted)
    return stored.toArrow()


def count_tokens(docs: DataFrame, path: str | None = None, keep: list[str] | None = None, held: int = 200_000) -> DataFrame:
    """The columns keep of docs (all: None), n_pretokens, n_tokens, score (of the best segmentation, log).

    held: so many pre-tokens' counts are stored and broadcast; results do not depend on it.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(vocabulary(path or default_path()))  # one vocabulary
    table = terminals(docs, shared, held)
    names = _spaced(pa.concat_arrays([c.cast(pa.string()) for c in table.column("word").chunks] or [pa.array([], pa.string())]))
    keys = tx.spans_hash(names.data, names.offsets[:-1] + len(MARK.encode()), names.offsets[1:])  # of the words without their mark
    order = np.argsort(keys)
    known = sc.broadcast((keys[order], table.column("n_tokens").to_numpy()[order], table.column("score").to_numpy()[order]))  # held of them at most

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column("text")
        w = _spaced(texts)
        u, first, inv = np.unique(tx.word_hashes(w), return_index=True, return_inverse=True)
        table, n, s = known.value
        at = np.minimum(np.searchsorted(table, u), max(len(table) - 1, 0))
        there = table[at] == u if len(table) else np.zeros(len(u), bool)
        score, number = np.zeros(len(u)), np.zeros(len(u), np.int64)
        score[there], number[there] = s[at[there]], n[at[there]]
        rest = np.flatnonzero(~there)
        score[rest], number[rest] = score_words(_marked(w, first[rest]), *shared.value)
        a = np.concatenate((np.zeros(1, np.int64), np.cumsum(number[inv])))
        f = w.first
        # per text, so that a sum does not depend on the texts before it
        sums = np.zeros(len(texts))
        full = np.flatnonzero(np.diff(f) > 0)
        if len(full):
            sums[full] = np.add.reduceat(score[inv], f[full])
        return [pa.array(np.diff(f).astype(np.int64)), pa.array(a[f[1:]] - a[f[:-1]]), pa.array(sums)]

    return append(docs, "n_pretokens long, n_tokens long, score double", make, docs.columns if keep is None else keep)
