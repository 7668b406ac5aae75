"""Katz backoff language model of any order: Good-Turing discounted n-gram counts, counted and evaluated in partitioned tables.

P(w | h) = d_r r / den(h)          for an n-gram seen r times in training,
           alpha(h) P(w | h')      otherwise, h' being h without its first word;
                                   alpha(h) = 1 where h is unseen,
P(w)     = d_c c / N               for a word seen c times, and the mass that the
                                   discounts leave (if none, of one event more),
                                   for all unseen words together.
den(h) is c(h), and one more where no word after h was seen 1 to k times, so that
the discounts leave no mass.  alpha(h) is exactly
(1 - sum over seen P(w | h)) / (1 - sum over seen P(w | h')).  Each order has its own
discounts.  A text is its words (A-Z lower-cased) and an end; before it stand begins.

How it runs: texts are cut into blocks of some MB; a block knows its distinct
words once and the rest as indexes into them.  Words go to partitions by hash,
where they are counted, and blocks get the counts and small ids back.  Then one
loop over the orders: a block numbers its distinct n-grams (an n-gram is the number
of its context, which is one of the order before, and that of its last word, so one
sort of plain numbers finds them) and sends them to partitions by
context (those of hot contexts by n-gram, so no partition gets a hot context alone),
with the count of the n-gram without its first word.  All of a context's n-grams
meet there; the block gets back how often each was seen in training, and of
contexts after which it has an unseen word the sums that make alpha.  An n-gram
whose context was never seen is not sent.  At last each block evaluates the
recursion for all its tokens, order upon order.  Words are identified by 64-bit
hashes, contexts by hashes of their words' ids, n-grams by both.

Tables of earlier orders are written once and read again for each later one, so disk
grows with the distinct n-grams of one order at a time.

Null and empty texts: the end alone.  No training texts: every word is unseen and
has probability 1, score 0.  Null training marks: not learned from.  Repeated rows:
each is learned from and scored.  Null ids: rows like others.  Very long texts:
whole; a block holds one at least.  No rows: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import text as tx
from quillon.llm.common import bundle, checkpoint, integers, numbers, partitions, planes, release, runs, unbundle

END = np.uint64(1)  # hash of the end
UNSEEN, BEGIN, IDS = 0, 1, 2  # ids: of all unseen words, of the begin, and the first of words
ROOM = 63  # bits in which an n-gram's numbers and its place are sorted as one number
HOT = 2000  # contexts with 1/HOT of all tokens are dealt by whole n-grams; there are HOT at most


def discounts(n: np.ndarray, k: int) -> np.ndarray:
    """d_1 to d_k from n_1 to n_(k+1) by Good-Turing as Katz renormalises it; where counts are too few or not falling, with a smaller k, and half a count off above it.  All are under 1."""
    half = 1 - 0.5 / np.arange(1, k + 1)
    for m in range(k, 0, -1):
        if (n[: m + 1] > 0).all():
            r = np.arange(1, m + 1)
            tail = (m + 1) * n[m] / n[0]
            if tail < 1:
                d = ((r + 1) * n[1 : m + 1] / n[:m] / r - tail) / (1 - tail)
                if (d > 0).all() and (d < 1).all():
                    return np.concatenate((d, half[m:]))
    return half


def discounted(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Counts less their discounts."""
    return np.append(np.append(1.0, d), 1.0)[np.minimum(c, len(d) + 1)] * c


class Unigram:
    def __init__(self, total: int, kinds: int, n: np.ndarray, k: int):
        self.total, self.kinds, self.d = total, kinds, discounts(n, k)
        r = np.arange(1, k + 1)
        left = float(((1 - self.d) * r * n[:k]).sum())
        self.den = total if left else total + 1  # one unseen event where the discounts leave no mass
        self.unseen = (left or 1.0) / self.den if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        if not self.total:
            return np.ones(len(c))
        return np.where(c > 0, discounted(self.d, c) / self.den, self.unseen)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c.astype(np.float64) + 1) / (self.total + self.kinds + 1))


KINDS = "block long, level int, part int, ids array<long>, a binary, b binary"
NAMES = [x.split()[0] for x in KINDS.split(", ")]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (block, level, part, ids, up to two bundles) as a batch of KINDS."""
    cols = list(zip(*((*r, *[None] * (len(NAMES) - len(r))) for r in rows), strict=True)) or [()] * len(NAMES)
    types = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=NAMES)


def _blocks(docs: DataFrame, block_bytes: int, parts: int) -> DataFrame:
    """A row of level 0 for each block: ids, training marks, lengths, words by rank, the ranks' indexes, distinct words (by part, then hash) and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in tx.slices(batch, "text", block_bytes):
                w = tx.words(piece.column("text"))
                h = tx.word_hashes(w)
                n = np.diff(w.first)
                ends = np.cumsum(n + 1) - 1  # places of the end tokens
                toks = np.empty(len(h) + len(n), np.uint64)
                at = np.ones(len(toks), bool)
                at[ends] = False
                toks[at], toks[ends] = h, END
                by, new = ordered(toks, toks)
                inv = np.empty(len(toks), np.int64)
                inv[by] = np.cumsum(new) - 1
                u = toks[by[new]]
                order, _ = dealt((u % np.uint64(parts)).astype(np.int64), parts)
                train = np.asarray(piece.column("train")).astype(bool)
                seen = np.bincount(inv[np.repeat(train, n + 1)], minlength=len(u))
                often = np.argsort(-np.bincount(inv, minlength=len(u))[order], kind="stable")  # tokens are stored by rank: small numbers compress well
                rank = np.empty(len(u), np.int64)
                rank[order[often]] = np.arange(len(u))
                yield _table([((task << 32) | number, 0, None, piece.column("doc_id").to_pylist(), bundle(*map(planes, (train, n + 1, rank[inv], often))), bundle(planes(u[order]), planes(seen[order])))])
                number += 1

    return docs.mapInArrow(run, KINDS)


def _count_words(blocks: DataFrame, parts: int, k: int) -> DataFrame:
    """Rows of level 1, for each block and part the training counts and ids of its words, and for each part a row (block null) of its totals.

    Ids are small for frequent words: a word's rank by count within its part, times parts, plus the part.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held in zip(*(batch.column(c).to_pylist() for c in ("block", "b")), strict=True):
                u, seen = unbundle(held)
                cut = np.searchsorted((numbers([u]) % np.uint64(parts)).astype(np.int64), np.arange(parts + 1)).tolist()
                yield _table([(block, 1, p, None, bundle(u[:, i:j], seen[:, i:j])) for p, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in runs(batches, "part"):
            words, seen = zip(*(unbundle(r["a"]) for r in rows), strict=True)
            u, inv = np.unique(numbers(words), return_inverse=True)
            c = np.bincount(inv, weights=integers(seen)).astype(np.int64)
            total, cut = int(c.sum()), np.cumsum([0, *(x.shape[1] for x in words)])
            ids = np.empty(len(u), np.int64)
            ids[np.lexsort((u, -c))] = np.arange(len(u))
            ids = np.where(c > 0, ids * parts + part + IDS, UNSEEN)
            told = planes(c[inv]), planes(ids[inv])
            out = [(r["block"], 1, part, None, bundle(*(x[:, i:j] for x in told))) for r, i, j in zip(rows, cut[:-1], cut[1:], strict=True)]
            n = np.bincount(np.minimum(c, k + 2), minlength=k + 3)[1 : k + 2]
            hot = np.flatnonzero((c * HOT >= max(total, 1)) & (c > 0))
            stats = np.concatenate(([total, int((c > 0).sum()), int(c[u == END].sum())], n, ids[hot], c[hot])).astype(np.int64)
            yield _table([*out, (None, 1, part, None, bundle(planes(stats)))])

    sent = blocks.select("block", "b").mapInArrow(deal, KINDS)
    return sent.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(count, KINDS)


def chain(columns: list[np.ndarray], h: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the words (ids, first to last) of many contexts; h: of the words before them."""
    if h is None:
        h = np.full(len(columns[0]), 0x2545F4914F6CDD1D, np.uint64)
    for c in columns:
        h = tx.mix(h * np.uint64(0xD6E8FEB86659FD93) + c.astype(np.uint64) + np.uint64(1))
    return h


def among(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether hashes are in the sorted table of hashes, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    far = np.uint64(48)
    start = np.searchsorted((table >> far).astype(np.int64), np.arange((1 << 16) + 1))  # by the upper bits
    at = np.minimum(start[(values >> far).astype(np.int64)], len(table) - 1)
    for _ in range(int(np.diff(start).max()) - 1):
        at = np.minimum(at + (table[at] < values), len(table) - 1)
    return table[at] == values, at


def sorted_places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by all but their lower bits, which must have room for the places; the keys so ordered, shifted."""
    s = key >> np.uint64(bits) << np.uint64(bits) | np.arange(len(key), dtype=np.uint64)
    s.sort()  # of plain numbers: several times faster than an argsort
    return (s & np.uint64((1 << bits) - 1)).view(np.int64), s >> np.uint64(bits)


def ordered(key: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams by key, and by word where keys of different words are equal; where a new one begins."""
    by, top = sorted_places(key, len(key).bit_length())
    new = np.ones(len(by), bool)
    new[1:] = top[1:] != top[:-1]
    same = np.flatnonzero(~new)
    differ = same[(word[by[same]] != word[by[same - 1]]) | (key[by[same]] != key[by[same - 1]])]
    if len(differ):  # stretches of equal upper bits that hold different n-grams
        stretch = np.cumsum(new) - 1
        mixed = np.zeros(stretch[-1] + 1, bool)
        mixed[stretch[differ]] = True
        at = np.flatnonzero(mixed[stretch])
        them = by[at]
        by[at] = them[np.lexsort((word[them], key[them], stretch[at]))]
        at = at[1:]
        new[at] |= (word[by[at]] != word[by[at - 1]]) | (key[by[at]] != key[by[at - 1]])
    return by, new


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def dealt(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by part, otherwise as they stand, and where each part begins."""
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")  # small numbers are sorted by radix
    return order, np.append(0, np.cumsum(np.bincount(part, minlength=parts)))


class Order(NamedTuple):
    """What is known of the n-grams of one order, and small: discounts and hot contexts (at most HOT)."""

    d: np.ndarray
    hot: np.ndarray  # sorted hashes of the contexts that are dealt by whole n-grams
    seen: np.ndarray  # of each, how many n-grams were seen 1 to k times
    mass: np.ndarray  # and the sum over its seen words of lower counts, discounted


class Texts:
    """The tokens of one block: words, and the counts of the n-grams that end at each, order by order.

    Words are numbered within the block, and so are the n-grams of an order: the
    number of the one that ends before a token is its context in the next order.
    """

    def __init__(self, rows: list[dict], uni: Unigram, texts: int):
        first = next(r for r in rows if r["level"] == 0)
        train, n, rank, often = (integers([x]) for x in unbundle(first["a"]))
        self.ids, self.train, self.n = first["ids"], train.astype(bool), n
        told = zip(*(unbundle(r["a"]) for r in rows if r["level"] == 1), strict=True)
        count, self.name = (integers(x)[often] for x in told)  # of words by rank
        unseen = np.flatnonzero(count == 0)
        one = np.arange(len(count))
        one[unseen] = unseen[:1]  # unseen words are one
        self.word, self.count = one[rank], count[rank]
        self.found, self.base, self.p = (x[rank] for x in (count > 0, uni.base(count), np.log10(uni.p(count))))
        self.start = np.cumsum(n) - n
        self.den = np.full(len(rank), uni.den)
        self.texts = texts
        self.of = self.word  # the n-gram that ends at each token
        self.hash = chain([self.name])  # of the words of each n-gram

    def climb(self, order: int, hot: np.ndarray, parts: int) -> None:
        """Finds the distinct n-grams of an order whose contexts were seen, by part and context."""
        hashes = np.append(self.hash, chain([np.array([BEGIN])] * (order - 1)))
        context, self.before = np.empty_like(self.of), np.empty_like(self.count)
        context[1:], self.before[1:] = self.of[:-1], self.count[:-1]
        context[self.start], self.before[self.start] = len(hashes) - 1, self.texts  # the context's count
        self.at = at = np.flatnonzero(self.before > 0)
        wide, bits = len(self.name).bit_length(), len(at).bit_length()
        key = context[at] << wide | self.word[at]
        if len(hashes).bit_length() + wide + bits <= ROOM:
            by, key = sorted_places(key.view(np.uint64) << np.uint64(bits), bits)
            key = key.view(np.int64)
        else:
            by = np.argsort(key)
            key = key[by]
        new = np.ones(len(by), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        key = key[first]
        part = part_of(hashes, parts)
        part[among(hot, hashes)[0]] = -1
        part = part[key >> wide]
        spread = np.flatnonzero(part < 0)  # n-grams of hot contexts are dealt one by one
        part[spread] = part_of(tx.mix(hashes[key[spread] >> wide] * np.uint64(3) + self.name[key[spread] & ((1 << wide) - 1)].astype(np.uint64)), parts)
        turn, self.cut = dealt(part, parts)
        place = np.empty(len(turn), np.int64)
        place[turn] = np.arange(len(turn))
        self.gram = np.empty(len(by), np.int64)  # of the tokens at
        self.gram[by] = place[np.cumsum(new) - 1]
        self.of = np.zeros(len(self.of), np.int64)
        self.of[at] = self.gram
        key = key[turn]
        self.context, self.last, self.lower = key >> wide, key & ((1 << wide) - 1), hashes  # of each n-gram: its context, and its last word; the contexts' hashes
        self.edge = np.ones(len(key), bool)  # where another context begins
        self.edge[1:] = self.context[1:] != self.context[:-1]
        self.edge[self.cut[self.cut < len(key)]] = True

    def rise(self) -> None:
        """The n-grams become contexts."""
        self.hash = chain([self.name[self.last]], self.lower[self.context])

    def messages(self, block: int, order: int) -> Iterator[tuple]:
        """To each part: its contexts' words, how many words follow each, those words, their lower counts and training counts."""
        lead = np.empty(len(self.last), np.int64)
        lead[self.gram] = self.at  # a token of each n-gram
        seen = np.bincount(self.gram[np.repeat(self.train, self.n)[self.at]], minlength=len(lead))
        head = np.flatnonzero(self.edge)
        at, place = lead[head], np.arange(len(self.word)) - np.repeat(self.start, self.n)
        words = (np.where(place[at] >= j, self.name[self.word[at - j]], BEGIN) for j in range(order - 1, 0, -1))
        contexts = [planes(c) for c in (*words, np.diff(np.append(head, len(lead))))]
        grams = [planes(x) for x in (self.name[self.last], self.count[lead], seen)]
        cut, head_cut = self.cut.tolist(), np.searchsorted(head, self.cut).tolist()
        for p in np.flatnonzero(np.diff(self.cut)).tolist():
            yield block, order, p, None, bundle(*(c[:, head_cut[p] : head_cut[p + 1]] for c in contexts), *(g[:, cut[p] : cut[p + 1]] for g in grams))

    def take(self, rows: list[dict], known: Order, k: int, weigh: bool) -> None:
        """Takes the parts' answers for the n-grams found; weigh: p, too, goes up to this order, by the backoff weight where a token's n-gram was not seen but its context was."""
        tokens = len(self.word)
        rows = sorted(rows, key=lambda r: r["part"])
        answers = list(zip(*(unbundle(r["a"]) for r in rows), strict=True)) or [[]] * 5
        r = integers(answers[0])
        lower, self.count, self.den = self.den, np.zeros(tokens, np.int64), self.before
        self.count[self.at] = r[self.gram]
        if not weigh:
            return
        spare = (1 - known.d) * np.arange(1, k + 1)
        head = np.flatnonzero(self.edge)
        extra, told = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)  # of contexts; told: which of those with an unseen word
        m = np.concatenate([np.zeros((1, k)), known.seen, integers(answers[3]).reshape(-1, k)])
        mass = np.concatenate([np.zeros(1), known.mass, numbers(answers[4]).view(np.float64)])
        if len(known.hot):
            is_hot, where = among(known.hot, self.lower[self.context[head]])
            told[is_hot] = where[is_hot] + 1
            extra[is_hot] = ~known.seen[where[is_hot]].astype(bool).any(1)
        lead = np.searchsorted(head, self.cut[[row["part"] for row in rows]])
        more, which = (np.repeat(lead, np.array([x.shape[1] for x in a], np.int64)) + integers(a) for a in answers[1:3])
        extra[more] = 1
        told[which] = 1 + len(known.hot) + np.arange(len(which))
        if extra.any():
            self.den = self.before.copy()
            self.den[self.at] += extra[np.cumsum(self.edge) - 1][self.gram]
        seen, t = np.flatnonzero(self.count), self.at[r[self.gram] == 0]
        g = told[np.searchsorted(head, self.of[t], side="right") - 1]
        den = self.den[t]
        self.p[t] += np.log10((den - self.before[t] + m[g] @ spare) / den / (1 - mass[g] / lower[t]))
        self.p[seen] = np.log10(discounted(known.d, self.count[seen]) / self.den[seen])


def _ngrams(blocks: DataFrame, order: int, uni: Unigram, texts: int, known: list[Order], hot: np.ndarray, parts: list[int], k: int) -> DataFrame:
    """Counts the n-grams of one order: answers for each block and part, and rows (block null) of totals.

    blocks: rows of all lower orders.  An answer has the training count of each
    n-gram, the contexts with one event more, and for contexts with an unseen word
    the number of words seen 1 to k times and the sum of their discounted lower
    counts.
    """
    below = known[-1].d if known else uni.d

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in runs(batches, "block"):
            t = _climbed(rows, uni, texts, known, parts, k, False)
            if known:
                t.rise()
            t.climb(order, hot, parts[-1])
            yield _table(list(t.messages(block, order)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in runs(batches, "part"):
            held = list(zip(*(unbundle(r["a"]) for r in rows), strict=True))
            columns = [integers(x) for x in held[: order - 1]]
            follow, word, lower, seen = (integers(x) for x in held[order - 1 :])
            start = np.cumsum(follow) - follow  # first n-gram of each context of each block
            heads = chain(columns)
            by, new = ordered(heads, heads)
            own, names = np.empty(len(heads), np.int64), heads[by[new]]
            own[by] = np.cumsum(new) - 1
            left = 64 - len(names).bit_length()
            context = np.repeat(own, follow)
            by, new = ordered(context.view(np.uint64) << np.uint64(left) | tx.mix(word.view(np.uint64)) >> np.uint64(64 - left), word)
            at = np.flatnonzero(new)
            lead = by[at]
            r, low, ctx = np.add.reduceat(seen[by], at), lower[lead], context[lead]  # of distinct n-grams
            some = r > 0
            few = some & (r <= k)
            m = np.bincount(ctx[few] * k + r[few] - 1, minlength=len(names) * k).reshape(-1, k)
            mass = np.bincount(ctx[some], weights=discounted(below, low[some]), minlength=len(names))
            is_hot, where = among(hot, names)
            extra = ~m.any(1) & ~is_hot
            mine = np.empty(len(by), np.int64)
            mine[by] = r[np.cumsum(new) - 1]
            more = np.flatnonzero(extra[own])
            which = np.flatnonzero((np.add.reduceat(mine == 0, start, dtype=np.int64) > 0) & ~is_hot[own])
            # of each block: its n-grams, contexts, those with one event more, and those with an unseen word
            ends = [np.cumsum([0, *(x.shape[1] for x in held[i])]) for i in (order, 0)]
            ends += [np.searchsorted(x, ends[1]) for x in (more, which)]
            first = np.repeat(ends[1][:-1], np.diff(ends[1]))
            told = [planes(x) for x in (mine, more - first[more], which - first[which], m[own[which]].ravel(), mass[own[which]])]
            out = [
                (row["block"], order, part, None, bundle(*(x[:, n * e[i] : n * e[i + 1]] for x, e, n in zip(told, (ends[0], ends[2], ends[3], ends[3], ends[3]), (1, 1, 1, k, 1), strict=True))))
                for i, row in enumerate(rows)
            ]
            n = np.bincount(np.minimum(r, k + 2), minlength=k + 3)[1 : k + 2]
            spread = np.flatnonzero(is_hot)
            often = lead[(r * HOT >= max(uni.total, 1)) & some]
            of = np.searchsorted(start, often, side="right") - 1
            deeper = chain([*(c[of] for c in columns), word[often]])
            yield _table([*out, (None, order, part, None, bundle(*map(planes, (n, where[spread], m[spread].ravel(), mass[spread]))), bundle(planes(deeper)))])

    near = blocks.repartition(partitions(blocks), "block").sortWithinPartitions("block", "level", "part").mapInArrow(send, KINDS).select("block", "part", "a")
    return near.repartition(parts[-1], "part").sortWithinPartitions("part", "block").mapInArrow(count, KINDS)


def _climbed(rows: list[dict], uni: Unigram, texts: int, known: list[Order], parts: list[int], k: int, weigh: bool) -> Texts:
    """A block's tokens with what all counted orders say of them; weigh: their log10 probabilities as well."""
    t = Texts(rows, uni, texts)
    for order, (o, p) in enumerate(zip(known, parts, strict=False), 2):
        if order > 2:
            t.rise()
        t.climb(order, o.hot, p)
        t.take([r for r in rows if r["level"] == order], o, k, weigh)
    return t


def _totals(answers: DataFrame, hot: np.ndarray, k: int) -> tuple[Order, np.ndarray]:
    """What the parts' totals add up to, and the hot contexts of the next order.  Sums are made by the executors; k + 1 numbers for each hot context come back."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sums in batch.column("a").to_pylist():
                n, at, m, mass = unbundle(sums)
                at = integers([at])
                where = np.concatenate((np.full(k + 1, -1), np.repeat(at, k), at))
                which = np.concatenate((np.arange(k + 1), np.tile(np.arange(k), len(at)), np.full(len(at), k)))
                value = np.concatenate((integers([n]), integers([m]), numbers([mass]).view(np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(which), pa.array(value)], names=["at", "which", "value"])

    totals = answers.filter("block is null")
    n, seen, mass = np.zeros(k + 1, np.int64), np.zeros((len(hot), k)), np.zeros(len(hot))
    for r in totals.select("a").mapInArrow(spread, "at long, which long, value double").groupBy("at", "which").agg(F.sum("value").alias("value")).collect():
        if r["at"] < 0:
            n[r.which] = int(r.value)
        elif r.which < k:
            seen[r["at"], r.which] = r.value
        else:
            mass[r["at"]] = r.value
    deeper = [numbers(unbundle(r.b)) for r in totals.select("b").toLocalIterator()]  # HOT of them at most, over all parts
    return Order(discounts(n, k), hot, seen, mass), np.unique(np.concatenate([np.zeros(0, np.uint64), *deeper]))


def score(docs: DataFrame, order: int = 3, k: int = 5, block_bytes: int = 4 << 20, tokens_a_part: int = 1_000_000) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id long, text, train boolean: learn from it)."""
    docs = docs.select("doc_id", "text", F.coalesce("train", F.lit(False)).alias("train"))
    word_parts = partitions(docs)
    blocks = checkpoint(_blocks(docs, block_bytes, word_parts))
    counts = checkpoint(_count_words(blocks, word_parts, k))
    stats = [integers(unbundle(r.a)) for r in counts.filter("block is null").select("a").toLocalIterator()]
    total, kinds, texts = (sum(int(s[i]) for s in stats) for i in range(3))  # as many texts begin as end
    uni = Unigram(total, kinds, sum((s[3 : k + 4] for s in stats), np.zeros(k + 1, np.int64)), k)
    often = np.concatenate([np.zeros((2, 0), np.int64), *(s[k + 4 :].reshape(2, -1) for s in stats)], 1)
    hot = chain([np.append(often[0][often[1] * HOT >= max(total, 1)], BEGIN)])
    begins = [chain([np.array([BEGIN])] * n) for n in range(2, order)]  # of higher orders

    tokens = checkpoint(blocks.withColumn("b", F.lit(None).cast("binary")))
    release(blocks)  # what only the words' counts needed goes
    rows = tokens.union(counts.filter("block is not null"))
    known: list[Order] = []
    parts: list[int] = []
    for level in range(2, order + 1):
        parts.append(max(word_parts, -(-total // tokens_a_part)))
        hot = np.sort(hot)
        answers = checkpoint(_ngrams(rows, level, uni, texts, known, hot, parts, k))
        o, deeper = _totals(answers, hot, k)
        known.append(o)
        rows = rows.union(answers.filter("block is not null"))
        hot = np.concatenate([deeper, *begins[level - 2 : level - 1]])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in runs(batches, "block"):
            t = _climbed(held, uni, texts, known, parts, k, True)
            doc = np.repeat(np.arange(len(t.n)), t.n)
            known_, *sums = (np.bincount(doc, weights=x, minlength=len(t.n)) for x in (t.found, t.base, t.p))
            yield pa.RecordBatch.from_arrays([pa.array(t.ids, pa.int64()), pa.array(t.train), pa.array(t.n), pa.array(known_.astype(np.int64)), pa.array(np.full(len(t.n), total, np.int64)), *map(pa.array, sums)], names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = rows.repartition(partitions(docs), "block").sortWithinPartitions("block", "level", "part")
    return both.mapInArrow(finish, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
