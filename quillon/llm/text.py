"""Vectorised tokenising and hashing of Arrow string columns.

All functions work on whole texts: an Arrow array's byte buffer is classified
and hashed with numpy in one sweep, so the cost is a few nanoseconds a byte and
no Python object is made for a word.  Null texts have no words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes that end a word: space and \t \n \v \f \r.
SPACES = np.ones(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
# Bytes of alphanumeric words, after A-Z were lower-cased: 0-9, a-z and all of non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEED = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64)
PIECE = 1 << 20  # bytes of text that are worked on at once, as far as texts are shorter
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    """At least n powers of base; tables of more than two pieces are not kept."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * PIECE) if n > PIECE else 1 << max(16, int(n - 1).bit_length()), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 2 * PIECE:
            _powers[name] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offs, data = texts.buffers()
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


class Words(NamedTuple):
    data: np.ndarray  # lower-cased bytes
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # first word of each text, and one past the last text's
    offsets: np.ndarray  # of each text in data


def words(texts: pa.Array, inside: np.ndarray = SPACES) -> Words:
    data, offs = buffer(texts)
    data = LOWER[data]
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return Words(data, e, e, np.zeros(len(offs), np.int64), offs)
    isin = inside[data]
    begins = isin.copy()
    begins[1:] &= ~isin[:-1]
    heads = offs[:-1][offs[:-1] < n]
    begins[heads] = isin[heads]
    ends = isin.copy()
    ends[:-1] &= ~isin[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    ends[tails] = isin[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offs), offs)


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans; long data is gone through by pieces."""
    n = len(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    if n > 2 * PIECE and int(start.max()) >= PIECE:
        out = np.empty(len(start), np.uint64)
        piece = start // PIECE
        for p in np.unique(piece):
            of = np.flatnonzero(piece == p)
            a, b = int(start[of].min()), int(end[of].max())
            out[of] = spans_hash(data[a:b], start[of] - a, end[of] - a)
        return out
    inv, pw = _power_table("inv", _INVERSE, n + 1), _power_table("pw", _BASE, n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(_SEED[data] * inv[:n], out=s[1:])
    return mix((s[end] - s[start]) * pw[end] + (end - start).astype(np.uint64))


def word_hashes(w: Words) -> np.ndarray:
    return spans_hash(w.data, w.start, w.end)


def slices(batch: pa.RecordBatch, column: str, limit: int = PIECE):
    """Cuts a batch so that a piece has about limit bytes of text, one row at least: bounded memory for very long texts."""
    a = batch.column(column)
    lens = np.asarray(pc.fill_null(pc.binary_length(a), 0)).astype(np.int64)
    at, n = 0, batch.num_rows
    total = np.cumsum(lens)
    while at < n:
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and the text of each; a text of fewer words, but not none, has its whole sequence as one."""
    n = np.diff(first)
    out = np.zeros(len(h), np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    m = len(h) - k + 1
    if m > 0:
        acc = np.zeros(m, np.uint64)
        for j in range(k):
            acc = acc * step + h[j : j + m]
        out[:m] = mix(acc)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(h)) - first[doc]
    keep = at + k <= n[doc]
    short = np.flatnonzero((n > 0) & (n < k))
    for d in short:
        acc = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in h[first[d] : first[d + 1]]:
                acc = acc * step + x
            out[first[d]] = mix(np.array([acc + np.uint64(n[d])]))[0]
        keep[first[d]] = True
    return out[keep], doc[keep]
