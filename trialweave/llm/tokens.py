"""Vectorised tokenising and hashing of Arrow text columns.

Every operator of this subpackage that looks at words reads them through :func:`tokenize`: the UTF-8
buffer of an Arrow string column is classified byte by byte with a lookup table, word boundaries are
found with one vector comparison, and each word gets a 64-bit hash from a prefix sum, so the cost is
a few nanoseconds a byte and no Python object exists per word. Texts are never cut: long buffers are
hashed in blocks of whole words, which bounds the temporary arrays.

Words are compared by 64-bit hash. Two different words (or n-grams) collide with a chance of 2**-64
a pair, which is the only way a result of these operators could differ from a comparison of strings.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_BLOCK = 1 << 20
#: Text bytes that one call of :func:`tokenize` should get, unless a single text is longer.
CHUNK_BYTES = 512 << 10

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1B54A32D192ED03 | 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: True for the bytes of a word. "space": all but 0x20 and 0x09-0x0D. "alnum": ASCII digits and
#: lower-case letters, and every byte of a character beyond ASCII.
CLASSES = {"space": np.ones(256, bool), "alnum": np.zeros(256, bool)}
CLASSES["space"][[9, 10, 11, 12, 13, 32]] = False
CLASSES["alnum"][48:58] = CLASSES["alnum"][97:123] = CLASSES["alnum"][128:] = True


class Tokens(NamedTuple):
    """Words of some texts. Word i is ``buf[start[i]:end[i]]``; text d has words ``doc[d]:doc[d + 1]``."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.doc) - 1), np.diff(self.doc))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they have been asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, m, 2**64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, m, 2**64))])
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (nulls are empty) and the offsets of its rows in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string()) if texts.null_count else texts.cast(pa.large_string())
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    return buf, offsets - lo


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library, which need not be told
    _trim = None


def release() -> None:
    """Gives freed memory back to the system. A Python worker lives on beside the executor's other tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` text bytes each; a longer text comes alone."""
    if not batch.num_rows:
        return
    try:
        yield from _slices(batch, column, limit)
    finally:
        release()


def _slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte spans, which must be in order and not overlap."""
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        lo = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, lo + _BLOCK, "right")))
        hi = int(end[to - 1])
        up, down = _byte_powers.get(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(_BYTE[buf[lo:hi]] * up[: hi - lo], out=total[1:])
        a, b = start[at:to] - lo, end[at:to] - lo
        out[at:to] = (total[b] - total[a]) * down[a] + (b - a).astype(U)
        at = to
    return mix(out)


def tokenize(texts: pa.Array, kind: str = "space", lower: bool = False, hashes: bool = True) -> Tokens:
    """Words of whole texts; ``lower`` lower-cases A-Z first."""
    buf, offsets = text_bytes(texts)
    if lower:
        buf = _LOWER[buf]
    word = CLASSES[kind][buf]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # a text begins here, and what came before ends
    begins[edges] = word[edges]
    edges = edges[edges > 0] - 1
    ends[edges] = word[edges]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(start, offsets)
    return Tokens(buf, offsets, start, end, doc, hash_spans(buf, start, end) if hashes else np.zeros(0, U))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, over the whole array; len(words) - n + 1 of them."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    if n <= 8:
        out = np.zeros(m, U)
        for j in range(n):
            out = out * U(_WORD_BASE) + words[j : j + m]
        return mix(out)
    out = np.empty(m, U)
    for at in range(0, m, _BLOCK):
        part = words[at : min(at + _BLOCK, m) + n - 1]
        up, down = _word_powers.get(len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=total[1:])
        k = len(part) - n + 1
        out[at : at + k] = (total[n : n + k] - total[:k]) * down[:k]
    return mix(out)


def gram_docs(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams that lie inside one text: their first words, texts and hashes."""
    h = grams(t.hash, n)
    owner = t.owner()
    at = np.flatnonzero(owner[: len(h)] == owner[n - 1 : n - 1 + len(h)]) if len(h) else np.zeros(0, np.int64)
    return at, owner[at], h[at]


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of a, then b, and where each stands in the input."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[new], y[new], order[new]


def runs_of(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, begin and end of each run of equal values."""
    edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(values[a]), int(a), int(b)
