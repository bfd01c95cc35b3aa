"""Vectorised text kernels over Arrow string columns: words as byte spans, hashes of spans, per-document sums.

A batch of texts is one byte buffer; words are (start, end) spans in it, so no Python string is made per word.
UTF-8 keeps every byte of a non-ASCII character at 0x80 or above, so byte classes decide word characters exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Fixed values of the public XXH64 algorithm.
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of the benchmark search: ASCII that is no digit and, lower-cased, no letter.
IS_PUNCT = np.zeros(256, bool)
IS_PUNCT[:128] = True
IS_PUNCT[0x30:0x3A] = IS_PUNCT[0x41:0x5B] = IS_PUNCT[0x61:0x7B] = False


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `most` text bytes each; a longer text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part, first = 0, 0
    for k, s in enumerate(size):
        if part and part + s > most:
            yield batch.slice(first, k - first)
            part, first = 0, k
        part += int(s)
    if first < len(size):
        yield batch.slice(first)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and the n + 1 offsets. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a batch of texts. buf: lower-cased bytes; start, end: of each word; ptr: first word of each text."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = IS_WHITE):
        raw, off = flat(texts)
        self.buf = LOWERED[raw]
        word = ~separators[raw]
        n = len(raw)
        edge = np.zeros(n + 1, bool)  # a word never goes on from one text to the next
        edge[off] = True
        open_ = word.copy()
        open_[1:] &= ~word[:-1] | edge[1:n]
        close = word
        close[:-1] &= ~word[1:] | edge[1:n]
        self.start = np.flatnonzero(open_)
        self.end = np.flatnonzero(close) + 1
        self.ptr = np.searchsorted(self.start, off)
        self.n = np.diff(self.ptr)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buffer in which single spaces part the words, with their starts and ends there."""
        size = self.end - self.start
        start = np.cumsum(size + 1) - size - 1
        total = int(start[-1] + size[-1] + 1) if len(size) else 0
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[self.start] = 1
        inside[self.end] -= 1  # starts and ends are each unique, though an end may be the next text's start
        out = np.full(total, 32, np.uint8)
        gap = np.ones(total, bool)
        gap[start + size] = False
        out[gap] = self.buf[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        return out, start, start + size


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _tail(h: np.ndarray, b8: np.ndarray, b4: np.ndarray, buf: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    for k in range(3):
        on = left >= 8
        if not on.any():
            break
        every = bool(on.all())
        idx = slice(None) if every else np.flatnonzero(on)
        h[idx] = _rotl(h[idx] ^ _round(U(0), b8[at[idx]]), 27) * P1 + P4
        at = at + 8 * on
        left = left - 8 * on
    idx = np.flatnonzero(left >= 4)
    if len(idx):
        h[idx] = _rotl(h[idx] ^ (b4[at[idx]].astype(U) * P1), 23) * P2 + P3
        at[idx] += 4
        left[idx] -= 4
    for _ in range(3):
        idx = np.flatnonzero(left > 0)
        if not len(idx):
            break
        h[idx] = _rotl(h[idx] ^ (buf[at[idx]].astype(U) * P5), 11) * P1
        at[idx] += 1
        left[idx] -= 1
    h ^= h >> U(33)
    h *= P2
    h ^= h >> U(29)
    h *= P3
    h ^= h >> U(32)
    return h


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every span buf[start:end], as unsigned 64 bit; spans may overlap."""
    with np.errstate(over="ignore"):
        return _xxh64(buf, start, end, U(seed))


def _xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.uint64) -> np.ndarray:
    size = end - start
    out = np.empty(len(size), U)
    if not len(size):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    b8 = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    b4 = np.ndarray((len(buf) + 1,), "<u4", padded, 0, (1,))
    small = np.flatnonzero(size < 32)
    n = size[small]
    out[small] = _tail(seed + P5 + n.astype(U), b8, b4, padded, start[small].copy(), n.copy())
    mid = np.flatnonzero((size >= 32) & (size < 2048))
    if len(mid):
        n, at = size[mid], start[mid].copy()
        v = [np.full(len(mid), x, U) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        stripes = n // 32
        for s in range(int(stripes.max())):
            idx = np.flatnonzero(stripes > s)
            for k in range(4):
                v[k][idx] = _round(v[k][idx], b8[at[idx] + 8 * k])
            at[idx] += 32
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ _round(U(0), x)) * P1 + P4
        out[mid] = _tail(h + n.astype(U), b8, b4, padded, at, n % 32)
    for k in np.flatnonzero(size >= 2048):
        out[k] = xxhash.xxh64_intdigest(buf[start[k] : end[k]].tobytes(), int(seed))
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (the finaliser of XXH64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(33))) * P2
        h = (h ^ (h >> U(29))) * P3
        return h ^ (h >> U(32))


def sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of values over each ptr[i]:ptr[i+1]; 0 where that is empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[ptr[1:]] - total[ptr[:-1]]


def exact_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The same by adding each document's own values only, so that long batches cost no precision."""
    out = np.zeros(len(ptr) - 1, np.float64)
    full = np.flatnonzero(ptr[1:] > ptr[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, ptr[full])
    return out


class HashIndex:
    """Position of 64-bit keys in a fixed list, by open addressing; -1 for others. Look-ups are vectorised."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slot) - 1)

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self._home(h)
        got = self.slot[at]
        if not len(self.keys):
            return got
        wrong = np.flatnonzero((got >= 0) & (self.keys[np.maximum(got, 0)] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.slot) - 1)
            got[wrong] = self.slot[at[wrong]]
            wrong = wrong[(got[wrong] >= 0) & (self.keys[np.maximum(got[wrong], 0)] != h[wrong])]
        return got
