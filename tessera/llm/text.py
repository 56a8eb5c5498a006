"""Vectorised word, line and window hashing over Arrow string columns.

A word is a run of bytes outside {space, tab, LF, VT, FF, CR}. Those six are
ASCII, so splitting UTF-8 bytes equals splitting code points. Hashes have 64 bits and
depend on content alone, never on batch or position. A span is taken eight bytes
at a time and the state is mixed after each, so that no two texts collide by their structure, as
they may under polynomials modulo 2**64; spans of more than WIDE bytes use BLAKE2.
A window is hashed from its halves in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WS = np.zeros(256, dtype=bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK = 1 << 19
WIDE = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, seed: int) -> np.ndarray:
    """Reproducible numbers in (0, 1) that depend on key and seed alone."""
    r = mix(key ^ np.uint64((seed * _B1 + 0x1234567) & (2**64 - 1)))
    return ((r >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


@dataclass
class Texts:
    """Some consecutive rows: their bytes, and row i is buf[offs[i]:offs[i + 1]]."""

    first: int
    buf: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1


def texts(column: pa.Array, max_bytes: int = CHUNK) -> Iterator[Texts]:
    """Rows in pieces of about max_bytes (a longer row makes a longer piece); null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        yield Texts(lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


@dataclass
class Words:
    """Words of some rows: byte spans, and row i has words ptr[i]:ptr[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def _spans(sep: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(sep)
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[1:], after[:-1] = sep[:-1], sep[1:]
    first, last = offs[:-1], offs[1:] - 1
    before[first[first < n]] = True
    after[last[last >= 0]] = True
    token = ~sep
    return np.flatnonzero(token & before), np.flatnonzero(token & after) + 1


def _span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 1) -> np.ndarray:
    """A hash of each span buf[start:end]; other salts give independent ones."""
    n = end - start
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    at = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # eight bytes from every byte on
    state = mix(n.astype(np.uint64) + np.uint64(salt) * np.uint64(_B1 & (2**60 - 1)))
    state = mix((state ^ (at[start] & _MASK[np.minimum(n, 8)])) * np.uint64(_B2))
    left, done = np.flatnonzero((n > 8) & (n <= WIDE)), 8
    while len(left):
        some = at[start[left] + done] & _MASK[np.minimum(n[left] - done, 8)]
        state[left] = mix((state[left] ^ some) * np.uint64(_B2))
        done += 8
        left = left[n[left] > done]
    for i in np.flatnonzero(n > WIDE):
        whole = hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([salt]))
        state[i] = np.frombuffer(whole.digest(), dtype="<u8")[0]
    return state


def words(t: Texts, lower: bool = False) -> Words:
    buf = _LOWER[t.buf] if lower else t.buf
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(t.offs), np.int64), np.zeros(0, np.uint64))
    start, end = _spans(_WS[buf], t.offs)
    return Words(start, end, np.searchsorted(start, t.offs), _span_hash(buf, start, end))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(_B1) + (b ^ (b >> np.uint64(32))) * np.uint64(_B2))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of every window of k consecutive words of one row."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    level, size, out, have = w.hash, 1, None, 0
    while size <= k:
        if k & size:  # what is there, and a run of that size behind it
            out = level if out is None else _join(out[: n - have - size + 1], level[have:])
            have += size
        if 2 * size <= k:
            level = _join(level[:-size], level[size:])
        size *= 2
    stop = np.repeat(w.ptr[1:], np.diff(w.ptr))
    at = np.flatnonzero(np.arange(k, n + k) <= stop)
    return at, out[at]


@dataclass
class Lines:
    """\\n-split lines of some rows, the empty ones too: row i has lines ptr[i]:ptr[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    has_word: np.ndarray
    hash: np.ndarray
    hash2: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def lines(t: Texts) -> Lines:
    """Every row has one line at least. Lines compare as raw bytes, the white space in them included."""
    cut = np.flatnonzero(t.buf == 10)
    start = np.sort(np.concatenate([t.offs[:-1], cut + 1]), kind="stable")
    end = np.sort(np.concatenate([t.offs[1:], cut]), kind="stable")
    solid = np.empty(len(t.buf) + 1, dtype=np.int64)
    solid[0] = 0
    np.cumsum(~_WS[t.buf], out=solid[1:])
    # a row's first line starts where its bytes do; count newlines before it to find its index
    ptr = np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(cut, t.offs)) + 1)])
    return Lines(start, end, ptr, solid[end] > solid[start], _span_hash(t.buf, start, end), _span_hash(t.buf, start, end, 3))


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of flags (one for each byte or item) over each row offs[i]:offs[i + 1]."""
    total = np.empty(len(flags) + 1, dtype=np.int64)
    total[0] = 0
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
