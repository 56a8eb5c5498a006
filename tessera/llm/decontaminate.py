"""Benchmark decontamination: SimHash of item-sized windows, a multi-index Hamming search, exact verification.

An item has a 64-bit SimHash of its lower-cased words, and a document one of every window of the
item's length. Fingerprints are cut into BLOCKS blocks; the index holds each item under every
value within one bit of each of its blocks, so any fingerprint within RADIUS = 2 * BLOCKS - 1 bits shares an
entry with it (pigeonhole). Similar windows may lie beyond that radius, so those that hold PERCENT of an item's
shingles, as every window with that similarity must, are candidates too. Candidates are verified on the whole window: the Jaccard
similarity of the two multisets of five-word shingles, 0.8 or more.

A window without one of the item's shingles has similarity 0, so fingerprints are computed only for windows around
a shingle that the benchmark holds; this drops nothing that could pass. Items
are broadcast PASS_WORDS words at a time, with a further pass over the documents for every further part,
so what is broadcast has a fixed bound. Documents are neither shuffled nor joined.

Defined results: null or empty texts and items match nothing; items of fewer than
five words are one shingle and match that sequence exactly; a document shorter than an item is
one window; items that repeat each match; of equal windows the first one counts; repeated
documents each get their rows; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .spread import lean

SHINGLE = 5
PERCENT = 80
BITS = (11, 11, 11, 11, 10, 10)
BLOCKS = len(BITS)
RADIUS = 2 * BLOCKS - 1
PASS_WORDS = 4_000_000
#: Words of one text that are looked at together.
SEGMENT = 50_000


def fingerprints(total: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """SimHash of words start:stop from the running sums of their bits (one column for each)."""
    votes = 2 * (total[stop] - total[start]) - (stop - start)[:, None]
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def running(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def _keys(print_: np.ndarray) -> np.ndarray:
    """Block number and value of each block of each fingerprint, as one number; shape (n, BLOCKS)."""
    out, at = [], 0
    for i, b in enumerate(BITS):
        out.append(((print_ >> np.uint64(at)) & np.uint64((1 << b) - 1)) | np.uint64(i << 16))
        at += b
    return np.stack(out, axis=1)


class Index:
    """Some items: their shingles, fingerprints and block entries."""

    def __init__(self, ids: list[int], words: list[np.ndarray]) -> None:
        self.ids, self.words = ids, words
        self.sizes = np.array([len(w) for w in words])
        self.sums = [shingles(w) for w in words]
        self.prints = np.concatenate([fingerprints(running(w), np.array([0]), np.array([len(w)])) for w in words]) if words else np.zeros(0, np.uint64)
        whole = _keys(self.prints)
        entries, owner = [], []
        for i, b in enumerate(BITS):
            near = np.concatenate([whole[:, i : i + 1], whole[:, i : i + 1] ^ (np.uint64(1) << np.arange(b, dtype=np.uint64))], axis=1)
            entries.append(near.ravel())
            owner.append(np.repeat(np.arange(len(ids)), b + 1))
        e, o = np.concatenate(entries), np.concatenate(owner)
        order = np.argsort(e, kind="stable")
        self.entries, self.owner = e[order], o[order]
        held = np.concatenate([s[0] for s in self.sums] or [np.zeros(0, np.uint64)])
        order = np.argsort(held, kind="stable")
        self.held, self.holder = held[order], np.repeat(np.arange(len(ids)), [len(s[0]) for s in self.sums])[order]
        self.known = np.unique(held)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        out = np.flatnonzero(self.marks[(h >> np.uint64(44)).astype(np.int64)])
        return out[np.isin(h[out], self.known)]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (row of prints, item) within RADIUS bits."""
        keys = _keys(prints)
        row = np.repeat(np.arange(len(prints)), BLOCKS)
        lo, hi = np.searchsorted(self.entries, keys.ravel(), "left"), np.searchsorted(self.entries, keys.ravel(), "right")
        n = hi - lo
        row = np.repeat(row, n)
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item = self.owner[at]
        close = np.bitwise_count(prints[row] ^ self.prints[item]) <= RADIUS
        pair = np.unique(row[close] * np.int64(len(self.ids)) + item[close])
        return pair // len(self.ids), pair % len(self.ids)


    def rich(self, at: np.ndarray, h: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Every (start, item) whose window of the document (n words; shingles h at at) holds PERCENT of the item's shingles."""
        lo, hi = np.searchsorted(self.held, h, "left"), np.searchsorted(self.held, h, "right")
        k = hi - lo
        item = self.holder[np.repeat(lo - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())] if len(k) else np.zeros(0, np.int64)
        at = np.repeat(at, k)
        need = np.maximum(self.sizes - SHINGLE + 1, 1) * PERCENT
        which, found = np.unique(item, return_counts=True)
        order = np.argsort(item, kind="stable")
        at, item = at[order], item[order]
        for i in which[(100 * found >= need[which]) & (self.sizes[which] >= SHINGLE)]:
            own = np.sort(at[np.searchsorted(item, i) : np.searchsorted(item, i, "right")])
            low = max(0, int(own[0]) - int(self.sizes[i]))  # no window before that, nor behind the last of them, holds any
            upto = np.concatenate([[0], np.cumsum(np.bincount(own - low, minlength=int(own[-1]) - low + 1))])
            start = np.arange(low, min(int(own[-1]), max(0, n - int(self.sizes[i]))) + 1)
            inside = upto[np.minimum(start - low + int(self.sizes[i]) - SHINGLE + 1, len(upto) - 1)] - upto[start - low]
            yield from ((int(start[a]), int(i)) for a in np.flatnonzero(100 * inside >= need[i]))


def shingles(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a word sequence, sorted, and how often each stands there."""
    k = min(SHINGLE, len(w))
    _, h = X.windows(X.Words(w, w, np.array([0, len(w)]), w), k) if k else (None, w)
    if 0 < k < SHINGLE:
        h = X.mix(h + np.uint64(k))
    return np.unique(h, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both, int(a[1].sum() + b[1].sum()) - both


def search(w: np.ndarray, hits: np.ndarray, index: Index) -> list[tuple[int, float, int, int]]:
    """Item, similarity, first word, end of the best window of each item in one document; hits: shingle starts the benchmark holds."""
    n, pairs = len(w), set()
    for size in np.unique(index.sizes).tolist():
        if size < SHINGLE and n < size:
            continue
        # starts of windows that hold a hit: one more from its first possible start on, one less behind its last one
        last = max(0, n - size)
        edge = np.zeros(last + 2, np.int32)
        np.add.at(edge, np.clip(hits - max(size - SHINGLE, 0), 0, last), 1)
        np.add.at(edge, np.minimum(hits, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]))
        for lo in range(0, last + 1, SEGMENT):  # sums of bits take 256 bytes for each word
            start = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, lo + SEGMENT)]
            if not len(start):
                continue
            total = running(w[lo : lo + SEGMENT + size])
            prints = fingerprints(total, start - lo, np.minimum(start + size, n) - lo)
            for r, i in zip(*index.near(prints), strict=True):
                if index.sizes[i] == size:
                    pairs.add((int(start[r]), int(i)))
    if n >= SHINGLE:
        at, h = X.windows(X.Words(w, w, np.array([0, n]), w), SHINGLE)
        pairs.update(index.rich(at, h, n))
    out = []
    for a, i in sorted(pairs):
        b = min(a + int(index.sizes[i]), n)
        both, union = similarity(shingles(w[a:b]), index.sums[i])
        if both and 100 * both >= PERCENT * union:
            out.append((i, both / union, a, b))
    best: dict[int, tuple[int, float, int, int]] = {}
    for x in sorted(out, key=lambda x: (x[0], -x[1], x[2])):
        best.setdefault(x[0], x)
    return list(best.values())


def _indexes(items: DataFrame, item_id: str, text: str) -> Iterator[Index]:
    ids, words, size = [], [], 0
    for row in items.select(F.col(item_id).cast("long"), text).orderBy(item_id, text).toLocalIterator():
        for t in X.texts(pc.utf8_lower(pa.array([row[1]], pa.string()))):
            h = X.words(t).hash
            if len(h):
                ids.append(row[0])
                words.append(h)
                size += len(h)
        if size >= PASS_WORDS:
            yield Index(ids, words)
            ids, words, size = [], [], 0
    if ids:
        yield Index(ids, words)


def _matches(t: X.Texts, index: Index) -> list[tuple[int, list[tuple[int, float, int, int]]]]:
    """Rows of t (lower-cased) with matches."""
    w = X.words(t)
    row = w.doc
    at, h = X.windows(w, SHINGLE)
    hit = [at[index.hits(h)]]
    for k in range(1, SHINGLE):
        if (index.sizes == k).any():
            at, h = X.windows(w, k)
            hit.append(at[index.hits(X.mix(h + np.uint64(k)))])
    hit = np.unique(np.concatenate(hit))
    out = []
    for r in np.unique(row[hit]):
        own = hit[row[hit] == r] - w.ptr[r]
        if found := search(w.hash[w.ptr[r] : w.ptr[r + 1]], own, index):
            out.append((int(r), found))
    return out


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, first_word, end_word: the best window of each item in each document that holds it."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, first_word long, end_word long"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], schema)
    for index in _indexes(items, item_id, item_text):
        held = spark.sparkContext.broadcast(index)

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                ids, found = b.column(0).to_pylist(), []
                for t in X.texts(pc.utf8_lower(b.column(1))):
                    found += [(ids[t.first + r], index.ids[i], s, a, z) for r, x in _matches(t, index) for i, s, a, z in x]
                cols = list(zip(*found, strict=True)) if found else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        out = out.union(rows.mapInArrow(lean(look), schema))
    return out


def drop_leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold an item; judged beside the row, so nothing is shuffled."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for index in _indexes(items, "item_id", "text"):
        held = spark.sparkContext.broadcast(index)

        def sift(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for t in X.texts(pc.utf8_lower(b.column(at))):
                    keep[[t.first + r for r, _ in _matches(t, held.value)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(sift), docs.schema)
    return docs
