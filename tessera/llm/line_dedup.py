"""Line dedup by site-relative frequency.

A line of a site (host) goes if it stands on more than MAX_RATIO of the site's pages, and on
MIN_PAGES of them at least. A line counts once a page. Lines are compared as raw bytes by a
128-bit hash; lines without a word always stay and aren't counted as lines.

Every task adds up its own pages before the shuffle, so a line on every page of
the largest site makes one row for each task. Boilerplate lines of a site number at most
lines per page / MAX_RATIO. Up to PIECE of them are broadcast. Beyond that, pages and lines are dealt by
site, a site's pages in groups of about GROUP_PAGES, each beside that site's lines.

Defined results: null text stays null and has no lines; empty text stays empty;
a null site is a site of its own; rows that repeat count as pages of their own;
an empty table gives an empty result; other columns pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .spread import lean, settle

MAX_RATIO = 0.01
MIN_PAGES = 5
PIECE = 1_000_000
GROUP_PAGES = 20_000
GATHER = 1_000_000


def _site_hash(column: pa.Array) -> np.ndarray:
    """A hash of each row's site; null has one that no text has."""
    out = np.zeros(len(column), dtype=np.uint64)
    for t in X.texts(column):
        at = t.offs[:-1]
        out[t.first : t.first + len(t)] = X._span_hash(t.buf, at, t.offs[1:], 3) if len(t.buf) else np.uint64(7)
    out[pc.is_null(column).to_numpy(zero_copy_only=False)] = np.uint64(5)
    return out


def _keys(t: X.Texts, site: np.ndarray) -> tuple[X.Lines, np.ndarray, np.ndarray, np.ndarray]:
    """Lines, the index of those with a word, and their two keys within the site."""
    ls = X.lines(t)
    at = np.flatnonzero(ls.has_word)
    s = site[t.first + ls.doc[at]]
    return ls, at, X.mix(ls.hash[at] ^ s), X.mix(ls.hash2[at] + s)


def boilerplate(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, text: str = "text", site: str = "source") -> DataFrame:
    """site (its hash), k1, k2 of each line that is to go, and the site's pages with a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        pages: dict[int, int] = {}

        def flush() -> pa.RecordBatch:
            k = np.concatenate(held, axis=1)
            order = np.lexsort((k[1], k[0]))
            k = k[:, order]
            new = np.ones(k.shape[1], bool)
            new[1:] = (k[0, 1:] != k[0, :-1]) | (k[1, 1:] != k[1, :-1])
            first = np.flatnonzero(new)
            return pa.RecordBatch.from_arrays([pa.array(k[i][first].view(np.int64)) for i in range(3)] + [pa.array(np.diff(np.append(first, k.shape[1])))], ["site", "k1", "k2", "n"])

        for b in batches:
            sites = _site_hash(b.column(1))
            full = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for s, c in zip(*np.unique(sites[full], return_counts=True), strict=True):
                pages[int(s)] = pages.get(int(s), 0) + int(c)
            for t in X.texts(b.column(0)):
                ls, at, k1, k2 = _keys(t, sites)
                doc = ls.doc[at]
                order = np.lexsort((k2, k1, doc))  # once a page
                d, a, c = doc[order], k1[order], k2[order]
                once = np.ones(len(d), bool)
                once[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])
                held.append(np.stack([sites[t.first + d[once]], a[once], c[once]]))
                n += int(once.sum())
                if n >= GATHER:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
        if pages:
            s = np.array(list(pages), dtype=np.uint64).view(np.int64)
            none = np.zeros(len(s), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(none), pa.array(none), pa.array(np.array(list(pages.values()), np.int64))], ["site", "k1", "k2", "n"])

    rows = docs.select(F.col(text).alias("t"), F.col(site).cast("string").alias("s")).mapInArrow(lean(count), "site long, k1 long, k2 long, n long")
    counts = settle(rows.groupBy("site", "k1", "k2").agg(F.sum("n").alias("n")).where((F.col("n") >= min_pages) | ((F.col("k1") == 0) & (F.col("k2") == 0))))
    pages = counts.where("k1 = 0 and k2 = 0").select(F.col("site").alias("s"), F.col("n").alias("pages"))
    often = counts.where("k1 <> 0 or k2 <> 0").join(pages, F.col("site") == F.col("s"))
    return often.where(F.col("n") > F.lit(float(max_ratio)) * F.col("pages")).select("site", "k1", "k2", "pages")


def _sorted(k1: pa.ChunkedArray, k2: pa.ChunkedArray) -> np.ndarray:
    k = np.zeros(len(k1), dtype=[("a", np.uint64), ("b", np.uint64)])
    k["a"], k["b"] = k1.to_numpy().view(np.uint64), k2.to_numpy().view(np.uint64)
    return np.sort(k, order=["a", "b"])


def _drop(t: X.Texts, sites: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Lines with a word and removed lines of each row, and the new bytes of rows that lose some."""
    ls, at, k1, k2 = _keys(t, sites)
    n = len(t)
    gone = np.zeros(len(at), bool)
    if len(keys) and len(at):
        lo, hi = np.searchsorted(keys["a"], k1, "left"), np.searchsorted(keys["a"], k1, "right")
        for step in range(int((hi - lo).max())):  # all with an equal first half
            j = np.minimum(lo + step, len(keys) - 1)
            gone |= (lo + step < hi) & (keys["b"][j] == k2)
    doc = ls.doc
    n_lines, removed = np.bincount(doc[at], minlength=n), np.bincount(doc[at[gone]], minlength=n)
    keep = np.ones(len(doc), bool)
    keep[at[gone]] = False
    new: list[bytes | None] = [None] * n
    raw = t.buf.tobytes()
    for r in np.flatnonzero(removed):
        new[r] = b"\n".join(raw[ls.start[i] : ls.end[i]] for i in range(ls.ptr[r], ls.ptr[r + 1]) if keep[i])
    return n_lines, removed, new


def drop_lines(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, text: str = "text", site: str = "source", counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with the site's boilerplate lines taken out of text; counts: names for lines with a word, before and removed."""
    found = settle(boilerplate(docs, max_ratio, min_pages, text, site))
    ti, si = docs.columns.index(text), docs.columns.index(site)
    kind = type(docs.schema)(list(docs.schema.fields))
    for c in counts or ():
        kind = kind.add(c, "long")

    def cleaned(b: pa.RecordBatch, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        sites = _site_hash(b.column(si).cast(pa.string()))
        for t in X.texts(b.column(ti)):
            part = b.slice(t.first, len(t))
            n_lines, removed, new = _drop(t, sites, keys)
            cols = list(part.columns)
            if removed.any():
                cols[ti] = pa.array([o if x is None else x.decode() for o, x in zip(cols[ti].to_pylist(), new, strict=True)], cols[ti].type)
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(n_lines), pa.array(removed)] if counts else []), kind.names)

    if found.count() <= PIECE:
        lines = found.select("k1", "k2").toArrow()
        held = docs.sparkSession.sparkContext.broadcast(_sorted(lines["k1"], lines["k2"]))

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from cleaned(b, held.value)

        return docs.mapInArrow(lean(clean), kind)

    names = [*docs.columns, "_tessera_site", "_tessera_roll"]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the hash of their site, and a number by their content that deals a site's pages."""
        for b in batches:
            sites, texts = _site_hash(b.column(si).cast(pa.string())), _site_hash(b.column(ti))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sites.view(np.int64)), pa.array((texts >> np.uint64(33)).astype(np.int64))], names)

    sites = found.groupBy("site").agg(F.ceil(F.first("pages") / GROUP_PAGES).alias("parts"))
    rows = docs.mapInArrow(lean(named), type(docs.schema)(list(docs.schema.fields)).add(names[-2], "long").add(names[-1], "long"))
    rows = rows.join(sites.withColumnRenamed("site", "_tessera_s"), F.col(names[-2]) == F.col("_tessera_s"), "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    others = rows.where("parts is null").select(*own)  # pages of sites that lose nothing
    rows = rows.where("parts is not null").select(*own, F.xxhash64(names[-2], F.pmod(names[-1], "parts")).alias("_tessera_g"))
    keys = found.join(sites, "site").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    keys = keys.select(F.xxhash64("site", "part").alias("_tessera_k"), "k1", "k2")

    columns = docs.columns

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        lines, own = _sorted(right.column("k1"), right.column("k2")), left.select(columns).combine_chunks()
        kinds = pa.schema([*own.schema, *(pa.field(c, pa.int64()) for c in counts or ())])
        return pa.Table.from_batches([x for b in own.to_batches() for x in cleaned(b, lines)], schema=kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=[("a", np.uint64), ("b", np.uint64)])
        for b in batches:
            yield from cleaned(b, none)

    return rows.groupBy("_tessera_g").cogroup(keys.groupBy("_tessera_k")).applyInArrow(cut, kind).union(others.mapInArrow(lean(count), kind))
