"""Quality rules: hashed n-gram log-likelihood ratio behind a few base rules.

Two multinomials over hashed 1- and 2-grams of lower-cased words are counted: one from the
trusted rows, one from the whole corpus. A document's score is its mean
log(p_trusted / p_corpus) over all its n-grams, and every document is held against
the same threshold. Both models are BINS additive counts, so what is merged and
broadcast has a fixed size however many documents there are.

Defined results: null or empty text has no words, fails the base rules and scores
0; repeated rows each get their own result; without trusted rows, or with an empty
table, every score is 0 and the base rules alone decide. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .spread import lean, lean_group

BINS = 1 << 16
BLOCK = 1 << 12
MIN_WORDS = 50
REPEAT_PERCENT = 50
MIN_SCORE = -0.16
PRIOR = 4.0
#: Trusted ids used, by smallest hash: the bound on what is broadcast beside the two models.
TRUSTED_ROWS = 200_000
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def _grams(w: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bin, and row, of each 1- and 2-gram."""
    at, pair = X.windows(w, 2)
    doc = w.doc
    mask = np.uint64(BINS - 1)
    return np.concatenate([w.hash & mask, pair & mask]).astype(np.int64), np.concatenate([doc, doc[at]])


def gram_counts(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Counts of all rows, and of those whose id is in trusted[doc_id]; BINS numbers each.

    Every task adds up its own rows first and sends BINS / BLOCK rows.
    """
    ids = trusted.select(F.col(doc_id).cast("long").alias("t")).where("t is not null").distinct().orderBy(F.xxhash64("t"), "t").limit(TRUSTED_ROWS).toPandas().t.to_numpy(dtype=np.int64)
    held = docs.sparkSession.sparkContext.broadcast(np.sort(ids))
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("x"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), dtype=np.int64)
        for b in batches:
            d = b.column(0)
            good = np.isin(d.fill_null(0).to_numpy(), held.value) & d.is_valid().to_numpy(zero_copy_only=False)
            for t in X.texts(b.column(1)):
                bins, doc = _grams(X.words(t, lower=True))
                total[0] += np.bincount(bins, minlength=BINS)
                total[1] += np.bincount(bins[good[t.first + doc]], minlength=BINS)
        parts = [(k, total[:, k * BLOCK : (k + 1) * BLOCK]) for k in range(BINS // BLOCK)]
        parts = [(k, x.tobytes()) for k, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(2 * BLOCK, dtype=np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), dtype=np.int64)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, counts binary"
    out = np.zeros((2, BINS), dtype=np.int64)
    for row in rows.mapInArrow(lean(count), schema).groupBy("block").applyInArrow(lean_group(add), schema).collect():  # BINS / BLOCK rows
        out[:, row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.counts, dtype=np.int64).reshape(2, BLOCK)
    return out[0], out[1]


def log_ratio(corpus: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """log of trusted over expected counts in each bin; 0 everywhere if a side is empty.

    Expected is the corpus's share of the trusted total. PRIOR is added to both, so bins
    that say little either way stay near 0 and a small trusted set is not overread.
    """
    if not trusted.sum() or not corpus.sum():
        return np.zeros(BINS)
    expected = corpus * (trusted.sum() / corpus.sum())
    return np.log((trusted + PRIOR) / (expected + PRIOR))


def row_features(t: X.Texts, ratio: np.ndarray) -> dict[str, np.ndarray]:
    n = len(t)
    w = X.words(t)
    n_words = np.diff(w.ptr)
    inside = np.empty(len(t.buf) + 1, dtype=np.int64)
    inside[0] = 0
    np.cumsum((t.buf & 0xC0) != 0x80, out=inside[1:])
    word_chars = X.per_row(inside[w.end] - inside[w.start], w.ptr)
    n_symbols = X.per_row(_SYMBOL[t.buf], t.offs)

    ls = X.lines(t)
    at = np.flatnonzero(ls.has_word)
    doc = ls.doc[at]
    order = np.lexsort((at, ls.hash2[at], ls.hash[at], doc))
    d, a, b = doc[order], ls.hash[at][order], ls.hash2[at][order]
    again = np.zeros(len(at), dtype=bool)
    again[1:] = (d[1:] == d[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    n_dup_lines = np.bincount(d[again], minlength=n)

    at, three = X.windows(w, 3)
    doc = w.doc
    key = X.mix(three + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(at) + 1, dtype=bool)
    same[1:-1] = key[order][1:] == key[order][:-1] if len(at) else False
    covered = np.zeros(len(w.hash) + 3, dtype=bool)
    twice = at[order[same[1:] | same[:-1]]]
    for k in range(3):
        covered[twice + k] = True
    n_repeat = np.bincount(doc[covered[: len(doc)]], minlength=n)

    bins, doc = _grams(X.words(t, lower=True))
    grams = np.bincount(doc, minlength=n)
    score = np.bincount(doc, weights=ratio[bins], minlength=n) / np.maximum(grams, 1)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "base_failed": failed, "score": score}


def quality(docs: DataFrame, trusted: DataFrame, min_score: float = MIN_SCORE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """RESULT for every row of docs. trusted: rows whose doc_id names the target texts."""
    spark = docs.sparkSession
    ratio = spark.sparkContext.broadcast(log_ratio(*gram_counts(docs, trusted, text, doc_id)))
    floor = float(min_score)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in X.texts(b.column(1)):
                f = row_features(t, ratio.value)
                f["kept"] = ~f["base_failed"] & (f["score"] >= floor)
                names = [x.split()[0] for x in RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, len(t)), *(pa.array(f[k]) for k in names[1:])], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(judge), RESULT)


def keep_good(docs: DataFrame, trusted: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs that pass, with all their columns; no join: the verdict is made beside the row."""
    spark = docs.sparkSession
    ratio = spark.sparkContext.broadcast(log_ratio(*gram_counts(docs, trusted)))
    floor, at = float(min_score), docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in X.texts(b.column(at)):
                f = row_features(t, ratio.value)
                yield b.slice(t.first, len(t)).filter(pa.array(~f["base_failed"] & (f["score"] >= floor)))

    return docs.mapInArrow(lean(sift), docs.schema)
