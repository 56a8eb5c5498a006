"""LM scoring by a hierarchical Pitman-Yor bigram model.

Tokens are lower-cased words and one end for each text. Every word has a context restaurant, and one
stands for the start of a text. All share one parent restaurant of
single words, whose customers are their tables, over a uniform base of the V trained words and one
more for all others.

Seating is sampled by Gibbs sweeps over tables for each (context, word): given its
customers, the tables of its context and the parent's probability, the number of its tables has a
closed conditional through generalised Stirling numbers, drawn by inverting it at a number
hashed from the pair; above STIRLING customers they are seated one after the other in growing steps.
Counts are split by word, so a word's parent customers are all in one place; the FREQUENT most frequent
words are split by (context, word), and their parent counts, like the tables of their contexts,
are vectors of fixed length which every sweep adds up again. The totals of all other contexts are a table
that is split by context: buckets ask it for the contexts that they hold. A single customer always has one table, so only
groups of more in such a context, and the other groups of their words ("hard"), need its totals while tables
are drawn; these alone are exchanged at each sweep. The model is thus spread over the cluster and only
vectors of FREQUENT + 1 numbers are broadcast. SAMPLES sweeps after BURN are averaged as probabilities.

A text is scored where its words' counts are: its tokens travel once, packed by word, meet the totals of
their contexts there, and sums of logarithms come back. Tokens of the most frequent pairs stay where they are: there are HOT such pairs
for each bucket at most, whose probabilities the driver works out and broadcasts, so no pair's tokens gather in one task.

Defined results: null or empty text is its end alone; rows that share a doc_id are one
document, whose tokens are theirs together; rows with a null doc_id train, and are one document; an
empty table gives an empty result; without training texts every probability is the base's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .spread import at_most, buckets, by_bucket, discard, pack, settle, small, squeeze, unpack, unsqueeze

FREQUENT = 32_000
CONTEXTS = FREQUENT + 1
STIRLING = 400
BURN, SAMPLES = 1, 3
#: A pair of frequent words with more than one in HOT of a bucket's even share of all tokens is scored where it is read.
HOT = 8
STRENGTH = 4.0
GATHER = 1_000_000
#: Tokens of a bucket that are scored together.
SLICE = 500_000
END = np.uint64(0x6A09E667F3BCC909)
LAST = 2**63 - 1
FOLDS, HELD = 7, 2


def tokens(t: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token, of the one before it (0 at the start), and its row."""
    w = X.words(t, lower=True)
    n = np.diff(w.ptr)
    ends = w.ptr[1:] + np.arange(len(n))
    tok = np.empty(len(w.hash) + len(n), np.uint64)
    real = np.ones(len(tok), bool)
    real[ends] = False
    tok[real], tok[ends] = w.hash, END
    row = np.repeat(np.arange(len(n)), n + 1)
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])] = 0
    return tok, before, row


def contexts(before: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Contexts by number: 0 for the start, then the frequent words, and from CONTEXTS on all other words by their hash."""
    out = np.where(before < np.uint64(CONTEXTS), before + np.uint64(CONTEXTS), before)
    own = _index(before, frequent)
    out[own >= 0] = own[own >= 0] + 1
    out[before == 0] = 0
    return out


def narrow(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts for an exchange: two bytes each, and the hashes of those that are not frequent."""
    rare = ctx >= CONTEXTS
    return np.where(rare, CONTEXTS, ctx).astype(np.uint16), ctx[rare]


def local(code: np.ndarray, rare: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Contexts of one bucket: those that are not frequent as CONTEXTS and on, by their place in ids."""
    out = code.astype(np.int32)
    out[code == CONTEXTS] = CONTEXTS + np.searchsorted(ids, rare)
    return out


def _home(ids: np.ndarray, n: int) -> np.ndarray:
    return (ids >> np.uint64(33)).astype(np.int64) % n


def _bucket(word: np.ndarray, ctx: np.ndarray, frequent: np.ndarray, n: int) -> np.ndarray:
    own, rare = _index(word, frequent) >= 0, ctx >= CONTEXTS
    key = np.where(own & rare, ctx, word)
    own &= ~rare
    key[own] = X.mix(word[own] + ctx[own] + np.uint64(1))
    return _home(key, n)


def _hard(own: np.ndarray, ptr: np.ndarray, ctx: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Groups whose tables depend on the totals of a context that is not frequent, with all groups of their words."""
    hard = (ctx >= CONTEXTS) & (c > 1)
    if len(own):
        word = np.logical_or.reduceat(hard, ptr[:-1]) & (own < 0)
        hard |= np.repeat(word, np.diff(ptr))
    return hard


def _part(use: np.ndarray, word: np.ndarray, own: np.ndarray, ptr: np.ndarray, ctx: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    at = np.repeat(np.arange(len(word)), np.diff(ptr))[use]
    k = np.bincount(at, minlength=len(word))
    return word[k > 0], own[k > 0], np.concatenate([[0], np.cumsum(k[k > 0])]), ctx[use], c[use]


def stirling(d: float) -> np.ndarray:
    """log S_d(c, t) for c, t <= STIRLING: the weight of seating c customers at t tables."""
    s = np.full((STIRLING + 1, STIRLING + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(1, STIRLING + 1):
        t = np.arange(1, c + 1)
        stay = np.where(t < c, s[c - 1, 1 : c + 1] + np.log(np.maximum(c - 1 - d * t, 1e-300)), -np.inf)
        s[c, 1 : c + 1] = np.logaddexp(s[c - 1, :c], stay)
    return s


def seat(c: np.ndarray, tables: np.ndarray, prob: np.ndarray, key: np.ndarray, seed: int, d: float, strength: float, table: np.ndarray) -> np.ndarray:
    """A number of tables for each group of c customers; tables: of the rest of their restaurant; prob: the parent's."""
    t = np.minimum(c, 1).astype(np.int64)
    u = X.uniform(key, seed)
    many = np.flatnonzero((c > 1) & (c <= STIRLING))
    many = many[np.argsort(c[many], kind="stable")]
    lo = 0
    while lo < len(many):  # groups of about one size together, in slabs of bounded size
        k = int(c[many[lo]])
        hi = min(int(np.searchsorted(c[many], k + k // 8, side="right")), lo + max(1, 250_000 // k))
        i = many[lo:hi]
        k, lo = int(c[i[-1]]), hi
        rise = np.log(strength + d * (tables[i][:, None] + np.arange(k))).cumsum(axis=1)
        w = table[c[i], 1 : k + 1] + rise + np.log(prob[i])[:, None] * np.arange(1, k + 1)  # -inf beyond a group's size
        w = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
        t[i] = 1 + (w < u[i][:, None] * w[:, -1:]).sum(axis=1)
    i = np.flatnonzero(c > STIRLING)
    if len(i):
        # one customer after the other, in steps that grow with those seated: new tables are Poisson in a step
        seated, now, step = np.ones(len(i)), np.ones(len(i)), 0
        while (left := np.flatnonzero(seated < c[i])).size:
            size = np.minimum(np.maximum(1, np.floor(seated[left] * 0.2)), c[i][left] - seated[left])
            new = (strength + d * (tables[i][left] + now[left])) * prob[i][left]
            p = new / (new + np.maximum(seated[left] - d * now[left], 1e-9))
            mean = size * p
            r = X.uniform(key[i][left] + np.uint64(step + 1), seed)
            z = np.sqrt(2.0) * _inverse_erf(2 * r - 1)
            drawn = np.where(size == 1, r < p, np.clip(np.round(mean + z * np.sqrt(mean * (1 - p))), 0, size))
            now[left] += drawn
            seated[left] += size
            step += 1
        t[i] = now.astype(np.int64)
    return t


def _inverse_erf(x: np.ndarray) -> np.ndarray:
    """To about 2e-3, which is enough for a step's rounding."""
    a = 0.147
    ln = np.log(np.maximum(1 - x * x, 1e-300))
    first = 2 / (math.pi * a) + ln / 2
    return np.sign(x) * np.sqrt(np.sqrt(first * first - ln / a) - first)


class Model:
    """Vectors that hold for all of the cluster, for one sweep."""

    def __init__(self, ctx_customers, ctx_tables, word_customers, d, d1, v, seed, others=0.0) -> None:
        self.customers, self.tables, self.seed = ctx_customers, ctx_tables, seed
        self.d, self.d1, self.base = d, d1, 1.0 / (v + 1)
        self.total = float(ctx_tables.sum()) + others  # others: tables of the contexts that are not frequent
        self.top = self.total  # tables of the parent; set by the sweep
        self.stirling, self.stirling1 = stirling(d), stirling(d1)
        self.word_customers = word_customers
        self.word_prob = np.zeros(len(word_customers))

    def parent(self, customers: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The parent's probability of words with so many customers there, after seating these."""
        t = seat(customers, np.full(len(customers), max(self.top - 1, 0.0)), np.full(len(customers), self.base), key, self.seed * 7 + 3, self.d1, STRENGTH, self.stirling1)
        self.seated = t
        return (customers - self.d1 * t + (STRENGTH + self.d1 * self.top) * self.base) / (STRENGTH + self.total)

    def sweep(self, word: np.ndarray, own: np.ndarray, ptr: np.ndarray, ctx: np.ndarray, c: np.ndarray, ids=(), tables=()) -> tuple[np.ndarray, np.ndarray]:
        """Tables of each (word, context), and each word's parent probability. own: index among the frequent, or -1;
        ids, tables: of the contexts from CONTEXTS on."""
        many = np.flatnonzero(c > 1)  # the others have one table for their customer, if any
        t, at = np.minimum(c, 1).astype(np.int64), np.searchsorted(ptr, many, side="right") - 1
        c, ctx = c[many].astype(np.int64), ctx[many]
        name = np.append(np.arange(CONTEXTS, dtype=np.uint64), np.asarray(ids, np.uint64))
        key = X.mix(word[at] + name[ctx] * np.uint64(0x9E3779B97F4A7C15))
        rest = np.maximum(np.append(self.tables, tables)[ctx] - 1.0, 0.0)
        customers = np.add.reduceat(t, ptr[:-1]) if len(word) else np.zeros(0, np.int64)
        for _ in range(2):
            prob = self.parent(customers, X.mix(word))
            prob = np.where(own >= 0, self.word_prob[np.maximum(own, 0)], prob) if len(self.word_prob) else prob
            t[many] = seat(c, rest, prob[at], key, self.seed, self.d, STRENGTH, self.stirling)
            customers = np.add.reduceat(t, ptr[:-1]) if len(word) else customers
        prob = self.parent(customers, X.mix(word))
        prob = np.where(own >= 0, self.word_prob[np.maximum(own, 0)], prob) if len(self.word_prob) else prob
        return t, prob


def _index(word: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.full(len(word), -1)
    i = np.minimum(np.searchsorted(frequent, word), len(frequent) - 1)
    return np.where(frequent[i] == word, i, -1)


BLOCK = 4096


def _sums(rows: DataFrame, size: int) -> np.ndarray:
    """Adds vectors that came in blocks; the result has a fixed size."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in table.column("packed"):
            v = unpack(x.as_buffer())[0]
            total[: len(v)] += v.astype(np.int64)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "packed": pa.array([pack(total)], pa.binary())})

    out = np.zeros(-(-size // BLOCK) * BLOCK, np.int64)
    for r in rows.groupBy("block").applyInArrow(add, "block int, packed binary").collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = unpack(r.packed)[0]
    return out[:size]


def _blocks(v: np.ndarray) -> pa.RecordBatch:
    parts = [(i // BLOCK, v[i : i + BLOCK]) for i in range(0, len(v), BLOCK)]
    parts = [(k, pack(small(x))) for k, x in parts if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["block", "packed"])


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    n_buckets = buckets(docs, 64 << 20)
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("d"), F.coalesce(fold != HELD, F.lit(True)).alias("train"), F.col(text).alias("x"))

    def pieces(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """Token, one before, document and training mark, some millions at a time."""
        held, size = [], 0
        for b in batches:
            ids, train = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            for t in X.texts(b.column(2)):
                tok, before, row = tokens(t)
                row = row + t.first
                if not every:
                    use = train[row]
                    tok, before, row = tok[use], before[use], row[use]
                held.append((tok, before, ids[row], train[row]))
                size += len(tok)
                if size >= GATHER:
                    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held, size = [], 0
        if size:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tok, *_ in pieces(batches, False):
            h, n = np.unique(tok, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counts = settle(rows.mapInArrow(singles, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    v, total = (int(x or 0) for x in counts.agg(F.count("*"), F.sum("n")).first())
    frequent, frequent_n = at_most(counts, "h", "n", FREQUENT)
    discard(counts)
    shared = sc.broadcast((frequent, frequent_n))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trained counts of each bucket, and the contexts that held-out tokens ask for there."""
        own = shared.value[0]
        for tok, before, _, train in pieces(batches, True):
            ctx = contexts(before, own)
            held = ~train & (ctx >= CONTEXTS)
            asked, asked_at = ctx[held], _bucket(tok[held], ctx[held], own, n_buckets)
            tok, ctx = tok[train], ctx[train]
            order = np.lexsort((ctx, tok))
            tok, ctx = tok[order], ctx[order]
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (ctx[1:] != ctx[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(tok)))
            tok, ctx = tok[at], ctx[at]
            order, ptr = by_bucket(_bucket(tok, ctx, own, n_buckets), n_buckets)
            asked_order, asked_ptr = by_bucket(asked_at, n_buckets)
            out = []
            for i in np.flatnonzero(np.diff(ptr) + np.diff(asked_ptr)):
                k = order[ptr[i] : ptr[i + 1]]
                w, start = firsts(tok[k])
                out.append((int(i), squeeze(pack(w, small(np.diff(np.append(start, len(k)))), *narrow(ctx[k]), small(n[k]), np.unique(asked[asked_order[asked_ptr[i] : asked_ptr[i + 1]]])))))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "packed"])

    def firsts(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.ones(len(w), bool)
        new[1:] = w[1:] != w[:-1]
        return w[new], np.flatnonzero(new)

    def placed(code: np.ndarray, rare: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return code, small(np.searchsorted(ids, rare))

    def gather(group: pa.Table) -> pa.Table:
        ws, cs, ns, asked = [], [], [], []
        for x in group.column("packed"):
            w, k, code, rare, n, a = unsqueeze(x.as_buffer())
            ctx = code.astype(np.uint64)
            ctx[code == CONTEXTS] = rare
            ws.append(np.repeat(w, k))
            cs.append(ctx)
            ns.append(n.astype(np.int64))
            asked.append(a)
        w, ctx, n = np.concatenate(ws), np.concatenate(cs), np.concatenate(ns)
        ids = np.unique(np.concatenate([ctx[ctx >= CONTEXTS], *asked]))
        order = np.lexsort((ctx, w))
        w, ctx, n = w[order], ctx[order], n[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (ctx[1:] != ctx[:-1])
        at = np.flatnonzero(new)
        n, w, ctx = np.add.reduceat(n, at) if len(at) else n, w[at], ctx[at]
        first_w, start = firsts(w)
        packed = squeeze(pack(first_w, small(np.diff(np.append(start, len(w)))), *placed(*narrow(ctx), ids), small(n), ids))
        return pa.table({"bucket": group.column("bucket")[:1], "packed": pa.array([packed], pa.binary())})

    state = settle(rows.mapInArrow(deal, "bucket int, packed binary").groupBy("bucket").applyInArrow(gather, "bucket int, packed binary"))

    def opened(packed) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        w, k, code, place, n, ids = unsqueeze(packed.as_buffer())
        ptr, ctx = np.concatenate([[0], np.cumsum(k, dtype=np.int64)]), code.astype(np.int32)
        ctx[code == CONTEXTS] += place.astype(np.int32)
        return (w, _index(w, shared.value[0]), ptr, ctx, n.astype(np.int32)), ids

    slots = 2 * CONTEXTS + FREQUENT + 6

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Customers and least tables of each context; contexts of each frequent word; hard groups and least tables of the
        contexts that are not frequent; counts of counts; the parent's tables."""
        out = np.zeros(slots, np.int64)
        for b in batches:
            for x in b.column(1):
                (w, own, ptr, ctx, n), _ = opened(x)
                fixed = ctx < CONTEXTS
                out[:CONTEXTS] += np.bincount(ctx[fixed], weights=n[fixed], minlength=CONTEXTS).astype(np.int64)
                out[CONTEXTS : 2 * CONTEXTS] += np.bincount(ctx[fixed], minlength=CONTEXTS)
                k, has = np.diff(ptr), own >= 0
                out[2 * CONTEXTS : 2 * CONTEXTS + FREQUENT] += np.bincount(own[has], weights=k[has], minlength=FREQUENT).astype(np.int64)
                out[-6:-4] += [_hard(own, ptr, ctx, n).sum(), (~fixed).sum()]
                out[-4:-2] += [(n == 1).sum(), (n == 2).sum()]
                out[-2:] += [(k[~has] == 1).sum(), (k[~has] == 2).sum()]
        yield _blocks(out)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of each bucket that are not frequent, with their customers and least tables there and whether hard groups need them."""
        for b in batches:
            for bucket, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                (_, own, ptr, ctx, n), ids = opened(x)
                at = np.where(ctx >= CONTEXTS, ctx - CONTEXTS, len(ids))
                customers = np.bincount(at, weights=n, minlength=len(ids) + 1)[:-1].astype(np.int64)
                tables = np.bincount(at, minlength=len(ids) + 1)[:-1]
                needed = np.bincount(at[_hard(own, ptr, ctx, n)], minlength=len(ids) + 1)[:-1] > 0
                yield posted(bucket, ids, customers, tables, needed)

    def posted(bucket: int, ids: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
        order, ptr = by_bucket(_home(ids, n_buckets), n_buckets)
        homes = np.flatnonzero(np.diff(ptr))
        packed = [pack(ids[k], *[small(v[k]) for v in values]) for k in (order[ptr[i] : ptr[i + 1]] for i in homes)]
        return pa.RecordBatch.from_arrays([pa.array(homes, pa.int32()), pa.array([bucket] * len(homes), pa.int32()), pa.array(packed, pa.binary())], ["home", "bucket", "packed"])

    def met(group: pa.Table) -> tuple[list, np.ndarray, list]:
        """Rows that were posted to one home, their contexts, and the place of each row's contexts among these."""
        posts = [unpack(x.as_buffer()) for x in group.column("packed")]
        ids, at = np.unique(np.concatenate([p[0] for p in posts]), return_inverse=True)
        return posts, ids, np.split(at, np.cumsum([len(p[0]) for p in posts])[:-1])

    def added(posts: list, at: list, column: int, size: int) -> np.ndarray:
        total = np.zeros(size, np.int64)
        for p, i in zip(posts, at, strict=True):
            total[i] += p[column].astype(np.int64)
        return total

    def replied(buckets_, kind: int, packed: list) -> pa.Table:
        return pa.table({"bucket": buckets_, "kind": pa.array([kind] * len(packed), pa.int32()), "packed": pa.array(packed, pa.binary())})

    def least(group: pa.Table) -> pa.Table:
        posts, ids, at = met(group)
        tables = added(posts, at, 2, len(ids))
        return replied(group.column("bucket"), 1, [pack(p[0][p[3] > 0], small(tables[i][p[3] > 0])) for p, i in zip(posts, at, strict=True)])

    def more(group: pa.Table) -> pa.Table:
        posts, ids, at = met(group)
        tables = added(posts, at, 1, len(ids))
        return replied(group.column("bucket"), 2, [pack(p[0], small(tables[i])) for p, i in zip(posts, at, strict=True)])

    def whole(group: pa.Table) -> pa.Table:
        """Customers and, for each sample, tables of the contexts that a bucket asked for."""
        posts, ids, at = met(group)
        kinds = group.column("kind").to_pylist()
        of = lambda kind: ([p for p, k in zip(posts, kinds, strict=True) if k == kind], [i for i, k in zip(at, kinds, strict=True) if k == kind])
        customers, tables = (added(*of(0), column, len(ids)) for column in (1, 2))
        samples = [tables + added(*of(1 + j), 1, len(ids)) for j in range(SAMPLES)]
        packed = [pack(p[0], small(customers[i]), *[small(x[i]) for x in samples]) for p, i in zip(*of(0), strict=True)]
        out = replied(group.filter(pc.equal(group.column("kind"), 0)).column("bucket"), 2, packed)
        return out.append_column("lot", pa.array([0] * len(packed), pa.int64())).select(["bucket", "kind", "lot", "packed"])

    def set_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hard groups of each bucket."""
        for b in batches:
            for bucket, x in zip(b.column(0), b.column(1), strict=True):
                groups, ids = opened(x)
                hard = _hard(*groups[1:])
                if hard.any():
                    w, _, ptr, ctx, n = _part(hard, *groups)
                    rare = ctx >= CONTEXTS
                    kept, place = np.unique(ctx[rare], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([bucket.as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([squeeze(pack(w, small(np.diff(ptr)), np.minimum(ctx, CONTEXTS).astype(np.uint16), small(place), small(n), ids[kept - CONTEXTS]))], pa.binary())], ["bucket", "kind", "packed"])

    first = _sums(state.mapInArrow(start, "block int, packed binary"), slots)
    share = lambda a, b: min(0.95, max(0.1, a / (a + 2 * b))) if a else 0.5
    d, d1 = share(*map(int, first[-4:-2])), share(*map(int, first[-2:]))
    customers, tables = first[:CONTEXTS].astype(float), first[CONTEXTS : 2 * CONTEXTS].astype(float)
    word_customers, top, others = first[2 * CONTEXTS : 2 * CONTEXTS + FREQUENT], float(v), float(first[-5])
    asks = settle(state.mapInArrow(ask, "home int, bucket int, packed binary"))
    apart = []
    known, extra, has_hard = asks.withColumn("kind", F.lit(0)), None, bool(first[-6])
    if has_hard:
        apart = [settle(state.mapInArrow(set_apart, "bucket int, kind int, packed binary")), settle(asks.groupBy("home").applyInArrow(least, "bucket int, kind int, packed binary"))]
        hard = apart[0].union(apart[1])

    def seated(out: np.ndarray, m: Model, groups: tuple, ids: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Tables of these groups, which are added to the sums in out."""
        _, own, ptr, ctx, _ = groups
        if not len(own):
            return np.zeros(0, np.int64)
        t, _ = m.sweep(*groups, ids, rest)
        fixed = ctx < CONTEXTS
        out[CONTEXTS : 2 * CONTEXTS] += np.bincount(ctx[fixed], weights=t[fixed], minlength=CONTEXTS).astype(np.int64)
        per, has = np.add.reduceat(t, ptr[:-1]), own >= 0
        out[2 * CONTEXTS : 2 * CONTEXTS + FREQUENT] += np.bincount(own[has], weights=per[has], minlength=FREQUENT).astype(np.int64)
        out[-5] += t[~fixed].sum()
        out[-1] += m.seated[~has].sum()
        return t

    models = []
    for k in range(BURN + SAMPLES):
        m = Model(customers, tables, word_customers[: len(frequent)], d, d1, v, k, others)
        m.top = top
        m.word_prob = m.parent(m.word_customers, X.mix(frequent))
        frequent_tables = int(m.seated.sum())
        if k >= BURN:
            models.append(m)
            if extra is not None:
                known = known.union(extra.select("home", "bucket", "packed", F.lit(1 + k - BURN).alias("kind")))
        if k == BURN + SAMPLES - 1:
            break
        held = sc.broadcast(m)

        def sweep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            out, m = np.zeros(slots, np.int64), held.value
            for b in batches:
                for x in b.column(1):
                    groups, ids = opened(x)
                    seated(out, m, _part(~_hard(*groups[1:]), *groups), ids, np.zeros(len(ids)))
            yield _blocks(out)

        def sweep_hard(group: pa.Table) -> pa.Table:  # run at once, so it takes this sweep's model
            kinds, packed = group.column("kind").to_pylist(), group.column("packed")
            groups, ids = opened(packed[kinds.index(0)])
            rest, out = np.zeros(len(ids)), np.zeros(slots, np.int64)
            for kind, x in zip(kinds, packed, strict=True):
                if kind:
                    i, n = unpack(x.as_buffer())
                    rest[np.searchsorted(ids, i)] += n
            t, ctx = seated(out, held.value, groups, ids, rest), groups[3]
            rare = ctx >= CONTEXTS
            post = posted(group.column("bucket")[0].as_py(), ids, np.bincount(ctx[rare] - CONTEXTS, weights=t[rare] - 1, minlength=len(ids)).astype(np.int64))
            sums = _blocks(out)
            sums = pa.RecordBatch.from_arrays([sums.column(0), pa.array([-1] * len(sums), pa.int32()), sums.column(1)], ["home", "bucket", "packed"])
            return pa.Table.from_batches([post, sums])

        parts = state.mapInArrow(sweep, "block int, packed binary")
        if has_hard:
            groups = hard if extra is None else hard.union(extra.groupBy("home").applyInArrow(more, "bucket int, kind int, packed binary"))
            new = settle(groups.groupBy("bucket").applyInArrow(sweep_hard, "home int, bucket int, packed binary"))
            parts = parts.union(new.where("bucket < 0").select("home", "packed"))
            extra = new.where("bucket >= 0")
        found = _sums(parts, slots)
        tables, word_customers = found[CONTEXTS : 2 * CONTEXTS].astype(float), found[2 * CONTEXTS : 2 * CONTEXTS + FREQUENT]
        top, others = float(found[-1] + frequent_tables), float(found[-5])
    chain = sc.broadcast(models)

    least_hot = max(total / (HOT * n_buckets), 2)

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of frequent words that are hot, with their customers."""
        for b in batches:
            for x in b.column(1):
                (w, own, ptr, ctx, n), _ = opened(x)
                at = np.repeat(np.arange(len(w)), np.diff(ptr))
                hot = (own[at] >= 0) & (ctx < CONTEXTS) & (n >= least_hot) if len(w) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(w[at[hot]].view(np.int64)), pa.array(ctx[hot].astype(np.int64)), pa.array(n[hot].astype(np.int64))], ["w", "ctx", "n"])

    hot = state.mapInArrow(most, "w long, ctx long, n long").toArrow()
    discard(state, *apart)  # scoring counts anew, beside the tokens
    hot_w, hot_ctx, hot_n = (hot[c].to_numpy() for c in ("w", "ctx", "n"))
    hot_w = hot_w.view(np.uint64)
    hot_key = X.mix(hot_w + (hot_ctx.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(hot_key)
    hot_w, hot_ctx, hot_n, hot_key = hot_w[order], hot_ctx[order], hot_n[order], hot_key[order]
    hot_own, alone, mean = _index(hot_w, frequent), np.arange(len(hot_w) + 1), np.zeros(len(hot_w))
    for m in models:
        t, prob = m.sweep(hot_w, hot_own, alone, hot_ctx, hot_n)
        mean += (np.maximum(hot_n - m.d * t, 0) + (STRENGTH + m.d * m.tables[hot_ctx]) * prob) / (STRENGTH + m.customers[hot_ctx])
    hot_base = np.log10(frequent_n[np.maximum(hot_own, 0)] + 1.0) if len(hot_w) else mean
    hottest = sc.broadcast((hot_key, hot_w, hot_ctx, hot_base, np.log10(mean / max(len(models), 1)) if len(hot_w) else mean))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed tokens for each bucket, and for each lot of documents that was read together its ids, once."""
        own, part = shared.value[0], TaskContext.get().partitionId()
        for lot, (tok, before, doc, train) in enumerate(pieces(batches, True), part << 32):
            ctx = contexts(before, own)
            ids, one, doc = np.unique(doc, return_index=True, return_inverse=True)
            train = train[one]
            key, hot_w, hot_ctx, hot_base, hot_score = hottest.value
            sums = [np.zeros(len(ids))] * 3
            if len(key):
                i = np.minimum(np.searchsorted(key, X.mix(tok + (ctx + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))), len(key) - 1)
                here = (hot_w[i] == tok) & (hot_ctx[i].astype(np.uint64) == ctx)
                at, i = doc[here], i[here]
                sums = [np.bincount(at, weights=x, minlength=len(ids)) for x in (None, hot_base[i], hot_score[i])]
                tok, ctx, doc = tok[~here], ctx[~here], doc[~here]
            order = np.argsort(tok, kind="stable")
            tok, ctx, doc = tok[order], ctx[order], doc[order]
            order, ptr = by_bucket(_bucket(tok, ctx, own, n_buckets), n_buckets)
            out = [(lot % n_buckets, 1, pack(ids, ~train, small(sums[0].astype(np.int64)), *sums[1:]))]
            for i in np.flatnonzero(np.diff(ptr)):
                k = order[ptr[i] : ptr[i + 1]]
                at = np.flatnonzero(np.append(True, tok[k][1:] != tok[k][:-1]))
                who, local = np.unique(doc[k], return_inverse=True)
                out.append((int(i), 0, squeeze(pack(tok[k][at], small(np.diff(np.append(at, len(k)))), *narrow(ctx[k]), small(who), np.packbits(train[who]), small(local)))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([lot] * len(out), pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "kind", "lot", "packed"])

    def add_rates(cols: list, w: np.ndarray, ctx: np.ndarray, doc: np.ndarray, train: np.ndarray, ids: np.ndarray, customers: np.ndarray, tables: list) -> None:
        """Adds all tokens of some words to their documents' numbers of tokens and of known ones, and sums of logarithms."""
        frequent, frequent_n = shared.value
        order = np.lexsort((ctx, w))
        w, ctx, doc, train = w[order], ctx[order], doc[order], train[order]
        new_w = np.ones(len(w), bool)
        new_w[1:] = w[1:] != w[:-1]
        new = new_w.copy()
        new[1:] |= ctx[1:] != ctx[:-1]
        at, kind = np.flatnonzero(new), np.cumsum(new) - 1
        c = np.add.reduceat(train.astype(np.int64), at)
        word, kctx = w[np.flatnonzero(new_w)], ctx[at].astype(np.int64)
        ptr = np.append(np.flatnonzero(new_w[at]), len(at))
        own = _index(word, frequent)
        mean = np.zeros(len(at))
        of = np.repeat(np.arange(len(word)), np.diff(ptr))
        for m, rest in zip(chain.value, tables, strict=True):
            t, prob = m.sweep(word, own, ptr, kctx, c, ids, rest)
            mean += (np.maximum(c - m.d * t, 0) + (STRENGTH + m.d * np.append(m.tables, rest)[kctx]) * prob[of]) / (STRENGTH + np.append(m.customers, customers)[kctx])
        n = np.add.reduceat(c, ptr[:-1])
        n = np.where(own >= 0, frequent_n[np.maximum(own, 0)], n) if len(frequent) else n
        each = n[of]
        for total_, x in zip(cols, (None, (each > 0)[kind], np.log10(each + 1.0)[kind], np.log10(mean / len(chain.value))[kind]), strict=True):
            total_ += np.bincount(doc, weights=x, minlength=len(total_)).astype(total_.dtype)

    def rate(group: pa.Table) -> pa.Table:
        back = group.filter(pc.equal(group.column("kind"), 1)).select(["lot", "kind", "packed"])
        totals = [unpack(x.as_buffer()) for x in group.filter(pc.equal(group.column("kind"), 2)).column("packed")]
        group = group.filter(pc.equal(group.column("kind"), 0))
        if not group.num_rows:
            return back
        ids, customers, *tables = (np.concatenate(x) for x in zip(*totals, strict=True)) if totals else [np.zeros(0, np.uint64)] * (2 + SAMPLES)
        order = np.argsort(ids)
        ids, customers, tables = ids[order], customers[order], [x[order] for x in tables]
        packets = [unsqueeze(x.as_buffer()) for x in group.column("packed")]
        names = [who for _, _, _, _, who, _, _ in packets]
        docs_upto = np.concatenate([[0], np.cumsum([len(who) for who in names])])
        cols = [np.zeros(docs_upto[-1], np.int64), np.zeros(docs_upto[-1], np.int64), np.zeros(docs_upto[-1]), np.zeros(docs_upto[-1])]
        slices = max(1, -(-sum(len(at) for *_, at in packets) // SLICE))
        edges = np.array([q * (1 << 64) // slices for q in range(1, slices)], np.uint64)
        # where each slice of words starts in a packet: among its words, tokens, and tokens whose context is not frequent
        cuts = [np.concatenate([[0], np.searchsorted(w, edges), [len(w)]]) for w, *_ in packets]
        tokens_at = [np.concatenate([[0], np.cumsum(k, dtype=np.int64)])[c] for (_, k, *_), c in zip(packets, cuts, strict=True)]
        rare_at = [np.concatenate([[0], np.cumsum(code == CONTEXTS)])[c] for (_, _, code, *_), c in zip(packets, tokens_at, strict=True)]
        for q in range(slices):
            ws, cs, ds, ts = [], [], [], []
            for (w, k, code, rare, who, train, at), first_doc, c, t, r in zip(packets, docs_upto, cuts, tokens_at, rare_at, strict=False):
                words, here = slice(c[q], c[q + 1]), slice(t[q], t[q + 1])
                ws.append(np.repeat(w[words], k[words]))
                cs.append(local(code[here], rare[r[q] : r[q + 1]], ids))
                ds.append(at[here].astype(np.int32) + np.int32(first_doc))
                ts.append(np.unpackbits(train, count=len(who)).astype(bool)[at[here]])
            w, ctx, doc, train = (np.concatenate(x) for x in (ws, cs, ds, ts))
            if len(w):
                add_rates(cols, w, ctx, doc, train, ids, customers, tables)
        packed = [pack(who, small(cols[0][a:b]), small(cols[1][a:b]), cols[2][a:b], cols[3][a:b].astype(np.float32)) for who, a, b in zip(names, docs_upto[:-1], docs_upto[1:], strict=True)]
        rated = pa.table({"lot": group.column("lot"), "kind": group.column("kind"), "packed": pa.array(packed, pa.binary())})
        return pa.concat_tables([back.combine_chunks(), rated.combine_chunks()])

    def total_up(group: pa.Table) -> pa.Table:
        """A lot's documents, and their sums over all buckets."""
        ids, held_out, n_hot, base, score_ = unpack(group.filter(pc.equal(group.column("kind"), 1)).column("packed")[0].as_buffer())
        sums = np.stack([n_hot, n_hot, base, score_]).astype(float)
        for x in group.filter(pc.equal(group.column("kind"), 0)).column("packed"):
            who, *cols = unpack(x.as_buffer())
            for total_, c in zip(sums, cols, strict=True):
                total_[who] += c
        return pa.table({"d": ids, "held_out": held_out, "n_tokens": sums[0].astype(np.int64), "n_known": sums[1].astype(np.int64), "base": sums[2], "score": sums[3]})

    parts = rows.mapInArrow(send, "bucket int, kind int, lot long, packed binary")
    parts = parts.union(known.groupBy("home").applyInArrow(whole, "bucket int, kind int, lot long, packed binary")).groupBy("bucket").applyInArrow(rate, "lot long, kind int, packed binary")
    out = parts.groupBy("lot").applyInArrow(total_up, "d long, held_out boolean, n_tokens long, n_known long, base double, score double")
    # documents whose rows were read in several lots
    out = out.groupBy("d").agg(F.bool_and("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return out.select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * math.log10(total + v + 1)).alias("base_score"), "score")
