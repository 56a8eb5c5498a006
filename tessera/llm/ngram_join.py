"""N-gram Jaccard self-join: size-aware, heavy-light, exact.

A document's set is its distinct five-word shingles. Sets of at most L shingles
enumerate their subsets of every size that a link could share; two such sets link only if
they share one of those. Larger sets put a prefix of their shingles, rarest
first, into inverted lists; L is where the estimated cost of the two is least. The order of the
shingles is any fixed total order, so a table of the HEAVY most repeated ones, bounded
in size and estimated within tasks, is enough to keep long lists out of the prefixes.

Identical sets are one class. Lists are resolved in two rounds, and neither expands a
group of copies to all its pairs: first each member is held against one document, the smallest of the lists
that it shares most often, and components are formed from the pairs that pass; then only pairs whose ends lie in different
components are counted, over all lists. Every pair that counts is verified on the whole sets.

Bound used: if J(a, b) >= 0.8 then |a & b| >= 0.8 max(|a|, |b|), so the first
|a| - ceil(0.8 |a|) + l shingles of a, and those of b, share at least l.

Defined results: null or empty texts, and texts without words, have an empty set,
link with nothing and are their own component; fewer than five words make one shingle;
rows with equal doc_id count as one document only if their sets are equal too, and
share a component in any case; rows without doc_id have a set, but link with nothing and have no
component; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .components import components
from .spread import at_most, buckets, by_bucket, discard, lean, lean_group, pack, settle, small, unpack

SHINGLE = 5
PERCENT = 80
HEAVY = 400_000
SMALL_MOST = 12
BROADCAST_ROWS = 1_000_000
GATHER = 1_000_000
LIGHT = 32
#: A long list is multiplied in tasks of two blocks of about so many documents, and there in pieces of so many keys.
ROWS, COLUMNS = 1024, 1024


def need(n):
    """The least overlap of a set of n with any partner."""
    return -(-n * PERCENT // 100)


def share(n):
    """Prefix shingles that a pair must share, by its smaller set."""
    return 1 + n // 20


def shingle_sets(t: X.Texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    w = X.words(t, lower=True)
    at, h = X.windows(w, SHINGLE)
    doc = w.doc
    ptr = np.searchsorted(doc[at], np.arange(len(t) + 1)) if len(at) else np.zeros(len(t) + 1, np.int64)
    out = [np.unique(h[a:b]) for a, b in itertools.pairwise(ptr)]
    n_words = np.diff(w.ptr)
    for k in range(1, SHINGLE):
        if (n_words == k).any():
            at, h = X.windows(w, k)
            row = doc[at]
            for i in np.flatnonzero(n_words[row] == k):
                out[row[i]] = X.mix(h[i : i + 1] + np.uint64(k))
    return out


def _prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each set that depend on its members alone."""
    ends = np.cumsum([0, *map(len, sets)])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(X.mix(flat ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return out[0], out[1]


def survey(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, n, the set's prints (k1, k2); kind 1: shingle k1, seen in n sets of a task's share, where n > 1."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], None] = {}
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            h, n = h[n > 1], n[n > 1]
            z = np.zeros(len(h), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), pa.array(z), pa.array(n), pa.array(h.view(np.int64)), pa.array(z)], ["kind", "doc_id", "n", "k1", "k2"])

        for b in batches:
            ids = b.column(0)
            for t in X.texts(b.column(1)):
                sets = shingle_sets(t)
                p1, p2 = _prints(sets)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), ids.slice(t.first, len(t)), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(p1), pa.array(p2)], ["kind", "doc_id", "n", "k1", "k2"])
                for s, a, c in zip(sets, p1, p2, strict=True):
                    if (int(a), int(c)) not in seen:
                        seen[int(a), int(c)] = None
                        held.append(s)
                        size += len(s)
                if size >= 2 * GATHER:
                    yield flush()
                    held, size = [], 0
                    seen.clear()
        if size:
            yield flush()

    return docs.mapInArrow(lean(look), "kind int, doc_id long, n long, k1 long, k2 long")


def _heavy(found: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The most repeated shingles, sorted, with their counts, HEAVY at most; and how many others share a shingle's list."""
    counts = settle(found.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")))
    h, n = at_most(counts, "k1", "n", HEAVY)
    total = found.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    light = counts.where(F.col("n") < int(n.min())) if len(n) else counts
    scan = float(light.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0) / max(total, 1)
    discard(counts)
    return h, n, scan


def boundary(sizes: dict[int, int], scan: float) -> int:
    """L: the largest size whose sets enumerate subsets, by the least estimated number of postings made and scanned."""

    def cost(most: int) -> float:
        subsets = sum(c * sum(math.comb(n, k) for k in range(need(n), n + 1)) for n, c in sizes.items() if n <= most)
        lists = sum(c * (n - need(n) + share(n)) * (1 + scan) for n, c in sizes.items() if n >= need(most + 1))
        return subsets + lists

    return min(range(SMALL_MOST + 1), key=lambda k: (cost(k), -k))


def _keys(s: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """The list keys of one set; rank: 0 for shingles that aren't heavy, else more the more there are."""
    n = len(s)
    out = []
    if 0 < n <= most:
        for k in range(need(n), n + 1):
            for pick in itertools.combinations(range(n), k):
                out.append(X.mix(np.array([np.add.reduce(X.mix(s[list(pick)])) + np.uint64(k)], np.uint64)))
    if n >= max(1, need(most + 1)):
        order = np.argsort(rank, kind="stable") if rank.any() else slice(None)
        out.append(s[order][: n - need(n) + share(n)])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_MARK = np.uint64(64 - 23)


def marked(heavy: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heavy shingles, their counts, and bits for a first look at whether a shingle is one."""
    marks = np.zeros(1 << 23, bool)
    marks[(heavy[0] >> _MARK).astype(np.int64)] = True
    return heavy[0], heavy[1], np.packbits(marks)


def postings(docs: DataFrame, heavy: Broadcast, most: int) -> DataFrame:
    """kind 0: list key k, document a of b shingles. kind 1: documents a < b share c list keys; from lists of two and more.

    A document's sets are dealt in packed rows by key. Kind 1 holds the lists' smallest documents against their others, if they could
    link by size: for each other document b that a whose lists hold it most often, of each bucket. heavy: see marked().
    """
    n_buckets = buckets(docs)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, bits = heavy.value
        mark = np.unpackbits(bits).astype(bool)
        seen: set[tuple[int, int]] = set()
        ids, sizes, keys, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            k = np.concatenate(keys)
            doc = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
            order, ptr = by_bucket((k >> np.uint64(33)).astype(np.int64) % n_buckets, n_buckets)
            out = []
            for i in np.flatnonzero(np.diff(ptr)):
                at = order[ptr[i] : ptr[i + 1]]
                who, local = np.unique(doc[at], return_inverse=True)
                out.append((int(i), pack(np.array(ids, np.int64)[who], small(np.array(sizes)[who]), small(local), k[at])))
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "packed"])

        for b in batches:
            rows = b.column(0).to_numpy()
            for t in X.texts(b.column(1)):
                sets = shingle_sets(t)
                p1, p2 = _prints(sets)
                flat = np.concatenate(sets)
                rank = np.zeros(len(flat), np.int64)
                maybe = np.flatnonzero(mark[(flat >> _MARK).astype(np.int64)])
                if len(maybe) and len(hashes):
                    i = np.minimum(np.searchsorted(hashes, flat[maybe]), len(hashes) - 1)
                    rank[maybe] = np.where(hashes[i] == flat[maybe], counts[i], 0)
                end = 0
                for j, s in enumerate(sets):
                    start, end = end, end + len(s)
                    if len(s) and (int(p1[j]), int(p2[j])) not in seen:
                        seen.add((int(p1[j]), int(p2[j])))
                        ids.append(rows[t.first + j])
                        sizes.append(len(s))
                        keys.append(_keys(s, rank[start:end], most))
                        size += len(keys[-1])
                if size >= GATHER:
                    yield flush()
                    ids, sizes, keys, size = [], [], [], 0
                    seen.clear()
        if size:
            yield flush()

    def match(group: pa.Table) -> pa.Table:
        ids, sizes, keys = [], [], []
        for x in group.column("packed"):
            who, n, local, k = unpack(x.as_buffer())
            ids.append(who[local])
            sizes.append(n[local].astype(np.int64))
            keys.append(k)
        ids, sizes, keys = np.concatenate(ids), np.concatenate(sizes), np.concatenate(keys)
        order = np.lexsort((ids, keys))
        ids, sizes, keys = ids[order], sizes[order], keys[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        ids, sizes, keys = ids[once], sizes[once], keys[once]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(keys)))
        lists = np.repeat(length, length) > 1
        first = np.repeat(start, length)[lists]
        a, b, n, m, k = ids[first], ids[lists], sizes[first], sizes[lists], keys[lists]
        star = (a != b) & (np.minimum(n, m) * 100 >= PERCENT * np.maximum(n, m))
        pair = np.stack([a[star], b[star], np.minimum(n, m)[star]], axis=1)
        if len(pair):
            order = np.lexsort((pair[:, 0], pair[:, 1]))
            pair = pair[order]
            new = np.ones(len(pair), bool)
            new[1:] = (pair[1:, :2] != pair[:-1, :2]).any(axis=1)
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(pair)))
            pair = pair[at]
            order = np.lexsort((pair[:, 0], -count, pair[:, 1]))
            best = order[np.append(True, pair[order][1:, 1] != pair[order][:-1, 1])]
            pair, count = pair[best], count[best]
        else:
            count = np.zeros(0, np.int64)
        kind = np.repeat(np.array([0, 1], np.int32), [len(k), len(pair)])
        return pa.table({"kind": kind, "k": np.concatenate([k.view(np.int64), pair[:, 2]]), "a": np.concatenate([b, pair[:, 0]]), "b": np.concatenate([m, pair[:, 1]]), "c": np.concatenate([np.ones(len(k), np.int64), count])})

    return docs.mapInArrow(lean(deal), "bucket int, packed binary").groupBy("bucket").applyInArrow(lean_group(match), "kind int, k long, a long, b long, c long")


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs a < b whose whole sets link. Members of one a are dealt in groups of 256, each beside a's own text."""
    pairs = settle(pairs.select("a", "b").distinct())
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("s"))
    dealt = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("s")).alias("s"))
    heads = dealt.select("a", F.col("a").alias("b"), "s").distinct()
    dealt = settle(dealt.union(heads))
    few = dealt.count() <= BROADCAST_ROWS
    rows = docs.join(F.broadcast(dealt) if few else dealt, F.col("doc_id") == F.col("b")).select("a", "s", "b", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "a", "s").sortWithinPartitions("a", "s", "b")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, s, b = (batch.column(i).to_numpy() for i in range(3))
            good = []
            for t in X.texts(batch.column(3)):
                for j, x in enumerate(shingle_sets(t), t.first):
                    if a[j] == b[j]:
                        head, own = (a[j], s[j]), x
                        continue
                    if head != (a[j], s[j]):
                        continue  # the head has no row: no such document
                    both = len(np.intersect1d(own, x, assume_unique=True))
                    if both and 100 * both >= PERCENT * (len(own) + len(x) - both):
                        good.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    out = settle(rows.mapInArrow(lean(hold), "a long, b long"))
    discard(pairs, dealt)
    return out


def least_shared(n, m):
    """List keys that sets of n and m must share to link: their least overlap, less what may lie behind a prefix."""
    behind = lambda k: F.ceil(k * PERCENT / 100.0) - 1 - F.floor(k / 20)  # noqa: E731  need(k) - share(k)
    return F.greatest(F.lit(1), F.ceil((n + m) * PERCENT / (100.0 + PERCENT)) - F.greatest(behind(n), behind(m))).cast("long")


def links_of(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which sets link with a set; all sorted."""
    out = np.zeros(len(others), bool)
    lo = 0
    while lo < len(others):
        hi, size = lo, 0
        while hi < len(others) and (hi == lo or size + len(others[hi]) <= GATHER):
            size += len(others[hi])
            hi += 1
        flat, sizes = np.concatenate(others[lo:hi]), np.array([len(x) for x in others[lo:hi]])
        both = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, np.cumsum(sizes) - sizes).astype(np.int64)
        out[lo:hi] = 100 * both >= PERCENT * (len(own) + sizes - both)
        lo = hi
    return out


def whole_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set: the sets of the documents that nodes names."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in X.texts(b.column(1)):
                sets = shingle_sets(t)
                ends = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, len(t)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["node", "set"])

    few = nodes.select(F.col("node").alias("_node")).distinct()
    return docs.join(few, F.col("doc_id") == F.col("_node"), "left_semi").select("doc_id", "text").mapInArrow(lean(make), "node long, set array<long>")


def candidates(docs: DataFrame, left: DataFrame, most: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Pairs a < b of different components: those that share keys of short lists, and may link; those of long lists, which do link;
    and the settled tables behind them. left: k, node, n, comp.

    Keys of lists up to LIGHT documents are joined, and counted for each pair, beside the most keys of long lists that
    it could share. The documents of a long list are dealt in blocks of bounded size; two blocks meet in a task, which
    counts the keys that pairs share by a product of matrices and names, in one row for each document, the others that it may link with and shares
    this list with first. Only documents named there are dealt again, with their whole sets, and held against each other. So a pair is a row only if it links.
    """
    sizes = left.groupBy("k").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    sized = settle(left.join(sizes, "k"))
    light, heavy = sized.where(F.col("m") <= LIGHT).drop("m", "total"), sized.where(F.col("m") > LIGHT)
    own = heavy.groupBy("node").agg(F.array_sort(F.collect_list("k")).alias("keys"))
    held = light.join(own.select(F.col("node").alias("_o"), F.size("keys").alias("h")), F.col("node") == F.col("_o"), "left").drop("_o").fillna(0, ["h"])
    x, y = (held.select(*[F.col(c).alias(f"{c}_{s}" if c != "k" else c) for c in held.columns]) for s in "xy")
    pairs = x.join(y, "k").where(f"node_x < node_y and comp_x <> comp_y and least(n_x, n_y) * 100 >= {PERCENT} * greatest(n_x, n_y)")
    pairs = pairs.groupBy(F.col("node_x").alias("a"), F.col("node_y").alias("b")).agg(F.count("*").alias("c"), F.first("n_x").alias("n"), F.first("n_y").alias("m"), F.least(F.first("h_x"), F.first("h_y")).alias("h"))
    # sets up to L may share a single subset only, so one key is enough for them
    pairs = pairs.where((F.least("n", "m") <= most) | (F.col("c") + F.col("h") >= least_shared(F.col("n"), F.col("m")))).select("a", "b")

    def behind(n: np.ndarray) -> np.ndarray:
        return need(n) - share(n)

    def meet(table: pa.Table) -> pa.Table:
        """For documents of block i, those of block j that they may link with and share this list with first (others); and those alone."""
        node, n, comp, block = (table.column(c).to_numpy() for c in ("node", "n", "comp", "block"))
        key, i, j = (table.column(c)[0].as_py() for c in ("k", "i", "j"))
        lists = table.column("keys").combine_chunks()
        words, at, times = np.unique(lists.values.to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(node), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        shared = np.flatnonzero(times > 1)  # keys of one document add nothing; the others are taken in order, some at a time
        place = np.full(len(words), -1, np.int32)
        place[shared] = np.arange(len(shared), dtype=np.int32)
        first = int(place[np.searchsorted(words, key)])
        names, others = [], []
        at = place[at]
        row, at = row[at >= 0], at[at >= 0]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        left_rows, right_rows = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for lo in range(0, len(left_rows) if first >= 0 else 0, ROWS):
            x = left_rows[lo : lo + ROWS]
            for hi in range(0, len(right_rows), ROWS):
                y = right_rows[hi : hi + ROWS]
                total = np.zeros((len(x), len(y)), np.float32)
                for left_, right in itertools.pairwise(sorted({*range(0, len(shared), COLUMNS), first, len(shared)})):
                    if left_ == first:
                        before = total.copy()
                    pick = slice(*np.searchsorted(at, [left_, right]))
                    grid = np.zeros((len(node), right - left_), np.float32)
                    grid[row[pick], at[pick] - left_] = 1
                    total += grid[x] @ grid[y].T
                low, high = np.minimum.outer(n[x], n[y]), np.maximum.outer(n[x], n[y])
                least = -(-(np.add.outer(n[x], n[y]) * PERCENT) // (100 + PERCENT)) - np.maximum.outer(behind(n[x]), behind(n[y]))
                good = np.not_equal.outer(comp[x], comp[y]) & (low * 100 >= PERCENT * high) & ((total >= least) | (low <= most)) & (before == 0)
                if i == j:
                    good &= np.less.outer(node[x], node[y])
                for r in np.flatnonzero(good.any(axis=1)):
                    names.append(node[x[r]])
                    others.append(node[y[good[r]]])
        partners = np.unique(np.concatenate(others)) if others else np.zeros(0, np.int64)
        rows = len(names) + len(partners)
        return pa.table([pa.array([key] * rows, pa.int64()), pa.array([i] * rows, pa.int32()), pa.array([j] * rows, pa.int32()), pa.array(np.concatenate([np.array(names, np.int64), partners])), pa.array(others + [None] * len(partners), pa.list_(pa.int64()))], names=["k", "i", "j", "node", "others"])

    def judge(table: pa.Table) -> pa.Table:
        """The pairs that meet() named and that link."""
        whole = table.column("set").combine_chunks()
        flat, ends = whole.values.to_numpy().view(np.uint64), whole.offsets.to_numpy()
        sets: dict[int, list[np.ndarray]] = {}  # rows that share a doc_id each have a set
        for name, a, b in zip(table.column("node").to_pylist(), ends[:-1], ends[1:], strict=True):
            if not any(np.array_equal(flat[a:b], x) for x in sets.setdefault(name, [])):
                sets[name].append(flat[a:b])
        out = set()
        for name, others in zip(table.column("node").to_pylist(), table.column("others").to_pylist(), strict=True):
            own = [(k, x) for k in others or [] for x in sets.get(k, [])]
            for x in sets[name] if own else []:
                out.update((min(name, k), max(name, k)) for (k, _), hit in zip(own, links_of(x, [s for _, s in own]), strict=True) if hit)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    parts = F.ceil(F.greatest(F.col("m") / ROWS, F.col("total") / GATHER)).cast("int")
    dealt = heavy.join(own, "node").withColumn("block", F.pmod(F.xxhash64("node"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("k", "node", "n", "comp", "keys", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    named = settle(dealt.groupBy("k", "i", "j").applyInArrow(lean_group(meet), "k long, i int, j int, node long, others array<long>"))
    sets = settle(whole_sets(docs, named))
    links = settle(named.join(sets, "node").groupBy("k", "i", "j").applyInArrow(lean_group(judge), "a long, b long"))
    discard(named, sets)
    return pairs, links, [sized]


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach); one row for each row of docs."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = settle(survey(docs))
    docs = docs.where("doc_id is not null")
    own = found.where("kind = 0").select("doc_id", "n", "k1", "k2")
    heavy, heavy_n, scan = _heavy(found)
    sizes = {r.n: r.c for r in own.where("n > 0").groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count("*").alias("c")).collect()}
    most = boundary(sizes, scan)

    full = own.where("n > 0 and doc_id is not null")
    rep = full.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    member = settle(full.join(rep, ["n", "k1", "k2"]).select("doc_id", "rep").distinct())
    links = member.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    table = docs.sparkSession.sparkContext.broadcast(marked((heavy, heavy_n)))
    listed = settle(postings(docs, table, most))
    table.unpersist()
    star = listed.where("kind = 1").select("a", "b", "c", F.col("k").alias("n")).repartition("b").groupBy("b", "a").agg(F.sum("c").alias("c"), F.first("n").alias("n"))
    star = star.groupBy("b").agg(F.max_by(F.struct("a", "n"), F.struct("c", -F.col("a"))).alias("x"), F.max("c").alias("c")).select("b", "x.a", "x.n", "c").where(F.col("c") * 2 >= 1 + F.floor(F.col("n") / 20))
    by = member.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    ra, rb = by.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), by.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb"))
    first = verify(docs, star.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")))
    links = settle(links.union(first.select("b", "a")))
    comp = settle(components(links))

    # second round: pairs whose ends lie in different components, counted over every list
    place = by.join(comp, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("rep").alias("node"), F.coalesce("component", "rep").alias("comp"))
    placed = listed.where("kind = 0").select("k", "a", F.col("b").alias("n")).join(place, F.col("a") == F.col("doc_id")).select("k", "node", "n", "comp")
    placed = placed.repartition("k").dropDuplicates(["k", "node"])  # this one exchange serves the next two steps too
    mixed = placed.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("k")
    left = settle(placed.join(mixed, "k"))
    discard(listed, member, comp, first)
    maybe, linked, behind = candidates(docs, left, most)
    again = verify(docs, maybe)
    every = settle(links.union(again.union(linked).select("b", "a")))
    comp = components(every)
    discard(left, *behind, links, linked, again, every)
    return own.select("doc_id", F.col("n").alias("n_shingles")).join(comp, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs less those that link, directly or by others, with a smaller doc_id; rows that repeat a kept doc_id, or have none, stay."""
    gone = groups(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # so that no name of docs meets one of ours
    own = docs.select(whole, F.col("doc_id").cast("long").alias("_id"))
    return own.join(gone.hint("merge"), F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
