"""Substring dedup over words, by suffix automata of reference shards.

drop_reference() removes from every document the maximal spans of MIN_WORDS words or more that a
reference set holds: its texts are cut into shards of SHARD_WORDS words, each
shard becomes a suffix automaton, shards are broadcast PASS_WORDS words at a time
(a further pass over the documents for every further part), and documents stream past them for their matching
statistics.

drop_repeats() takes the corpus itself as reference. No broadcast holds that, and if each
document streamed past every shard, the work would grow with the square of the corpus, so an exchange of hashed
windows of MIN_WORDS words chooses who meets whom, and no more. A task first resolves its own documents and sends on
only the first occurrence of a window, so a passage of a third of all documents makes one row for each
task. The first occurrences of windows that repeat are the reference: they are dealt in shards by their
document. The spans in which a document's windows start later than one of a shard are sent there, once for all
equal spans of a group of documents, stream past the shard's automaton for their matching statistics, and what it
confirms, word by word, goes. Should a window not be confirmed, as two had one hash, all is done again under another
salt, until a salt under which every match is confirmed: then no word is removed or kept by a collision.

Defined results: null or empty text has no words and loses none; a repeated window of one
document goes where it starts later; rows that share a doc_id are judged as one
document, alike; rows with a null doc_id come after all others, as one; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .spread import buckets, by_bucket, discard, input_bytes, pack, settle, small, unpack

MIN_WORDS = 20
GATHER = 1_000_000
SHARD_WORDS = 50_000
#: Input bytes for each shard of the corpus's own repeats.
SHARD_BYTES = 4 << 20
PASS_WORDS = 1_000_000
LAST = 2**63 - 1


class SuffixAutomaton:
    """Of one sequence of whole numbers; -1 may separate texts, as it matches nothing."""

    def __init__(self, symbols) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        last = 0
        nxt, link, length = self.next, self.link, self.length
        for c in symbols:
            if c == -1:
                last = 0
                continue
            if c in nxt[last]:  # a generalised automaton: the state may be there from an earlier text
                q = nxt[last][c]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def matching(self, symbols) -> np.ndarray:
        """For each position, the length of the longest run ending there that the automaton holds."""
        out = np.zeros(len(symbols), dtype=np.int64)
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for i, c in enumerate(symbols):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(c)
            if to is None:
                state = size = 0
            else:
                state, size = to, size + 1
            out[i] = size
        return out


def covered(matching: np.ndarray, least: int) -> np.ndarray:
    """Positions under a match of at least that length."""
    ends = np.flatnonzero(matching >= least)
    edge = np.zeros(len(matching) + 1, dtype=np.int64)
    np.add.at(edge, ends + 1 - matching[ends], 1)
    np.add.at(edge, ends + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def drop_reference(docs: DataFrame, reference: DataFrame, min_words: int = MIN_WORDS, text: str = "text", counts: str | None = None) -> DataFrame:
    """docs less the words under any match of min_words with a text of reference[text]; kept words are joined by one space.

    Texts that lose nothing stay as they are. Words are known by 64-bit hashes. counts: a column for the words removed.
    """
    sc = docs.sparkSession.sparkContext
    ti = docs.columns.index(text)
    names = [*docs.columns, "_tessera_cut"]
    out = docs.withColumn(names[-1], F.lit(None).cast("binary"))

    def parts() -> Iterator[list[list[int]]]:
        shards, shard, size = [], [], 0
        for row in reference.select(text).where(F.col(text).isNotNull()).toLocalIterator():
            for t in X.texts(pa.array([row[0]])):
                h = X.words(t).hash.tolist()
                if len(h) >= min_words:
                    shard += [*h, -1]
            if len(shard) >= SHARD_WORDS:
                shards.append(shard)
                size, shard = size + len(shard), []
            if size >= PASS_WORDS:
                yield shards
                shards, size = [], 0
        if shard:
            shards.append(shard)
        if shards:
            yield shards

    for shards in parts():
        held = sc.broadcast(shards)

        def mark(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automata = [SuffixAutomaton(s) for s in held.value]
            for b in batches:
                cut = []
                old = b.column(len(names) - 1).to_pylist()
                for t in X.texts(b.column(ti)):
                    w = X.words(t)
                    for i in range(len(t)):
                        h = w.hash[w.ptr[i] : w.ptr[i + 1]].tolist()
                        bits = np.zeros(len(h), bool) if old[t.first + i] is None else np.unpackbits(np.frombuffer(old[t.first + i], np.uint8), count=len(h)).astype(bool)
                        for a in automata:
                            bits |= covered(a.matching(h), min_words)
                        cut.append(np.packbits(bits).tobytes() if bits.any() else None)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(cut, pa.binary())], names)

        out = out.mapInArrow(mark, out.schema)

    kind = docs.schema.add(counts, "long") if counts else docs.schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed = [], []
            for s, cut in zip(b.column(ti).to_pylist(), b.column(len(names) - 1).to_pylist(), strict=True):
                n = 0
                if cut is not None:
                    ws = s.encode().split()
                    keep = ~np.unpackbits(np.frombuffer(cut, np.uint8), count=len(ws)).astype(bool)
                    n = int((~keep).sum())
                    s = b" ".join(compress(ws, keep)).decode()
                texts.append(s)
                removed.append(n)
            cols = list(b.columns[:-1])
            cols[ti] = pa.array(texts, cols[ti].type)
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(removed, pa.int64())] if counts else []), kind.names)

    return out.mapInArrow(apply, kind)


def _later(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices to send on (one first occurrence of each hash), indices that have an earlier occurrence, and the first one of each of these."""
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    alone = new.copy()
    alone[:-1] &= new[1:]
    many = order[~alone]
    many = many[np.lexsort((pos[many], doc[many], h[many]))]
    s = h[many]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    head = many[new]
    own = head[np.cumsum(new) - 1]
    behind = (doc[many] != doc[own]) | (pos[many] != pos[own])
    return np.concatenate([order[alone], head]), many[behind], own[behind]


def _steps(pos: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, ascending in each document, as one byte for each step; longer steps apart."""
    step = np.diff(pos, prepend=0)
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    step[first] = pos[first]
    wide = np.flatnonzero(step >= 255)
    return np.minimum(step, 255).astype(np.uint8), small(wide), small(step[wide]), np.flatnonzero(first)


def _unsteps(byte: np.ndarray, wide: np.ndarray, step: np.ndarray, count: np.ndarray) -> np.ndarray:
    pos = byte.astype(np.int64)
    pos[wide.astype(np.int64)] = step
    total = np.cumsum(pos)
    start = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    return total - np.repeat(total[start] - pos[start], count) if len(pos) else pos


def _shard(doc: np.ndarray, n: int) -> np.ndarray:
    """The shard, of n, that a document's first occurrences go to; modulo the buckets, its group."""
    return (X.mix(doc.view(np.uint64)) >> np.uint64(33)).astype(np.int64) % n


def _spots(doc: np.ndarray, pos: np.ndarray, *more: np.ndarray) -> bytes:
    """Positions of some documents, sorted, packed, with what belongs to each."""
    byte, wide, step, start = _steps(pos, doc)
    return pack(doc[start], small(np.diff(np.append(start, len(doc)))), byte, wide, step, *more)


def _unspots(data) -> tuple[np.ndarray, ...]:
    doc, k, byte, wide, step, *more = unpack(data)
    return np.repeat(doc, k), _unsteps(byte, wide, step, k.astype(np.int64)), *more


def _texts(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return small(np.array([len(x) for x in contents], np.int64)), np.frombuffer(b"".join(contents), np.uint8)


def _untexts(size: np.ndarray, blob: np.ndarray) -> list[bytes]:
    whole, ends = blob.tobytes(), np.cumsum(size, dtype=np.int64)
    return [whole[e - k : e] for e, k in zip(ends.tolist(), size.tolist(), strict=True)]


WINDOW, LATER, FIRST = 0, 1, 2


def repeats(docs: DataFrame, n_buckets: int, n_shards: int, min_words: int = MIN_WORDS, salt: int = 0) -> DataFrame:
    """_g, kind, _at: for a group of documents (null id: LAST), packed starts of windows by their hash; several rows each.

    kind LATER: windows that also start earlier, each with the shard of such a start; FIRST: those that start there.
    """

    def grouped(kind: int, doc: np.ndarray, pos: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        order = np.lexsort((pos, doc))
        order2, ptr = by_bucket(_shard(doc[order], n_shards) % n_buckets, n_buckets)
        for i in np.flatnonzero(np.diff(ptr)):
            at = order[order2[ptr[i] : ptr[i + 1]]]
            yield int(i), kind, _spots(doc[at], pos[at], *(m[at] for m in more))

    def table(rows: list[tuple[int, int, bytes]]) -> list[pa.Array]:
        return [pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary())]

    def marks(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, bytes]]]:
        first, later, own = _later(h, doc, pos)
        heads = np.unique(own)
        return first, [*grouped(LATER, doc[later], pos[later], small(_shard(doc[own], n_shards))), *grouped(FIRST, doc[heads], pos[heads])]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            first, out = marks(h, doc, pos)
            h, order = h[first], np.lexsort((pos[first], doc[first]))
            h, first = h[order], first[order]
            order, ptr = by_bucket((h >> np.uint64(33)).astype(np.int64) % n_buckets, n_buckets)
            for i in np.flatnonzero(np.diff(ptr)):
                at = order[ptr[i] : ptr[i + 1]]
                out.append((int(i), WINDOW, _spots(doc[first[at]], pos[first[at]], h[at])))
            return pa.RecordBatch.from_arrays(table(out), ["bucket", "kind", "packed"])

        for b in batches:
            ids = b.column(0).to_numpy()
            for t in X.texts(b.column(1)):
                w = X.words(t)
                at, h = X.windows(w, min_words)
                row = w.doc[at]
                held.append((X.mix(h + np.uint64(salt)) if salt else h, ids[t.first + row], at - w.ptr[row]))
                size += len(h)
                if size >= GATHER:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def settle_bucket(group: pa.Table) -> pa.Table:
        windows, out = [], []
        bucket = group.column("bucket")[0].as_py()
        for kind, x in zip(group.column("kind").to_pylist(), group.column("packed"), strict=True):
            if kind == WINDOW:
                windows.append(_unspots(x.as_buffer()))
            else:
                out.append((bucket, kind, x.as_py()))
        if windows:
            d, p, h = (np.concatenate(x) for x in zip(*windows, strict=True))
            out += marks(h, d, p)[1]
        return pa.table(table(out), names=["_g", "kind", "_at"])

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_d"), F.col("text"))
    return keyed.mapInArrow(deal, "bucket int, kind int, packed binary").groupBy("bucket").applyInArrow(settle_bucket, "_g int, kind int, _at binary")


def _runs(pos: np.ndarray, shard: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of consecutive positions (of one shard)."""
    new = np.ones(len(pos), bool)
    new[1:] = np.diff(pos) != 1
    if shard is not None:
        new[1:] |= shard[1:] != shard[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(pos)))


KEPT, CUT, REFERENCE, ASKED = 0, 1, 2, 3


def spans(docs: DataFrame, spots: DataFrame, n_buckets: int, n_shards: int, min_words: int, keep_text: bool) -> DataFrame:
    """One pass over each group of documents: results of those without repeats (KEPT), the others with their spans (CUT);
    the reference spans of each shard (REFERENCE), and the different spans that are to be held against it (ASKED, by group)."""
    schema = "kind int, key int, n long, doc_id long, n_words long, kept_sha256 string, text string, packed binary"

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(LAST).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((_shard(ids, n_shards) % n_buckets).astype(np.int32))], ["doc_id", "text", "_g"])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        found = {LATER: [(none, none, none)], FIRST: [(none, none)]}
        for kind, x in zip(right.column("kind").to_pylist(), right.column("_at"), strict=True):
            found[kind].append(_unspots(x.as_buffer()))
        d, p, s = (np.concatenate(x) for x in zip(*found[LATER], strict=True))
        order = np.lexsort((p, d))
        d, p, s = d[order], p[order], s[order].astype(np.int64)
        fd, fp = (np.concatenate(x) for x in zip(*found[FIRST], strict=True))
        order = np.lexsort((fp, fd))
        fd, fp = fd[order], fp[order]
        once = np.ones(len(fd), bool)
        once[1:] = (fd[1:] != fd[:-1]) | (fp[1:] != fp[:-1])
        fd, fp = fd[once], fp[once]
        names = left.column("doc_id")
        ids = names.fill_null(LAST).to_numpy()
        _, which, rows_of = np.unique(ids, return_inverse=True, return_counts=True)
        several = rows_of[which] > 1
        lo, hi = np.searchsorted(d, ids, "left"), np.searchsorted(d, ids, "right")
        flo, fhi = np.searchsorted(fd, ids, "left"), np.searchsorted(fd, ids, "right")
        asked: dict[tuple[int, bytes], tuple[bytes, bool]] = {}
        reference: dict[int, list[bytes]] = {}
        g = int(_shard(ids[:1], n_shards)[0] % n_buckets) if len(ids) else 0
        out: list[tuple] = []
        for r, (name, text) in enumerate(zip(names.to_pylist(), left.column("text"), strict=True)):
            raw = text.as_py()
            ws = (raw or "").encode().split()
            here = fp[flo[r] : fhi[r]]
            here = here[here <= len(ws) - min_words]  # of rows that share an id, another may be longer
            if len(here):
                shard = int(_shard(ids[r : r + 1], n_shards)[0])
                for a, k in zip(*_runs(here), strict=True):
                    reference.setdefault(shard, []).append(b" ".join(ws[here[a] : here[a] + k - 1 + min_words]))
            at, to = p[lo[r] : hi[r]], s[lo[r] : hi[r]]
            fits = at <= len(ws) - min_words
            at, to = at[fits], to[fits]
            if not len(at) and not several[r]:
                kept = b" ".join(ws)
                out.append((KEPT, 0, 0, name, len(ws), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None, None))
                continue
            start, length = _runs(at, to)
            digests = []
            for a, k in zip(start.tolist(), length.tolist(), strict=True):
                content = b" ".join(ws[at[a] : at[a] + k - 1 + min_words])
                digests.append(hashlib.blake2b(content, digest_size=16).digest())
                key = (int(to[a]), digests[-1])
                asked[key] = (content, bool(several[r]) and asked.get(key, (b"", True))[1])
            spans_ = pack(small(at[start]), small(length), small(to[start]), np.frombuffer(b"".join(digests), np.uint8))
            out.append((CUT, g, 0, name, len(ws), None, raw, spans_))
        for shard, contents in reference.items():
            contents = list(dict.fromkeys(contents))
            out.append((REFERENCE, shard, 0, None, None, None, None, pack(*_texts(contents))))
        for shard in {k[0] for k in asked}:
            own = [(k[1], *v) for k, v in asked.items() if k[0] == shard]
            out.append((ASKED, shard, g, None, None, None, None, pack(*_texts([x[1] for x in own]), np.frombuffer(b"".join(x[0] for x in own), np.uint8), np.array([x[2] for x in own], bool))))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        cols = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(group, "doc_id long, text string, _g int")
    return rows.groupBy("_g").cogroup(spots.groupBy("_g")).applyInArrow(cut, schema)


def confirmed(contents: list[bytes], reference: list[bytes], min_words: int) -> list[np.ndarray]:
    """For each content, which of its windows of min_words words a reference text holds; one automaton at a time."""
    split = [x.split() for x in contents]
    found = [np.zeros(len(x) - min_words + 1, bool) for x in split]
    symbols: list[int] = []
    ids: dict[bytes, int] = {}

    def stream() -> None:
        automaton = SuffixAutomaton(symbols)
        for ws, hit in zip(split, found, strict=True):
            if not hit.all():
                hit |= automaton.matching([ids.get(w, -1) for w in ws])[min_words - 1 :] >= min_words

    for x in reference:
        symbols += [ids.setdefault(w, len(ids)) for w in x.split()]
        symbols.append(-1)
        if len(symbols) >= SHARD_WORDS:
            stream()
            symbols, ids = [], {}
    if symbols:
        stream()
    return found


def _judge(min_words: int):
    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        """Answers to the groups that asked a shard: for each span its digest and which of its windows are confirmed."""
        reference = [t for x in left.column("packed") for t in _untexts(*unpack(x.as_buffer()))]
        shard, groups, contents, digests, soft = 0, [], [], [], []
        for key, g, x in zip(right.column("key").to_pylist(), right.column("n").to_pylist(), right.column("packed"), strict=True):
            size, blob, digest, s = unpack(x.as_buffer())
            shard = key
            groups += [g] * len(size)
            contents += _untexts(size, blob)
            raw = digest.tobytes()
            digests += [raw[i : i + 16] for i in range(0, len(raw), 16)]
            soft += s.tolist()
        names = dict(zip(digests, contents, strict=True))  # equal spans of many groups are streamed once
        verdict = dict(zip(names, confirmed(list(names.values()), reference, min_words), strict=True))
        out = []
        for g in sorted(set(groups)):
            mine = [(x, s) for h, x, s in zip(groups, digests, soft, strict=True) if h == g]
            hits = [verdict[x] for x, _ in mine]
            missed = sum(int((~v).sum()) for v, (_, s) in zip(hits, mine, strict=True) if not s)
            out.append((g, shard, missed, pack(np.frombuffer(b"".join(x for x, _ in mine), np.uint8), small(np.array([len(v) for v in hits])), np.packbits(np.concatenate(hits)))))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.int32(), pa.int64(), pa.binary()], strict=True)], names=["key", "shard", "missed", "packed"])

    return judge


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, keep_text: bool = False, salt: int = 0) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and kept_text if asked for."""
    n_buckets = buckets(docs, 64 << 20)
    n_shards = n_buckets * max(1, -(-min(input_bytes(docs), 1 << 50) // (SHARD_BYTES * n_buckets)))
    for again in count(salt):
        spots = settle(repeats(docs, n_buckets, n_shards, min_words, again))
        moved = settle(spans(docs, spots, n_buckets, n_shards, min_words, keep_text))
        discard(spots)
        asked = moved.where(F.col("kind") == ASKED).select("key", "n", "packed")
        held = moved.where(F.col("kind") == REFERENCE).select("key", "packed")
        answers = settle(held.groupBy("key").cogroup(asked.groupBy("key")).applyInArrow(_judge(min_words), "key int, shard int, missed long, packed binary"))
        if not answers.agg(F.sum("missed")).first()[0]:
            break
        discard(moved, answers)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        verdict: dict[tuple[int, bytes], np.ndarray] = {}
        for shard, x in zip(right.column("shard").to_pylist(), right.column("packed"), strict=True):
            digest, size, bits = unpack(x.as_buffer())
            raw, ends = digest.tobytes(), np.cumsum(size, dtype=np.int64)
            hit = np.unpackbits(bits, count=int(ends[-1])).astype(bool)
            for i, (e, k) in enumerate(zip(ends.tolist(), size.tolist(), strict=True)):
                verdict[shard, raw[16 * i : 16 * i + 16]] = hit[e - k : e]
        names = left.column("doc_id").to_pylist()
        shared, starts = Counter(names), []
        gone: dict[int | None, set[int]] = {}
        for name, x in zip(names, left.column("packed"), strict=True):
            start, _, to, digest = unpack(x.as_buffer())
            raw, at = digest.tobytes(), [np.zeros(0, np.int64)]
            for i, (a, shard) in enumerate(zip(start.tolist(), to.tolist(), strict=True)):
                at.append(a + np.flatnonzero(verdict.get((shard, raw[16 * i : 16 * i + 16]), np.zeros(0, bool))))
            starts.append(np.concatenate(at))
            if shared[name] > 1:
                gone.setdefault(name, set()).update(starts[-1].tolist())
        rows: list[tuple] = []
        for name, own, text in zip(names, starts, left.column("text"), strict=True):
            ws = (text.as_py() or "").encode().split()
            at = np.array(sorted(gone[name]), np.int64) if name in gone else own
            at = at[at <= len(ws) - min_words]
            edge = np.zeros(len(ws) + 1 + min_words, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + min_words, -1)
            keep = np.cumsum(edge)[: len(ws)] == 0
            kept = b" ".join(compress(ws, keep))
            rows.append((name, len(ws), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep_text else [])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 + keep_text]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    whole = moved.where(F.col("kind") == KEPT).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", *([F.col("text").alias("kept_text")] if keep_text else []))
    left = moved.where(F.col("kind") == CUT).select("key", "doc_id", "text", "packed")
    return whole.union(left.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(apply, schema))
