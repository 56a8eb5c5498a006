from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from common import LOWER, WORD, thue_morse

from tessera.llm import line_dedup, ngram_join, substring_dedup
from tessera.llm.components import components


def corpus(seed, n=60, vocabulary=400):
    """Random texts with copies, near copies, shared passages and self-repeats."""
    r = random.Random(seed)
    words = lambda k: [f"w{r.randrange(vocabulary)}" for _ in range(k)]
    shared = [words(30) for _ in range(3)]
    out = []
    for i in range(n):
        kind = r.random()
        if kind < 0.2 and out:
            ws = list(out[r.randrange(len(out))])
        elif kind < 0.5 and out:
            ws = list(out[r.randrange(len(out))])
            for _ in range(r.randrange(1, 4)):
                if ws:
                    ws[r.randrange(len(ws))] = words(1)[0]
        else:
            ws = words(r.choice([1, 3, 4, 5, 6, 8, 12, 40, 120]))
        if r.random() < 0.2:
            at = r.randrange(len(ws) + 1)
            ws = ws[:at] + shared[r.randrange(3)] + ws[at:]
        if r.random() < 0.1:
            ws = ws + ws
        out.append(ws)
    return [(i * 3 + 1, " ".join(ws)) for i, ws in enumerate(out)]


# -- op7
def windows_removed(rows, k=20):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda x: x[0]):
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for p in range(len(ws) - k + 1):
            w = tuple(ws[p : p + k])
            if w in seen:
                gone[p : p + k] = [True] * k
            seen.add(w)
        out[i] = (len(ws), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_brute_force(docs, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.drop_repeats(docs(rows, 5)).collect()}
    assert got == windows_removed(rows) and sum(v[1] for v in got.values()) > 0


def test_repeats_in_small_lots_are_the_same(docs, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(substring_dedup, "GATHER", 50)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.drop_repeats(docs(rows, 2)).collect()}
    assert got == windows_removed(rows)


def test_repeats_odd_rows(docs, odd, spark):
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.drop_repeats(docs(odd)).collect())
    assert got == [(0, 3, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (5, 3, 0), (6, 2, 0), (6, 2, 0), (7, 60000, 59999), (8, 2, 0)]
    assert substring_dedup.drop_repeats(docs([(1, "x")]).limit(0)).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    twins = substring_dedup.drop_repeats(docs([(4, text), (4, text), (9, text)]), keep_text=True).orderBy("doc_id").collect()
    assert [(r.n_removed, r.kept_text) for r in twins] == [(0, text), (0, text), (30, "")]


def test_windows_with_one_hash_are_told_apart(docs, monkeypatch):
    """Under the first salt all windows share a few hashes; under the next ones they don't."""
    real, rows = substring_dedup.repeats, corpus(4, 30)
    tried = []

    def weak(*how):
        tried.append(how[-1])
        if how[-1] == 0:
            mask = how[3] and __import__("numpy").uint64(3)
            monkeypatch.setattr(substring_dedup.X, "windows", lambda w, k, f=substring_dedup.X.windows: (lambda at, h: (at, h & mask))(*f(w, k)))
            try:
                return substring_dedup.settle(real(*how))
            finally:
                monkeypatch.undo()
        return real(*how)

    monkeypatch.setattr(substring_dedup, "repeats", weak)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.drop_repeats(docs(rows, 1)).collect()}
    assert got == windows_removed(rows)


def test_confirmation_by_many_small_automata(monkeypatch):
    r = random.Random(9)
    texts = [b" ".join(b"%d" % r.randrange(3) for _ in range(r.randrange(4, 40))) for _ in range(12)]
    asked = [b" ".join(b"%d" % r.randrange(3) for _ in range(r.randrange(4, 30))) for _ in range(12)] + texts[:3]
    have = {tuple(t.split()[i : i + 4]) for t in texts for i in range(len(t.split()) - 3)}
    want = [[tuple(a.split()[i : i + 4]) in have for i in range(len(a.split()) - 3)] for a in asked]
    for words in (5, 60, 10_000):
        monkeypatch.setattr(substring_dedup, "SHARD_WORDS", words)
        assert [x.tolist() for x in substring_dedup.confirmed(asked, texts, 4)] == want
    assert not any(x.any() for x in substring_dedup.confirmed(asked, [], 4))


def test_words_of_one_structure_are_not_one(docs):
    a, b = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    words = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([a, *words])), (2, " ".join([b, *words])), (3, " ".join([b, *words]))]
    assert [r.n_removed for r in substring_dedup.drop_repeats(docs(rows)).orderBy("doc_id").collect()] == [0, 0, 20]
    sets = [(1, a), (2, b), (3, f"{a} x y z u"), (4, f"{b} x y z u")]
    assert [r.component_id for r in ngram_join.groups(docs(sets)).orderBy("doc_id").collect()] == [1, 2, 3, 4]


def test_reference_spans(docs, spark, monkeypatch):
    passage = " ".join(f"r{i}" for i in range(25))
    reference = spark.createDataFrame([(passage,), (None,), ("too short",)], "text string")
    rows = [(1, f"a b {passage} c"), (2, "plain  text"), (3, None), (4, " ".join(f"r{i}" for i in range(19))), (5, " ".join(f"r{i}" for i in range(3, 23)) + " z")]
    want = {1: ("a b c", 25), 2: ("plain  text", 0), 3: (None, 0), 4: (rows[3][1], 0), 5: ("z", 20)}
    for words in (1_000_000, 10):  # one pass, and one for each shard
        monkeypatch.setattr(substring_dedup, "PASS_WORDS", words)
        monkeypatch.setattr(substring_dedup, "SHARD_WORDS", min(words, 20))
        out = substring_dedup.drop_reference(docs(rows), reference, counts="cut").collect()
        assert {r.doc_id: (r.text, r.cut) for r in out} == want


def test_automaton_against_all_substrings():
    r = random.Random(5)
    for _ in range(200):
        texts = [[r.randrange(3) for _ in range(r.randrange(1, 12))] for _ in range(3)]
        query = [r.randrange(4) for _ in range(15)]
        subs = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        want = [max((k for k in range(1, i + 2) if tuple(query[i + 1 - k : i + 1]) in subs), default=0) for i in range(15)]
        assert substring_dedup.SuffixAutomaton([x for t in texts for x in [*t, -1]]).matching(query).tolist() == want


# -- op9
def linked(rows):
    sets = {}
    for i, t in rows:
        ws = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for p, i in enumerate(ids):
        for j in ids[:p]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("how", [{}, {"LIGHT": 2}, {"LIGHT": 1, "ROWS": 3, "COLUMNS": 2}, {"HEAVY": 5}, {"boundary": lambda sizes, scan: 9}])
def test_join_matches_brute_force(docs, monkeypatch, how):
    for k, v in how.items():
        monkeypatch.setattr(ngram_join, k, v)
    rows = corpus(7, 80, 60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(docs(rows, 4)).collect()}
    want = linked(rows)
    assert got == want and len({v[1] for v in want.values()}) < 70


def test_join_odd_rows(docs, odd):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.groups(docs(odd)).collect())
    assert got == [(0, 1, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 1, 5), (6, 1, 6), (6, 1, 6), (7, 1, 7), (8, 1, 8)]
    assert ngram_join.groups(docs([(1, "x")]).limit(0)).count() == 0
    kept = ngram_join.keep_one(docs([(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "other"), (None, "a b c d e f g")]))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2] and "node" in kept.columns


def test_a_long_list_of_documents_that_do_not_link(spark, monkeypatch):
    """All share one key, and two of each four documents the other keys that a link takes."""
    monkeypatch.setattr(ngram_join, "LIGHT", 1)
    monkeypatch.setattr(ngram_join, "ROWS", 32)
    n = 24
    texts = []
    for i in range(400):  # of each four documents two are the same but for their last word; all begin alike
        pair = [f"p{i // 4}x{k}" for k in range(n + 4 - 8)] if i % 4 < 2 else [f"q{i}x{k}" for k in range(n + 4 - 8)]
        texts.append(" ".join(["all", "begin", "with", "these", "few", "words", *pair, f"z{i}", "end"]))
    sets = {i: linked([(i, t)])[i][0] for i, t in enumerate(texts)}
    assert set(sets.values()) == {n}
    rows = [(0, i, n, i) for i in range(400)] + [(1 + 9 * (i // 4) + k, i, n, i) for i in range(400) if i % 4 < 2 for k in range(9)] + [(-1 - k, i, n, i) for i in range(400) for k in range(5)]
    maybe, links, _ = ngram_join.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(rows, "k long, node long, n long, comp long"), 0)
    assert maybe.count() == 0 and sorted(map(tuple, links.collect())) == [(i, i + 1) for i in range(0, 400, 4)]


def test_links_of_sets(monkeypatch):
    r = random.Random(3)
    np = __import__("numpy")
    make = lambda: np.array(sorted(r.sample(range(30), r.randrange(1, 25))), np.uint64)
    for gather in (1, 40, 10_000):
        monkeypatch.setattr(ngram_join, "GATHER", gather)
        own, others = make(), [make() for _ in range(50)] + [np.arange(30, dtype=np.uint64)]
        want = [100 * len(set(own) & set(x)) >= 80 * len(set(own) | set(x)) for x in others]
        assert ngram_join.links_of(own, others).tolist() == want


def test_boundary_by_cost():
    assert ngram_join.boundary({2: 100}, 0.0) >= 2
    assert ngram_join.boundary({3: 1000, 12: 1000}, 0.5) >= 3
    assert ngram_join.boundary({12: 1000}, 0.0) < 12


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(50)]
    parent = {}
    for u, v in edges:
        a, b = u, v
        while parent.setdefault(a, a) != a:
            a = parent[a]
        while parent.setdefault(b, b) != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def root(x):
        return x if parent[x] == x else root(parent[x])

    loops = {u for u, v in edges if u == v} - {x for u, v in edges if u != v for x in (u, v)}
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent if x not in loops}


# -- op8
def boilerplate_removed(rows, ratio, least):
    pages, seen = Counter(), defaultdict(set)
    for k, (_, t, s) in enumerate(rows):
        if t is not None:
            pages[s] += 1
            for line in t.split("\n"):
                if WORD.search(line):
                    seen[s, line].add(k)
    gone = {x for x, at in seen.items() if len(at) >= least and len(at) > ratio * pages[x[0]]}
    out = []
    for i, t, s in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if (s, x) not in gone]
        out.append((i or 0, None if t is None else "\n".join(keep), sum(bool(WORD.search(x)) for x in ls), len(ls) - len(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("piece", "pages"), [(1_000_000, 1), (2, 20_000), (2, 4)])
def test_lines_match_brute_force(docs, odd, monkeypatch, piece, pages):
    monkeypatch.setattr(line_dedup, "PIECE", piece)
    monkeypatch.setattr(line_dedup, "GROUP_PAGES", pages)
    r = random.Random(2)
    common = [f"menu {i}" for i in range(6)]
    rows = [(100 + i, "\n".join([*r.sample(common, 3), f"body {i}", "", "same  line "] + (["menu 0"] if i % 3 else [])), r.choice(["s", "t", None])) for i in range(40)] + odd
    got = line_dedup.drop_lines(docs(rows), 0.3, 3, counts=("lines_", "gone_")).collect()
    assert sorted(((x.doc_id or 0, x.text, x.lines_, x.gone_) for x in got), key=str) == boilerplate_removed(rows, 0.3, 3)
    assert got[0].n == "mine" and line_dedup.drop_lines(docs(rows).limit(0)).count() == 0
