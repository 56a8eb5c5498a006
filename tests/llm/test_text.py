from __future__ import annotations

import numpy as np
import pyarrow as pa
from common import WORD, thue_morse
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import text as X
from tessera.llm.spread import pack, unpack

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x85  #", max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_lines_and_windows_match_plain_python(rows, size):
    words, lines, pairs = [], [], []
    for t in X.texts(pa.array(rows, pa.string()), size):
        w, ls = X.words(t), X.lines(t)
        at, h = X.windows(w, 2)
        for i in range(len(t)):
            words.append([bytes(t.buf[a:b]).decode() for a, b in zip(w.start[w.ptr[i] : w.ptr[i + 1]], w.end[w.ptr[i] : w.ptr[i + 1]])])
            lines.append([bytes(t.buf[a:b]).decode() for a, b in zip(ls.start[ls.ptr[i] : ls.ptr[i + 1]], ls.end[ls.ptr[i] : ls.ptr[i + 1]])])
            assert [bool(x) for x in ls.has_word[ls.ptr[i] : ls.ptr[i + 1]]] == [bool(WORD.search(x)) for x in lines[-1]]
        pairs += list(zip(w.doc[at] + t.first, h))
    assert words == [WORD.findall(r or "") for r in rows] and lines == [(r or "").split("\n") for r in rows]
    seen = {}
    it = iter(pairs)
    for i, ws in enumerate(words):
        for p in zip(ws, ws[1:]):
            row, h = next(it)
            assert row == i and seen.setdefault(p, h) == h
    assert len(set(seen.values())) == len(seen)


def test_hashes_depend_on_content_alone():
    a = [X.words(t).hash.tolist() for t in X.texts(pa.array(["x yy", "zzz x"]), 1)]
    b = [X.words(t).hash.tolist() for t in X.texts(pa.array(["zzz x yy"]))]
    assert a[0][0] == a[1][1] == b[0][1] and a[0][1] == b[0][2]


def test_no_collisions_by_structure():
    rows = [thue_morse(n, *pair) for n in (64, 255, 256, 257, 1024, 4096) for pair in ("ab", "ba")] + ["", "a", "a\0", "a" * 8, "a" * 9, "a" * 16]
    for t in X.texts(pa.array(rows)):
        ls, w = X.lines(t), X.words(t)
        assert len(set(ls.hash)) == len(set(ls.hash2)) == len(rows) and not set(ls.hash) & set(ls.hash2)
        assert len(set(w.hash)) == len(w.hash) == len(rows) - 1
    a, b = (" ".join(thue_morse(64, *pair)) for pair in ("ab", "ba"))
    for k in (3, 5, 20, 64):
        hashes = {}
        for t in X.texts(pa.array([a, b])):
            w = X.words(t)
            for i, h in zip(*X.windows(w, k)):
                words = tuple(w.hash[i : i + k])
                assert hashes.setdefault(h, words) == words
        assert len(set(hashes.values())) == len(hashes)


def test_sliced_and_large_columns():
    column = pa.chunked_array([pa.array(["q", None, "a b"]).slice(1), pa.array(["c"])])
    assert [np.diff(X.words(t).ptr).tolist() for t in X.texts(column)] == [[0, 2, 1]]
    assert sum(len(X.words(t).hash) for t in X.texts(pa.array(["a b", None], pa.large_string()))) == 2


def test_packing():
    arrays = [np.arange(5, dtype=np.uint16), np.zeros(0, np.int64), np.array([1.5]), np.array([True, False])]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, unpack(pack(*arrays)), strict=True))
