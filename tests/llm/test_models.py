from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from common import LOWER, WORD

from tessera.llm import decontaminate, mixing, pitman_yor, quality_rules, token_counts
from tessera.llm import text as X


def prose(seed, n, vocabulary=300, mean=80):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7)) % vocabulary}" for _ in range(n * mean * 2)]
    out, at = [], 0
    for i in range(n):
        k = r.randrange(1, 2 * mean)
        out.append((i, " ".join(words[at : at + k])))
        at += k
    return out


# -- op6
def base_rules(text):
    text = text or ""
    ws = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    three = Counter(zip(ws, ws[1:], ws[2:]))
    inside = set()
    for k, t in enumerate(zip(ws, ws[1:], ws[2:])):
        if three[t] > 1:
            inside |= {k, k + 1, k + 2}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_quality_base_matches_brute_force(docs, odd, spark):
    rows = [(i + 100, t.replace("w1 ", "é# ") + ("\nsame\nsame\n \nx  y" if i % 2 else "")) for i, t in prose(1, 30)] + [(50, "a b c " * 30)] + odd
    trusted = spark.createDataFrame([(100,), (101,), (None,)], "doc_id long")
    got = quality_rules.quality(docs(rows), trusted).collect()
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        want = base_rules(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.base_failed or not r.kept)
    assert {r.doc_id for r in got if r.doc_id == 50 and r.base_failed}


def test_quality_score_matches_brute_force(docs, spark):
    rows = prose(2, 40)
    good = {i for i, _ in rows[:15]}
    bins = lambda t: next(quality_rules._grams(X.words(x, lower=True))[0] for x in X.texts(__import__("pyarrow").array([t])))
    corpus, trusted = Counter(), Counter()
    for i, t in rows:
        corpus.update(bins(t).tolist())
        if i in good:
            trusted.update(bins(t).tolist())
    share = sum(trusted.values()) / sum(corpus.values())
    ratio = lambda b: math.log((trusted[b] + quality_rules.PRIOR) / (corpus[b] * share + quality_rules.PRIOR))
    got = {r.doc_id: r.score for r in quality_rules.quality(docs(rows), spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}
    for i, t in rows:
        g = bins(t).tolist()
        assert got[i] == pytest.approx(sum(map(ratio, g)) / len(g))


def test_quality_rejects_junk_and_keeps_the_rest(docs, spark):
    clean = prose(3, 120, mean=150)
    junk = [(1000 + i, " | ".join(f"q{(i * 97 + k * 31) % 900}" for k in range(120))) for i in range(40)]
    labels = spark.createDataFrame([(i,) for i, _ in clean[:80]], "doc_id long")
    kept = {r.doc_id for r in quality_rules.keep_good(docs(clean + junk), labels).collect()}
    long = {i for i, t in clean if not (lambda b: b[0] < 50 or 100 * b[4] > 50 * b[0])(base_rules(t))}
    assert not kept & {i for i, _ in junk} and kept == long
    nobody = quality_rules.quality(docs(clean), labels.limit(0))
    assert nobody.where("score <> 0").count() == 0 and quality_rules.quality(docs(clean).limit(0), labels).count() == 0


# -- op3
def test_sainte_lague_by_highest_quotients():
    r = random.Random(4)
    for _ in range(60):
        votes = np.array([r.choice([0, r.randrange(1, 500)]) for _ in range(r.randrange(1, 8))], float)
        seats, most = r.randrange(0, 60), np.array([r.randrange(0, 30) for _ in votes])
        got, want = mixing.sainte_lague(votes, seats, most), np.zeros(len(votes), int)
        for _ in range(seats):
            q = [v / (2 * w + 1) if w < m and v else -1 for v, w, m in zip(votes, want, most)]
            if max(q) < 0:
                break
            want[int(np.argmax(q))] += 1
        assert got.tolist() == want.tolist()


def test_targets_share_the_excess():
    got = mixing.targets([10, 100, 100], [5, 2, 1], 315)
    assert got[0] == 20 and got.sum() == pytest.approx(315) and got[1] == pytest.approx(196.6666666) and got[2] == pytest.approx(98.3333333)
    assert mixing.targets([10, 10], [1, 1], 100).tolist() == [20, 20]


@pytest.mark.parametrize("shard", [mixing.SHARD, 300])
def test_mix_meets_its_targets(docs, odd, shard):
    r = random.Random(6)
    rows = [(i, t, r.choice(["src0"] * 4 + ["Z", "a", "é"])) for i, t in prose(8, 300)] + [(1000 + i, *x[1:]) for i, x in enumerate(odd) if x[0] != 7]
    got = mixing.apportion(docs(rows, 4), shard_tokens=shard, block=8).collect()
    again = mixing.apportion(docs(rows, 7), shard_tokens=shard, block=8).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    source, size = {r[0]: r[2] for r in rows}, {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    names = sorted({s for s in source.values() if s is not None}, key=str.encode) + [None]
    totals = Counter()
    for i, n in size.items():
        totals[source[i]] += n
    want = dict(zip(names, mixing.targets([totals[s] for s in names], [mixing.WEIGHTS[k % 3] for k in range(len(names))], 1.5 * sum(totals.values()))))
    taken = Counter()
    for x in got:
        s = source[x.doc_id]
        assert x.size == size[x.doc_id] and x.source_size == totals[s] and x.target == pytest.approx(want[s]) and 0 <= x.taken <= 2 * x.size
        taken[s] += x.taken
    assert {s: (taken[s], want[s], totals[s]) for s in names if abs(taken[s] - want[s]) > 8 * (2 + totals[s] // shard)} == {}


def brute_mix(rows):
    """Every token on its source's line, block by block, for sources of one shard."""
    names = sorted({s for _, _, s in rows}, key=str.encode)
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    totals = [sum(size[i] for i, _, s in rows if s == name) for name in names]
    want = mixing.targets(totals, [mixing.WEIGHTS[k % 3] for k in range(len(names))], mixing.SHARE * sum(totals))
    rest = [t if t < 2 * n else 0.0 for t, n in zip(want, totals)]
    seats = [0] * len(names)
    for _ in range(round(sum(rest) / mixing.BLOCK)):
        at = max(range(len(names)), key=lambda k: (rest[k] / (2 * seats[k] + 1), -k))
        seats[at] += 1
    taken = dict.fromkeys(size, 0)
    for at, name in enumerate(names):
        key = at * 1_000_003 * 8191 + mixing.SEED
        scrambled = lambda x: int(mixing.scramble(np.array([x], np.uint64))[0])
        ids = sorted((i for i, _, s in rows if s == name and size[i]), key=lambda i: scrambled(i ^ key))
        line = [i for i in ids for _ in range(size[i])]
        n = -(-len(line) // mixing.BLOCK)
        quota = 2 * n if want[at] >= 2 * totals[at] else min(2 * n, math.floor(seats[at] * mixing.BLOCK * n / len(line) + 0.5)) if line else 0
        order = sorted(range(n), key=lambda b: scrambled(b ^ scrambled(key)))
        times = [quota // n + (order.index(b) < quota % n) for b in range(n)]
        for b in range(n):
            for i in line[b * len(line) // n : (b + 1) * len(line) // n]:
                taken[i] += times[b]
    return taken


def test_mix_matches_brute_force(docs):
    r = random.Random(16)
    rows = [(i, t, r.choice(["src0"] * 4 + ["Z", "a", "é"])) for i, t in prose(18, 200)] + [(900, None, "a"), (901, "", "Z")]
    assert {x.doc_id: x.taken for x in mixing.apportion(docs(rows, 4)).collect()} == brute_mix(rows)


def test_rows_without_words_or_ids_are_not_one_shard(docs):
    rows = [(None, f"w{i} " * 30, "s") for i in range(40)] + [(i, None, "s") for i in range(40)] + [(7, "long " * 60_000, "t")]
    got = mixing.apportion(docs(rows), shard_tokens=300, block=8).collect()
    assert len(got) == 81 and sum(x.taken for x in got if x.size == 30) == pytest.approx(got[0].target if got[0].size == 30 else 1e9, rel=1) and all(x.taken == 0 for x in got if x.size == 0)
    assert {x.taken <= 2 * x.size for x in got} == {True}


def test_mix_keeps_rows_and_columns(docs):
    rows = [(1, "a b c"), (1, "a b c"), (None, "d e"), (2, None)]
    out = mixing.mix(docs(rows), block=1)
    assert "n" in out.columns and "size" in out.columns and out.columns[-1] == "taken"
    assert sum(r.taken for r in out.collect()) in (11, 12, 13) and out.count() <= 3
    assert mixing.mix(docs(rows).limit(0)).count() == 0


# -- op10
def naive_base(rows):
    tokens = {i: WORD.findall((t or "").translate(LOWER)) + ["\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}, c


@pytest.mark.parametrize(("lot", "slice_"), [(1_500_000, 500_000), (700, 90)])
def test_base_scores_match_brute_force(docs, monkeypatch, lot, slice_):
    monkeypatch.setattr(pitman_yor, "GATHER", lot)
    monkeypatch.setattr(pitman_yor, "SLICE", slice_)
    rows = prose(9, 60) + [(1000, None), (1001, "W1 unseen words"), (1002, " ")]
    want, _ = naive_base(rows)
    out = pitman_yor.score(docs(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4])


def test_hot_pairs_score_alike_wherever_they_are_read(docs, monkeypatch):
    rows = prose(19, 60) + [(1000 + i, "of the " * 40) for i in range(20)]
    found = []
    for hot, slice_ in ((1e-9, 500_000), (pitman_yor.HOT, 50), (1e9, 500_000)):
        monkeypatch.setattr(pitman_yor, "HOT", hot)
        monkeypatch.setattr(pitman_yor, "SLICE", slice_)
        found.append({r.doc_id: r for r in pitman_yor.score(docs(rows)).collect()})
    for i, r in found[0].items():
        for other in found[1:]:
            assert r[:5] == other[i][:5] and r.base_score == pytest.approx(other[i].base_score) and r.score == pytest.approx(other[i].score, rel=1e-5)


def test_context_helps_where_words_follow_each_other(docs):
    r = random.Random(21)
    after = {k: r.sample(range(200), 4) for k in range(200)}
    rows = []
    for i in range(150):
        w, ws = r.randrange(200), []
        for _ in range(60):
            w = r.choice(after[w])
            ws.append(f"w{w}")
        rows.append((i, " ".join(ws)))
    held = [x for x in pitman_yor.score(docs(rows)).collect() if x.held_out]
    n = sum(x.n_tokens for x in held)
    base, own = sum(x.base_score for x in held) / n, sum(x.score for x in held) / n
    assert base < -2 and -1.1 < own < -math.log10(4) * 60 / 61 + 0.1  # four words may follow: log10(1/4) a word at best


def test_each_word_is_a_context_however_many_there_are(docs):
    """36,000 equally frequent words in chains of 20, each always followed by the same word."""
    rows = [(i, " ".join(f"w{i % 1800 * 20 + k}" for k in range(20))) for i in range(1800 * 8)]
    held = [x for x in pitman_yor.score(docs(rows)).collect() if x.held_out]
    own = sum(x.score for x in held) / sum(x.n_tokens for x in held)
    # of about 7 customers at each context, all are the next word: 20 times about (7 - d t) / (7 + strength), once 1 / 1800
    assert (20 * math.log10(7 / 11) + math.log10(1 / 1800)) / 21 - 0.1 < own < (20 * math.log10(8 / 12) + math.log10(1 / 1800)) / 21 + 0.05


def test_seats_follow_their_closed_form():
    """Mean number of tables of 3 customers against the exact weights of 1, 2 and 3 tables."""
    d, strength, prob = 0.5, 1.0, 0.3
    table = pitman_yor.stirling(d)
    w = np.exp([table[3, t] + sum(math.log(strength + d * i) for i in range(t)) + t * math.log(prob) for t in (1, 2, 3)])
    n = 40_000
    keys = X.mix(np.arange(n, dtype=np.uint64))
    t = pitman_yor.seat(np.full(n, 3), np.zeros(n), np.full(n, prob), keys, 1, d, strength, table)
    assert np.bincount(t, minlength=4)[1:] / n == pytest.approx(w / w.sum(), abs=0.01)
    assert np.exp(table[3, 1:4]) == pytest.approx([0.5 * 1.5, 3 * 0.5, 1])
    many = pitman_yor.seat(np.full(2000, 500), np.zeros(2000), np.full(2000, prob), keys[:2000], 2, d, strength, table)
    assert (many >= 1).all() and (many <= 500).all() and 3 < many.mean() < 60


def test_model_is_a_distribution():
    """One restaurant by hand: probabilities over all words and the unknown one."""
    word = np.sort(X.mix(np.arange(1, 30, dtype=np.uint64)))
    c = np.arange(1, 30)
    customers, tables = np.zeros(pitman_yor.CONTEXTS), np.zeros(pitman_yor.CONTEXTS)
    customers[1] = c.sum()
    m = pitman_yor.Model(customers, tables, np.zeros(0, np.int64), 0.6, 0.5, 29, 0)
    ptr, ctx, own = np.arange(30), np.ones(29, np.int64), np.full(29, -1)
    for _ in range(3):
        t, prob = m.sweep(word, own, ptr, ctx, c)
        m.tables[1], m.total, m.top = t.sum(), t.sum(), m.seated.sum()
    t, prob = m.sweep(word, own, ptr, ctx, c)
    m.tables[1] = t.sum()
    m.total, m.top = float(t.sum()), float(m.seated.sum())
    prob = (t - m.d1 * m.seated + (pitman_yor.STRENGTH + m.d1 * m.top) * m.base) / (pitman_yor.STRENGTH + m.total)
    unknown = (pitman_yor.STRENGTH + m.d1 * m.top) * m.base / (pitman_yor.STRENGTH + m.total)
    assert prob.sum() + unknown == pytest.approx(1)
    back = pitman_yor.STRENGTH + m.d * m.tables[1]
    p = (c - m.d * t + back * prob) / (pitman_yor.STRENGTH + customers[1])
    assert p.sum() + back * unknown / (pitman_yor.STRENGTH + customers[1]) == pytest.approx(1)


def test_scores_odd_rows(docs, odd):
    out = {r.doc_id: r for r in pitman_yor.score(docs(odd)).collect()}
    assert set(out) == {1, 2, 3, None, 5, 6, 7, 8} and out[1].n_tokens == 1 and out[6].n_tokens == 6 and out[7].n_tokens == 60_001
    assert all(math.isfinite(r.score) and r.score < 0 for r in out.values())
    assert pitman_yor.score(docs(odd).limit(0)).count() == 0


# -- op1
def best_leak(doc, item):
    sh = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    best = 0.0
    for k in range(max(1, len(doc) - len(item) + 1)):
        a, b = sh(doc[k : k + len(item)]), sh(item)
        best = max(best, sum((a & b).values()) / max(1, sum((a | b).values())))
    return best


def test_leaks_match_brute_force(docs, spark):
    r = random.Random(12)
    words = lambda k: [f"B{r.randrange(5000)}é" for _ in range(k)]
    items = {i: words(n) for i, n in enumerate([3, 5, 8, 20, 33, 59])}
    rows = []
    for k in range(60):
        body = words(r.randrange(5, 80))
        if k % 2:
            leak = list(items[k % 6])
            if k % 3 == 0 and len(leak) > 12:
                leak[r.choice([0, len(leak) - 1, len(leak) // 2])] = "changed"
            at = r.randrange(len(body))
            body[at:at] = leak
        rows.append((k, " ".join(body).upper() if k % 5 == 0 else " ".join(body)))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(99, None), (98, " ")], "item_id long, text string")
    want = {}
    for k, t in rows:
        for i, w in items.items():
            s = best_leak(t.lower().split(), [x.lower() for x in w])
            if s >= 0.8:
                want[k, i] = round(s, 9)
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontaminate.leaks(docs(rows), table).collect()}
    assert got == want and len(want) >= 25
    clean = {x.doc_id for x in decontaminate.drop_leaked(docs(rows), table).collect()}
    assert clean == {k for k, _ in rows} - {k for k, _ in want}


def test_leaks_beyond_the_hamming_radius(docs, spark):
    """Both ends of items replaced up to the limit of similarity; some of these windows are more than RADIUS bits away."""
    r = random.Random(4)
    words = lambda k: [f"b{r.randrange(50_000)}" for _ in range(k)]
    items, rows = {}, []
    for i in range(500):
        items[i] = words(r.choice([14, 23, 32, 59]))
        cut = (len(items[i]) - 4) // 9
        head = r.randrange(cut + 1)
        rows.append((i, " ".join(words(9) + words(head) + items[i][head : len(items[i]) - cut + head] + words(cut - head) + words(9))))
    assert all(best_leak(rows[i][1].split(), items[i]) >= 0.8 for i in items)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs(rows), table).collect()} == {(i, i) for i in items}


def test_one_long_text_in_segments(docs, spark, monkeypatch):
    r = random.Random(12)
    item = [f"b{i}" for i in range(40)]
    words = [f"w{r.randrange(900)}" for _ in range(30_000)]
    for at in (0, 990, 15_000, 29_960):
        words[at : at + 40] = item
    rows, table = [(1, " ".join(words)), (2, " ".join(words[100:900]))], spark.createDataFrame([(1, " ".join(item)), (2, "w1 w2 w3 zz")], "item_id long, text string")
    want = sorted(map(tuple, decontaminate.leaks(docs(rows), table).collect()))
    assert [(x[0], x[1], x[2], x[3], x[4]) for x in want] == [(1, 1, 1.0, 0, 40)]
    monkeypatch.setattr(decontaminate, "SEGMENT", 64)
    assert sorted(map(tuple, decontaminate.leaks(docs(rows), table).collect())) == want


def test_leak_passes_and_odd_rows(docs, odd, spark, monkeypatch):
    table = spark.createDataFrame([(1, "one two three four five six"), (2, "some words here"), (2, "some words here")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PASS_WORDS", 4)
    got = sorted((x.doc_id or 0, x.item_id, x.first_word, x.end_word) for x in decontaminate.leaks(docs(odd + [(11, "zero one two three four five six")]), table).collect())
    assert got == [(0, 2, 0, 3), (0, 2, 0, 3), (11, 1, 1, 7)]
    assert decontaminate.leaks(docs(odd).limit(0), table).count() == 0 and decontaminate.leaks(docs(odd), table.limit(0)).count() == 0


def test_hamming_index_finds_all_within_its_radius():
    rng = np.random.default_rng(3)
    index = decontaminate.Index(list(range(40)), [rng.integers(0, 2**63, 12, dtype=np.uint64) for _ in range(40)])
    base = index.prints[rng.integers(0, 40, 600)]
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(0, 16), replace=False).astype(np.uint64), initial=np.uint64(0)) for _ in base])
    prints = base ^ flips
    want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(prints[:, None] ^ index.prints[None]) <= decontaminate.RADIUS))}
    assert set(zip(*index.near(prints))) == want


# -- op5
def test_rollup_follows_deltas_and_replays(docs, odd, spark, tmp_path):
    rows = prose(13, 20) + [(100 + i, *x[1:]) for i, x in enumerate(odd) if x[0] != 7]
    from pyspark.sql import functions as F

    table = docs(rows).withColumn("lang", F.lit("en"))
    counts = token_counts.count_tokens(table).cache()
    words = {r.doc_id: r.n_tokens for r in counts.where("version = 'words'").collect()}
    assert words == {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = {r.doc_id: r.n_tokens for r in counts.where("version = 'byte_bpe_50k'").collect()}
    assert bpe == {r[0]: len(coder.encode_ordinary(r[1] or "")) for r in rows} and coder.decode(coder.encode_ordinary("<|endoftext|> é")) == "<|endoftext|> é"
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    assert rollup.commit("load", token_counts.signed(counts, 1)) and not rollup.commit("load", token_counts.signed(counts, 1))
    gone, changed = counts.where("doc_id = 0"), counts.where("doc_id = 1")
    rollup.commit("out", token_counts.signed(gone, -1))
    (tmp_path / "r" / "rows" / "broken-1").mkdir()  # a write that broke off has no marker
    rollup.commit("edit", token_counts.revised(changed, changed.withColumn("n_tokens", F.lit(7).cast("long"))))
    got = {(r.source, r.version): (r.docs, r.tokens) for r in token_counts.Rollup(spark, f"file://{tmp_path}/r").totals().collect()}
    for name, n in (("words", words), ("byte_bpe_50k", bpe)):
        want = Counter()
        for r in rows:
            if r[0] != 0:
                want[(*r, "s")[2]] += 7 if r[0] == 1 else n[r[0]]
        assert {s: t for (s, v), (_, t) in got.items() if v == name} == dict(want)
    assert rollup.commit("none", token_counts.signed(counts.limit(0), 1))
    with pytest.raises(ValueError):
        rollup.commit("../x", token_counts.signed(counts, 1))


def test_long_runs_of_white_space(docs, monkeypatch):
    import public_tokenizers
    import tiktoken
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    monkeypatch.setattr(token_counts, "_BLANKS", __import__("re").compile(token_counts._BLANKS.pattern.replace(f"{{{token_counts.LONG},}}", "{3,}")))
    r = random.Random(5)
    for _ in range(400):
        text = "".join(r.choice([" ", " ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "a", "Zé", "7", "!", "'s"]) for _ in range(r.randrange(40)))
        assert token_counts.n_tokens(coder, text) == len(coder.encode_ordinary(text)), repr(text)
    monkeypatch.undo()
    rows = [(1, " " * 1_000_000), (2, "a" + "\n" * 300_000 + "b"), (3, "x" * 300_000), (4, None)]
    got = {x.doc_id: x.n_tokens for x in token_counts.count_tokens(docs(rows).selectExpr("*", "'en' AS lang")).where("version <> 'words'").collect()}
    assert got[1] == len(coder._encode_single_piece(" " * 1_000_000)) and got[2] == 2 + len(coder._encode_single_piece("\n" * 299_999)) + 1 and got[4] == 0


def test_commits_of_one_batch(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([("s", "en", "words", 1, n), (None, None, "words", 1, 2)], token_counts.SCHEMA)
    a, b = (token_counts.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    # two writers that both have seen no marker: one of them commits
    first, looked = b._marker, []
    b._marker = lambda batch: first(batch) if looked else looked.append(batch)
    assert a.commit("one", rows(5)) and not b.commit("one", rows(5))
    with pytest.raises(token_counts.BatchConflict):
        a.commit("one", rows(6))
    assert sorted((x.source or "", x.docs, x.tokens) for x in a.totals().collect()) == [("", 1, 2), ("s", 1, 5)]
    assert len(list((tmp_path / "r" / "rows").iterdir())) == 1


def test_registered_totals_count_whole_texts(spark, tmp_path):
    from tessera.llm import queries

    texts = ["one  two\nthree four", "five\n\nsix seven", "gone\nwith all", None, "\n late "]
    spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.version: (r.docs, r.tokens) for r in queries.op5_token_counts(spark, str(tmp_path)).collect()}
    assert got["words"] == (4, 8)


def test_registered_totals_move_no_texts_but_of_many_labels(spark, tmp_path, monkeypatch):
    from tessera.llm import queries

    spark.createDataFrame([(i, f"a  b{' c' * i}" if i else None, "en", "s") for i in (*range(60), 7)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in (*range(40), 4, 99)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plans, made = [], token_counts.count_tokens
    monkeypatch.setattr(token_counts, "count_tokens", lambda docs: plans.append(docs._jdf.queryExecution().executedPlan().toString()) or made(docs))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        totals = [{tuple(r) for r in queries.op5_token_counts(spark, str(tmp_path)).collect()}]
        monkeypatch.setattr(queries, "BROADCAST_IDS", 3, raising=False)
        totals.append({tuple(r) for r in queries.op5_token_counts(spark, str(tmp_path)).collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plans[1] and "SortMergeJoin" not in plans[1] and "SortMergeJoin" in plans[3]
    kept = [i for i in (*range(60), 7) if not (i < 40 and i % 3 == 0)]
    assert totals[0] == totals[1] and ("s", "en", "words", len(kept), sum(2 + i for i in kept)) in totals[0]
