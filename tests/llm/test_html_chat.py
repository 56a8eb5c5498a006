from __future__ import annotations

import json
import random
import time

import pytest

from tessera.llm import html_text, tool_calls

ODD_PAGES = [(1, "http://h.org/a", None), (2, "http://h.org/b", ""), (3, None, "<p>alone"), (4, "nonsense", "no markup &amp; all"), (4, "nonsense", "no markup &amp; all"), (5, "http://h.org/c", "<div " + "<p>x" * 3000), (6, "http://h.org/d", "<script>only</script>")]


def page(i, body, extra=""):
    nav = "".join(f"<li><a href='/{i}-{k}'>Item {k}</a>" for k in range(4))
    return f"""<!DOCTYPE html><html><head><title>t{i}</title><style>p{{x:"</p>"}}</style></head><body><header><h2>Site</h2></header><nav><ul>{nav}</ul></nav>
<div id=cookie-notice>We use cookies</div><div class="main-ad adBanner">Buy {i}</div>{body}<aside>Aside {i}</aside><form>Name <input></form>
<section class="comments"><article class="comment"><p>First {i}!</p></article></section>{extra}<footer>&copy; us</footer><script>var x = "<p>no</p>"</script>"""


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r for r in html_text.extract(df).collect()}


def test_articles_with_and_without_semantic_tags(spark):
    r = random.Random(1)
    rows, want = [], {}
    for i in range(40):
        paras = [f"Para {i} {k} " + " ".join(f"w{r.randrange(99)}" for _ in range(12)) for k in range(r.randrange(1, 6))]
        open_ = r.random() < 0.5  # unclosed paragraphs
        inner = f"<h1>Head &lt;{i}&gt;</h1>" + "".join(f"<p>{p[:10]}<b>{p[10:]}" + ("" if open_ else "</b></p>") for p in paras)
        wrap = "<article>{}</article>" if i % 2 else '<div class="wrap"><div class="story">{}</div></div>'
        rows.append((i, f"https://{'a' if i % 3 else 'b'}.example.org:80/{i}", page(i, wrap.format(inner))))
        want[i] = "\n\n".join([f"Head <{i}>", *paras])
    got = texts(spark, rows)
    assert {i: x.text for i, x in got.items()} == want and all(x.n_chars == len(x.text) for x in got.values())


def test_constant_blocks_of_a_host_are_template(spark):
    rows = [(i, "http://c.org/x", f"<body><div><p>Welcome to our site, read on</p><p>Body of {i}</p><p>Written by the team, all rights kept</p></div>") for i in range(20)]
    rows += [(100 + i, f"http://other{i}.org/", rows[0][2]) for i in range(2)]
    got = texts(spark, rows)
    assert {got[i].text for i in range(20)} == {f"Body of {i}" for i in range(20)}
    assert got[100].text.startswith("Welcome")  # a host of one page has no template


def test_templates_of_more_than_400_nodes(spark):
    terms = "".join(f"<dt>Term {k}<dd>Meaning {k}" for k in range(210))
    rows = [(i, "http://long.org/", f"<div><dl>{terms}</dl><p>Own text of {i}</p></div>") for i in range(12)]
    assert {i: r.text for i, r in texts(spark, rows).items()} == {i: f"Own text of {i}" for i in range(12)}


@pytest.mark.parametrize("first", [0, 3])
def test_constant_texts_among_many_others(spark, first):
    """Texts on 90% of the pages that are missing on the first of them, beside 40 other paragraphs."""
    own = lambda i: [f"Paragraph {k} of {i}" for k in range(40)]
    lines = [f"Line {k} that the site repeats" for k in range(8)]
    rows = [(i, "http://c.org/x", "<div>" + "".join(f"<p>{x}</p>" for x in (lines if i >= first else []) + own(i)) + "</div>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {i: "\n\n".join(own(i)) for i in range(30)}


def test_odd_pages(spark):
    df = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text[:30], r.n_chars) for r in html_text.extract(df).collect())
    assert got[:2] == [(1, "", 0), (2, "", 0)] and got[2][1] == "alone" and got[3] == got[4] == (4, "no markup & all", 15) and got[6] == (6, "", 0)
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_templates_joined_or_broadcast_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(html_text, "TEMPLATE_BYTES", limit)
    rows = [(i, f"http://{'ab'[i % 2]}.org/", f"<div><p>Same line on all</p><p>Own {i}</p></div>") for i in range(24)]
    assert {i: r.text for i, r in texts(spark, rows).items()} == {i: f"Own {i}" for i in range(24)}


PLAIN = 16


def plain(i, short=False):
    """A page of nothing but div, p and ul: menu, notice, teaser, article, foot; what varies beside the article is short, the notice is long."""
    menu = "".join(f'<div><a href="/{k}">Section {k} of {(i * 7 + k) % 5}</a></div>' for k in range(5))
    own = [f"Title {i}", f"Short {i}."] if short else [f"Title {i}", *(f"Sentence {k} of article {i}, " + "word " * (5 + i % 3) + "end." for k in range(4))]
    notice = "We changed our terms; read on to learn what that means for all of our readers, writers and friends. " * 4
    teaser = f"Weather: {i * 37 % 40} degrees"
    body = "".join(f"<p>{x}</p>" for x in own[1:])
    return f"<body><div><div>{menu}</div><div><div>{notice}</div></div><div><div>{teaser}</div></div><div><h1>{own[0]}</h1>{body}</div><div>Page {i} of many</div></div></body>", "\n\n".join(own)


def test_templates_find_the_article_on_plain_pages(spark, monkeypatch):
    rows, want = [], {}
    for i in range(PLAIN):
        html, want[i] = plain(i, i % 4 == 0)
        rows.append((i, "http://plain.org/", html))
    assert {i: r.text for i, r in texts(spark, rows).items()} == want
    alone = {i: html_text.content(html_text.parse(h), None) for i, _, h in rows}  # without the host's template
    assert all(alone[i] != want[i] for i in range(0, PLAIN, 4))


def test_constant_and_varying_copies(spark):
    """Copies of one page are no template of their host, nor are pages of a host with two of them."""
    twin = "<div><p>The same page, twice</p><p>Word for word</p></div>"
    got = texts(spark, [(0, "http://two.org/", twin), (1, "http://two.org/", twin), *((10 + i, "http://five.org/", twin) for i in range(5))])
    assert {r.text for r in got.values()} == {"The same page, twice\n\nWord for word"}


def tree(label, *kids, texts=None, pages=1):
    t = html_text.Tree()

    def put(label, kids):
        x = t.add(label, False, pages)
        for k in kids:
            t.kids[x].append(put(k[0], k[1:]))
        return x

    put(label, kids)
    t.texts[0] = dict(texts or {})
    return t


def brute_match(a, x, b, y):
    """Simple tree matching as it is defined."""
    best = [[0] * (len(b.kids[y]) + 1) for _ in range(len(a.kids[x]) + 1)]
    for i, p in enumerate(a.kids[x], 1):
        for j, q in enumerate(b.kids[y], 1):
            both = brute_match(a, p, b, q) if a.labels[p] == b.labels[q] else 0
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + both)
    return 1 + best[-1][-1]


def test_simple_tree_matching():
    r = random.Random(8)

    def grown(depth):
        return (r.choice("pqs"), *(grown(depth - 1) for _ in range(r.randrange(4) if depth else 0)))

    for _ in range(150):
        a, b = tree("root", *grown(3)[1:]), tree("root", *grown(3)[1:])
        pairs = html_text.align(a, b)
        assert len(pairs) == len(set(pairs)) == brute_match(a, 0, b, 0)
        up_a, up_b = ({k: x for x in range(len(t)) for k in t.kids[x]} for t in (a, b))
        mate = dict(pairs)
        for x, y in pairs:
            assert a.labels[x] == b.labels[y] and (x == 0 or mate[up_a[x]] == up_b[y])
    one = tree("root", ("p",), ("div", ("p",), ("ul",)), ("s",))
    m = html_text.merge(one, tree("root", ("div", ("ul",)), ("p",), ("h1",), texts={7: 2}, pages=2))
    assert [m.labels[k] for k in m.kids[0]] == ["p", "div", "p", "h1", "s"] and m.pages[0] == 3 and m.texts[0] == {7: 2}
    assert m.pages[m.kids[0][1]] == 3


def test_hard_pages(spark):
    """Very deep, very wide and never-ending pages; none may take time that grows with the square of its length."""
    deep = "<div>" * 5000 + "<p>core</p>" + "</div>" * 5000
    wide = "<div>" + "".join(f"<h2>Head {k}</h2><p>Text {k}</p>" for k in range(5000)) + "</div>"
    named = "<div>" + "".join(f'<div class="{"abcdefghij"[k % 10] * (k % 7 + 1)}">Part {k}</div>' for k in range(10_000)) + "</div>"
    rows = [(10 * n + i, f"http://{n}.org/", h) for i in range(4) for n, h in enumerate([deep.replace("core", f"core {i}"), wide, named])]
    rows += [(100, "http://q.org/", '<a "' * 8000 + ">tail"), (101, "http://q.org/", '<p>before</p><a href="x>in</a><p>after</p>'), (102, "http://q.org/", "<p>x</p>" + "<!-- " * 20_000), (103, "http://q.org/", "</b>" * 50_000 + "<p>end"), (104, "http://q.org/", "<p>&#" + "9" * 6000 + "; &#0000000000065;</p>"), (105, "http://q.org/", "<b>" * 30_000 + "deep<p>er")]
    began = time.monotonic()
    got = {i: r.text for i, r in texts(spark, rows).items()}
    assert [got[10 * 0 + i] for i in range(4)] == [f"core {i}" for i in range(4)]
    assert got[10].count("\n\n") == 9999 and got[20].count("\n\n") == 9999
    assert got[101].startswith("before") and got[101].endswith("after") and got[102] == "x" and got[103] == "end" and got[104] == "\ufffd A" and got[105] == "deep\n\ner"
    assert time.monotonic() - began < 120


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://h.org/", "<p>x</p>", "mine")], "page_id long, url string, html string, _host string").selectExpr("*", "'a' AS h", "'b' AS _template", "'c' AS u", "1 AS _salt")
    assert [r.text for r in html_text.extract(df).collect()] == ["x"]


def test_character_references_and_broken_ends():
    read = lambda h: html_text.content(html_text.parse(h), None)
    assert read("<p>a&nbsp;b &#233; &amp;amp; &unknown; A&B &lt") == "a b é &amp; &unknown; A&B <"
    assert read("<p>one<p>two</div></p>three") == "one\n\ntwo\n\nthree"
    assert read("<ul><li>a<li>b<ul><li>c</ul></ul>") == "a\n\nb\n\nc"
    assert read("<p>x <i>y</p> z <!-- no --> <![CDATA[q]]><div hidden>h</div><div style='display: none'>n</div>w") == "x y\n\nz\n\nw"
    assert read("<table><tr><td>a<td>b<tr><td>c</table>") == "a\n\nb\n\nc"


# -- op4
SCHEMAS = [("add", "x", "number", True), ("add", "y", "integer", False), ("add", None, None, None)]


def messages(spark, rows):
    return spark.createDataFrame([(c, t, r, json.dumps(x, ensure_ascii=False) if isinstance(x, dict) else x, "mine") for c, t, r, x in rows], "conv_id string, turn long, role string, text string, level string")


def call(i, args, name="add", deps=None):
    return {"id": i, "name": name, "arguments": args, **({"depends_on": deps} if deps else {})}


def linked(spark, rows):
    out = tool_calls.link(messages(spark, rows), spark.createDataFrame([x for x in SCHEMAS if x[1]], "name string, field string, type string, required boolean"))
    return {(r.conv_id, r.call_id): r for r in out.collect()}


def test_links_orders_validates_and_serialises(spark):
    rows = [
        ("c", 0, "user", "hello"),
        ("c", 1, "assistant", {"tool_calls": [call("b", {"y": 2, "x": 1.5}, deps=["a"]), call("a", {"x": 1}), call("late", {"x": "s"})]}),
        ("c", 2, "tool", {"tool_call_id": "a", "content": {"z": 1, "b": [1, "é\n"]}}),
        ("c", 3, "tool", {"tool_call_id": "b", "content": "done"}),
        ("c", 4, "tool", {"tool_call_id": "b", "content": "again"}),
        ("c", 0, "tool", {"tool_call_id": "late", "content": None}),
        ("c", 5, "tool", {"tool_call_id": "ghost", "content": 1}),
        ("d", 1, "assistant", {"tool_calls": [call("a", {"y": 1}), call("p", {"x": 1}, deps=["q"]), call("q", {"x": 1}, deps=["p"]), call("r", {"x": 1}, deps=["none"]), call("s", {"x": 1, "other": 2}), call("t", {"x": 1}, "unknown"), call("u", [1])]}),
        ("d", 2, "assistant", {"tool_calls": [call("a", {"x": 9})]}),
        ("e", 1, "assistant", "{broken"),
        ("e", 2, "tool", None),
        (None, 1, "assistant", {"tool_calls": [call("a", {"x": 1})]}),
        (None, 2, "tool", {"tool_call_id": "a", "content": "null joins null"}),
    ]
    got = linked(spark, rows)
    assert len(got) == 12
    a, b = got["c", "a"], got["c", "b"]
    assert (a.status, a.level, a.valid, a.result_turn) == ("linked", 0, True, 2) and (b.level, b.n_results, b.result_turn, b.valid) == (1, 2, 3, True)
    assert a.json == '{"arguments":{"x":1},"call_id":"a","name":"add","result":{"b":[1,"é\\n"],"z":1}}'
    assert b.json == '{"arguments":{"x":1.5,"y":2},"call_id":"b","name":"add","result":"done"}'
    assert (got["c", "late"].status, got["c", "late"].valid) == ("early", False)
    assert (got["c", "ghost"].status, got["c", "ghost"].valid, got["c", "ghost"].level) == ("orphan", None, None)
    assert (got["d", "a"].n_calls, got["d", "a"].call_turn, got["d", "a"].valid, got["d", "a"].status) == (2, 1, False, "unanswered")
    assert [got["d", x].level for x in "pqr"] == [None] * 3 and [got["d", x].valid for x in "stu"] == [False] * 3
    assert got[None, "a"].status == "linked"


def test_long_chains_and_empty_tables(spark):
    calls = [call(f"k{i}", {"x": i}, deps=[f"k{i - 1}"] if i else None) for i in range(6)]
    got = linked(spark, [("c", 1, "assistant", {"tool_calls": calls[::-1]})])
    assert [got["c", f"k{i}"].level for i in range(6)] == list(range(6))
    assert linked(spark, [("c", 1, "user", "x")]) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_are_longest_paths(spark, seed):
    """Chains, diamonds, cycles and unknown calls, against a plain search."""
    r = random.Random(seed)
    deps = {"c0": []}
    for i in range(1, 40):
        deps[f"c{i}"] = r.choice([[], [f"c{i - 1}"], [f"c{i - 1}"], [f"c{i - 1}"], r.sample([f"c{k}" for k in range(i)], min(i, 3))])
    deps |= {"x": ["y"], "y": ["z"], "z": ["x"], "w": ["x", "c3"], "v": ["w"], "u": ["nobody"], "t": ["u"], "s": ["s"], "r": ["c5", "nobody"]}

    def depth(i, seen=()):
        if i not in deps or i in seen:
            return None
        found = [depth(d, (*seen, i)) for d in deps[i]]
        return None if None in found else 1 + max(found) if found else 0

    got = linked(spark, [("c", 1, "assistant", {"tool_calls": [call(i, {"x": 1}, deps=d) for i, d in sorted(deps.items(), key=lambda x: r.random())]}), ("d", 1, "assistant", {"tool_calls": [call("c1", {"x": 1}, deps=["c0"])]})])
    assert {i: got["c", i].level for i in deps} == {i: depth(i) for i in deps} and got["d", "c1"].level is None


def test_very_long_arguments(spark):
    long = "word " * 400_000
    got = linked(spark, [("c", 1, "assistant", {"tool_calls": [call("a", {"x": long})]}), ("c", 2, "tool", {"tool_call_id": "a", "content": long})])
    assert json.loads(got["c", "a"].json)["result"] == long and got["c", "a"].valid is False


def test_main_path_is_native(spark):
    out = tool_calls.link(messages(spark, [("c", 1, "assistant", {"tool_calls": [call("a", {"x": 1})]})]), spark.createDataFrame([SCHEMAS[0]], "name string, field string, type string, required boolean"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
