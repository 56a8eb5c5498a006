"""HTML extraction by wrapper induction.

A page becomes a tree of its block elements, menus, notices and footers included; only what no browser shows as
text (scripts, styles, hidden parts, controls) is left out. Like siblings in running text (paragraphs, items, cells) share
one node, and so do those behind the first FOLD of other like siblings. The trees of a host's pages are aligned by simple tree matching
and merged to a template, first the pages that one task reads, then the tasks' templates, a few at a time. A node counts its pages, the
characters of its texts and of its links, and the texts that stand at it.

A text that stands at its node on CONSTANT of the host's pages, and on LEAST of them at least, is template; whatever
varies is a slot. The content is the slots of one part of the template: from the root, the walk goes on to the
child that holds SHARE of the varying characters outside links, over all pages of the host, until there is none.
Lists and parts in it whose text is links alone on all pages are menus. Each page is then aligned with its template, and its blocks at content slots
are its text, with a headline (h1) outside that part if it varies. What varies in the part itself, like advertisements and readers' comments, no template
tells from the article: elements that say so by their kind (nav, aside, form, ...) or by the words in their class, id or role are no content, and
count little in the walk; article and main count more. A page on which nothing is left, or that has no such part, as its host has too few pages like it, is read by
itself in the same way, as a template of one page.

Counts of texts are upper bounds by lossy counting: only what
stands on at most a share LOSS of the pages seen goes, and what comes later is counted as if it had stood on that
share, so nothing on CONSTANT of the pages is ever lost and a template stays small however many pages a host has. Where a template
has such texts, a second pass over its pages counts them exactly.

Text is decoded; white space in a block becomes one space; blocks are joined by an empty line.

Defined results: null or empty html, and pages without content, give empty text; broken or unclosed markup is
read with HTML's implied ends, and depth and length of a page have no bound; a quote that never closes ends with its tag; a page without a host is of the host ''; repeated rows count as pages; an
empty table gives an empty result. Nothing else is dropped or cut.
"""

from __future__ import annotations

import html as entities
import math
import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import discard, input_bytes, settle

CONSTANT = 0.8
LEAST = 3
SHARE = 0.6
FOLD = 8
LOSS = (0.1, 0.3, 0.5)  # in one task's templates, and in the two rounds that merge them; below CONSTANT
TEMPLATE_BYTES = 64 << 20
#: Weights in the walk of what calls itself boilerplate, and of what calls itself the article.
SUSPECT, ARTICLE = 0.05, 2.0
MENU = 0.9

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe noframes noembed xmp svg math canvas audio video object select title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre td th tr tbody thead tfoot caption table figure figcaption".split())
ENDS_P = BLOCK - frozenset("body html tbody td tfoot th thead tr caption legend optgroup option".split())
SIBLING = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "thead tbody tr td th", "tfoot": "tbody tr td th"}
SCOPE = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table", "th": "table", "thead": "table", "tbody": "table", "tfoot": "table", "option": "select"}
OFF = frozenset("head button".split())
KINDS = frozenset("nav footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription taboola tags toolbar widget widgets topbar header".split()
)
SIBLING = {k: frozenset(v.split()) for k, v in SIBLING.items()}
SCOPE = {k: frozenset(v.split()) for k, v in SCOPE.items()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = ("article", "main")

_BARE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>=]")
_QUOTE = re.compile(r"\s*([\"'])")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_LONG_NUMBER = re.compile(r"&#([0-9]{9,});?")


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


class Page:
    """The block elements of a page in page order, 0 being the page itself, and its blocks: text, element, characters in links."""

    __slots__ = ("tags", "labels", "parents", "suspect", "blocks")

    def __init__(self) -> None:
        self.tags, self.labels, self.parents, self.suspect = ["#page"], ["#page"], [-1], [False]
        self.blocks: list[tuple[str, int, int]] = []


def _named(tag: str, attrs: str, in_main: bool) -> tuple[str, bool, bool]:
    """An element's label, whether it says that it is boilerplate, and whether it is hidden."""
    label, suspect, off = tag, tag in KINDS or (tag == "header" and not in_main), tag in OFF
    if attrs and not attrs.isspace():
        found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(attrs)}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if names != " ":
            words = set(_WORD.findall(_CAMEL.sub(r"\1 \2", names).lower()))
            label = f"{tag}.{' '.join(sorted(words))}"
            if in_main:
                words -= {"header", "masthead"}  # the heading of the article itself
            if tag not in ("html", "body", "main") and not (tag == "article" and not words & {"comment", "comments", "reply"}):
                suspect = suspect or bool(words & WORDS)
        suspect = suspect or found.get("role", "").lower() in ROLES
        off = off or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    return label, suspect, off


def _number(m: re.Match) -> str:
    digits = m[1].lstrip("0")
    return f"&#{digits or '0'};" if len(digits) < 9 else "�"


def parse(source: str) -> Page:
    page = Page()
    # open elements: tag, the block element that they are or are in, whether they are one, in a link, not shown
    stack: list[tuple[str, int, bool, bool, bool]] = [("#page", 0, True, False, False)]
    open_: defaultdict[str, int] = defaultdict(int)
    piece: list[str] = []
    linked, at, end = 0, 0, len(source)
    lacking: set[str] = set()  # what doesn't stand in the rest of the page

    def find(what: str, start: int) -> int:
        if what in lacking:
            return -1
        i = source.find(what, start)
        if i < 0:
            lacking.add(what)
        return i

    def flush() -> None:
        nonlocal linked
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                page.blocks.append((text, stack[-1][1], linked))
            piece.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        _, _, _, link, off = stack[-1]
        if off or not text:
            return
        if "&" in text:
            text = entities.unescape(_LONG_NUMBER.sub(_number, text) if "&#" in text else text)
        piece.append(text)
        if link:
            linked += len(text)

    def close(i: int) -> None:
        """Ends the open elements from i on."""
        if i == len(stack) - 1:
            if stack[i][2]:
                flush()
            open_[stack.pop()[0]] -= 1
            return
        for _, _, block, _, _ in stack[i:]:
            if block:
                flush()
                break
        for tag, *_ in stack[i:]:
            open_[tag] -= 1
        del stack[i:]

    while at < end:
        i = source.find("<", at)
        if i < 0:
            put(source[at:])
            break
        if i > at:
            put(source[at:i])
        m = _BARE.match(source, i)
        if m is not None:
            tag, at, ends, attrs = m[2].lower(), m.end(), m[1] == "/", ""
        else:
            c = source[i + 1 : i + 2]
            ends = c == "/"
            m = _NAME.match(source, i + 1 + ends)
            attrs = None
        if m is None:
            if c in ("!", "?") or ends:
                mark = "-->" if source.startswith("<!--", i) else ">"
                j = find(mark, i + 2)
                at = j + len(mark) if j >= 0 else end
            else:
                put("<")
                at = i + 1
            continue
        if attrs is None:
            tag, at = m[0].lower(), m.end()
        while attrs is None:  # to the tag's end, past quoted values
            stop = _STOP.search(source, at)
            if stop is None:
                at = end + 1
                break
            at = stop.end()
            if stop[0] == ">":
                break
            quote = _QUOTE.match(source, at)
            if quote:
                j = find(quote[1], quote.end())
                if j < 0:
                    j = source.find(">", quote.end())
                    at = j + 1 if j >= 0 else end + 1
                    break
                at = j + 1
        if at > end:
            break  # the page ends within the tag
        if ends:
            if open_[tag] <= 0:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i][2]:
                    break  # a stray end of an inline element doesn't end blocks
            continue
        attrs = source[m.end() : at - 1] if attrs is None else attrs
        if tag in RAW:
            if attrs.endswith("/") and tag in ("svg", "math"):
                continue
            mark = f"</{tag}"
            found = None if mark in lacking else _CLOSE[tag].search(source, at)
            if found is None:
                lacking.add(mark)
            at = found.end() if found else end
            continue
        if tag in VOID:
            put(" ")
            if tag == "hr":
                flush()
            continue
        if open_["head"] > 0 and tag in BLOCK:
            close(next(i for i, x in enumerate(stack) if x[0] == "head"))
        if tag in ENDS_P and open_["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in ("button", "table", "td", "th", "caption"):
                    break
        if tag in SIBLING and sum(map(open_.__getitem__, SIBLING[tag])):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SCOPE[tag]:
                    break
                if stack[i][0] in SIBLING[tag]:
                    close(i)
                    if tag not in ("tr", "tbody", "tfoot", "thead"):
                        break
        if tag in HEADINGS and stack[-1][0] in HEADINGS:
            close(len(stack) - 1)
        label, suspect, off = _named(tag, attrs, open_["article"] + open_["main"] > 0)
        _, inside, _, link, hidden = stack[-1]
        block = tag in BLOCK
        if block:
            flush()
            page.tags.append(tag)
            page.labels.append(label)
            page.parents.append(inside)
            page.suspect.append(suspect)
            inside = len(page.tags) - 1
        open_[tag] += 1
        stack.append((tag, inside, block, link or tag == "a", hidden or off or (suspect and not block)))
    flush()
    return page


class Tree:
    """A template, or a page as one: nodes in an order with parents first, 0 being the root."""

    __slots__ = ("labels", "suspect", "pages", "chars", "links", "texts", "kids")

    def __init__(self) -> None:
        self.labels: list[str] = []
        self.suspect: list[bool] = []
        self.pages: list[int] = []
        self.chars: list[int] = []
        self.links: list[int] = []
        self.texts: list[dict[int, int]] = []
        self.kids: list[list[int]] = []

    def add(self, label: str, suspect: bool, pages: int, chars: int = 0, links: int = 0, texts: dict[int, int] | None = None) -> int:
        self.labels.append(label)
        self.suspect.append(suspect)
        self.pages.append(pages)
        self.chars.append(chars)
        self.links.append(links)
        self.texts.append(texts or {})
        self.kids.append([])
        return len(self.labels) - 1

    def __len__(self) -> int:
        return len(self.labels)

    def weight(self) -> int:
        return len(self.labels) + sum(map(len, self.texts))

    def packed(self) -> bytes:
        return pickle.dumps([getattr(self, k) for k in self.__slots__])

    @classmethod
    def opened(cls, data: bytes) -> Tree:
        tree = cls()
        for k, v in zip(cls.__slots__, pickle.loads(data), strict=True):
            setattr(tree, k, v)
        return tree


def tag_of(label: str) -> str:
    return label.partition(".")[0]


def _key(text: str) -> int:
    """A text's digest, with its length above it."""
    return len(text) << 32 | zlib.crc32(text.encode("utf-8", "surrogatepass"))


def outline(page: Page) -> tuple[Tree, list[int]]:
    """A page as a template of one page, and the node of each of its elements that holds text (-1: none)."""
    holds = [False] * len(page.tags)
    holds[0] = True
    for _, e, _ in page.blocks:
        while not holds[e]:
            holds[e] = True
            e = page.parents[e]
    tree, place = Tree(), [-1] * len(page.tags)
    place[0] = tree.add("#page", False, 1)
    nodes: dict[tuple[int, str, int], int] = {}
    seen: dict[tuple[int, str], int] = {}
    for e in range(1, len(page.tags)):
        if not holds[e]:
            continue
        up, label = page.parents[e], page.labels[e]
        nth = 0
        if page.tags[e] not in FLOW:
            nth = seen[up, label] = seen.get((up, label), -1) + 1
        key = (place[up], label, min(nth, FOLD))
        if key not in nodes:
            nodes[key] = tree.add(label, page.suspect[e], 1)
            tree.kids[place[up]].append(nodes[key])
        place[e] = nodes[key]
    for text, e, linked in page.blocks:
        x = place[e]
        tree.chars[x] += len(text)
        tree.links[x] += min(linked, len(text))
        tree.texts[x][_key(text)] = 1
    return tree, place


def _shapes(tree: Tree) -> tuple[list[int], list[int]]:
    """Of each node, a hash of the labels below it, and how many nodes these are."""
    shape, size = [0] * len(tree), [1] * len(tree)
    for x in _upwards(tree):
        shape[x] = hash((tree.labels[x], *[shape[k] for k in tree.kids[x]]))
        size[x] = 1 + sum(size[k] for k in tree.kids[x])
    return shape, size


def _downwards(tree: Tree) -> list[int]:
    out, i = [0], 0
    while i < len(out):
        out += tree.kids[out[i]]
        i += 1
    return out


def _upwards(tree: Tree) -> list[int]:
    return _downwards(tree)[::-1]


def heaviest(steps: list[tuple[int, int, int]], weight: list[int]) -> tuple[int, list[int]]:
    """Of (place in a, place in b, number of a pair), the pairs that rise in both and weigh most."""
    if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(steps, steps[1:], strict=False)):
        return sum(weight[n] for _, _, n in steps), [n for _, _, n in steps]
    top = max(y for _, y, _ in steps) + 2
    best: list[tuple[int, int]] = [(0, -1)] * (top + 1)  # a Fenwick tree over places in b: weight, last step
    back, total = [-1] * len(steps), [0] * len(steps)
    for k in sorted(range(len(steps)), key=lambda k: (steps[k][0], -steps[k][1])):
        _, y, n = steps[k]
        i, got = y, (0, -1)
        while i:
            got = max(got, best[i], key=lambda g: g[0])
            i -= i & -i
        total[k], back[k] = got[0] + weight[n], got[1]
        i = y + 1
        while i <= top:
            if best[i][0] < total[k]:
                best[i] = (total[k], k)
            i += i & -i
    k = max(range(len(steps)), key=total.__getitem__)
    most, out = total[k], []
    while k >= 0:
        out.append(steps[k][2])
        k = back[k]
    return most, out[::-1]


def align(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Simple tree matching from the roots: the most pairs of nodes with one label whose parents are a pair, siblings in order.

    Equal subtrees are matched as they are.
    """
    (shape_a, size), (shape_b, _) = _shapes(a), _shapes(b)
    pairs: list[tuple[int, int]] = [(0, 0)]
    below: list[list[tuple[int, int, int]]] = []
    i = 0
    while i < len(pairs):
        x, y = pairs[i]
        steps: list[tuple[int, int, int]] = []
        if shape_a[x] != shape_b[y] and a.kids[x] and b.kids[y]:
            places: dict[str, list[int]] = {}
            for q, k in enumerate(b.kids[y]):
                places.setdefault(b.labels[k], []).append(q)
            for p, k in enumerate(a.kids[x]):
                for q in places.get(a.labels[k], ()):
                    steps.append((p, q, len(pairs)))
                    pairs.append((k, b.kids[y][q]))
        below.append(steps)
        i += 1
    weight, chosen = [1] * len(pairs), [[]] * len(pairs)
    for i in range(len(pairs) - 1, -1, -1):
        x, y = pairs[i]
        if shape_a[x] == shape_b[y]:
            weight[i] = size[x]
        elif below[i]:
            most, chosen[i] = heaviest(below[i], weight)
            weight[i] = 1 + most
    out, todo = [], [0]
    while todo:
        i = todo.pop()
        x, y = pairs[i]
        if shape_a[x] != shape_b[y]:
            out.append((x, y))
            todo += chosen[i]
            continue
        both = [(x, y)]
        while both:
            x, y = both.pop()
            out.append((x, y))
            both += zip(a.kids[x], b.kids[y], strict=True)
    return out


def merge(a: Tree, b: Tree, lost_a: int = 0, lost_b: int = 0) -> Tree:
    """b into a, of one host: nodes that match are one node, the others stand beside them.

    lost_a, lost_b: the pages that a node or text may have stood on which the template no longer has.
    """
    pairs = align(a, b)
    mate = {y: x for x, y in pairs}
    if lost_b:
        for x in set(range(len(a))) - {x for x, _ in pairs}:
            a.pages[x] += lost_b
            a.texts[x] = {k: n + lost_b for k, n in a.texts[x].items()}
    for x, y in pairs:
        a.pages[x] += b.pages[y]
        a.chars[x] += b.chars[y]
        a.links[x] += b.links[y]
        own, new = a.texts[x], b.texts[y]
        if lost_b:
            own = {k: n + (0 if k in new else lost_b) for k, n in own.items()}
        for k, n in new.items():
            own[k] = own[k] + n if k in own else n + lost_a
        a.texts[x] = own
    for up in _downwards(b):
        last = -1
        for y in b.kids[up]:
            if y not in mate:
                mate[y] = a.add(b.labels[y], b.suspect[y], b.pages[y] + lost_a, b.chars[y], b.links[y], {k: n + lost_a for k, n in b.texts[y].items()})
                kids = a.kids[mate[up]]
                kids.insert(kids.index(last) + 1 if last >= 0 else 0, mate[y])
            last = mate[y]
    return a


def lost(pages: int, loss: float) -> int:
    return int(loss * pages)


def prune(t: Tree, nodes: float, texts: float) -> Tree:
    """A template with the nodes and texts on more than so many pages."""
    out, place = Tree(), {}
    todo = [(0, -1)]
    while todo:
        x, up = todo.pop()
        place[x] = out.add(t.labels[x], t.suspect[x], t.pages[x], t.chars[x], t.links[x], {k: n for k, n in t.texts[x].items() if n > texts})
        if up >= 0:
            out.kids[place[up]].append(place[x])
        todo += [(k, x) for k in reversed(t.kids[x]) if t.pages[k] > nodes]
    return out


def needed(pages: int) -> float:
    """Pages that a text must stand on to be template."""
    return max(LEAST, CONSTANT * pages)


def part(t: Tree) -> tuple[int, set[int]]:
    """The node whose slots are the content, and the nodes in it that are menus."""
    n, least = len(t), needed(t.pages[0])
    varying, chars, links = [0.0] * n, list(t.chars), list(t.links)
    doubt = list(t.suspect)
    order = _downwards(t)
    for x in order:
        for k in t.kids[x]:
            doubt[k] = doubt[k] or doubt[x]
    for x in reversed(order):
        same = sum((k >> 32) * c for k, c in t.texts[x].items() if c >= least)
        varying[x] += max(0, t.chars[x] - t.links[x] - same) * (SUSPECT if doubt[x] else 1.0)
        for k in t.kids[x]:
            varying[x] += varying[k]
            chars[x] += chars[k]
            links[x] += links[k]
    here = 0
    while True:
        inner = [(varying[k] * (ARTICLE if tag_of(t.labels[k]) in MAIN else 1.0), k) for k in t.kids[here] if tag_of(t.labels[k]) not in FLOW]
        most, k = max(inner, key=lambda v: v[0], default=(0.0, -1))
        if not most or most < SHARE * varying[here]:
            break
        here = k
    menus = set()
    if t.pages[0] >= LEAST:
        lists = FLOW - frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre caption figcaption".split())
        menus = {x for x in order if chars[x] and links[x] >= MENU * chars[x] and (tag_of(t.labels[x]) in lists or tag_of(t.labels[x]) not in FLOW)}
    return here, menus


class Template:
    """A host's template as pages are read with it."""

    def __init__(self, tree: Tree) -> None:
        self.tree = tree
        self.least = needed(tree.pages[0])
        self.part, self.menus = part(tree)


def content(page: Page, template: Template | None) -> str:
    """The text at the content slots."""
    tree, place = outline(page)
    kept = _slots(page, tree, place, template, dict((y, x) for x, y in align(template.tree, tree))) if template else []
    if not kept:
        alone = Template(tree)
        kept = _slots(page, tree, place, alone, {x: x for x in range(len(tree))})
    return "\n\n".join(kept)


def _slots(page: Page, tree: Tree, place: list[int], t: Template, to: dict[int, int]) -> list[str]:
    """to: the template's node for a node of the page."""
    home = next((y for y, x in to.items() if x == t.part), None)
    inside, clean, sure = [False] * len(tree), [False] * len(tree), [not s for s in tree.suspect]
    for y in _downwards(tree):
        if y == home:
            inside[y] = clean[y] = True
        for k in tree.kids[y]:
            sure[k] = sure[k] and sure[y]
            inside[k] = inside[k] or inside[y]
            clean[k] = clean[y] and not tree.suspect[k] and to.get(k) not in t.menus
    out, in_part = [], False
    for text, e, _ in page.blocks:
        y = place[e]
        x = to.get(y)
        if x is not None and t.tree.texts[x].get(_key(text), 0) >= t.least:
            continue
        if inside[y] and clean[y]:
            in_part = True
            out.append(text)
        elif not inside[y] and sure[y] and page.tags[e] == "h1":
            out.append(text)
    return out if in_part else []


def induce(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """_host, _template, _texts: one packed template for each host, and how many texts it may have in common."""
    salts = max(16, math.isqrt(max(1, min(input_bytes(pages), 1 << 60) >> 27)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Tree] = {}
        held = 0
        for b in batches:
            for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not h:
                    continue
                one, name = outline(parse(h))[0], host(u)
                old = known.get(name)
                if old is not None:
                    before, held = lost(old.pages[0], LOSS[0]), held - old.weight()
                    one = merge(old, one, before)
                    now = lost(one.pages[0], LOSS[0])
                    one = prune(one, now, now) if now > before else one
                known[name] = one
                held += one.weight()
                if held > 1_000_000:
                    yield rows(known)
                    known, held = {}, 0
        yield rows(known)

    def rows(known: dict[str, Tree]) -> pa.RecordBatch:
        names = sorted(known)
        packed = [known[n].packed() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([zlib.crc32(x) % salts for x in packed], pa.int32()), pa.array(packed, pa.binary())], ["_host", "_salt", "_template"])

    def join(salted: bool):
        loss, part_loss = (LOSS[1], LOSS[0]) if salted else (LOSS[2], LOSS[1])

        def add(group: pa.Table) -> pa.Table:
            total = None
            for x in sorted(group.column("_template").to_pylist()):
                t = Tree.opened(x)
                if total is not None:
                    t = merge(total, t, lost(total.pages[0], loss), lost(t.pages[0], part_loss))
                gone = lost(t.pages[0], loss)
                total = prune(t, gone, gone)
            first = group.slice(0, 1)
            if salted:
                return pa.table({"_host": first.column("_host"), "_salt": pa.array([0], pa.int32()), "_template": pa.array([total.packed()], pa.binary())})
            # only texts that may be template are kept, and what none of them is needs no more
            total = prune(total, lost(total.pages[0], loss), needed(total.pages[0]) - 1e-9)
            return pa.table({"_host": first.column("_host"), "_template": pa.array([total.packed()], pa.binary()), "_texts": pa.array([sum(map(len, total.texts))], pa.int64())})

        return add

    parts = pages.select(F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h")).mapInArrow(learn, "_host string, _salt int, _template binary")
    parts = parts.groupBy("_host", "_salt").applyInArrow(join(True), "_host string, _salt int, _template binary")
    return parts.groupBy("_host").applyInArrow(join(False), "_host string, _template binary, _texts long")


def _aligned(pages: DataFrame, templates: DataFrame, columns: list[str], opened, each, out: str) -> DataFrame:
    """each(rows) for batches of rows (columns of pages, the last two of them url and html; opened(template)), packed templates by _host."""
    size = templates.agg(F.sum(F.length("_template") + F.length("_host"))).first()[0] or 0
    rows = pages.select(*columns)

    if size <= TEMPLATE_BYTES:
        held = pages.sparkSession.sparkContext.broadcast({r._host: bytes(r._template) for r in templates.select("_host", "_template").collect()})

        def map_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, object] = {}

            def of(name: str):
                if name not in known and name in held.value:
                    known[name] = opened(held.value[name])
                return known.get(name)

            yield from each((b, [of(host(u)) for u in b.column(len(columns) - 2).to_pylist()]) for b in batches)

        return rows.mapInArrow(map_held, out)

    name = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))

    def map_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def beside() -> Iterator[tuple[pa.RecordBatch, list]]:
            last: tuple = (None, None)
            for b in batches:
                known = []
                for t in b.column(len(columns)).to_pylist():
                    if t != last[0]:
                        last = (t, opened(t) if t else None)
                    known.append(last[1])
                yield b, known

        yield from each(beside())

    joined = rows.withColumn("_h", name).join(templates.select("_host", "_template").hint("merge"), F.col("_h") == F.col("_host"), "left")
    return joined.select(*columns, "_template").mapInArrow(map_joined, out)


def recount(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """_host, _template with the exact numbers of pages that have its texts."""

    def tally(batches: Iterator[tuple[pa.RecordBatch, list]]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, int], int] = {}

        def told() -> pa.RecordBatch:
            keys = list(seen)
            cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["_host", "node", "digest", "n"])

        for b, known in batches:
            for u, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), known, strict=True):
                if not h or t is None or not any(t.texts):
                    continue
                tree, name = outline(parse(h))[0], host(u)
                for x, y in align(t, tree):
                    for k in tree.texts[y]:
                        if k in t.texts[x]:
                            seen[name, x, k] = seen.get((name, x, k), 0) + 1
            if len(seen) > 200_000:
                yield told()
                seen.clear()
        yield told()

    def put(template: pa.Table, counts: pa.Table) -> pa.Table:
        at = {(x, d): n for x, d, n in zip(*(counts.column(c).to_pylist() for c in ("node", "digest", "n")), strict=True)}
        packed = []
        for data in template.column("_template").to_pylist():
            t = Tree.opened(data)
            t.texts = [{k: at[x, k] for k in texts if (x, k) in at} for x, texts in enumerate(t.texts)]
            packed.append(t.packed())
        return pa.table({"_host": template.column("_host"), "_template": pa.array(packed, pa.binary())})

    counts = _aligned(rows, templates, ["url", "h"], Tree.opened, tally, "_host string, node int, digest long, n long")
    counts = counts.groupBy("_host", "node", "digest").agg(F.sum("n").alias("n"))
    return templates.groupBy("_host").cogroup(counts.groupBy("_host")).applyInArrow(put, "_host string, _template binary")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("h"))
    templates = settle(induce(pages, url, html))
    if not templates.where("_texts > 0").isEmpty():
        templates, old = settle(recount(rows, templates)), templates
        discard(old)

    def finish(batches: Iterator[tuple[pa.RecordBatch, list]]) -> Iterator[pa.RecordBatch]:
        for b, known in batches:
            texts = [content(parse(h), t) if h else "" for h, t in zip(b.column(2).to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return _aligned(rows, templates, ["page_id", "url", "h"], lambda data: Template(Tree.opened(data)), finish, "page_id long, url string, text string, n_chars long")
