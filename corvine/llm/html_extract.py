"""Main text of web pages by wrapper induction.

Pages of one host come from one template. The exemplar of a host is the page whose element paths are most nearly those
that more than half of the host's pages have (then the smallest one), so odd pages do not become one; every page's
DOM tree is aligned with it by simple tree matching (largest order-preserving common top-down tree).
What the aligned nodes hold over the host's distinct titles decides:

* *Where the content is.* From the root on, the wrapper steps into the one element that holds most of the
  text outside links, as long as no headings or paragraphs stand beside it. The node it ends at is the host's
  content slot; everything that is aligned outside of it is template, whatever its tag, class or wording.
* *What in it is template.* An aligned node with the same text on at least ``CONSTANT`` of the titles (and on
  ``LEAST`` of them) is template, a node whose text varies is a slot.

Inside the slot, elements that by tag, role, class or id are menus, notices, adverts, forms or comments go too (``framed``); paragraphs of links stay there. A page that has no
counterpart of the slot, and hosts with fewer than ``LEAST`` titles or without a dominant element, fall back on those lists
alone: article elements, else main elements, else the body without blocks that are mostly links. The column
``way`` says which of the two it was. Copies of a page count once, through their title, so an article that is
republished under several addresses does not look like template.

Only compact trees (labels, text hashes, text lengths) are compared across pages. Templates are broadcast
while their measured size is below ``BROADCAST_CHARS``, and then no page moves at all; beyond that both
joins on host are plain shuffled ones, whose large side can be split when a host is hot, and the html
moves once. One row per (task, host) stands for a host before any shuffle.

Matching is exact for pages of any size. Beyond ``CELLS`` compared pairs of nodes, kinds of subtrees are compared instead, with the same result:
texts that the other page lacks tell no subtrees apart, so the rows of a long table are of few kinds. Time still grows with the product of the two
numbers of siblings and of the two numbers of kinds. Nothing recurses: markup may be nested to any depth.

Defined results: null and empty html give an empty text; broken markup is closed as browsers do for
paragraphs, list items and table cells, stray quotes and unfinished tags as ``tags`` states; pages with null url form one host; repeated rows are extracted
each and count once as evidence; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.storage import written

CONSTANT = 0.5
LEAST = 3
BROADCAST_CHARS = 8 << 20
CELLS = 1 << 17
#: Nodes of subtrees that are compared without the texts that only one of them holds.
SMALL = 64
#: Share of an element's text that one child must hold for the wrapper to step into it.
DOMINANT = 0.5

#: Fixed values of HTML: elements without content, with raw content, inside a line, and what closes an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What is not main text by element, role or class word.
NOT_TEXT = frozenset("head script style noscript template nav footer aside form button select textarea iframe svg object menu dialog header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|sidebar|side|aside|nav\w*|menu|breadcrumbs?"
    r"|comments?|commentlist|reply|replies|discussion|disqus|respond|footer|foot|header|masthead|related|recommend\w*|login|signup|search|widget|toolbar|pagination|pager|copyright|skip\w*)(?:$|[\s_-])",
    re.I,
)
#: Elements that are text by themselves.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
#: What frames a block in names such as ``ad-slot`` or ``related-posts`` without saying what it is.
FRAMES = frozenset("area article articles author bar block body bottom box btn button buttons center col column container content entry fixed form global group head heading icon icons id inline inner item items js left link links list main meta news now outer page pane panel post posts primary reading right row secondary section site slot sticky stories story text this thread title top unit wrap wrapper zone".split())
#: Elements whose content is no markup, and those that are skipped whole where they are closed.
RAW = frozenset("script style textarea iframe".split())
SKIPPED = frozenset("noscript template svg".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_GAP = re.compile(r"[\s/]*")
_PARTS = re.compile(r"[a-z]+|[0-9]+")


def framed(names: str) -> bool:
    """Whether one of the names (class words or an id) says that a block is no main text: its head, the last part that is neither frame nor number, is a word of ``WORDS``.

    So ``ad-slot-2`` and ``reader-comments`` do, ``social-history`` and ``search-results`` do not.
    """
    for name in names.lower().split() if WORDS.search(names) else ():
        head = next((x for x in reversed(_PARTS.findall(name)) if x not in FRAMES and len(x) > 1 and not x.isdigit()), "")
        if WORDS.fullmatch(head):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, dict[str, str] | None]]:
    """(start, end, name, attributes; None for an end tag) in page order; the name is empty for comments, declarations and skipped elements.

    One pass, linear on any input: every look ahead either consumes what it read or happens once a page. Attribute names are whole
    (``data-id`` is no ``id``), the first of a name counts, quotes count only as the first character of a value. Where a quote never closes the
    value ends at the next space or ``>``; from the first tag on that runs into the end of the page, tags end at their first ``>``. What has no ``>`` after it is text, but for a comment, which then reaches to the end.
    """
    at, last, plain = 0, page.rfind(">"), False
    unclosed: set[str] = set()
    while (start := page.find("<" if at < last else "<!--", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", None
            continue
        at = start + 1
        if start > last:
            continue
        after = page[at]
        if after in "!?":
            at = page.find(">", start) + 1
            yield start, at, "", None
            continue
        closing = after == "/"
        named = _NAME.match(page, start + 1 + closing)
        if named is None:
            if closing:
                at = page.find(">", start) + 1
                yield start, at, "", None
            continue
        name, end, said = named[0].lower(), named.end(), {}
        if not plain:
            while True:
                gap = _GAP.match(page, end).end()
                if gap >= len(page) or page[gap] == ">":
                    end = gap
                    break
                attr = _ATTR.match(page, end)
                said.setdefault(attr[1].lower(), attr[2] or attr[3] or attr[4] or "")
                end = attr.end()
            plain = end >= len(page)
        if plain:
            end, said = page.find(">", named.end()), {}
        at = end + 1
        if closing or name not in RAW and name not in SKIPPED:
            yield start, at, name, None if closing else said
            continue
        if name in unclosed or name == "svg" and page[end - 1] == "/":
            yield start, at, "", None
            continue
        close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
        if close:
            at = page.find(">", close.end()) + 1 or len(page)
        elif name in RAW:
            at = len(page)
        else:
            unclosed.add(name)
        yield start, at, "", None


class Node:
    __slots__ = ("children", "kept", "label", "parts", "tag")

    def __init__(self, tag: str, label: str, kept: bool):
        self.tag, self.label, self.kept = tag, label, kept
        self.children: list[Node] = []
        self.parts: list[str | Node] = []  # text and children in page order


def parse(page: str) -> Node:
    """A tolerant DOM: labels are tag and first class word; ``kept`` is false for what is not main text."""
    root = Node("#", "#", True)
    stack, at = [root], 0
    solid, wall = [0], [0]  # nearest element at or below each one of the stack that is no inline one (and no paragraph)
    opened: Counter = Counter()

    def cut(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag] -= 1
        del stack[i:], solid[i:], wall[i:]

    for start, end, tag, said in tags(page):
        if start > at:
            stack[-1].parts.append(page[at:start])
        at = end
        if not tag:
            continue
        if said is None:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
            continue
        if tag in ENDS_P and stack[solid[-1]].tag == "p":
            cut(solid[-1])
        while tag in CLOSES and stack[wall[-1]].tag in CLOSES[tag]:
            cut(wall[-1])
        label, kept = tag, tag not in NOT_TEXT
        if said:
            named, role = said.get("class", ""), said.get("role", "").lower()
            first = named.split()
            label = f"{tag}.{first[0]}" if first else tag
            if tag not in ("html", "body", "article", "main") or "comment" in named.lower():
                kept = kept and role not in ROLES and not framed(named) and not framed(said.get("id", ""))
            if role == "main":
                tag = "main"
        node = Node(tag, label, kept)
        stack[-1].children.append(node)
        stack[-1].parts.append(node)
        if tag not in VOID:
            n = len(stack)
            stack.append(node)
            solid.append(solid[-1] if tag in INLINE else n)
            wall.append(wall[-1] if tag in INLINE or tag == "p" else n)
            opened[tag] += 1
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return root


def squeezed(text: str) -> str:
    return " ".join((entities.unescape(text) if "&" in text else text).split())


class Tree:
    """A page as flat lists in page order, inline elements left out: label, parent, hash of its own text, characters outside and inside links."""

    __slots__ = ("chars", "full", "kids", "label", "links", "nodes", "parent", "same", "size", "text")

    def __init__(self, label: list[str], parent: list[int], text: list[str], chars: list[int], links: list[int], nodes: list[Node] | None = None):
        self.label, self.parent, self.text, self.chars, self.links, self.nodes = label, parent, text, chars, links, nodes
        n = len(label)
        self.kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            self.kids[parent[i]].append(i)
        self.size, self.full = [1] * n, [1.5 if t else 1.0 for t in text]
        self.same = [0] * n
        for i in range(n - 1, -1, -1):
            self.same[i] = hash((label[i], text[i], *[self.same[k] for k in self.kids[i]])) if self.kids[i] else hash((label[i], text[i]))
            if i:
                self.size[parent[i]] += self.size[i]
                self.full[parent[i]] += self.full[i]

    def dumped(self) -> str:
        return json.dumps([self.label, self.parent, self.text, self.chars, self.links], separators=(",", ":"))

    def masses(self, values: list[int]) -> list[int]:
        """Sums over each node's subtree; the document's head counts as empty."""
        out = [0 if self.label[i] == "head" else v for i, v in enumerate(values)]
        for i in range(len(out) - 1, 0, -1):
            if self.label[i] != "head":
                out[self.parent[i]] += out[i]
        return out


def loaded(dump: str) -> Tree:
    return Tree(*json.loads(dump))


def compact(root: Node) -> Tree:
    """What alignment compares."""
    label, parent, nodes, lines, links = [root.label], [-1], [root], [[]], [0]
    stack = [(iter(root.parts), 0, False, True)]
    while stack:
        parts, at, linked, said = stack[-1]
        for p in parts:
            if isinstance(p, str):
                if said:
                    lines[at].append(p)
                    if linked:
                        links[at] += len(p)
            elif p.tag in INLINE:
                if said and not p.kept:
                    lines[at].append(" ")
                stack.append((iter(p.parts), at, linked or p.tag == "a", said and p.kept))
                break
            else:
                if said:
                    lines[at].append(" ")
                if p.tag != "br":
                    label.append(p.label)
                    parent.append(at)
                    nodes.append(p)
                    lines.append([])
                    links.append(0)
                    stack.append((iter(p.parts), len(label) - 1, False, True))
                    break
        else:
            stack.pop()
    text = [squeezed("".join(x)) for x in lines]
    chars = [max(0, len(t) - k) for t, k in zip(text, links, strict=True)]
    return Tree(label, parent, [f"{xxhash.xxh64_intdigest(t):x}" if t else "" for t in text], chars, links, nodes)


def paths_of(tree: Tree) -> list[int]:
    """Hashes of the distinct label paths from the root."""
    at: list[int] = []
    for label, up in zip(tree.label, tree.parent, strict=True):
        at.append(xxhash.xxh64_intdigest(f"{at[up] if up >= 0 else 0}/{label}") - (1 << 63))
    return list(dict.fromkeys(at))


def ends(x: list[int], y: list[int]) -> tuple[int, int]:
    """How many numbers are equal at the beginnings and, behind these, at the ends of two lists."""
    least = min(len(x), len(y))
    head = 0
    while head < least and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < least - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    return head, tail


class Kinds:
    """Subtrees of two pages by kind: those of one kind match equally well with whatever the other page holds.

    A text that the other page lacks counts as none. Two of one kind weigh ``full``, the most that either can. Two small subtrees are
    compared as what they are without the texts that only one of them holds.
    """

    def __init__(self, a: Tree, b: Tree):
        both = set(a.text) & set(b.text)
        self.seen: dict[tuple, int] = {}
        self.label, self.text, self.kids, self.full, self.height, self.size, self.texts = [], [], [], [], [], [], []
        self.of: list[list[int]] = []
        for t in (a, b):
            own = [0] * len(t.label)
            for i in range(len(own) - 1, -1, -1):
                own[i] = self.kind(t.label[i], t.text[i] if t.text[i] in both else "", tuple([own[k] for k in t.kids[i]]))
            self.of.append(own)
        self.less: dict[tuple[int, frozenset], int] = {}
        self.weight: dict[tuple[int, int], float] = {}
        self.weigh(self.of[0][0], self.of[1][0])

    def kind(self, label: str, text: str, kids: tuple[int, ...]) -> int:
        key = (label, text, kids)
        at = self.seen.setdefault(key, len(self.seen))
        if at == len(self.label):
            self.label.append(label)
            self.text.append(text)
            self.kids.append(kids)
            self.full.append((1.5 if text else 1.0) + sum([self.full[k] for k in kids]))
            self.height.append(1 + max([self.height[k] for k in kids], default=-1))
            self.size.append(1 + sum([self.size[k] for k in kids]))
            own = [text] if text else []
            self.texts.append(frozenset(own).union(*[self.texts[k] for k in kids]) if self.size[at] <= SMALL else None)
        return at

    def without(self, p: int, texts: frozenset) -> int:
        """Kind of a small subtree ``p`` that has lost all other texts than ``texts``."""
        own = self.texts[p] & texts
        if len(own) == len(self.texts[p]):
            return p
        if (p, own) not in self.less:
            self.less[p, own] = self.kind(self.label[p], self.text[p] if self.text[p] in own else "", tuple([self.without(k, own) for k in self.kids[p]]))
        return self.less[p, own]

    def key(self, p: int, q: int) -> tuple[int, int]:
        """Kinds that weigh what ``p`` and ``q`` weigh."""
        x, y = self.texts[p], self.texts[q]
        return (p, q) if x is None or y is None else (self.without(p, y), self.without(q, x))

    def weigh(self, u: int, v: int) -> None:
        """Weights of two kinds and of all that theirs depends on."""
        met, todo = {(u, v)}, [(u, v)]
        while todo:
            x, y = self.between(*todo.pop())
            places: dict[str, set[int]] = defaultdict(set)
            for q in y:
                if self.kids[q]:
                    places[self.label[q]].add(q)
            new = {self.key(p, q) for p in set(x) if self.kids[p] for q in places.get(self.label[p], ()) if p != q}
            new = {m for m in new if m[0] != m[1] and m not in self.weight} - met
            met |= new
            todo += new
        for u, v in sorted(met, key=lambda m: self.height[m[0]]):
            x, y = self.between(u, v)
            head, tail = ends(self.kids[u], self.kids[v])
            equal = sum(self.full[k] for k in self.kids[u][:head]) + sum(self.full[k] for k in self.kids[u][len(self.kids[u]) - tail :])
            row = None
            for row in self.rows(x, y, None, 0, len(x)) if x and y else ():
                pass
            self.weight[u, v] = (1.5 if self.text[u] and self.text[u] == self.text[v] else 1.0) + equal + (float(row[-1]) if row is not None else 0.0)

    def between(self, u: int, v: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        x, y = self.kids[u], self.kids[v]
        head, tail = ends(x, y)
        return x[head : len(x) - tail], y[head : len(y) - tail]

    def pair(self, p: int, q: int) -> float:
        if p == q:
            return self.full[p]
        if self.label[p] != self.label[q]:
            return 0.0
        if self.kids[p] and self.kids[q]:
            p, q = self.key(p, q)
            if p == q:
                return self.full[p]
            if (p, q) not in self.weight:
                self.weigh(p, q)
            return self.weight[p, q]
        return 1.5 if self.text[p] and self.text[p] == self.text[q] else 1.0

    def rows(self, x: list[int], y: list[int], up: np.ndarray | None, begin: int, end: int) -> Iterator[np.ndarray]:
        """Rows ``begin`` + 1 to ``end`` of the table of best weights of beginnings; ``up`` is the row before."""
        distinct = list(dict.fromkeys(y))
        at = {q: k for k, q in enumerate(distinct)}
        which = np.array([at[q] for q in y])
        by: dict[str, list[int]] = defaultdict(list)
        for k, q in enumerate(distinct):
            by[self.label[q]].append(k)
        held: dict[int, np.ndarray] = {}
        up = np.zeros(len(y) + 1) if up is None else up
        for p in x[begin:end]:
            if p not in held:
                if len(held) * len(y) > CELLS:
                    held.clear()
                w = np.zeros(len(distinct))
                for k in by.get(self.label[p], ()):
                    w[k] = self.pair(p, distinct[k])
                held[p] = w[which]
            row = np.zeros(len(y) + 1)
            np.maximum.accumulate(np.maximum(up[1:], up[:-1] + held[p]), out=row[1:])
            yield row
            up = row

    def paired(self, x: list[int], y: list[int], cells: int) -> list[tuple[int, int]]:
        """Places in ``x`` and ``y`` of a best matching; rows of the table are held at intervals and made again where there are more than ``cells``."""
        n, c = len(x), len(y)
        step = n if n * c <= cells else isqrt(n) + 1
        kept = {0: np.zeros(c + 1)}
        if step < n:
            kept |= {k: row for k, row in enumerate(self.rows(x, y, None, 0, n), 1) if k % step == 0}
        out, k, first = [], n, n
        while k and c:
            if k <= first:  # the block of rows that ends here
                first = (k - 1) // step * step
                best = [kept[first], *self.rows(x, y, kept[first], first, k)]
            one, row, above = self.pair(x[k - 1], y[c - 1]), best[k - first], best[k - 1 - first]
            if one and row[c] == above[c - 1] + one:
                out.append((k - 1, c - 1))
                k, c = k - 1, c - 1
            elif row[c] == above[c]:
                k -= 1
            else:
                c -= 1
        return out


def matched_by_kinds(a: Tree, b: Tree, cells: int) -> tuple[float, list[tuple[int, int]]]:
    """What ``match`` gives, by kinds of subtrees."""
    kinds = Kinds(a, b)
    of_a, of_b = kinds.of
    out, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        out.append((i, j))
        x, y = a.kids[i], b.kids[j]
        head, tail = ends([a.same[p] for p in x], [b.same[q] for q in y])
        for p, q in (*zip(x[:head], y[:head], strict=True), *zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)):
            out += [(p + k, q + k) for k in range(a.size[p])]
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        if x and y:
            todo += [(x[k], y[c]) for k, c in kinds.paired([of_a[p] for p in x], [of_b[q] for q in y], cells)]
    return kinds.weight[of_a[0], of_b[0]], sorted(out)


def match(a: Tree, b: Tree, cells: int = CELLS) -> tuple[float, list[tuple[int, int]]]:
    """Simple tree matching: (weight, pairs of matched nodes).

    Equal labels weigh 1, equal texts a half more, so constant nodes keep their place. Equal subtrees at both ends of two lists of
    children belong together in a best matching; what is between them is matched by dynamic programming. Beyond ``cells`` compared pairs
    kinds of subtrees are compared; the result does not depend on ``cells``.
    """
    if a.label[0] != b.label[0]:
        return 0.0, []
    todo, met = [(0, 0)], []
    limit = cells
    while todo:
        i, j = todo.pop()
        x, y = a.kids[i], b.kids[j]
        head, tail = ends([a.same[p] for p in x], [b.same[q] for q in y])
        equal = [*zip(x[:head], y[:head], strict=True), *zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)]
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        limit -= len(x) * len(y)
        if limit < 0:
            return matched_by_kinds(a, b, cells)
        met.append((i, j, equal, x, y))
        todo += [(p, q) for p in x if a.kids[p] for q in y if b.kids[q] and a.label[p] == b.label[q]]
    weight: dict[tuple[int, int], float] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def pair(p: int, q: int) -> float:
        if a.label[p] != b.label[q]:
            return 0.0
        if a.kids[p] and b.kids[q]:
            return weight[p, q]
        return 1.5 if a.text[p] and a.text[p] == b.text[q] else 1.0

    for i, j, equal, x, y in reversed(met):
        total = (1.5 if a.text[i] and a.text[i] == b.text[j] else 1.0) + sum(a.full[p] for p, _ in equal)
        if x and y:
            w = [[pair(p, q) for q in y] for p in x]
            n, m = len(x), len(y)
            best = [[0.0] * (m + 1)]
            for k in range(n):
                up, row, left = best[-1], [0.0], 0.0
                for d, one, above in zip(up, w[k], up[1:], strict=False):
                    left = max(left, above, d + one)
                    row.append(left)
                best.append(row)
            found, k, c = [], n, m
            while k and c:
                one = w[k - 1][c - 1]
                if one and best[k][c] == best[k - 1][c - 1] + one:
                    found.append((x[k - 1], y[c - 1]))
                    k, c = k - 1, c - 1
                elif best[k][c] == best[k - 1][c]:
                    k -= 1
                else:
                    c -= 1
            total += best[n][m]
            chosen[i, j] = found
        weight[i, j] = total
    out, todo = [], [(0, 0)]
    alike = {(i, j): equal for i, j, equal, *_ in met}
    while todo:
        i, j = todo.pop()
        out.append((i, j))
        for p, q in alike.get((i, j), ()):
            out += [(p + k, q + k) for k in range(a.size[p])]
        todo += chosen.get((i, j), ())
    return weight[0, 0], sorted(out)


def title_of(tree: Tree) -> str:
    """Hash of the page's title and first heading; copies of a page share it."""
    found: dict[str, str] = {}
    for n, t in zip(tree.nodes, tree.text, strict=True):
        if n.tag in ("title", "h1"):
            found.setdefault(n.tag, t)
    return f"{xxhash.xxh64_intdigest(chr(0).join(found.get(t, '') for t in ('title', 'h1'))):x}"


class Wrapper:
    """What a host's pages have in common: the exemplar, its content slot (or -1) and the constant texts of its nodes.

    ``stats``: (node, titles, characters, titles with the commonest text, hash of that text) over the host's distinct titles.
    """

    def __init__(self, exemplar: str, stats: list[tuple[int, int, int, int, str]]):
        self.tree = loaded(exemplar)
        by = {s[0]: s for s in stats}
        titles = by[0][1] if 0 in by else 0
        self.constant = {s[0]: s[4] for s in stats if s[4] and s[3] >= max(LEAST, CONSTANT * titles)}
        self.slot, at = -1, 0
        while titles >= LEAST and by[at][2]:
            kids = [k for k in self.tree.kids[at] if k in by]
            into = max(kids, key=lambda k: by[k][2], default=0)
            beside = any(k != into and self.tree.label[k].split(".")[0] in PROSE for k in kids)
            if not into or by[into][2] < DOMINANT * by[at][2] or by[into][1] < CONSTANT * titles or not self.tree.kids[into] or beside:
                break
            at = into
            if self.tree.label[at] not in ("html", "body"):
                self.slot = at

    def applied(self, page: Tree) -> tuple[Node | None, set[str]]:
        """(the page's content element, hashes of its template texts)."""
        pairs = match(self.tree, page)[1]
        here = next((page.nodes[j] for i, j in pairs if i == self.slot), None)
        return here, {page.text[j] for i, j in pairs if page.text[j] and self.constant.get(i) == page.text[j]}


def listed(root: Node) -> list[Node]:
    """The outermost article elements, or else main elements, that no list rules out."""
    for tag in ("article", "main"):
        out, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.tag == tag:
                out.append(n)
            else:
                todo += [c for c in reversed(n.children) if c.kept]
        if out:
            return out
    return []


def lines_of(root: Node) -> Iterator[tuple[str, int]]:
    """(text, characters in links) of the blocks below ``root``, without what the lists rule out."""
    line: list[str] = []
    links = 0
    stack = [(iter(root.parts), False, True)]
    while stack:
        parts, linked, block = stack[-1]
        for p in parts:
            if isinstance(p, str):
                line.append(p)
                links += len(p) if linked else 0
            elif not p.kept:
                continue
            elif p.tag in INLINE:
                stack.append((iter(p.parts), linked or p.tag == "a", False))
                break
            elif p.tag == "br":
                line.append(" ")
            elif p.tag not in VOID:
                yield squeezed("".join(line)), links
                line, links = [], 0
                stack.append((iter(p.parts), False, True))
                break
        else:
            stack.pop()
            if block:
                yield squeezed("".join(line)), links
                line, links = [], 0


def main_text(root: Node, slot: Node | None, constant: set[str]) -> str:
    """Text of the varying slots; ``constant`` holds text hashes of this page's template nodes."""
    roots = [slot] if slot is not None else listed(root)
    bare = slot is None and (not roots or roots[0].tag not in ("article", "main"))
    out = []
    for r in roots or [root]:
        for text, links in lines_of(r):
            if text and not (constant and f"{xxhash.xxh64_intdigest(text):x}" in constant) and not (bare and links > 0.6 * len(text)):
                out.append(text)
    return " ".join(out)


def host(url: Column) -> Column:
    """Lower-case host of an address; empty when there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def small_or_shuffled(side: DataFrame, size: Column) -> DataFrame:
    """``side`` marked for broadcast when its measured size is below the bound; otherwise left to a shuffled join."""
    total = side.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(side) if total <= BROADCAST_CHARS else side


def exemplars(trees: DataFrame) -> DataFrame:
    """host, exemplar: of the pages that have most of the host's common paths and fewest others, the smallest."""
    whole = trees.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    common = trees.select("host", F.explode("paths").alias("path")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).join(whole, "host")
    common = written(common.filter(2 * F.col("n") > F.col("pages")).groupBy("host").agg(F.collect_list("path").alias("common")), "page-paths")
    likeness = 2 * F.size(F.array_intersect("paths", "common")) - F.size("paths")
    ranked = trees.join(small_or_shuffled(common, 9 * F.size("common") + 100), "host").select("host", (-likeness).alias("apart"), "n", "tree")
    return ranked.groupBy("host").agg(F.min(F.struct("apart", "n", "tree")).alias("best")).select("host", F.col("best.tree").alias("exemplar"))


def templates(pages: DataFrame) -> DataFrame:
    """host, exemplar, stats of its nodes (see ``Wrapper``). Bounded by the exemplar's size per host."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page in batch.column(1).to_pylist():
                tree = compact(parse(page))
                out.append((title_of(tree), len(tree.label), tree.dumped(), paths_of(tree)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()))))], ["host", "title", "n", "tree", "paths"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Tree] = {}
        for batch in batches:
            rows = {}
            for h, title, dump, ex in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ex not in held:
                    held.clear()
                    held[ex] = loaded(ex)
                tree = loaded(dump)
                chars = tree.masses(tree.chars)
                for i, j in match(held[ex], tree)[1]:
                    rows[h, title, i, tree.text[j], chars[j]] = None
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64()))], ["host", "title", "node", "text", "chars"])

    tree = written(pages.filter("html is not null and html <> ''").select("host", "html").mapInArrow(trees, "host string, title string, n long, tree string, paths array<long>"), "page-trees")
    shown = written(exemplars(tree), "page-exemplars")
    met = tree.join(small_or_shuffled(shown, F.length("exemplar") + 100), "host").select("host", "title", "tree", "exemplar").mapInArrow(align, "host string, title string, node int, text string, chars long")
    titles = met.distinct().groupBy("host", "node", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    common = F.max(F.struct(F.when(F.col("text") != "", F.col("n")).otherwise(0).alias("n"), "text")).alias("common")
    nodes = titles.groupBy("host", "node").agg(F.sum("n").alias("titles"), F.sum("chars").alias("chars"), common)
    stats = nodes.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("node", "titles", "chars", F.col("common.n").alias("n"), F.col("common.text").alias("text")))).alias("stats"))
    return shown.join(stats, "host")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, way ("template" or "list")."""
    here = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    known = written(templates(here), "page-templates")
    known = small_or_shuffled(known, F.length("exemplar") + 60 * F.size("stats") + 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, Wrapper | None] = (None, None)
        for batch in batches:
            out = []
            for page, ex, stats in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                root, slot, fixed = parse(page or ""), None, set()
                if ex is not None and page:
                    if ex != last[0]:
                        last = (ex, Wrapper(ex, [tuple(x.values()) for x in stats]))
                    slot, fixed = last[1].applied(compact(root))
                out.append((main_text(root, slot, fixed), "list" if slot is None else "template"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], ["page_id", "url", "text", "way"])

    kinds = {f.name: f.dataType.simpleString() for f in here.schema}
    out = here.join(known, "host", "left").select("page_id", "url", "html", "exemplar", "stats").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, way string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "way")
