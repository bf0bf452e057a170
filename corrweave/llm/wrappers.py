"""Main text of web pages by wrapper induction.

Pages become small DOM trees (runs of like siblings are one node). Trees of the same host are aligned by simple tree
matching and merged into the host's wrapper: a node whose text stays the same over the host's pages is template, a node
whose text varies is a slot. The content root is where the varying text outside links comes together; a page's text is
what lies in its counterpart of that root, without template nodes. Names of tags and classes only part what varies alike:
they tell an article from the comments and teasers beside it. Pages of hosts with too few pages are read by names alone.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import copied, dealt, fresh_path, hot_keys, small_batches, stored

# HTML elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
DARK = frozenset("head button select option input dialog object audio video canvas map".split()) | RAW
NO_TEXT = frozenset("nav header footer aside form menu".split()) | DARK
BOXES = frozenset("div td section".split())
CONTAINERS = frozenset("# html body main article section div center form table tbody tr td".split())
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ARTICLE = frozenset({"article", "main"})
# Name parts of class, id and role that mark what isn't article text, and what is.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside complementary widget "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations more trending popular comment comments "
    "disqus respond reply replies discussion form search pagination pager tags toolbar skip copyright legal disclaimer contentinfo".split()
)
ARTICLE_WORDS = frozenset("article articlebody main content entry post story body".split())
# Those that set even an inline element apart.
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
# Elements that text flows in, one after another.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure".split())
# Of the first, those that beside one of the second name a layout and not a part to leave out.
LAYOUT_WORDS = frozenset("sidebar header masthead banner widget more form search tags legal".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|itemprop|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_STYLE_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")


class Node:
    """An element or a run of like siblings. parts: own texts and children, in order."""

    __slots__ = ("sign", "tag", "words", "hidden", "parts", "links", "apart", "dark", "chars", "plain", "digest")

    def __init__(self, sign: str, tag: str, words: frozenset[str] = frozenset(), hidden: bool = False):
        self.sign, self.tag, self.words, self.hidden = sign, tag, words, hidden
        self.parts: list[str | Node] = []
        self.links = 0  # characters of link texts among its own

    def children(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]

    def aside(self) -> bool:
        if self.hidden or self.tag in NO_TEXT or self.tag in INLINE:  # an inline node is one that is set apart
            return True
        named = self.words & ASIDE_WORDS
        return bool(named - LAYOUT_WORDS if self.words & ARTICLE_WORDS else named) and self.tag not in ("body", "html")


@functools.lru_cache(maxsize=4096)
def _described(tag: str, attributes: str) -> tuple[str, frozenset[str], bool]:
    names, hidden = [], bool(_STYLE_NONE.search(attributes))
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif key in ("class", "id", "role", "itemprop"):
            names.append(value)
    said = " ".join(names)
    return f"{tag}.{_DIGITS.sub('', said)}" if said else tag, frozenset(w.lower() for w in _NAME_PART.findall(said)), hidden


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are mended much as browsers do, in time that grows with the page alone.

    Inline elements are part of their block, whatever they are called, but for hidden ones and adverts: such a one is a node
    of its own, up to its own end or that of its block.
    """
    root = Node("#", "#")
    stack, at = [root], 0
    open_: dict[str, list[int]] = {}  # of each tag, where it is on the stack
    linked = False
    apart: list[list] = []  # open inline nodes set apart: place on the stack, open elements of the same tag

    def say(raw: str) -> None:
        if raw:
            stack[-1].parts.append(entities.unescape(raw) if "&" in raw else raw)
            if linked:
                stack[-1].links += len(raw)

    def push(node: Node) -> None:
        open_.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut_back(i: int) -> None:
        while len(stack) > i:
            open_[stack.pop().tag].pop()
        while apart and apart[-1][0] >= i:
            apart.pop()

    def last(tags) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=0)

    def close(tags: frozenset[str] | set[str], until: frozenset[str]) -> None:
        i = last(tags)
        if i > last(until):
            cut_back(i)

    scope = frozenset({"ul", "ol", "dl", "table", "td", "th", "article", "section", "main", "div", "body"})
    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        linked = tag == "a" and not m.group(1) or linked and tag in INLINE and tag != "a"
        if m.group(1):
            if tag == "br" or tag == "p" and not open_.get("p"):
                stack[-1].parts.append(Node("br", "br"))
            elif tag in INLINE:
                if apart and stack[apart[-1][0]].tag == tag:
                    apart[-1][1] -= 1
                    if not apart[-1][1]:
                        cut_back(apart[-1][0])
            elif open_.get(tag):
                cut_back(open_[tag][-1])
            continue
        attributes = m.group(3)
        if tag in RAW and not attributes.endswith("/"):
            end = _raw_end(tag).search(page, at)
            at = end.end() if end else n
            continue
        sign, words, hidden = _described(tag, attributes) if attributes.strip(" /") else (tag, frozenset(), False)
        if tag in INLINE:
            if apart and stack[apart[-1][0]].tag == tag:
                apart[-1][1] += 1
            elif hidden or words & ADVERT_WORDS:
                node = Node(sign, tag, words, hidden)
                stack[-1].parts.append(node)
                apart.append([len(stack), 1])
                push(node)
            continue
        if tag not in VOID:
            close({"p"}, scope)
        if tag in CLOSED_BY and CLOSED_BY[tag]:
            close(CLOSED_BY[tag], frozenset({"ul", "ol", "dl", "table", "select"}))
        node = Node(sign, tag, words, hidden)
        if stack[-1].sign in BOXES:  # a box without a name is told from its like by what it begins with
            stack[-1].sign += f"-{tag}"
        stack[-1].parts.append(node)
        if tag not in VOID:
            push(node)
    return root


@functools.lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I)


def blocks(node: Node, skip: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Texts of the blocks under a node in page order, white space as one space, without asides and nodes in `skip` (by id)."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    def walk(x: Node) -> None:
        todo = [iter(x.parts)]
        while todo:
            for part in todo[-1]:
                if isinstance(part, str):
                    held.append(part)
                elif part.tag == "br" or part.tag == "wbr":
                    held.append(" " if part.tag == "br" else "")
                elif part.tag in VOID:
                    held.append(" ")
                elif part.tag in INLINE:
                    continue
                elif part.aside() or id(part) in skip:
                    flush()
                else:
                    flush()
                    todo.append(iter(part.parts))
                    break
            else:
                todo.pop()
                flush()

    walk(node)
    return out


class Shape:
    """A tree for alignment: sign, digest of its text, characters of its text without parts set apart by name, those outside links with them, whether it varies, how many pages have it, children."""

    __slots__ = ("sign", "text", "chars", "plain", "varies", "pages", "kids", "nodes", "aside", "article")

    def __init__(self, sign: str, aside: bool, article: bool, text: str = "", chars: float = 0, plain: float = 0, varies: bool = False, pages: int = 1):
        self.sign, self.aside, self.article, self.text, self.chars, self.plain, self.varies, self.pages = sign, aside, article, text, chars, plain, varies, pages
        self.kids: list[Shape] = []
        self.nodes: list[Node] = []

    def every(self) -> list[Shape]:
        """This shape and all below it, parents before children and those in order."""
        out, todo = [], [self]
        while todo:
            out.append(x := todo.pop())
            todo += reversed(x.kids)
        return out

    def dump(self) -> list:
        """A flat list, since a tree may be deeper than JSON can nest."""
        return [[x.sign, x.aside, x.article, x.text, round(x.chars), round(x.plain), x.varies, x.pages, len(x.kids)] for x in self.every()]

    @staticmethod
    def load(rows: list) -> Shape:
        open_: list[tuple[Shape, int]] = []
        for *fields, n in rows:
            s = Shape(*fields)
            while open_ and len(open_[-1][0].kids) == open_[-1][1]:
                open_.pop()
            if open_:
                open_[-1][0].kids.append(s)
            else:
                top = s
            open_.append((s, n))
        return top

    def structure(self) -> str:
        out: list[str] = []
        todo: list[Shape | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            out.append(x.sign)
            if x.kids:
                out.append("(")
                todo.append(")")
                for i, k in enumerate(reversed(x.kids)):
                    todo += [",", k] if i else [k]
        return "".join(out)


def measure(root: Node) -> None:
    """Sets the characters and the digest of the text of each node, children first."""
    order, todo = [], [root]
    while todo:
        order.append(x := todo.pop())
        todo += (k for k in x.children() if k.tag not in VOID)
    for x in reversed(order):
        x.apart, x.dark = x.aside(), x.hidden or x.tag in DARK
        kids = [k for k in x.children() if k.tag not in VOID]
        text = " ".join("".join(p for p in x.parts if isinstance(p, str)).split())
        x.chars = len(text) + (0 if x.apart else sum(k.chars for k in kids if not k.apart))
        x.plain = 0 if x.dark else max(0, len(text) - x.links) + sum(k.plain for k in kids)
        digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8)
        for k in kids:
            digest.update(k.digest)
        x.digest = digest.digest()


def _run(nodes: list[Node]) -> Shape:
    first = nodes[0]
    text = first.digest if len(nodes) == 1 else hashlib.blake2b(b"".join(n.digest for n in nodes), digest_size=8).digest()
    s = Shape(first.sign, first.apart, first.tag in ARTICLE or bool(first.words & ARTICLE_WORDS) and not first.words & ASIDE_WORDS, text.hex(), sum(n.chars for n in nodes), sum(n.plain for n in nodes))
    s.nodes = nodes
    return s


def _stretch(runs: list[Shape], sign: str) -> Shape:
    """Several runs as one shape, whose children are the runs of each sign brought together, in order of sign."""
    by_sign: dict[str, list[Node]] = {}
    for r in runs:
        by_sign.setdefault(r.sign, []).extend(r.nodes)
    nodes = [n for r in runs for n in r.nodes]
    text = hashlib.blake2b(b"".join(n.digest for n in nodes), digest_size=8).hexdigest()
    s = Shape(sign, False, False, text, sum(r.chars for r in runs if not r.aside), sum(r.plain for r in runs))
    s.nodes = nodes
    s.kids = [_run(by_sign[k]) for k in sorted(by_sign)]
    return s


#: Kinds of siblings that may alternate in a stretch, and how often they have to.
PERIODS, REPEATS = (2, 3, 4), 3


def _folded(runs: list[Shape]) -> list[Shape]:
    """Stretches of prose, and of runs that alternate in one order, as one shape each: however long they are, they align as one."""
    out: list[Shape] = []
    held: list[Shape] = []

    def flush() -> None:
        if held:
            out.append(held[0] if len(held) == 1 else _stretch(list(held), "~"))
            held.clear()

    for r in runs:  # a named aside stays by itself
        if r.nodes[0].tag in PROSE and not r.aside:
            held.append(r)
        else:
            flush()
            out.append(r)
    flush()
    runs, out, i = out, [], 0
    signs = [r.sign for r in runs]
    while i < len(runs):
        for p in PERIODS:
            j = i + p
            while j < len(runs) and signs[j] == signs[j - p]:
                j += 1
            if j - i >= REPEATS * p:
                out.append(_stretch(runs[i:j], "~" + "~".join(sorted(set(signs[i : i + p])))))
                i = j
                break
        else:
            out.append(runs[i])
            i += 1
    return out


def shape(root: Node) -> Shape:
    """The shape of a page's tree, however deep and wide; adjacent like siblings are one run, stretches are folded."""
    measure(root)
    top = _run([root])
    todo = [top]
    while todo:
        s = todo.pop()
        runs: list[list[Node]] = []
        for node in s.nodes:
            for part in node.children():
                if part.tag not in VOID:
                    if runs and runs[-1][0].sign == part.sign:
                        runs[-1].append(part)
                    else:
                        runs.append([part])
        s.kids = _folded([_run(r) for r in runs])
        for k in s.kids:
            todo += k.kids if k.sign[0] == "~" else [k]
    return top


def _aligned(a: Shape, b: Shape, weight: dict[tuple[int, int], int]) -> list[tuple[Shape, Shape]]:
    """The pairs of children, in order and of one sign, with the largest sum of weights (1 where none is given).

    Only pairs of one sign are tried: the best chain that ends before each child of b is kept in a tree of prefix maxima.
    """
    n = len(b.kids)
    places: dict[str, list[int]] = {}
    for j in range(n, 0, -1):
        places.setdefault(b.kids[j - 1].sign, []).append(j)
    best: list[tuple[int, tuple | None]] = [(0, None)] * (n + 1)
    for x in a.kids:
        for j in places.get(x.sign, ()):  # from the last, so that x is used once in a chain
            y, top, k = b.kids[j - 1], (0, None), j - 1
            while k:
                if best[k][0] > top[0]:
                    top = best[k]
                k &= k - 1
            here, k = (top[0] + weight.get((id(x), id(y)), 1), (x, y, top[1])), j
            while k <= n:
                if here[0] > best[k][0]:
                    best[k] = here
                k += k & -k
    top, k = (0, None), n
    while k:
        if best[k][0] > top[0]:
            top = best[k]
        k &= k - 1
    pairs, chain = [], top[1]
    while chain:
        pairs.append(chain[:2])
        chain = chain[2]
    return pairs[::-1]


def matching(a: Shape, b: Shape) -> list[tuple[Shape, Shape]]:
    """Simple tree matching: the pairs of matched shapes, parents before children."""
    if a.sign != b.sign:
        return []
    frames, todo = [], [(a, b)]
    while todo:  # all pairs that could match, parents first; pairs in which one has no children weigh 1
        x, y = todo.pop()
        alike = [k.sign for k in x.kids] == [k.sign for k in y.kids]  # no other alignment matches more roots; the common case
        frames.append((x, y, alike))
        if alike:
            todo += ((p, q) for p, q in zip(x.kids, y.kids) if p.kids and q.kids)
        else:
            by_sign: dict[str, list[Shape]] = {}
            for q in y.kids:
                if q.kids:
                    by_sign.setdefault(q.sign, []).append(q)
            todo += ((p, q) for p in x.kids if p.kids for q in by_sign.get(p.sign, ()))
    weight: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[Shape, Shape]]] = {}
    for x, y, alike in reversed(frames):
        pairs = list(zip(x.kids, y.kids)) if alike else _aligned(x, y, weight)
        chosen[id(x), id(y)] = pairs
        weight[id(x), id(y)] = 1 + sum(weight.get((id(p), id(q)), 1) for p, q in pairs)
    out, at = [(a, b)], 0
    while at < len(out):
        x, y = out[at]
        out += chosen.get((id(x), id(y)), ())
        at += 1
    return out


def merge(a: Shape, b: Shape) -> None:
    """Folds b into a by their alignment; children of b without a counterpart become optional ones of a."""
    pairs = matching(a, b)
    partner = {id(y): x for x, y in pairs}
    for x, y in pairs:
        x.varies = x.varies or y.varies or x.text != y.text
        x.chars, x.plain, x.pages = x.chars + y.chars, x.plain + y.plain, x.pages + y.pages
        kids, at = [], 0
        for k in y.kids:
            if id(k) in partner:
                while x.kids[at] is not partner[id(k)]:
                    kids.append(x.kids[at])
                    at += 1
                kids.append(x.kids[at])
                at += 1
            else:
                kids.append(k)
        x.kids = kids + x.kids[at:]


def content_root(t: Shape) -> Shape:
    """The slot with most article text: the largest that is an article by name, else as deep as most of the text stays together."""
    named: list[Shape] = []
    todo = [k for k in reversed(t.kids) if not k.aside]
    while todo:
        s = todo.pop()
        if s.article and s.sign.split(".")[0] not in INLINE:
            named.append(s)
        todo += (k for k in reversed(s.kids) if not k.aside)
    total = t.chars or 1
    named = [s for s in named if s.chars >= 0.5 * total] or [s for s in named if s.sign.split(".")[0] in ARTICLE and s.chars]
    if named:  # the outermost of the narrowest kind: an article before a wrapper that also has other things
        tags = [s for s in named if s.sign.split(".")[0] in ARTICLE]
        inner = [s for s in tags if s.sign.split(".")[0] == "article"] or tags or named
        return max(inner, key=lambda s: s.chars)
    while True:
        best = max((k for k in t.kids if not k.aside), key=lambda k: k.chars, default=None)
        if best is None or best.chars < 0.8 * t.chars or not best.kids or best.sign[0] == "~":
            return t
        t = best


def slot_root(t: Shape) -> Shape:
    """Where the varying text outside links comes together: as deep in containers as four fifths of it stay in one of them.

    If an article by name holds at least half of what varies there, it is the root: comments may vary as much.
    """
    def tag(s: Shape) -> str:
        return re.split("[.-]", s.sign, maxsplit=1)[0]

    varying: dict[int, float] = {}
    for s in reversed(t.every()):  # children before their parents
        own = s.plain - sum(k.plain for k in s.kids)
        varying[id(s)] = max(0, own) + sum(varying[id(k)] for k in s.kids) if s.varies else 0.0
    while True:
        inner = [k for k in t.kids if tag(k) in CONTAINERS and varying[id(k)] >= 0.8 * varying[id(t)] > 0]
        if not inner:
            break
        t = max(inner, key=lambda k: varying[id(k)])
    named = [s for s in t.every() if s.article and not s.aside and tag(s) not in INLINE and varying[id(s)] >= 0.5 * varying[id(t)] > 0]
    return max(named, key=lambda s: (tag(s) == "article", tag(s) in ARTICLE, varying[id(s)])) if named else t


#: A node is template if it has the same text on so many distinct pages of a host, and on all that have it. A node in a run
#: of like siblings is so too if its text is on so many pages and on at least half of those with a node at its path of signs.
TEMPLATE_PAGES = 4


@functools.lru_cache(maxsize=1 << 16)
def _slot(above: bytes, sign: str) -> bytes:
    """A path of signs as a digest, from that of the path above."""
    return hashlib.blake2b(sign.encode("utf-8", "surrogatepass"), key=above, digest_size=8).digest()


def members(nodes: list[Node], start: bytes = b"") -> Iterator[tuple[Node, bytes]]:
    """The nodes with text below these, but for what no browser shows, each with its slot."""
    todo = [(n, start) for n in nodes]
    while todo:
        x, slot = todo.pop()
        for k in x.children():
            if k.tag not in VOID and not k.dark and (k.plain or k.chars):
                below = _slot(slot, k.sign)
                yield k, below
                todo.append((k, below))


class Wrapper:
    """A host's wrapper, its content root, and for each structure of pages its alignment: shapes with the places of their counterparts.

    constant: slot and digest of the nodes that are template by their text, wherever they stand in a run.
    """

    #: Alignments that a wrapper holds.
    MOST_ALIGNED = 256

    def __init__(self, top: Shape, constant: frozenset[bytes] = frozenset()):
        self.top, self.constant = top, constant
        self.root = slot_root(top) if top.pages >= TEMPLATE_PAGES else content_root(top)
        self.inside = {id(x) for x in self.root.every()}
        self.aligned: dict[str, list[tuple[Shape, int]]] = {}

    def match(self, own: Shape) -> list[tuple[Shape, Shape]]:
        every, structure = own.every(), own.structure()
        if structure not in self.aligned:
            if len(self.aligned) >= self.MOST_ALIGNED:
                self.aligned.clear()
            place = {id(y): i for i, y in enumerate(every)}
            self.aligned[structure] = [(x, place[id(y)]) for x, y in matching(self.top, own)]
        return [(x, every[i]) for x, i in self.aligned[structure]]


def extract(page: str | None, wrapper: Wrapper | None) -> str:
    """A page's main text by its host's wrapper (None: by the page alone)."""
    tree = parse(page or "")
    own = shape(tree)
    if wrapper is None:
        return " ".join(x for n in content_root(own).nodes for x in blocks(n))
    counterpart, template = None, set()
    for x, y in wrapper.match(own):
        if x is wrapper.root:
            counterpart = y
        elif id(x) in wrapper.inside and not x.varies and x.pages >= TEMPLATE_PAGES:
            template.update(id(n) for n in y.nodes)
    if wrapper.constant:
        template.update(id(n) for n, slot in members([tree]) if slot + n.digest in wrapper.constant)
    chosen = counterpart if counterpart and counterpart.chars else content_root(own)
    found = [x for n in chosen.nodes if id(n) not in template for x in blocks(n, template)]
    return " ".join(found or [x for n in chosen.nodes for x in blocks(n)])


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _fold(into: dict[tuple[str, str], Shape], host: str, other: Shape) -> None:
    """Pages of one structure merge node by node; different structures stay apart until all pages are in."""
    key = (host, other.structure())
    if key in into:
        merge(into[key], other)
    else:
        into[key] = other


#: Bytes of all wrappers up to which each executor gets them; beyond it pages and wrappers meet by a shuffle on the host.
BROADCAST_BYTES = 32 << 20
#: Digests of pages with copies that each executor gets; beyond it all pages are shuffled by digest.
BROADCAST_COPIES = 500_000
#: Structures and texts of nodes that a task holds before it hands them on.
MOST_SHAPES, MOST_TEXTS = 2000, 200_000

_PARTS = "host string, structure string, shape string, slot binary, digest binary, pages bigint"


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From distinct pages, two kinds of rows: shapes by host and structure; pages by host, slot and digest of a node (null: all with that slot)."""
    held: dict[tuple[str, str], Shape] = {}
    texts: dict[tuple[str, bytes, bytes | None], int] = {}
    kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64())

    def out() -> pa.RecordBatch:
        rows = [(h, s, json.dumps(x.dump()), None, None, None) for (h, s), x in held.items()]
        rows += [(h, None, None, slot, digest, n) for (h, slot, digest), n in texts.items()]
        held.clear()
        texts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in _PARTS.split(", ")])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
            page = page.as_py()
            tree = parse(page)
            _fold(held, host, shape(tree))
            found = {(host, slot, n.digest) for n, slot in members([tree])}
            for key in found | {(host, slot, None) for _, slot, _ in found}:
                texts[key] = texts.get(key, 0) + 1
            if len(held) > MOST_SHAPES or len(texts) > MOST_TEXTS:
                yield out()
    if held or texts:
        yield out()


#: Groups of structures that a host's merge is dealt over before the last one.
GROUPS = 64


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of host and structure: merges a run of one key as it streams by."""
    now: tuple | None = None
    held: Shape | None = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (*now, json.dumps(held.dump()))], ["host", "structure", "shape"])

    for batch in batches:
        for host, structure, said in zip(*(batch.column(i).to_pylist() for i in range(3))):
            key, s = (host, structure), Shape.load(json.loads(said))
            if key == now:
                merge(held, s)
            else:
                if held is not None:
                    yield out()
                now, held = key, s
    if held is not None:
        yield out()


def constants(parts: DataFrame) -> DataFrame:
    """(host, constant): slots and digests, in hex and joined, of the nodes whose text is template in a host's runs."""
    counts = parts.where("slot is not null").groupBy("host", "slot", "digest").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= TEMPLATE_PAGES)
    slots = counts.where("digest is null").select("host", "slot", F.col("pages").alias("of"))
    kept = counts.where("digest is not null").join(slots, ["host", "slot"]).where("2 * pages >= of")
    return kept.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.hex("slot"), F.hex("digest")))), " ").alias("constant"))


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper) over all pages (url, html) with html, the wrapper as JSON and, on a second line, its constant nodes.

    A host's copies of one page, which say nothing about what is constant, are first made one over the whole table: only
    pages that have a copy leave their place for that, as long as their digests are few enough to send to all. Then
    each task merges its pages by host and structure before anything is shuffled, so a hot host sends a few shapes from
    each task; they are merged by structure first and then, across structures, by group of structures and by host. The
    tasks' rows are written to the shared folder, since shapes and counts of texts are both made from them.
    """
    rows = pages.where("html <> ''").select(_host(F.col("url")).alias("host"), "html")
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat("host", F.lit("\n"), "html"), 256)))
    copied_ = stored(rows.groupBy("digest").count().where("count > 1").select("digest"), "copies")
    if copied_.count() <= BROADCAST_COPIES:
        alone = rows.join(F.broadcast(copied_), "digest", "left_anti")
        rows = alone.unionByName(rows.join(F.broadcast(copied_), "digest", "left_semi").dropDuplicates(["digest"]))
    else:
        rows = rows.dropDuplicates(["digest"])
    rows = rows.select("host", "html")
    path = fresh_path(pages.sparkSession, "shapes")
    rows.mapInArrow(_shapes, _PARTS).write.parquet(path)
    parts = pages.sparkSession.read.schema(_PARTS).parquet(path)
    schema = "host string, structure string, shape string"
    shapes = parts.where("shape is not null").select("host", "structure", "shape")
    by_structure = shapes.repartition("host", "structure").sortWithinPartitions("host", "structure", "shape").mapInArrow(_merged, schema)
    grouped = by_structure.withColumns({"order": F.col("structure"), "structure": F.pmod(F.xxhash64("structure"), F.lit(GROUPS)).cast("string")})
    by_group = grouped.repartition("host", "structure").sortWithinPartitions("host", "structure", F.length("order"), "order")
    merged = by_group.select("host", "structure", "shape").mapInArrow(_merged, schema).withColumns({"order": F.col("structure"), "structure": F.lit("")})
    by_host = merged.repartition("host").sortWithinPartitions("host", F.length("shape"), "order")
    merged = by_host.select("host", "structure", "shape").mapInArrow(_merged, schema).join(constants(parts), "host", "left")
    return merged.select("host", F.concat_ws("\n", "shape", "constant").alias("wrapper"))


@functools.lru_cache(maxsize=256)
def _wrapper(said: str) -> Wrapper:
    top, _, constant = said.partition("\n")
    return Wrapper(Shape.load(json.loads(top)), frozenset(map(bytes.fromhex, constant.split())))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of `pages` (page_id, url, html).

    Null html is empty and has the empty text. A null or odd url counts as a host of its own name, "". Repeated rows stay
    (copies count once for the wrapper), other columns are ignored, an empty table gives an empty one. Wrappers are
    written to the shared folder, so that their size is known when they are joined.
    """

    spark = pages.sparkSession
    small_batches(spark)
    path = fresh_path(spark, "wrappers")
    induce(pages).write.parquet(path)
    wrappers = spark.read.schema("host string, wrapper string").parquet(path)
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        every = spark.sparkContext.broadcast(dict(map(tuple, wrappers.collect())))

        @arrow_udf("string")
        def text(htmls: pa.Array, hosts: pa.Array) -> pa.Array:
            return pa.array([extract(p.as_py(), _wrapper(w) if (w := every.value.get(h)) else None) for p, h in zip(htmls, hosts.to_pylist())], pa.string())

        rows = rows.select("page_id", "url", text("html", "host").alias("text"))
    else:  # pages of a hot host are dealt over tasks, each of which gets its wrapper
        hot = hot_keys(rows.groupBy("host").count(), "host", rows.count())
        kinds = dict(rows.dtypes)
        pages_of = dealt(rows, "host", hot).withColumn("wrapper", F.lit(None).cast("string"))
        first = copied(wrappers, "host", hot).select(*(F.lit(None).cast(kinds[c]).alias(c) for c in ("page_id", "url", "html")), "host", "salt", "wrapper")
        both = pages_of.withColumn("page", F.lit(1)).unionByName(first.withColumn("page", F.lit(0)))
        in_turn = both.repartition("host", "salt").sortWithinPartitions("host", "salt", "page")
        rows = in_turn.mapInArrow(_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return rows.withColumn("n_chars", F.char_length("text").cast("bigint"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of pages, each host's behind its wrapper's row."""
    now, wrapper = None, None
    for batch in batches:
        kept, texts = [], []
        for i, (host, salt, page, said) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "page", "wrapper")))):
            if (host, salt) != now:
                now, wrapper = (host, salt), None
            if not page:
                wrapper = _wrapper(said)
            else:
                kept.append(i)
                texts.append(extract(batch.column("html")[i].as_py(), wrapper))
        pages = batch.select(["page_id", "url"]).take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([*pages.columns, pa.array(texts, pa.string())], ["page_id", "url", "text"])
