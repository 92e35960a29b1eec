"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks with the elements around them. A fixed logistic classifier
adds up evidence: the elements around a block, the names in their class and id, link density,
length and sentence ends. Its log odds are the terminal capacities. No name settles a block by
itself: what a name says depends on its place in a compound and on the element that bears it.
Neighbours in page order and neighbours among the children of one element are tied by smoothness
capacities, the stronger the closer they are in the tree, so a short or odd block follows those
around it. The maximum flow gives the cheapest labelling.

Scripts, styles and comments in the markup are no text. Character references are decoded once;
white space within a block becomes one space. A null or empty page, or one without content, gives
an empty text. Repeated rows are extracted each. An empty table gives an empty table. Columns
named like an output are replaced. Pages of any length and depth are read in one walk; markup that
is never closed is text to its end. As in browsers, inline elements nested deeper than MOST_DEPTH
lie beside each other; their text stays.
"""

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from math import exp, log1p

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellweek.llm.common import add_columns

# A tag with closed quotes and no angle bracket within; all others are read piece by piece.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*+)([^<>\"']*+(?>(?:\"[^<>\"]*+\"|'[^<>']*+')[^<>\"']*+)*+)>")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^\"'>]*")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_RAW_END = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in _RAW}
_SILENT = {*_RAW, "head", "template", "noscript", "canvas", "select", "button", "audio", "video", "datalist"}
# Drawings and formulas, whose elements may close themselves.
_DRAWN = {"svg", "math", "path", "circle", "rect", "line", "g", "use", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# An opening tag of the first kind ends an open element of the second, up to a border.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_AWAY_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar", "tablist"}
# Names that stand for boilerplate, and those that articles use in other senses as well.
_AWAY_WORDS = {
    "ad", "ads", "adv", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "sponsors",
    "promo", "banner", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar",
    "widget", "widgets", "footer", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "recommended", "recommendations",
    "comment", "comments", "commentlist", "disqus", "replies", "respond", "copyright", "hidden",
}
_UNSURE_WORDS = {
    "side", "aside", "notice", "notices", "alert", "promotion", "search", "form", "related", "reply", "discussion", "skip", "toc",
}
_HEADER_WORDS = {"header", "head", "top"}
_MAIN_WORDS = {"article", "content", "entry", "post", "story", "main", "maincontent", "articlebody", "text", "body"}
# Parts that only say what shape an element has: the name before them counts.
_SHAPE_WORDS = {
    "area", "bar", "block", "box", "button", "col", "column", "container", "group", "inner", "item", "items", "left", "link", "links", "list",
    "outer", "panel", "right", "row", "section", "slot", "title", "unit", "wrap", "wrapper",
}
_NEGATED = {"has", "have", "with", "without", "no", "not", "is"}
# Elements that hold parts of a page; names on others (p, li, h1, span) say less.
_HOLDERS = {"div", "section", "ul", "ol", "dl", "table", "tbody", "tr", "td", "blockquote", "figure", "header", "details", "center", "nav", "aside", "footer", "form"}
# Log odds: content around a block, elements and names that speak against it, a name that is only
# a part of another, names on elements that are no holders.
MAIN, AWAY, NAME, PART, SMALL = 5.0, -11.0, -9.0, -1.0, 0.45
LINK = 1.5
CERTAIN = 14.0
MOST_DEPTH = 512


class Block:
    __slots__ = ("pieces", "link_chars", "chars", "inside", "against", "kind", "parent", "depth", "text")

    def __init__(self, kind: str, parent: int, depth: int):
        self.pieces: list[str] = []
        self.link_chars = self.chars = 0
        self.inside, self.against = False, 0.0
        self.kind, self.parent, self.depth = kind, parent, depth
        self.text = ""


class Element:
    """An open element: what holds for the text directly in it."""

    __slots__ = ("tag", "inside", "against", "silent", "link", "number", "depth", "holder", "above")

    def __init__(self, tag: str, number: int, outer: "Element | None"):
        self.tag, self.number = tag, number
        self.inside = outer.inside if outer else False
        self.against = outer.against if outer else 0.0
        self.silent = (outer.silent if outer else False) or tag in _SILENT
        self.link = (outer.link if outer else False) or tag == "a"
        self.depth = outer.depth + 1 if outer else 0
        block = outer is None or tag in _BLOCK
        # The nearest block element, and the number of the one around that.
        self.holder = self if block else outer.holder
        self.above = (outer.holder.number if outer else 0) if block else outer.above


def tokens(page: str) -> Iterator[tuple[str, bool, str, str, int]]:
    """tag, whether it closes, attributes, text before it, and the end of every piece of markup.

    Comments and declarations have an empty tag; the rest of the page comes with the tag None. A
    caller may send the place where to go on. Each search that finds nothing is not made again.
    """
    size, at, start = len(page), 0, 0
    quoted, sections = True, True
    while True:
        open_ = page.find("<", at)
        if open_ < 0 or open_ + 1 >= size:
            break
        simple = _TAG.match(page, open_) if quoted else None
        if simple:
            close = simple.end()
            moved = yield simple[2].lower(), bool(simple[1]), simple[3], page[start:open_], close
            at = start = close if moved is None else moved
            if moved is not None:
                yield "", False, "", "", moved
            continue
        close, name, first = -1, None, page[open_ + 1]
        if first in "!?":
            if page.startswith("<!--", open_):
                close = page.find("-->", open_ + 4)
                close = size if close < 0 else close + 3
            elif sections and page.startswith("<![CDATA[", open_):
                close = page.find("]]>", open_ + 9)
                sections = close >= 0
                close = close + 3 if sections else -1
            if close < 0:
                close = page.find(">", open_) + 1
                if not close:
                    break
        else:
            name = _NAME.match(page, open_ + 1)
            if name is None:
                at = open_ + 1
                continue
            close = name.end()
            while quoted:
                close = _PLAIN.match(page, close).end()
                if close >= size:
                    quoted = False
                elif page[close] == ">":
                    break
                else:
                    # The quote may never end; then quotes have no meaning from here on.
                    close = page.find(page[close], close + 1) + 1
                    quoted = close > 0
            if not quoted:
                close = page.find(">", name.end())
                if close < 0:
                    break
            close += 1
        if name is None:
            moved = yield "", False, "", page[start:open_], close
        else:
            moved = yield name[2].lower(), bool(name[1]), page[name.end() : close - 1], page[start:open_], close
        at = start = close if moved is None else moved
        if moved is not None:
            yield "", False, "", "", moved
    yield None, False, "", page[start:], size


def name_evidence(name: str) -> tuple[float, bool]:
    """What a class or id says against a block, and whether it names main content.

    The last part that is no shape is what the element is: `cookie-notice` is a notice,
    `ad-slot` an ad, but `form-factor` is no form and `has-sidebar` no sidebar.
    """
    parts = [w.lower() for w in _PART.findall(name)]
    if not parts:
        return 0.0, False
    main = parts[-1] in _MAIN_WORDS
    if parts[0] in _NEGATED:
        return 0.0, False
    core = [w for w in parts if w not in _SHAPE_WORDS and not w.isdigit()]
    while len(core) > 1 and core[-1] in _MAIN_WORDS | _HEADER_WORDS and core[-2] in _AWAY_WORDS | _UNSURE_WORDS:
        core.pop()
    if not core:
        return 0.0, main
    if core[-1] in _AWAY_WORDS:
        return NAME, False
    if core[-1] in _UNSURE_WORDS:
        return NAME + 0.5, False
    if any(w in _AWAY_WORDS or w in _UNSURE_WORDS for w in core):
        return PART, main
    return 0.0, main


def judge(element: Element, rest: str) -> None:
    """Add the evidence of an element's own tag and attributes."""
    tag, inside = element.tag, element.inside
    against = AWAY if tag in _AWAY_TAGS or (tag == "header" and not inside) else 0.0
    main = tag in ("article", "main")
    if "=" in rest or "hidden" in rest:
        worst, head = 0.0, False
        for m in _ATTRIBUTE.finditer(rest):
            name = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if name in ("class", "id") and tag not in ("html", "body"):
                for one in value.split():
                    said, good = name_evidence(one)
                    if said > NAME and said < PART and tag not in _HOLDERS:
                        said *= SMALL
                    worst = min(worst, said)
                    main |= good and tag in _HOLDERS
                    head |= bool({w.lower() for w in _PART.findall(one)} & _HEADER_WORDS)
            elif name == "role":
                against += AWAY if value.lower() in _AWAY_ROLES else 0.0
                main |= value.lower() in ("main", "article")
            elif name == "aria-hidden" and value.lower() == "true":
                against += PART
            elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                against += NAME
        if head and not main and not inside and tag in _HOLDERS:
            worst = min(worst, NAME)
        # Main names and boilerplate names on one element weaken each other.
        against += worst / 2 if main and tag in ("article", "main") else worst
        main = main and (worst > NAME / 2 or tag in ("article", "main"))
    element.inside = inside or main
    element.against += against


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order."""
    blocks: list[Block] = []
    stack = [Element("", 0, None)]
    open_: Counter = Counter()
    now: Block | None = None
    elements = 0

    def close() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join(unescape("".join(now.pieces)).split())
            if now.text:
                blocks.append(now)
            now = None

    def add(raw: str) -> None:
        nonlocal now
        top = stack[-1]
        if top.silent or (now is None and raw.isspace()):
            return
        if now is None:
            now = Block(top.holder.tag, top.above, top.holder.depth)
        now.pieces.append(raw)
        n = len(raw)
        # The evidence of the inline elements counts by their share of the text.
        now.against += (top.against * n - now.against * n) / (now.chars + n)
        now.chars += n
        now.link_chars += n if top.link else 0
        now.inside |= top.inside

    def cut(i: int) -> None:
        """Close all elements from the i-th on."""
        while len(stack) > i:
            open_[stack.pop().tag] -= 1

    walk = tokens(page)
    for tag, closes, rest, before, at in walk:
        if before:
            add(before)
        if not tag:
            continue
        if closes:
            if tag in _BLOCK:
                close()
            if open_[tag] <= 0:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in _BLOCK:
                        cut(i)
                    else:
                        open_[tag] -= 1
                        del stack[i]
                    break
                if stack[i].tag in _BLOCK and tag not in _BLOCK:
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in _BLOCK:
            close()
            if open_["p"] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        cut(i)
                        break
                    if stack[i].tag in _BLOCK:
                        break
        if tag in _ENDS:
            ends, border = _ENDS[tag]
            if any(open_[e] > 0 for e in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        cut(i)
                        break
                    if stack[i].tag in border:
                        break
        if tag in _VOID:
            continue
        elements += 1
        empty = rest.endswith("/") and tag in _DRAWN
        if not empty and (tag in _BLOCK or tag in _SILENT or len(stack) < MOST_DEPTH):
            element = Element(tag, elements, stack[-1])
            judge(element, rest)
            stack.append(element)
            open_[tag] += 1
        if tag in _RAW and not empty:
            end = _RAW_END[tag].search(page, at)
            walk.send(end.start() if end else len(page))
    close()
    return blocks


def content_logit(block: Block, has_main: bool) -> float:
    """The fixed classifier: positive for content."""
    links = block.link_chars / max(1, block.chars)
    words = block.text.count(" ") + 1
    z = block.against + (MAIN if block.inside else (-4.0 if has_main else -1.0))
    if not block.inside:
        z += min(3.0, words / 12) + (0.8 if block.text[-1] in ".!?…\"”" else 0.0) - 4.0 * links
        if block.kind in ("p", "pre", "blockquote", "h1"):
            z += 1.0
    else:
        z -= 1.5 * links
    return max(-CERTAIN, min(CERTAIN, z))


def minimum_cut(gain: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the cost: gain is the cost of not taking a node less that of taking it.

    A node whose gain outweighs all its ties is certain; it is settled first and its ties move
    into the gains of its neighbours. Maximum flow over shortest paths labels the rest.
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in ties:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    gain = list(gain)
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(gain[i]) >= sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    for group in _groups([i for i in range(n) if label[i] is None], near):
        taken = _source_side(group, gain, near)
        for i in group:
            label[i] = i in taken
    return [bool(x) for x in label]


def _groups(rest: list[int], near: list[dict[int, float]]) -> Iterator[list[int]]:
    """The nodes in groups without ties between them."""
    seen: set[int] = set()
    for first in rest:
        if first in seen:
            continue
        seen.add(first)
        group = [first]
        for i in group:
            fresh = [j for j in near[i] if j not in seen]
            seen.update(fresh)
            group.extend(fresh)
        yield group


def _source_side(nodes: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """The nodes that a maximum flow leaves connected with the source.

    Every phase measures distances from the source and then fills all shortest paths, so the
    number of phases, not that of paths, decides the time.
    """
    source, sink = -1, -2
    flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    flow[source], flow[sink] = {}, {}
    for i in nodes:
        if gain[i] > 0:
            flow[source][i], flow[i][source] = gain[i], 0.0
        elif gain[i] < 0:
            flow[i][sink], flow[sink][i] = -gain[i], 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, w in flow[i].items():
                if w > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level)
        # Walk forward along the levels; a node without a way on is left for good in this phase.
        ways = {i: iter(list(flow[i])) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                steps = list(zip(path, path[1:], strict=False))
                least = min(flow[x][y] for x, y in steps)
                for x, y in steps:
                    flow[x][y] -= least
                    flow[y][x] = flow[y].get(x, 0.0) + least
                # Back to the first step that is full now.
                path = path[: next(k for k, (x, y) in enumerate(steps) if flow[x][y] <= 1e-12) + 1]
                continue
            onward = next((j for j in ways[i] if flow[i][j] > 1e-12 and level.get(j) == level[i] + 1), None)
            if onward is None:
                path.pop()
            else:
                path.append(onward)


def page_labels(page: str) -> tuple[list[Block], list[float], list[bool]]:
    """The blocks of a page, their log odds and their labels after the cut."""
    blocks = blocks_of(page)
    has_main = any(b.inside for b in blocks)
    gain = []
    for b in blocks:
        z = content_logit(b, has_main)
        # -log(1 - p) - (-log p) for p = 1 / (1 + exp(-z)), both terms being terminal capacities
        gain.append(log1p(exp(z)) - log1p(exp(-z)))
    ties = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            steps = abs(b.depth - blocks[i - 1].depth) + (b.parent != blocks[i - 1].parent)
            ties.append((i - 1, i, LINK * exp(-steps)))
        j = last.get(b.parent)
        if j is not None and j != i - 1:
            ties.append((j, i, LINK / 2))
        last[b.parent] = i
    return blocks, gain, minimum_cut(gain, ties)


def page_text(page: str) -> str:
    blocks, _, labels = page_labels(page)
    return "\n".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", output: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but html by default) with the main text."""

    def make(raw: list[bytes]) -> list[list]:
        return [[page_text(x.decode()) for x in raw]]

    kept = [c for c in pages.columns if c != html] if keep is None else keep
    return add_columns(pages, html, [T.StructField(output, T.StringType(), False)], make, kept)
