"""Main text of web pages by minimum cut.

A page is read into blocks: stretches of text between block-level tags, each with its path of open
elements. A logistic classifier gives every block two costs, of calling it content and of calling
it boilerplate, which become capacities to source and sink; blocks next to each other and blocks
of one parent are joined by smoothness edges, weaker the further apart they are in the DOM. The
minimum cut gives the labelling of least total cost, and the content blocks are the text.

A class or id with a bad name costs a block all but everything, so names that say nothing of an
element's own text are passed over: those after a word like ``has`` or ``tag``, those of an article
that don't make it an aside, and those on or around the element that holds the page's main text
(``shelter``).

Blocks whose own costs outweigh all their edges are settled first, which no minimum cut contradicts;
augmenting paths run on the rest. Capacities are integers, so the cut is exact.

Null and empty pages give an empty text. Pages are handled one by one where they lie; nothing is
shuffled, cut short or dropped. Further columns pass through; those named like a result are
replaced.
"""

from __future__ import annotations

import math
import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from skyledger.llm.frames import add_columns

OPENING = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
MARKED = re.compile(r"[>\"']")
NAME_END = re.compile(r"[\s/>]")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby"
    " s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Their contents are never text of a page.
SILENT = frozenset(
    "script style noscript template svg math iframe object canvas audio video select option"
    " textarea button title head datalist noframes noembed".split()
)
RAW = frozenset("script style textarea title noscript iframe noframes noembed template".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset search".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends an open element of the same kind.
SIBLINGS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
#: The end tag of a block never reaches out of a table cell, that of a table's part not out of it.
CELLS = frozenset("table td th caption".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
#: An implied end tag, or that of a paragraph or inline element, never reaches beyond these.
SCOPES = frozenset(
    "html body article main section nav header footer aside div form table ul ol dl blockquote"
    " td th li figure dialog menu fieldset".split()
)
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb"
    " breadcrumbs comment comments commentlist consent cookie cookies copyright dialog discuss"
    " disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice"
    " notices notification overlay pager pagination paywall popup privacy promo promoted promotion"
    " recommended related replies reply respond search share sharing shoutbox sidebar signup skip"
    " social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: What follows these within a class or id names a layout or a topic.
MODIFIERS = frozenset("has no with without tag category".split())
COMMENT_NAMES = frozenset(
    "comment comments commentlist discuss disqus replies reply respond".split()
)
#: The bad names that an article or main element itself may bear in earnest.
ASIDE_NAMES = COMMENT_NAMES | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense promo promoted promotion"
    " recommended related sponsor sponsored widget widgets".split()
)
GOOD_NAMES = frozenset("article body content entry main post story text".split())
BAD_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar"
    " toolbar form".split()
)

#: Weights of the classifier: log-odds of being content.
BIAS = 0.3
IN_CONTENT = 3.0
IN_GOOD_NAME = 1.0
IN_BOILERPLATE = -8.0
IN_BAD_NAME = -7.0
IN_HEADER = -7.0
PARAGRAPH = 1.0
HEADING = 0.6
TITLE = 7.0
LINKS = -3.0
WORDS = 0.5
#: Weight of smoothness edges: neighbours, children of one parent, and the loss for each step apart.
NEIGHBOUR = 0.6
SIBLING = 0.4
FALL = 0.5
SCALE = 1000
#: Share of a page's words that makes an element more than an aside.
BULK = 0.8


class Element:
    __slots__ = (
        "tag", "parent", "depth", "odds", "silent", "content", "link", "title",
        "core", "bad", "junk", "comment", "aside", "words", "plain", "relief",
    )

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        odds = parent.odds if parent else 0.0
        self.silent = tag in SILENT or bool(parent and parent.silent)
        self.content = tag in CONTENT or bool(parent and parent.content)
        self.link = tag == "a" or bool(parent and parent.link)
        self.title = bool(parent and parent.title)  # in the header of an article
        self.core = tag if tag in CONTENT else ""
        self.bad = False  # by its own name
        self.junk = bool(parent and parent.junk)  # by its tag or role, or one around it
        self.comment = bool(parent and parent.comment)
        self.aside = bool(parent and parent.aside)  # in comments, cards, advertisements
        self.words = self.plain = self.relief = 0.0
        if tag in CONTENT:
            if not (parent and parent.content):
                odds += IN_CONTENT
        elif tag in BOILERPLATE:
            odds += IN_BOILERPLATE
            self.junk = True
        elif tag == "header":
            odds += IN_HEADER
            self.junk = True
            self.title = self.content
        if attributes and tag not in ("html", "body"):
            odds += self.named(attributes)
        self.odds = odds

    def named(self, attributes: str) -> float:
        """Log-odds of class, id and role; hidden elements are silent."""
        odds, names = 0.0, []
        lowered = attributes.lower()
        if "hidden" in lowered or "display" in lowered:
            bare = ATTRIBUTE.sub(" ", lowered)
            if "hidden" in bare.split() or re.search(
                r"aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", lowered
            ):
                self.silent = True
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name in ("class", "id"):
                names += _names(value)
            elif name == "role":
                if value.lower() in BAD_ROLES:
                    odds += IN_BOILERPLATE
                    self.junk = True
                elif value.lower() in ("main", "article"):
                    odds += IN_CONTENT
                    self.core = value.lower()
        if not (ASIDE_NAMES if self.core else BAD_NAMES).isdisjoint(names):
            odds += IN_BAD_NAME
            self.bad = True
            self.comment = self.comment or not COMMENT_NAMES.isdisjoint(names)
            self.aside = self.aside or not ASIDE_NAMES.isdisjoint(names)
        elif not GOOD_NAMES.isdisjoint(names):
            odds += IN_GOOD_NAME
        return odds


def _names(value: str) -> list[str]:
    """Words of a class or id, without those behind a modifier."""
    names = NAME.findall(CAMEL.sub(" ", value).lower())
    if MODIFIERS.isdisjoint(names):
        return names
    out = []
    for token in value.split():
        for name in NAME.findall(CAMEL.sub(" ", token).lower()):
            if name in MODIFIERS:
                break
            out.append(name)
    return out


class Block:
    __slots__ = ("parent", "text", "odds")

    def __init__(self, parent: Element, text: str, linked: int):
        self.parent, self.text = parent, text
        words = text.count(" ") + 1
        odds = BIAS + parent.odds + WORDS * (math.log(words) - 1.5)
        odds += LINKS * linked / len(text)
        if parent.tag == "p":
            odds += PARAGRAPH
        elif parent.tag in HEADINGS:
            odds += HEADING + (TITLE if parent.title else 0.0)
        self.odds = odds
        parent.words += words * (1 - linked / len(text))


def shelter(made: list[Element], found: list[Block]) -> None:
    """Takes the cost of bad names off the page's main text and what is around it.

    ``made`` holds the elements in order. The main text is that of the ``main`` element of most
    words outside links; of the largest article, if it holds more than all blocks free of bad names
    and tags; and of any element that holds ``BULK`` of the page's words, or of those outside asides
    if that is half of all. Articles in asides, and whatever lies in comments, are never it.
    """
    if not any(e.bad for e in made):
        return
    own = [e.words for e in made]
    for e, words in zip(reversed(made), reversed(own)):
        if not (e.aside or e.junk):
            e.plain += words
        if e.parent is not None:
            e.parent.words += e.words
            e.parent.plain += e.plain
    sheltered: set[Element] = set()

    def keep(found: list[Element]) -> None:
        e = max(found, key=lambda e: e.words, default=None)
        while e is not None:
            if e.bad:
                sheltered.add(e)
            e = e.parent

    cores = [e for e in made if e.core and not e.junk]
    keep([e for e in cores if e.core == "main" and not e.comment])
    total, plain = made[0].words, made[0].plain
    for e in made:
        if e.bad and e.words and not e.junk and not (e.parent if e.core else e).comment:
            if e.words >= BULK * total or 2 * e.plain >= total and e.plain >= BULK * plain:
                sheltered.add(e)
    spoilt: set[Element] = set()
    for e in made:
        if e.junk or e.bad and e not in sheltered or e.parent in spoilt:
            spoilt.add(e)
    free = sum(words for e, words in zip(made, own) if e not in spoilt)
    articles = [e for e in cores if e.core == "article" and not e.aside]
    keep([e for e in articles if e in spoilt and e.words > free])
    if not sheltered:
        return
    for e in made:
        e.relief = (e.parent.relief if e.parent else 0.0) - IN_BAD_NAME * (e in sheltered)
    for block in found:
        block.odds += block.parent.relief


class Markup:
    """Tags, comments and sections of a page, found in time that grows with its length.

    A tag ends at the first ``>`` outside quotes; where quotes do not close, at the first ``>``.
    Where a tag would end is kept for each quote that is met outside quotes, so no stretch is
    read again however many tags begin before it. Without a later ``>`` there is no tag.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.ends: dict[int, int] = {}

    def end(self, at: int) -> int:
        """The first ``>`` outside quotes from ``at`` on, or -1."""
        html, met, end = self.html, [], -1
        while m := MARKED.search(html, at):
            quote = m.start()
            if m.group() == ">":
                end = quote
                break
            if quote in self.ends:
                end = self.ends[quote]
                break
            met.append(quote)
            at = html.find(m.group(), quote + 1) + 1
            if not at:
                break
        self.ends.update(dict.fromkeys(met, end))
        return end

    def next(self, at: int) -> tuple[int, int, str | None, str, str] | None:
        """Start and end of the next markup; slash, name and attributes of a tag, or None and the
        text of a CDATA section."""
        html = self.html

        def until(mark: str) -> int:
            found = html.find(mark, m.end())
            return len(html) if found < 0 else found + len(mark)

        while m := OPENING.search(html, at):
            start, head = m.span()[0], m.group()
            if head == "<!--":
                return start, until("-->"), None, "", ""
            if head == "<![CDATA[":
                end = until("]]>")
                return start, end, None, "", html[m.end() : end].removesuffix("]]>")
            if head in ("<!", "<?"):
                return start, until(">"), None, "", ""
            if start < self.last:
                name = NAME_END.search(html, m.end() - 1).start()
                end = self.end(name)
                if end < 0:
                    end = html.find(">", name)
                slash = "/" if head[1] == "/" else ""
                return start, end + 1, slash, html[m.end() - 1 : name], html[name:end]
            at = start + 1
        return None


def blocks(html: str) -> list[Block]:
    """Blocks of a page in order; text of scripts, styles and hidden elements is left out."""
    out: list[Block] = []
    here = root = Element("#root", "", None)
    made = [root]
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                holder = here
                while holder.tag in INLINE and holder.parent is not None:
                    holder = holder.parent
                out.append(Block(holder, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = unescape(text)
        pieces.append(text)
        if here.link:
            linked += len(text)

    def close(tags, scopes=SCOPES) -> None:
        """Leaves the nearest open element of these kinds, if none of ``scopes`` is between."""
        nonlocal here
        at = here
        while at is not root and at.tag not in tags:
            if at.tag in scopes:
                return
            at = at.parent
        if at is not root:
            here = at.parent

    at, size, markup = 0, len(html), Markup(html)
    while at < size:
        found = markup.next(at)
        if found is None:
            if not here.silent:
                say(html[at:])
            break
        start, end, ends, tag, attributes = found
        if start > at and not here.silent:
            say(html[at:start])
        at = end
        if ends is None:
            if attributes and not here.silent:
                pieces.append(attributes)
            continue
        tag = tag.lower()
        if tag == "br":
            if not here.silent:
                pieces.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if ends:
            if tag in INLINE:
                close({tag}, SCOPES | {"p"})
            elif tag == "p" or tag in HEADINGS:
                close(HEADINGS if tag in HEADINGS else {"p"})
            else:
                close({tag}, CELLS - {tag} if tag not in TABLE_PARTS else {"table"} - {tag})
            continue
        if tag in VOID or attributes.endswith("/") and tag not in INLINE and tag not in SCOPES:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b", re.I).search(html, at)
            at = html.find(">", stop.end()) + 1 if stop else 0
            at = at or size
            continue
        if tag not in INLINE:
            if here.tag != "#root":
                close({"p", *HEADINGS} if tag in HEADINGS else {"p"})
            if tag in SIBLINGS:
                close(SIBLINGS[tag], SCOPES - SIBLINGS[tag])
            if tag == "body" or tag == "html":
                here = root if tag == "html" else _outside_head(here)
        elif tag == "a":
            close({"a"})
        here = Element(tag, attributes, here)
        made.append(here)
    flush()
    shelter(made, out)
    return out


def _outside_head(here: Element) -> Element:
    at = here
    while at.parent is not None:
        if at.tag == "head":
            return at.parent
        at = at.parent
    return here


def steps_apart(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges: neighbours, and each block to the next of the same parent's children."""
    out, last = [], {}
    for i, block in enumerate(found):
        if i:
            steps = steps_apart(found[i - 1].parent, block.parent)
            out.append((i - 1, i, round(SCALE * NEIGHBOUR * FALL ** max(0, steps - 2))))
        key = id(block.parent.parent or block.parent)
        before = last.get(key)
        if before is not None and before != i - 1:
            out.append((before, i, round(SCALE * SIBLING)))
        last[key] = i
    return [e for e in out if e[2] > 0]


def least_cut(odds: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes the source side of a least cut holds; of several, the smallest side.

    ``odds`` is the capacity from the source if positive, to the sink if negative.
    """
    n = len(odds)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in links:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    own = list(odds)
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(own[i]) <= sum(near[i].values()):
            continue
        label[i] = own[i] > 0
        for j, w in near[i].items():
            own[j] += w if label[i] else -w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _augmented(rest, own, near)
        for i in rest:
            label[i] = i in side
    return [bool(x) for x in label]


def _augmented(rest: list[int], own: list[int], near: list[dict[int, int]]) -> set[int]:
    """Nodes that the source still reaches once blocking flows along shortest paths are used up.

    Each phase sends a blocking flow through the layers of a breadth-first search, and the
    shortest path grows with every phase: few phases, each in time near the number of edges.
    """
    room = {i: dict(near[i]) for i in rest}
    supply = {i: own[i] for i in rest if own[i] > 0}
    demand = {i: -own[i] for i in rest if own[i] < 0}
    while True:
        layer = {i: 0 for i, s in supply.items() if s > 0}
        queue, met = deque(layer), False
        while queue:
            i = queue.popleft()
            met = met or demand.get(i, 0) > 0
            for j, c in room[i].items():
                if c > 0 and j not in layer:
                    layer[j] = layer[i] + 1
                    queue.append(j)
        if not met:
            return set(layer)
        arcs = {i: iter(list(room[i])) for i in layer}
        for source in [i for i, d in layer.items() if d == 0]:
            path = [source]
            while path and supply[source] > 0:
                i = path[-1]
                if demand.get(i, 0) > 0:
                    steps = list(zip(path, path[1:]))
                    flow = min(supply[source], demand[i], *(room[x][y] for x, y in steps))
                    supply[source] -= flow
                    demand[i] -= flow
                    for x, y in steps:
                        room[x][y] -= flow
                        room[y][x] = room[y].get(x, 0) + flow
                    full = next((k for k, (x, y) in enumerate(steps) if not room[x][y]), len(steps))
                    del path[full + 1 :]
                    continue
                onward = next(
                    (j for j in arcs[i] if layer.get(j, 0) == layer[i] + 1 and room[i][j] > 0), None
                )
                if onward is None:
                    layer[i] = -1  # leads nowhere in this phase
                    path.pop()
                else:
                    path.append(onward)


def main_text(html: str) -> str:
    found = blocks(html)
    labels = least_cut([round(SCALE * b.odds) for b in found], edges(found))
    return " ".join(b.text for b, keep in zip(found, labels) if keep)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``, its code points."""

    def compute(_: pa.RecordBatch, bodies: list[bytes]) -> dict[str, list]:
        text = [main_text(b.decode("utf-8", "replace")) for b in bodies]
        return {"text": text, "n_chars": [len(t) for t in text]}

    return add_columns(pages, html, "text string, n_chars long", compute)
