"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A linear classifier scores each block from what it says itself: its words, links,
tag and ending; the score becomes the capacity to one terminal. Elements whose tag, role or class tells what they are for are nodes of
the graph, too, with capacities of their own: an article speaks for content, a menu against it, a class word such as "ad" or "search" against it the less the more
of the page the element holds. Smoothness edges join neighbouring blocks, blocks that are close in the DOM, and each block
with the element that holds it. The minimum cut gives the cheapest labelling of all blocks and elements at once: a short line
inside an article is kept and a long sentence in an advert goes, whatever each says by itself, and a class word around the whole
article is outvoted by the paragraphs inside. Nodes whose terminal capacity outweighs all their edges are settled first, which leaves
the cut the same; max-flow (Dinic's algorithm) settles the rest.

Tags are read by a scanner that looks at each character a bounded number of times, whatever the page.
"""

from __future__ import annotations

import html as references
import math
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import tidily

# Element names and words of class, id and role that tell what a part of a page is for.
RAW = frozenset("script style title textarea iframe".split())
DROPPED = frozenset("noscript template svg canvas object select button audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
VOID = frozenset("br img input hr meta link wbr area base col embed source track param".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = HEADINGS | frozenset("p li td th dt dd".split())  # what holds them is their blocks' parent
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
WHOLE_PAGE = frozenset("html body".split())
BOILERPLATE_ROLES = frozenset("navigation contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus discussion".split())
BOILERPLATE_WORDS = COMMENT_WORDS | frozenset("nav navbar navigation menu footer sidebar aside ad ads advert advertisement adverts banner cookie cookies consent gdpr notice notices popup modal overlay promo sponsor sponsored share sharing social related recommended breadcrumb breadcrumbs newsletter subscribe subscription signup login search widget pagination pager toolbar copyright skip".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
BLOCK_START = re.compile(r"<(?:p|div|article|main|section|body|h[1-6]|ul|ol|table|header|footer|nav|aside|blockquote|pre)\b", re.I)
PLAIN_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\s+[A-Za-z-]+(?:="[^"<>]*")?)*)\s*(/?)>""")
NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
ATTRIBUTE_NAME = re.compile(r"[^\s=></][^\s=></]*")
BARE_VALUE = re.compile(r"[^\s>]*")
SPACE = re.compile(r"\s*")
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:="([^"]*)")?""")
WORD = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Weights of the classifier; positive speaks for content. Capacities are in hundredths, as those of the edges.
WEIGHTS = {"bias": -3.0, "words": 0.8, "links": -4.0, "linked_in_article": 2.0, "heading": 0.6, "paragraph": 0.4, "item": -0.1, "sentence": 0.5, "rights": -2.5}
ENOUGH = 24  # words; more say no more
ADJACENT, ACROSS, SIBLING = 100, 20, 60
#: Edges of a block to the element that holds it (a firm one decides), and of an element to the one around it.
HOLDS, HOLDS_FIRMLY, AROUND = 250, 600, 100
#: What elements say for each block that they hold; what is outside of the article counts by the article's share of the page.
ELEMENT = {"article": 250, "word": -500, "firm": -1000, "outside": -400}


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    linked: int
    parent: int
    node: int  # the element that holds it


@dataclass(slots=True)
class Element:
    kind: str  # "" (the page), "article", "word" (marked by a class or id), "firm"
    around: int


class Scanner:
    """Text and tags of a page: (text, "", False, {}, False) or (None, name, closing, attributes, self-closed).

    A quote counts only where a value begins, and only if it is closed; outside of quotes a tag ends at "<" too.
    A comment that is not closed ends at the next ">".
    """

    def __init__(self, page: str):
        self.page, self.none_left, self.ends = page, set(), {}

    def find(self, what: str, at: int) -> int:
        if what in self.none_left:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none_left.add(what)
        return found

    def end_tag(self, name: str, at: int) -> int:
        """Where the next end tag of that name begins, or -1; all are looked up once."""
        if name not in self.ends:
            self.ends[name] = [m.start() for m in re.finditer(rf"</{name}(?![A-Za-z0-9:-])", self.page, re.I)]
        i = bisect_right(self.ends[name], at)
        return self.ends[name][i] if i < len(self.ends[name]) else -1

    def __iter__(self) -> Iterator[tuple]:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            open_ = page.find("<", at)
            if open_ < 0:
                yield page[at:], "", False, {}, False
                return
            if open_ > at:
                yield page[at:open_], "", False, {}, False
            m = PLAIN_TAG.match(page, open_)
            if m:
                at = m.end()
                name, closing = m.group(2).lower(), bool(m.group(1))
                attributes = {k.lower(): v for k, v in ATTRIBUTE.findall(m.group(3))} if m.group(3) else {}
                closed = bool(m.group(4))
            elif page.startswith("<!--", open_):
                end = self.find("-->", open_ + 4)
                end = end if end >= 0 else self.find(">", open_)
                at = n if end < 0 else page.index(">", end) + 1
                continue
            elif m := NAME.match(page, open_):
                name, closing = m.group(1).lower(), page[open_ + 1] == "/"
                at, attributes, closed = self.attributes(m.end())
            elif page[open_ + 1 : open_ + 2] in ("!", "?", "/"):
                end = self.find(">", open_)
                at = n if end < 0 else end + 1
                continue
            else:
                yield "<", "", False, {}, False
                at = open_ + 1
                continue
            yield None, name, closing, attributes, closed
            if name in RAW and not closing and not closed:
                end = self.end_tag(name, at)
                if end < 0:  # never closed: up to the next block
                    block = BLOCK_START.search(page, at)
                    end = block.start() if block else n
                at = end

    def attributes(self, at: int) -> tuple[int, dict[str, str], bool]:
        page, n, out, closed = self.page, len(self.page), {}, False
        while at < n:
            at = SPACE.match(page, at).end()
            x = page[at : at + 1]
            if x == ">":
                return at + 1, out, closed
            if x in ("<", ""):
                return at, out, closed
            if x in "/=":
                closed = x == "/"
                at += 1
                continue
            closed = False
            m = ATTRIBUTE_NAME.match(page, at)
            at = SPACE.match(page, m.end()).end()
            value = ""
            if page[at : at + 1] == "=":
                at = SPACE.match(page, at + 1).end()
                quote = page[at : at + 1]
                end = self.find(quote, at + 1) if quote and quote in "\"'" else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    b = BARE_VALUE.match(page, at)
                    value, at = b.group().strip("\"'"), b.end()
            out.setdefault(m.group().lower(), value)
        return n, out, closed


def purpose(tag: str, attributes: dict[str, str], in_article: bool) -> tuple[str, bool]:
    """(mark, article) as the element itself says: marks are "" (none), "word" (by class or id), "firm"."""
    mark, good = "firm" if tag in BOILERPLATE_TAGS or (tag == "header" and not in_article) else "", tag in CONTENT_TAGS
    for name, value in attributes.items():
        if name in ("class", "id"):
            words = set(WORD.findall(value.lower()))
            if not words.isdisjoint(COMMENT_WORDS):
                mark = "firm"
            elif tag not in WHOLE_PAGE and not good and (not words.isdisjoint(BOILERPLATE_WORDS) or (not in_article and not words.isdisjoint(HEADER_WORDS))):
                mark = mark or "word"
        elif name == "role":
            value = value.lower()
            if value in BOILERPLATE_ROLES or (value == "banner" and not in_article):
                mark = "firm"
            good = good or value in CONTENT_TAGS
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)):
            mark = "firm"
    return mark, good


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks in page order, and the elements that say what they are for: white space is one space, character references are
    decoded, nothing is empty. What a firm element holds has no element of its own.

    An element that is dropped and never closed drops nothing but its tag.
    """
    out: list[Block] = []
    elements = [Element("", -1)]
    stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]  # tag, number, element, in an article, dropped
    names: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link, tag, number = 0, False, "", 0
    scanner = Scanner(page)
    seen = 0  # characters read, at least

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tag, min(linked, len(text)), stack[-1][1], stack[-1][2]))
            parts.clear()
        linked = 0

    def pop() -> None:
        names[stack.pop()[0]] -= 1

    for text, name, closing, attributes, closed in scanner:
        if text is not None:
            seen += len(text)
            if not stack[-1][4]:
                parts.append(text)
                linked += len(text) * in_link
            continue
        seen += len(name) + 2 + closing
        if name in RAW:
            continue
        if name == "a":
            in_link = not closing
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE and (name in VOID or (not names[name] if closing else not attributes or not purpose(name, attributes, True)[0])):
            continue
        flush()
        in_link = in_link and name == "p"
        if closing:
            if names[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            tag = stack[-1][0]
            continue
        tag = name
        if name in VOID or closed or (name in DROPPED and scanner.end_tag(name, seen - len(name) - 2) < 0):
            continue
        while stack[-1][0] == "p" or (name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name):
            pop()  # ended by what follows
        _, parent, node, article, dropped = stack[-1]
        own, good = purpose(name, attributes, article)
        number += 1
        if (own or good) and elements[node].kind != "firm":
            elements.append(Element(own or "article", node))
            node, article = len(elements) - 1, good and not own
        stack.append((name, parent if name in PARTS else number, node, article, dropped or name in DROPPED))
        names[name] += 1
    flush()
    return out, elements


def scores(page: list[Block], elements: list[Element]) -> list[float]:
    """The classifier: what each block says by itself."""
    w = WEIGHTS
    out = []
    for b in page:
        density = b.linked / len(b.text)
        z = w["bias"] + w["words"] * math.log2(1 + min(b.text.count(" ") + 1, ENOUGH)) + w["links"] * density
        if elements[b.node].kind == "article":
            z += w["linked_in_article"] * density
        if b.tag == "p":
            z += w["paragraph"]
        elif b.tag in HEADINGS:
            z += w["heading"]
        elif b.tag in ("li", "td", "th", "dt"):
            z += w["item"]
        if b.text[-1] in ".!?。…\"”»":
            z += w["sentence"]
        if "©" in b.text:
            z += w["rights"]
        out.append(z)
    return out


def capacities(page: list[Block], elements: list[Element]) -> tuple[list[int], list[int]]:
    """(what each element says, in hundredths; which element each block is held by, -1: none that says anything).

    A class word is worth less the more of what it should have hidden is inside, and nothing from a half on: of the words of the article that it is in; or of all articles, where the page has
    any; or of the page. Firm elements' words never count. Where an article has words, the page's own blocks are outside of it.
    """
    n = len(elements)
    inside, articles, article = [0] * n, [0] * n, [-1] * n
    for b in page:
        if elements[b.node].kind != "firm":
            inside[b.node] += b.text.count(" ") + 1
    unmarked = inside[0]
    for i in range(1, n):  # an element follows the one around it
        article[i] = article[elements[i].around] if elements[elements[i].around].kind != "article" else elements[i].around
    for i in range(n - 1, 0, -1):
        inside[elements[i].around] += inside[i]
        articles[elements[i].around] += inside[i] if elements[i].kind == "article" else articles[i]
    says, speaker, held = [], [], [0] * n
    for i, e in enumerate(elements):
        if e.kind == "":
            says.append(ELEMENT["outside"] * articles[0] / (articles[0] + unmarked) if articles[0] else 0)
        elif e.kind == "word":
            part, whole = (inside[i], inside[article[i]]) if article[i] >= 0 else (articles[i], articles[0]) if articles[0] else (inside[i], inside[0])
            says.append(ELEMENT["word"] * max(0.0, 1 - (2 * part / whole) ** 2) if whole else 0)
        else:
            says.append(ELEMENT[e.kind])
        speaker.append(i if says[i] else speaker[e.around] if i else -1)
    by = [speaker[b.node] for b in page]
    for i in by:
        held[i] += i >= 0
    return [round(x * k) for x, k in zip(says, held, strict=True)], by


def holders(elements: list[Element], by: list[int]) -> list[tuple[int, int, int]]:
    """Edges of blocks to the elements that hold them, and of elements to those around; elements come after the blocks."""
    n = len(by)
    out = [(i, n + k, HOLDS_FIRMLY if elements[k].kind == "firm" else HOLDS) for i, k in enumerate(by) if k >= 0]
    return out + [(n + i, n + e.around, AROUND) for i, e in enumerate(elements) if e.around >= 0 and e.kind != "firm"]


def edges(page: list[Block]) -> list[tuple[int, int, int]]:
    """Neighbours in page order, stronger under one parent; and the next block of the same parent further on."""
    out, last = [], {}
    for i, b in enumerate(page):
        if i:
            out.append((i - 1, i, ADJACENT if page[i - 1].parent == b.parent else ACROSS))
        j = last.get(b.parent)
        if j is not None and j < i - 1:
            out.append((j, i, SIBLING))
        last[b.parent] = i
    return out


def min_cut(source: list[int], sink: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source. ``source[i]`` is paid if i goes to the sink, ``sink[i]`` if it stays, a link's
    weight if it is cut. Of equally cheap cuts, the one with the most nodes at the source."""
    n = len(source)
    gain = [a - b for a, b in zip(source, sink, strict=True)]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in links:
        if i != j and w:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    label: list[bool | None] = [None] * n
    pull = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:  # a node whose gain outweighs its open links has its label in a minimum cut
        i = queue.popleft()
        if label[i] is not None or -pull[i] <= gain[i] < pull[i]:
            continue
        label[i] = gain[i] >= pull[i]
        for j, w in near[i].items():
            if label[j] is None:
                gain[j] += w if label[i] else -w
                pull[j] -= w
                queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        flow = [(at[i], at[j], w) for i in rest for j, w in near[i].items() if label[j] is None and i < j]
        for i, stays in zip(rest, dinic([gain[i] for i in rest], flow), strict=True):
            label[i] = stays
    return [bool(x) for x in label]


def dinic(gain: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Max-flow from the source (to nodes of positive gain) to the sink (from nodes of negative gain)."""
    n = len(gain)
    s, t = n, n + 1
    out: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            arc(s, i, g, 0)
        elif g < 0:
            arc(i, t, -g, 0)
    for i, j, w in links:
        arc(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            break
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                path.clear()
                a = s
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break
    drains = [False] * (n + 2)  # what can still reach the sink goes to it; all else stays
    drains[t] = True
    queue = deque([t])
    while queue:
        b = queue.popleft()
        for e in out[b]:
            if room[e ^ 1] and not drains[to[e]]:
                drains[to[e]] = True
                queue.append(to[e])
    return [not x for x in drains[:n]]


def labelled(page: str) -> tuple[list[Block], list[int], list[bool]]:
    """The blocks, what each says by itself, and which are content."""
    found, elements = blocks(page)
    own = [round(100 * z) for z in scores(found, elements)]
    said, by = capacities(found, elements)
    capacity = own + said
    content = min_cut([max(c, 0) for c in capacity], [max(-c, 0) for c in capacity], edges(found) + holders(elements, by))
    return found, own, content[: len(found)]


def main_text(page: str) -> str:
    found, _, content = labelled(page)
    return " ".join(b.text for b, x in zip(found, content, strict=True) if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row. Null or empty html, and pages without content, give the empty text.

    Elements that are never closed end with what holds them; tags that are never closed end at the next "<". Each page is labelled by itself, whole; repeated rows each give a row; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(tidily(run), "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
