"""Main-text extraction by minimum-cut labelling.

A page is read into blocks (runs of text between block-level tags).  A linear
classifier of each block's own features gives the cost of calling it content
or boilerplate; these are the capacities from the source and to the sink.
Smoothness edges join neighbours in page order and blocks under the same
parent element, weaker with growing distance in the tree, and not at all
across the border of a page part (header, navigation, article).  The minimum
cut, found by maximum flow, separates content from boilerplate.

Each page is labelled by itself in a row-wise pass: no shuffle, and the memory
is that of one page's blocks.  Blocks whose own cost outweighs all their edges
are labelled at once; only the rest enters the flow network, which does not
change the minimum.

Reading is linear in the length of a page, however malformed.  Defined results: a
null or empty html, or a page without content blocks, gives an empty text;
malformed pages (unclosed or stray tags, missing body) are read as far as they
go, and a tag that the page's end cuts off is dropped; repeated rows are extracted one by one; columns of the
pages that clash with ``text`` or ``n_chars`` are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from foldwise.llm.frames import annotate

# possessive, and every start of a tag matches (at worst up to the page's end), so
# a page is read in linear time whatever is missing in it; a quote opens a value
# only after an equals sign
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(>|\Z)""", re.S | re.X)
SPACE = re.compile(r"\s+")
HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# elements whose content is never text of the page
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select "
                   "option textarea button datalist map".split())
RAW = frozenset("script style noscript template title textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr".split())
# opening one of these ends an open paragraph
ENDS_P = frozenset("address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
# parts of a page: evidence for content (positive) or boilerplate (negative)
PARTS = {"article": 4.0, "main": 3.0, "nav": -8.0, "header": -4.0, "footer": -8.0, "aside": -8.0, "form": -8.0,
         "menu": -8.0, "dialog": -6.0}
GOOD = frozenset("article body content entry main post story text".split())
BAD = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent "
                "cookie cookies disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter "
                "notice pagination pager popup privacy promo promoted recommended related respond search share sharing "
                "sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
TAGS = {"p": 1.5, "h1": 1.0, "h2": 0.6, "h3": 0.6, "h4": 0.3, "blockquote": 1.0, "pre": 1.0, "li": -0.3, "td": 0.0,
        "figcaption": 0.3, "body": -1.0, "div": 0.0}
# Costs and edges are on one scale: what a page's part (its elements and the words
# of its class names) tells is one feature of limited weight, so neighbours can
# overrule a block's own look
NEIGHBOUR, SIBLING = 1.0, 1.5     # capacities of smoothness edges
LINK, BIAS, LENGTH, STOP = -2.0, -0.5, 1.0, 0.3
PART, PART_LEAST, PART_MOST, TAG = 0.3125, -2.5, 1.25, 0.5
SHORT, LONG = 4, 12               # words


class Block:
    __slots__ = ("text", "linked", "part", "parent", "tag", "depth")

    def __init__(self, text, linked, part, parent, tag, depth):
        self.text, self.linked, self.part, self.parent, self.tag, self.depth = text, linked, part, parent, tag, depth


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    # open elements: (tag, serial number, evidence of its page part, part number)
    stack: list[tuple[str, int, float, int]] = [("", 0, 0.0, 0)]
    solid = [0]                               # places in the stack of elements that are not inline
    places: dict[str, list[int]] = {}         # places in the stack by tag
    pieces: list[str] = []
    linked = links = silent = serial = 0
    at = 0

    def close():
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            if text:
                tag, number, evidence, _ = stack[solid[-1]]
                below = solid[-1] if solid[-1] < len(stack) - 1 else solid[-2] if len(solid) > 1 else 0
                out.append(Block(text, min(1.0, linked / len(text)), (evidence, stack[-1][3]), stack[below][1], tag, len(stack)))
            pieces.clear()
        linked = 0

    def pop(to: int):
        nonlocal links, silent
        while len(stack) > to:
            tag = stack.pop()[0]
            places[tag].pop()
            if solid[-1] == len(stack):
                solid.pop()
            links -= tag == "a"
            silent -= tag in SILENT

    while True:
        m = TOKEN.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text and not silent:
            pieces.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None or not m[4]:          # comment, doctype, instruction; a tag cut off by the page's end
            continue
        name = name.lower()
        if m[1]:                              # end tag: close up to its element, if open
            if name not in INLINE:
                close()
            if places.get(name):
                k = places[name][-1]
                if name in INLINE and solid[-1] > k:
                    continue                  # a stray inline end within a block
                pop(k)
            continue
        if name == "br":
            pieces.append(" ")
        if name not in INLINE:
            close()
        if name in ENDS_P:
            k = solid[-1]
            if k and (stack[k][0] == "p" or name in ("li", "dd", "dt") and stack[k][0] == name):
                pop(k)
        if name == "body" and places.get("head"):     # a head left open ends here
            pop(places["head"][0])
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:                       # its content is not markup
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        serial += 1
        evidence, part = stack[-1][2], stack[-1][3]
        own = PARTS.get(name, 0.0)
        if name == "header" and evidence > 0:  # of an article: its title
            own = 0.0
        if m[3] and name not in INLINE:
            words = {w for g in HINT.findall(m[3]) for w in re.split(r"[^a-z]+", "".join(g).lower())}
            if words & BAD:
                own -= 8.0
            elif words & GOOD:
                own += 2.0
        if own:
            evidence, part = (min(evidence, 0.0) if own < 0 else evidence) + own, serial
        links += name == "a"
        silent += name in SILENT
        places.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            solid.append(len(stack))
        stack.append((name, serial, evidence, part))
    close()
    return out


def costs(items: list[Block]) -> list[float]:
    """Score of each block: positive if content is likelier."""
    out = []
    for b in items:
        words = b.text.count(" ") + 1
        score = BIAS + TAG * TAGS.get(b.tag, 0.0) + LINK * b.linked
        score += max(PART_LEAST, min(PART_MOST, PART * b.part[0]))
        score += LENGTH if words >= LONG else -LENGTH if words <= SHORT else 0.0
        score += STOP if b.text[-1] in ".!?…\"'”»" else -STOP
        out.append(score)
    return out


def edges(items: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges between blocks of the same page part."""
    out, latest = [], {}
    for i, b in enumerate(items):
        if i and items[i - 1].part[1] == b.part[1]:
            out.append((i - 1, i, NEIGHBOUR / (1 + abs(items[i - 1].depth - b.depth))))
        j = latest.get((b.parent, b.part[1]))
        if j is not None:
            out.append((j, i, SIBLING / (i - j)))
        latest[b.parent, b.part[1]] = i
    return out


def max_flow(n: int, arcs: list[tuple[int, int, float, float]], source: int, sink: int) -> list[bool]:
    """Dinic's algorithm; arcs are (u, v, capacity u->v, capacity v->u).
    Returns which nodes stay on the source's side of a minimum cut."""
    head: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for u, v, c, back in arcs:
        head[u].append(len(to))
        to.append(v)
        room.append(c)
        head[v].append(len(to))
        to.append(u)
        room.append(back)
    tiny = 1e-9
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level]
        nxt = [0] * n
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if room[e] <= tiny)
                u = to[path[k] ^ 1]
                del path[k:]
            while nxt[u] < len(head[u]):
                e = head[u][nxt[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    break
                nxt[u] += 1
            else:
                if u == source:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]


def minimum_cut(score: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for the blocks on the content side of the minimum cut."""
    n = len(score)
    weight = [0.0] * n
    for i, j, c in links:
        weight[i] += c
        weight[j] += c
    label: list[bool | None] = [s > 0 if abs(s) >= w else None for s, w in zip(score, weight)]
    free = [i for i in range(n) if label[i] is None]
    if free:
        number = {i: k for k, i in enumerate(free)}
        source, sink = len(free), len(free) + 1
        pull = {i: score[i] for i in free}
        arcs = []
        for i, j, c in links:
            if label[i] is None and label[j] is None:
                arcs.append((number[i], number[j], c, c))
            elif label[i] is None:
                pull[i] += c if label[j] else -c
            elif label[j] is None:
                pull[j] += c if label[i] else -c
        for i, s in pull.items():
            if s > 0:
                arcs.append((source, number[i], s, 0.0))
            elif s < 0:
                arcs.append((number[i], sink, -s, 0.0))
        side = max_flow(len(free) + 2, arcs, source, sink)
        for i in free:
            label[i] = side[number[i]]
    return [bool(x) for x in label]


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by an empty line."""
    items = blocks(page) if page else []
    if not items:
        return ""
    keep = minimum_cut(costs(items), edges(items))
    return "\n\n".join(b.text for b, k in zip(items, keep) if k)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its ``keep`` columns) with text and n_chars (code points)."""
    def make():
        def compute(batch):
            texts = [main_text(p) for p in batch.column(0).to_pylist()]
            return [texts, pa.array([len(t) for t in texts], pa.int64())]
        return compute
    return annotate(pages, {"html": f"`{html}`"}, [("text", "string"), ("n_chars", "bigint")], make, keep)
