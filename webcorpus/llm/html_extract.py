"""Main text of pages by a minimum cut over their text blocks.

A page is cut into blocks of text. Each block has a score from its place in the document and its text; the score is the
capacity of its edge from the source (content) or to the sink (boilerplate). Neighbouring blocks, and blocks that follow each
other below one parent, are joined by smoothness edges, weaker where the document's structure says that a section ends. The
minimum cut is the cheapest labelling: what stays with the source is the main text.

A block whose score outweighs all its edges keeps its label in some minimum cut. Such blocks are fixed first, which moves their
edges into the scores of their neighbours; the flow runs only through what remains, so very long pages stay cheap.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Quoted values may hold ">" but end before "<", so that a quote without an end costs no second reading.
TOKEN = re.compile(
    r"""<!--(?:.*?--!?>|.*)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>|[^<>]*+>?)|<[!?][^<>]*+>?""", re.S
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SKIPPED = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "button", "canvas"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "head"}
SAME = {"li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}
SCOPES = {"article", "main", "section", "div", "table", "body", "ul", "ol", "nav", "aside", "footer", "header", "form"}
BAD_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "label", "head"}
GOOD_TAGS = {"article", "main"}
BAD_WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|breadcrumbs?|foot(?:er)?|site-?header|masthead|topbar|side-?bar|widgets?|ads?|advert\w*|banner|"
    r"promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|newsletter|subscri\w*|pop-?up|modal|overlay|shar(?:e|ing)|social|"
    r"related|recommend\w*|comments?|disqus|repl(?:y|ies)|respond|login|sign-?up|pag(?:er|ination)|copyright|legal|search|"
    r"navigation|complementary|contentinfo|toolbar|skip)(?=$|[\s_-])",
    re.I,
)
GOOD_WORDS = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|body|text|prose)(?=$|[\s_-])", re.I)
BAD, GOOD, HEADER = 1, 2, 4
INFLUENCE = {BAD: -8.0, GOOD: 3.0, HEADER: -4.0}
NEXT, SIBLING, ACROSS = 0.6, 0.8, 0.05  # capacities of smoothness edges


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    tag: str
    parent: int  # number of the element that holds the block
    flags: int


class _Open(NamedTuple):
    name: str
    number: int
    flags: int


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order: runs of text between starts and ends of block elements."""
    out: list[Block] = []
    stack = [_Open("", 0, 0)]
    count: dict[str, int] = {}
    parts: list[str] = []
    linked = opened = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                holder = next((e for e in reversed(stack[-8:]) if e.name in BLOCK or not e.name), stack[0])
                out.append(Block(text, min(linked, len(text)), holder.name, holder.number, stack[-1].flags))
            parts.clear()
        linked = 0

    def close(name: str) -> None:
        while True:
            gone = stack.pop()
            count[gone.name] -= 1
            if gone.name == name:
                return

    end = len(page)
    while at < end:
        found = TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            piece = page[at:stop]
            parts.append(piece)
            if count.get("a"):
                linked += len(piece)
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name in BLOCK:
                flush()
            elif name not in ("a", "b", "i", "em", "strong", "span", "u", "small", "font", "sub", "sup", "code", "mark"):
                parts.append(" ")
            if count.get(name):
                close(name)
            continue
        if name in SKIPPED:
            if not found[3].endswith("/>"):
                last = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                at = last.end() if last else end
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name in CLOSES_P and count.get("p"):
            close("p")
        same = SAME.get(name)
        if same and stack[-1].name == same:
            close(same)
        opened += 1
        flags = stack[-1].flags
        if name in BAD_TAGS:
            flags |= BAD
        elif name in GOOD_TAGS:
            flags |= GOOD
        elif name == "header" and not flags & GOOD:
            flags |= HEADER
        if name in BLOCK and name not in ("html", "body") and len(found[3]) > 4:
            hints = " ".join(a or b or c for a, b, c in NAMES.findall(found[3]))
            if hints:
                if BAD_WORDS.search(hints):
                    flags |= BAD
                elif GOOD_WORDS.search(hints):
                    flags |= GOOD
        stack.append(_Open(name, opened, flags))
        count[name] = count.get(name, 0) + 1
    flush()
    return out


def score(block: Block) -> float:
    """Log odds that a block is content; above zero for content."""
    value = sum(weight for flag, weight in INFLUENCE.items() if block.flags & flag)
    size = len(block.text)
    value += min(2.0, size / 80) - 1.0
    value -= 4.0 * block.linked / size
    if block.tag in ("p", "blockquote", "pre") or re.fullmatch("h[1-6]", block.tag):
        value += 0.8
    elif block.tag == "li":
        value -= 0.4
    if block.text[-1] in ".!?…:;\"”":
        value += 0.5
    return value


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Adjacent blocks, and blocks that follow each other below one parent."""
    out = []
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            before = blocks[i - 1]
            out.append((i - 1, i, ACROSS if before.flags != block.flags else NEXT))
        j = last.get(block.parent)
        if j is not None and j < i - 1 and blocks[j].flags == block.flags:
            out.append((j, i, SIBLING))
        last[block.parent] = i
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source, for capacities score (from the source) and -score (to the sink)."""
    n = len(scores)
    scores = list(scores)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    load = [0.0] * n
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
        load[a] += w
        load[b] += w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(scores[i]) < load[i]:
            continue
        label[i] = scores[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                scores[j] += w if label[i] else -w
                load[j] -= w
                todo.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        place = {i: k for k, i in enumerate(left)}
        inner = [(place[a], place[b], w) for a, b, w in edges if label[a] is None and label[b] is None]
        for i, kept in zip(left, _max_flow([scores[i] for i in left], inner), strict=True):
            label[i] = kept
    return [bool(x) for x in label]


def _max_flow(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of a minimum cut, by shortest augmenting paths in level graphs."""
    n = len(scores)
    source, sink = n, n + 1
    head: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(head))
        head.append(b)
        room.append(forth)
        out[b].append(len(head))
        head.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        add(source, i, s, 0.0) if s > 0 else add(i, sink, -s, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                flow = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                back = next(k for k, e in enumerate(path) if room[e] <= tiny)
                node = head[path[back] ^ 1]
                del path[back:]
                continue
            while at[node] < len(out[node]):
                e = out[node][at[node]]
                if room[e] > tiny and level[head[e]] == level[node] + 1:
                    break
                at[node] += 1
            else:
                if node == source:
                    break
                e = path.pop()
                node = head[e ^ 1]
                at[node] += 1
                continue
            path.append(e)
            node = head[e]


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    kept = minimum_cut([score(b) for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text`` per row of ``pages``: blocks of the main text joined by line feeds.

    A null or empty page, and one that is all boilerplate, has an empty text. Unfinished tags, comments and scripts take what
    the standard gives them. Repeated rows and null keys stay as they are; other columns aren't read. Each page is worked
    on whole, in the task that reads it. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(p) if p else "" for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(pages[key].cast("bigint").alias("page_id"), pages[url].alias("url"), pages[page].alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string")
