"""Main text of web pages by a minimum cut between content and boilerplate.

A page becomes a row of text blocks. A classifier gives each block a cost for either side; these
are the capacities to the two terminals. Neighbouring blocks, and blocks of one parent in the
document tree, are tied by smoothness edges. The maximum flow decides the cheapest labelling.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import utf8

LEAST_BLOCKS = 50
MAX_TRAINING_PAGES = 4000  # bound of the sample the block classifier is fitted on

# Elements of HTML by their use here.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Left out with all they hold: machinery, form fields, and what a page shows only where sound, pictures or scripts do not work.
SKIPPED = set("audio button canvas datalist embed head iframe noscript option script select style svg template textarea title video".split())
RAW = set("script style textarea title iframe noscript".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = set("nav footer aside dialog menu".split())
CONTENT = set("article main".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words in class names, ids and roles that speak for boilerplate or content, and words that say nothing beside them.
BAD_NAMES = set("ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie "
                "cookies dialog discussion disqus footer form gdpr login menu modal nav navbar navigation newsletter notice notification overlay pager pagination "
                "paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor "
                "sponsored subscribe subscription toc toolbar warning widget".split())
HARD_NAMES = set("ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments disqus discussion footer menu nav navbar navigation "
                 "promoted recommended related replies reply respond sidebar sponsor sponsored widget".split())
GOOD_NAMES = set("article articlebody content entry main post story text".split())
NEUTRAL_NAMES = set("area bar block body bottom box center col column container desktop fixed global group inner item items left link links list mobile module "
                    "outer page panel posts primary right row secondary section site stories top unit wrap wrapper".split())
HEADS = set("header masthead topbar".split())
NO_HINT, GOOD, BAD, HARD = 0, 1, 2, 3

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    links: int
    tag: str
    parent: int
    grand: int
    hint: int


@dataclass
class _Open:
    tag: str
    number: int
    hint: int
    skipped: bool
    inline: Counter | None  # of a block element: the open inline elements right inside it, by tag


def _name_hint(name: str, inside: bool) -> int:
    """What one class name says. It must consist of known words only: ``no-sidebar`` and ``widget-review`` say nothing."""
    parts = {p.lower() for p in _NAME_PART.findall(name)}
    bad = parts & (BAD_NAMES if inside else BAD_NAMES | HEADS)
    if not parts <= bad | GOOD_NAMES | NEUTRAL_NAMES:
        return NO_HINT
    return HARD if bad & HARD_NAMES else BAD if bad else GOOD if parts & GOOD_NAMES else NO_HINT


def _own_hint(tag: str, attributes: str, inside: bool) -> int:
    """What an element says by itself; ``inside`` an article a header belongs to it."""
    found = {GOOD if tag in CONTENT else HARD if tag in BOILERPLATE else BAD if tag == "form" or tag == "header" and not inside else NO_HINT}
    if attributes and tag not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            name = (m[1] or m[5]).lower()
            value = html.unescape(m[2] or m[3] or m[4] or "")
            if name in ("class", "id", "role"):
                found |= {_name_hint(token, inside) for token in value.split()}
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                found.add(HARD)
    if HARD in found:
        return HARD
    return GOOD if tag in CONTENT else max(found)


def _hint(outer: int, own: int) -> int:
    """The nearest element that says something decides, except inside comments, menus and the like."""
    return outer if outer == HARD or own == NO_HINT else own


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, white space collapsed; hidden machinery is left out.

    Open elements are looked at only if an end tag or a new block closes them, so the work is
    proportional to the page, however broken it is.
    """
    out: list[Block] = []
    stack = [_Open("", 0, NO_HINT, False, Counter())]
    holders, open_blocks = [0], Counter()  # places of open block elements in the stack, and how many there are of each tag
    parts: list[str] = []
    linked, links, serial, raw, at = 0, 0, 0, "", 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            own = [stack[k] for k in holders[-3:]]
            out.append(Block(text, links, own[-1].tag, own[-2].number if len(own) > 1 else 0, own[-3].number if len(own) > 2 else 0, stack[-1].hint))
        parts.clear()
        links = 0

    def add(run: str) -> None:
        nonlocal links
        if run and not stack[-1].skipped:
            run = html.unescape(run)
            parts.append(run)
            if linked:
                links += len("".join(run.split()))

    def close(block: bool, tag: str) -> None:
        """Close the innermost open element of this tag, and all inside it."""
        while True:
            last = stack.pop()
            if last.inline is not None:
                holders.pop()
                open_blocks[last.tag] -= 1
            else:
                stack[holders[-1]].inline[last.tag] -= 1
            if last.tag == tag and (last.inline is not None) == block:
                return

    while at < len(page):
        if raw:
            end = re.compile(rf"</{raw}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            raw = ""
            continue
        m = _TOKEN.search(page, at)
        add(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if m[1] or m[4]:
            if tag == "a":
                linked = max(0, linked - 1)
            if open_blocks[tag] > 0 if block else stack[holders[-1]].inline[tag] > 0:
                close(block, tag)
            continue
        if block and tag != "hr" and stack[holders[-1]].tag in CLOSES.get(tag, {"p"}):
            close(True, stack[holders[-1]].tag)
        elif tag == "br":
            parts.append(" ")
        if tag in RAW:
            raw = tag
        elif tag not in VOID:
            if tag == "a":
                linked += 1
            top = stack[-1]
            serial += 1
            if block:
                holders.append(len(stack))
                open_blocks[tag] += 1
            else:
                stack[holders[-1]].inline[tag] += 1
            hint = _hint(top.hint, _own_hint(tag, m[3] or m[6] or "", top.hint == GOOD))
            stack.append(_Open(tag, serial, hint, top.skipped or tag in SKIPPED, Counter() if block else None))
    flush()
    return out


def features(block: Block) -> tuple[int, int, int, int]:
    """Length, share of linked characters, closing punctuation, and kind of element, each in a few classes."""
    words, size = len(block.text.split()), max(1, len(block.text.replace(" ", "")))
    kinds = {"p": 0, "blockquote": 0, "pre": 0, "li": 2, "td": 2, "th": 2, "dd": 2, "dt": 2}
    kind = 1 if re.fullmatch("h[1-6]", block.tag) else kinds.get(block.tag, 3)
    return (sum(words >= k for k in (4, 10, 25, 60)), 2 if 2 * block.links > size else int(block.links > 0), int(block.text[-1] in ".!?…:;\"»”"), kind)


# What the classifier starts from, as counts of (content, boilerplate) for each class of each feature.
PRIOR = [[(2, 4), (3, 4), (4, 3), (5, 2), (6, 1)], [(6, 3), (4, 3), (1, 6)], [(3, 6), (6, 3)], [(6, 2), (4, 3), (2, 4), (3, 4)]]
LANDMARK, HINT, LIMIT = 5.0, 9.0, 4.0
SAME_PARENT, NEXT, SAME_GRAND = 1.5, 0.4, 0.8


def fit(pages: DataFrame) -> list[np.ndarray]:
    """Log odds of content for the classes of each feature, from pages that mark their content and boilerplate themselves.

    Blocks inside article or main elements are content, those inside navigation and the like
    boilerplate. NULL pages have no blocks; repeated pages count as often as they occur, pages of
    one page_id are chosen or left out together. Only counts of feature combinations (240 at most) leave the tasks. Without
    LEAST_BLOCKS blocks of either kind the start values decide.
    """
    chosen = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(MAX_TRAINING_PAGES)

    def count(batches):
        for batch in batches:
            rows = [(*features(b), int(b.hint == GOOD)) for page in batch.column(0).to_pylist() for b in blocks_of((page or b"").decode()) if b.hint]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32()) for i in range(5)], names=["a", "b", "c", "d", "content"])

    found = pages.join(F.broadcast(chosen), "page_id", "left_semi").select(utf8("html").alias("html")).mapInArrow(
        count, "a int, b int, c int, d int, content int").groupBy("a", "b", "c", "d", "content").count().collect()
    seen = [sum(r["count"] for r in found if r["content"] == c) for c in (0, 1)]
    counts = [np.array(p, np.float64) for p in PRIOR]
    for r in found if min(seen) >= LEAST_BLOCKS else []:
        for table, value in zip(counts, r[:4], strict=True):
            table[value, 1 - r["content"]] += r["count"]
    return [np.log(t[:, 0] / t[:, 0].sum()) - np.log(t[:, 1] / t[:, 1].sum()) for t in counts]


def max_flow_side(excess: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source side of a minimum cut.

    ``excess`` is a node's capacity from the source, or to the sink where negative; an edge
    has its capacity in both directions. Flow is pushed along shortest paths in phases.
    """
    n = len(excess)
    source, sink, out = n, n + 1, [[] for _ in range(n + 2)]
    to, room = [], []

    def link(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, e in enumerate(excess):
        if e:
            link(source, i, e, 0.0) if e > 0 else link(i, sink, -e, 0.0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        depth = [-1] * (n + 2)
        depth[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and depth[to[e]] < 0:
                    depth[to[e]] = depth[a] + 1
                    queue.append(to[e])
        if depth[sink] < 0:
            return [d >= 0 for d in depth[:n]]
        place, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if room[e] <= 1e-9 and not cut:
                        cut = k + 1
                a = to[path[cut - 1] ^ 1]
                del path[cut - 1:]
                continue
            while place[a] < len(out[a]) and not (room[out[a][place[a]]] > 1e-9 and depth[to[out[a][place[a]]]] == depth[a] + 1):
                place[a] += 1
            if place[a] < len(out[a]):
                path.append(out[a][place[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                a = to[path.pop() ^ 1]
                place[a] += 1


def labels_of(blocks: list[Block], odds: list[np.ndarray]) -> list[bool]:
    """Which blocks are content."""
    excess, edges, last, older = [], [], {}, {}
    for i, b in enumerate(blocks):
        cost = float(np.clip(sum(t[f] for t, f in zip(odds, features(b), strict=True)), -LIMIT, LIMIT))
        excess.append(cost + (LANDMARK if b.hint == GOOD else -HINT if b.hint else 0.0))
        if i:
            edges.append((i - 1, i, SAME_PARENT if b.parent == blocks[i - 1].parent else NEXT))
        if last.get(b.parent, i - 1) != i - 1:
            edges.append((last[b.parent], i, SAME_PARENT))
        if older.get(b.grand, i - 1) != i - 1:
            edges.append((older[b.grand], i, SAME_GRAND))
        last[b.parent] = older[b.grand] = i
    return max_flow_side(excess, edges)


def main_text(page: str, odds: list[np.ndarray]) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, content in zip(blocks, labels_of(blocks, odds), strict=True) if content)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row; an empty text where nothing is content.

    A NULL or empty page has an empty text, broken markup is read as far as it goes, rows given
    twice are extracted alike, other columns are not read.
    """
    odds = fit(pages)

    def run(batches):
        for batch in batches:
            texts = [main_text((page or b"").decode(), odds) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), utf8("html").alias("html")).mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
