"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks (runs of text no block element interrupts).  A logistic classifier gives each the log-odds of being content.  It sees the block's text (length, links,
sentences, words of notices, whether it is short and stands among links) and its marks: what its element is, and whether class, id and role values on the way to it name furniture or content; all with
weights that are learned.  The log-odds, text and marks each within bounds, are the capacities to the two terminals.  Neighbouring blocks, and the next blocks under the same parent, are
joined by smoothness edges that weaken with their distance in the DOM, and further across the border of page furniture; items of one list or table hold together more.  The cut of least
capacity labels the blocks: a short line, or one that is all link, stays where its neighbours are the article.  What stays on the content side, in page order, is the text.

The classifier is fitted to the pages at hand by weak labels: of :data:`FIT_PAGES` pages drawn by a hash of their ids (those of at most :data:`FIT_BYTES` bytes), up to :data:`FIT_BLOCKS`
blocks each, those in an article or main element are examples of content, those in navigation, footers and the like are not.  Every example counts twice, with its marks and with none, so
texts are learned to be told where pages do not mark them.  The fit is drawn towards :data:`PRIOR`, which is the classifier where there are no examples of both kinds.

A block whose terminal outweighs all its edges is on that side of some minimum cut, so it is settled first and its edges become its
neighbours' terminal capacity; max-flow (shortest augmenting paths) runs on what is left.  Both steps are exact.

Defined results: null or empty html gives the empty text.  Malformed markup is read leniently, as browsers do: unclosed and
misnested elements, missing ends, stray angle brackets (kept as text), unterminated scripts (run to the page's end).  A tag with an unclosed quote
ends at its first angle bracket.  Reading takes time in proportion to the page, however its markup is broken.  Any white space,
no-break spaces included, counts as white space.  Repeated rows are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg select option button canvas audio video xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "head"}
#: Elements that end an open one of the same group.
ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}

# Parts of class, id and role values that tell what reads like prose but is none of the article; that
# often name page furniture; that often name the article; that only say that the part before them is boxed.
STRONG = frozenset(
    "ad ads advert advertisement adverts adsense banner captcha comment comments commentlist consent cookie cookies copyright disqus footer gdpr login masthead "
    "modal nav navbar navigation newsletter pagination pager paywall popup promo promoted promotion reply replies respond sidebar signup sponsor sponsored subscribe subscription contentinfo".split()
)
MILD = frozenset(
    "billboard breadcrumb breadcrumbs byline complementary dialog disclaimer feedback header menu meta notice notification privacy rail recommended related rss search share sharing skip "
    "social tags teaser toc toolbar topbar trending warning widget widgets".split()
)
CONTENT = frozenset("article articlebody body content entry main maincontent page post story text".split())
BOXED = frozenset("area bar block body bottom box button col column container content form frame group holder inner item items left link links list main message right row section slot text thread top unit wrap wrapper zone".split())
#: Elements that hold furniture wherever they stand.
FURNITURE = frozenset("nav footer aside form dialog menu search fieldset".split())
# Words of notices, and what ends a sentence.
NOTICE = frozenset("advertisement consent cookie cookies copyright disclaimer login newsletter password privacy reserved signup sponsored subscribe subscribed subscriber subscribers terms unsubscribe".split())
ENDS = ".!?:;\"”»)…"

#: What the classifier sees of a block, its weights before it has seen pages, and where the marks begin.
FEATURES = (
    "constant", "log words", "linked share", "ends a sentence", "notice words", "short among links",
    "strong name", "named after", "mild name", "content name", "furniture element", "page header", "in article", "in main", "beside the article", "p", "heading", "item",
)
PRIOR = (-1.7, 0.9, -4.5, 0.8, -5.0, -0.8, -8.0, -0.8, -2.5, 1.0, -7.0, -4.0, 3.0, 2.0, -3.5, 0.4, 0.8, 0.2)
MARKS = 6
#: Bounds of what a block's text adds, and its marks.
TEXT_BOUND, MARK_BOUND = (-2.5, 4.0), (-9.0, 9.0)
#: Examples that one of the prior's weights counts for.
BELIEF = 100.0
FIT_PAGES, FIT_BYTES, FIT_BLOCKS = 256, 1 << 18, 64
SMOOTH, FAR, BORDER, TOGETHER = 1.0, 0.35, 0.1, 1.5

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]*[a-z]+|[A-Z]+|\d+")
#: Failed searches for the end of a tag that heeds quotes, of a page.
FAILURES = 8


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    depth: int
    serial: int
    strong: float = 0.0
    after: float = 0.0
    mild: float = 0.0
    pro: float = 0.0
    apart: float = 0.0  # a furniture element is on the way
    header: float = 0.0
    furniture: bool = False
    container: str = ""  # the article or main element it is in


@dataclass(slots=True)
class Block:
    element: Element
    text: str
    linked: int
    score: float = 0.0
    edges: dict[int, float] = field(default_factory=dict)


def _named(attributes: str) -> tuple[float, float, float, float]:
    """What the class, id and role values of an element say: (strong, named after, mild, content), 0 or 1 each, doubtful ones a half.

    The last part of a name tells what it is, if it does not just say that the first is boxed: a comment-list is one of comments, a reply-letter a letter.
    """
    strong = after = mild = pro = 0.0
    for m in _NAME.finditer(attributes):
        for value in (m[1] or m[2] or m[3] or "").split():
            parts = [x.lower() for x in _PART.findall(value)]
            if not parts:
                continue
            first, last = parts[0], parts[-1]
            if first in CONTENT or last in CONTENT:
                pro = 1.0
            boxed = len(parts) == 1 or last in BOXED or last in STRONG or last in MILD or last.isdigit() or len(last) < 3
            if len(parts) > 1 and last in CONTENT and last not in BOXED:  # a widget-post is a post
                continue
            if last in STRONG or (first in STRONG and boxed):
                strong = 1.0
            elif first in STRONG:
                after = 1.0
            elif last in MILD or first in MILD:
                mild = max(mild, 1.0 if last in MILD or boxed else 0.5)
    if pro:
        mild /= 2  # names that speak for both sides
    return strong, after, mild, pro


def _open(tag: str, attributes: str, parent: Element | None, serial: int) -> Element:
    e = Element(tag, parent, parent.depth + 1 if parent else 0, serial)
    if parent:
        e.strong, e.after, e.mild, e.pro, e.apart, e.header = parent.strong, parent.after, parent.mild, parent.pro, parent.apart, parent.header
        e.furniture, e.container = parent.furniture, parent.container
    strong, after, mild, pro = _named(attributes) if "=" in attributes and tag not in ("html", "body") else (0.0,) * 4
    if e.container:
        mild /= 2  # within the article, doubtful names say less
    e.strong, e.after, e.mild, e.pro = max(e.strong, strong), max(e.after, after), min(2.0, e.mild + mild), max(e.pro, pro)
    apart = tag in FURNITURE
    header = tag == "header" and not e.container
    e.apart, e.header = max(e.apart, float(apart)), max(e.header, float(header))
    if tag in ("article", "main") and not strong and not e.furniture:
        e.container = tag
    e.furniture |= bool(strong or apart or header)
    return e


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in page order, with the element each stands in."""
    root = Element("#page", None, 0, 0)
    stack = [root]
    at_of: dict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of each tag are
    in_blocks = [0]  # where in the stack the block elements are
    out: list[Block] = []
    texts: list[str] = []
    linked = serial = 0
    in_link = head = False
    endless: set[str] = set()
    failures = 0
    last_end = page.rfind(">")

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                e = stack[in_blocks[-1]]
                if stack[-1].furniture and not e.furniture:
                    e = stack[-1]
                out.append(Block(e, text, min(linked, len(text))))
            texts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if head and not raw.strip():
            return
        text = html.unescape(raw) if "&" in raw else raw
        texts.append(text)
        if in_link:
            linked += len(text.strip())

    def close(to: int) -> None:
        for e in reversed(stack[to:]):
            at_of[e.tag].pop()
            if e.tag in BLOCK:
                in_blocks.pop()
        del stack[to:]

    def innermost(*tags: str) -> int:
        return max((at_of[t][-1] for t in tags if at_of[t]), default=0)

    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        if begin > at:
            add(page[at:begin])
        at = begin
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), at) and at < last_end:
            at = page.find(">", at) + 1
            continue
        m = _TAG.match(page, at) if at < last_end else None
        if m is None:
            add("<")
            at += 1
            continue
        whole = _ATTRIBUTES.match(page, m.end()) if failures < FAILURES else None
        if whole is None:
            failures += 1
            stop = page.find(">", m.end())
            attributes, at = page[m.end() : stop], stop + 1
        else:
            attributes, at = whole[1], whole.end()
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag == "a":
                in_link = False
            if tag in ("p", "br"):
                flush() if tag == "p" else texts.append(" ")
            if not at_of[tag]:
                continue
            hit = at_of[tag][-1]
            if tag not in BLOCK and in_blocks[-1] > hit:
                continue  # a formatting element does not close the blocks within it
            if tag in BLOCK:
                flush()
            close(hit)
            if tag == "head":
                head = False
            continue
        if tag in RAW:
            if attributes.rstrip().endswith("/") and tag in ("svg", "iframe", "canvas"):
                continue
            texts.append(" ")
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end is None:
                endless.add(tag)
                if tag in ("option", "button", "select", "template"):
                    continue
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "input"):
                texts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                hit = innermost("p", "td", "th", "li", "div", "article", "section", "body")
                if hit and stack[hit].tag == "p":
                    close(hit)
            if tag in ALIKE:
                hit = innermost(*ALIKE[tag], "ul", "ol", "dl", "table", "menu")
                if hit and stack[hit].tag in ALIKE[tag]:
                    close(hit)
            if tag == "head":
                head = True
            if tag == "body":
                head = False
        elif tag == "a":
            in_link = True
        serial += 1
        at_of[tag].append(len(stack))
        if tag in BLOCK:
            in_blocks.append(len(stack))
        stack.append(_open(tag, attributes, stack[-1], serial))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """What the classifier sees of the blocks of a page, a row each (see :data:`FEATURES`)."""
    plain = [0 if b.element.furniture else len(b.text) - b.linked for b in found]
    inside = sum(n for n, b in zip(plain, found, strict=True) if b.element.container)
    apart = bool(inside) and 2 * inside >= sum(plain)  # an article or main element holds most of the page's plain text
    share = [b.linked / len(b.text) for b in found]
    rows = []
    for i, b in enumerate(found):
        e, words = b.element, b.text.count(" ") + 1
        notice = 0.0
        if words <= 60 or "©" in b.text[:80]:
            said = sum(w.strip(".,;:!?()\"'").lower() in NOTICE for w in b.text.split()[:60]) + b.text.startswith("©")
            notice = min(1.0, 10.0 * said / words)
        around = [share[j] for j in (i - 1, i + 1) if 0 <= j < len(found)]
        rows.append((
            1.0, np.log1p(words), share[i], float(b.text[-1] in ENDS or ". " in b.text), notice, sum(around) / max(1, len(around)) * max(0.0, 1 - words / 16),
            e.strong, e.after, e.mild, e.pro, e.apart, e.header, float(e.container == "article"), float(e.container == "main"), float(apart and not e.container),
            float(e.tag == "p"), float(e.tag in ("h1", "h2", "h3", "h4")), float(e.tag in ("li", "td", "th", "dd", "dt")),
        ))
    return np.array(rows).reshape(len(rows), len(FEATURES))


def scores(found: list[Block], weights: tuple[float, ...] = PRIOR) -> list[float]:
    """Log-odds of all blocks of a page."""
    x, w = features(found), np.array(weights)
    text = np.clip(x[:, :MARKS] @ w[:MARKS], *TEXT_BOUND)
    return (text + np.clip(x[:, MARKS:] @ w[MARKS:], *MARK_BOUND)).tolist()


Examples = list[tuple[np.ndarray, bool]]


def examples(page: str, most: int = FIT_BLOCKS) -> Examples:
    """Features and weak label of up to ``most`` blocks of a page, evenly spread, with their marks and without: elements and containers tell what is content."""
    found = blocks(page)
    told = [(x, not b.element.furniture) for b, x in zip(found, features(found), strict=True) if b.element.furniture or b.element.container]
    told = told[:: max(1, -(-len(told) // most))]
    bare = np.arange(len(FEATURES)) < MARKS
    return told + [(np.where(bare, x, 0.0), y) for x, y in told]


def fit(seen: Examples) -> tuple[float, ...]:
    """Weights of a logistic classifier, drawn towards the prior; both kinds count alike, and of each kind mostly linked blocks and plain ones."""
    prior = np.array(PRIOR)
    y = np.array([label for _, label in seen], float)
    if not len(y) or y.min() == y.max():
        return PRIOR
    x = np.array([f for f, _ in seen])
    strata = 2 * (y > 0) + (x[:, 2] > 0.5)
    counts = np.bincount(strata, minlength=4)
    kinds = np.maximum(1, [(counts[0] > 0) + (counts[1] > 0), 0, (counts[2] > 0) + (counts[3] > 0)])
    each = 0.5 * len(y) / (kinds[2 * (y > 0)] * counts[strata])
    w = prior.copy()
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (p - y)) + BELIEF * (w - prior)
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + BELIEF * np.eye(len(w)), slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.round(6).tolist())


def _steps(a: Element, b: Element) -> int:
    """Edges between two elements in the DOM."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


ITEMS = ("li", "td", "th", "dd", "dt")


def _whole(e: Element) -> Element | None:
    """The list or table an element is part of."""
    while e and e.tag not in ("ul", "ol", "dl", "table", "menu"):
        e = e.parent
    return e


def connect(found: list[Block]) -> None:
    """Smoothness edges: page neighbours, and the next block under the same parent; weaker between furniture and the rest."""
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        parent = b.element.parent.serial if b.element.parent else -1
        for j, weight in ((i - 1, SMOOTH), (last.get(parent, -1), FAR)):
            if j >= 0:
                w = weight / max(1, _steps(found[j].element, b.element) - 1)
                if b.element.tag in ITEMS and found[j].element.tag in ITEMS and _whole(found[j].element) is _whole(b.element):
                    w = max(w, TOGETHER / 2)
                if found[j].element.furniture != b.element.furniture or found[j].element.container != b.element.container:
                    w *= BORDER
                b.edges[j] = b.edges.get(j, 0.0) + w
                found[j].edges[i] = found[j].edges.get(i, 0.0) + w
        last[parent] = i


def cut(scores: list[float], edges: list[dict[int, float]]) -> list[bool]:
    """Labels (True: content side) of a minimum cut, ties to the content side."""
    n = len(scores)
    score = list(scores)
    label: list[bool | None] = [None] * n
    edges = [dict(e) for e in edges]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(score[i]) >= sum(edges[i].values()):
            label[i] = score[i] >= 0
            for j, w in edges[i].items():
                del edges[j][i]
                score[j] += w if label[i] else -w
                queue.append(j)
            edges[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = max_flow({i: score[i] for i in rest}, {i: edges[i] for i in rest})
        for i in rest:
            label[i] = i not in side
    return [bool(x) for x in label]


def max_flow(score: dict[int, float], edges: dict[int, dict[int, float]]) -> set[int]:
    """Nodes on the sink side of the cut that leaves most nodes at the source; positive scores are capacities from it, negative ones to the sink.

    Flow is sent along shortest residual paths, from one node with capacity left from the source after another: once a node has no path to the sink, no
    flow from other nodes gives it one.
    """
    tiny = 1e-9
    cap = {i: dict(e) for i, e in edges.items()}
    out = {i: max(0.0, -s) for i, s in score.items()}
    dead: set[int] = set()  # without a path to the sink
    for start, s in score.items():
        left = s
        while left > tiny and start not in dead:
            came, queue, end = {start: start}, deque([start]), None
            while queue:
                a = queue.popleft()
                if out[a] > tiny:
                    end = a
                    break
                for b, c in cap[a].items():
                    if c > tiny and b not in came and b not in dead:
                        came[b] = a
                        queue.append(b)
            if end is None:
                dead.update(came)
                break
            path, b = [], end
            while b != start:
                path.append((came[b], b))
                b = came[b]
            flow = min([left, out[end], *(cap[a][b] for a, b in path)])
            left -= flow
            out[end] -= flow
            for a, b in path:
                cap[a][b] -= flow
                cap[b][a] = cap[b].get(a, 0.0) + flow
    # what can still reach the sink is on its side; all else is content
    side = {i for i, c in out.items() if c > tiny}
    queue = deque(side)
    into: dict[int, list[int]] = {}
    for a, to in cap.items():
        for b, c in to.items():
            if c > tiny:
                into.setdefault(b, []).append(a)
    while queue:
        for a in into.get(queue.popleft(), ()):
            if a not in side:
                side.add(a)
                queue.append(a)
    return side


def label(page: str, weights: tuple[float, ...] = PRIOR) -> tuple[list[Block], list[float], list[bool]]:
    """The blocks of a page, their log-odds and their labels by the minimum cut."""
    found = blocks(page)
    connect(found)
    costs = scores(found, weights)
    return found, costs, cut(costs, [b.edges for b in found])


def extract(page: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    """The main text of a page: its content blocks, joined by blank lines."""
    if not page:
        return ""
    found, _, labels = label(page, weights)
    return "\n\n".join(b.text for b, keep in zip(found, labels, strict=True) if keep)


def fit_to(pages: DataFrame) -> tuple[float, ...]:
    """The classifier fitted to a bounded sample of ``pages`` (columns page_id, html): ids are drawn by their hashes, so the order of files is all one."""
    ids = [r[0] for r in pages.where("page_id IS NOT NULL").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(FIT_PAGES).collect()]
    drawn = pages.where(F.col("page_id").isin(ids) & (F.octet_length("html") <= FIT_BYTES)).select("page_id", "html")
    sample = drawn.orderBy("page_id", "html").limit(FIT_PAGES).collect() if ids else []
    return fit([x for row in sample for x in examples(row["html"])])


def op9_html_mincut(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    weights = fit_to(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [extract(x.as_py(), weights) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
