"""Main-text extraction by tag-path ratios.

A page is read as a sequence of text blocks, each with its tag path from the
root.  Containers (div, section, td, ...) count by identity, the elements in
them (p, li, h2, ...) by kind, so the paragraphs of one container share a path
and those of the next one have another.  Per path, text length, punctuation and
text in links are summed and divided by its number of blocks; the ratios and the
spread of lengths are fused, and smoothed along the page with weights for how
much of their paths two blocks share.

What markup says is evidence that multiplies a path's score: ARTICLE each for
standing in an article and in a main element, OFF for elements whose kind, role or class
names a menu, header, footer, side bar, notice, advert, form or comments.  Words
of layout count only where the element holds no article and less than half of the
page's sentences.

Paths whose score reaches THRESHOLD of the page's spread are content.  From the
root, the article is the container in which DOMINANT of the content's score lies,
step by step, down to an article element or to content that stands in the
container itself; once something was left aside, SURE of it.  Within it everything above FLOOR is kept, short paragraphs
and headings too, but for containers without content that are made of links.

Nulls, ties and odd input: null or empty html gives an empty text; a null
page_id or url stays; unclosed elements, comments and tags end where a browser
would end them or at the end of the page; of equal containers the first is
taken; repeated rows give repeated results; further columns are not read; an
empty table gives an empty result.  Work is linear in the page's length.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

THRESHOLD = 0.5
REACH = 2  # blocks on either side that smoothing sees
ARTICLE, OFF = 1e3, 1e-10
FLOOR = 0.01
DOMINANT, SURE = 0.66, 0.95
#: A container without content is a menu if this much of its text is in links and its blocks are this short.
LINKS, SHORT = 0.8, 30

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|select|object|canvas|title|xmp)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<foreign>svg|annotation(?:-xml)?)\b[^>]*+(?<!/)>.*?(?:</(?P=foreign)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_TELLING = re.compile(r"class|role|hidden|style", re.I)
_PUNCT = re.compile(r"[.,;:!?…。、，；：！？]")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that count by identity in a path.
CONTAINER = frozenset("article aside blockquote body center details dialog dir div dl fieldset figure footer form header html main menu nav ol section table td th ul".split())
#: A start tag of the key ends open elements of the values, up to the nearest of SCOPE.
ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option", "p")}
SCOPE = frozenset("html body article section main div table ul ol dl nav aside footer header form".split())
CELLS = frozenset(("td", "th"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("blockquote dl figure ol table td th ul".split())
#: Of these, what pages are laid out with.
LAYOUT = frozenset("center table td".split())
#: Kinds of element, roles and words of a class that name what is not the article.
OFF_TAGS = frozenset("head nav footer aside menu dialog button label fieldset".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner sidebar aside side menu nav navbar "
    "navigation breadcrumb breadcrumbs masthead header footer foot cookie cookies consent notice notices notification notifications disclaimer alert popup modal "
    "overlay newsletter subscribe subscription signup signin login register search searchbox share sharing social related recommended recommendations "
    "trending comment comments commentlist reply replies respond disqus discussion widget toolbar pager pagination copyright legal skip hidden".split()
)
#: Of these, words of layout: they count only where the page's text does not speak against it.
LAYOUT_WORDS = frozenset(
    "banner sidebar aside side menu nav navbar masthead header footer foot register search searchbox share sharing social "
    "discussion widget toolbar pager pagination legal skip".split()
)
#: Words that a class adds to one of OFF_WORDS without changing what it names; any other word does (share-enabled, with-sidebar).
NEUTRAL = frozenset(
    "area bar block blocks body bottom box boxes btn button buttons container content desktop form global group holder home inner item items left link links list "
    "main mobile outer page panel post posts primary right row secondary section site slot small story thread title top unit units user wrap wrapper".split()
)
MAIN_TAGS = frozenset(("article", "main"))
#: An article of such a class is no article of its own.
PART_WORDS = OFF_WORDS - LAYOUT_WORDS | {"teaser", "teasers"}


class _Named:
    """An element that is named as something else than the article, the named
    element around it, whether only by layout, and what it holds."""

    __slots__ = ("around", "layout", "holds", "size", "off")

    def __init__(self, around: _Named | None, layout: bool):
        self.around, self.layout, self.holds, self.size, self.off = around, layout, False, 0, False


class _Box:
    """A container: the one around it, its tag, and what lies in it."""

    __slots__ = ("number", "tag", "around", "main", "mass", "own", "chars", "linked", "blocks", "content", "menu", "inside")

    def __init__(self, number: int, tag: str, around: _Box | None):
        self.number, self.tag, self.around = number, tag, around
        self.mass = self.own = 0.0  # content in it, and in it directly
        self.chars = self.linked = self.blocks = 0
        self.main = self.content = self.menu = self.inside = False


class _Node:
    """An open element, linked to nothing but what tells its blocks apart."""

    __slots__ = ("tag", "path", "box", "named", "article", "header", "link", "block", "scope", "cells")

    def __init__(self, tag: str, path: int, box: _Box):
        self.tag, self.path, self.box = tag, path, box
        self.named: _Named | None = None
        self.header = self.link = False
        self.article = 0  # 1: in an article, 2: in a main element, 3: in both
        self.block = self.scope = self.cells = 0  # stack places of the block around, and of the scopes for most tags and for cells


@dataclass
class Block:
    """A text block: path number, depth, and how much of its path it shares with the block before."""

    text: str
    path: int
    depth: int
    common: int
    box: _Box
    tag: str
    named: _Named | None
    article: int
    linked: int = 0


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    boxes: list[_Box] = field(default_factory=list)
    named: list[_Named] = field(default_factory=list)


def _names(attrs: str) -> tuple[set[str], str, bool]:
    """(words of OFF_WORDS that name the element, its role, whether it is hidden)."""
    words: set[str] = set()
    role, hidden = "", False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "class":
            for token in value.split():
                parts = [w.lower() for w in _PART.findall(token)]
                named = [w for w in parts if w in OFF_WORDS]
                if named and all(w in OFF_WORDS or w in NEUTRAL for w in parts):
                    words.update(named)
                words.update(w for w in parts if w == "teaser" or w == "teasers")
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden":
            hidden = value.lower() != "until-found"
        elif name == "aria-hidden":
            hidden = hidden or value.lower() == "true"
        elif name == "style":
            hidden = hidden or bool(_UNSEEN.search(value))
    return words, role, hidden


def _evidence(node: _Node, parent: _Node, tag: str, attrs: str, page: Page) -> None:
    """What kind, class and role of an element say."""
    node.named, node.article, node.header = parent.named, parent.article, parent.header
    node.link = parent.link or tag == "a"
    words, role, hidden = _names(attrs) if attrs and _TELLING.search(attrs) else (set(), "", False)
    main = tag in MAIN_TAGS or role == "main"
    strong = weak = False
    if tag == "header":
        node.header = parent.article
        strong = not parent.article
    elif tag == "form":
        weak = True
    elif tag in OFF_TAGS:
        strong = True
    if hidden:
        strong = True
    if tag not in ("html", "body"):
        strong = strong or role in OFF_ROLES
        if main:
            strong = strong or bool(words & PART_WORDS)
        else:
            words -= {"teaser", "teasers"}
            if tag in HEADINGS:
                words.discard("header")
            strong = strong or bool(words - LAYOUT_WORDS)
            weak = weak or bool(words)
    if strong or weak:
        node.named = _Named(parent.named, not strong)
        page.named.append(node.named)
    if main and not strong:
        node.article |= 1 if tag == "article" else 2
        node.box.main = node.box is not parent.box
        x = parent.named
        while x is not None and not x.holds:
            x.holds = True
            x = x.around


def read(source: str) -> Page:
    """The page's text blocks in order, its containers and its named elements."""
    page = Page()
    first = _Box(0, "", None)
    page.boxes.append(first)
    root = _Node("", 0, first)
    stack = [root]
    paths: dict[tuple[int, str, _Named | None], int] = {}
    last_path = 0
    at_tag: dict[str, list[int]] = {}  # places in the stack, by tag
    pieces: list[tuple[str, _Node]] = []
    low = depth = 0  # least depth since the last block, and its depth
    at = 0

    def path_of(around: int, tag: str, named: _Named | None) -> int:
        """The path of an element that is no container: one for all of a kind, but for those that are named."""
        nonlocal last_path
        key = (around, tag, named)
        if key not in paths:
            last_path += 1
            paths[key] = last_path
        return paths[key]

    def flush() -> None:
        nonlocal low, depth
        if not pieces:
            return
        held = list(pieces)
        pieces.clear()
        home = stack[stack[-1].block]
        # text of inline elements belongs to the block around them, unless they are named apart
        groups: dict[_Named | None, list[tuple[str, _Node]]] = {}
        for piece in held:
            groups.setdefault(piece[1].named, []).append(piece)
        for named, group in groups.items():
            joined = "".join(t for t, _ in group)
            words = (html.unescape(joined) if "&" in joined else joined).split()
            if not words:
                continue
            if home.header and home.tag not in HEADINGS:
                continue  # an article's own header: its headings only
            text = " ".join(words)
            total = sum(len(t) for t, _ in group)
            linked = sum(len(t) for t, n in group if n.link)
            here = stack[-1].block
            path = home.path if named is home.named else path_of(home.path, "", named)
            page.blocks.append(Block(text, path, here, min(low, depth, here), home.box, home.tag, named, home.article, len(text) * linked // max(1, total)))
            low = depth = here
        low = min(low, len(stack) - 1)

    def close(k: int) -> None:
        nonlocal low
        for node in stack[k:]:
            at_tag[node.tag].pop()
        del stack[k:]
        low = min(low, k - 1)

    for m in _TOKEN.finditer(source):
        if m.start() > at:
            pieces.append((source[at : m.start()], stack[-1]))
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            if tag in BLOCK:
                flush()
            places = at_tag.get(tag)
            if places and (tag in BLOCK or places[-1] > stack[-1].block):  # a stray inline end tag closes no block
                close(places[-1])
            continue
        if tag == "br":
            pieces.append((" ", stack[-1]))
            continue
        if tag in BLOCK:
            flush()
            if tag not in ("html", "body"):
                bound = stack[-1].cells if tag in CELLS or tag == "tr" else stack[-1].scope
                ended = [p[-1] for t in ENDS.get(tag, ("p",)) if (p := at_tag.get(t)) and p[-1] > bound]
                if ended:
                    close(min(ended))
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        parent = stack[-1]
        if tag in CONTAINER:
            last_path += 1
            box = _Box(len(page.boxes), tag, parent.box)
            page.boxes.append(box)
            node = _Node(tag, last_path, box)
        else:
            node = _Node(tag, parent.path, parent.box)
        _evidence(node, parent, tag, attrs, page)
        if tag in BLOCK and tag not in CONTAINER:
            node.path = path_of(parent.path, tag, node.named)
        k = len(stack)
        node.block = k if tag in BLOCK else parent.block
        node.cells = k if tag in SCOPE else parent.cells
        node.scope = k if tag in SCOPE or tag in CELLS else parent.scope
        at_tag.setdefault(tag, []).append(k)
        stack.append(node)
    if at < len(source):
        pieces.append((source[at:], stack[-1]))
    flush()
    _settle(page)
    return page


def _settle(page: Page) -> None:
    """Named elements are off; those named by layout are not if they hold an
    article or, on a page without one beside them, most of the sentences."""

    def sentences(b: Block) -> int:
        return len(b.text) if _PUNCT.search(b.text) else 0

    for x in page.named:  # made after those around them
        x.off = not x.layout or x.around is not None and x.around.off
    total, article = 0, False
    for b in page.blocks:
        if b.named is None or not b.named.off:
            total += sentences(b)
            article = article or bool(b.article) and b.named is None
            if b.named is not None:
                b.named.size += sentences(b)
    for x in reversed(page.named):
        if x.around is not None:
            x.around.size += x.size
    for x in page.named:
        x.off = x.off or x.around is not None and x.around.off or not x.holds and (article or 2 * x.size <= total)


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """Score of every path: ratios fused, smoothed along the page, times the evidence."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0, 0.0])
        n = len(b.text)
        s[0] += 1
        s[1] += n
        s[2] += len(_PUNCT.findall(b.text))
        s[3] += n * n
        s[4] += b.linked
    fused = {}
    for path, (k, n, p, q, a) in sums.items():
        spread = math.sqrt(max(0.0, q / k - (n / k) ** 2))
        fused[path] = (n / k) * (1.0 + p / k) * (1.0 + spread / (1.0 + n / k)) * (1.0 - 0.9 * a / n)
    smooth: dict[int, list[float]] = {}
    for i, b in enumerate(blocks):
        total, weight = fused[b.path], 1.0
        for way in (-1, 1):
            common = b.depth
            for d in range(1, REACH + 1):
                j = i + way * d
                if not 0 <= j < len(blocks):
                    break
                common = min(common, blocks[j + 1 if way < 0 else j].common)
                other = blocks[j]
                w = math.exp(-d * d / 2.0) * ((2.0 * common / (b.depth + other.depth)) if b.depth + other.depth else 1.0)
                total += w * fused[other.path]
                weight += w
        evidence = ARTICLE ** b.article.bit_count() * (OFF if b.named is not None and b.named.off else 1.0)
        s = smooth.setdefault(b.path, [0.0, 0.0])
        s[0] += total / weight * evidence
        s[1] += 1
    return {path: a / k for path, (a, k) in smooth.items()}


def threshold(scores: dict[int, float]) -> float:
    values = list(scores.values())
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return max(FLOOR, min(THRESHOLD * spread, max(values)))


def _weigh(page: Page, scores: dict[int, float], content: set[int]) -> None:
    """Sums the blocks into their containers, content by its scores."""
    for b in page.blocks:
        box, n = b.box, len(b.text)
        box.chars += n
        box.linked += b.linked
        box.blocks += 1
        if b.path in content:
            box.own += scores[b.path]
            box.content = True
    for box in page.boxes:
        box.mass = box.own
    for box in reversed(page.boxes):  # made after those around them
        up = box.around
        if up is not None:
            up.mass += box.mass
            up.chars += box.chars
            up.linked += box.linked
            up.blocks += box.blocks
            up.content = up.content or box.content
        box.menu = not box.content and box.chars > 0 and box.linked >= LINKS * box.chars and box.chars < SHORT * box.blocks


def _region(page: Page) -> _Box:
    """The container of the article."""
    best: dict[int, _Box] = {}  # heaviest container in each container
    for box in page.boxes:
        if box.around is not None and (box.around.number not in best or box.mass > best[box.around.number].mass):
            best[box.around.number] = box
    here, need = page.boxes[0], DOMINANT
    while (inner := best.get(here.number)) is not None and (inner.main or not here.main):
        top = here.tag in ("", "html", "body")
        if inner.mass < (SURE if inner.tag == "section" else need) * here.mass or here.own > (1 - need) * here.mass * top:
            break
        if inner.tag in LISTS and not (inner.tag in LAYOUT and (top or here.tag in LAYOUT)):
            break
        if inner.mass < here.mass:
            need = SURE
        here = inner
    return here


def select(page: Page, scores: dict[int, float]) -> list[str]:
    """The article's blocks by the scores of their paths."""
    if not scores or max(scores.values()) < FLOOR:
        return []
    cut = threshold(scores)
    content = {path for path, v in scores.items() if v >= cut}
    _weigh(page, scores, content)
    region = _region(page)
    for box in page.boxes:
        box.inside = box is region or box.around is not None and box.around.inside and not box.menu
    over, up = set(), region.around
    while up is not None and up.tag not in ("", "html", "body"):
        over.add(up.number)
        up = up.around
    kept = []
    for b in page.blocks:
        title = not kept and b.tag == "h1" and b.box.number in over  # stands above the article
        if (b.box.inside or title) and scores[b.path] >= FLOOR:
            kept.append(b)
    if region.tag in ("", "html", "body"):
        # no container of its own: content, headings, and lists and the like between content
        at = [i for i, b in enumerate(kept) if b.path in content]
        kept = [
            b for i, b in enumerate(kept)
            if b.path in content or b.tag in HEADINGS or at[0] < i < at[-1] and b.box.around is region and b.box.tag in LISTS and 2 * b.linked < len(b.text)
        ]
    return [b.text for b in kept]


def main_text(source: str | None) -> str:
    """The article's blocks joined by blank lines."""
    page = read(source or "")
    return "\n\n".join(select(page, path_scores(page.blocks)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row; no shuffle."""

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
