"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices

#: Width of the smoothing window over neighbouring leaves, in leaves to either side.
SMOOTH = 2
#: Mean length and mean punctuation beyond which a path is no more like content than another.
FULL_LENGTH, FULL_MARKS = 400.0, 8.0
#: Seeds are paths of at least SEED of the page's best ratio; KEEP is the share that a path needs inside the seeds'
#: common element, STAND the one it needs outside of it, and FLOOR what any path needs.
SEED, KEEP, STAND, FLOOR = 0.25, 0.004, 0.75, 0.02
#: Share of the seeds' text that their common element holds.
COVER = 0.9
#: Factors of a path's ratio: elements and names that are not the article's (no ratio makes up for FOREIGN: 180 times it is
#: under FLOOR), those that may be, link text, and marked articles.
FOREIGN, DOUBTFUL, LINKED, MARKED = 0.0001, 0.2, 0.05, 2.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[\s ]+")
#: Marks that end something: a full stop inside a number or a host name is none.
_PUNCTUATION = re.compile(r"[.,;:!?](?=[\s\"')\]»”]|\Z)|[…。，、！？¿¡]")

_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr",
}
#: Elements whose content is no text of the page: what they hold is not read.
_UNREAD = {"head", "button", "select", "option", "datalist", "audio", "video", "input"} | _RAW
_FOREIGN = {"nav", "footer", "aside", "form", "dialog", "menu", "fieldset"}
#: Elements that end when one of the given kinds begins.
_P_ENDERS = {
    "p", "div", "article", "section", "nav", "footer", "header", "aside", "main", "ul", "ol", "dl", "table", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "blockquote", "pre", "hr", "figure", "figcaption", "address", "details", "fieldset", "menu",
}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "main", "body", "html", "nav", "aside", "footer", "header", "form", "td", "th"}
_NAMES = {
    FOREIGN: re.compile(
        r"(?:^|[-_\s])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|side-?bar\w*|footer|masthead|comment\w*|replies|disqus|cookie\w*|consent|gdpr|"
        r"notice\w*|alert|popup|modal|overlay|newsletter|subscribe|signup|sign-up|login|share|sharing|social|toolbar|pagination|pager|skip-?link|outbrain|taboola)(?:$|[-_\s\d])",
        re.I,
    ),
    DOUBTFUL: re.compile(
        r"(?:^|[-_\s])(?:header|reply|discussion|related|recommend\w*|widget\w*|tags?|tag-?cloud|copyright|legal|disclaimer|search\w*|form|trending|popular|byline-links)(?:$|[-_\s\d])", re.I
    ),
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar", "note"}


@dataclass
class Leaf:
    """One stretch of text: its root-to-leaf path, block, element and what part of it is link text."""

    path: str
    text: str
    block: int
    element: int
    linked: bool


@dataclass
class Page:
    """leaves: in page order; prior: the factor of each path; parents, names: of each element, the root being 0."""

    leaves: list[Leaf]
    prior: dict[str, float]
    parents: list[int]
    names: list[str]


@dataclass
class _Open:
    name: str
    path: str
    number: int
    prior: float
    article: bool
    linked: bool


def _prior(name: str, attributes: str, inside: bool) -> float | None:
    """The factor that an element's name, role and names in class and id give to the ratio of paths below; None: hidden."""
    factor = FOREIGN if name in _FOREIGN else DOUBTFUL if name == "header" and not inside else 1.0
    if not attributes or name in ("html", "body"):
        return factor
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return None
        if key == "role" and value.lower() in _ROLES:
            factor = min(factor, FOREIGN)
        if key in ("class", "id") and name not in ("article", "main"):
            factor = min([factor, *(f for f, names in _NAMES.items() if names.search(value))])
    return factor


def parse(page: str) -> Page:
    """Texts of a page by path, in page order. Unclosed elements end as the HTML standard's parsers end them."""
    stack = [_Open("", "", 0, 1.0, False, False)]
    out = Page([], {}, [0], [""])
    block, at, size = 0, 0, len(page)

    def put(piece: str) -> None:
        top, text = stack[-1], html.unescape(piece)
        # White space alone counts only between two texts of one block.
        if text and (not text.isspace() or out.leaves and out.leaves[-1].block == block):
            out.leaves.append(Leaf(top.path, text, block, top.number, top.linked))
            out.prior[top.path] = top.prior

    def end(kinds: set[str], scopes: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in kinds:
                del stack[k:]
                return
            if stack[k].name in scopes:
                return

    def skip(name: str) -> int:
        stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
        return stop.end() if stop else size

    hidden = 0  # depth of the stack below which nothing is shown
    while at < size:
        open_at = page.find("<", at)
        if open_at < 0:
            hidden or put(page[at:])
            break
        m = _TOKEN.match(page, open_at)
        if not m:
            hidden or put(page[at : open_at + 1])
            at = open_at + 1
            continue
        if open_at > at and not hidden:
            put(page[at:open_at])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name not in _INLINE:
            block += 1
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if name in _INLINE and stack[k].name not in _INLINE:
                    break
            hidden = hidden if len(stack) > hidden else 0
            continue
        if name in _VOID:
            continue
        if name in _P_ENDERS:
            end({"p"}, _SCOPES)
        if name in _CLOSES:
            end(_CLOSES[name], _SCOPES - {"td", "th"} if name == "tr" else _SCOPES)
        hidden = hidden if len(stack) > hidden else 0
        if name in _RAW:
            at = skip(name)
            continue
        top = stack[-1]
        factor = None if name in _UNREAD else _prior(name, m[3], top.article)
        if factor is None and not hidden:
            hidden = len(stack)
        if name in _INLINE and (factor is None or factor == 1.0):
            # Inline elements don't lengthen a path: the block that holds a text decides what the text is.
            stack.append(_Open(name, top.path, top.number, top.prior, top.article, top.linked or name == "a"))
            continue
        factor = 1.0 if factor is None else factor
        # Elements of one name but of other standing are other paths.
        path = f"{top.path}/{name}" + {FOREIGN: "!", DOUBTFUL: "?"}.get(factor, "")
        marked = name in ("article", "main") and not top.article
        out.parents.append(top.number)
        out.names.append(name)
        stack.append(_Open(name, path, len(out.parents) - 1, top.prior * factor * (MARKED if marked else 1.0), top.article or marked, top.linked or name == "a"))
    return out


def path_ratios(page: Page, priors: bool = True) -> dict[str, float]:
    """The fused ratio of each path.

    The text length and the punctuation of all leaves below a path are aggregated to its ratios per block. Along the page
    each leaf's ratios are smoothed with its neighbours', the more the longer the head that their paths share. The fused
    ratio is the root of the length times one and the punctuation, averaged over the path, times the path's prior and
    what of its text is no link.
    """
    nodes = page.leaves
    paths = {p: k for k, p in enumerate(dict.fromkeys(x.path for x in nodes))}
    of = np.fromiter((paths[x.path] for x in nodes), np.int64, len(nodes))
    length = np.fromiter((len(x.text.strip()) for x in nodes), np.float64, len(nodes))
    marks = np.fromiter((len(_PUNCTUATION.findall(x.text)) for x in nodes), np.float64, len(nodes))
    linked = np.fromiter((x.linked for x in nodes), np.float64, len(nodes))
    blocks = np.zeros(len(paths))
    np.add.at(blocks, of[np.flatnonzero(np.diff([x.block for x in nodes], prepend=-1))], 1)
    total = np.bincount(of, length, len(paths))
    blocks = np.maximum(blocks, 1)
    long = np.minimum(total / blocks, FULL_LENGTH)[of]
    pointed = np.minimum(np.bincount(of, marks, len(paths)) / blocks, FULL_MARKS)[of]
    parts = [p.split("/") for p in paths]
    kinship: dict[tuple[int, int], float] = {}

    def kin(a: int, b: int) -> float:
        key = (a, b) if a < b else (b, a)
        if key not in kinship:
            x, y = parts[a], parts[b]
            shared = next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
            kinship[key] = 0.25 ** (len(x) + len(y) - 2 * shared)
        return kinship[key]

    weight, near_long, near_pointed = np.ones(len(nodes)), long.copy(), pointed.copy()
    order = of.tolist()
    for step in range(1, SMOOTH + 1):
        w = np.fromiter((kin(a, b) for a, b in zip(order, order[step:])), np.float64, max(0, len(nodes) - step))
        for here, there in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
            weight[here] += w
            near_long[here] += w * long[there]
            near_pointed[here] += w * pointed[there]
    fused = np.sqrt(near_long / weight) * (1 + near_pointed / weight)
    ratio = np.bincount(of, fused, len(paths)) / np.bincount(of, minlength=len(paths))
    free = 1 - np.bincount(of, linked * length, len(paths)) / np.maximum(total, 1)
    ratio *= LINKED + (1 - LINKED) * free
    if priors:
        ratio *= [page.prior[p] for p in paths]
    return {p: float(ratio[k]) for p, k in paths.items()}


def content_element(page: Page, seeds: set[str]) -> int:
    """The innermost element that holds COVER of the seeds' text and does not itself stand around bare text."""
    weight = np.zeros(len(page.parents))
    bare = set()
    for x in page.leaves:
        if x.path in seeds:
            weight[x.element] += len(x.text)
            bare.add(x.element)
    for k in range(len(weight) - 1, 0, -1):
        weight[page.parents[k]] += weight[k]
    at, need = 0, COVER * weight[0]
    for k in range(1, len(weight)):  # elements come after the ones that hold them
        if page.parents[k] == at and weight[k] >= need:
            at = k
    while at and at in bare and page.names[at] not in ("article", "main", "body"):
        at = page.parents[at]
    return at


def extract(page: str | None, priors: bool = True) -> str:
    """The main text: the leaves of the paths that the ratios choose, their blocks joined by a line feed."""
    parsed = parse(page or "")
    if not parsed.leaves:
        return ""
    ratios = path_ratios(parsed, priors)
    top = max(ratios.values())
    seeds = {p for p, r in ratios.items() if r >= SEED * top}
    home = content_element(parsed, seeds)
    inside = [k == home for k in range(len(parsed.parents))]
    for k in range(1, len(inside)):
        inside[k] = inside[k] or inside[parsed.parents[k]]
    blocks: dict[int, list[str]] = {}
    for x in parsed.leaves:
        if ratios[x.path] >= max(FLOOR, (KEEP if inside[x.element] else STAND) * top):
            blocks.setdefault(x.block, []).append(x.text)
    texts = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks.values())
    return "\n".join(t for t in texts if t)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, 2):
            texts = [extract(x.as_py()) for x in piece.column(2)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id (a long), url, text, n_chars (code points).

    The ratios of length and punctuation of every root-to-leaf tag path are smoothed and fused (path_ratios). What an
    element is called is a factor of the ratio: foreign names (nav, footer, a class that says advert) weigh so much that no
    ratio makes up for them, doubtful ones and article only tip it. Paths of
    at least SEED of the best ratio are seeds; the innermost element that holds nearly all of the seeds' text is the
    article's, and there a low threshold drops only what the ratios call foreign, outside of it a high one keeps only
    what is as good as the article. Hidden elements, form controls, scripts and styles hold no text of the page.
    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by
    a line feed.

    A null or empty page and one without text give an empty text; so does a page of nothing but foreign paths. Of equal
    ratios all stay. Texts of any length take time in proportion. Rows that repeat are all returned, an empty table gives
    no rows, and other columns, whatever their names, are not read.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return source.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
