"""Main-text extraction by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf path of tags.
Text length and punctuation are aggregated per tag path, smoothed along the
page and fused into one score; a path is content if its score is near the
best one and the scores of its container (all paths with the same parent)
add up to a share of the best container's. The chosen paths span the content
element, whose blocks are the main text. What isn't text (scripts, controls,
hidden parts) goes beforehand. Tags, roles, names and places of furniture
only weigh the scores of their paths.

All steps take time in proportion to the page, broken markup included: no
tag is searched to the end of the page twice, open elements are looked up by
tag, paths are numbered, and what lies in an element is an interval.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without text of the article (fixed values of the markup language and its conventions).
NO_TEXT = frozenset("head script style noscript template form button select textarea input iframe object svg canvas dialog audio video map".split())
NO_TEXT_ROLES = frozenset("search form dialog alert alertdialog".split())
#: Elements, roles and names of furniture: they weigh the score of a path.
FURNITURE_TAGS = frozenset("nav header footer aside menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising advertorial sponsored nav navs navbar navigation breadcrumb breadcrumbs pagination pager "
    "masthead topbar footer colophon sidebar sidebars cookie cookies consent gdpr paywall login signin signup newsletter comments commentlist disqus".split()
)
#: Names that hint at furniture, but may be those of sections too.
HINTS = frozenset(
    "header aside sponsor sponsors promo promos promotion related recommended recommendations trending popular notice notices alert alerts legal copyright "
    "form search subscribe subscription share sharing social comment respond reply replies discussion skip menu menus banner banners widget widgets popup modal overlay".split()
)
#: Names that say nothing by themselves beside another.
LAYOUT = frozenset("area bar block bottom box button buttons card cards col column container content group holder inner item items left link links list outer panel posts right row section site stories thread top wrap wrapper".split())
#: Weight of a path in furniture; in an element whose name hints at it; outside of the article element, if there is one.
FURNITURE, HINTED, OUTSIDE = 0.05, 0.5, 0.1
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSE_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Tags that end an open one of the second set, up to a tag of the third.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
P_SCOPE = frozenset("table td th button object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of prose, for pages without one element around the content.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
#: Elements around the page, which are never the content element.
PAGE = ("", "html", "body")
RAW = "script|style|textarea|title|noscript|iframe|template"

_OTHER = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)")
_TAG = re.compile(r"""(?is)<(?P<end>/?)(?P<tag>[a-z][^\s/><]*+)(?P<attrs>(?:"[^"]*+"|'[^']*+'|[^'">])*+)>""")
#: The same without a `<` in it, so that a tag which has no end costs no more than the way to the next one.
_SHORT_TAG = re.compile(r"""(?is)<(?P<end>/?)(?P<tag>[a-z][^\s/><]*+)(?P<attrs>(?:"[^"<]*+"|'[^'<]*+'|[^'"<>])*+)>""")
_TAG_START = re.compile(r"(?i)</?[a-z]")
_LONG_NUMBER = re.compile(r"&#([0-9]{8,})")
_RAW_END = {t: re.compile(rf"(?is)</{t}\b[^>]*+(?:>|\Z)") for t in RAW.split("|")}
_ATTR = re.compile(r"""(?is)([a-z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
PUNCTUATION = re.compile(r"[.,;:!?…،。，；：！？、]")
#: Weights of a block's neighbours in smoothing; share of the best fused score that a path must reach;
#: share of the best container's sum of scores that its container must reach.
KERNEL = (0.06, 0.24, 0.4, 0.24, 0.06)
THRESHOLD, SHARE = 0.25, 0.4
#: Lines that head or end a reader's comment, alone in their block (English).
_COMMENT = re.compile(
    r"(?i)(?:posted|commented|submitted|written|reply|replied) by\b.{0,80}|.{1,60} (?:says|wrote|commented|replied)\b.{0,40}:|(?:leave a |log in to |add a )?(?:reply|comment)|(?:reader )?(?:comments|replies|responses)(?: ?\(\d+\))?|\d+ (?:comments?|replies|reply|responses?)"
)


@dataclass(eq=False, slots=True)
class Element:
    """An element; its number and that of its last descendant, in page order, bound what lies in it."""

    tag: str
    parent: Element | None
    weight: float  # 0 for what isn't text, 1 for what nothing speaks against
    article: bool
    marked: bool = False  # is itself the article element
    path: int = 0
    number: int = 0
    last: int = -1
    holder: Element = None  # type: ignore[assignment]  # itself, or the innermost block element around an inline one

    def __post_init__(self) -> None:
        self.holder = self.parent.holder if self.parent and self.tag in INLINE else self

    def holds(self, other: Element) -> bool:
        return self.number <= other.number <= self.last


@dataclass(slots=True)
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _decoded(text: str) -> str:
    """Character references decoded; numbers beyond the last character become the replacement character, however long."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0") or "0")[:8], text))


def _named(names: str) -> float:
    """Weight by class and id: names count whole, each of their words being of furniture or of mere layout."""
    weight = 1.0
    for name in names.split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words & FURNITURE_NAMES and words <= FURNITURE_NAMES | HINTS | LAYOUT:
            return FURNITURE
        if words & HINTS and words <= HINTS | LAYOUT:
            weight = HINTED
    return weight


def _element(tag: str, attrs: str, parent: Element) -> Element:
    given = {k.lower(): _decoded(v.strip("\"'")) for k, v in _ATTR.findall(attrs)} if "=" in attrs or "hidden" in attrs.lower() else {}
    role = given.get("role", "").lower()
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or bool(re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")))
    own = 0.0 if tag in NO_TEXT or role in NO_TEXT_ROLES or hidden else 1.0
    if own and (role in FURNITURE_ROLES or tag in FURNITURE_TAGS and not (tag == "header" and parent.article)):
        own = FURNITURE
    elif own and tag not in ("html", "body", "main"):
        own = _named(given.get("class", "") + " " + given.get("id", ""))
    marked = tag == "article" or given.get("itemprop", "").lower() == "articlebody"
    return Element(tag, parent, min(own, parent.weight), marked or tag == "main" or role == "main" or parent.article, marked)


def _read(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks of text in page order, each with its innermost element, and all elements in page order.

    A tag without an end is text. After the first one, tags with a `<` in
    their attributes count as tags without an end.
    """
    root = Element("", None, 1.0, False)
    elements, stack, found, links = [root], [root], [Block(root)], 0
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    paths: dict[tuple[int, str], int] = {}

    def say(raw: str, decode: bool = True) -> None:
        if raw:
            if found[-1].element is not stack[-1] and not found[-1].parts:
                found[-1].element = stack[-1]
            text = _decoded(raw) if decode else raw
            found[-1].parts.append(text)
            if links:
                found[-1].linked += len("".join(text.split()))

    def cut() -> None:
        if found[-1].parts:
            found.append(Block(stack[-1]))
        else:
            found[-1].element = stack[-1]

    def push(made: Element) -> None:
        made.path = paths.setdefault((made.parent.path if made.parent else 0, made.tag), len(paths) + 1)
        made.number = len(elements)
        elements.append(made)
        opened.setdefault(made.tag, []).append(len(stack))
        stack.append(made)

    def drop(upto: int) -> None:
        nonlocal links
        block = False
        while len(stack) > upto:
            gone = stack.pop()
            opened[gone.tag].pop()
            gone.last = len(elements) - 1
            links -= gone.tag == "a"
            block = block or gone.tag not in INLINE
        if block:
            cut()

    def top_of(tags: frozenset[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close(tags: frozenset[str], scope: frozenset[str]) -> None:
        place = top_of(tags)
        if place > top_of(scope):
            drop(place)

    tags, at, look = _TAG, 0, 0
    while (look := page.find("<", look)) >= 0:
        if _TAG_START.match(page, look):
            m = tags.match(page, look)
            if not m and tags is _TAG:
                tags = _SHORT_TAG
                m = tags.match(page, look)
        else:
            m = _OTHER.match(page, look)
        if not m:
            look += 1
            continue
        say(page[at:look])
        at = look = m.end()
        if m.re is _OTHER:
            if m["cdata"] is not None:
                say(m["cdata"], decode=False)
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if opened.get(tag):
                drop(opened[tag][-1])
            elif tag == "p":
                cut()
            continue
        if tag in CLOSE_P:
            close(frozenset(["p"]), P_SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in VOID:
            if tag not in INLINE:
                cut()
            continue
        made = _element(tag, m["attrs"], stack[-1])
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = look = end.end() if end else len(page)
            continue
        inside = tag in INLINE and made.weight == stack[-1].weight
        push(made)
        if not inside:
            cut()
        links += tag == "a"
    say(page[at:])
    drop(1)
    root.last = len(elements) - 1
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in found if b.text], elements


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, with the innermost element of each."""
    return _read(page)[0]


#: The number of a tag path and the weight of its blocks.
Key = tuple[int, float]


def path_scores(blocks: list[Block], keys: list[Key]) -> dict[Key, float]:
    """Fused score of each tag path: text and punctuation per block of the path, smoothed along the page, times the weight."""
    total: dict[Key, list[float]] = {}
    for b, k in zip(blocks, keys, strict=True):
        t = total.setdefault(k, [0, 0, 0])
        t[0] += 1
        t[1] += max(0, len(b.text) - b.linked)
        t[2] += len(PUNCTUATION.findall(b.text))
    ratio = {k: (chars / n) * math.log(2 + punctuation / n) for k, (n, chars, punctuation) in total.items()}
    raw = [ratio[k] for k in keys]
    half = len(KERNEL) // 2
    out: dict[Key, float] = {}
    for i, k in enumerate(keys):
        smooth = sum(KERNEL[j + half] * raw[i + j] for j in range(-half, half + 1) if 0 <= i + j < len(raw))  # no text beyond the page
        out[k] = out.get(k, 0.0) + k[1] * math.sqrt(smooth * ratio[k]) / total[k][0]
    return out


def _spanned(chosen: list[Element], plain: list[Element]) -> Element:
    """The innermost block element around all chosen ones; further out past headings, or to its article element.

    *plain* are the elements of all blocks that aren't headings.
    """
    first, last = min(chosen, key=lambda e: e.number), max(chosen, key=lambda e: e.number)
    top = first.holder
    if top.parent and top.parent.tag not in PAGE:
        top = top.parent
    while top.parent and not (top.holds(first) and top.holds(last)):
        top = top.parent
    at: Element | None = top
    while at and not at.marked:
        at = at.parent
    if at:
        return at
    numbers = sorted(e.number for e in plain)

    def count(e: Element) -> int:
        return bisect_right(numbers, e.last) - bisect_left(numbers, e.number)

    inside = count(top)
    while top.parent and top.parent.tag not in PAGE and count(top.parent) == inside:
        top = top.parent
    return top


def _comments(blocks: list[Block], elements: list[Element], top: Element, scores: list[float]) -> set[int]:
    """Places of the blocks of readers' comments in the content element, where no name tells them.

    A child of the content element with a line that heads or ends a comment
    is one, if it follows prose and its scores are below the share of the
    content that makes a container; a paragraph only if it is such a line.
    """
    children = [e for e in elements if e.parent is top and e.tag not in INLINE]
    starts = [e.number for e in children]
    of = [bisect_right(starts, b.element.number) - 1 for b in blocks]
    of = [c if c >= 0 and children[c].holds(b.element) else -1 for b, c in zip(blocks, of, strict=True)]
    mass: dict[int, float] = {}
    for c, score in zip(of, scores, strict=True):
        mass[c] = mass.get(c, 0.0) + score
    within = sum(v for c, v in mass.items() if top.holds(children[c] if c >= 0 else top))
    told, before = set(), 0.0
    for b, c, score in zip(blocks, of, scores, strict=True):
        if c >= 0 and before > SHARE * within and mass[c] < SHARE * within and len(b.text) <= 120 and _COMMENT.fullmatch(b.text) and (b.element.holder is not children[c] or not b.text.endswith(":")):
            told.add(c)
        if c >= 0:
            before += score
    return {i for i, c in enumerate(of) if c in told}


def main_text(page: str | None) -> str:
    """The page's main text; empty for a null page or one without content.

    Every block has a path score, and paths near the best score in containers
    near the best one span the content element. Inside of it all paths near
    the best score are content; blocks of a lower score stay too if nothing
    hints at furniture and they aren't mere links: headings, list items,
    short lines. If only the page spans them, they alone and unhinted
    elements of prose are the text.
    """
    blocks, elements = _read(page or "")
    blocks = [b for b in blocks if b.element.weight]
    if all(b.element.weight <= FURNITURE for b in blocks):
        return ""
    marked = any(b.element.article for b in blocks)
    weights = [b.element.weight * (1.0 if b.element.article or not marked else OUTSIDE) for b in blocks]
    keys = [(b.element.path, w) for b, w in zip(blocks, weights, strict=True)]
    by_key = path_scores(blocks, keys)
    scores = [by_key[k] for k in keys]
    inside = [(b.element.holder.parent or b.element.holder).path for b in blocks]
    mass: dict[int, float] = {}
    for c, score in zip(inside, scores, strict=True):
        mass[c] = mass.get(c, 0.0) + score
    least, enough = THRESHOLD * max(scores), SHARE * max(mass.values())
    chosen = [score >= least and mass[c] >= enough for c, score in zip(inside, scores, strict=True)]
    near = [score >= least for score in scores]
    top = _spanned([b.element for b, ok in zip(blocks, chosen, strict=True) if ok], [b.element for b in blocks if b.element.holder.tag not in HEADINGS])
    spans = top.tag not in PAGE or not any(b.linked for b in blocks)
    comments = _comments(blocks, elements, top, scores) if spans else set()

    def stays(i: int) -> bool:
        """Whether a block of a path that didn't span belongs to the content."""
        b, weight = blocks[i], weights[i]
        links = b.linked * 2 > len(b.text)
        if spans and top.holds(b.element):
            return near[i] or weight == 1.0 and (b.element.article or not links)
        return not spans and weight == 1.0 and b.element.tag in PROSE and not links

    return " ".join(b.text for i, (b, ok) in enumerate(zip(blocks, chosen, strict=True)) if i not in comments and (ok or stays(i)))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page; one row for each row of *df*, narrow, whole pages.

    Null and empty pages have the empty text; megabytes of unclosed tags take seconds; repeated rows and null ids or
    urls are kept as they are; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, SCHEMA)
