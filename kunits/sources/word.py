"""Reader of word-processing packages.

A part is read paragraph by paragraph and table by table. Tables nest: each
has a frame of its own (number, open vertical merges, the cell that holds it).
Lists have counters by list definition and level, as the numbering part says.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from kunits.sources.archive import Package, PackageError
from kunits.sources.markup import Block, Element, elements, unread_features

NOTES = {"footnote": "word/footnotes.xml", "endnote": "word/endnotes.xml", "comment": "word/comments.xml"}
REFERENCES = ("footnoteReference", "endnoteReference", "commentReference")
#: What was moved away or deleted is no text of the document.
GONE = ("del", "moveFrom", "delText")
PROPERTIES = ("pPr", "rPr", "tblPr", "tblGrid", "trPr", "tcPr", "sectPr")
LEVELS = 9


# Numbers of lists


def _letters(n: int) -> str:
    return chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1)


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + sign * (n // value), n % value
    return out


def _han(n: int) -> str:
    digits, out = "零一二三四五六七八九", ""
    for place, unit in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        d, n = divmod(n, place)
        if d:
            out += digits[d] + unit
        elif out and n and not out.endswith("零"):
            out += "零"
    return re.sub("^一十", "十", out)


def shown(n: int, form: str) -> str:
    """A list's number in one of the named formats; decimal where the format is another."""
    if form == "none" or n < 0:
        return ""
    if form == "decimalZero":
        return f"{n:02d}"
    if n and form in ("lowerLetter", "upperLetter"):
        return _letters(n) if form == "lowerLetter" else _letters(n).upper()
    if n and form in ("lowerRoman", "upperRoman"):
        return _roman(n) if form == "lowerRoman" else _roman(n).upper()
    if 0 < n < 10_000 and re.match("chineseCounting|japaneseCounting|taiwaneseCounting|ideographDigital", form):
        return _han(n)
    if 0 < n <= 20 and form == "decimalEnclosedCircle":
        return chr(0x245F + n)
    return str(n)


@dataclass(frozen=True)
class Level:
    start: int = 1
    form: str = "decimal"
    text: str = ""
    restart: int | None = None  # the level (from 1) whose items restart this one; 0: none does
    style: str = ""
    legal: bool = False  # all numbers of the label are decimal

    @classmethod
    def of(cls, lvl: Element) -> Level:
        restart = lvl.at("lvlRestart")
        return cls(int(lvl.value("start") or 1), lvl.value("numFmt") or "decimal", lvl.value("lvlText") or "", None if restart is None else restart.whole("val"), lvl.value("pStyle") or "", lvl.at("isLgl") is not None)


@dataclass
class Numbering:
    """List definitions, the lists that use them, and the counters of a part."""

    definitions: dict[str, dict[int, Level]] = field(default_factory=dict)
    lists: dict[str, str] = field(default_factory=dict)
    starts: dict[tuple[str, int], int] = field(default_factory=dict)
    levels: dict[tuple[str, int], Level] = field(default_factory=dict)
    counts: dict[str, dict[int, int]] = field(default_factory=dict)
    begun: set[tuple[str, int]] = field(default_factory=set)

    @classmethod
    def of(cls, package: Package) -> Numbering:
        made, named, linked = cls(), {}, {}
        for x in elements(package, "word/numbering.xml", "abstractNum", "num"):
            if x.tag == "abstractNum":
                key = x.get("abstractNumId")
                made.definitions[key] = {lvl.whole("ilvl"): Level.of(lvl) for lvl in x.outer("lvl")}
                if (style := x.value("styleLink")) is not None:
                    named[style] = key
                if (style := x.value("numStyleLink")) is not None:
                    linked[key] = style
                continue
            number = x.get("numId")
            made.lists[number] = x.value("abstractNumId") or ""
            for changed in x.outer("lvlOverride"):
                at = (number, changed.whole("ilvl"))
                if (start := changed.at("startOverride")) is not None:
                    made.starts[at] = start.whole("val", 1)
                if (lvl := changed.at("lvl")) is not None:
                    made.levels[at] = Level.of(lvl)
        made.lists = {number: named.get(linked.get(key, ""), key) for number, key in made.lists.items()}
        return made

    def again(self) -> Numbering:
        """The same lists with counters at their starts: each part counts for itself."""
        return Numbering(self.definitions, self.lists, self.starts, self.levels)

    def level(self, number: str, depth: int) -> Level:
        return self.levels.get((number, depth)) or self.definitions.get(self.lists.get(number, ""), {}).get(depth, Level())

    def depth_of_style(self, number: str, style: str) -> int | None:
        return next((d for d in range(LEVELS) if style and self.level(number, d).style == style), None)

    def item(self, number: str, depth: int) -> tuple[str, str]:
        """(format, label) of the next item of a list at a level; counters go on."""
        counts = self.counts.setdefault(self.lists.get(number, number), {})
        first = lambda d: self.starts.get((number, d), self.level(number, d).start)
        if (number, depth) in self.starts and (number, depth) not in self.begun:
            counts[depth] = first(depth)  # a list that overrides the start begins anew
        else:
            counts[depth] = counts[depth] + 1 if depth in counts else first(depth)
        self.begun.add((number, depth))
        for d in range(depth):
            counts.setdefault(d, first(d))
        for d in [d for d in counts if d > depth]:
            restart = self.level(number, d).restart
            if restart is None or depth < restart:
                del counts[d]
        mine = self.level(number, depth)
        if mine.form == "bullet":
            return mine.form, mine.text
        of = lambda d: shown(counts.get(d, first(d)), "decimal" if mine.legal else self.level(number, d).form)
        return mine.form, re.sub("%([1-9])", lambda m: of(int(m[1]) - 1), mine.text) if mine.text else of(depth)


# Styles


@dataclass(frozen=True)
class Style:
    name: str = ""
    based: str = ""
    outline: int | None = None
    number: str | None = None
    depth: int | None = None


def _level(properties: Element | None, *path: str) -> int | None:
    found = properties.at(*path) if properties else None
    return None if found is None else found.whole("val")


class Styles:
    def __init__(self, package: Package):
        self.known: dict[str, Style] = {}
        self.language = ""
        for x in elements(package, "word/styles.xml", "style", "docDefaults"):
            self.language = self.language or next((v for lang in x.all("lang") if (v := lang.get("val"))), "")
            if x.tag == "style":
                p = x.at("pPr")
                outline = _level(p, "outlineLvl")
                # Some writers put it right below the style.
                outline = _level(x, "outlineLvl") if outline is None else outline
                self.known[x.get("styleId")] = Style(x.value("name") or "", x.value("basedOn") or "", outline, p.value("numPr", "numId") if p else None, _level(p, "numPr", "ilvl"))

    def chain(self, style: str) -> list[Style]:
        """The style and what it is based on; a ring of styles ends where it closes."""
        found, seen = [], set()
        while style in self.known and style not in seen:
            seen.add(style)
            found.append(self.known[style])
            style = found[-1].based
        return found

    def outline(self, style: str) -> int | None:
        """Level (from 0) of a heading style: as the style or its bases say, or as its name does."""
        chain = self.chain(style)
        said = next((s.outline for s in chain if s.outline is not None), None)
        if said is not None:
            return said if said < LEVELS else None  # level 9 is body text
        m = re.match(r"(?i)(?:heading|标题)\s*([1-9])", (chain[0].name if chain else "") or style)
        return int(m[1]) - 1 if m else None

    def list_of(self, style: str) -> tuple[str | None, int | None]:
        for s in self.chain(style):
            if s.number is not None:
                return s.number, s.depth
        return None, None


# Parts


@dataclass
class Paragraph:
    text: str = ""
    style: str = ""
    outline: int | None = None
    form: str = ""
    label: str = ""
    depth: int | None = None
    ends_section: bool = False
    links: list[str] = field(default_factory=list)
    references: list[str] = field(default_factory=list)
    images: list[str] = field(default_factory=list)
    breaks: list[str] = field(default_factory=list)
    boxes: list[Element] = field(default_factory=list)

    def marks(self) -> dict:
        kept = (("hyperlinks", self.links), ("references", self.references), ("images", self.images), ("breaks", self.breaks))
        return {name: " ".join(values) for name, values in kept if values}


@dataclass
class Frame:
    """A table that is being read: its number, the cell around it, the first cells of open vertical merges by grid column."""

    number: int
    inside: str
    merged: dict[int, str] = field(default_factory=dict)


class Part:
    """One part of a document; blocks gather in reading order."""

    def __init__(self, package: Package, kind: str, name: str, styles: Styles, numbering: Numbering):
        self.kind, self.name, self.styles, self.numbering = kind, name, styles, numbering.again()
        self.links = package.relations(name)
        self.blocks: list[Block] = []
        self.section, self.paragraphs, self.tables = 1, 0, 0
        for x in elements(package, name, "p", "tbl", "sectPr", "AlternateContent"):
            self.content(Element("", {}, [x]))

    def content(self, around: Element) -> None:
        for x in around.outer("p", "tbl", "sectPr"):
            if x.tag == "p":
                self.paragraph(x)
            elif x.tag == "tbl":
                self.table(x)
            else:
                self.section += 1

    def target(self, x: Element, *names: str) -> str:
        return next((self.links[i]["target"] for n in names if (i := x.get(n)) in self.links), "")

    def read(self, p: Element) -> Paragraph:
        """A paragraph's text and properties; its list's counter goes on."""
        self.paragraphs += 1
        properties = p.at("pPr") or Element("pPr", {})
        made = Paragraph(style=properties.value("pStyle") or "", ends_section=properties.at("sectPr") is not None)
        outline = properties.at("outlineLvl")
        made.outline = self.styles.outline(made.style) if outline is None else outline.whole("val")
        number, depth = self.styles.list_of(made.style)
        if (own := properties.value("numPr", "numId")) is not None:
            number, depth = own, None
        if number and number != "0":
            own_depth = _level(properties, "numPr", "ilvl")
            by_style = self.numbering.depth_of_style(number, made.style)
            made.depth = next((d for d in (own_depth, by_style, depth) if d is not None), 0)
            made.form, made.label = self.numbering.item(number, made.depth)
        self.runs(p, made)
        return made

    def runs(self, around: Element, into: Paragraph) -> None:
        for x in around.children():
            if x.tag in ("t", "instrText"):
                into.text += x.said()
            elif x.tag == "br":
                into.breaks.append(x.get("type") or "line")
            elif x.tag in REFERENCES:
                into.references.append(f"{x.tag}:{x.get('id')}")
            elif x.tag in ("blip", "imagedata"):
                into.images.append(self.target(x, "embed", "id"))
            elif x.tag == "txbxContent":
                into.boxes.append(x)
            elif x.tag not in GONE + PROPERTIES:
                if x.tag == "hyperlink":
                    into.links.append(self.target(x, "id") or (f"#{x.get('anchor')}" if x.get("anchor") else ""))
                self.runs(x, into)

    def paragraph(self, p: Element) -> None:
        made = self.read(p)
        kind = "heading" if made.outline is not None else "list_item" if made.depth is not None else self.kind
        meta = {"part": self.kind, "paragraph": self.paragraphs, "section": self.section, "style": made.style, "language": self.styles.language or "unknown"}
        if made.outline is not None:
            meta["outline_level"] = made.outline
        if made.depth is not None:
            meta |= {"list_level": made.depth, "list_format": made.form, "list_label": made.label}
        self.blocks.append(Block(kind, made.text.strip(), f"{self.name}#section={self.section}/p={self.paragraphs}", meta | made.marks()))
        for box in made.boxes:
            self.content(box)
        self.section += made.ends_section

    def table(self, tbl: Element, inside: str = "") -> None:
        self.tables += 1
        frame = Frame(self.tables, inside)
        for r, tr in enumerate(tbl.outer("tr"), 1):
            column = 1 + (_level(tr, "trPr", "gridBefore") or 0)
            for c, tc in enumerate(tr.outer("tc"), 1):
                column += self.cell(tc, frame, r, c, column)

    def cell(self, tc: Element, frame: Frame, row: int, nth: int, column: int) -> int:
        """The block of a cell, then its nested tables; returns how many grid columns it takes."""
        span = max(1, _level(tc, "tcPr", "gridSpan") or 1)
        vertical = tc.at("tcPr", "vMerge")
        merge = "none" if vertical is None else vertical.get("val") or "continue"
        at = f"{self.name}#table={frame.number}/row={row}/cell={nth}"
        meta = {"part": self.kind, "table": frame.number, "row": row, "cell": nth, "grid_column": column, "merge": f"{span}:{merge}" if span > 1 or merge != "none" else "none"}
        if merge == "continue" and column in frame.merged:
            meta["merged_into"] = frame.merged[column]
        elif merge == "restart":
            frame.merged[column] = at
        else:
            frame.merged.pop(column, None)
        if frame.inside:
            meta["inside"] = frame.inside
        block = Block("table_cell", "", at, meta)
        self.blocks.append(block)
        for x in tc.outer("p", "tbl"):
            if x.tag == "tbl":
                self.table(x, at)
                continue
            made = self.read(x)
            block.text += made.text
            for name, value in made.marks().items():
                meta[name] = f"{meta[name]} {value}" if name in meta else value
            for box in made.boxes:
                self.content(box)
        block.text = block.text.strip()
        return span


def read_docx(data: bytes) -> list[Block]:
    """Blocks of the body, headers, footers, notes and comments, in that order."""
    package = Package(data)
    if package.read("[Content_Types].xml") is None or "word/document.xml" not in package.entries:
        raise PackageError("OOXML_UNSUPPORTED", "not a word-processing package")
    margins = sorted((name, m[1].lower()) for name in package.entries if (m := re.fullmatch(r"(?i)word/(header|footer)\d*\.xml", name)))
    parts = [("document", "word/document.xml"), *((kind, name) for name, kind in margins), *((kind, name) for kind, name in NOTES.items() if name in package.entries)]
    styles, numbering = Styles(package), Numbering.of(package)
    blocks = [b for kind, name in parts for b in Part(package, kind, name, styles, numbering).blocks]
    return blocks + unread_features(package, "word/document.xml")
