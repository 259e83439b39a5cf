"""Reader of presentation packages: slides in order, the shapes of each, then its notes."""

from __future__ import annotations

import re
from collections.abc import Iterator

from kunits.sources.archive import Package, PackageError
from kunits.sources.markup import Block, Element, elements, unread_features
from kunits.sources.sheets import NO_CONTENT

#: Placeholders of a page of notes that hold no notes (fixed values).
LINES_OF_NOTES = frozenset(("sldNum", "hdr", "ftr", "dt"))
TITLES = frozenset(("title", "ctrTitle"))
SHAPES = ("sp", "pic", "graphicFrame", "cxnSp")
BULLETS = ("buChar", "buAutoNum", "buBlip")


def _text(p: Element) -> str:
    return "".join(t.said() for t in p.all("t"))


def _placeholder(shape: Element) -> str | None:
    found = next(shape.all("ph"), None)
    return None if found is None else found.get("type", "body")


class Slide:
    """One slide; paragraphs, those of tables too, and shapes are numbered in reading order."""

    def __init__(self, package: Package, path: str, number: int):
        self.path, self.number = path, number
        self.links = package.relations(path)
        root = next(elements(package, path), Element("sld", {}))
        transition = next(root.all("transition"), None)
        self.meta = {"slide": number, "hidden": root.get("show") == "0", "transition": transition.get("spd", "present") if transition else ""}
        if next(root.all("timing"), None):
            self.meta["timing"] = True
        self.paragraphs = self.tables = 0
        self.content: list[Block] = []
        self.pictures: list[Block] = []
        self.charts: list[Block] = []
        for nth, shape in enumerate(root.outer(*SHAPES), 1):
            self.shape(shape, nth)

    def at(self, what: str) -> str:
        return f"{self.path}#slide={self.number}/{what}"

    def target(self, x: Element) -> str:
        return self.links.get(x.get("embed") or x.get("link") or x.get("id"), {}).get("target", "")

    def shape(self, shape: Element, nth: int) -> None:
        named = next(shape.all("cNvPr"), None) or Element("cNvPr", {})
        meta = self.meta | {"shape": named.get("name")}
        frame = next(shape.all("xfrm"), None)
        if frame and (off := frame.at("off")) and (ext := frame.at("ext")):
            meta["bounds"] = f"{off.get('x')},{off.get('y')},{ext.get('cx')},{ext.get('cy')}"
        for x in shape.outer("tbl", "txBody", "chart", "blip", "imagedata"):
            if x.tag == "tbl":
                self.table(x)
            elif x.tag == "txBody":
                for p in x.outer("p"):
                    self.paragraph(p, nth, _placeholder(shape) in TITLES, meta)
            elif x.tag == "chart":
                self.charts.append(Block("chart_metadata", "", self.at(f"chart={nth}"), meta | {"target": self.target(x)}, False, NO_CONTENT))
            else:
                said = named.get("descr") or named.get("title")
                self.pictures.append(Block("image_metadata", said, self.at(f"image={nth}"), meta | {"target": self.target(x)}, False, NO_CONTENT))

    def paragraph(self, p: Element, shape: int, title: bool, meta: dict) -> None:
        self.paragraphs += 1
        text, properties = _text(p).strip(), p.at("pPr") or Element("pPr", {})
        if not text:
            return
        listed = any(x.tag in BULLETS for x in properties.children())
        meta = meta | ({"level": properties.whole("lvl")} if properties.get("lvl") else {})
        if links := [t for x in p.all("hlinkClick") if (t := self.target(x))]:
            meta["hyperlinks"] = " ".join(links)
        self.content.append(Block("heading" if title else "list_item" if listed else "paragraph", text, self.at(f"shape={shape}/p={self.paragraphs}"), meta))

    def table(self, tbl: Element) -> None:
        self.tables += 1
        for r, tr in enumerate(tbl.outer("tr"), 1):
            for c, tc in enumerate(tr.outer("tc"), 1):
                paragraphs = list(tc.all("p"))
                self.paragraphs += len(paragraphs)
                span, rows = tc.get("gridSpan", "1"), tc.get("rowSpan", "1")
                covered = any(tc.get(name) in ("1", "true") for name in ("hMerge", "vMerge"))
                meta = {"slide": self.number, "table": self.tables, "row": r, "column": c, "hidden": self.meta["hidden"], "merge": f"{rows}x{span}" if covered or (rows, span) != ("1", "1") else "none"}
                self.content.append(Block("table_cell", "".join(map(_text, paragraphs)).strip(), self.at(f"table={self.tables}/row={r}/cell={c}"), meta))

    def notes(self, package: Package) -> Iterator[Block]:
        part = next((x["target"] for x in self.links.values() if not x["external"] and (x["type"].endswith("/notesSlide") or "notesSlides/" in x["target"])), None)
        if part is None:
            return
        nth = 0
        for root in elements(package, part):
            for shape in root.outer("sp"):
                for p in shape.all("p"):
                    nth += 1
                    if (text := _text(p).strip()) and _placeholder(shape) not in LINES_OF_NOTES:
                        yield Block("speaker_note", text, f"{part}#slide={self.number}/p={nth}", {"slide": self.number})


def read_pptx(data: bytes) -> list[Block]:
    """Blocks of slides in order of the presentation, each with its notes, pictures and charts."""
    package = Package(data)
    if "ppt/presentation.xml" not in package.entries:
        raise PackageError("OOXML_UNSUPPORTED", "not a presentation package")
    links = package.relations("ppt/presentation.xml")
    blocks: list[Block] = []
    for number, x in enumerate(elements(package, "ppt/presentation.xml", "sldId"), 1):
        path = links.get(x.get("r:id"), {}).get("target", "")
        if path not in package.entries or not re.fullmatch(r"(?i)ppt/slides/slide[^/]*\.xml", path):
            raise PackageError("OOXML_MALFORMED_RELATIONSHIP", f"no part for slide {number}")
        slide = Slide(package, path, number)
        blocks += [*slide.content, *slide.notes(package), *slide.pictures, *slide.charts]
    return blocks + unread_features(package, "ppt/presentation.xml")
