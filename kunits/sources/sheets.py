"""Reader of spreadsheet packages: sheets in the workbook's order, a row at a time."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from kunits.sources.archive import Package, PackageError
from kunits.sources.markup import Block, Element, elements, unread_features

#: Built-in number formats that are dates (fixed values).
DATE_FORMATS = frozenset((14, 15, 16, 17, 22))
ANCHORS = ("twoCellAnchor", "oneCellAnchor", "absoluteAnchor")
NO_CONTENT = "non-card metadata"
#: Cell types whose value is the text itself (fixed values).
PLAIN_TYPES = {"inlineStr": "inline_string", "str": "formula_string_cache", "e": "error"}


def letters_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def number_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


@dataclass(frozen=True)
class Area:
    """A range of cells; columns and rows count from 1."""

    left: int
    top: int
    right: int
    bottom: int

    @classmethod
    def of(cls, ref: str) -> Area | None:
        m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d{1,7})(?::\$?([A-Za-z]{1,3})\$?(\d{1,7}))?", ref)
        if not m:
            return None
        columns, rows = sorted(letters_number(x) for x in (m[1], m[3] or m[1])), sorted(int(x) for x in (m[2], m[4] or m[2]))
        return cls(columns[0], rows[0], columns[1], rows[1])

    def cells(self) -> list[str]:
        return [f"{number_letters(c)}{r}" for r in range(self.top, self.bottom + 1) for c in range(self.left, self.right + 1)]

    def holds(self, column: int, row: int) -> bool:
        return self.left <= column <= self.right and self.top <= row <= self.bottom


def cells_of(area: str) -> list[str]:
    """Cells of a range such as B2:C3, row by row."""
    found = Area.of(area)
    return found.cells() if found else []


def _yes(x: Element, name: str) -> bool:
    return x.get(name) in ("1", "true")


def spoken(x: Element) -> str:
    """Text of a string item, without its phonetic reading."""
    return "".join(t.said() for part in x.children() if part.tag in ("t", "r") for t in ([part] if part.tag == "t" else part.outer("t")))


@dataclass
class Workbook:
    """What all sheets share: strings and, by style of a cell, number formats."""

    strings: list[str]
    formats: list[str]

    @classmethod
    def of(cls, package: Package) -> Workbook:
        codes: dict[int, str] = {}
        styles: list[int] = []
        for x in elements(package, "xl/styles.xml", "numFmt", "cellXfs"):
            if x.tag == "numFmt":
                codes[x.whole("numFmtId")] = x.get("formatCode")
            else:
                styles = [xf.whole("numFmtId") for xf in x.children() if xf.tag == "xf"]
        return cls([spoken(si) for si in elements(package, "xl/sharedStrings.xml", "si")], [codes.get(i) or ("builtin-date" if i in DATE_FORMATS else "") for i in styles])

    def number_format(self, style: int) -> str:
        return self.formats[style] if 0 <= style < len(self.formats) else ""

    def shared(self, index: str) -> str:
        if not index.isdigit() or int(index) >= len(self.strings):
            raise PackageError("OOXML_MALFORMED_XML", "a cell names a string that isn't there")
        return self.strings[int(index)]

    def text(self, c: Element) -> tuple[str, str, str]:
        """(text, type, number format) of a cell."""
        code = self.number_format(c.whole("s"))
        v, inline, kind = c.at("v"), c.at("is"), c.get("t", "n")
        raw = v.said() if v else ""
        if kind == "s":
            return self.shared(raw), "shared_string", code
        if kind == "b":
            return "TRUE" if raw == "1" else "FALSE", "boolean", code
        if kind in PLAIN_TYPES:
            return (spoken(inline) if inline else "") if kind == "inlineStr" else raw, PLAIN_TYPES[kind], code
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)  # quoted and escaped signs and colours name no date
        dated = code == "builtin-date" or re.search("(?i)[ymdhis]", bare)
        return raw, "date_serial" if dated else "number", code


@dataclass
class Sheet:
    """One worksheet: cells by reference, and what the sheet says about ranges of them."""

    path: str
    title: str
    number: int
    state: str
    cells: dict[str, Block] = field(default_factory=dict)
    hidden_columns: list[tuple[int, int]] = field(default_factory=list)
    hidden_rows: list[int] = field(default_factory=list)
    merges: list[str] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    drawings: list[str] = field(default_factory=list)
    used: str = ""
    formulas: dict[str, str] = field(default_factory=dict)

    def where(self) -> dict:
        return {"sheet": self.title, "sheet_index": self.number}

    def at(self, what: str) -> str:
        return f"{self.path}#sheet={self.number}/{what}"

    def read(self, package: Package, book: Workbook) -> None:
        links = package.relations(self.path)
        last = 0
        for x in elements(package, self.path, "dimension", "col", "row", "mergeCell", "autoFilter", "drawing", "tablePart"):
            if x.tag == "row":
                last = self.row(x, x.whole("r", last + 1), book)
            elif x.tag == "col":
                if _yes(x, "hidden"):
                    self.hidden_columns.append((x.whole("min"), x.whole("max")))
            elif x.tag in ("drawing", "tablePart"):
                if x.get("id") in links:
                    (self.drawings if x.tag == "drawing" else self.tables).append(links[x.get("id")]["target"])
            elif x.tag == "dimension":
                self.used = x.get("ref")
            else:
                (self.merges if x.tag == "mergeCell" else self.filters).append(x.get("ref"))

    def row(self, row: Element, number: int, book: Workbook) -> int:
        hidden, column = _yes(row, "hidden"), 0
        if hidden:
            self.hidden_rows.append(number)
        for c in row.outer("c"):
            place = Area.of(c.get("r"))  # a cell without a reference stands right of the one before
            column, here = (place.left, place.top) if place else (column + 1, number)
            self.cell(c, column, here, hidden, book)
        return number

    def cell(self, c: Element, column: int, row: int, row_hidden: bool, book: Workbook) -> None:
        ref, letters = c.get("r") or f"{number_letters(column)}{row}", number_letters(column)
        text, kind, code = book.text(c)
        column_hidden = any(a <= column <= b for a, b in self.hidden_columns)
        meta = self.where() | {"sheet_visibility": self.state, "coordinate": ref, "row": row, "column": letters, "row_hidden": row_hidden, "cell_type": kind, "number_format": code, "column_hidden": column_hidden}
        if (f := c.at("f")) is not None:
            formula = f.said()
            if f.get("t") == "shared":  # the first cell has the formula of all that share it
                formula = formula or self.formulas.get(f.get("si"), "")
                self.formulas.setdefault(f.get("si"), formula)
            cached = v.said() if (v := c.at("v")) else ""
            if formula:
                meta |= {"formula": formula, "cached_value": cached, "cached_value_status": "present" if cached else "missing"}
        if kind == "date_serial" and text:
            meta["date_serial"] = text
        self.cells[ref] = Block("spreadsheet_cell", text, self.at(f"cell={ref}"), meta)

    def mark_ranges(self) -> None:
        """Cells of merges take part in them, the first as anchor; cells of filters know their range."""
        for area in self.merges:
            refs = cells_of(area)
            for ref in refs:
                if ref not in self.cells:
                    place = Area.of(ref)
                    self.cells[ref] = Block("spreadsheet_cell", "", self.at(f"cell={ref}"), self.where() | {"coordinate": ref, "row": place.top, "column": number_letters(place.left)})
                inherited = self.cells[refs[0]].text if ref != refs[0] else ""
                self.cells[ref].metadata |= {"merge": area, "merge_role": "inherited" if ref != refs[0] else "anchor", "inherited_header": inherited}
        for area in filter(None, map(Area.of, self.filters)):
            for b in self.cells.values():
                if area.holds(letters_number(b.metadata["column"]), b.metadata["row"]):
                    b.metadata["filter_role"] = "header" if b.metadata["row"] == area.top else "filtered"

    def name_rows(self) -> None:
        """A row is named by its leftmost text (no number, no formula), if no other row has the same name."""
        leftmost: dict[int, Block] = {}
        for b in self.cells.values():
            row, m = b.metadata["row"], b.metadata
            if b.text and not m.get("row_hidden") and (row not in leftmost or letters_number(m["column"]) < letters_number(leftmost[row].metadata["column"])):
                leftmost[row] = b
        names = {row: b.text.strip() for row, b in leftmost.items() if b.metadata.get("cell_type") != "number" and "formula" not in b.metadata}
        alone = {name for name, times in Counter(names.values()).items() if name and times == 1}
        for b in self.cells.values():
            if names.get(b.metadata["row"]) in alone:
                b.metadata["row_identity"] = names[b.metadata["row"]]

    def about(self) -> list[Block]:
        """What the sheet says of itself, where it does: used range, filters, tables."""
        said = {"used_range": self.used, "autofilters": " ".join(self.filters), "tables": " ".join(self.tables)}
        if not any(said.values()):
            return []
        said |= {"merges": " ".join(self.merges), "hidden_rows": " ".join(map(str, self.hidden_rows)), "hidden_columns": " ".join(f"{a}:{b}" for a, b in self.hidden_columns)}
        return [Block("sheet_metadata", "", self.at("about"), self.where() | {"coordinate": "", "sheet_visibility": self.state} | said, False, NO_CONTENT)]

    def pictures(self, package: Package) -> list[Block]:
        """Pictures and charts with the cells that they cover; a drawing without any counts as one picture."""
        found = []
        for drawing in self.drawings:
            links = package.relations(drawing)
            target = lambda x: links.get(x.get("embed") or x.get("id"), {}).get("target", "")  # noqa: B023, E731
            before = len(found)
            for nth, anchor in enumerate(elements(package, drawing, *ANCHORS), 1):
                corners = [f"{number_letters((int(p.at('col').said()) if p.at('col') else 0) + 1)}{(int(p.at('row').said()) if p.at('row') else 0) + 1}" for side in ("from", "to") if (p := anchor.at(side))]
                named = next(anchor.all("cNvPr"), None)
                for x in anchor.all("blip", "chart"):
                    meta = self.where() | {"drawing": drawing, "target": target(x), "anchor": ":".join(corners), "shape": named.get("name") if named else ""}
                    found.append(Block("chart_metadata" if x.tag == "chart" else "image_metadata", named.get("descr") if named else "", f"{drawing}#sheet={self.number}/anchor={nth}", meta, False, NO_CONTENT))
            if len(found) == before:
                found.append(Block("image_metadata", "", f"{drawing}#sheet={self.number}", self.where() | {"drawing": drawing}, False, NO_CONTENT))
        return found


def read_xlsx(data: bytes) -> list[Block]:
    """A block for each cell, sheets in the workbook's order; then what is no content."""
    package = Package(data)
    if "xl/workbook.xml" not in package.entries:
        raise PackageError("OOXML_UNSUPPORTED", "not a spreadsheet package")
    book, links = Workbook.of(package), package.relations("xl/workbook.xml")
    blocks: list[Block] = []
    for number, x in enumerate(elements(package, "xl/workbook.xml", "sheet"), 1):
        link = links.get(x.get("r:id") or x.get("id"))
        if link is None or link["target"] not in package.entries:
            raise PackageError("OOXML_MALFORMED_RELATIONSHIP", f"no part for sheet {number}")
        sheet = Sheet(link["target"], x.get("name"), number, x.get("state", "visible"))
        sheet.read(package, book)
        sheet.mark_ranges()
        sheet.name_rows()
        blocks += [*sheet.cells.values(), *sheet.about(), *sheet.pictures(package)]
    return blocks + unread_features(package, "xl/workbook.xml")
