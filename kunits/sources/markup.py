"""Blocks, and elements of XML entries that are read one outermost element at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from kunits.sources.archive import Package


@dataclass
class Block:
    kind: str
    text: str
    locator: str
    metadata: dict = field(default_factory=dict)
    eligible: bool = True
    reason: str = ""


@dataclass
class Element:
    """An element with its attributes (also by local name), and what is in it: elements and text."""

    tag: str
    given: dict
    inner: list[Element | str] = field(default_factory=list)

    def get(self, name: str, usual: str = "") -> str:
        return self.given.get(name, usual)

    def whole(self, name: str, usual: int | None = 0) -> int | None:
        """An attribute as a number; *usual* where it isn't one."""
        value = self.given.get(name, "")
        return int(value) if re.fullmatch(r"[+-]?\d{1,18}", value) else usual

    def children(self) -> Iterator[Element]:
        """Elements right below; of alternatives the first."""
        for x in self.inner:
            if isinstance(x, Element):
                if x.tag == "AlternateContent":
                    yield from next(iter(x.inner_elements()), Element("", {})).children()
                else:
                    yield x

    def inner_elements(self) -> list[Element]:
        return [x for x in self.inner if isinstance(x, Element)]

    def at(self, *path: str) -> Element | None:
        """The first element along a path of tags."""
        here: Element | None = self
        for tag in path:
            here = next((x for x in here.children() if x.tag == tag), None) if here else None
        return here

    def value(self, *path: str) -> str | None:
        """Attribute ``val`` of the element along the path; null without that element."""
        found = self.at(*path)
        return None if found is None else found.get("val")

    def outer(self, *tags: str) -> Iterator[Element]:
        """Outermost elements below with one of the tags, in order."""
        for x in self.children():
            if x.tag in tags:
                yield x
            else:
                yield from x.outer(*tags)

    def all(self, *tags: str) -> Iterator[Element]:
        """All elements below with one of the tags, in order."""
        for x in self.children():
            if x.tag in tags:
                yield x
            yield from x.all(*tags)

    def said(self) -> str:
        return "".join(x if isinstance(x, str) else x.said() for x in self.inner)


def elements(package: Package, part: str, *tags: str) -> Iterator[Element]:
    """Outermost elements of an entry with one of the tags (without tags: the root), each built when it ends."""
    open_: list[Element] = []
    for kind, name, given in package.events(part):
        if kind == "start":
            if open_ or not tags or name in tags:
                made = Element(name, given)
                if open_:
                    open_[-1].inner.append(made)
                open_.append(made)
        elif kind == "text":
            if open_:
                open_[-1].inner.append(name)
        elif open_:
            done = open_.pop()
            if not open_:
                yield done


#: Entries that readers of packages leave alone: macros and embedded objects.
UNREAD = re.compile(r"(?i)vbaProject\.bin$|/embeddings/")


def unread_features(package: Package, part: str) -> list[Block]:
    """A block that says so where a package holds macros or embedded objects; it is no content."""
    if not any(UNREAD.search(name) for name in package.entries):
        return []
    return [Block("package_warning", "", f"{part}#warning=1", {"feature": "embedded-object-or-macro"}, False, "OOXML_PARTIAL_FEATURE_SUPPORT")]
