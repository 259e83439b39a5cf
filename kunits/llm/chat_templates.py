"""A small sandboxed template language for conversations, compiled to closures.

Grammar: text, ``{{ expression }}``, ``{# comment #}`` and the blocks
``for NAME in expression`` / ``endfor``, ``if`` / ``elif`` / ``else`` /
``endif``, ``set NAME = expression`` and ``generation`` / ``endgeneration``.
Expressions: names, ``.field`` and ``[index]`` of dictionaries and lists,
strings, integers, ``true false none``, ``+`` (numbers or texts), ``==`` ``!=``
``in`` ``not in``, ``and`` ``or`` ``not``, parentheses and ``| filter``.

There are no calls, no attributes of Python objects and no imports, so a
template can reach nothing but its variables. The parser builds a syntax tree,
constants are folded, and every node becomes a Python closure that yields
(text, inside generation) pieces, so messages may be a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Piece = tuple[str, bool]


class TemplateError(ValueError):
    """The template is not of the language, or an expression has no value."""


# Syntax tree: tuples of a kind and its parts.

_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|[-+|.()\[\]])|([A-Za-z_]\w*))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_BLOCK = re.compile(r"(?s)\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}")


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            if not (m := _TOKEN.match(text, at)):
                raise TemplateError(f"unexpected {text[at:].strip()[:20]!r}")
            kind = ("number", "string", "sign", "name")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind != "string" and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}, found {self.peek()[1]!r}")

    def whole(self) -> tuple:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        if sign := self.take("==", "!=", "in"):
            return (sign, node, self.added())
        if self.take("not"):
            self.need("in")
            return ("not", ("in", node, self.added()))
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.value()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name":
                raise TemplateError("a filter needs a name")
            self.at += 1
            node = ("filter", name, node)
        return node

    def value(self) -> tuple:
        kind, text = self.peek()
        self.at += 1
        if kind == "number":
            node: tuple = ("const", int(text))
        elif kind == "string":
            node = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S))
        elif kind == "name":
            node = ("const", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
        elif text == "(":
            node = self.either()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {text!r}" if text else "the expression ends early")
        while True:
            if self.take("."):
                kind, text = self.peek()
                if kind != "name":
                    raise TemplateError("a field needs a name")
                self.at += 1
                node = ("item", node, ("const", text))
            elif self.take("["):
                node = ("item", node, self.either())
                self.need("]")
            else:
                return node


def parse(source: str) -> list[tuple]:
    """Syntax tree of a template: a list of nodes."""
    stack: list[tuple[str, list, Any]] = [("", [], None)]
    at, trim = 0, False

    def text(upto: int, cut: bool) -> None:
        part = source[at:upto]
        part = part.lstrip() if trim else part
        part = part.rstrip() if cut else part
        if part:
            stack[-1][1].append(("text", part))

    for m in _BLOCK.finditer(source):
        text(m.start(), "-" in (m[1], m[4]))
        at, trim = m.end(), "-" in (m[3], m[6])
        if m[2] is not None:
            stack[-1][1].append(("print", _Expression(m[2]).whole()))
            continue
        if m[5] is None:
            continue
        word, _, rest = m[5].strip().partition(" ")
        if word == "for":
            if not (loop := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                raise TemplateError("for needs 'NAME in expression'")
            stack.append(("for", [], (loop[1], _Expression(loop[2]).whole())))
        elif word == "if":
            stack.append(("if", [], [(_Expression(rest).whole(), None)]))
        elif word in ("elif", "else"):
            kind, body, arms = stack.pop()
            if kind != "if" or arms[-1][0] is None:
                raise TemplateError(f"{word} outside if")
            arms[-1] = (arms[-1][0], body)
            stack.append(("if", [], [*arms, (_Expression(rest).whole() if word == "elif" else None, None)]))
        elif word == "set":
            if not (given := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", rest, re.S)):
                raise TemplateError("set needs 'NAME = expression'")
            stack[-1][1].append(("set", given[1], _Expression(given[2]).whole()))
        elif word == "generation":
            stack.append(("generation", [], None))
        elif word in ("endfor", "endif", "endgeneration"):
            kind, body, more = stack.pop()
            if kind != word[3:]:
                raise TemplateError(f"{word} without {word[3:]}")
            if kind == "if":
                more[-1] = (more[-1][0], body)
                node: tuple = ("if", more)
            else:
                node = (kind, body, more)
            stack[-1][1].append(node)
        else:
            raise TemplateError(f"unknown block {word!r}")
    text(len(source), False)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return stack[0][1]


# Constant folding.


def fold(node: Any, filters: dict[str, Callable[[str], str]]) -> Any:
    """The tree with constant expressions computed, constant arms chosen and texts joined."""
    if isinstance(node, list):
        out: list[tuple] = []
        for part in node:
            new = fold(part, filters)
            for n in new if isinstance(new, list) else [new]:
                if n[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + n[1])
                else:
                    out.append(n)
        return out
    kind = node[0]
    if kind == "print":
        value = fold(node[1], filters)
        return ("text", _shown(value[1])) if value[0] == "const" else ("print", value)
    if kind == "set":
        return ("set", node[1], fold(node[2], filters))
    if kind == "for":
        return ("for", fold(node[1], filters), (node[2][0], fold(node[2][1], filters)))
    if kind == "generation":
        return ("generation", fold(node[1], filters), None)
    if kind == "if":
        arms = []
        for test, body in node[1]:
            test = ("const", True) if test is None else fold(test, filters)
            if test[0] == "const" and not test[1]:
                continue
            arms.append((test, fold(body, filters)))
            if test[0] == "const":
                break
        return [] if not arms else arms[0][1] if arms[0][0][0] == "const" else ("if", arms)
    if kind in ("and", "or", "not", "==", "!=", "in", "+", "item", "filter"):
        parts = [fold(p, filters) if isinstance(p, tuple) else p for p in node[1:]]
        node = (kind, *parts)
        if all(p[0] == "const" for p in parts if isinstance(p, tuple)):
            return ("const", _value(node, filters)({}))
    return node


def _shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


# Closures.


def _value(node: tuple, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], Any]:
    kind, *parts = node
    if kind == "const":
        constant = parts[0]
        return lambda scope: constant
    if kind == "name":
        name = parts[0]

        def lookup(scope: dict) -> Any:
            if name not in scope:
                raise TemplateError(f"no variable {name!r}")
            return scope[name]

        return lookup
    if kind == "filter":
        if parts[0] not in filters:
            raise TemplateError(f"no filter {parts[0]!r}")
        change, inner = filters[parts[0]], _value(parts[1], filters)
        return lambda scope: change(_shown(inner(scope)))
    a = _value(parts[0], filters)
    if kind == "not":
        return lambda scope: not a(scope)
    b = _value(parts[1], filters)
    if kind == "item":

        def item(scope: dict) -> Any:
            of, key = a(scope), b(scope)
            if isinstance(of, dict):
                return of.get(key)
            if isinstance(of, list | str) and isinstance(key, int) and not isinstance(key, bool) and -len(of) <= key < len(of):
                return of[key]
            return None

        return item
    if kind == "+":

        def plus(scope: dict) -> Any:
            x, y = a(scope), b(scope)
            return x + y if isinstance(x, int) and isinstance(y, int) else _shown(x) + _shown(y)

        return plus
    if kind == "in":

        def within(scope: dict) -> bool:
            x, y = a(scope), b(scope)
            return isinstance(y, str | list | dict) and (isinstance(x, str) or not isinstance(y, str)) and x in y

        return within
    return {
        "and": lambda scope: a(scope) and b(scope),
        "or": lambda scope: a(scope) or b(scope),
        "==": lambda scope: a(scope) == b(scope),
        "!=": lambda scope: a(scope) != b(scope),
    }[kind]


def _body(nodes: list[tuple], filters: dict[str, Callable[[str], str]]) -> Callable[[dict, bool], Iterator[Piece]]:
    steps = [_step(n, filters) for n in nodes]

    def run(scope: dict, inside: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, inside)

    return run


def _step(node: tuple, filters: dict[str, Callable[[str], str]]) -> Callable[[dict, bool], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        constant = node[1]

        def plain(scope: dict, inside: bool) -> Iterator[Piece]:
            yield constant, inside

        return plain
    if kind == "print":
        value = _value(node[1], filters)

        def printed(scope: dict, inside: bool) -> Iterator[Piece]:
            yield _shown(value(scope)), inside

        return printed
    if kind == "set":
        name, value = node[1], _value(node[2], filters)

        def assign(scope: dict, inside: bool) -> Iterator[Piece]:
            scope[name] = value(scope)
            return iter(())

        return assign
    if kind == "generation":
        body = _body(node[1], filters)
        return lambda scope, inside: body(scope, True)
    if kind == "for":
        body, name, value = _body(node[1], filters), node[2][0], _value(node[2][1], filters)

        def loop(scope: dict, inside: bool) -> Iterator[Piece]:
            for i, item in enumerate(value(scope)):
                yield from body({**scope, name: item, "loop": {"index0": i, "index": i + 1, "first": i == 0}}, inside)

        return loop
    arms = [(_value(test, filters), _body(body, filters)) for test, body in node[1]]

    def choose(scope: dict, inside: bool) -> Iterator[Piece]:
        for test, body in arms:
            if test(scope):
                yield from body(scope, inside)
                return

    return choose


def compiled(source: str, filters: dict[str, Callable[[str], str]] | None = None) -> Callable[..., Iterator[Piece]]:
    """A renderer: variables in, (text, inside generation) pieces out."""
    filters = filters or {}
    body = _body(fold(parse(source), filters), filters)
    return lambda **variables: body(dict(variables), False)


# The chat format.

#: Marks of the format (fixed values).
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Strings that other readers take for control; they and the marks are escaped inside texts.
CONTROL = (TURN, SAYS, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TEMPLATE = (
    "{% for message in messages %}{{ '" + TURN + "' }}{{ message.role | escape }}{{ '" + SAYS + "' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}{{ '" + END + "' }}{% endfor %}"
)
_UNSAFE = re.compile(r"\\|(" + "|".join(map(re.escape, CONTROL)) + ")")


def escape(text: str) -> str:
    r"""Doubles backslashes and puts ``\~`` after the first character of a control string."""
    return _UNSAFE.sub(lambda m: "\\\\" if m[1] is None else m[0][0] + "\\~" + m[0][1:], text)


def unescape(text: str) -> str:
    """The text that :func:`escape` was given."""
    return re.sub(r"\\([\\~])", lambda m: "\\" if m[1] == "\\" else "", text)


def read_back(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str, int]]:
    """Turns of a rendered conversation: role, text, text under the mask, characters of output.

    Reads the output alone; it holds one turn at a time.
    """
    output, mask = "", ""
    for text, inside in pieces:
        output += text
        mask += text * inside
        if not text.endswith(END):
            continue
        while (end := output.find(END)) >= 0:
            turn, output = output[: end + len(END)], output[end + len(END) :]
            if not turn.startswith(TURN):
                raise ValueError("the output doesn't start with a turn")
            role, _, said = turn[len(TURN) : -len(END)].partition(SAYS)
            yield unescape(role), unescape(said), unescape(mask), len(turn)
            mask = ""
    if output:
        raise ValueError("the output doesn't end with a turn")


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
FORMATTED = "conv_id long, turn_no long, formatted string, loss boolean"


def _ordered(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Whole conversations in order of turn within partitions; ties by role, then text, nulls first."""
    rows = df.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _messages(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, dict[str, str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for conv, role, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                yield conv, {"role": role, "text": text}


def format_conversations(df: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The formatted pieces of every conversation in order: conv_id, turn_no, formatted, loss.

    Rows are streamed in order, so a conversation of any length takes the
    memory of a turn. Null roles and texts are empty; a null conv_id is a
    conversation of its own; repeated rows are turns each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template, {"escape": escape})
        rows: list[tuple] = []
        for conv, group in groupby(_messages(batches), key=lambda x: x[0]):
            for i, (text, inside) in enumerate(render(messages=(m for _, m in group))):
                rows.append((conv, i, text, inside))
                if len(rows) == 1024:
                    yield _batch(rows, ["conv_id", "turn_no", "formatted", "loss"], [pa.int64(), pa.int64(), pa.string(), pa.bool_()])
                    rows = []
        yield _batch(rows, ["conv_id", "turn_no", "formatted", "loss"], [pa.int64(), pa.int64(), pa.string(), pa.bool_()])

    return _ordered(df, id_col, turn_col, role_col, text_col).mapInArrow(run, FORMATTED)


def format_digests(df: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation with digests of what is read back from its formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template, {"escape": escape})
        rows: list[tuple] = []
        for conv, group in groupby(_messages(batches), key=lambda x: x[0]):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text, learned, size in read_back(render(messages=(m for _, m in group))):
                n, loss_chars, chars = n + 1, loss_chars + len(learned), chars + size
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(learned.encode())
            rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(rows) == 1024:
                yield _batch(rows, _NAMES, _TYPES)
                rows = []
        yield _batch(rows, _NAMES, _TYPES)

    return _ordered(df, id_col, turn_col, role_col, text_col).mapInArrow(run, SCHEMA)


_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
