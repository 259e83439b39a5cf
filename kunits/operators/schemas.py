"""JSON Schema as columns: a nested schema is compiled to one array of labelled violations.

Values stay in the JVM as variants. Each violation is ``path:keyword``, with
paths such as ``$.lines[3].quantity``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ANNOTATIONS = frozenset(("$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"))
ASSERTIONS = frozenset((
    "type", "enum", "const", "minLength", "maxLength", "pattern", "format", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "items", "minItems", "maxItems", "uniqueItems",
    "properties", "required", "additionalProperties", "minProperties", "maxProperties", "anyOf", "allOf", "oneOf", "not", "$ref",
))
OF_OBJECTS = frozenset(("properties", "required", "additionalProperties", "minProperties", "maxProperties"))
OF_ARRAYS = frozenset(("items", "minItems", "maxItems", "uniqueItems"))
#: Keywords that only hand the value on to other schemas.
OF_SCHEMAS = frozenset(("anyOf", "allOf", "oneOf", "not", "$ref"))
FORMATS = {"date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$", "date-time": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$", "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"}


class SchemaError(ValueError):
    """A schema that can't be compiled whole; nothing is left unchecked silently."""


def _none() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """*then* of a value that is computed once. Cheaper where it nests than an array of one: nothing is copied, no type is asked for in a row."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, then)


class Compiler:
    """Compiles a schema; references are to its own definitions and must end."""

    def __init__(self, schema: dict | bool):
        self.root = schema

    def referred(self, ref: str) -> dict | bool:
        here = self.root
        for part in ref.removeprefix("#").strip("/").split("/"):
            if not ref.startswith("#/") or not isinstance(here, dict) or part not in here:
                raise SchemaError(f"unknown reference {ref}")
            here = here[part]
        return here

    def errors(self, schema: dict | bool, value: Column, path: Column, refs: tuple[str, ...] = ()) -> Column:
        """Violations (array of strings) of a value that is there, in the order of the checks."""
        if schema is True or schema == {}:
            return _none()
        if schema is False:
            return F.array(F.concat(path, F.lit(":false")))
        if unknown := set(schema) - ANNOTATIONS - ASSERTIONS:
            raise SchemaError(f"keywords that aren't supported: {sorted(unknown)}")
        if not set(schema) - ANNOTATIONS - OF_SCHEMAS:
            return self._checked(schema, value, F.lit(""), None, None, path, refs)
        kinds = schema.get("type", ())

        def within(held: Column | None, items: Column | None) -> Column:
            # The schema of an object or array is that of all it holds, so it is only asked for where there is neither.
            shape = F.schema_of_variant(value)
            for inside, kind in ((items, "ARRAY"), (held, "OBJECT")):
                shape = shape if inside is None else F.when(inside.isNotNull(), F.lit(kind)).otherwise(shape)
            return let(shape, lambda s: self._checked(schema, value, s, held, items, path, refs))

        def with_items(held: Column | None) -> Column:
            if not OF_ARRAYS & set(schema) and "array" not in kinds:
                return within(held, None)
            return let(F.try_variant_get(value, "$", "array<variant>"), lambda items: within(held, items))

        if not OF_OBJECTS & set(schema) and "object" not in kinds:
            return with_items(None)
        return let(F.try_variant_get(value, "$", "map<string,variant>"), with_items)

    def _checked(self, schema: dict, value: Column, shape: Column, held: Column | None, items: Column | None, path: Column, refs: tuple[str, ...]) -> Column:
        simple: list[Column] = []
        label = lambda keyword: F.concat(path, F.lit(f":{keyword}"))

        def unless(keyword: str, holds: Column, applies: Column | None = None) -> None:
            wrong = ~F.coalesce(holds, F.lit(False))
            simple.append(F.when(wrong if applies is None else applies & wrong, label(keyword)))

        if "type" in schema:
            wanted = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            unless("type", reduce(lambda a, b: a | b, (self.is_a(t, value, shape) for t in wanted)))
        for keyword, among in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
            if among is not None:
                texts = [x for x in among if isinstance(x, str)]
                tests = [self.equals(value, shape, x) for x in among if not isinstance(x, str)]
                if texts:
                    tests.insert(0, (shape == "STRING") & F.try_variant_get(value, "$", "string").isin(texts))
                unless(keyword, reduce(lambda a, b: a | b, tests, F.lit(False)))
        self._text(schema, value, shape, unless)
        self._number(schema, value, shape, unless)
        more: list[Column] = []
        self._array(schema, items, shape, path, refs, unless, more)
        if OF_OBJECTS & set(schema):
            more.append(F.when(shape.startswith("OBJECT"), self._object(schema, held, path, refs)).otherwise(_none()))
        right = lambda sub: F.size(self.errors(sub, value, path, refs)) == 0
        if "anyOf" in schema:
            unless("anyOf", reduce(lambda a, b: a | b, map(right, schema["anyOf"])))
        if "oneOf" in schema:
            unless("oneOf", reduce(lambda a, b: a + b, (right(s).cast("int") for s in schema["oneOf"])) == 1)
        if "not" in schema:
            unless("not", ~right(schema["not"]))
        more += [self.errors(s, value, path, refs) for s in schema.get("allOf", ())]
        if "$ref" in schema:
            ref = schema["$ref"]
            if ref in refs:
                raise SchemaError(f"reference {ref} has no end")
            more.append(self.errors(self.referred(ref), value, path, (*refs, ref)))
        found = [*([F.array_compact(F.array(*simple))] if simple else []), *more]
        return found[0] if len(found) == 1 else F.concat(*found) if found else _none()

    def is_a(self, kind: str, value: Column, shape: Column) -> Column:
        number = shape.isin("BIGINT", "DOUBLE", "FLOAT", "TINYINT", "SMALLINT", "INT") | shape.startswith("DECIMAL")
        double = F.try_variant_get(value, "$", "double")
        known = {
            "string": shape == "STRING", "number": number, "integer": number & (double % 1 == 0), "boolean": shape == "BOOLEAN", "null": shape == "VOID",
            "array": shape.startswith("ARRAY"), "object": shape.startswith("OBJECT"),
        }
        if kind not in known:
            raise SchemaError(f"unknown type {kind}")
        return known[kind]

    def equals(self, value: Column, shape: Column, given: object) -> Column:
        if given is None:
            return shape == "VOID"
        if isinstance(given, bool):
            return (shape == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == given)
        if isinstance(given, int | float):
            return self.is_a("number", value, shape) & (F.try_variant_get(value, "$", "double") == float(given))
        return F.to_json(value) == json.dumps(given, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def _text(self, schema: dict, value: Column, shape: Column, unless: Callable) -> None:
        text, applies = F.try_variant_get(value, "$", "string"), shape == "STRING"
        if "minLength" in schema:
            unless("minLength", F.char_length(text) >= schema["minLength"], applies)
        if "maxLength" in schema:
            unless("maxLength", F.char_length(text) <= schema["maxLength"], applies)
        if "pattern" in schema:
            unless("pattern", text.rlike(schema["pattern"]), applies)
        if "format" in schema:
            if schema["format"] not in FORMATS:
                raise SchemaError(f"unknown format {schema['format']}")
            real = F.lit(True) if "date" not in schema["format"] else F.substring(text, 1, 10).try_cast("date").isNotNull()
            unless("format", text.rlike(FORMATS[schema["format"]]) & real, applies)

    def _number(self, schema: dict, value: Column, shape: Column, unless: Callable) -> None:
        number, applies = F.try_variant_get(value, "$", "double"), self.is_a("number", value, shape)
        for keyword, holds in (("minimum", lambda x: number >= x), ("maximum", lambda x: number <= x), ("exclusiveMinimum", lambda x: number > x), ("exclusiveMaximum", lambda x: number < x)):
            if keyword in schema:
                unless(keyword, holds(float(schema[keyword])), applies)
        if "multipleOf" in schema:
            exact = F.try_variant_get(value, "$", "decimal(38,18)")  # in decimals, where 0.3 is a multiple of 0.1
            unless("multipleOf", exact % F.lit(str(schema["multipleOf"])).cast("decimal(38,18)") == 0, applies)

    def _array(self, schema: dict, items: Column | None, shape: Column, path: Column, refs: tuple[str, ...], unless: Callable, more: list[Column]) -> None:
        applies = shape.startswith("ARRAY")
        if "minItems" in schema:
            unless("minItems", F.size(items) >= schema["minItems"], applies)
        if "maxItems" in schema:
            unless("maxItems", F.size(items) <= schema["maxItems"], applies)
        if schema.get("uniqueItems"):
            unless("uniqueItems", F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) == F.size(items), applies)
        if "items" in schema:
            each = F.transform(items, lambda x, i: self.errors(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), refs))
            more.append(F.when(applies, F.flatten(each)).otherwise(_none()))

    def _object(self, schema: dict, held: Column, path: Column, refs: tuple[str, ...]) -> Column:
        known, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        at = lambda name: F.concat(path, F.lit(f".{name}"))
        under = lambda e: F.concat(path, F.lit("."), e["key"])

        # A value of the map is never null: JSON's null is a variant, too.
        simple = [F.when(F.try_element_at(held, F.lit(name)).isNull(), F.concat(at(name), F.lit(":required"))) for name in schema.get("required", ())]
        if "minProperties" in schema:
            simple.append(F.when(F.size(held) < schema["minProperties"], F.concat(path, F.lit(":minProperties"))))
        if "maxProperties" in schema:
            simple.append(F.when(F.size(held) > schema["maxProperties"], F.concat(path, F.lit(":maxProperties"))))
        found = [F.array_compact(F.array(*simple))] if simple else []
        for name, sub in known.items():
            found.append(let(F.try_element_at(held, F.lit(name)), lambda child: F.when(child.isNotNull(), self.errors(sub, child, at(name), refs)).otherwise(_none())))  # noqa: B023  called at once
        if other is not True:
            rest = F.filter(F.map_entries(held), lambda e: ~e["key"].isin(*known) if known else F.lit(True))
            found.append(F.transform(rest, lambda e: F.concat(under(e), F.lit(":additional"))) if other is False else F.flatten(F.transform(rest, lambda e: self.errors(other, e["value"], under(e), refs))))
        return F.concat(*found) if found else _none()


def violations(document: Column, schema: dict | bool) -> Column:
    """Violations of JSON texts, as an array of ``path:keyword``; empty where the text is right.

    A text that is no JSON (null and empty ones, and objects that name a key
    twice) has ``$:not_json`` alone. Keywords apply to values of their own
    type, as the standard says. Supported: types, enum, const; lengths,
    pattern and format of strings; bounds of numbers; items and properties,
    nested to any depth; anyOf, oneOf, allOf, not; references that end.
    Anything else in the schema is refused.
    """
    compiler = Compiler(schema)
    parsed = F.try_parse_json(document)
    # A null variant is a value (JSON's null), a null column isn't.
    return let(parsed, lambda v: F.when(v.isNull(), F.array(F.lit("$:not_json"))).otherwise(compiler.errors(schema, v, F.lit("$"))))
