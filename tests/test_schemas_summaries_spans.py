"""Schemas, normalisers and spans against plain Python."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from kunits.operators import schemas, spans, summaries


def found(spark, schema, values: list) -> list[list[str]]:
    said = [v if isinstance(v, str) and v.startswith("raw:") else "raw:" + json.dumps(v, ensure_ascii=False) for v in values]
    df = spark.createDataFrame([(i, s[4:]) for i, s in enumerate(said)], "i int, doc string")
    return [r.e for r in df.select("i", schemas.violations(F.col("doc"), schema).alias("e")).orderBy("i").collect()]


def test_card_dates(spark):
    """Dates and times with a zone; what follows them isn't ignored."""
    created = {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2}))?$"}
    good = ["2026-07-15", "2026-07-15T05:05:46Z", "2026-07-15T05:05:46.715Z", "2026-07-15T13:05:46+08:00"]
    bad = ["2026-07-15Tanything", "2026-07-15garbage", "2026-07-15T05:05:46.715Zsuffix", "2026-07-15T05:05:46"]
    assert found(spark, created, good + bad) == [[]] * 4 + [["$:pattern"]] * 4


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"type": "integer"}, [1, -3, 2.0, 10**19], [1.5, "1", True, None, [], {}]),
        ({"type": ["number", "null"]}, [1, 1.5, None, 1e300], ["1", False]),
        ({"enum": ["a", 1, None, True, [1, {"b": 2}]]}, ["a", 1, 1.0, None, True, [1, {"b": 2}]], ["b", 2, False, [1], {}]),
        ({"const": "é"}, ["é"], ["e", None]),
        ({"minLength": 2, "maxLength": 3}, ["ab", "日本語", 5, None], ["a", "abcd"]),
        ({"minimum": 1, "exclusiveMaximum": 3}, [1, 2.99, "9"], [0.9, 3]),
        ({"multipleOf": 0.1}, [0.3, 1, "x"], [0.35]),
        ({"items": {"type": "string"}, "minItems": 1, "maxItems": 3, "uniqueItems": True}, [["a"], ["a", "b"], "no array"], [[], ["a", "a"], ["a", "b", "c", "d"]]),
        ({"minProperties": 1, "maxProperties": 2}, [{"a": 1}, 3], [{}, {"a": 1, "b": 2, "c": 3}]),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["x", 5, True], [1]),
        ({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, [1, 5.5], [7, 1.5]),
        ({"not": {"type": "string"}}, [1], ["x"]),
        ({"format": "date"}, ["2024-02-29", 4], ["2023-02-29", "2024-1-1", "x"]),
        ({"format": "date-time"}, ["2024-02-29T01:02:03Z"], ["2024-02-29T01:02:03", "2023-02-29T01:02:03Z"]),
    ],
)
def test_keywords(spark, schema, good, bad):
    errors = found(spark, schema, good + bad)
    assert errors[: len(good)] == [[]] * len(good)
    assert all(errors[len(good) :])


NESTED = {
    "type": "object", "required": ["id", "lines", "a.b"], "additionalProperties": {"type": "boolean"},
    "properties": {"id": {"type": "integer"}, "a.b": {"type": "string"}, "lines": {"type": "array", "items": {"allOf": [{"$ref": "#/$defs/line"}, {"required": ["note"]}]}}},
    "$defs": {"line": {"type": "object", "properties": {"n": {"minimum": 1}, "parts": {"items": {"items": {"enum": ["x", "y"]}}}}, "additionalProperties": False}},
}


def test_paths_of_nested_violations(spark):
    values = [
        {"id": 1, "a.b": "", "lines": [], "flag": True}, {"id": "1", "lines": [{"n": 0, "parts": [["x"], ["z", "y", 3]]}, 7], "other": 3}, [], None, "raw:", "raw:nope", 'raw:{"id":1,"id":2}', {"id": None, "a.b": "s", "lines": None},
    ]
    assert found(spark, NESTED, values) == [
        [],
        ["$.a.b:required", "$.id:type", "$.lines[0].n:minimum", "$.lines[0].parts[1][0]:enum", "$.lines[0].parts[1][2]:enum", "$.lines[0].note:required", "$.lines[1]:type", "$.other:type"],
        ["$:type"], ["$:type"], ["$:not_json"], ["$:not_json"], ["$:not_json"], ["$.id:type", "$.lines:type"],
    ]


def test_false_closes_and_true_opens(spark):
    assert found(spark, {"properties": {"a": False, "b": True}}, [{"a": 1, "b": 1}, {"b": 2}]) == [["$.a:false"], []]
    assert found(spark, {"additionalProperties": False}, [{"a": 1, "b": 2}, {}]) == [["$.a:additional", "$.b:additional"], []]


@pytest.mark.parametrize("schema", [{"type": "text"}, {"if": {}}, {"$ref": "#/nowhere"}, {"$ref": "other.json"}, {"format": "colour"}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}])
def test_schemas_that_are_refused(spark, schema):
    with pytest.raises(schemas.SchemaError):
        schemas.violations(F.lit("1"), schema)


def test_null_documents(spark):
    df = spark.createDataFrame([(None,)], "doc string")
    assert df.select(schemas.violations(F.col("doc"), {"type": "null"}).alias("e")).head().e == ["$:not_json"]


# Normalisers

ATOMS = "doc string, atom_id string, content_point_ids array<string>, point_ids array<string>, title string"
POINTS, EVIDENCE, BLOCKS = "doc string, point_id string, evidence_ids array<string>", "doc string, evidence_id string, quote string, block_id string", "doc string, block_id string, text string, card_eligible boolean"


def test_atoms_need_explicit_known_points(spark):
    atoms = [
        ("d", "a", ["P1"], None, "content"), ("d", "b", None, ["P2"], "beside the content"), ("d", "c", None, None, "none"), ("d", "e", [], [" "], "blank"), ("d", "f", ["ZZZ"], None, "unknown"), ("d", "g", ["ZZZ", "P3", None, "P1", "P3"], ["P2"], "several"),
        ("e", "a", ["P1"], None, "other document"), (None, "h", ["P1"], None, "no document"), ("d", "i", ["P4"], None, "point without evidence"),
    ]
    points = [("d", "P1", ["E1", "E2"]), ("d", "P2", ["E9", "E2"]), ("d", "P3", ["E3"]), ("d", "P4", None), ("f", "P1", ["E1"])]
    evidence = [("d", "E1", "Q1", "b1"), ("d", "E2", "Q2", "b2"), ("d", "E3", "Q3", None), ("d", "E3", "Q3", None), ("e", "E1", "other", "b1")]
    kept, counts = summaries.normalise_atoms(spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(points, POINTS), spark.createDataFrame(evidence, EVIDENCE), "doc")
    rows = {r.atom_id: (r.point_ids, r.evidence_quote, r.evidence_block, r.title) for r in kept.collect()}
    assert rows == {"a": (["P1"], "Q1", "b1", "content"), "b": (["P2"], "Q2", "b2", "beside the content"), "g": (["P3", "P1"], "Q3", None, "several"), "i": (["P4"], None, None, "point without evidence")}
    assert counts.get == {"atoms": 9, "kept": 4, "dropped_no_point_attribution": 2, "dropped_point_id_mismatch": 3, "unknown_point_ids": 4}


def test_atoms_of_a_batch_without_attribution(spark):
    """Not even a single point is attributed by guess."""
    kept, counts = summaries.normalise_atoms(spark.createDataFrame([("d", "a", None, None, "x")], ATOMS), spark.createDataFrame([("d", "P1", ["E1"])], POINTS), spark.createDataFrame([("d", "E1", "Q", "b")], EVIDENCE), "doc")
    assert kept.count() == 0
    assert (counts.get["dropped_no_point_attribution"], counts.get["kept"]) == (1, 0)


def test_counts_are_those_of_a_second_count(spark):
    r = random.Random(3)
    atoms = [(f"d{i % 7}", f"a{i}", [f"P{r.randrange(9)}" for _ in range(r.randrange(3))] or None, None, "t") for i in range(400)]
    points = [(f"d{d}", f"P{p}", [f"E{p}"]) for d in range(7) for p in range(0, 9, 2)]
    kept, counts = summaries.normalise_atoms(spark.createDataFrame(atoms, ATOMS).repartition(6), spark.createDataFrame(points, POINTS), spark.createDataFrame([("d0", "E0", "q", "b")], EVIDENCE), "doc")
    kept.write.format("noop").mode("overwrite").save()
    named = [(bool(ids), any(int(p[1:]) % 2 == 0 for p in ids or ())) for _, _, ids, *_ in atoms]
    assert counts.get == {
        "atoms": 400, "kept": sum(b for _, b in named), "dropped_no_point_attribution": sum(not a for a, _ in named), "dropped_point_id_mismatch": sum(a and not b for a, b in named),
        "unknown_point_ids": sum(len({p for p in ids or () if int(p[1:]) % 2}) for _, _, ids, *_ in atoms),
    }


def test_summaries_keep_what_the_source_says(spark):
    blocks = [("d", "block-a", "What the plan covers.", True), ("d", "block-b", "Ｐumps run only after two inspections.", True), ("d", "block-c", "Twice here.", True), ("d", "block-d", "Twice here.", True)]
    evidence = [("d", f"EV-{i}", f"nobody wrote this {i}", "block-a") for i in range(12)] + [("d", "EV-moved", "Pumps run only  after two inspections.", "block-a"), ("d", "EV-twice", "Twice", None), ("d", "EV-hint", "Twice", "block-d")]
    points = [("d", f"P{i}", [f"EV-{i}"]) for i in range(12)] + [("d", "P-valid", ["EV-0", "EV-moved", "EV-none"]), ("d", "P-twice", ["EV-twice"]), ("d", "P-hint", ["EV-hint"]), ("d", "P-bare", None)]
    kept, whole, of_points, of_evidence = summaries.normalise_summary(spark.createDataFrame(points, POINTS), spark.createDataFrame(evidence, EVIDENCE), spark.createDataFrame(blocks, BLOCKS), "doc")
    assert {r.point_id: r.evidence_ids for r in kept.collect()} == {"P-valid": ["EV-moved"], "P-hint": ["EV-hint"]}
    placed = {r.evidence_id: (r.provenance.status, r.provenance.block_id) for r in whole.collect()}
    assert (placed["EV-moved"], placed["EV-twice"], placed["EV-hint"], placed["EV-3"]) == (("resolved", "block-b"), ("ambiguous_quote", None), ("resolved", "block-d"), ("quote_not_found", None))
    assert of_points.get == {"points": 16, "kept": 2, "dropped_points": 14, "dropped_evidence_ids": 15}
    assert of_evidence.get == {"evidence": 15, "resolved": 2, "quote_not_found": 12, "ambiguous_quote": 1}


# Spans

TEXTS = ["", None, "plain", "  leading and   double\n\nspaces \t", "\x01\x02ab\x03c \x04 d\x05", "a" * 25, " \x01 \x02 ", "日本\r\n語  テキスト🙂 end", "\x00" * 9, "x \x1f\x1f y"]


def normal(text: str) -> str:
    return re.sub(r"[ \t\n\x0b\f\r]+|[\x00-\x08\x0e-\x1f\x7f]+", lambda m: " " if m[0][0] in " \t\n\x0b\f\r" else "", text)


@pytest.mark.parametrize("most", [1, 2, 5, 7, 6000])
def test_spans_cut_the_chunks_out_of_the_source(spark, most):
    r = random.Random(most)
    texts = TEXTS + ["".join(r.choice("ab \n\x01\x02é") for _ in range(r.randrange(80))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("chunk", F.lit("own"))
    by: dict[int, list] = {}
    for row in spans.chunks(df, "id", most=most).collect():
        by.setdefault(row.id, []).append(row)
    assert sorted(by) == list(range(len(texts)))
    for i, rows in by.items():
        text = texts[i] or ""
        rows.sort(key=lambda row: row.chunk_no)
        assert [row.chunk_no for row in rows] == list(range(len(rows)))
        assert "".join(row.chunk for row in rows) == normal(text)
        assert all(len(row.chunk) <= most for row in rows)
        assert [rows[0].source_start, *(row.source_end for row in rows)] == [0, *(row.source_start for row in rows[1:]), len(text)]
        assert all(row.bounded == (len(rows) > 1) for row in rows)
        assert len({row.chunk_id for row in rows}) == len(rows)
        for row in rows:
            assert normal(text[row.source_start : row.source_end]) == row.chunk
            for k, c in enumerate(row.chunk):
                piece = [p for p in row.pieces if p["at"] <= k][-1]
                at = piece["source"] + k - piece["at"]
                assert normal(text[at]) == c


def test_fixtures_of_two_lengths(spark):
    rows = spans.chunks(spark.createDataFrame([("long", "字" * 11371), ("short", "字" * 780)], "id string, text string"), "id").collect()
    assert sorted((r.id, len(r.chunk), r.bounded) for r in rows) == [("long", 5371, True), ("long", 6000, True), ("short", 780, False)]


def test_long_replacements_are_not_cut(spark):
    rules = ((r"&", "and"), (r"\s+", ""))
    df = spark.createDataFrame([(1, "a & b&c  &d& & e")], "id int, text string")
    rows = sorted(spans.chunks(df, "id", most=4, rules=rules).collect(), key=lambda r: r.chunk_no)
    text = "a & b&c  &d& & e"
    assert "".join(r.chunk for r in rows) == "aandbandcanddandande"
    for r in rows:
        assert re.sub(r"\s+", "", text[r.source_start : r.source_end].replace("&", "and")) == r.chunk and len(r.chunk) <= 4
    with pytest.raises(ValueError, match="replacement"):
        spans.chunks(df, "id", most=2, rules=rules)
    with pytest.raises(ValueError, match="groups"):
        spans.Normaliser(((r"(a)", "b"),))


def test_places_of_quotes_in_the_source(spark):
    text = "one   two\n\n\nthree \x01four"
    df = spans.chunks(spark.createDataFrame([(1, text)], "id int, text string"), "id")
    places = df.select(*(spans.source_place(F.col("pieces"), F.instr("chunk", word) - 1).alias(word) for word in ("one", "two", "three", "four"))).head()
    assert {word: places[word] for word in ("one", "two", "three", "four")} == {word: text.index(word) for word in ("one", "two", "three", "four")}


def test_gate_stops_where_nothing_is_supported(spark):
    made = spans.chunks(spark.createDataFrame([("a", "x" * 30), ("b", "y" * 30), ("c", "z" * 5)], "id string, text string"), "id", most=10)
    ids = {(r.id, r.chunk_no): r.chunk_id for r in made.collect()}
    good = [("b", ids["b", 0]), ("b", ids["b", 0]), ("c", ids["c", 0]), ("a", ids["b", 1])]
    got = {r.id: (r.n_chunks, r.n_supported, r.status) for r in spans.gate(made, spark.createDataFrame(good, "id string, chunk_id string"), "id").collect()}
    assert got == {"a": (3, 0, "all_unsupported"), "b": (3, 1, "partial"), "c": (1, 1, "complete")}


def test_a_space_for_a_space_is_no_piece():
    """plain words are one piece, not two a word; places are as they were."""
    normal = spans.Normaliser(spans.RULES)
    whole, starts, sources, put = normal("a b  c\x01 d e\nf")
    assert whole == "a b c d e f"
    place = [int(sources[i] + p - starts[i]) for p in range(len(whole)) for i in [int((starts <= p).sum()) - 1]]
    assert place == [0, 1, 2, 3, 5, 7, 8, 9, 10, 11, 12]
    assert len(normal("one two three")[1]) == 1
