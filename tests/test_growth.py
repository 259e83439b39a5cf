"""What grows with the input: how often a plan does a thing, and whether it does it in one place."""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F

from kunits import session
from kunits.functions import lang, text
from kunits.operators import blocks, ops, provenance, schemas, segment, similar, units
from kunits.plans import pipeline, queries


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_missing_ids_are_dealt(spark):
    atoms = spark.range(2000).select(F.lit(1).alias("source_document_id"), F.col("id").alias("atom_id"), F.when(F.col("id") % 4 > 0, F.array("id", F.col("id") + 10_000)).alias("point_ids"))
    points = spark.range(2000).select(F.lit(1).alias("source_document_id"), F.col("id").alias("point_id"), F.when(F.col("id") % 4 > 1, F.array("id", F.lit(None).cast("long"))).otherwise(F.array().cast("array<long>")).alias("evidence_ids"))
    evidence = spark.range(0, 2000, 3).select(F.lit(1).alias("source_document_id"), F.col("id").alias("evidence_id"))
    links, dropped = provenance.point_atoms(atoms, points, evidence)
    with_evidence = [i for i in range(2000) if i % 4 > 1]
    held = {i for i in with_evidence if i % 3 == 0}
    assert {tuple(r) for r in links.collect()} == {(1, i, i, i) for i in held}
    want = {"no_attribution": 500, "unknown_point": 1500, "missing_evidence": 500 + 2 * len(with_evidence) - len(held)}
    assert {r.dropped: r.n for r in dropped.collect()} == want
    assert all("_deal" in line for line in _plan(dropped).splitlines() if "Join LeftOuter" in line)


def test_renderings_run_where_their_words_are(spark):
    words = ["shall", "Shall Not", "must", "may", "may_be", "risks", "Risk", "requirement事項", "禁止", "工程", "リスク", "action items", "process", "rеquired", "required to", "べき", "x", "。", "processing"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(words) + rng.choice([" ", "", "-", "工"]) for _ in range(8)) for _ in range(300)]

    def plain(column):
        for pattern, replacement in lang.RENDERINGS:
            column = F.regexp_replace(column, text.ascii_edges(pattern), replacement)
        return column

    rows = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
    got = rows.select(lang.deterministic_chinese(F.col("t"))["text"].alias("got"), plain(F.col("t")).alias("want"))
    assert [r for r in got.collect() if r.got != r.want] == []
    assert "exists(" in _plan(rows.select(lang.deterministic_chinese(F.col("t"))["text"]))


def test_facts_start_where_their_first_character_is(spark):
    words = ["2024-01-05", "12024-01", "x2024/3", "3月5日", "AB-123", "xAB-123", "_AB12", "ISO 9001", "iso9001", "XISO 1", "GB/T-5.", "Foo-bar/baz", "foo-Bar", "éFoo-bar", "5 MPa"]
    rng = random.Random(5)
    rows = spark.createDataFrame([("".join(rng.choice(words) + rng.choice([" ", "", ",", "日", "é", "_"]) for _ in range(6)),) for _ in range(300)], "t string")
    kinds = [(lang.DATE, True, "[0-9]"), (lang.MODEL, True, "[A-Z]"), (lang.STANDARD, False, "[ADEGIJ]"), (lang.NAME, True, "[A-Z]")]
    pairs = rows.select(*(F.struct(lang._extract(F.col("t"), p, case=c, first=f).alias("got"), lang._extract(F.col("t"), p, case=c).alias("want")) for p, c, f in kinds))
    assert all(x["got"] == x["want"] for r in pairs.collect() for x in r)
    assert "(?=[ADEGIJ])(?<!" in _plan(rows.select(lang.protected_tokens(F.col("t"))))


def test_only_texts_beyond_ascii_are_normalised_in_python(spark):
    values = ["plain", "", None, "ﬁne", "é", "全角Ａ", *("é%d" % i for i in range(600))]
    rows = spark.createDataFrame([(v,) for v in values], "t string")
    assert [r[0] for r in rows.select(text.nfkc(F.col("t"))).collect()] == [v if v is None else unicodedata.normalize("NFKC", v) for v in values]
    assert "octet_length" in _plan(rows.select(text.nfkc(F.col("t"))))


def test_kinds_are_tried_once(spark):
    rows = spark.createDataFrame([("a", "x must y")], "n string, t string")
    kind = F.when(F.col("n") == "b", "noise").otherwise(lang.dominant_kind(F.col("t")))
    assert rows.select(kind).first()[0] == "requirement"
    assert _plan(rows.select(kind)).count("retrospective") < 4


def test_merged_rows_without_python(spark):
    rng = random.Random(11)
    rows = [(doc, n, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, "x" * rng.randrange(9)])) for doc in range(40) for n in range(60)]
    want = {}
    for doc in range(40):
        number, held, last = 0, 0, ()
        for _, n, k, t in (r for r in rows if r[0] == doc):
            size = len(t or "")
            if last == (k,) and held + size < 20:
                held += size + 1
            else:
                number, held, last = number + 1, size, (k,)
            want[doc, n] = number
    rng.shuffle(rows)
    got = segment.merge_adjacent(spark.createDataFrame(rows, "doc long, ord int, k string, t string"), ["k"], "doc", "ord", "t", most=20)
    assert got.columns == ["doc", "ord", "k", "t", "merged"]
    assert {(r.doc, r.ord): r.merged for r in got.collect()} == want
    assert "Pandas" not in _plan(got)


def test_leaders_read_signatures_that_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def mark(i):
        made.add(1)
        return i % 7 * 0x111

    rows = spark.range(60).select((F.col("id") % 3).alias("group"), "id", F.udf(mark, "long")("id").alias("mark"))
    assert similar.leader_groups(rows, ["group"], "id", 2).count() == 60
    assert made.value == 60


def test_parts_follow_the_rows(spark):
    assert session.parts_of(spark.range(1000), rows=10) == 100
    atoms = spark.createDataFrame([(1, [5, 6]), (2, [6]), (3, [7])], "card_id long, point_ids array<long>")
    points, refused = ops.regeneration_plan(spark.createDataFrame([(1,), (3,), (4,)], "card_id long"), atoms)
    assert ([r[0] for r in points.collect()], sorted(r[0] for r in refused.collect())) == ([7], [1, 4])
    assert "RepartitionByExpression [point_id" in _plan(points) and "RepartitionByExpression [card_id" in _plan(refused)


def test_schemas_look_into_a_value_once(spark):
    """Keys are looked up, not listed; a value is bound without an array of one."""
    rows = spark.createDataFrame([('{"id":1,"lines":[{"n":1},{"n":"x"},{"m":null},7]}',), ('{"id":null}',), ("[]",)], "doc string")
    line = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "m": {"type": "null"}}}
    errors = schemas.violations(F.col("doc"), {"type": "object", "required": ["id"], "properties": {"id": {"type": ["integer", "null"]}, "lines": {"items": {"$ref": "#/$defs/line"}}}, "$defs": {"line": line}})
    got = rows.select("doc", errors.alias("e"))
    assert [r.e for r in got.collect()] == [["$.lines[1].n:type", "$.lines[2].n:required", "$.lines[3]:type"], [], ["$:type"]]
    plan = _plan(got)
    assert "map_keys" not in plan and "transform(array(" not in plan


def _documents(spark):
    """Documents with lifecycle words within and beyond the characters of a profile, on its edge, with long runs, noise, copies and without texts."""
    long = "x" * 99_990
    texts = [
        "must do\nmust do more\nPage 3\n\nrisk of x\n第 2 页\nthe end", "报价与合同\nactive\nプロセス 工程", None, "", "  \n\t", "ﬁne e\u0301\nA\u030a must", f"{long}\ncompleted", f"{long}\ncomp\ncompleted", f"{'y' * 100_001}\ncompleted", f"{'z ' * 40_000}\nactive\n{'z ' * 9_000}\ncompleted",
        "\n".join(["must " + "a" * 3000] * 20), "\n".join(["method"] * 30), "active", "completed\nactive", "招标 tender\n已完成",
    ]
    return spark.createDataFrame([*enumerate(texts), (None, "must\nlost"), (3, "twice\nrisk")], "doc_id long, text string")


def test_counts_are_the_telemetry_of_the_whole_pipeline(spark):
    docs = _documents(spark)
    whole = pipeline.run(pipeline.raw_lines(docs), scoped=False)
    want = sorted(map(str, whole["telemetry"].collect()))
    assert sorted(map(str, pipeline.counts(pipeline.raw_lines(docs), scoped=False).collect())) == want
    assert sorted(map(str, pipeline.counts(pipeline.raw_lines(docs, dealt=True), scoped=False, dealt=True).collect())) == want
    outline = segment.outline(whole["regions"])
    kept = ["unit_id", "fingerprint", "ord", "region_ids", "route.ambiguous"]
    assert sorted(map(str, units.outlined(outline).select(*kept).collect())) == sorted(map(str, whole["units"].select(*kept).collect()))
    of = lambda df: {tuple(r) for r in df.select("source_document_id", "lifecycle").distinct().collect()}
    assert of(outline) == of(whole["profiles"])
    assert {life for _, life in of(outline)} == {"completed", "active", "unknown"}


def test_telemetry_writes_no_texts(spark, monkeypatch):
    """Texts are cleaned once and dealt once; what is written are outlines."""
    written, stored = {}, session.Scratch.stored

    def noted(self, df, name):
        written[name] = (df.columns, _plan(df))
        return stored(self, df, name)

    monkeypatch.setattr(session.Scratch, "stored", noted)
    assert queries.universal_telemetry(spark, "/root/testdata/sf0.001").count() == 200
    assert not {"text", "blocks", "statement", "evidence"} & {c for columns, _ in written.values() for c in columns}
    assert written["regions"][1].count("_nfkc(") == 1 and "Join" not in written["regions"][1]


def test_clean_texts_without_a_second_look(spark):
    rows = spark.createDataFrame([("a", "x\x00"), ("header", " \n"), ("page_break", ""), ("a", "\x01 "), ("a", None), ("a", "ﬁ")], "kind string, text string")
    kept = [(r.kind, r.text) for r in blocks.cleaned(rows).collect()]
    assert kept == [("a", "x"), *((k, "") for k in ("header", "page_break") if k in blocks.LAYOUT_KINDS), ("a", "fi")]
    assert _plan(blocks.cleaned(rows)).count("_nfkc(") == 1


def test_stable_characters():
    """Each is its own NFKC, and none is joined with the one before it."""
    import re

    stable = re.compile(f"[{text.STABLE}]")
    chars = [chr(c) for c in range(0x110000) if stable.match(chr(c))]
    joined = {parts[1] for c in range(0x110000) if len(parts := unicodedata.decomposition(chr(c)).split()) == 2 and not parts[0].startswith("<")}
    assert len(chars) > 20_000 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in chars)
    assert not joined & {f"{ord(c):04X}" for c in chars}


def test_literals_of_han_are_looked_for_where_han_is(spark):
    words = ["必须", "shall", "SHALL", "É", "follow-up", "Follow up", "followup", "follow", "リスク", "5 mm", "5 mmx", "型号", "ß", "\u212a", "action", "报价", "прайс", "しなければならない"]
    rng = random.Random(9)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(4))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    plain = {k: sum((F.col("t").rlike("(?i)" + text.ascii_edges(p)).cast("int") for p in ps), F.lit(0)) for k, ps in lang.SIGNALS.items()}
    found = rows.select(lang.semantic_signals(F.col("t")).alias("got"), F.struct(*(n.alias(k) for k, n in plain.items())).alias("want"), "t").collect()
    assert [r.t for r in found if r.got != r.want] == []
    assert ".wide" in _plan(rows.select(lang.dominant_kind(F.col("t"))))


def test_lines_of_noise_by_their_first_character(spark):
    lines = ["第 3 页", "第3页", "PAGE 4", "page  5", "目录", "Table Of Contents", "table of contents ", "xpage 5", "签字：", "Signature:", "签名", "免责声明", "DISCLAIMER", "disclaimer x", "", "t", "第"]
    rows = spark.createDataFrame([(t,) for t in lines], "t string")
    made = blocks.noise_reason(F.col("t"), F.lit("paragraph"), F.lit(1), F.lit(False))
    want = F.when(F.col("t") == "", "空内容").when(F.col("t").rlike(blocks.PAGE_OR_CONTENTS), "页码或目录").when(F.col("t").rlike(blocks.BARE_SIGNATURE), "无义务内容的签名或声明").otherwise("")
    assert [r for r in rows.select("t", made.alias("got"), want.alias("want")).collect() if r.got != r.want] == []
