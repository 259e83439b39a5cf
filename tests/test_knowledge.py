"""Blocks to units, candidates, the gate, tables, chunks, provenance, vectors."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kunits.operators import blocks as B
from kunits.operators import candidates, gate, provenance, segment, split, tables, units, vectors
from kunits.plans import pipeline
from kunits.schema import LOCATOR, RAW_BLOCKS


def raw(spark, rows: list[dict]):
    full = []
    for i, r in enumerate(rows):
        base = {"source_document_id": "d1", "block_id": f"b{i}", "ord": i, "kind": "paragraph", "text": "", "fields": {}, "hierarchy": [], "heading_path": None, "heading": None, "locator": None, "provenance": [], "parse_status": "present", "card_eligible": True, "exclusion_reason": None, "metadata": {}}
        full.append({**base, **r})
    schema = spark.createDataFrame([], RAW_BLOCKS).schema
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in full], schema)


def test_canonical_blocks(spark):
    got = {r.ord: r for r in B.canonical_blocks(raw(spark, [{"text": " ＡＢ\n c "}, {"kind": "document", "text": "x"}, {"text": ""}, {"kind": "figure"}, {"block_id": None, "text": "y", "heading": "H", "hierarchy": ["H", "G"]}])).collect()}
    assert sorted(got) == [0, 1, 3, 4]
    assert got[0].text == "AB c"
    assert (got[1].kind, got[1].source_kind) == ("text", "document")
    assert got[4].block_id.startswith("blk-")
    assert got[4].hierarchy == ["H", "G"]
    assert (got[0].locator.scheme, got[0].locator.value) == ("block", "b0")


def test_noise_and_eligibility(spark):
    rows = B.with_occurrence(B.canonical_blocks(raw(spark, [{"kind": "footer", "text": "f"}, {"kind": "footer", "text": "f"}, {"text": "第 3 页"}, {"text": "签字："}, {"text": "real", "metadata": {"noise": "true"}}, {"text": "good"}, {"text": "no", "card_eligible": None}, {"text": "no", "parse_status": "missing"}])))
    reason = B.noise_reason(F.col("text"), F.col("kind"), F.col("occurrence"), B.flag(F.col("metadata"), "noise", "structural_noise"))
    got = [r.r for r in rows.orderBy("ord").select(reason.alias("r")).collect()]
    assert got[:6] == ["重复页眉页脚", "重复页眉页脚", "页码或目录", "无义务内容的签名或声明", "适配器标记为结构噪声", ""]
    assert [r.text for r in B.eligible(rows).orderBy("ord").collect()] == ["f", "f", "第 3 页", "签字:", "good"]


def test_text_blocks_by_lines(spark):
    text = "# Title\npara one\npara two\n\n- a\n- b\n| x | y |\n|---|---|\n```\n# code\n```\nend"
    got = B.text_blocks(spark.createDataFrame([("d", text)], "source_document_id string, text string")).orderBy("ord").collect()
    assert [(r.kind, r.locator) for r in got] == [("heading", "L1"), ("paragraph", "L2-L3"), ("list", "L5-L6"), ("table", "L7-L8"), ("code_block", "L9-L11"), ("paragraph", "L12")]


def test_profiles(spark):
    blocks = B.canonical_blocks(raw(spark, [{"text": "投标人必须在工期内完成质量验收，合同付款条件如下"}, {"text": "存在风险"}]))
    docs = spark.createDataFrame([("d1", {"project_id": "P1", "client": "C"})], "source_document_id string, metadata map<string,string>")
    p = B.profiles(blocks, docs).head()
    assert p.purposes[0] == "requirement"
    assert p.lifecycle == "active"
    assert p.project_scope == ["P1"]
    assert p.entity_scope == ["C"]
    assert {"质量", "时间", "合同"} <= set(p.business_domains)
    assert p.structural_confidence == 0.65


def brute_segments(rows: list[dict]) -> list[int]:
    out, number, size, first = [], 0, 0, None
    for r in rows:
        new = first is None or "noise" in (r["k"], first["k"]) or r["h"] or r["k"] != first["k"] or size >= 8 or (r["s"] and r["s"] != first["s"])
        if new:
            number, size, first = number + 1, 0, r
        size += 1
        out.append(number)
    return out


@pytest.mark.parametrize("scoped", [True, False])
def test_segments_against_a_fold(spark, scoped):
    r = random.Random(4)
    rows, brute = [], []
    for _ in range(120):
        k = r.choice(["fact"] * 6 + ["risk", "noise"])
        heading, scope = r.random() < 0.05, r.choice(["", "", "A", "B"]) if scoped else ""
        text = {"fact": f"plain {r.random()}", "risk": f"风险 {r.random()}", "noise": "目录"}[k]
        rows.append({"text": text, "kind": "heading" if heading else "paragraph", "metadata": {"scope_id": scope} if scope else {}})
        brute.append({"k": k, "h": heading, "s": scope})
    got = segment.segments(B.canonical_blocks(raw(spark, rows)), scoped=scoped).orderBy("ord").collect()
    assert [g.segment for g in got] == brute_segments(brute)


def test_region_parents(spark):
    rows = [("d", i + 1, level, f"r{i}") for i, level in enumerate([0, 1, 1, 2, 0, 2, 1, 3])]
    got = segment.parents(spark.createDataFrame(rows, "doc string, segment int, level int, region_id string"), "doc").orderBy("segment").collect()
    assert [g.parent_region_id for g in got] == [None, "r0", "r0", "r2", None, "r4", "r4", "r6"]


def test_merge_adjacent_with_a_limit(spark):
    rows = [(1, i, "a" if i < 6 else "b", "x" * 30) for i in range(9)]
    got = segment.merge_adjacent(spark.createDataFrame(rows, "doc long, ord int, k string, t string"), ["k"], "doc", "ord", "t", most=100).orderBy("ord").collect()
    assert [g.merged for g in got] == [1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_units_cover_every_region(spark):
    rows = [{"text": "目录"}, {"text": "投标人必须提交保函"}, {"text": "投标人必须按期开工"}, {"kind": "heading", "text": "风险说明"}, {"text": "存在安全隐患，可能导致事故", "metadata": {"project_id": "P9"}}, {"text": "普通说明文字"}]
    out = pipeline.run(raw(spark, rows))
    statuses = {r.status for r in out["coverage"].collect()}
    assert statuses <= {"covered", "merged", "dropped"}
    assert out["coverage"].count() == out["regions"].count()
    assert out["gaps"].count() == 0
    got = {u.semantic_kind: u for u in out["units"].collect()}
    assert got["requirement"].reusable
    assert got["risk"].project_ids == ["P9"]
    assert got["risk"].route.ambiguous is False or got["risk"].status == "unknown"
    assert all(u.unit_id == "ku-" + u.fingerprint[:24] for u in got.values())
    t = out["telemetry"].head()
    assert t.semantic_coverage == 1.0
    assert t.rejected == 1
    reviewed = {i for r in out["reviews"].collect() for i in r.unit_ids}
    assert reviewed == {u.unit_id for u in got.values() if u.route.ambiguous}


def test_units_do_not_depend_on_row_order(spark):
    rows = [{"text": f"text {i} 必须" if i % 3 else "风险"} for i in range(30)]
    a = pipeline.run(raw(spark, rows))["units"]
    b = pipeline.run(raw(spark, rows).repartition(7))["units"]
    key = lambda df: sorted(map(str, df.select("unit_id", "fingerprint", "statement", "tags").collect()))
    assert key(a) == key(b)


def test_repair_and_relations(spark):
    out = pipeline.run(raw(spark, [{"text": "必须 A", "metadata": {"project_id": "P"}}, {"text": "风险 B", "metadata": {"project_id": "P"}}]))
    partial = out["units"].where("semantic_kind = 'risk'")
    ledger = units.coverage(out["regions"], partial)
    assert units.coverage_gaps(out["regions"], ledger).count() == 1
    assert units.repaired(out["regions"], out["profiles"], partial, ledger).count() == 2
    edges = out["relations"].collect()
    assert [(e.evidence.value, e.type) for e in edges] == [("P", "related")]
    many = spark.createDataFrame([("x", i, "same") for i in range(50)], "d string, unit_id int, identity string")
    assert units.crowded(many, "unit_id", "identity", 40).head().members == 50


@pytest.mark.parametrize(
    ("state", "project", "reusable", "library", "ambiguous"),
    [("bidding", True, False, "active_tender", False), ("bidding", True, True, "business", False), ("archived", True, False, "business", False), ("unknown", True, False, "business", True), ("odd", True, False, "active_tender", False), ("bidding", False, False, "business", False)],
)
def test_routes(spark, state, project, reusable, library, ambiguous):
    r = spark.range(1).select(units.route_unit(F.lit("risk"), F.lit(state), F.lit(project), F.lit(reusable)).alias("r")).head().r
    assert (r.library, r.ambiguous) == (library, ambiguous)
    assert r.category == ("risk_deviation_compliance" if library == "active_tender" else "risks_issues")


def test_tags(spark):
    df = spark.createDataFrame([(["质量管理,quality", "#Risk/风险", "x" * 30, "a[b]", None, "Cost"], ["RISK", "cost"])], "c array<string>, e array<string>")
    got = df.select(units.normalize_tags(F.col("c"), F.col("e")).alias("t")).head().t
    assert got == ["质量", "RISK", "风险", "cost"]


def test_project_matching(spark):
    registry = spark.createDataFrame([("P1", "North Bridge", ["NB-1"], None), ("P2", "South", ["NB-1", "Hall"], ["R/7"]), ("P3", "East", None, None)], "project_id string, name string, aliases array<string>, references array<string>")
    docs = spark.createDataFrame([("a", "north_bridge report.docx", {}), ("b", "x.docx", {"project_reference": "nb 1"}), ("c", "none.txt", {}), ("d", "about R7.pdf", {})], "source_document_id string, filename string, metadata map<string,string>")
    blocks = spark.createDataFrame([("c", "b1", {"project_name": "EAST"})], "source_document_id string, block_id string, metadata map<string,string>")
    found = candidates.match_projects(candidates.project_evidence(docs, blocks), candidates.registry_identities(registry))
    got = {r.source_document_id: (r.project_id, r.outcome) for r in found.collect()}
    assert got == {"b": (None, "ambiguous"), "c": ("P3", "matched"), "d": ("P2", "matched")}
    exact = spark.createDataFrame([("a", "North-Bridge.docx", {"library": "business", "category": "risks_issues", "document_role": "reference"})], docs.schema)
    matched = candidates.match_projects(candidates.project_evidence(exact, blocks.limit(0)), candidates.registry_identities(registry))
    route = candidates.local_route(exact, matched).head()
    assert (route.project_id, route.library, route.directory_category, route.resolved) == ("P1", "business", "risks_issues", True)
    proposed = spark.createDataFrame([("a", "P2", None, "nonsense", None)], "source_document_id string, project_id string, library string, directory_category string, document_role string")
    merged = candidates.merge_route(candidates.local_route(exact, matched), proposed, matched.select("source_document_id", "project_id")).head()
    assert merged.project_id is None
    assert set(merged.review_reasons) == {"unsupported_invented_facts", "ambiguous_category"}


FACTS = "struct<actors:array<string>,status:array<string>,dates:array<string>,units:array<string>,numbers:array<string>,modality:array<string>>"


def test_candidates(spark):
    blocks = spark.createDataFrame([("d", "b1", "The bidder shall pay 5 EUR.", ("page", "3")), ("d", "b2", "Other text", (None, None))], "source_document_id string, block_id string, text string, locator struct<scheme:string,value:string>")
    blocks = blocks.withColumn("locator", F.struct("locator.scheme", "locator.value", *(F.lit(None).alias(c) for c in ("page", "sheet", "range", "row", "column", "message_id", "attachment_id", "heading_path"))).cast(LOCATOR))
    rows = [
        ("d", "requirement", "b1", "shall pay 5 EUR", "pay", ["if asked"], True, 0), ("d", "nonsense", "b1", "shall pay", "", None, False, 1), ("d", "risk", "b9", "x", "", None, False, 2), ("d", "risk", "b2", "Other", "", None, False, 3), ("d", "risk", "b1", "not there", "", None, False, 4),
        ("d", "requirement", "b1", "shall  pay 5 EUR".replace("  ", " "), "pay", ["if asked"], False, 5), ("d", "requirement", "b1", "The bidder", "pay", [], False, 6),
    ]
    given = spark.createDataFrame(rows, "source_document_id string, item_type string, block_id string, verbatim string, summary string, applicable_conditions array<string>, reusable boolean, ord int")
    got = candidates.validate(given, blocks).orderBy("ord").collect()
    assert [g.error is None for g in got] == [True, False, False, False, False, True, True]
    assert got[0].review_reasons == ["reuse_promotion"]
    assert got[0].candidate_id == got[5].candidate_id
    valid = candidates.validate(given, blocks).where("error is null").withColumns({"facts": F.lit(None).cast(FACTS), "boundary": F.col("block_id"), "reuse_reasons": F.array().cast("array<string>")})
    done = candidates.consolidate(valid).collect()
    assert len(done) == 2  # the two equal ones became one
    assert all("conflicting_facts" in d.review_reasons for d in done)  # one summary, two conditions
    facts = spark.range(1).select(candidates.normalized_facts(F.struct(*(F.array(F.lit(" a "), F.lit("a"), F.lit("")).alias(k) for k in candidates.FACT_KEYS))).alias("f")).head().f
    assert facts.actors == ["a"]
    summary = candidates.review_summary(spark.createDataFrame([("d", "P", "business", "risks_issues", ["ambiguous_project"])], "source_document_id string, project_id string, library string, directory_category string, review_reasons array<string>"), valid.withColumn("locator", F.col("block_locator"))).head().summary
    assert "发现 3 条" in summary
    assert "项目证据有歧义" in summary


def test_gate(spark):
    rows = [
        ("c1", [], True, False, None, "business", "x", "reference", []), ("c2", ["missing_evidence"], True, False, None, "business", "x", "reference", []), ("c3", ["conflicting_facts"], True, False, "matched", "business", "x", "reference", []),
        ("c4", ["conflicting_facts"], True, True, "conflict", "business", "x", "reference", []), ("c5", None, None, None, None, None, None, None, ["ambiguous_project"]), ("c6", ["ambiguous_category"], True, False, None, "business", "x", "unknown", []),
    ]
    df = spark.createDataFrame(rows, "candidate_id string, review_reasons array<string>, evidence_ok boolean, reusable boolean, difference_status string, library string, directory_category string, document_role string, route_reasons array<string>").withColumn("source_document_id", F.lit("d"))
    classified, groups, counts = gate.run(df, enabled=True)
    got = {r.candidate_id: r for r in classified.collect()}
    assert got["c1"].outcome == gate.PASS
    assert got["c2"].hard_risks == ["missing_or_unverifiable_evidence"]
    assert (got["c3"].outcome, got["c3"].notices) == (gate.NOTICE, ["noncritical_difference"])
    assert got["c4"].hard_risks == ["company_reuse_promotion", "critical_fact_conflict"]
    assert got["c5"].hard_risks == ["missing_or_unverifiable_evidence", "project_ownership_conflict"]
    assert got["c6"].notices == ["category_unresolved", "route_incomplete"]
    n = counts.head()
    assert (n.generated, n.auto_passed, n.notices, n.needs_handling, n.handling_groups) == (6, 1, 2, 3, 4)
    by_cause = {g.root_cause: g.candidate_ids for g in groups.collect()}
    assert by_cause["missing_or_unverifiable_evidence"] == ["c2", "c5"]
    assert "4 个问题组" in gate.plain_summary(counts).head().summary
    assert gate.run(df)[2].head().generated == 0


def test_decision_ledger(spark):
    rows = [("l", i, f"id{i}", "t", "me", "d", "g", "accept", ["b", "a"], "") for i in range(4)]
    entries = gate.append_decisions(spark.createDataFrame(rows, "ledger string, seq int, decision_id string, decided_at string, decided_by string, source_document_id string, group_id string, decision string, candidate_ids array<string>, reason string"))
    assert gate.verify_ledger(entries).head().intact
    changed = entries.withColumn("decision", F.when(F.col("seq") == 2, "reject").otherwise(F.col("decision")))
    assert not gate.verify_ledger(changed).head().intact
    assert not gate.verify_ledger(entries.where("seq <> 1")).head().intact


def test_tables(spark):
    grid = [["名称", "规格", "要求"], ["水泥", "P.O 42.5", "强度合格"], ["", "", ""], ["名称", "规格", "要求"], ["钢筋", "HRB400", "-"], ["水泥", "P.O 42.5", "强度合格"]]
    cells = [("d", "t", r + 1, c + 1, v, f"b{r}{c}", False, r * 10 + c) for r, row in enumerate(grid) for c, v in enumerate(row)]
    df = spark.createDataFrame(cells, "doc string, table_key string, row int, col int, value string, block_id string, merged boolean, ord int")
    found = {r.row: r for r in tables.subjects(df, ["doc", "table_key"]).collect()}
    assert [found[r].dropped for r in (2, 3, 4, 5, 6)] == [None, "empty", "repeated_header", None, "duplicate"]
    assert found[2].content == "水泥：规格=P.O 42.5；要求=强度合格"
    assert found[5].content == "钢筋：规格=HRB400"
    points = tables.key_points(tables.subjects(df, ["doc", "table_key"]), ["doc", "table_key"])
    assert points.count() == 2
    known = spark.createDataFrame([("d", " 水泥：规格=p.o 42.5；要求=强度合格")], "doc string, content string")
    assert tables.new_points(points, known, ["doc"]).count() == 1
    d = tables.diagnostics(tables.subjects(df, ["doc", "table_key"]), points, ["doc"]).head()
    assert (d.tables_found, d.subjects_found, d.candidates_generated, d.dense_warning) == (1, 2, 2, False)


def test_merged_cells_labels_and_ranges(spark):
    cells = spark.createDataFrame([("t", 1, 1, "A", False, 0), ("t", 1, 2, "B", False, 1), ("t", 2, 1, "", True, 2), ("t", 2, 2, "C", False, 3), ("t", 3, 1, "", False, 4)], "k string, row int, col int, value string, merged boolean, ord int")
    got = {(r.row, r.col): r.value for r in tables.fill_merged(cells, ["k"]).collect()}
    assert got[(2, 1)] == "A"
    assert got[(3, 1)] == ""
    labels = tables.unique_row_labels(spark.createDataFrame([("t", 1, 1, "x"), ("t", 2, 1, "y"), ("t", 3, 1, "y"), ("t", 4, 1, "7")], "k string, row int, col int, value string"), ["k"])
    assert [(r.row, r.label) for r in labels.collect()] == [(1, "x")]
    area = tables.expand_ranges(spark.createDataFrame([("Z2:AB3",)], "range string")).collect()
    assert {(r.row, r.col) for r in area} == {(r, c) for r in (2, 3) for c in (26, 27, 28)}
    assert [(r.row, r.col) for r in area if r.anchor] == [(2, 26)]
    keys = spark.createDataFrame([("spreadsheet_cell", {"sheet": "S"}, "v", "b"), ("table_cell", {"part": "document", "table": "2"}, "v", "b"), ("table_cell", {"slide": "1", "table": "2"}, "v", "b"), ("table", {}, None, "b"), ("paragraph", {}, None, "b")], "kind string, m map<string,string>, l string, b string")
    assert [r.k for r in keys.select(tables.table_key(F.col("kind"), F.col("m"), F.col("l"), F.col("b")).alias("k")).collect()] == ["xlsx:S", "docx:document:2", "pptx:1:2", "text:b", ""]


def test_split_covers_the_text():
    r = random.Random(6)
    for size in (200, 1200):
        for _ in range(40):
            parts = [r.choice(["# A\n", "## B b\n", "word " * r.randrange(1, 60) + "\n", "```\n# no heading\n```\n", "| a | b |\n|---|---|\n", "$$\nx\n$$\n", "\n", "长" * r.randrange(1, 300)]) for _ in range(r.randrange(0, 25))]
            text = "".join(parts)
            chunks = split.split_text(text, size, r.random() < 0.5, 0.1)
            assert "".join(text[c["start"] : c["end"]] for c in chunks) == text
            assert chunks[0]["start"] == 0
            assert all(c["end"] - c["start"] <= size for c in chunks if "```" not in text and "|" not in text and "$$" not in text)
    assert len(split.split_text("x" * 25_000)) == 3
    assert len(split.split_text("")) == 1


def test_split_markdown(spark):
    text = "# A\n" + "alpha " * 50 + "\n## B\n" + "beta " * 50 + "\n# C\n" + "gamma " * 50
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = split.split_markdown(docs, "doc_id", "text", 400, coalesce=False).orderBy("doc_id", "chunk_no").collect()
    assert [r.breadcrumb for r in rows if r.doc_id == 1] == ["A", "A > B", "C"]
    assert [r for r in rows if r.doc_id == 2][0].markdown == ""
    assert all(r.valid for r in split.validate_chunks(split.split_markdown(docs, "doc_id", "text", 100), "doc_id").collect())
    crumbs = split.breadcrumbs(B.line_blocks(docs.where("doc_id = 1")), "doc_id").orderBy("ord").collect()
    assert [c.breadcrumb for c in crumbs] == ["A", "A", "A > B", "A > B", "C", "C"]
    p = split.profile_markdown(docs, "doc_id", "text").orderBy("doc_id").head()
    assert (p.heading_counts[:2], p.dominant_level, p.strategy) == ([2, 1], 1, "heading")


def test_pack_and_sample(spark):
    blocks = spark.createDataFrame([("d", i, "heading" if i == 3 else "text", "x" * n, "loc") for i, n in enumerate([300, 900, 30, 12, 6000])], "doc string, ord int, kind string, text string, locator string")
    packed = split.pack_blocks(blocks, "doc", hard=400, soft=300)
    got = packed.orderBy("ord", "piece").collect()
    assert "".join(r.text for r in got if r.ord == 4) == "x" * 6000
    assert max(r.tokens for r in got) <= 400
    m = split.packing_metrics(packed, "doc").head()
    assert (m.split_blocks, m.locator_coverage) == (1, 1.0)
    sample = split.classification_sample(blocks, "doc", 50).head().sample
    assert sample.startswith("x" * 12 + "\n")
    assert len(sample) <= 50


def test_quotes(spark):
    blocks = spark.createDataFrame([("d", "b1", "付款期限为 30 天。Ａ级", True), ("d", "b2", "same words", True), ("d", "b3", "same words", None), ("d", "b4", "hidden quote", False)], "source_document_id string, block_id string, text string, card_eligible boolean")
    quotes = spark.createDataFrame([("q1", "d", "付款期限为30天", None), ("q2", "d", "same words", None), ("q3", "d", "same words", "b3"), ("q4", "d", "absent", None), ("q5", "d", "hidden quote", None), ("q6", "d", "A级", None)], "quote_id string, source_document_id string, quote string, hint string")
    got = {r.quote_id: (r.status, r.block_id) for r in provenance.reconcile(quotes, blocks).collect()}
    assert got == {"q1": ("resolved", "b1"), "q2": ("ambiguous_quote", None), "q3": ("resolved", "b3"), "q4": ("quote_not_found", None), "q5": ("quote_not_found", None), "q6": ("resolved", "b1")}
    rows = provenance.original_spelling(spark.createDataFrame([("x 付款 期限Ａ y", "付款期限A"), ("abc", "zz")], "text string, quote string")).collect()
    assert [(r.found, r.start) for r in rows] == [("付款 期限Ａ", 2), (None, -1)]
    places = provenance.occurrences(spark.createDataFrame([(1, "a.b.a.b", "a.b"), (2, "xx", "y"), (3, "", "")], "id int, t string, q string"), ["id"], "t", "q").collect()
    assert sorted((p.id, p.nth, p.start) for p in places) == [(1, 1, 0), (1, 2, 4)]


@pytest.mark.parametrize(
    ("claim", "evidence", "status"),
    [
        ("应在 30 天内付款", "应在30天内付款", "matched"), ("应在 45 天内付款", "应在 30 天内付款", "conflict"), ("必须提交 3 份", "必须提交", "missing_in_evidence"), ("30 天与 2 kg", "30 天", "unsupported_addition"), ("必须提交", "可以提交", "strengthened_obligation"),
        ("可以提交", "必须提交", "weakened_obligation"), ("不得提交", "必须提交", "changed_obligation"), ("如果下雨，必须停工", "必须停工", "invented_condition"), ("必须停工", "如果下雨，必须停工", "removed_condition_or_exception"),
    ],
)
def test_evidence_consistency(spark, claim, evidence, status):
    got = spark.range(1).select(provenance.evidence_consistency(F.lit(claim), F.lit(evidence)).alias("c")).head().c
    assert got.status == status


def test_ocr_shapes_packages_and_points(spark):
    rows = spark.createDataFrame([(0, "a", [1.0], None, None, None), (None, None, None, 2, ["b", ""], [[1.0], [2.0]])], "page_idx int, text string, bbox array<double>, page int, rec_texts array<string>, rec_boxes array<array<double>>")
    assert sorted((r.page, r.text) for r in provenance.ocr_spans(rows).collect()) == [(1, "a"), (2, "b")]
    schema = "source_document_id string, markdown string, blocks array<struct<block_id:string,kind:string,text:string,page:int>>"
    once = provenance.upgrade_packages(spark.createDataFrame([("d", "text", None), ("e", "t", [("b", "k", "x", 4)])], schema))
    twice = provenance.upgrade_packages(once)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {(r.kind, r.page) for r in provenance.evidence_index(once).collect()} == {("parsed-text-span", None), ("k", 4)}
    atoms = spark.createDataFrame([("d", "a1", ["p1", "p9"]), ("d", "a2", [])], "source_document_id string, atom_id string, point_ids array<string>")
    points = spark.createDataFrame([("d", "p1", ["e1", "e2"])], "source_document_id string, point_id string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("d", "e1")], "source_document_id string, evidence_id string")
    links, dropped = provenance.point_atoms(atoms, points, evidence)
    assert [(r.atom_id, r.evidence_id) for r in links.collect()] == [("a1", "e1")]
    assert {r.dropped: r.n for r in dropped.collect()} == {"unknown_point": 1, "missing_evidence": 1, "no_attribution": 1}


def test_vectors(spark):
    rows = spark.createDataFrame([(0, "l", [1.0, 0.0]), (1, "l", [0.9, 0.1]), (2, "l", [0.0, 1.0]), (3, "m", [1.0, 0.0]), (4, "l", [0.0, 0.0])], "id long, library string, vector array<double>")
    got = vectors.top_k_cosine(rows, rows.where("id = 0"), 2, filters=["library"]).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2]
    assert vectors.tombstoned(rows, rows.where("id = 1")).count() == 4
    assert vectors.top_k_cosine(rows, rows.where("id = 0"), 5, filters=["library"], limit=2).count() <= 2
    texts = spark.createDataFrame([("the quick brown fox jumps over the lazy dog",), ("the quick brown fox jumped over the lazy dog",), ("质量 管理 要求",)], "t string")
    a, b, c = (r.h for r in texts.select(vectors.simhash(F.col("t")).alias("h")).collect())
    assert bin((a ^ b) & (2**64 - 1)).count("1") < 32 < 64
    assert a != c
    atoms = spark.createDataFrame([("d", "a1", "设备必须在 30 天内交付"), ("d", "a2", "设备必须在30 天内交付完成"), ("d", "a3", "设备必须在 45 天内交付"), ("d", "a4", "——")], "source_document_id string, atom_id string, text string")
    groups = {r.atom_id: r.group_id for r in vectors.consolidate_atoms(atoms).collect()}
    assert groups["a3"] == "a3"
    assert "a4" not in groups
    relation = spark.range(1).select(vectors.infer_relation(F.lit("v2 替代 v1"), F.lit("旧版"), F.lit(0.9)).alias("r")).head().r
    assert relation == "supersedes"


def test_top_k_of_many_queries_in_blocks(spark):
    given = [(i, "lm"[i % 2], [float(i * 7 % 5), float(i * 3 % 4), float(i % 3)]) for i in range(120)] + [(120, "l", None)]
    rows = spark.createDataFrame(given, "id long, library string, vector array<double>")
    got = vectors.top_k_cosine_many(rows, rows.where("id % 20 = 0"), 5, filters=["library"], index_block=30, query_block=2).collect()
    want = []
    for i in range(0, 121, 20):
        want += vectors.top_k_cosine(rows, rows.where(F.col("id") == i), 5, filters=["library"]).collect()
    assert len(want) == 35
    assert sorted(got) == sorted(want)


def test_simhash_groups_take_the_whole_text(spark, tmp_path):
    from kunits.plans.queries import QUERIES

    given = [(1, "title\nthe quick brown fox"), (2, "title\nquality management of suppliers"), (3, "title\nthe quick brown fox")]
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.first_doc, r.n) for r in QUERIES["simhash_groups"](spark, str(tmp_path)).collect())
    assert got == [(1, 2), (2, 1)]


def test_crowded_identities_keep_their_units(spark):
    rows = [{"text": "必须 完成", "metadata": {"project_id": "P"}}] * 45 + [{"text": "风险 B", "metadata": {"project_id": "Q"}}] * 2
    each = raw(spark, rows).withColumn("source_document_id", F.col("ord").cast("string"))  # a document for each block
    out = {k: v.cache() for k, v in pipeline.run(each).items() if k in ("units", "relations", "crowded")}
    held = {r.unit_id for r in out["units"].where("array_contains(project_ids, 'P')").select("unit_id").collect()}
    assert len(held) == 45
    assert sorted((r.identity, r.unit_id) for r in out["crowded"].collect()) == sorted(("P", u) for u in held)
    assert [r.evidence.value for r in out["relations"].collect()] == ["Q"]
