from __future__ import annotations

from pyspark.sql import functions as F

from kunits.operators import blocks as B
from kunits.plans import phases
from kunits.schema import RAW_BLOCKS


def _blocks(spark):
    schema = spark.createDataFrame([], RAW_BLOCKS).schema
    texts = ["投标人必须提交 3 份资料", "报价有效期为 30 天", "footer"]
    rows = [("d1", f"b{i}", i, "paragraph", t, {}, [], None, None, ("page", str(i), i, None, None, None, None, None, None, None), [], "present", t != "footer", None, {}) for i, t in enumerate(texts)]
    return B.canonical_blocks(spark.createDataFrame(rows, schema))


def _inputs(spark):
    documents = spark.createDataFrame([("d1", "Bridge.docx", {"library": "business", "category": "risks_issues", "document_role": "reference"})], "source_document_id string, filename string, metadata map<string,string>")
    registry = spark.createDataFrame([("P1", "Bridge", None, None)], "project_id string, name string, aliases array<string>, references array<string>")
    return documents, registry


def test_without_a_provider(spark):
    out = phases.run(_blocks(spark), *_inputs(spark))
    assert out["candidates"].count() == 0
    assert out["eligible"].count() == 2
    assert out["routes"].head().project_id == "P1"
    assert out["counters"].head().generated == 0


def test_with_a_provider(spark):
    def extract(requests):
        item = {"applicable_conditions": [], "facts": {"numbers": ["3"], "actors": None, "status": None, "dates": None, "units": None, "modality": None}, "reusable": False, "reuse_reasons": [], "project_id": None, "directory_category": None}
        good = {**item, "item_type": "requirement", "block_id": "b0", "verbatim": "必须提交 3 份", "summary": "提交资料"}
        return [{"batch_key": r["batch_key"], "items": [good, good, {**good, "block_id": "b9"}, {**good, "block_id": "b1", "verbatim": "有效期为 30 天", "project_id": "P9", "summary": "有效期"}]} for r in requests]

    out = phases.run(_blocks(spark), *_inputs(spark), extract)
    got = {c.said: c for c in out["classified"].collect()}
    assert got["提交资料"].outcome == "automatic_pass"
    assert got["有效期"].hard_risks == ["unsupported_model_fact"]
    assert [e.error for e in out["errors"].collect()] == ["证据块不在当前批次"]
    assert out["failed"].count() == 0
    broken = phases.run(_blocks(spark), *_inputs(spark), lambda requests: [])
    assert {r.error for r in broken["failed"].collect()} == {"PROVIDER_IDS_INVALID"}


def test_settings_labels_and_caches(spark, tmp_path):
    s = phases.ocr_settings({"executable": "/opt/x/tesseract", "workers": 99, "dpi": None})
    assert (s["executable"], s["workers"], s["dpi"]) == ("tesseract", 8, 200)
    assert s["fingerprint"] == phases.ocr_settings({"executable": "C:\\y\\tesseract", "workers": 8})["fingerprint"]
    r = spark.createDataFrame([(" a  b ",)], "t string").select(phases.repaired_label(F.col("t")).alias("r")).head().r
    assert (r.value, r.repairs) == ("a b", ["trimmed", "collapsed"])
    (tmp_path / "kunits").mkdir()
    (tmp_path / "kunits" / "x").write_text("1")
    (tmp_path / "source.txt").write_text("keep")
    assert phases.clear_cache(spark, f"file://{tmp_path}") == 1
    assert phases.clear_cache(spark, f"file://{tmp_path}") == 0
    assert (tmp_path / "source.txt").exists()
    assert [r.n for r in spark.createDataFrame([(11371,), (780,), (0,)], "c int").select(phases.bounded_chunks(F.col("c")).alias("n")).collect()] == [2, 1, 1]
