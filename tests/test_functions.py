from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kunits.functions import decode, lang, numbers, text


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("x")).head().x


@pytest.mark.parametrize(
    ("value", "language"),
    [("质量管理要求", "zh"), ("これは仕様です", "ja"), ("plain English", "en"), ("the 质量 plan", "mixed"), ("これは a test です", "mixed"), ("abc", "unknown"), ("", "unknown"), ("12 !", "unknown"), ("カナ", "ja")],
)
def test_detect_language(spark, value, language):
    got = one(spark, lang.detect_language(F.col("t")), value)
    assert got.language == language
    assert got.confidence == 0 if not got.script_evidence.han + got.script_evidence.latin + got.script_evidence.hiragana + got.script_evidence.katakana else 0.55 < got.confidence <= 0.99


@pytest.mark.parametrize(("value", "language"), [("안녕하세요 세계", "ko"), ("Привет мир", "ru"), ("中文文本", "zh"), ("日本語のテキスト", "ja"), ("hello", "en"), ("مرحبا", "ar"), ("สวัสดี", "th"), ("नमस्ते", "hi"), ("123", "unknown")])
def test_dominant_language(spark, value, language):
    assert one(spark, lang.dominant_language(F.col("t")), value) == language


@pytest.mark.parametrize(
    ("value", "kind"),
    [("投标人必须提交资料", "requirement"), ("付款方式与税率", "commercial_term"), ("施工工艺说明", "method"), ("存在安全隐患", "risk"), ("nothing here", "fact"), ("型号A 允许偏差 5mm x", "parameter"), ("审批流程", "process"), ("会議で承認された", "decision")],
)
def test_dominant_kind(spark, value, kind):
    assert one(spark, lang.dominant_kind(F.col("t")), value) == kind


def test_facts_use_ascii_boundaries(spark):
    got = one(spark, lang.extract_facts(F.col("t")), "于2026年8月1日前交付 12.5 kg 及 5 MPa，型号 AB-1234，2026-01-02。3 mm 3 mm")
    assert "12.5 kg" in got.numbers
    assert "5 M" in got.numbers  # the unit list tries m first
    assert got.numbers.count("3 mm") == 1
    assert "2026年8月1" in got.dates[0]
    assert "2026-01-02" in got.dates
    assert got.models == ["AB-1234"]
    assert "5 MPa" in one(spark, lang.extract_numbers(F.col("t"), True), "5 MPa")
    tokens = one(spark, lang.protected_tokens(F.col("t")), "按 ISO 9001 与 GB/T-50001 的 Foo-Bar/2 执行")
    assert {"Foo-Bar/2"} <= set(tokens)
    assert any(t.startswith("ISO 9001") for t in tokens)


def test_protected_tokens_are_all_kept(spark):
    """Beyond twenty numbers, ten dates and ten models, and beyond 160 characters of a name."""
    numbers, dates, models = [f"{i}.5 kg" for i in range(100, 130)], [f"2024-01-{i}" for i in range(10, 25)], [f"AB-{i}" for i in range(200, 215)]
    names = ["Long-" + "x" * 200 + end for end in ("a", "b")]
    value = "; ".join([*numbers, *dates, *models, *names])
    tokens = one(spark, lang.protected_tokens(F.col("t")), value)
    assert {*numbers, *dates, *models, *names} <= set(tokens) and len(tokens) == len(set(tokens))
    rows = spark.createDataFrame([(value, "交付 " + value.replace(lost, "")) for lost in ("129.5 kg", "2024-01-24", "AB-214", names[1])], "s string, t string")
    assert {r.p for r in rows.select(lang.translation_problem(F.col("s"), F.col("t")).alias("p")).collect()} == {"TRANSLATION_FIDELITY_INVALID"}


def test_deterministic_chinese(spark):
    got = one(spark, lang.deterministic_chinese(F.col("t")), "shall not")
    assert (got.text, got.safe) == ("不得", True)
    assert one(spark, lang.deterministic_chinese(F.col("t")), "要求事項")["text"] == "要求"
    assert not one(spark, lang.deterministic_chinese(F.col("t")), "The contractor must deliver")["safe"]


def test_translation_checks(spark):
    rows = spark.createDataFrame([("deliver 12 kg", "交付 12 kg"), ("deliver 12 kg", "交付十二公斤"), ("x", "only English text"), ("x", "")], "s string, t string")
    got = [r.p for r in rows.select(lang.translation_problem(F.col("s"), F.col("t")).alias("p")).collect()]
    assert got == [None, "TRANSLATION_FIDELITY_INVALID", "TRANSLATION_NOT_CHINESE", "TRANSLATION_NOT_CHINESE"]


def test_cleaners(spark):
    assert one(spark, text.clean(F.col("t")), "  ＡＢ\n\tc\x00  ") == "ABc"
    assert one(spark, text.clean(F.col("t"), 2), None) == ""
    assert one(spark, text.clean_text(F.col("t")), " a \n b ") == "a b"
    assert one(spark, text.verbatim(F.col("t")), "\n a  b \n") == "a  b"
    assert one(spark, text.identity_key(F.col("t")), " Ｐroject-A (1)_x ") == "projecta1x"
    assert one(spark, text.unique_sorted(F.col("t")), [" b", "a", "", None, "b"], "array<string>") == ["a", "b"]
    assert one(spark, text.safe_segment(F.col("t")), " a/b:c?..d ") == "a-b-c--d"
    assert one(spark, text.safe_segment(F.col("t")), " . ") == "未命名"
    assert one(spark, text.attachment_name(F.col("t")), "../x/a:b\x01.pdf") == "a_b.pdf"
    assert one(spark, text.safe_slice(F.col("t"), 1, 2), "a🙂b") == "🙂b"
    assert one(spark, text.legacy_id("card", F.col("t"), F.lit(3)), " a b!c ") == "card:a-b-c"
    assert one(spark, text.legacy_id("card", F.col("t"), F.lit(3)), "！") == "card:3"


@pytest.mark.parametrize(("path", "ok"), [("a/b.md", True), ("/a", False), ("a//b", False), ("../a", False), ("a/./b", False), ("C:/x", False), ("a\\b", True), ("a/", True), ("", False), ("a/b?c", False), (None, False)])
def test_path_safe(spark, path, ok):
    assert one(spark, text.path_safe(F.col("t")), path) is ok


def test_redaction(spark):
    got = one(spark, text.redact(F.col("t")), "Authorization: Basic abc123\nbearer abcdefgh12345 https://x/?token=s3cret&page=2 eyJhbGciOi.eyJzdWIiOi.abcdefg api_key=ABCDEF123")
    for secret in ("abc123\n", "abcdefgh12345", "s3cret", "eyJhbGciOi.", "ABCDEF123"):
        assert secret not in got
    assert "page=2" in got


def test_entities_and_mail_encodings(spark):
    assert one(spark, text.decode_entities(F.col("t")), "&amp;lt; &#65;&#x42; &nope; &#xD800; &eacute;") == "&lt; AB &nope; &#xD800; é"
    assert one(spark, text.strip_html(F.col("t")), "<p>a&amp;b<script>x</script> <b>c</b></p>") == "a&b c"
    assert one(spark, decode.quoted_printable(F.col("t")), "a=C3=A9=\nb") == "aéb"
    assert one(spark, decode.mime_words(F.col("t")), "=?utf-8?B?5rWL?= =?utf-8?B?6K+V?=") == "测试"


@pytest.mark.parametrize(("value", "name"), [("质量管理要求必须满足", "gb18030"), ("日本語のテキストです。", "shift_jis"), ("한국어 문장입니다", "euc_kr"), ("caf\u00e9 d\u00e9j\u00e0 vu encore", "cp1252"), ("hello world", "utf-16-le"), ("naïve", "utf-8")])
def test_decode_bytes(value, name):
    assert decode.decode_bytes(value.encode(name))[:2] == (value, name)


def test_decode_refuses_binary(spark):
    assert decode.decode_bytes(b"%PDF-1.7 ...")[0] is None
    row = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfhi"),), (None,)], "t binary").select(decode.decode_text("t").alias("d")).select("d.*").collect()
    assert (row[0].text, row[1].text) == ("hi", None)


@pytest.mark.parametrize(("broken", "good"), [('{"a": [1,2,], "b": "x', '{"a": [1, 2], "b": "x"}'), ('```json\n{"a":1,}\n```', '{"a": 1}'), ('text {"a":{"b":2}', '{"a": {"b": 2}}'), ("no json", None), (None, None), ('{"a":"q\\"z"', '{"a": "q\\"z"}')])
def test_repair_json(broken, good):
    assert decode.repair(broken) == good


def test_numbers_and_dates(spark):
    assert one(spark, numbers.business_date(F.col("t"), "Asia/Shanghai"), "2026-03-01T20:00:00Z") == "2026-03-02"
    assert one(spark, numbers.business_date(F.col("t"), "Asia/Shanghai"), "2026-03-01") == "2026-03-01"
    assert one(spark, numbers.business_date(F.col("t"), "Asia/Shanghai"), "soon") == ""
    assert one(spark, numbers.iso_instant(F.col("t")), "2026-03-01T20:00:00Z") == "2026-03-01T20:00:00.000Z"
    assert [one(spark, numbers.column_number(F.col("t")), x) for x in ("A", "Z", "AA", "zz", "")] == [1, 26, 27, 702, 0]
    assert [one(spark, numbers.column_letters(F.col("t")), x, "int") for x in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(spark, numbers.rotation(F.col("t")), "-90") == 270
    assert [one(spark, numbers.clamp_int(F.col("t"), 1, 20, 8), x) for x in ("0", "7.6", "99", "x", None)] == [1, 8, 20, 8, 8]
    assert [one(spark, numbers.backoff_ms(F.col("t")), x, "int") for x in (0, 1, 3, 30)] == [0, 1000, 4000, 60000]
    assert one(spark, numbers.is_date_format(F.col("t")), "yyyy-mm-dd")
    assert not one(spark, numbers.is_date_format(F.col("t")), '0.00"days"')
    assert one(spark, numbers.looks_like_gibberish(F.col("t")), "\ufffd\ufffd\ufffdabc")
    assert not one(spark, numbers.looks_like_gibberish(F.col("t")), "正常文本 with words.")


def test_html_text_decoded_against_brute_force(spark):
    import hashlib
    import html
    import re

    from kunits.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert one(spark, text.strip_html(F.col("t")), "<p>caf&eacute; &middot;&nbsp;&#233;&#xE9; &amp;lt; &nope;</p>") == "café · éé &lt; &nope;"

    def plain(page):
        bare = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ", page)
        found = re.sub(r"&(?:#\w+|\w+);", lambda m: html.unescape(m[0]), re.sub(r"<[^>]*>", " ", bare))
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", found.replace("\xa0", " ")).strip(" ")

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()}
    assert any("&middot;" in p for p in pages.values())
    got = {r.page_id: r.text_hash for r in QUERIES["html_text_decoded"](spark, sf).collect()}
    assert got == {i: hashlib.sha256(plain(p).encode()).hexdigest() for i, p in pages.items()}


def test_signals_as_their_patterns_say(spark):
    """literals are looked up as such, with the results of the patterns, and no literal in a pattern."""
    from kunits.functions.text import ascii_edges

    texts = [None, "", "It SHALL be", "ris\u212a and RISK", "CL\u0130ENT", "cl\u0130ent Client", "Follow-Up", "followup", "follow  up", "5 MM", "5 mmx", "FROM: a", "要求必须 12kg", "承認フロー", "\u017fhall", "Lesson\nACTION 期限", "型号 3 %", "requi\nred"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    plain = {k: sum((t.rlike("(?i)" + ascii_edges(p)).cast("int") for p in ps), F.lit(0)) for k, ps in lang.SIGNALS.items()}
    got = rows.select(lang.semantic_signals(t).alias("s"), F.struct(*(c.alias(k) for k, c in plain.items())).alias("w"), lang.dominant_kind(t).alias("k"), F.struct(*(lang.signal(t, k).alias(k) for k in lang.SIGNALS)).alias("o"))
    for r in got.collect():
        assert r.s == r.w == r.o
        assert r.k == next((k for k, n in r.w.asDict().items() if n and n == max(x or 0 for x in r.w)), "fact")
    assert "(?i)" in str(lang.signal(t, "action")) and "(?i)" not in str(lang.signal(t, "risk"))
