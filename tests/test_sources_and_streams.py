from __future__ import annotations

import io
import struct
import zipfile
from datetime import datetime, timedelta
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from kunits.sources import mail, office, scan
from kunits.sources.archive import Package, PackageError, resolve
from kunits.streaming import events


def package(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_rels_", "_rels"), body)
    return out.getvalue()


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


REL = '<Relationships xmlns="r">{}</Relationships>'
DOCX = {
    "[Content_Types].xml": "<Types/>",
    "word/document.xml": '<w:document xmlns:w="w" xmlns:r="r"><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Scope &amp; aims</w:t></w:r></w:p><w:p><w:r><w:t>Hello </w:t></w:r><w:hyperlink r:id="rId1"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>'
    '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>',
    "word/styles.xml": '<w:styles xmlns:w="w"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
    "word/footer1.xml": '<w:ftr xmlns:w="w"><w:p><w:r><w:t>foot</w:t></w:r></w:p></w:ftr>',
    "word/_rels/document.xml.rels": REL.format('<Relationship Id="rId1" Type="t" Target="https://x.y" TargetMode="External"/>'),
}
XLSX = {
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/>'),
    "xl/sharedStrings.xml": "<sst><si><t>Name</t></si><si><r><t>Ce</t></r><r><t>ment</t></r></si></sst>",
    "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": '<worksheet><cols><col min="3" max="4" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Inline</t></is></c></row>'
    '<row r="2" hidden="1"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>45000</v></c><c r="C2"><f>B2+1</f><v>45001</v></c><c r="D2" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A4:B5"/></mergeCells></worksheet>',
}
PPTX = {
    "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="256" r:id="rId2"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": REL.format('<Relationship Id="rId2" Type="t" Target="slides/slide1.xml"/>'),
    "ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvSpPr><p:cNvPr name="T"/><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:txBody></p:sp>'
    '<p:sp><p:txBody><a:p><a:pPr><a:buChar/></a:pPr><a:r><a:t>point</a:t></a:r></a:p></p:txBody></p:sp><p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>cell</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame></p:sld>',
    "ppt/slides/_rels/slide1.xml.rels": REL.format('<Relationship Id="rId1" Type="http://x/notesSlide" Target="../notesSlides/notesSlide1.xml"/>'),
    "ppt/notesSlides/notesSlide1.xml": '<p:notes xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:r><a:t>say this</a:t></a:r></a:p></p:sp></p:notes>',
}


def test_docx():
    got = office.read_docx(zipped(DOCX))
    assert [(b.kind, b.text) for b in got] == [("heading", "Scope & aims"), ("document", "Hello link"), ("list_item", "item"), ("table_cell", "A"), ("table_cell", ""), ("footer", "foot")]
    assert got[1].metadata["hyperlinks"] == "https://x.y"
    assert [b.metadata["merge"] for b in got if b.kind == "table_cell"] == ["none", "2:none"]


def test_xlsx():
    got = {b.metadata["coordinate"]: b for b in office.read_xlsx(zipped(XLSX))}
    assert [got[c].text for c in ("A1", "B1", "A2", "B2", "C2", "D2")] == ["Name", "Inline", "Cement", "45000", "45001", "TRUE"]
    assert got["B2"].metadata["cell_type"] == "date_serial"
    assert got["C2"].metadata["formula"] == "B2+1"
    assert (got["C2"].metadata["column_hidden"], got["A1"].metadata["column_hidden"], got["A2"].metadata["row_hidden"]) == (True, False, True)
    assert {c for c, b in got.items() if "merge" in b.metadata} == {"A4", "B4", "A5", "B5"}
    assert got["A1"].metadata["row_identity"] == "Name"


def test_pptx():
    got = office.read_pptx(zipped(PPTX))
    assert [(b.kind, b.text) for b in got] == [("heading", "Title"), ("list_item", "point"), ("table_cell", "cell"), ("speaker_note", "say this")]


@pytest.mark.parametrize(("parts", "code"), [({"../x": "a"}, "OOXML_PATH_TRAVERSAL"), ({"a": "0" * 10_000_000}, "OOXML_LIMIT_EXCEEDED"), ({"/abs": "x"}, "OOXML_PATH_TRAVERSAL")])
def test_unsafe_packages(parts, code):
    with pytest.raises(PackageError) as e:
        Package(zipped(parts))
    assert e.value.code == code


def test_package_errors():
    for data in (b"", b"PK\x03\x04 broken" * 10, b"text" * 30):
        with pytest.raises(PackageError, match=""):
            Package(data)
    with pytest.raises(PackageError) as e:
        list(Package(zipped({"a.xml": "<!DOCTYPE x><x/>"})).events("a.xml"))
    assert e.value.code == "OOXML_UNSUPPORTED"
    with pytest.raises(PackageError) as e:
        list(Package(zipped({"a.xml": "<a>" * 200 + "</a>" * 200})).events("a.xml"))
    assert e.value.code == "OOXML_LIMIT_EXCEEDED"
    with pytest.raises(PackageError):
        resolve("word/document.xml", "../../etc")
    bad = bytearray(zipped({"a.xml": "hello hello hello"}))
    bad[40] ^= 0xFF
    with pytest.raises(PackageError):
        Package(bytes(bad)).read("a.xml")
    assert Package(zipped({"dir/full.md": "x"})).ending_with(".md") == b"x"


def message() -> bytes:
    inner = EmailMessage()
    inner["Subject"] = "Inner"
    inner.set_content("inner body")
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Message-ID"] = "报价 Réf", "a@x.y", "b@x.y", "<1@x>"
    m.set_content("Plain body 必须\n\nPlease unsubscribe here\n")
    m.add_alternative("<p>Markup body <img src='cid:pic1'></p>", subtype="html")
    m.add_attachment(b"\x89PNG", maintype="image", subtype="png", filename="p.png", cid="<pic1>")
    m.add_attachment(b"data", maintype="application", subtype="pdf", filename="../a:b.pdf")
    m.add_attachment(inner)
    return m.as_bytes()


def test_eml():
    got = mail.parse_message(message())
    assert got["subject"] == "报价 Réf"
    assert got["body"].startswith("Plain body 必须")
    assert sorted(n for n, _, _ in got["attachments"]) == ["Inner.eml", "a_b.pdf"]
    blocks = mail.read_eml(message())
    assert [b.text for b in blocks if b.eligible] == ["报价 Réf", "Plain body 必须"]
    assert [b.reason for b in blocks if b.kind == "attachment"] == ["inventory", "inventory"]
    bare = EmailMessage()
    bare["Subject"] = "s"
    bare.add_attachment(b"x", maintype="application", subtype="pdf", filename="f.pdf")
    assert "正文为空" in mail.message_blocks(mail.parse_message(bare.as_bytes()))[1].text


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with small sectors: every stream as one chain."""
    size = 512
    chunks, fat, starts = [], [], {}
    for name, data in streams.items():
        data = data.ljust(4096, b"\0") if len(data) < 4096 else data
        n = -(-len(data) // size)
        starts[name] = (len(fat), len(data))
        for i in range(n):
            chunks.append(data[i * size : (i + 1) * size].ljust(size, b"\0"))
            fat.append(len(fat) + 1 if i < n - 1 else 0xFFFFFFFE)

    def entry(name: str, kind: int, start: int, length: int, right: int = 0xFFFFFFFF, child: int = 0xFFFFFFFF) -> bytes:
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw) + 2, kind, 1, 0xFFFFFFFF, right, child) + b"\0" * 36 + struct.pack("<IQ", start, length)

    entries = [entry("Root Entry", 5, 0xFFFFFFFE, 0, child=1)]
    names = list(starts)
    for i, n in enumerate(names):
        entries.append(entry(n, 2, *starts[n], right=i + 2 if i + 1 < len(names) else 0xFFFFFFFF))
    raw = b"".join(entries)
    directory = len(fat)
    for i in range(-(-len(raw) // size)):
        chunks.append(raw[i * size : (i + 1) * size].ljust(size, b"\0"))
        fat.append(len(fat) + 1 if (i + 1) * size < len(raw) else 0xFFFFFFFE)
    table = len(fat)
    fat.append(0xFFFFFFFD)
    chunks.append(struct.pack("<128I", *(fat + [0xFFFFFFFF] * (128 - len(fat)))))
    head = mail.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<II", 1, directory) + b"\0" * 4 + struct.pack("<5I", 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", table, *[0xFFFFFFFF] * 108)
    return head.ljust(512, b"\0") + b"".join(chunks)


def test_msg():
    utf = lambda s: s.encode("utf-16-le")
    data = compound({"__substg1.0_0037001F": utf("主题"), "__substg1.0_1000001F": utf("正文 必须\n\nunsubscribe"), "__substg1.0_0C1A001F": utf("sender")})
    got = mail.read_msg(data)
    assert [b.text.rstrip("\0") for b in got if b.eligible] == ["主题", "正文 必须"]
    assert any(b.reason == "tracking" for b in got)
    with pytest.raises(PackageError):
        mail.read_msg(b"not a compound file" * 100)


def test_scan_of_files(spark, tmp_path):
    for name, data in {"a.docx": zipped(DOCX), "b.xlsx": zipped(XLSX), "c.eml": message(), "d.md": b"# T\ntext\n", "e.zip": b"PK", "f.docx": b"broken", "g.txt": "质量管理要求".encode("gb18030"), "h.md": b"# T\ntext\n"}.items():
        (tmp_path / name).write_bytes(data)
    found = scan.files(spark, str(tmp_path))
    rows = scan.read_blocks(found).collect()
    status = {r.path.rsplit("/", 1)[1]: r.status for r in rows}
    assert status == {"a.docx": "ok", "b.xlsx": "ok", "c.eml": "ok", "d.md": "ok", "e.zip": "unsupported", "f.docx": "failed", "g.txt": "ok", "h.md": "ok"}
    assert [r.text for r in rows if r.path.endswith("g.txt")] == ["质量管理要求"]
    routes = {r.path.rsplit("/", 1)[1]: r.route for r in scan.dispatch(found).collect()}
    assert (routes["a.docx"], routes["e.zip"]) == ("local", "unsupported")
    known = found.where("path like '%a.docx'").select("source_hash")
    assert scan.intake(found, known).count() == 6  # two files have equal contents


PDF = b"%PDF-1.4\n1 0 obj << /Type /Pages /Kids [2 0 R 4 0 R] >> endobj\n2 0 obj << /Type /Page /Contents 3 0 R /Font 9 0 R >> endobj\n3 0 obj << >> stream\nBT (x) Tj ET\nendstream endobj\n4 0 obj << /Type /Page /Rotate 90 /XObject 5 0 R >> endobj\n5 0 obj << /Subtype /Image >> endobj\n"


def test_pdf(spark):
    got = scan.pdf_pages(PDF)
    assert [(p["classification"], p["rotation"], p["ocr_required"]) for p in got] == [("native", 0, False), ("scanned", 90, True)]
    p = spark.createDataFrame([(bytearray(PDF),), (bytearray(PDF.replace(b"/Rotate 90", b"")),)], "c binary").select(scan.pdf_probe(F.col("c")).alias("p")).collect()
    assert [(r.p.pages, r.p.native_text, r.p.reliable_local) for r in p] == [(2, True, False), (2, True, True)]
    ok = spark.createDataFrame([("ok", "x" * 20, 1, 0.0), ("ok", "x" * 20, 1, None), ("ok", "short", 1, 0.0), ("failed", "x" * 20, 1, 0.0)], "s string, m string, e int, r double").select(scan.quality_ok(F.col("s"), F.col("m"), F.col("e"), F.col("r")).alias("o")).collect()
    assert [r.o for r in ok] == [True, False, False, False]


def test_ocr(spark):
    tsv = ["level\tpage_num", "5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t91.5\thello world", "4\t1\t1\t1\t1\t0\t1\t1\t1\t1\t-1\t", "5\t1\t1\t1\t1\t2\t1\t2\t3\t4\t-1\tx"]
    got = scan.tesseract_rows(spark.createDataFrame([(t,) for t in tsv], "line string")).collect()
    assert [(r.text, r.confidence, r.bbox) for r in got] == [("hello world", 0.915, [10, 20, 40, 60]), ("x", 0.0, [1, 2, 4, 6])]
    blocks = spark.createDataFrame([("f", 1, 1, " good ", 0.9, None, "text", 450), ("f", 1, 2, "low", 0.2, None, "text", 0), ("f", 1, 3, "seal", 0.9, "印章", "text", 0), ("f", 1, 4, "", 2.0, None, None, -90)], "path string, page int, nth int, text string, confidence double, visual_type string, kind string, rotation int")
    rows = scan.normalize_ocr(blocks).orderBy("nth")
    assert [r.exclusion_reason for r in rows.collect()] == [None, "low_confidence_ocr", "unverified_stamp", "empty_ocr"]
    assert [r.rotation for r in rows.collect()] == [90, 0, 0, 270]
    pages = scan.ocr_pages(rows, ["path"])
    assert (pages.head().text, pages.head().status) == ("good\nlow\nseal", "ok")
    m = scan.ocr_metrics(pages, rows).head()
    assert (m.pages_completed, m.low_confidence_blocks) == (1, 1)
    images = spark.createDataFrame([("f", 1, "scanned", 0, bytearray(b"i")), ("f", 2, "native", 0, None), ("f", 3, "mixed", 0, bytearray(b"i" * 99))], "path string, page int, classification string, rotation int, image binary")
    assert {r.error for r in scan.recognize(images, None).collect()} == {"OCR_PROVIDER_UNAVAILABLE"}
    done = scan.recognize(images, lambda data, page: [{"text": f"p{page['page']}", "confidence": 0.8}], {"page_bytes": 50}).collect()
    assert {(r.page, r.text, r.error) for r in done} == {(1, "p1", None), (3, None, "OCR_LIMITS_EXCEEDED")}


T0 = datetime(2026, 1, 1)


def test_event_rules(spark):
    rows = [("a", T0, "processing"), ("a", T0 + timedelta(seconds=1), "stored"), ("a", T0 + timedelta(seconds=2), "processing"), ("b", T0, "processing")]
    df = spark.createDataFrame(rows, "key string, at timestamp, status string")
    assert [r.accepted for r in events.late_progress(df, "key", "at", "status").orderBy("key", "at").collect()] == [True, True, False, True]
    assert {r.key: r.status for r in events.last_state(df, "key", "at", "status").collect()} == {"a": "stored", "b": "processing"}
    assert [(r.key, r.starts) for r in events.limiter_violations(df, ["key"], "at", 1, "10 seconds").collect()] == [("a", 3)]
    assert events.debounced(df, "key", "at", "10 seconds").count() == 2
    assert {r.key: r.status for r in events.owners(df, "key", "at", "status").collect()} == {"a": "processing", "b": "processing"}
    legal = events.with_transitions(df, "key", "at", "status").orderBy("key", "at").collect()
    assert [r.legal for r in legal] == [True, True, False, True]


def _stream(spark, tmp_path, name: str, batches: list[list[tuple]], schema: str):
    folder = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def _drain(df, name: str, mode: str = "append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_state_machine_stream(spark, tmp_path):
    batches = [[("t", T0, "processing")], [("t", T0 + timedelta(seconds=2), "stored"), ("t", T0 + timedelta(seconds=1), "waiting")], [("t", T0 + timedelta(seconds=3), "processing")]]
    stream = _stream(spark, tmp_path, "states", batches, "task string, at timestamp, state string")
    got = _drain(events.state_machine(stream, "task", "state", "at"), "machine").orderBy("at").collect()
    assert [(r.asked, r.accepted) for r in got] == [("processing", True), ("waiting", False), ("stored", True), ("processing", False)]
    assert got[-1].state == "stored"


def test_intake_and_windows(spark, tmp_path):
    rows = [[("h1", T0), ("h1", T0)], [("h1", T0 + timedelta(minutes=1)), ("h2", T0 + timedelta(minutes=30))]]
    stream = _stream(spark, tmp_path, "intake", rows, "source_hash string, at timestamp")
    assert _drain(events.deduplicated(stream, "source_hash", "at"), "intake").count() == 2
    windows = _drain(events.tumbling(_stream(spark, tmp_path, "win", rows, "source_hash string, at timestamp"), "at", "5 minutes", ["source_hash"], "1 minute"), "windows").collect()
    assert [(w.source_hash, w.n) for w in windows] == [("h1", 3)]


def test_cooldowns(spark, tmp_path):
    rows = [[("p", T0, "failure"), ("p", T0 + timedelta(seconds=1), "failure"), ("p", T0 + timedelta(seconds=2), "cancelled")], [("p", T0 + timedelta(seconds=3), "success")]]
    stream = _stream(spark, tmp_path, "cool", rows, "provider string, at timestamp, outcome string")
    got = _drain(events.cooldowns(stream, "provider", "at", "outcome"), "cooldowns").collect()
    assert sorted(r.failures for r in got) == [0, 2]
    assert [r.until for r in got if r.failures == 2] == [T0 + timedelta(seconds=3)]


def test_foreach_batch_pipeline(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello there")
    seen = []
    q = events.run_pipeline(events.file_intake(spark, str(tmp_path / "in")), lambda rows, n: seen.extend(r.source_hash for r in rows.collect()), str(tmp_path / "ck"), once=True)
    q.awaitTermination(60)
    assert len(seen) == 1


# Word processing: lists, nested tables, sections


def _p(text: str, properties: str = "") -> str:
    return f"<w:p><w:pPr>{properties}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def _item(text: str, number: int, level: int = 0) -> str:
    return _p(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>')


def _cell(inner: str, properties: str = "") -> str:
    return f"<w:tc><w:tcPr>{properties}</w:tcPr>{inner}</w:tc>"


def _document(body: str, numbering: str = "", styles: str = "", **parts: str) -> list[office.Block]:
    names = 'xmlns:w="w" xmlns:r="r" xmlns:mc="mc" xmlns:a="a"'
    given = {"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {names}><w:body>{body}</w:body></w:document>"}
    if numbering:
        given["word/numbering.xml"] = f"<w:numbering {names}>{numbering}</w:numbering>"
    if styles:
        given["word/styles.xml"] = f"<w:styles {names}>{styles}</w:styles>"
    return office.read_docx(zipped(given | parts))


def _level(n: int, form: str, text: str, more: str = "") -> str:
    return f'<w:lvl w:ilvl="{n}"><w:start w:val="1"/><w:numFmt w:val="{form}"/>{more}<w:lvlText w:val="{text}"/></w:lvl>'


RESTART = '<w:lvlRestart w:val="1"/>'
NUMBERING = (
    f'<w:abstractNum w:abstractNumId="1">{_level(0, "decimal", "%1.")}{_level(1, "lowerLetter", "%1.%2)")}{_level(2, "upperRoman", "%3", RESTART)}</w:abstractNum>'
    f'<w:abstractNum w:abstractNumId="2">{_level(0, "bullet", "•")}{_level(1, "chineseCounting", "（%2）", "<w:isLgl/>")}</w:abstractNum>'
    '<w:num w:numId="1"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num>'
    '<w:num w:numId="3"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="7"/></w:lvlOverride></w:num><w:num w:numId="5"><w:abstractNumId w:val="2"/></w:num>'
)


def _labels(blocks: list[office.Block]) -> list[tuple[str, str]]:
    return [(b.text, b.metadata["list_label"]) for b in blocks if "list_label" in b.metadata]


def test_list_counters():
    asked = [("a", 1, 0), ("b", 1, 1), ("c", 1, 1), ("d", 1, 0), ("e", 1, 1), ("f", 2, 0), ("g", 3, 0), ("h", 3, 0), ("i", 1, 0), ("j", 5, 0)]
    got = _document("".join(_item(*x) for x in asked), NUMBERING)
    assert {b.kind for b in got} == {"list_item"}
    # Lists of one definition count on together; one that overrides its start begins anew.
    assert _labels(got) == list(zip("abcdefghij", ["1.", "1.a)", "1.b)", "2.", "2.a)", "3.", "7.", "8.", "9.", "•"], strict=True))
    assert got[-1].metadata["list_format"] == "bullet"


def test_list_levels_restart_as_told():
    asked = [("a", 1, 0), ("b", 1, 1), ("c", 1, 2), ("d", 1, 1), ("e", 1, 2), ("f", 1, 0), ("g", 1, 2)]
    # The third level goes on after an item of the second one, and restarts after one of the first.
    assert _labels(_document("".join(_item(*x) for x in asked), NUMBERING)) == list(zip("abcdefg", ["1.", "1.a)", "I", "1.b)", "II", "2.", "I"], strict=True))


def test_list_without_definition_or_upper_item():
    assert _labels(_document(_item("x", 9) + _item("y", 1, 1), NUMBERING)) == [("x", "1"), ("y", "1.a)")]
    assert [b.kind for b in _document(_item("x", 0), NUMBERING)] == ["document"]


def test_lists_and_headings_by_style():
    styles = (
        '<w:style w:styleId="Base"><w:name w:val="base"/><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style><w:style w:styleId="Sub"><w:name w:val="sub"/><w:basedOn w:val="Base"/></w:style>'
        '<w:style w:styleId="T"><w:name w:val="title of part"/><w:basedOn w:val="H"/></w:style><w:style w:styleId="H"><w:name w:val="heading 2"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style>'
        '<w:style w:styleId="R1"><w:basedOn w:val="R2"/></w:style><w:style w:styleId="R2"><w:basedOn w:val="R1"/></w:style>'
    )
    got = _document(_p("one", '<w:pStyle w:val="Sub"/>') + _p("none", '<w:pStyle w:val="Sub"/><w:numPr><w:numId w:val="0"/></w:numPr>') + _p("part", '<w:pStyle w:val="T"/>') + _p("ring", '<w:pStyle w:val="R1"/>') + _p("body", '<w:outlineLvl w:val="2"/>'), NUMBERING, styles)
    assert [(b.kind, b.metadata.get("list_label"), b.metadata.get("outline_level")) for b in got] == [("list_item", "1.", None), ("document", None, None), ("heading", None, 1), ("document", None, None), ("heading", None, 2)]


@pytest.mark.parametrize(("form", "want"), [("decimal", ["1", "9", "10", "27"]), ("lowerLetter", ["a", "i", "j", "aa"]), ("upperRoman", ["I", "IX", "X", "XXVII"]), ("chineseCounting", ["一", "九", "十", "二十七"]), ("decimalZero", ["01", "09", "10", "27"]), ("none", [""] * 4), ("other", ["1", "9", "10", "27"])])
def test_number_formats(form, want):
    from kunits.sources.word import shown

    assert [shown(n, form) for n in (1, 9, 10, 27)] == want
    assert (shown(105, "chineseCounting"), shown(1010, "chineseCounting"), shown(110, "chineseCounting")) == ("一百零五", "一千零一十", "一百一十")


def test_nested_tables():
    inner = f"<w:tbl><w:tr>{_cell(_p('x'))}{_cell(_p('y') + '<w:tbl><w:tr>' + _cell(_p('deep')) + '</w:tr></w:tbl>')}</w:tr></w:tbl>"
    body = f"<w:tbl><w:tr>{_cell(_p('a') + inner + _p('after'))}{_cell(_p('b'))}</w:tr><w:tr>{_cell(_p('c'))}</w:tr></w:tbl>{_p('end')}<w:tbl><w:tr>{_cell(_p('z'))}</w:tr></w:tbl>"
    got = _document(body)
    assert [(b.text, b.metadata.get("table"), b.metadata.get("row"), b.metadata.get("cell")) for b in got] == [("aafter", 1, 1, 1), ("x", 2, 1, 1), ("y", 2, 1, 2), ("deep", 3, 1, 1), ("b", 1, 1, 2), ("c", 1, 2, 1), ("end", None, None, None), ("z", 4, 1, 1)]
    of = {b.text: b for b in got}
    assert of["deep"].metadata["inside"] == of["y"].locator and of["x"].metadata["inside"] == of["aafter"].locator and "inside" not in of["b"].metadata
    assert len({b.locator for b in got}) == len(got)


def test_merges_of_cells():
    restart, go_on = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    rows = [_cell(_p("wide"), '<w:gridSpan w:val="2"/>') + _cell(_p("tall"), restart), _cell(_p("p")) + _cell(_p("q")) + _cell(_p(""), go_on), "<w:trPr><w:gridBefore w:val='2'/></w:trPr>" + _cell(_p(""), go_on)]
    got = _document("<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>")
    assert [(b.metadata["grid_column"], b.metadata["merge"]) for b in got] == [(1, "2:none"), (3, "1:restart"), (1, "none"), (2, "none"), (3, "1:continue"), (3, "1:continue")]
    assert [b.metadata.get("merged_into") for b in got][-2:] == [got[1].locator] * 2


def test_sections_breaks_boxes_and_alternatives():
    body = (
        _p("first", "<w:sectPr/>") + '<w:p><w:r><w:t>se</w:t><w:br w:type="page"/><w:t>cond</w:t><w:br/></w:r></w:p>'
        + '<w:p><w:r><mc:AlternateContent><mc:Choice><w:drawing><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></w:drawing></mc:Choice><mc:Fallback><w:pict><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></w:pict></mc:Fallback></mc:AlternateContent><w:t>around</w:t></w:r></w:p>'
        + "<w:sdt><w:sdtContent>" + _p("held") + "</w:sdtContent></w:sdt><w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p><w:sectPr/>"
    )
    got = _document(body)
    assert [(b.text, b.metadata["section"]) for b in got] == [("first", 1), ("second", 2), ("around", 2), ("boxed", 2), ("held", 2), ("new", 2)]
    assert got[1].metadata["breaks"] == "page line"


def test_macros_are_a_warning():
    got = _document(_p("text"), **{"word/vbaProject.bin": "x"})
    assert [(b.kind, b.eligible, b.reason) for b in got] == [("document", True, ""), ("package_warning", False, "OOXML_PARTIAL_FEATURE_SUPPORT")]


def test_sheet_filters_drawings_and_shared_formulas():
    sheet = (
        '<worksheet xmlns:r="r"><dimension ref="A1:B3"/><sheetData><row r="1"><c t="inlineStr"><is><t>Item</t></is></c><c t="inlineStr"><is><r><t>Am</t></r><r><t>ount</t></r><rPh><t>reading</t></rPh></is></c></row>'
        '<row r="2"><c r="A2"><f t="shared" ref="A2:A3" si="0">B2*2</f><v>4</v></c><c r="B2"><v>2</v></c></row><row r="3"><c r="A3"><f t="shared" si="0"/></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells><autoFilter ref="A1:B3"/><drawing r:id="rD"/></worksheet>'
    )
    drawing = '<d xmlns:a="a" xmlns:r="r"><twoCellAnchor><from><col>0</col><row>1</row></from><to><col>1</col><row>3</row></to><pic><cNvPr name="p" descr="shown"/><a:blip r:embed="rI"/></pic></twoCellAnchor></d>'
    got = office.read_xlsx(zipped(XLSX | {"xl/worksheets/sheet1.xml": sheet, "xl/drawings/drawing1.xml": drawing, "xl/worksheets/_rels/sheet1.xml.rels": REL.format('<Relationship Id="rD" Target="../drawings/drawing1.xml"/>'), "xl/drawings/_rels/drawing1.xml.rels": REL.format('<Relationship Id="rI" Target="../media/image1.png"/>')}))
    of = {b.metadata.get("coordinate"): b for b in got if b.kind == "spreadsheet_cell"}
    assert [of[c].text for c in ("A1", "B1", "A2", "B2", "A3")] == ["Item", "Amount", "4", "2", ""]
    assert (of["A3"].metadata["formula"], of["A3"].metadata["cached_value_status"]) == ("B2*2", "missing")
    assert (of["A1"].metadata["filter_role"], of["B2"].metadata["filter_role"]) == ("header", "filtered")
    assert of["A2"].metadata["inherited_header"] == "Item"
    about = next(b for b in got if b.kind == "sheet_metadata")
    assert (about.metadata["autofilters"], about.metadata["used_range"], about.eligible) == ("A1:B3", "A1:B3", False)
    picture = next(b for b in got if b.kind == "image_metadata")
    assert (picture.text, picture.metadata["target"], picture.metadata["anchor"]) == ("shown", "xl/media/image1.png", "A2:B4")


def test_slide_levels_links_and_groups():
    slide = (
        '<p:sld xmlns:p="p" xmlns:a="a" xmlns:r="r" show="0"><p:cSld><p:spTree><p:grpSp><p:sp><p:nvSpPr><p:cNvPr name="in group"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="1" y="2"/><a:ext cx="3" cy="4"/></a:xfrm></p:spPr>'
        '<p:txBody><a:p><a:pPr lvl="1"><a:buChar char="-"/></a:pPr><a:r><a:rPr><a:hlinkClick r:id="rL"/></a:rPr><a:t>key point</a:t></a:r></a:p><a:p/></p:txBody></p:sp></p:grpSp>'
        '<p:pic><p:nvPicPr><p:cNvPr name="photo" descr="a room"/></p:nvPicPr><p:blipFill><a:blip r:embed="rI"/></p:blipFill></p:pic></p:spTree></p:cSld><p:transition spd="fast"/><p:timing/></p:sld>'
    )
    rels = REL.format('<Relationship Id="rL" Target="https://x.y/z" TargetMode="External"/><Relationship Id="rI" Target="../media/image1.png"/>')
    got = office.read_pptx(zipped(PPTX | {"ppt/slides/slide1.xml": slide, "ppt/slides/_rels/slide1.xml.rels": rels}))
    assert [(b.kind, b.text) for b in got] == [("list_item", "key point"), ("image_metadata", "a room")]
    assert {k: got[0].metadata[k] for k in ("level", "hyperlinks", "bounds", "hidden", "transition", "timing")} == {"level": 1, "hyperlinks": "https://x.y/z", "bounds": "1,2,3,4", "hidden": True, "transition": "fast", "timing": True}
    assert got[1].metadata["target"] == "ppt/media/image1.png"
