"""Scans: files of all kinds to block rows, with errors as rows; OCR; intake."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kunits.functions.decode import decode_bytes
from kunits.functions.numbers import clamp, rotation
from kunits.sources.archive import STATUS, PackageError
from kunits.sources.mail import read_eml, read_msg
from kunits.sources.office import Block, read_docx, read_pptx, read_xlsx

LOCAL = ("docx", "xlsx", "pptx", "msg", "eml", "txt", "md")
BLOCKS = "path string, source_hash string, status string, code string, message string, ord int, kind string, text string, locator struct<scheme:string,value:string>, metadata map<string,string>, card_eligible boolean, exclusion_reason string"
_NAMES = ["path", "source_hash", "status", "code", "message", "ord", "kind", "text", "locator", "metadata", "card_eligible", "exclusion_reason"]


def extension(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, content of the files under a folder, with their hash."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "length", "modificationTime", "content", F.sha2("content", 256).alias("source_hash"))


def intake(found: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each content that isn't known yet: the first path of each hash."""
    new = found.join(known.select("source_hash"), "source_hash", "left_anti")
    return new.groupBy("source_hash").agg(F.min("path").alias("path"))


def _text_blocks(data: bytes) -> list[Block]:
    text, encoding, score = decode_bytes(data)
    if text is None:
        raise PackageError("TEXT_DECODE_FAILED", f"unreadable ({encoding}, {score:.2f})")
    out, start, kind, held = [], 0, "", []
    rules = (("heading", r"#{1,6}\s+\S"), ("table", r"\s*\|.*\|\s*$"), ("list", r"\s*([-*+]|\d+[.)])\s+\S"))
    fence = False
    lines = text.splitlines()

    def flush(end: int) -> None:
        if held and any(h.strip() for h in held):
            out.append(Block(kind, "\n".join(held), f"L{start + 1}" + (f"-L{end}" if end > start + 1 else ""), {"encoding": encoding}))

    for i, line in enumerate([*lines, None]):
        mark = line is not None and bool(re.match(r"\s*(```|~~~)", line))
        now = "" if line is None else "code_block" if fence or mark else "" if not line.strip() else next((k for k, p in rules if re.match(p, line)), "paragraph")
        if line is None or now != kind or now == "heading" or (mark and not fence):
            flush(i)
            start, kind, held = i, now, []
        if line is not None:
            held.append(line)
        fence ^= mark
    return out


def pdf_pages(data: bytes) -> list[dict]:
    """page, classification (native, scanned, mixed, blank), rotation, ocr_required: from the file's own objects."""
    raw = data.decode("latin1")
    objects = {int(m[1]): m[2] for m in re.finditer(r"(?s)(\d+)\s+\d+\s+obj\b(.*?)endobj", raw)}
    out = []
    for body in objects.values():
        if not re.search(r"/Type\s*/Page(?![a-zA-Z])", body):
            continue
        content = body
        for n in re.findall(r"/Contents\s*\[?((?:\s*\d+\s+\d+\s+R)+)", body):
            for k in re.findall(r"(\d+)\s+\d+\s+R", n):
                content += _stream(objects.get(int(k), ""))
        resources = body + "".join(objects.get(int(k), "") for k in re.findall(r"/(?:Resources|XObject|Im\w*|Font|F\w*)\s+(\d+)\s+\d+\s+R", body))
        words, image = bool(re.search(r"\b(?:Tj|TJ)\b", content)), bool(re.search(r"/Subtype\s*/Image\b|\bDo\b", resources + content))
        turn = int(m[1]) % 360 if (m := re.search(r"/Rotate\s+(-?\d+)", body)) else 0
        kind = "mixed" if words and image else "native" if words else "scanned" if image else "blank"
        out.append({"page": len(out) + 1, "classification": kind, "rotation": turn, "ocr_required": kind in ("scanned", "mixed")})
    return out


def _stream(body: str) -> str:
    m = re.search(r"(?s)stream\r?\n(.*?)\r?\nendstream", body)
    if not m:
        return ""
    raw = m[1].encode("latin1")
    if "/FlateDecode" in body:
        try:
            return zlib.decompressobj().decompress(raw, 16 << 20).decode("latin1")
        except zlib.error:
            return ""
    return m[1]


def _pdf_text(data: bytes) -> list[Block]:
    """Text by optional readers: pdfplumber, then pypdf where there are fewer than 20 characters."""
    import importlib
    import io

    for name in ("pdfplumber", "pypdf"):
        try:
            module = importlib.import_module(name)
        except ImportError:
            continue
        pages = module.open(io.BytesIO(data)).pages if name == "pdfplumber" else module.PdfReader(io.BytesIO(data)).pages
        found = [Block("page", (p.extract_text() or "").strip(), f"page:{i}", {"page": i, "extractor": name}) for i, p in enumerate(pages, 1)]
        if sum(len(b.text) for b in found) >= 20:
            return [b for b in found if b.text]
    raise PackageError("PDF_READER_UNAVAILABLE", "no reader of PDF text gave text")


READERS: dict[str, Callable[[bytes], list[Block]]] = {"docx": read_docx, "xlsx": read_xlsx, "pptx": read_pptx, "eml": read_eml, "msg": read_msg, "txt": _text_blocks, "md": _text_blocks, "pdf": _pdf_text}


def read_blocks(found: DataFrame, readers: dict[str, Callable[[bytes], list[Block]]] | None = None) -> DataFrame:
    """Block rows of files (path, content, source_hash); a file that can't be read gives one row with status and code.

    Readers are looked up by extension; others may be given. Statuses: ok,
    review_required (nothing eligible), unsupported, limits_exceeded,
    cancelled, failed.
    """
    table = READERS | (readers or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, data, mark in zip(pdf["path"], pdf["content"], pdf["source_hash"], strict=True):
                kind = path.lower().rpartition(".")[2]
                empty = {"scheme": "file", "value": path}
                try:
                    if kind not in table:
                        raise PackageError("OOXML_UNSUPPORTED", f"自动识别暂不支持：{kind or 'unknown'}")
                    blocks = table[kind](bytes(data))
                    ok = any(b.eligible and b.text for b in blocks)
                    status, code = ("ok", "") if ok else ("review_required", "OOXML_NO_ELIGIBLE_CONTENT")
                    rows = [(path, mark, status, code, "", i, b.kind, b.text, {"scheme": "ooxml" if kind in ("docx", "xlsx", "pptx") else kind, "value": b.locator}, {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in b.metadata.items()}, b.eligible, b.reason) for i, b in enumerate(blocks)]
                    rows = rows or [(path, mark, status, code, "", None, None, None, empty, {}, False, "")]
                except PackageError as e:
                    rows = [(path, mark, STATUS.get(e.code, "failed"), e.code, str(e), None, None, None, empty, {}, False, "")]
                except Exception as e:  # one broken file must not stop a scan: it becomes a row
                    rows = [(path, mark, "failed", "OOXML_EXTRACTION_FAILED", f"{type(e).__name__}: {e}", None, None, None, empty, {}, False, "")]
                yield pd.DataFrame(rows, columns=_NAMES)

    return found.select("path", "content", "source_hash").mapInPandas(run, BLOCKS)


def pdf_probe(content: Column) -> Column:
    """struct(pages, native_text, complex_layout, reliable_local) from counts of PDF tokens; native."""
    raw = F.decode(content, "ISO-8859-1")
    n = lambda p: F.regexp_count(raw, F.lit(p))
    pages = F.greatest(n(r"/Type\s*/Page(?!s)\b"), F.lit(1))
    native = (n(r"\b(?:BT|Tj|TJ)\b") >= pages) & (n(r"/(?:Font|ToUnicode)\b") > 0)
    complex_ = (n(r"/Subtype\s*/Image\b") > F.greatest(F.lit(2), pages * 2)) | (n(r"/Rotate\s+-?\d+") > 0)
    return F.struct(pages.alias("pages"), native.alias("native_text"), complex_.alias("complex_layout"), (native & ~complex_).alias("reliable_local"))


def quality_ok(status: Column, markdown: Column, eligible_blocks: Column, corrupt_ratio: Column) -> Column:
    """The gate for parsed files; a missing ratio fails."""
    return (status == "ok") & (F.char_length(F.trim(F.coalesce(markdown, F.lit("")))) >= 20) & (eligible_blocks > 0) & F.coalesce(corrupt_ratio <= 0.02, F.lit(False))


def dispatch(found: DataFrame) -> DataFrame:
    """Adds route: local, local_pdf, ocr_or_cloud, or unsupported."""
    kind = extension(F.col("path"))
    probe = pdf_probe(F.col("content"))
    return found.withColumn("route", F.when(kind.isin(*LOCAL), "local").when(kind == "pdf", F.when(probe["reliable_local"], "local_pdf").otherwise("ocr_or_cloud")).otherwise("unsupported"))


def tesseract_rows(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Adds text, confidence (0 to 1), bbox of the word lines of a recogniser's TSV; the header must be its own."""
    p = F.split(F.col(line_col), "\t", 12)
    word = (F.size(p) >= 12) & (p[0] == "5") & (F.trim(F.try_element_at(p, F.lit(12))) != "")
    d = lambda i: p[i].try_cast("double")
    rows = lines.where(word)
    return rows.withColumns({"text": F.trim(p[11]), "confidence": F.greatest(d(10), F.lit(0.0)) / 100, "bbox": F.array(d(6), d(7), d(6) + d(8), d(7) + d(9))})


def visual_type(column: Column) -> Column:
    c = F.lower(F.coalesce(column, F.lit("")))
    return F.when(c.rlike("stamp|seal|印章|盖章"), "stamp").when(c.rlike("signature|签名|签字"), "signature").when(c.rlike("approval|批准|审批"), "approval_visual").otherwise("")


def normalize_ocr(blocks: DataFrame, threshold: float = 0.75) -> DataFrame:
    """OCR blocks with clamped confidence, visual type, eligibility, reason and locator."""
    rows = blocks.withColumns({"text": F.trim(F.coalesce("text", F.lit(""))), "confidence": clamp(F.col("confidence"), 0, 1, 0), "visual_type": visual_type(F.coalesce("visual_type", "kind")), "rotation": rotation(F.col("rotation"))})
    low = F.col("confidence") < threshold
    reason = F.when(F.col("visual_type") != "", F.concat(F.lit("unverified_"), "visual_type")).when(F.col("text") == "", "empty_ocr").when(low, "low_confidence_ocr")
    place = F.concat(F.lit("page:"), F.col("page").cast("string"), F.lit(":ocr:"), F.col("nth").cast("string"))
    return rows.withColumns({"card_eligible": reason.isNull(), "exclusion_reason": reason, "locator": F.struct(F.lit("pdf-quote").alias("scheme"), place.alias("value"), F.sha2("text", 256).alias("quote_hash"))})


def ocr_pages(blocks: DataFrame, keys: list[str], threshold: float = 0.75) -> DataFrame:
    """keys, page, text, confidence (mean, six places), status of each page."""
    rows = blocks.groupBy(*keys, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("nth", "text")))), lambda x: x["text"]), "\n").alias("text"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return rows.withColumn("status", F.when(F.col("text") == "", "empty").when(F.col("confidence") >= threshold, "ok").otherwise("low_confidence"))


def ocr_metrics(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    a = pages.agg(F.count("*").alias("pages_completed"), F.sum(F.char_length("text")).alias("text_characters"), F.count_if(F.col("status") == "low_confidence").alias("low_confidence_pages"))
    return a.join(blocks.agg(F.count_if(F.col("exclusion_reason") == "low_confidence_ocr").alias("low_confidence_blocks")))  # one row each


def recognize(pages: DataFrame, recognizer: Callable[[bytes, dict], list[dict]] | None, limits: dict | None = None) -> DataFrame:
    """OCR block rows of scanned and mixed pages (path, page, classification, rotation, image) by a provider.

    Without a provider, and for pages over the limits of bytes, each page
    gives one row with ``error``.
    """
    most = (limits or {}).get("page_bytes", 64 << 20)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.to_dict("records"):
                base = {"path": r["path"], "page": r["page"], "rotation": r["rotation"]}
                try:
                    if recognizer is None:
                        raise RuntimeError("OCR_PROVIDER_UNAVAILABLE")
                    if r["image"] is not None and len(r["image"]) > most:
                        raise RuntimeError("OCR_LIMITS_EXCEEDED")
                    rows = [{**base, "nth": i, "text": b.get("text"), "confidence": float(b.get("confidence") or 0), "bbox": b.get("bbox"), "kind": b.get("kind"), "visual_type": b.get("visual_type"), "error": None} for i, b in enumerate(recognizer(bytes(r["image"] or b""), r), 1)]
                except Exception as e:  # a page that fails is a row, the others go on
                    rows = [{**base, "nth": 0, "text": None, "confidence": 0.0, "bbox": None, "kind": None, "visual_type": None, "error": str(e)}]
                yield pd.DataFrame(rows, columns=["path", "page", "rotation", "nth", "text", "confidence", "bbox", "kind", "visual_type", "error"])

    needed = pages.where(F.col("classification").isin("scanned", "mixed"))
    return needed.mapInPandas(run, "path string, page int, rotation int, nth int, text string, confidence double, bbox array<double>, kind string, visual_type string, error string")


def probe_recognizer(executable: str = "tesseract") -> dict:
    """Whether a recogniser is on this machine's path, and its version."""
    import shutil
    import subprocess

    found = shutil.which(executable)
    if not found:
        return {"available": False, "reason": "executable_missing"}
    out = subprocess.run([found, "--version"], capture_output=True, text=True, timeout=10, check=False)
    return {"available": out.returncode == 0, "executable": found, "version": (out.stdout or out.stderr).split("\n")[0]}
