"""Blocks: canonical form, noise, eligibility, profiles of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kunits.functions import lang
from kunits.functions.text import clean, clean_text, json_text, unique_first
from kunits.schema import BLOCK_KINDS, LAYOUT_KINDS, LOCATOR

#: Lines that are noise by themselves (fixed values).
PAGE_OR_CONTENTS = r"(?i)^(第\s*\d+\s*页|page\s+\d+|目录|table of contents)$"
BARE_SIGNATURE = r"(?i)^(签字|签名|signature|免责声明|disclaimer)\s*[:：]?$"
#: Line classes of Markdown and plain text (fixed values).
LINES = (("fence", r"^\s*(```|~~~)"), ("heading", r"^#{1,6}\s+\S"), ("table", r"^\s*\|.*\|\s*$"), ("list", r"^\s*([-*+]|\d+[.)])\s+\S"), ("blank", r"^\s*$"))


def canonical_locator(locator: Column, block_id: Column) -> Column:
    """The locator with scheme ``block`` and the block's id where they are missing."""
    keep = [F.when(F.trim(locator[k].cast("string")) != "", locator[k]).alias(k) for k in ("page", "sheet", "range", "row", "column", "message_id", "attachment_id")]
    scheme = F.coalesce(F.nullif(F.trim(locator["scheme"]), F.lit("")), F.lit("block"))
    value = F.coalesce(F.nullif(F.trim(locator["value"]), F.lit("")), block_id)
    return F.struct(scheme.alias("scheme"), value.alias("value"), *keep, locator["heading_path"].alias("heading_path")).cast(LOCATOR)


def strict_locator(locator: Column) -> Column:
    """The locator, null without scheme or value."""
    given = (clean_text(locator["scheme"], 80) != "") & (clean_text(locator["value"], 500) != "")
    return F.when(given, locator)


def cleaned(raw: DataFrame) -> DataFrame:
    """Raw blocks with clean texts; those without any go, unless they are of layout. A text is cleaned once, not again for the filter."""
    all_, given = F.array(clean(F.col("text"), 30000)), F.array_remove(F.array(clean(F.col("text"), 30000)), "")
    some = F.when(F.col("kind").isin(*LAYOUT_KINDS), all_).otherwise(given) if "kind" in raw.columns else given
    return raw.select(*(F.explode(some).alias("text") if c == "text" else F.col(c) for c in raw.columns))


def canonical_blocks(raw: DataFrame, clean_texts: bool = False) -> DataFrame:
    """Raw blocks as canonical ones: cleaned text, known kind, hierarchy, id, locator, language.

    Blocks without text go, unless they are of layout. ``source_kind`` keeps
    the parser's kind. A missing id is derived from source, order and text.
    With *clean_texts* they are those of :func:`cleaned` already.
    """
    given = clean(F.col("block_id"), 160)
    made = F.concat(F.lit("blk-"), F.substring(F.sha2(F.concat(F.lit("["), json_text(F.col("source_document_id")), F.lit(","), F.col("ord"), F.lit(","), json_text(F.col("text")), F.lit("]")), 256), 1, 20))
    empty = F.array().cast("array<string>")
    hierarchy = F.concat(F.coalesce("hierarchy", empty), F.coalesce("heading_path", empty), F.array(F.substring(F.coalesce("heading", F.lit("")), 1, 300)))
    rows = (raw if clean_texts else cleaned(raw)).withColumn("source_kind", F.col("kind"))
    rows = rows.withColumns({
        "block_id": F.when(given != "", given).otherwise(made),
        "kind": F.when(F.col("kind").isin(*BLOCK_KINDS), F.col("kind")).otherwise("text"),
        "hierarchy": unique_first(F.transform(hierarchy, lambda h: F.trim(h))),
        "parse_status": F.when(F.trim(F.coalesce("parse_status", F.lit(""))) != "", F.trim("parse_status")).otherwise(F.when(F.col("text") != "", "present").otherwise("missing")),
        "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>")),
    })
    return rows.withColumns({"locator": canonical_locator(F.col("locator"), F.col("block_id")), "source_language": lang.detect_language(F.col("text"))})


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One block a line: doc id, ord (from 0), text."""
    return docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("ord", "text"))


def text_blocks(docs: DataFrame, id_col: str = "source_document_id", text_col: str = "text") -> DataFrame:
    """Blocks of Markdown or plain text: kind, first and last line, text.

    Runs of lines of one class are blocks; a heading is one by itself, a fence
    lasts to its end. Ids depend on content and lines, not on a path.
    """
    lines = line_blocks(docs, id_col, text_col)
    kind = F.lit("paragraph")
    for name, pattern in reversed(LINES):
        kind = F.when(F.col("text").rlike(pattern), name).otherwise(kind)
    order = W.partitionBy(id_col).orderBy("ord")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("kind", kind)
    fences = F.sum((F.col("kind") == "fence").cast("int")).over(so_far)
    lines = lines.withColumn("inside", (fences % 2 == 1) | (F.col("kind") == "fence"))
    lines = lines.withColumn("kind", F.when(F.col("inside"), "code_block").otherwise(F.col("kind")))
    opens = (F.col("kind") == "code_block") & (fences % 2 == 1) & F.col("text").rlike(LINES[0][1])
    start = F.lag("kind").over(order).isNull() | (F.lag("kind").over(order) != F.col("kind")) | (F.col("kind") == "heading") | opens
    runs = lines.withColumn("run", F.sum(start.cast("int")).over(so_far)).where("kind <> 'blank'")
    made = runs.groupBy(id_col, "run").agg(F.first("kind").alias("kind"), F.min("ord").alias("first"), F.max("ord").alias("last"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("lines"))
    made = made.withColumn("text", F.array_join(F.transform("lines", lambda line: line["text"]), "\n"))
    locator = F.concat(F.lit("L"), F.col("first") + 1, F.when(F.col("last") > F.col("first"), F.concat(F.lit("-L"), F.col("last") + 1)).otherwise(""))
    block_id = F.concat(F.lit("blk-"), F.substring(F.sha2(F.concat_ws("\n", locator, "text"), 256), 1, 20))
    return made.select(id_col, block_id.alias("block_id"), (F.row_number().over(W.partitionBy(id_col).orderBy("first")) - 1).alias("ord"), "kind", "text", locator.alias("locator"))


def with_occurrence(blocks: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """occurrence: how often the text stands in its document."""
    return blocks.withColumn("occurrence", F.count("*").over(W.partitionBy(id_col, "text")))


def flag(metadata: Column, *names: str) -> Column:
    """Whether any of the metadata is ``true``; missing is not."""
    out = F.lit(False)
    for name in names:
        out = out | (metadata[name].eqNullSafe(F.lit("true")))
    return out


def noise_reason(text: Column, kind: Column, occurrence: Column, marked: Column) -> Column:
    """Why a block is noise; empty if it isn't. Patterns of whole lines are tried where the first character fits."""
    line = lambda pattern, starts: F.substring(text, 1, 1).isin(*starts) & text.rlike(pattern)
    return (
        F.when(text == "", "空内容").when(marked, "适配器标记为结构噪声").when(line(PAGE_OR_CONTENTS, "第pP目tT"), "页码或目录")
        .when(kind.isin("header", "footer") & (occurrence > 1), "重复页眉页脚").when(line(BARE_SIGNATURE, "签sS免dD"), "无义务内容的签名或声明").otherwise("")
    )


def eligible(blocks: DataFrame) -> DataFrame:
    """Blocks that may become candidates."""
    ok = F.col("card_eligible").eqNullSafe(True) & F.col("parse_status").eqNullSafe("present") & ~flag(F.col("metadata"), "noise", "structural_noise")
    return blocks.where(ok & (clean_text(F.col("text"), 6000) != ""))


#: Characters of a document that its profile looks at.
PROFILED = 100_000


def lifecycles(parts: DataFrame, text: str, order: str, id_col: str = "source_document_id") -> DataFrame:
    """Adds the lifecycle that :func:`profiles` has without metadata, from the parts of a document's text, line breaks between them.

    A part is looked at as far as it lies within the profile's characters.
    What is looked for are literals of one line, so parts tell it together.
    """
    whole = W.partitionBy(id_col)
    before = F.coalesce(F.sum(F.char_length(text) + 1).over(whole.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = tuple((str(i), pattern) for i, (_, pattern) in enumerate(lang.LIFECYCLES))
    rows = parts.withColumn("_before", before)
    rows = rows.withColumn("_place", lang.first_of(F.substring(F.col(text), F.lit(1), F.greatest(PROFILED - F.col("_before"), F.lit(0)).cast("int")), places, str(len(places)))).drop("_before", text)
    names = F.array(*(F.lit(name) for name, _ in lang.LIFECYCLES), F.lit("unknown"))
    return rows.withColumn("lifecycle", F.get(names, F.min("_place").over(whole).cast("int"))).drop("_place")


def profiles(blocks: DataFrame, documents: DataFrame | None = None, id_col: str = "source_document_id") -> DataFrame:
    """One semantic profile a document, from its blocks' text (of 100,000 characters at most).

    *documents* may give ``metadata`` (map) by id: its lifecycle, project and
    entity fields go before what the text says.
    """
    parts = blocks.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("lines"),
        F.max((F.size("hierarchy") > 0) | F.col("kind").isin("heading", "table")).alias("structured"),
    )
    rows = parts.withColumn("text", F.substring(F.array_join(F.transform("lines", lambda line: line["text"]), "\n"), 1, PROFILED)).drop("lines")
    none = F.create_map().cast("map<string,string>")
    rows = rows.join(documents.select(id_col, "metadata"), id_col, "left").withColumn("metadata", F.coalesce("metadata", none)) if documents is not None else rows.withColumn("metadata", none)
    m = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col("metadata")[n]), F.lit("")) for n in names))
    rows = rows.withColumn("purposes", F.slice(lang.ranked_kinds(lang.semantic_signals(F.col("text"))), 1, 6))
    rows = rows.withColumn("lifecycle", F.coalesce(m("project_state", "lifecycle", "status"), lang.first_of(F.col("text"), lang.LIFECYCLES, "unknown")))
    known = F.col("lifecycle") != "unknown"
    return rows.select(
        id_col,
        F.when(F.size("purposes") > 0, F.col("purposes")).otherwise(F.array(F.lit("fact"))).alias("purposes"),
        lang.domains(F.col("text")).alias("business_domains"), "lifecycle",
        unique_first(F.array(m("project_id"), m("project_name"), m("project_reference"))).alias("project_scope"),
        unique_first(F.array(m("entity_id"), m("client"), m("supplier"))).alias("entity_scope"),
        F.coalesce(m("valid_until", "effective_date", "version"), F.lit("")).alias("temporal_validity"),
        lang.first_of(F.col("text"), lang.AUTHORITIES, "informational").alias("authority"),
        F.when(F.col("text").rlike("(?i)" + lang.RESTRICTED), "restricted").otherwise("normal").alias("confidentiality"),
        F.slice("purposes", 1, 3).alias("dominant_patterns"),
        F.when(F.col("structured"), 0.9).otherwise(0.65).alias("structural_confidence"),
        F.struct(F.when(F.size("purposes") > 0, 0.82).otherwise(0.55).alias("purpose"), F.when(known, 0.85).otherwise(0.45).alias("lifecycle"), F.lit(0.75).alias("authority")).alias("confidence"),
        F.when(known, F.array().cast("array<string>")).otherwise(F.array(F.lit("项目生命周期未从显式元数据或正文确定"))).alias("uncertainty"),
    )
