"""Knowledge in tables: cells, headers, subjects, evidence, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kunits.functions.numbers import column_number
from kunits.functions.text import nfkc

#: What counts as an empty cell, a header and a subject; header rows that a table has at most (fixed values).
EMPTY_CELL = r"(?i)^(?:[-—/\\]|n/?a|无|合计|小计|序号)$"
HEADER_WORDS = r"(?i)材料|产品|部位|位置|区域|系统|规格|型号|单位|性能|要求|做法|施工|验收|责任|适用|备注|名称"
SUBJECT_WORDS = r"(?i)材料|产品|名称|部位|位置|区域|系统|做法"
SEPARATOR = r"^:?-{3,}:?$"
HEADER_ROWS = 5


def cell_text(value: Column, normal: bool = True) -> Column:
    text = F.coalesce(value, F.lit(""))
    return F.trim(F.regexp_replace(nfkc(text) if normal else text, r"\s+", " "))


def meaningful(value: Column) -> Column:
    return (F.coalesce(value, F.lit("")) != "") & ~value.rlike(EMPTY_CELL)


def header_like(value: Column) -> Column:
    return value.rlike(HEADER_WORDS)


def table_key(kind: Column, metadata: Column, locator_value: Column, block_id: Column) -> Column:
    """Which table a block belongs to, empty for none. Slides count: their tables have numbers of their own."""
    m = lambda k: F.coalesce(metadata[k], F.lit(""))
    slide = F.coalesce(F.concat(F.lit("pptx:"), metadata["slide"], F.lit(":"), m("table")), F.lit(None))
    return (
        F.when(kind == "spreadsheet_cell", F.concat(F.lit("xlsx:"), m("sheet"))).when((kind == "table_cell") & metadata["slide"].isNotNull(), slide)
        .when(kind == "table_cell", F.concat(F.lit("docx:"), m("part"), F.lit(":"), F.coalesce(metadata["table"], F.lit("0"))))
        .when(kind == "table", F.concat(F.lit("text:"), F.coalesce(locator_value, block_id)))
        .when(kind.rlike("(?i)table") | metadata["table"].isNotNull() | metadata["table_id"].isNotNull(), F.concat(F.lit("ocr:"), F.coalesce(metadata["table_id"], metadata["table"], locator_value, block_id)))
        .otherwise("")
    )


def cell_position(metadata: Column, nth: Column) -> tuple[Column, Column]:
    """(row, column) of a cell: numbers as they are, letters as numbers; row falls back to *nth*, column to 1."""
    row = F.coalesce(metadata["row"].try_cast("int"), metadata["table_row"].try_cast("int"), nth.cast("int"))
    letters = F.when(metadata["column"].rlike("^[A-Za-z]+$"), column_number(metadata["column"]))
    column = F.coalesce(metadata["cell"].try_cast("int"), metadata["column_index"].try_cast("int"), metadata["column"].try_cast("int"), letters, F.lit(1))
    return row, column


def markdown_cells(rows: DataFrame, keys: list[str], text_col: str = "text", normal: bool = True) -> DataFrame:
    """keys, row, col (from 1), value: cells of pipe tables; separator rows are dropped."""
    lines = rows.select(*keys, F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n"), lambda line: line.rlike(r"^\s*\|.*\|\s*$")).alias("lines"))
    lines = lines.select(*keys, F.posexplode("lines").alias("nth", "line"))
    parts = F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|")
    lines = lines.withColumn("cells", F.transform(parts, lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))))
    lines = lines.where(~F.forall("cells", lambda c: c.rlike(SEPARATOR)))
    cells = lines.select(*keys, (F.col("nth") + 1).alias("row"), F.posexplode("cells").alias("at", "value"))
    return cells.select(*keys, "row", (F.col("at") + 1).alias("col"), (cell_text(F.col("value")) if normal else F.col("value")).alias("value"))


def collect_cells(blocks: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """id, table_key, row, col, value, block_id, merged, ord: cells of all kinds of tables."""
    m = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    rows = blocks.withColumns({"metadata": m}).withColumn("table_key", table_key(F.col("kind"), F.col("metadata"), F.col("locator.value"), F.col("block_id")))
    rows = rows.where((F.col("table_key") != "") & ~F.col("card_eligible").eqNullSafe(False) & ~F.col("parse_status").eqNullSafe("missing"))
    flat = rows.where("kind <> 'table'").withColumn("nth", F.row_number().over(W.partitionBy(id_col, "table_key").orderBy("ord")))
    row, column = cell_position(F.col("metadata"), F.col("nth"))
    merged = F.coalesce(F.col("metadata")["merge"], F.lit("none")).isin("none", "") == F.lit(False)
    flat = flat.select(id_col, "table_key", row.alias("row"), column.alias("col"), cell_text(F.col("text")).alias("value"), "block_id", merged.alias("merged"), "ord")
    text = markdown_cells(rows.where("kind = 'table'"), [id_col, "table_key", "block_id", "ord"]).withColumn("merged", F.lit(False))
    return flat.unionByName(text.select(*flat.columns))


def fill_merged(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Blank cells of merges take the last meaningful cell that is not below or right of them.

    A two-dimensional as-of join within a table: the last by place in the
    table's order, among cells of at most the same row and column.
    """
    full = cells.where(meaningful(F.col("value"))).select(*keys, F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("v"), F.struct("ord", "row", "col").alias("o"))
    blank = cells.where(F.col("merged") & ~meaningful(F.col("value"))).select(*keys, "row", "col")
    near = blank.join(full, keys).where((F.col("r") <= F.col("row")) & (F.col("c") <= F.col("col"))).groupBy(*keys, "row", "col").agg(F.max_by("v", "o").alias("filled"))
    value = F.when(meaningful(F.col("value")), F.col("value")).otherwise(F.coalesce("filled", F.lit("")))
    return cells.join(near, [*keys, "row", "col"], "left").withColumn("value", value).drop("filled")


def header_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row: the header rows, of the first five rows; a repeated one ends them.

    The first row with content is a header; a later one is if half its cells
    read like headers or it has one cell only. Tables without content take
    their first row.
    """
    rows = cells.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"))
    good = F.filter(F.transform("cells", lambda c: c["value"]), lambda v: meaningful(v))
    rows = rows.withColumns({"good": good, "nth": F.row_number().over(W.partitionBy(*keys).orderBy("row"))}).where(F.col("nth") <= HEADER_ROWS)
    rows = rows.withColumns({"signature": F.lower(F.array_join("good", "|")), "n": F.size("good"), "like": F.size(F.filter("good", lambda v: header_like(v)))})
    first = rows.groupBy(*keys).agg(F.min("row").alias("top"))
    w = W.partitionBy(*keys).orderBy("row")
    some = rows.where("n > 0").withColumns({"rank": F.row_number().over(w), "before": F.lag("signature").over(w)})
    stop = (F.col("rank") > 1) & ((F.col("signature") == F.col("before")) | ((F.col("like") / F.col("n") < 0.5) & (F.col("n") > 1)))
    some = some.withColumn("stopped", F.max(stop.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("stopped = 0").select(*keys, "row")
    bare = first.join(some, keys, "left_anti").select(*keys, F.col("top").alias("row"))
    return some.unionByName(bare)


def subjects(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, subject, content, fields: the knowledge of each body row, with ``dropped`` rows.

    dropped is ``empty``, ``repeated_header``, ``duplicate`` or null.
    """
    heads = header_rows(cells, keys)
    named = cells.join(heads, [*keys, "row"]).where(meaningful(F.col("value")))
    headers = named.groupBy(*keys, "col").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"])), " / ").alias("header"))
    body = cells.join(heads, [*keys, "row"], "left_anti").join(headers, [*keys, "col"], "left")
    body = body.withColumn("header", F.coalesce("header", F.concat(F.lit("第"), F.col("col"), F.lit("列"))))
    rows = body.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", "header", "value", "block_id"))).alias("all"))
    fields = F.filter("all", lambda f: meaningful(f["value"]))
    last = lambda h: F.lower(F.element_at(F.split(h, " / "), -1))
    same = F.size(F.filter("all", lambda f: F.lower(f["value"]) == last(f["header"])))
    rows = rows.withColumns({"fields": fields, "n": F.size(fields), "same": same})
    signature = F.lower(F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["header"], f["value"])), "|"))
    rows = rows.withColumn("signature", signature)
    first = F.when(F.col("n") == 0, "empty").when(F.col("same") >= F.greatest(F.lit(2), F.ceil(F.col("n") * 0.6)), "repeated_header")
    rows = rows.withColumn("dropped", first)
    nth = F.row_number().over(W.partitionBy(*keys, "signature", F.col("dropped").isNull()).orderBy("row"))
    rows = rows.withColumn("nth", nth).withColumn("dropped", F.when(F.col("dropped").isNull() & (F.col("nth") > 1), "duplicate").otherwise(F.col("dropped")))
    about = F.filter("fields", lambda f: f["header"].rlike(SUBJECT_WORDS))
    rest = F.filter("fields", lambda f: ~f["header"].rlike(SUBJECT_WORDS))
    pairs = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws("=", f["header"], f["value"])), "；")
    subject = F.coalesce(F.nullif(F.array_join(F.transform(about, lambda f: f["value"]), " / "), F.lit("")), F.try_element_at("fields", F.lit(1))["value"])
    rows = rows.withColumn("subject", subject)
    content = F.concat(F.col("subject"), F.lit("："), F.coalesce(F.nullif(pairs(rest), F.lit("")), pairs(F.col("fields"))))
    return rows.select(*keys, "row", "subject", content.alias("content"), "fields", "dropped")


def key_points(found: DataFrame, keys: list[str], key: str = "table_key") -> DataFrame:
    """point_id, content, evidence_ids for each kept row; equal contents of one document once."""
    doc = [k for k in keys if k != key]
    rows = found.where("dropped is null").withColumn("normal", F.lower(cell_text(F.col("content"))))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(*doc, "normal").orderBy(key, "row"))).where("nth = 1")
    evidence = F.transform("fields", lambda f: F.concat(F.lit("table-evidence-"), F.substring(F.sha2(F.concat_ws("|", f["block_id"], F.col("row").cast("string"), f["col"].cast("string"), f["value"]), 256), 1, 20)))
    return rows.select(*doc, key, "row", F.concat(F.lit("table-point-"), F.substring(F.sha2(F.concat_ws("|", key, "content"), 256), 1, 20)).alias("point_id"), "subject", "content", F.array_distinct(evidence).alias("evidence_ids"))


def new_points(points: DataFrame, existing: DataFrame, doc: list[str]) -> DataFrame:
    """Points whose content a document's summary doesn't have yet: left anti join by lower-case content."""
    known = existing.select(*doc, F.lower(cell_text(F.col("content"))).alias("normal"))
    return points.withColumn("normal", F.lower(cell_text(F.col("content")))).join(known, [*doc, "normal"], "left_anti").drop("normal")


def diagnostics(found: DataFrame, points: DataFrame, doc: list[str], key: str = "table_key") -> DataFrame:
    """tables_found, subjects_found, candidates, dropped by reason, coverage_ratio, dense_warning of each document."""
    per = found.groupBy(*doc, key).agg(F.count_if(F.col("dropped").isNull()).alias("subjects"), *(F.count_if(F.col("dropped") == d).alias(d) for d in ("empty", "repeated_header", "duplicate")))
    rows = per.groupBy(*doc).agg(F.count("*").alias("tables_found"), F.sum("subjects").alias("subjects_found"), F.max((F.col("subjects") >= 6)).alias("dense"), *(F.sum(d).alias(f"dropped_{d}") for d in ("empty", "repeated_header", "duplicate")))
    rows = rows.join(points.groupBy(*doc).agg(F.count("*").alias("n")), doc, "left").withColumn("candidates_generated", F.coalesce("n", F.lit(0)))
    ratio = F.coalesce(F.try_divide(F.col("candidates_generated").cast("double"), F.col("subjects_found").cast("double")), F.lit(1.0))
    return rows.withColumn("coverage_ratio", ratio).withColumn("dense_warning", F.col("dense") & (F.col("coverage_ratio") < 0.6)).drop("dense", "n")


def unique_row_labels(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, label: the leftmost text of a row, where it occurs in one row only."""
    first = cells.where(F.coalesce("value", F.lit("")) != "").groupBy(*keys, "row").agg(F.min_by("value", "col").alias("label"))
    first = first.where(~F.col("label").rlike(r"^-?\d+(\.\d+)?$")).withColumn("n", F.count("*").over(W.partitionBy(*keys, "label")))
    return first.where("n = 1").drop("n")


def expand_ranges(ranges: DataFrame, range_col: str = "range") -> DataFrame:
    """A row for each cell of a range such as B2:D5: row, col, and whether it is the anchor."""
    parts = F.split(F.col(range_col), ":")
    a, b = parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)), parts[0])
    col, row = lambda c: column_number(F.regexp_extract(c, "^([A-Za-z]+)", 1)), lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("int")
    rows = ranges.withColumns({"c1": col(a), "r1": row(a), "c2": col(b), "r2": row(b)})
    rows = rows.withColumn("row", F.explode(F.sequence("r1", "r2"))).withColumn("col", F.explode(F.sequence("c1", "c2")))
    return rows.withColumn("anchor", (F.col("row") == F.col("r1")) & (F.col("col") == F.col("c1"))).drop("c1", "r1", "c2", "r2")
