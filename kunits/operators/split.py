"""Markdown: profiles, chunks with breadcrumbs and offsets, checks, packing, samples."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADING = re.compile(r"^(#{1,6})\s+(\S.*?)\s*#*\s*$")
FENCE = re.compile(r"^\s*(```+|~~~+)")
TABLE = re.compile(r"^\s*\|.*\|\s*$")
CHUNKS = "chunk_no int, stable_id string, markdown string, headings array<string>, breadcrumb string, start int, `end` int, overlap int, token_estimate int"


def profile_markdown(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Headings by level, dominant level, flags for tables, code and math, and a splitting strategy."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.regexp_replace(text, r"(?ms)^\s*(```|~~~).*?^\s*\1\s*$", "")
    count = lambda level: F.regexp_count(bare, F.lit(rf"(?m)^#{{{level}}}\s+\S"))
    counts = F.array(*(count(n) for n in range(1, 7)))
    rows = docs.select(id_col, text.alias("t"), counts.alias("heading_counts"))
    most = F.array_max("heading_counts")
    total = F.aggregate("heading_counts", F.lit(0).cast("int"), lambda a, b: a + b)
    strategy = F.when(total >= 2, "heading").when(F.col("t").rlike(r"(?m)^\s*(第[一二三四五六七八九十\d]+[章节条]|\d+(\.\d+)*[.、]?\s+\S)"), "heuristic").otherwise("legacy")
    return rows.select(
        id_col, "heading_counts", F.when(most > 0, F.array_position("heading_counts", most)).otherwise(0).cast("int").alias("dominant_level"),
        F.col("t").rlike(r"(?m)^\s*\|.*\|\s*$").alias("has_tables"), F.col("t").rlike(r"(?m)^\s*(```|~~~)").alias("has_code"), F.col("t").contains("$$").alias("has_math"), strategy.alias("strategy"),
    )


def _pieces(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, heading level or 0, heading) of lines; fences, tables and ``$$`` blocks are one piece."""
    at, hold, fence = 0, None, ""
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        bare = line.rstrip("\r\n")
        kind = hold[1] if hold else ""
        if kind == "fence":
            if (m := FENCE.match(bare)) and m[1][:3] == fence:
                yield hold[0], end, 0, ""
                hold = None
        elif kind == "math":
            if "$$" in bare:
                yield hold[0], end, 0, ""
                hold = None
        elif kind == "table" and TABLE.match(bare):
            pass
        else:
            if kind == "table":
                yield hold[0], at, 0, ""
                hold = None
            if m := FENCE.match(bare):
                hold, fence = (at, "fence"), m[1][:3]
            elif bare.count("$$") == 1:
                hold = (at, "math")
            elif TABLE.match(bare):
                hold = (at, "table")
            elif m := HEADING.match(bare):
                yield at, end, len(m[1]), m[2]
            else:
                yield at, end, 0, ""
        at = end
    if hold:
        yield hold[0], at, 0, ""


def split_text(text: str, max_chars: int = 12_000, coalesce: bool = True, overlap: float = 0.0) -> list[dict]:
    """Chunks of one document in order; at least one. Sizes and offsets count characters.

    Sections start at headings; pieces are packed up to *max_chars*; only a
    plain piece larger than that is cut, at white space where there is some.
    Sections under half the size join their neighbour. *overlap* (0 to 0.5)
    repeats that share of the size from the chunk before.
    """
    overlap = min(max(overlap, 0.0), 0.5)
    sections: list[dict] = []
    path: list[str] = []
    for start, end, level, heading in _pieces(text):
        if level:
            path = path[: level - 1] + [""] * max(0, level - 1 - len(path)) + [heading]
        if level or not sections:
            sections.append({"start": start, "end": end, "path": [p for p in path if p], "cuts": [start, end]})
        else:
            sections[-1]["end"] = end
            sections[-1]["cuts"].append(end)
    if not sections:
        sections = [{"start": 0, "end": len(text), "path": [], "cuts": [0, len(text)]}]
    parts: list[dict] = []
    for s in sections:
        low = s["start"]
        for a, b in zip(s["cuts"], s["cuts"][1:], strict=False):
            if b - low > max_chars and a > low:
                parts.append({**s, "start": low, "end": a})
                low = a
            while b - low > max_chars and not FENCE.match(text[low:b]) and not TABLE.match(text[low:b].split("\n", 1)[0]) and not text[low:b].lstrip().startswith("$$"):
                cut = max(text.rfind(" ", low, low + max_chars), text.rfind("\n", low, low + max_chars))
                cut = cut + 1 if cut > low + max_chars // 2 else low + max_chars
                parts.append({**s, "start": low, "end": cut})
                low = cut
        if s["end"] > low or not parts:
            parts.append({**s, "start": low, "end": s["end"]})
    joined: list[dict] = []
    for p in parts:
        last = joined[-1] if joined else None
        if coalesce and last and p["end"] - last["start"] <= max_chars and (last["end"] - last["start"] < max_chars / 2 or p["end"] - p["start"] < max_chars / 2):
            last["end"] = p["end"]
            last["path"] = common_breadcrumb([last["path"], p["path"]])
            last["headings"] += [h for h in p["path"] if h not in last["headings"]]
        else:
            joined.append({"start": p["start"], "end": p["end"], "path": p["path"], "headings": list(p["path"])})
    for i, c in enumerate(joined):
        c["overlap"] = min(int(max_chars * overlap), joined[i - 1]["end"] - joined[i - 1]["start"]) if i else 0
    return joined


def common_breadcrumb(paths: list[list[str]]) -> list[str]:
    """The headings that all paths start with."""
    out = []
    for parts in zip(*paths, strict=False):
        if len(set(parts)) > 1:
            break
        out.append(parts[0])
    return out


def split_markdown(docs: DataFrame, id_col: str, text_col: str, max_chars: int = 12_000, coalesce: bool = True, overlap: float = 0.0) -> DataFrame:
    """Chunks of every document: see :func:`split_text`; ids depend on place and content."""
    import hashlib

    key = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "chunk_no", "stable_id", "markdown", "headings", "breadcrumb", "start", "end", "overlap", "token_estimate"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(pdf[id_col], pdf["text"], strict=True):
                text = text or ""
                for i, c in enumerate(split_text(text, max_chars, coalesce, overlap)):
                    body = text[c["start"] - c["overlap"] : c["end"]]
                    made = hashlib.sha256(f"{c['start']}:{c['end']}:{text[c['start'] : c['end']]}".encode()).hexdigest()[:20]
                    rows.append((doc, i, f"chunk-{made}", body, c["headings"], " > ".join(c["path"]), c["start"], c["end"], c["overlap"], -(-len(body) // 3)))
                held += len(text)
                if held > 4_000_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return docs.select(id_col, F.col(text_col).alias("text")).mapInPandas(run, f"{id_col} {key}, {CHUNKS}")


def validate_chunks(chunks: DataFrame, id_col: str) -> DataFrame:
    """id, valid: starts ascend and no chunk starts after the end of the one before."""
    w = W.partitionBy(id_col).orderBy("chunk_no")
    before, ended = F.lag("start").over(w), F.lag("end").over(w)
    ok = (before.isNull() & (F.col("start") == 0)) | ((F.col("start") > before) & (F.col("start") <= ended))
    return chunks.select(id_col, F.coalesce(ok, F.lit(False)).alias("ok")).groupBy(id_col).agg(F.every("ok").alias("valid"))


def breadcrumbs(lines: DataFrame, id_col: str, order: str = "ord", text_col: str = "text") -> DataFrame:
    """Adds breadcrumb: the headings in force at each line."""
    w = W.partitionBy(id_col).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    level = F.length(F.regexp_extract(text_col, r"^(#{1,6})\s+\S", 1))
    rows = lines.withColumn("_level", level)
    last = [F.last(F.when(F.col("_level") == k, F.struct(F.col(order).alias("o"), F.regexp_extract(text_col, r"^#{1,6}\s+(.*\S)", 1).alias("h"))), ignorenulls=True).over(w) for k in range(1, 7)]
    rows = rows.withColumn("_path", F.array(*last))
    valid = F.filter("_path", lambda x, i: x.isNotNull() & ~F.exists(F.slice("_path", F.lit(1), F.greatest(i, F.lit(0))), lambda y: y.isNotNull() & (y["o"] > x["o"])))
    return rows.withColumn("breadcrumb", F.array_join(F.transform(valid, lambda x: x["h"]), " > ")).drop("_level", "_path")


def pack_blocks(blocks: DataFrame, id_col: str, order: str = "ord", text_col: str = "text", hard: int = 4000, soft: int = 3000, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds pack (from 0), piece, tokens: blocks packed to a soft budget, those over the hard one cut."""
    count = tokens or (lambda c: F.ceil(F.char_length(c) / 3))
    size = F.greatest(count(F.col(text_col)).cast("int"), F.lit(1))
    pieces = F.ceil(size / hard).cast("int")
    width = F.ceil(F.char_length(text_col) / pieces).cast("int")
    rows = blocks.withColumns({"_pieces": pieces, "_width": width}).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    rows = rows.withColumn(text_col, F.when(F.col("_pieces") > 1, F.substring(F.col(text_col), F.col("piece") * F.col("_width") + 1, F.col("_width"))).otherwise(F.col(text_col)))
    rows = rows.withColumn("tokens", F.greatest(count(F.col(text_col)).cast("int"), F.lit(1))).drop("_pieces", "_width")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "piece"], ignore_index=True)
        out, pack, held = [], 0, 0
        for n in pdf["tokens"]:
            if held and held + n > soft:
                pack, held = pack + 1, 0
            held += n
            out.append(pack)
        return pdf[[id_col, order, "piece"]].assign(pack=out)

    key, at = (rows.schema[c].dataType.simpleString() for c in (id_col, order))
    packs = rows.select(id_col, order, "piece", "tokens").groupBy(id_col).applyInPandas(fold, f"{id_col} {key}, {order} {at}, piece int, pack int")
    return rows.join(packs, [id_col, order, "piece"])


def packing_metrics(packed: DataFrame, id_col: str) -> DataFrame:
    """split_blocks, packs, max_tokens, locator_coverage of each document."""
    per = packed.groupBy(id_col, "pack").agg(F.sum("tokens").alias("t"))
    return packed.groupBy(id_col).agg(
        F.count_distinct(F.when(F.col("piece") > 0, F.col("ord"))).alias("split_blocks"), F.avg(F.col("locator").isNotNull().cast("int")).alias("locator_coverage")
    ).join(per.groupBy(id_col).agg(F.count("*").alias("packs"), F.max("t").alias("max_tokens")), id_col)


def classification_sample(blocks: DataFrame, id_col: str, budget: int = 4000) -> DataFrame:
    """id, sample: headings first, then table headers, then body, in order, up to *budget* characters."""
    first = F.when(F.col("kind") == "heading", 0).when(F.col("kind").isin("table", "table_row", "table_cell"), 1).otherwise(2)
    rows = blocks.withColumn("rank", first)
    w = W.partitionBy(id_col).orderBy("rank", "ord")
    rows = rows.withColumn("before", F.coalesce(F.sum(F.char_length("text") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < budget)
    part = F.struct("rank", "ord", F.substring(F.col("text"), F.lit(1), (budget - F.col("before")).cast("int")).alias("t"))
    return rows.groupBy(id_col).agg(F.array_sort(F.collect_list(part)).alias("parts")).select(id_col, F.array_join(F.transform("parts", lambda p: p["t"]), "\n").alias("sample"))
