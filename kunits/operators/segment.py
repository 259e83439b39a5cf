"""Regions: runs of blocks of one kind, their tree, and adjacent merges."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kunits.functions import lang
from kunits.operators.blocks import flag, lifecycles, noise_reason, with_occurrence

MOST_BLOCKS, MOST_CHARS, DEPTH = 8, 10_000, 12


def runs(rows: DataFrame, partition: list[str], order: list[str], boundary: Column, name: str = "run") -> DataFrame:
    """Number runs: one starts at the first row and wherever *boundary* holds."""
    w = W.partitionBy(*partition).orderBy(*order)
    starts = F.coalesce(boundary, F.lit(True)).cast("int")
    return rows.withColumn(name, F.sum(starts).over(w.rowsBetween(W.unboundedPreceding, 0)))


def capped(rows: DataFrame, partition: list[str], order: list[str], most: int, name: str = "run") -> DataFrame:
    """Cut runs of more than *most* rows: adds ``part`` (from 0) to be grouped by too."""
    nth = F.row_number().over(W.partitionBy(*partition, name).orderBy(*order))
    return rows.withColumn("part", F.floor((nth - 1) / most).cast("int"))


def described(blocks: DataFrame, id_col: str = "source_document_id", dealt: bool = False) -> DataFrame:
    """Blocks with noise reason, semantic kind, heading and subject, dealt by document once for all that follows, unless they are *dealt* so."""
    rows = with_occurrence(blocks if dealt else blocks.repartition(id_col), id_col)
    rows = rows.withColumn("dropped_reason", noise_reason(F.col("text"), F.col("kind"), F.col("occurrence"), flag(F.col("metadata"), "noise", "structural_noise")))
    last = F.coalesce(F.try_element_at("hierarchy", F.lit(-1)), F.lit(""))
    heading = F.when((F.col("kind") == "heading") | (F.size("hierarchy") > 0), F.substring(F.when(F.col("text") != "", F.col("text")).otherwise(last), 1, 300)).otherwise("")
    subject = F.coalesce(F.nullif(F.col("heading_text"), F.lit("")), F.nullif(last, F.lit("")), F.regexp_extract(F.substring("text", 1, 160), r"^([^。；;\n]*)", 1))
    rows = rows.withColumns({"semantic_kind": F.when(F.col("dropped_reason") != "", "noise").otherwise(lang.dominant_kind(F.col("text"))), "heading_text": heading})
    return rows.withColumns({
        "subject": subject, "level": F.size("hierarchy"),
        "scope_id": F.coalesce(F.col("metadata")["scope_id"], F.lit("")), "temporal_scope": F.coalesce(F.col("metadata")["temporal_scope"], F.lit("")),
    })


def segments(blocks: DataFrame, id_col: str = "source_document_id", scoped: bool = True, dealt: bool = False) -> DataFrame:
    """Described blocks with ``segment`` numbers (from 1 in each document).

    A segment starts at noise, after noise, at a heading, where the kind
    changes, where a scope or time differs from the segment's first block,
    and after eight blocks. Scopes need a fold over the document; without
    them (*scoped* off) window functions give the same.
    """
    rows = described(blocks, id_col, dealt)
    if not scoped:
        w = W.partitionBy(id_col).orderBy("ord")
        before = F.lag("semantic_kind").over(w)
        hard = (F.col("semantic_kind") == "noise") | (before == "noise") | (F.col("heading_text") != "") | (before != F.col("semantic_kind"))
        rows = capped(runs(rows, [id_col], ["ord"], hard), [id_col], ["ord"], MOST_BLOCKS)
        return rows.withColumn("segment", F.dense_rank().over(W.partitionBy(id_col).orderBy("run", "part"))).drop("run", "part")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", ignore_index=True)
        out, number, size, first = [], 0, 0, None
        for r in pdf.itertuples(index=False):
            new = first is None or "noise" in (r.semantic_kind, first.semantic_kind) or bool(r.heading_text) or r.semantic_kind != first.semantic_kind or size >= MOST_BLOCKS
            new = new or bool(r.scope_id and r.scope_id != first.scope_id) or bool(r.temporal_scope and r.temporal_scope != first.temporal_scope)
            if new:
                number, size, first = number + 1, 0, r
            size += 1
            out.append(number)
        return pdf[[id_col, "ord"]].assign(segment=out)

    key = rows.schema[id_col].dataType.simpleString()
    numbered = rows.select(id_col, "ord", "semantic_kind", "heading_text", "scope_id", "temporal_scope").groupBy(id_col).applyInPandas(fold, f"{id_col} {key}, ord {rows.schema['ord'].dataType.simpleString()}, segment int")
    return rows.join(numbered, [id_col, "ord"])


def regions(segmented: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """One row a segment, with id, text, language, fingerprint and its parent region."""
    s = lambda c: F.transform("blocks", lambda b: b[c])
    carried = ["ord", "block_id", "text", "subject", "level", "semantic_kind", "scope_id", "temporal_scope", "dropped_reason", "locator", "metadata"]
    rows = segmented.groupBy(id_col, "segment").agg(F.array_sort(F.collect_list(F.struct(*carried))).alias("blocks")) if "metadata" not in segmented.columns else _collected(segmented, id_col, [c for c in carried if c != "metadata"])
    rows = rows.withColumns({"first": F.col("blocks")[0], "text": F.array_join(F.filter(s("text"), lambda t: t != ""), "\n"), "block_ids": s("block_id")})
    rows = rows.select(
        id_col, "segment", F.col("first.semantic_kind").alias("semantic_kind"), F.col("first.subject").alias("subject"), F.col("first.level").alias("level"),
        F.col("first.scope_id").alias("scope_id"), F.col("first.temporal_scope").alias("temporal_scope"), F.col("first.dropped_reason").alias("dropped_reason"), "text", "block_ids", "blocks", "project_ids",
    )
    ids = F.concat(F.lit("["), F.to_json(F.array(F.col(id_col).cast("string"))), F.lit(","), F.to_json("block_ids"), F.lit(","), F.to_json(F.array("semantic_kind")), F.lit("]"))
    rows = rows.withColumns({
        "region_id": F.concat(F.lit("reg-"), F.substring(F.sha2(ids, 256), 1, 24)),
        "fingerprint": F.sha2(F.to_json(F.array("semantic_kind", "subject", "text")), 256),
        "source_language": lang.detect_language(F.col("text")),
    })
    return parents(rows, id_col)


def _collected(segmented: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    ids = F.array(F.col("metadata")["project_id"], F.col("metadata")["project_name"])
    return segmented.withColumn("own_ids", F.array_compact(ids)).groupBy(id_col, "segment").agg(
        F.array_sort(F.collect_list(F.struct(*carried))).alias("blocks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("own_ids")))).alias("project_ids")
    )


def said(regions: DataFrame) -> Column:
    """What a region says: its translation if it has one."""
    return F.coalesce(F.nullif(F.col("translated_text"), F.lit("")), F.col("text")) if "translated_text" in regions.columns else F.col("text")


def shown(blocks: Column) -> Column:
    """Where each of the blocks stands that have a text."""
    return F.transform(F.filter(blocks, lambda b: b["text"] != ""), lambda b: F.concat_ws("|", b["block_id"], b["locator"]["scheme"], b["locator"]["value"]))


def outline(regions: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """Regions without their texts: what units are told apart and counted by, with the lifecycle of their document."""
    rows = regions.select(
        id_col, "segment", "semantic_kind", "subject", "dropped_reason", "project_ids", "region_id", "fingerprint",
        F.char_length(said(regions)).alias("chars"), shown(F.col("blocks")).alias("shown"), F.size("blocks").alias("parse_blocks"), F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("lines"),
    )
    return lifecycles(rows, "lines", "segment", id_col)


def parents(rows: DataFrame, id_col: str, order: str = "segment", level: str = "level", key: str = "region_id", depth: int = DEPTH) -> DataFrame:
    """parent_<key>: the nearest earlier row of a lower level, null without one."""
    before = W.partitionBy(id_col).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = [F.max(F.when(F.least(F.col(level), F.lit(depth)) == k, F.struct(order, key))).over(before) for k in range(depth)]
    lower = F.array_max(F.array(*(F.when(F.col(level) > k, last[k]) for k in range(depth))))
    return rows.withColumn(f"parent_{key}", lower[key])


def merge_adjacent(rows: DataFrame, keys: list[str], id_col: str, order: str, text_col: str | None, most: int = MOST_CHARS, chars: Column | None = None) -> DataFrame:
    """Number groups of adjacent rows with equal *keys* whose text stays under *most* characters.

    Rows without the text give its length in *chars*.

    Adds ``merged`` (from 1 in each document). The length that a row is
    compared with is that of the group so far, line breaks included. Windows
    number the runs of equal keys; only the runs that don't fit in one group
    are folded, each for the places where its further groups start.
    """
    in_order, run = W.partitionBy(id_col).orderBy(order), W.partitionBy(id_col, "_run")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lag(k).over(in_order)) for k in keys))
    size = F.char_length(F.coalesce(F.col(text_col), F.lit(""))) if chars is None else F.coalesce(chars, F.lit(0))
    sized = rows.withColumn("_size", size.cast("long")).withColumn("_run", F.sum((~same).cast("int")).over(in_order))
    several = F.count("*").over(run)
    sized = sized.withColumn("_long", (several > 1) & (F.sum("_size").over(run) + several - 2 >= most))

    none = F.slice(F.array(F.col(order)), 1, 0)
    begun = F.struct(F.lit(None).cast("long").alias("held"), none.alias("starts"))

    def step(so_far: Column, x: Column) -> Column:
        fits = so_far["held"] + x["_size"] < most
        return F.when(so_far["held"].isNull(), F.struct(x["_size"].alias("held"), so_far["starts"].alias("starts"))).otherwise(F.struct(
            F.when(fits, so_far["held"] + x["_size"] + 1).otherwise(x["_size"]).alias("held"), F.when(fits, so_far["starts"]).otherwise(F.concat(so_far["starts"], F.array(x[order]))).alias("starts"),
        ))

    long_runs = sized.where("_long").groupBy(id_col, "_run").agg(F.array_sort(F.collect_list(F.struct(order, "_size"))).alias("_rows"), F.min(order).alias(order))
    cut = long_runs.select(id_col, F.struct("_run", F.aggregate("_rows", begun, step)["starts"].alias("starts")).alias("_cut")).groupBy(id_col).agg(F.collect_list("_cut").alias("_cuts"))
    found = sized.join(cut, id_col, "left")
    starts = F.get(F.filter("_cuts", lambda c: c["_run"] == F.col("_run")), 0)["starts"]
    part = F.when(F.col("_long"), F.size(F.filter(starts, lambda s: s <= F.col(order)))).otherwise(0)
    numbered = found.withColumn("_part", part).withColumn("merged", F.dense_rank().over(W.partitionBy(id_col).orderBy("_run", "_part")))
    return numbered.drop("_size", "_run", "_long", "_cuts", "_part")
