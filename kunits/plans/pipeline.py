"""The universal pipeline: documents to blocks, profiles, regions, units, relations, reviews, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kunits.operators import blocks as B
from kunits.operators import segment as S
from kunits.operators import units as U
from kunits.schema import RAW_BLOCKS
from kunits.session import Scratch


def raw_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dealt: bool = False) -> DataFrame:
    """Raw blocks of plain texts, one a line; *dealt* ones have clean texts and lie by document."""
    lines = B.line_blocks(docs.select(F.col(id_col).cast("string").alias("source_document_id"), F.col(text_col).alias("text")), "source_document_id")
    lines = B.cleaned(lines).repartition("source_document_id") if dealt else lines
    empty, none = F.array().cast("array<string>"), F.lit(None)
    locator = F.struct(F.lit("line").alias("scheme"), (F.col("ord") + 1).cast("string").alias("value"), none.cast("int").alias("page"), none.cast("string").alias("sheet"), none.cast("string").alias("range"), none.cast("int").alias("row"), none.cast("string").alias("column"), none.cast("string").alias("message_id"), none.cast("string").alias("attachment_id"), empty.alias("heading_path"))
    full = {
        "block_id": none.cast("string"), "kind": F.lit("paragraph"), "fields": F.create_map().cast("map<string,string>"), "hierarchy": empty, "heading_path": empty, "heading": none.cast("string"), "locator": locator,
        "provenance": F.array(locator), "parse_status": F.lit("present"), "card_eligible": F.lit(True), "exclusion_reason": none.cast("string"), "metadata": F.create_map().cast("map<string,string>"),
    }
    names = [f.name for f in lines.sparkSession.createDataFrame([], RAW_BLOCKS).schema]
    return lines.withColumns(full).select(*names)


def run(raw: DataFrame, documents: DataFrame | None = None, scoped: bool = True, explicit_library: str | None = None, scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """All stages from raw blocks; *documents* may give metadata by source_document_id.

    Units of an identity that has too many for pairs in "relations" are in
    "crowded". With *scratch* blocks, regions and units are written once and
    what depends on them reads them; without, each result is a plan of its own.
    """
    kept = scratch.stored if scratch else lambda df, name: df
    blocks = kept(B.canonical_blocks(raw), "blocks")
    profiles = B.profiles(blocks, documents)
    regions = kept(S.regions(S.segments(blocks, scoped=scoped)), "regions")
    units = kept(U.units(regions, profiles, explicit_library=explicit_library), "units")
    ledger = U.coverage(regions, units)
    reviews = U.review_groups(units)
    return {
        "blocks": blocks, "profiles": profiles, "regions": regions, "units": units, "coverage": ledger, "gaps": U.coverage_gaps(regions, ledger),
        "relations": U.relations(units), "crowded": U.crowded_members(units), "reviews": reviews, "telemetry": U.telemetry(blocks, regions, units, ledger, reviews),
    }


def counts(raw: DataFrame, scoped: bool = True, explicit_library: str | None = None, scratch: Scratch | None = None, dealt: bool = False) -> DataFrame:
    """The telemetry of :func:`run` without metadata of documents, from outlines of regions and units: no text is written.

    Blocks that are *dealt* by document (:func:`raw_lines`) become regions
    where they are; only outlines move after that.
    """
    kept = scratch.stored if scratch else lambda df, name: df
    blocks = B.canonical_blocks(raw, clean_texts=dealt)
    regions = kept(S.outline(S.regions(S.segments(blocks, scoped=scoped, dealt=dealt))), "regions")
    units = kept(U.outlined(regions, explicit_library=explicit_library), "units")
    return U.telemetry(None, regions, units, U.coverage(regions, units), U.review_groups(units))
