"""Provenance: quotes to blocks, chunks to pages, claims against evidence, OCR rows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kunits.functions import lang
from kunits.functions.text import ascii_edges
from kunits.operators.quotes import reconcile  # noqa: F401  quotes to blocks, beside the other steps of provenance

#: Words of modality, by strength (fixed values).
MUST, MUST_NOT, SHOULD, MAY = r"必须|应当|须|shall|must|required", r"不得|禁止|shall not|must not|prohibited", r"宜|应该|should", r"可以|允许|may\b"
CONDITION = r"如果|若|当.{1,20}时|除非|除外|if\b|unless|except|when\b"


def overlap_join(chunks: DataFrame, spans: DataFrame, doc: str, start: str = "start", end: str = "end", bin_size: int = 4096) -> DataFrame:
    """Chunks with first and last page: intervals that overlap, joined by document and bin.

    Bins turn the range join into an equi join; an interval is in every bin
    that it touches, and pairs count once.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / bin_size)))
    c = chunks.select(doc, "chunk_no", F.col(start).alias("cs"), F.col(end).alias("ce")).withColumn("bin", bins("cs", "ce"))
    s = spans.select(doc, "page", F.col(start).alias("ss"), F.col(end).alias("se")).withColumn("bin", bins("ss", "se"))
    hit = c.join(s, [doc, "bin"]).where((F.col("cs") < F.col("se")) & (F.col("ss") < F.col("ce")))
    return hit.groupBy(doc, "chunk_no").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))


def band_join(rows: DataFrame, bands: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Rows with each band that their value lies in, ends included; *bands* is a small fixed table."""
    return rows.join(F.broadcast(bands), F.col(value).between(F.col(low), F.col(high)))


def _normal_with_offsets(text: str) -> tuple[str, list[int]]:
    out, places = [], []
    for i, c in enumerate(text):
        for n in unicodedata.normalize("NFKC", c):
            if not n.isspace():
                out.append(n)
                places.append(i)
    return "".join(out), places


def original_spelling(rows: DataFrame, text_col: str = "text", quote_col: str = "quote") -> DataFrame:
    """Adds found, start: the text's own spelling of the quote and its place (-1 where there is none)."""

    @F.pandas_udf("found string, start int")
    def locate(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
        out = []
        for t, q in zip(text, quote, strict=True):
            at = t.find(q) if t and q else -1
            if at >= 0:
                out.append((q, at))
                continue
            normal, places = _normal_with_offsets(t or "")
            wanted = _normal_with_offsets(q or "")[0]
            at = normal.find(wanted) if wanted else -1
            out.append((t[places[at] : places[at + len(wanted) - 1] + 1], places[at]) if at >= 0 else (None, -1))
        return pd.DataFrame(out, columns=["found", "start"])

    return rows.withColumn("_l", locate(text_col, quote_col)).select(*rows.columns, "_l.found", "_l.start")


def occurrences(rows: DataFrame, keys: list[str], text_col: str, quote_col: str) -> DataFrame:
    """keys, nth (from 1), start (from 0): every place of a quote in its text, without overlap."""
    parts = F.posexplode(F.slice(F.split(F.col(text_col), F.concat(F.lit(r"\Q"), F.col(quote_col), F.lit(r"\E")), -1), F.lit(1), F.greatest(F.size(F.split(F.col(text_col), F.concat(F.lit(r"\Q"), F.col(quote_col), F.lit(r"\E")), -1)) - 1, F.lit(0))))
    cut = rows.where(F.coalesce(quote_col, F.lit("")) != "").select(*keys, F.char_length(quote_col).alias("_n"), parts.alias("at", "part"))
    w = W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return cut.select(*keys, (F.col("at") + 1).alias("nth"), (F.sum(F.char_length("part")).over(w) + F.col("at") * F.col("_n")).cast("int").alias("start"))


def modality(text: Column) -> Column:
    """must_not, must, should, may or none: the strongest that the text has."""
    has = lambda p: text.rlike("(?i)" + ascii_edges(p))
    return F.when(has(MUST_NOT), "must_not").when(has(MUST), "must").when(has(SHOULD), "should").when(has(MAY), "may").otherwise("none")


def evidence_consistency(claim: Column, evidence: Column) -> Column:
    """struct(status, missing, added): numbers, dates, modality and conditions of a claim against its evidence.

    matched; unsupported_addition (the claim has figures that the evidence
    lacks); missing_in_evidence (the evidence has none at all); conflict (both
    have others); strengthened, weakened or changed_obligation;
    invented_condition or removed_condition_or_exception.
    """
    figures = lambda t: F.array_distinct(F.concat(F.transform(lang.extract_numbers(t, True), lambda n: F.lower(F.regexp_replace(n, r"\s+", ""))), lang.extract_dates(t)))
    c, e = figures(claim), figures(evidence)
    added, missing = F.array_except(c, e), F.array_except(e, c)
    rank = lambda m: F.when(m == "must_not", 3).when(m == "must", 3).when(m == "should", 2).when(m == "may", 1).otherwise(0)
    mc, me = modality(claim), modality(evidence)
    cond = lambda t: t.rlike("(?i)" + ascii_edges(CONDITION))
    status = (
        F.when((F.size(added) > 0) & (F.size(e) == 0), "missing_in_evidence").when((F.size(added) > 0) & (F.size(missing) > 0), "conflict").when(F.size(added) > 0, "unsupported_addition")
        .when((mc == "must_not") != (me == "must_not"), F.when((mc == "none"), "removed_condition_or_exception").otherwise("changed_obligation"))
        .when(rank(mc) > rank(me), "strengthened_obligation").when(rank(mc) < rank(me), "weakened_obligation")
        .when(cond(claim) & ~cond(evidence), "invented_condition").when(~cond(claim) & cond(evidence), "removed_condition_or_exception").otherwise("matched")
    )
    return F.struct(status.alias("status"), missing.alias("missing"), added.alias("added"))


def expand_evidence(atoms: DataFrame, blocks: DataFrame, doc: str = "source_document_id") -> DataFrame:
    """Atoms with the whole text of the block that holds their quote; others keep the quote."""
    b = blocks.select(doc, "block_id", F.col("text").alias("whole"))
    rows = atoms.join(b, [doc, "block_id"], "left")
    held = F.coalesce(F.contains("whole", F.col("quote")), F.lit(False))
    return rows.withColumn("evidence", F.when(held, F.col("whole")).otherwise(F.col("quote"))).withColumn("verified", held).drop("whole")


def ocr_spans(rows: DataFrame) -> DataFrame:
    """page, text, bbox from either vendor shape: (page_idx from 0, text, bbox) or (page, rec_texts, rec_boxes)."""
    many = F.arrays_zip(F.col("rec_texts").alias("text"), F.col("rec_boxes").alias("bbox"))
    one = F.array(F.struct(F.col("text").alias("text"), F.col("bbox").alias("bbox")))
    return rows.select(F.coalesce(F.col("page_idx") + 1, F.col("page")).alias("page"), F.inline(F.when(F.col("rec_texts").isNotNull(), many).otherwise(one))).where(F.coalesce("text", F.lit("")) != "")


def upgrade_packages(packages: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    """Packages without blocks get one ``parsed-text-span`` block; no page is invented; others stay as they are."""
    made = F.array(F.struct(F.concat(F.lit("blk-"), F.substring(F.sha2(F.col("markdown"), 256), 1, 20)).alias("block_id"), F.lit("parsed-text-span").alias("kind"), F.col("markdown").alias("text"), F.lit(None).cast("int").alias("page")))
    return packages.withColumn("blocks", F.when(F.size(F.coalesce("blocks", F.array().cast(packages.schema["blocks"].dataType))) == 0, made).otherwise(F.col("blocks")))


def evidence_index(packages: DataFrame, id_col: str = "source_document_id") -> DataFrame:
    return packages.select(id_col, F.inline("blocks"))


def point_atoms(atoms: DataFrame, points: DataFrame, evidence: DataFrame, doc: str = "source_document_id") -> tuple[DataFrame, DataFrame]:
    """(atom_id, point_id, evidence_id links, counts of what was dropped): many to many, explicit attribution only."""
    asked = atoms.select(doc, "atom_id", F.explode_outer("point_ids").alias("point_id"))
    known = points.select(doc, "point_id", "evidence_ids")
    # A missing id meets nothing: it is dealt by its atom, as all of a document's missing ids would go to one task.
    spread = lambda key: F.when(F.col(key).isNull(), F.xxhash64("atom_id")).otherwise(0).alias("_deal")
    met = F.lit(0).cast("long").alias("_deal")
    rows = asked.select("*", spread("point_id")).join(known.select("*", met), [doc, "point_id", "_deal"], "left").drop("_deal")
    rows = rows.withColumn("evidence_id", F.explode_outer("evidence_ids")).select("*", spread("evidence_id"))
    rows = rows.join(evidence.select(doc, "evidence_id", F.lit(True).alias("held"), met), [doc, "evidence_id", "_deal"], "left").drop("_deal")
    reason = F.when(F.col("point_id").isNull(), "no_attribution").when(F.col("evidence_ids").isNull(), "unknown_point").when(F.col("held").isNull(), "missing_evidence")
    rows = rows.withColumn("dropped", reason)
    return rows.where("dropped is null").select(doc, "atom_id", "point_id", "evidence_id"), rows.where("dropped is not null").groupBy(doc, "dropped").agg(F.count("*").alias("n"))


def sse_tokens(lines: Iterator[str]) -> Iterator[str]:
    """Payloads of a token stream's ``data:`` lines, up to ``[DONE]``."""
    for line in lines:
        if m := re.match(r"data:\s?(.*)", line):
            if m[1].strip() == "[DONE]":
                return
            yield m[1]
