"""The corpus pipeline: documents are judged, deduplicated, decontaminated and encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kunits.llm import decontamination, order_minhash, rule_ensemble, sentencepiece_codec, substring_dedup
from kunits.llm.common import fresh, table, written
from kunits.llm.queries import PIECES

#: The stages end in token ids of a vocabulary and in models fitted on labels: no SQL expresses them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least id."""
    return order_minhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start earlier are cut out of the texts; n_chars follows."""
    before, after = fresh(docs, "words_before"), fresh(docs, "words_removed")
    cut = substring_dedup.remove_repeats(docs, n_words=before, n_removed=after)
    chars = F.when(F.col(after) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    cut = cut if chars is None else cut.withColumn("n_chars", chars)
    return cut.select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with digests of what they decode to."""
    return sentencepiece_codec.encode_documents(docs, Path(PIECES).read_bytes())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontaminated),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of *sf_dir*, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
