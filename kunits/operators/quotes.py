"""Quotes in texts: one pass over each text with an automaton of many quotes.

Quotes of a document are dealt into chunks, its blocks into parts, both of
bounded size; every part is read once with the automaton of each chunk. So
neither many quotes nor many blocks of one document land in one task, and a
quote isn't compared with every block in turn.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of quotes in a chunk and of blocks in a part, about; each row counts as some more.
CHUNK, PART, ROW = 2_000_000, 4_000_000, 200
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def compact(text: str | None) -> str:
    """NFKC without white space: how quotes are compared beyond exact equality."""
    return _SPACE.sub("", unicodedata.normalize("NFKC", text or ""))


class Quotes:
    """An automaton over quotes; several quotes may have one form."""

    def __init__(self, forms: list[str]):
        import ahocorasick

        self.of: dict[str, list[int]] = {}
        for i, form in enumerate(forms):
            if form:
                self.of.setdefault(form, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for form in self.of:
            self.automaton.add_word(form, form)
        if self.of:
            self.automaton.make_automaton()

    def within(self, text: str) -> list[int]:
        """Places of the quotes that the text holds, each once."""
        if not self.of or not text:
            return []
        return [i for form in {form for _, form in self.automaton.iter(text)} for i in self.of[form]]


def _dealt(rows: DataFrame, key: str, text: str, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of a bounded share of their document's rows; and how many shares each document has."""
    cost = F.char_length(F.coalesce(text, F.lit(""))) + ROW
    shares = rows.groupBy("_doc").agg(F.ceil(F.sum(cost) / most).cast("int").alias(f"{name}s"))
    dealt = rows.join(shares, "_doc").withColumn(name, F.pmod(F.xxhash64(key, text), F.col(f"{name}s")).cast("int"))
    return dealt.drop(f"{name}s"), shares.select(F.col("_doc").alias("_doc"), F.col(f"{name}s").alias(f"{name}s"))


def quote_hits(quotes: DataFrame, blocks: DataFrame, doc: str = "source_document_id") -> DataFrame:
    """quote_id, block_id, exact: which blocks of its document hold a quote, up to NFKC and white space.

    *quotes*: doc, quote_id, quote; *blocks*: doc, block_id, text. ``exact``:
    the block holds the quote letter by letter. Quotes without any letter
    but white space are nowhere; null texts hold nothing. A pair comes once,
    but where ids repeat.
    """
    # New names, since both sides may come from one table.
    named = lambda df, *columns: df.select(F.col(doc).alias("_doc"), *(F.col(c).alias(c) for c in columns))
    (q, chunks), (b, parts) = _dealt(named(quotes, "quote_id", "quote"), "quote_id", "quote", CHUNK, "_chunk"), _dealt(named(blocks, "block_id", "text"), "block_id", "text", PART, "_part")
    every = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    q, b = every(q.join(parts, "_doc"), "_parts", "_part"), every(b.join(chunks, "_doc"), "_chunks", "_chunk")
    schema = T.StructType([T.StructField("quote_id", quotes.schema["quote_id"].dataType), T.StructField("block_id", blocks.schema["block_id"].dataType), T.StructField("exact", T.BooleanType())])

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        quoted = left.column("quote").to_pylist()
        known = Quotes([compact(t) for t in quoted])
        at, where, exact = [], [], []
        for i, text in enumerate(right.column("text").to_pylist()):
            for j in known.within(compact(text)):
                at.append(j)
                where.append(i)
                exact.append(quoted[j] in text)
        columns = [left.column("quote_id").take(pa.array(at, pa.int64())), right.column("block_id").take(pa.array(where, pa.int64())), pa.array(exact, pa.bool_())]
        return pa.table(columns, names=schema.names)

    by = ["_doc", "_chunk", "_part"]
    q, b = q.select(*by, "quote_id", "quote"), b.select(*by, "block_id", "text")
    return q.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(lambda left, right: read(left, right), schema)


def reconcile(quotes: DataFrame, blocks: DataFrame, doc: str = "source_document_id") -> DataFrame:
    """quote_id, status, block_id, exact, n_blocks: where each quote stands in its document's eligible blocks.

    Exact containment goes before containment without white space; never
    across blocks, never fuzzy. Several blocks are ``ambiguous_quote`` unless
    the quote's ``hint`` names one; none is ``quote_not_found``. n_blocks
    counts the blocks of the kind that decides. A quote in very many blocks
    is counted, its blocks aren't gathered.
    """
    eligible = blocks.where(~F.col("card_eligible").eqNullSafe(False))
    hits = quote_hits(quotes, eligible, doc).groupBy("quote_id", "block_id").agg(F.max("exact").alias("exact"))
    hinted = hits.join(quotes.where("hint is not null").groupBy("quote_id").agg(F.min("hint").alias("hint")), "quote_id", "left")
    named = F.col("block_id").eqNullSafe(F.col("hint")) & F.col("hint").isNotNull()
    best = F.max("exact").alias("exact")
    per = hinted.groupBy("quote_id").agg(
        best, F.count_if("exact").alias("n_exact"), F.count("*").alias("n"), F.min(F.when(F.col("exact"), F.col("block_id"))).alias("exact_block"), F.min("block_id").alias("any_block"),
        F.min(F.when(named & F.col("exact"), F.col("block_id"))).alias("exact_hint"), F.min(F.when(named, F.col("block_id"))).alias("any_hint"),
    )
    pick = lambda a, b: F.when(F.col("exact"), F.col(a)).otherwise(F.col(b))
    per = per.select("quote_id", "exact", pick("n_exact", "n").alias("n_blocks"), pick("exact_block", "any_block").alias("first"), pick("exact_hint", "any_hint").alias("hinted"))
    rows = quotes.select("quote_id").join(per, "quote_id", "left")
    status = F.when(F.col("n_blocks").isNull(), "quote_not_found").when((F.col("n_blocks") == 1) | F.col("hinted").isNotNull(), "resolved").otherwise("ambiguous_quote")
    block = F.when(status == "resolved", F.coalesce("hinted", "first"))
    return rows.select("quote_id", status.alias("status"), block.alias("block_id"), F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))


def texts_with_quotes(texts: DataFrame, quotes: DataFrame, key: str, text: str = "text", quote_id: str = "quote_id", quote: str = "quote", most: int = CHUNK) -> DataFrame:
    """quote_id, key: every text that holds a quote letter by letter, found in one pass for each block of quotes.

    Quotes are dealt into blocks of about *most* characters, so what goes to a
    task is bounded; texts are read once for each block and never shuffled.
    An empty quote stands in every text, a null one in none.
    """
    spark = texts.sparkSession
    size = quotes.agg(F.coalesce(F.sum(F.char_length(quote) + ROW), F.lit(0))).first()[0]
    blocks = max(1, -(-size // most))
    schema = T.StructType([T.StructField(quote_id, quotes.schema[quote_id].dataType), T.StructField(key, texts.schema[key].dataType)])
    arrow, whole = to_arrow_schema(schema), spark.createDataFrame([], schema)
    for i in range(blocks):
        share: Column = F.pmod(F.xxhash64(quote_id, quote), F.lit(blocks)) == i
        rows = quotes.where(F.col(quote).isNotNull()).where(share).select(quote_id, quote).collect()  # about *most* characters
        if not rows:
            continue
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Quotes([said for _, said in shared.value])
            everywhere = [j for j, (_, said) in enumerate(shared.value) if not said]
            ids = pa.array([x for x, _ in shared.value], arrow.field(0).type)
            for batch in batches:
                at, where = [], []
                for k, said in enumerate(batch.column(1).to_pylist()):
                    found = known.within(said) + everywhere if said is not None else []
                    at += found
                    where += [k] * len(found)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), batch.column(0).take(pa.array(where, pa.int64()))], schema=arrow)

        whole = whole.unionByName(texts.select(key, text).mapInArrow(run, schema))
    return whole
